"""Line deduplication as an exact set-similarity join over the words of lines.

A line is removed if an earlier line (by document, then position) has a Jaccard
similarity of at least the threshold. Lines with the same set of words are one
entry, that of the earliest. The words of a set are ordered by rarity: words are
counted over all documents, in a fixed number of hash buckets, and rare buckets come first.
Two sets that are similar share a word among their first few (prefix filter);
where they meet, their sizes, the places of the shared word and a sketch of 64 bits,
256 for long lines, bound what they can share, and the pairs that remain are verified
on all their words.

Only whether an earlier match exists is asked, so near copies need not all meet: each
set is first compared with the earliest sets that agree on the least hashes of its
prefix; two sets that this settles no longer meet, nor does one with a set that is known to come later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.common import stage
from tidemark.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
_BUCKETS = 18
_HASH_BITS = 58
_MOST_CLASS = 31
MAX_BROADCAST_LINES = 500_000
#: Longs of the wide sketch, and the words from which on a set's entries bring it: 64 bits of that many words tell little.
_WIDE, _LONG = 4, 96


def _split(text: Column) -> Column:
    """The words of a text and empty strings. Without white space other than spaces no pattern is run."""
    return F.when(text.rlike(r"[\x09-\x0D]"), F.split(text, SPACES)).otherwise(F.split(text, " "))


def word_classes(docs: DataFrame, text: str) -> str:
    """How common the words of each of 2^18 hash buckets are: the logarithm of their count, comma-joined.

    Classes are made and joined on the cluster, so the driver gets 256 strings of a few kilobytes, whatever the table.
    """
    value = F.replace(F.col(f"`{text}`").cast("string"), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(_split(value)).alias("w")).filter("w <> ''")
    ids = words.select(F.xxhash64("w").bitwiseAND(F.lit((1 << _BUCKETS) - 1)).alias("id"))
    # each bucket once more, so that none is missing
    ids = ids.unionByName(docs.sparkSession.range(1 << _BUCKETS))
    common = F.least(F.floor(F.log2("count")), F.lit(_MOST_CLASS)).cast("string")
    rows = ids.groupBy("id").count().select(F.shiftright("id", 10).alias("part"), F.struct("id", common.alias("c")).alias("bucket"))
    each = F.transform(F.sort_array(F.collect_list("bucket")), lambda x: x["c"])
    parts = rows.groupBy("part").agg(F.array_join(each, ",").alias("classes"))
    return ",".join(c for _, c in sorted(map(tuple, parts.collect())))


def _keys(line: Column, classes: str) -> Column:
    """A line's distinct words as sorted numbers: the rarest classes first, then by their hash."""
    table = F.split(F.lit(classes), ",").cast("array<tinyint>")  # the planner folds it

    def key(h: Column) -> Column:
        common = F.get(table, h.bitwiseAND(F.lit((1 << _BUCKETS) - 1)).cast("int"))
        return F.shiftleft(common.cast("long"), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))

    words = F.array_remove(_split(line), "")
    return F.sort_array(F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), key))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, h, no, line: every line that has a word. Equal id and text is the same document."""
    value = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(value).alias("h"), F.posexplode(F.split(value, "\n")).alias("no", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _sketch(words: str, part: int) -> Column:
    """64 of the wide sketch's bits: each of a set's words flips one bit of the whole sketch."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    mine = F.filter(F.col(words), lambda k: k.bitwiseAND(F.lit((_WIDE - 1) << 6)) == part << 6)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))


def line_sets(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """One row per distinct set of words: its number, first line, size, sketches and prefix.

    The sketch is what the parts of the wide one fold to by XOR; ``wide1`` to ``wide3`` are
    its parts but the first, 0 for sets that are not long.
    """
    common = word_classes(docs, text)
    keyed = stage(_lines(docs, doc_id, text), {"keys": _keys(F.col("line"), common)}).drop("line")
    n = F.size("keys")
    prefix = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    sketch = F.aggregate(
        "keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int")))
    )
    rows = keyed.select(
        F.xxhash64("keys").alias("set1"),
        F.xxhash64(F.lit(1), "keys").alias("set2"),
        F.struct(
            F.col("d").isNull().alias("no_id"),
            "d",
            "h",
            "no",
            n.alias("n"),
            sketch.alias("sketch"),
            *[F.when(n >= _LONG, _sketch("keys", i)).otherwise(0).alias(f"wide{i}") for i in range(1, _WIDE)],
            F.transform(F.slice("keys", 1, prefix), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix"),
        ).alias("first"),
    )
    return rows.groupBy("set1", "set2").agg(F.min("first").alias("first"))


def _few(table: DataFrame) -> DataFrame:
    """The table, sent to all tasks if its rows are counted to be few; else the join shuffles both sides."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_LINES else table


def near_copies(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: each set and the earliest ones that agree on least hashes of its prefix.

    Near copies agree on some of them, so nearly all of a group is compared with
    a few sets each, and what that settles need not meet any more. Pairs that
    cannot be similar by their sizes and sketches are left to the prefix join.
    """
    # words are hashes: the one nearest to a number, by XOR, is any of them with equal odds
    seeded = lambda i: lambda w: w.bitwiseXOR(F.lit(i << 28 | 0x5BD1E995 * (i + 1) & 0xFFFFFFF))
    least = F.array(*[F.array_min(F.transform("prefix", seeded(i))) for i in range(8)])
    at = lambda i: F.get("least", F.lit(i))
    bands = [F.xxhash64(F.lit(i), at(i)) for i in range(4)] + [F.xxhash64(F.lit(i), at(i), at(i + 1)) for i in range(4, 8, 2)]
    rows = stage(sets.select("set", "d", "n", "sketch", "prefix"), {"least": least}).drop("prefix")
    rows = rows.select("set", "d", "n", "sketch", F.explode(F.array(*bands)).alias("band"))
    # the least is found before the shuffle, and the join can split a band that very many sets share
    earliest = F.min(F.struct(F.col("d").isNull().alias("no_id"), "d", "set", "n", "sketch")).alias("first")
    first = rows.groupBy("band").agg(earliest, F.count("*").alias("members")).filter("members > 1")
    first = first.select("band", F.col("first.set").alias("a"), F.col("first.n").alias("a_n"), F.col("first.sketch").alias("a_sketch"))
    similar = _sizes_allow(F.col("n"), F.col("a_n"), F.col("sketch"), F.col("a_sketch"), threshold)
    pairs = rows.alias("x").join(first.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("a") != F.col("set")) & similar)
    return pairs.select("a", F.col("set").alias("b")).distinct()


def _sizes_allow(nx: Column, ny: Column, sx: Column, sy: Column, t: float) -> Column:
    """Whether sets of these sizes and sketches can be similar."""
    apart = F.bit_count(sx.bitwiseXOR(sy))
    return (F.least(nx, ny) + 1e-9 >= t * F.greatest(nx, ny)) & (apart * (1 + t) <= (1 - t) * (nx + ny) + 1e-9)


_SETTLED, _PLACE = 1 << 60, (1 << 24) - 1


def _may_match(x: str, y: str, threshold: float) -> Column:
    """Whether two entries that share a word can be similar: by sizes, places of the word, sketches."""
    t = threshold
    at = lambda s: F.col(f"{s}.at")
    size = lambda s: F.shiftright(at(s).bitwiseAND(F.lit(_SETTLED - 1)), 24)
    nx, ny = size(x), size(y)
    most = F.least(nx - at(x).bitwiseAND(F.lit(_PLACE)), ny - at(y).bitwiseAND(F.lit(_PLACE)))
    can_reach = most * (1 + t) + 1e-9 >= t * (nx + ny)
    parts = [F.col(f"{x}.wide{i}").bitwiseXOR(F.col(f"{y}.wide{i}")) for i in range(1, _WIDE)]
    first = F.col(f"{x}.sketch").bitwiseXOR(F.col(f"{y}.sketch"))
    for part in parts:
        first = first.bitwiseXOR(part)
    apart = sum((F.bit_count(p) for p in parts), F.bit_count(first))
    far = (F.least(nx, ny) >= _LONG) & (apart * (1 + t) > (1 - t) * (nx + ny) + 1e-9)
    return can_reach & _sizes_allow(nx, ny, F.col(f"{x}.sketch"), F.col(f"{y}.sketch"), t) & ~far


def _order(sets: DataFrame) -> Column:
    """A number that does not fall with a set's place; the same for all where ids are not whole numbers."""
    whole = isinstance(sets.schema["d"].dataType, T.IntegralType)
    return F.coalesce(F.col("d").cast("long"), F.lit((1 << 63) - 1)) if whole else F.lit(0).cast("long")


def similar_pairs(sets: DataFrame, settled: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of sets that share a prefix word and may be similar, unless it is known that the later one is settled.

    ``at`` of an entry: whether its set is settled, its size, and the word's place in it.
    """
    known = sets.join(_few(settled.withColumn("done", F.lit(_SETTLED))), "set", "left")
    size = F.shiftleft(F.col("n").cast("long"), 24)
    wide = [f"wide{i}" for i in range(1, _WIDE)]
    # never null, so that the join tries pairs without asking for nulls
    own = [F.coalesce(c, F.lit(0)).alias(c) for c in ("set", "sketch", *wide)]
    size = F.coalesce(F.coalesce("done", F.lit(0)) + size, F.lit(0)).alias("size")
    entry = known.select(*own, _order(sets).alias("order"), size, F.posexplode("prefix").alias("place", "word"))
    entry = entry.select("word", "set", F.coalesce(F.col("size") + F.col("place"), F.lit(0)).alias("at"), "sketch", *wide, "order")
    # both settled, or the one that is settled surely comes later
    needless = lambda x, y: (F.col(f"{x}.at") >= _SETTLED) & (
        (F.col(f"{y}.at") >= _SETTLED) | (F.col(f"{x}.order") > F.col(f"{y}.order"))
    )
    meet = (
        (F.col("x.word") == F.col("y.word"))
        & (F.col("x.set") < F.col("y.set"))
        & ~needless("x", "y")
        & ~needless("y", "x")
        & _may_match("x", "y", threshold)
    )
    return entry.alias("x").join(entry.alias("y"), meet).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """set: of each pair that is similar, the one whose first line comes later."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = materialize(sets.join(wanted, "set", "left_semi").select("set", "no_id", "d", "h", "no"), "lines-to-verify")
    place = F.struct("no_id", F.col("d").alias("wd"), F.col("h").alias("wh"), F.col("no").alias("wno"))
    # only documents that hold a wanted line are taken apart
    held = wanted.select(F.col("d").alias("wd"), F.col("h").alias("wh"), F.struct("set", place.alias("place")).alias("line"))
    held = held.groupBy("wd", "wh").agg(F.collect_list("line").alias("wanted"))
    value = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(value).alias("h"), value.alias("t"))
    held = F.broadcast(held) if wanted.count() <= MAX_BROADCAST_LINES else held
    rows = rows.join(held, F.col("d").eqNullSafe(F.col("wd")) & (F.col("h") == F.col("wh"))).select("wanted", F.split("t", "\n").alias("lines"))
    found = F.transform("wanted", lambda w: F.struct(w["set"].alias("set"), w["place"].alias("place"), F.get("lines", w["place"]["wno"]).alias("line")))
    lines = rows.select(F.inline(found))
    # words as 64-bit hashes: a line is compared by all its words, at a third of their bytes
    words = F.array_distinct(F.transform(F.array_remove(_split(F.col("line")), ""), lambda w: F.xxhash64(w)))
    texts = stage(lines.select("set", "place", words.alias("words")).dropDuplicates(["set"]), {"words": F.col("words")})
    texts = materialize(texts.withColumn("wide", F.array(*[_sketch("words", i) for i in range(_WIDE)])), "lines-verified")
    # most pairs fall to a wider sketch, before their words travel
    x, y = (texts.select(F.col("set").alias(s), F.col("wide").alias(f"{s}_wide"), F.size("words").alias(f"{s}_n")) for s in "ab")
    apart = sum((F.bit_count(F.get("a_wide", F.lit(i)).bitwiseXOR(F.get("b_wide", F.lit(i)))) for i in range(_WIDE)), F.lit(0))
    close = apart * (1 + threshold) <= (1 - threshold) * (F.col("a_n") + F.col("b_n")) + 1e-9
    pairs = pairs.join(x, "a").join(y, "b").filter(close).select("a", "b")
    x, y = (texts.select(F.col("set").alias(s), F.col("place").alias(f"{s}_place"), F.col("words").alias(f"{s}_words")) for s in "ab")
    both = stage(pairs.join(x, "a").join(y, "b"), {"shared": F.size(F.array_intersect("a_words", "b_words"))})
    alike = F.col("shared") + 1e-9 >= threshold * (F.size("a_words") + F.size("b_words") - F.col("shared"))
    later = F.when(F.col("a_place") < F.col("b_place"), F.col("b")).otherwise(F.col("a"))
    return both.filter(alike).select(later.alias("set")).distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with the text less its removed lines, n_lines with a word, and n_removed.

    Lines without a word stay. Null texts stay null. Null ids come after all
    others; rows equal in id and text are the same document and lose the same
    lines. A document may lose all its lines; its row stays.
    """
    keep = docs.columns if keep is None else keep
    found = line_sets(docs, doc_id, text, threshold).select("first.*")
    sets = materialize(found.withColumn("set", F.monotonically_increasing_id()), "line-sets")
    pairs = materialize(near_copies(sets, threshold), "line-copies")
    settled = materialize(verified(docs, sets, pairs, doc_id, text, threshold), "settled-lines")
    pairs = materialize(similar_pairs(sets, settled, threshold), "line-pairs")
    later = materialize(settled.unionByName(verified(docs, sets, pairs, doc_id, text, threshold)).distinct(), "later-lines")
    removed = _few(later)
    stay = sets.join(removed, "set", "left_anti").groupBy("d", "h").agg(F.collect_set("no").alias("stay"))
    value = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct("*").alias("row"), value.alias("t"), F.col(f"`{doc_id}`").alias("rd"), F.xxhash64(value).alias("rh"))
    joined = rows.join(stay, F.col("rd").eqNullSafe(F.col("d")) & (F.col("rh") == F.col("h")), "left")
    cut = stage(joined.select("row", "t", "stay"), {"_lines": F.coalesce(F.split("t", "\n"), F.array().cast("array<string>"))})
    every = F.transform("_lines", lambda _, i: i)
    blank = F.filter(every, lambda i: ~F.get("_lines", i).rlike(r"[^\x20\x09-\x0D]"))
    cut = stage(cut, {"_every": every, "_blank": blank})
    stays = F.array_intersect("_every", F.coalesce("stay", F.array().cast("array<int>")))
    left = F.transform(F.sort_array(F.array_union(stays, "_blank")), lambda i: F.get("_lines", i))
    n = (F.size("_every") - F.size("_blank")).cast("long")
    done = stage(cut, {"_left": F.when(F.col("t").isNotNull(), F.array_join(left, "\n")), "_n": n, "_removed": n - F.size(stays)})
    return done.select(
        *[F.col("_left" if c == text else f"row.`{c}`").alias(c) for c in keep],
        F.col("_n").alias("n_lines"),
        F.col("_removed").cast("long").alias("n_removed"),
    )
