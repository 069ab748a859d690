"""A Merkle manifest of a table, with each row's proof by pointer jumping.

The rows of a group are the leaves of a binary tree, in order; the roots of the
groups are the leaves of a tree over the groups. Positions come from a sort by
ranges, so no group is sorted in one task. Trees are folded in blocks of 1024
neighbouring nodes, ten levels at a time.

Every node starts with a pointer to its parent and the segment of its proof up
to there: its sibling. Joining nodes with the nodes that they point to doubles
the distance and appends the segment found there, so after log2(height) rounds
a leaf points at the root and holds its whole proof. Only nodes at levels that
are multiples of the distance take part in later rounds, so all rounds together
read little more than the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import stage
from tidemark.operators.ranking import ranked
from tidemark.operators.skew import lookup_join
from tidemark.session import materialize

#: Levels that one block of nodes is folded by.
BLOCK_LEVELS = 10
#: Nodes sent to all tasks at most, each with a segment of 33 bytes a level; of more, both sides are shuffled.
MAX_BROADCAST_NODES = 20_000
_NONE, _RIGHT, _LEFT = "00", "01", "02"
#: Bytes of a proof's step: where the sibling stands, and its digest (zeros without one).
STEP = 33


def encoded(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parents(level: Column) -> Column:
    """The digests of the level above an array of digests: of every two, the last alone if one is left."""
    pairs = F.sequence(F.lit(0), (F.size(level) - 1).bitwiseAND(F.lit(~1)), F.lit(2))
    two = lambda i: F.concat(_hex(F.get(level, i)), F.coalesce(_hex(F.get(level, i + 1)), F.lit("")))
    return F.transform(pairs, lambda i: F.unhex(F.sha2(two(i).cast("binary"), 256)))


def _fold(nodes: DataFrame, base: int) -> DataFrame:
    """g, size, pos, levels: per block of nodes of level ``base`` the digests of its levels, up to the group's root."""
    block = F.shiftright("pos", BLOCK_LEVELS)
    rows = nodes.groupBy("g", "size", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("of"))
    out = rows.select("g", "size", "block", F.col("of.digest").alias("l0"))
    for j in range(BLOCK_LEVELS):
        # a group has one node on this level: its root
        ends = F.col("size") <= F.lit(1 << (base + j)).cast("long")
        out = stage(out, {f"l{j + 1}": F.when(~ends, _parents(F.col(f"l{j}")))})
    return out.select("g", "size", "block", F.array(*[f"l{j}" for j in range(BLOCK_LEVELS + 1)]).alias("levels"))


def _steps(folded: DataFrame, base: int) -> DataFrame:
    """g, level, pos, seg: every node below the root of its group with its sibling."""
    rows = folded.select("g", "block", F.posexplode(F.slice("levels", 1, BLOCK_LEVELS)).alias("j", "level_of"), F.col("levels").alias("_levels"))
    rows = rows.filter(F.get("_levels", F.col("j") + 1).isNotNull())
    rows = rows.select("g", "block", "j", "level_of", F.posexplode("level_of").alias("i", "digest"))
    other = F.get("level_of", F.col("i").bitwiseXOR(F.lit(1)))
    side = F.when(other.isNull(), F.unhex(F.lit(_NONE))).when(F.col("i") % 2 == 0, F.unhex(F.lit(_RIGHT))).otherwise(F.unhex(F.lit(_LEFT)))
    pos = F.col("block") * F.call_function("shiftleft", F.lit(1), BLOCK_LEVELS - F.col("j")) + F.col("i")
    return rows.select(
        "g",
        (F.col("j") + base).alias("level"),
        pos.cast("long").alias("pos"),
        F.concat(side, F.coalesce(other, F.unhex(F.lit("00" * (STEP - 1))))).alias("seg"),
    )


def _tree(leaves: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the roots with their siblings, and g, size, root per group. ``leaves``: g, size, pos from 0 on, digest."""
    nodes, steps, roots = leaves, [], []
    for base in range(0, max(height, 1), BLOCK_LEVELS):
        folded = materialize(_fold(nodes, base), "merkle-blocks")
        steps.append(_steps(folded, base))
        top = folded.select("g", "size", "block", F.posexplode("levels").alias("j", "level_of")).filter(F.size("level_of") >= 1)
        last = F.lit(1 << base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
        # the first level with one node in all
        whole = top.filter((F.col("size") <= last) & ((F.col("size") > F.shiftright(last, 1)) | (last == 1)))
        roots.append(whole.select("g", "size", F.get("level_of", F.lit(0)).alias("root")))
        nodes = top.filter((F.col("j") == BLOCK_LEVELS) & (F.col("size") > last))
        nodes = nodes.select("g", "size", F.col("block").alias("pos"), F.get("level_of", F.lit(0)).alias("digest"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(steps), union(roots)


def _height(size: int) -> int:
    return max(0, size - 1).bit_length()


def _jump(nodes: DataFrame, targets: DataFrame, n_targets: int, distance: int) -> DataFrame:
    """Nodes with the segment of the node that they point to appended; beyond the root there is none."""
    found = targets.select(F.col("g").alias("_g"), F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("seg").alias("_seg"))
    found = F.broadcast(found) if n_targets <= MAX_BROADCAST_NODES else found
    up = (F.col("g") == F.col("_g")) & (F.col("level") + distance == F.col("_level"))
    joined = nodes.join(found, up & (F.shiftright("pos", distance) == F.col("_pos")), "left")
    return joined.withColumn("seg", F.concat("seg", F.coalesce("_seg", F.unhex(F.lit(""))))).select(*nodes.columns)


def proofs(leaves: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """The leaves' g, pos and payload with ``seg``, their proof below the root of their group; and g, size, root.

    ``leaves``: g (not null), size (of the group), pos (from 0 on), digest (binary) and the payload.
    """
    leaves = materialize(leaves.select("g", "size", "pos", "digest", *payload), "merkle-leaves")
    height = _height(leaves.agg(F.max("size")).first()[0] or 0)
    steps, roots = _tree(leaves.select("g", "size", "pos", "digest"), height)
    steps = materialize(steps, "merkle-nodes")
    own = steps.filter("level = 0").select("g", "pos", F.col("seg").alias("first"))
    rows = leaves.select("g", "pos", F.lit(0).alias("level"), *payload).join(own, ["g", "pos"], "left")
    rows = rows.withColumn("seg", F.coalesce("first", F.unhex(F.lit("")))).drop("first")
    inner, distance = steps.filter("level > 0"), 1
    while distance < height:
        # pointers of this length end at levels that are odd multiples of it
        targets = inner.filter(F.col("level") % (2 * distance) == distance)
        nearest = targets.filter(F.col("level") == distance)
        rows = _jump(rows, nearest, nearest.count(), distance)
        rest = inner.filter(F.col("level") % (2 * distance) == 0)
        inner = materialize(_jump(rest, targets, targets.count(), distance), "merkle-jumps")
        distance *= 2
    return rows.drop("level"), materialize(roots, "merkle-roots")


def _part(seg: Column, i: Column, start: int, length: int) -> Column:
    """Bytes of the i-th step of a proof."""
    return F.substr(seg, i * STEP + (start + 1), F.lit(length))


def folded(leaf: Column, seg: Column) -> Column:
    """The root as hex, recomputed from a leaf's hex digest and its proof."""
    steps = F.sequence(F.lit(1), F.floor(F.octet_length(seg) / STEP).cast("int"))

    def up(x: Column, i: Column) -> Column:
        side, other = F.hex(_part(seg, i - 1, 0, 1)), _hex(_part(seg, i - 1, 1, STEP - 1))
        both = F.when(side == _RIGHT, F.concat(x, other)).when(side == _LEFT, F.concat(other, x)).otherwise(x)
        return F.sha2(both.cast("binary"), 256)

    return F.when(F.octet_length(seg) == 0, leaf).otherwise(F.aggregate(steps, leaf, up))


def siblings(seg: Column) -> Column:
    """The hex digests of the siblings of a proof, from the leaf to the root, as one string."""
    steps = F.sequence(F.lit(0), F.floor(F.octet_length(seg) / STEP).cast("int"))
    there = F.filter(steps, lambda i: F.hex(_part(seg, i, 0, 1)).isin(_RIGHT, _LEFT))
    return F.array_join(F.transform(there, lambda i: _hex(_part(seg, i, 1, STEP - 1))), "")


def manifest(
    docs: DataFrame,
    group: str = "lang",
    doc_id: str = "doc_id",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns, leaf, subroot, root, proof, folded_root and verified of every row.

    Leaves of a group ascend by id, null first, then by digest; rows equal in
    all fields have equal leaves and one place each. Groups ascend by their UTF-8
    bytes, null first. ``proof`` is binary: per level 33 bytes, where the sibling
    stands (0 none, 1 right, 2 left) and its digest; ``siblings`` and ``folded``
    read it. ``tampered`` gives some fields other values, over the
    row's own columns; with them the leaf is recomputed and folded with the
    original proof. An empty table gives an empty table.
    """
    keep = [doc_id] if keep is None else keep
    plain = lambda c: F.col(f"`{c}`")
    changed = tampered or {}
    lang = plain(group).cast("string")
    rows = docs.select(
        *[plain(c).alias(f"k{i}") for i, c in enumerate(keep)],
        plain(doc_id).alias("id"),
        F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), lang)).alias("g"),
        leaf_digest([plain(c) for c in fields]).alias("digest"),
        leaf_digest([changed.get(c, plain(c)) for c in fields]).alias("other"),
    )
    # the texts are read once; the row number spreads rows that are equal in everything else
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = ranked(rows, [F.col("id"), F.col("digest"), F.col("row")], ["g"], "place", "size")
    placed = placed.withColumns({"pos": F.col("place") - 1, "leaf": F.col("digest")})
    leaves, subroots = proofs(placed, [*[f"k{i}" for i in range(len(keep))], "leaf", "other"])
    top = ranked(subroots.withColumn("all", F.lit("all")), [F.col("g")], ["all"], "place", "groups")
    top = top.select(
        F.col("all").alias("g"),
        F.col("groups").alias("size"),
        (F.col("place") - 1).alias("pos"),
        F.col("root").alias("digest"),
        F.col("g").alias("name"),
        F.col("root").alias("subroot"),
        F.col("size").alias("n"),
    )
    upper, root = proofs(top, ["name", "subroot", "n"])
    upper = upper.join(F.broadcast(root.select("g", "root")), "g")
    upper = materialize(upper.select(F.col("name").alias("g"), "n", "subroot", F.col("seg").alias("upper"), "root"), "merkle-groups")
    found = lookup_join(leaves, upper, ["g"], "n", F.col("pos"))
    found = stage(found, {"proof": F.concat("seg", "upper"), "leaf": _hex(F.col("leaf")), "other": _hex(F.col("other"))})
    found = stage(found, {"folded_root": folded(F.col("other"), F.col("proof")), "root": _hex(F.col("root"))})
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "leaf",
        _hex(F.col("subroot")).alias("subroot"),
        "root",
        "proof",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
