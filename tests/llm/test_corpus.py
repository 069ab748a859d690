"""The pipeline's operators against brute force, over messy rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, line_dedup, packing, quality, simhash
from tidemark.llm.components import components
from tidemark.llm.corpus_queries import word_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long, k0 string, set string, ids binary"


def messy():
    """Nulls, empty, very long and repeated texts, repeated and null ids, ties."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "zwölf", "the", "of", "a1", "x-y", "Omega", "straße"] + [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [make(r.randint(60, 140)) for _ in range(12)]
    texts = [None, None, "", "", " \n\t ", "one", "one two", "One two", "one two three"]
    texts += base + base[:4]
    for t in base[:6]:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[r.randrange(len(v))] = r.choice(words)
            texts.append(" ".join(v))
    lines = [make(r.randint(2, 14)) for _ in range(25)]
    for _ in range(15):
        chosen = [r.choice(lines) for _ in range(r.randint(1, 9))]
        texts.append("\n".join(" ".join(r.sample(x.split(), len(x.split()))) if r.random() < 0.3 else x for x in chosen) + "\n\n")
    texts.append((make(4000) + "\n") * 2)
    texts.append("!!! ### $$$ " * 60)
    texts.append("same words again " * 50)
    rows = [(i, t, "en", "s", len(t or ""), -1, -2, "clash", "clash", b"x") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, base[0], *rows[0][2:]), (None, None, *rows[0][2:]), (3, base[1], *rows[0][2:])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def items_of(rows):
    r = random.Random(3)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    cut = lambda t, n: " ".join(t.split()[r.randrange(20) :][:n])
    items = [(1, cut(long[0], 30)), (2, cut(long[1], 13)), (3, cut(long[2], 12)), (4, "One, two"), (5, ""), (6, None), (7, "...")]
    items += [(8, cut(long[3], 20).upper()), (8, cut(long[4], 25)), (None, cut(long[5], 14)), (9, cut(long[-1], 200)), (10, "zz yy xx ww vv")]
    return items


def test_decontamination(spark, docs, empty):
    rows, items = messy(), items_of(messy())
    grab = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = {}
    for i, t in items:
        w = grab(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    want = Counter()
    for row in rows:
        w, hit, found = grab(row[1]), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in found - {None})
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        want[(row[0], len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w))] += 1
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    for bits in (24, 6):  # a full bitmap lets everything through and changes nothing
        got = decontamination.contamination(docs, table, log2_bits=bits)
        assert Counter(map(tuple, got.collect())) == want
    assert sum(n for k, n in want.items() if k[2]) > 10
    assert decontamination.contamination(empty, table).count() == 0
    clean = decontamination.contamination(docs, table.limit(0)).filter("n_hit > 0 or contaminated")
    assert clean.count() == 0


def brute_fingerprint(text):
    w = words_of(ascii_lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    label = list(range(len(values)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, empty):
    rows = messy()
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_components(prints)
    least = {}
    for g, row in zip(groups, rows):
        least[g] = min(least.get(g, 10**9), 10**9 if row[0] is None else row[0])
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups))
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id", "stays").collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == want
    assert len(set(groups)) < len(set(prints)), "no link between different fingerprints"
    stay = [r for r in got if r["stays"]]
    assert len(stay) == len(set(groups)) and all(r["doc_id"] == r["component_id"] for r in stay)
    assert simhash.near_duplicates(empty).count() == 0
    odd = docs.withColumnsRenamed({"doc_id": "a.b", "lang": "first", "source": "component", "k0": "simhash_bits", "set": "node"})
    names = ["a.b", "first", "component", "simhash_bits", "node"]
    clash = simhash.near_duplicates(odd, "a.b", keep=names)
    assert clash.columns == [*names, "fingerprint", "component_id", "stays"] and clash.count() == len(got)
    assert packing.pack(odd, word_tokenizer(), "a.b").columns[0] == "a.b"


@pytest.mark.parametrize("size", [300, 6000])
def test_links_of_a_large_group_of_near_copies(spark, size):
    r = random.Random(size)
    values = {r.getrandbits(64)}
    while len(values) < size:  # a tight group: most have many links
        v = r.choice(list(values)) if len(values) < 50 or r.random() < 0.01 else next(iter(values))
        values.add(v ^ sum(1 << b for b in r.sample(range(20), r.randint(1, 5))))
    values |= {r.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "simhash_bits long"))
    found = {r.node: r.component for r in components(links).collect()}
    listed, sizes = np.array(sorted(values), np.uint64), []
    left = np.ones(len(listed), bool)
    for i in range(len(listed)):
        queue, n = [i] if left[i] else [], 0
        left[i] = False
        while queue:
            j, n = queue.pop(), n + 1
            near = np.flatnonzero(left & (np.bitwise_count(listed ^ listed[j]) <= 3))
            left[near] = False
            queue += near.tolist()
        sizes += [n] * (n > 0)
    ours = Counter(found.get(v - (1 << 64) if v >> 63 else v, v) for v in values).values()
    assert sorted(ours) == sorted(sizes) and max(sizes) > 0.5 * size
    assert links.count() < 60 * size


def brute_facts(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality(docs, empty):
    want = Counter((r[0], *brute_facts(r[1])) for r in messy())
    got = quality.quality(docs, keep=["doc_id", "n_words"]).toDF("doc_id", "clash", *["n_words", "a", "b", "c", "d", "failed", "kept", "p"], *[f"v{i}" for i in range(len(quality.RULES))])
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.a, r.b, r.c, r.d, r.failed) for r in rows) == want
    assert not any(r.kept and r.failed for r in rows) and all(r.clash == -1 for r in rows)
    assert all(r.kept == (not r.failed and r.p >= 0.5) for r in rows)
    assert quality.quality(empty).count() == 0


def test_label_model_finds_the_rules_that_are_right():
    r = random.Random(1)
    right = [0.95, 0.9, 0.85, 0.9, 0.6, 0.9, 0.8, 0.9, 0.85, 0.9, 0.7][: len(quality.RULES)]
    counts, truth = Counter(), []
    for _ in range(20000):
        good = r.random() < 0.7
        votes = tuple(0 if r.random() < 0.2 else (1 if (r.random() < p) == good else -1) for p in right)
        counts[votes] += 1
        truth.append((good, votes))
    model = quality.fit(sorted(counts.items()))
    assert abs(model.good - 0.7) < 0.03
    assert all(abs(a - p) < 0.05 for a, p in zip(model.right_if_good, right))
    agree = sum((quality.posterior(model, v) >= 0.5) == g for g, v in truth) / len(truth)
    majority = sum((sum(v) > 0) == g for g, v in truth) / len(truth)
    assert agree > max(0.93, majority)


def test_quality_finds_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, keep=["doc_id"]).join(labels, "doc_id").select("base_failed", "kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_line_dedup(docs, empty):
    for threshold in (0.8, 0.5):
        lines, docs_seen = [], {}
        for r in messy():
            docs_seen.setdefault((r[0] is None, r[0], r[1]), r)
        ordered = sorted((k for k in docs_seen if k[2] is not None), key=lambda k: (k[0], k[1] or 0))
        # equal ids with other texts come in the order of the texts' hashes
        hashed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (x >> 63)
        ordered.sort(key=lambda k: (k[0], k[1] or 0, hashed(k[2])))
        for k in ordered:
            lines += [(k, i, frozenset(words_of(x))) for i, x in enumerate(k[2].split("\n")) if words_of(x)]
        gone = set()
        for n, (k, i, s) in enumerate(lines):
            if any(len(s & e) >= threshold * len(s | e) - 1e-9 for _, _, e in lines[:n]):
                gone.add((k, i))
        want = Counter()
        for r in messy():
            k = (r[0] is None, r[0], r[1])
            kept = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if (k, i) not in gone)
            n = sum(bool(words_of(x)) for x in (r[1] or "").split("\n"))
            want[(r[0], kept, n, sum((k, i) in gone for i in range(len((r[1] or "").split("\n")))))] += 1
        got = line_dedup.dedup_lines(docs, threshold=threshold, keep=["doc_id", "text"])
        assert Counter(map(tuple, got.collect())) == want
        assert sum(r[3] > 0 for r in want) > 15
    assert line_dedup.dedup_lines(empty).count() == 0


def test_classes_of_words_reach_the_driver_as_few_short_strings(spark, monkeypatch):
    text = "\n".join([" ".join(["often"] * 1000), "twice\ttwice  once", ""])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows, kind = [], type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: rows.extend(got := collect(self)) or got)
    classes = line_dedup.word_classes(docs, "text").split(",")
    assert len(rows) == 256 and all(isinstance(v, (int, str)) and len(str(v)) < 4096 for r in rows for v in r)
    at = lambda w: int(classes[xxhash.xxh64_intdigest(w.encode(), 42) & ((1 << 18) - 1)])
    # logarithms of the counts, a bucket counting one more
    assert [at(w) for w in ("often", "twice", "once")] == [9, 1, 1]
    assert len(classes) == 1 << 18 and sum(map(int, classes)) == 11


def test_near_copies_take_the_earliest_set_without_sorting_a_band(spark):
    rows = [(10, 7, [1, 2]), (11, 3, [1, 2]), (12, None, [1, 2]), (13, 3, [1, 2]), (14, None, [8, 9]), (15, 5, [8, 9]), (16, 1, [5])]
    table = [(s, d, len(p), 0, p) for s, d, p in rows]
    # the same prefix and a size or a sketch that cannot be similar
    table += [(17, 9, 40, 0, [1, 2]), (18, 9, 2, 255, [1, 2])]
    got = line_dedup.near_copies(spark.createDataFrame(table, "set long, d long, n int, sketch long, prefix array<int>"), 0.8)
    assert sorted(map(tuple, got.collect())) == [(11, 10), (11, 12), (11, 13), (15, 14)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()



def test_long_lines_that_share_a_rare_word_or_are_settled_make_no_pairs(spark):
    r = random.Random(5)
    common = [f"word{i}" for i in range(3000)]
    # 150 lines of 150 words with the same rare word; lines of one word more than the first line has
    apart = [" ".join(["rareword", *r.sample(common, 149)]) for _ in range(150)]
    alike = [apart[0] + f" other{i}" for i in range(30)]
    rows = [(i, line) for i, line in enumerate(apart + alike)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = line_dedup.line_sets(docs, "doc_id", "text", 0.8).select("first.*").withColumn("set", 1000 - F.col("d"))
    sets = sets.localCheckpoint()
    none = spark.createDataFrame([], "set long")
    pairs = {frozenset(p) for p in line_dedup.similar_pairs(sets, none, 0.8).collect()}
    group = [1000, *(1000 - 150 - i for i in range(30))]
    assert pairs == {frozenset((a, b)) for a in group for b in group if a < b}
    # all of the group but its first and its last are settled: the last meets all earlier ones, the first no later one
    settled = spark.createDataFrame([(s,) for s in group[1:-1]], "set long")
    got = {frozenset(p) for p in line_dedup.similar_pairs(sets, settled, 0.8).collect()}
    assert got == {frozenset((group[-1], s)) for s in group[:-1]}
    # ids that are not whole numbers tell no order here: pairs with an unsettled set stay
    named = sets.withColumn("d", F.col("d").cast("string"))
    got = {frozenset(p) for p in line_dedup.similar_pairs(named, settled, 0.8).collect()}
    assert got == {frozenset((s, e)) for e in (group[0], group[-1]) for s in group if s != e}


def check_pieces(pieces, texts, capacity, padded=False):
    """pieces: rows of pack(); texts: (id, text) rows."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = Counter()
    for i, t in texts:
        want[(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]))] += 1
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and (padded or at == capacity or at & (at - 1) == 0), "padding"
    # each document's pieces are its ids in order; documents of one id and size are told apart by their sums
    by_id = {}
    for p in pieces:
        by_id.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    for (i, ids), n in want.items():
        mine = by_id[(i, len(ids))]
        raw = lambda s, k: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + k]))
        covered = Counter(q for s, k, c in mine if raw(s, k) == c for q in range(s, s + k))
        assert all(covered[q] >= n for q in range(len(ids)))
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


@pytest.mark.parametrize("capacity,windows,fan_in", [(4096, 16, 64), (64, 3, 2)])
def test_packing(docs, empty, capacity, windows, fan_in):
    pieces = packing.pack(docs, word_tokenizer(), capacity=capacity, windows=windows, fan_in=fan_in).collect()
    check_pieces(pieces, [(r[0], r[1]) for r in messy()], capacity)
    assert packing.pack(empty, word_tokenizer()).count() == 0


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_pieces(packing.pack(docs.repartition(7), word_tokenizer()).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_odd_texts_have_the_ids_of_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import WordEncoder

    odd = ["¶ a¶b ¶¶", "don't I'VE 12 3.5", " a b\x85c", "é É ́x", "日本語 テスト", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ ς", "\x1c\x1d x​y", "ﬁ İi ẞ", "😀😀 👨‍👩‍👧", None, "", "é.É, x×. a÷! ß? ø;ñ:", "a.b.c,d a.'s A!'T x.'re", "a≮ b.́c é.̂", "…. a…. b’s. C3#4$5%", "İ. ǅ, a|. |b.", "<|ENDOFTEXT|> <|endoftext|>."]
    encoder, tokenizer = WordEncoder(word_tokenizer(), cache_words=5, per_call=3), Tokenizer.from_file(word_tokenizer())
    for texts in (odd, odd[::-1], odd[:3]):
        ids, bounds = encoder.encode(pa.array(texts))
        for t, low, high in zip(texts, bounds, bounds[1:]):
            assert ids[low:high].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_words_of_letters_are_encoded_without_marks(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import MARK, WordEncoder

    encoder, tokenizer = WordEncoder(word_tokenizer(), per_call=3), Tokenizer.from_file(word_tokenizer())
    calls, run = [], encoder._run
    monkeypatch.setattr(encoder, "_run", lambda rows: (calls.extend(rows), run(rows))[1])
    texts = ["Plain words of letters, " + "q" * 300, "don't 12 plain of new wordsss"]
    ids, bounds = encoder.encode(pa.array(texts))
    for t, low, high in zip(texts, bounds, bounds[1:]):
        assert ids[low:high].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert "plain words of" in calls and not any(MARK in c for c in calls if "letters" in c)
    # a tokenizer whose tokens do not tell a word's end gets marks
    encoder = WordEncoder(word_tokenizer())
    encoder.ends = np.zeros_like(encoder.ends)
    assert encoder.encode(pa.array(texts))[0].tolist() == ids.tolist()


def test_words_of_latin_letters_are_encoded_without_marks(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import MARK, WordEncoder

    encoder, tokenizer = WordEncoder(word_tokenizer()), Tokenizer.from_file(word_tokenizer())
    calls, run = [], encoder._run
    monkeypatch.setattr(encoder, "_run", lambda rows: (calls.extend(rows), run(rows))[1])
    r = random.Random(3)
    letters = [chr(c) for c in range(0xC0, 0x100) if chr(c) not in "×÷"] + list("abcdenrst")
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    texts += ["façade naïve", "naïve façade × ÷ été"]
    ids, bounds = encoder.encode(pa.array(texts))
    for t, low, high in zip(texts, bounds, bounds[1:]):
        assert ids[low:high].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert not any(MARK in c for c in calls if "façade" in c)


def test_pipeline(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    pieces = got.collect()
    assert {p.doc_id for p in pieces} <= kept and len({p.doc_id for p in pieces}) > 0.5 * len(texts)


def test_pipeline_stages_take_messy_and_empty_tables(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
