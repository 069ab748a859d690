"""Manifest, divergence audit and exact deduplication against brute force, over messy rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, exact_dedup, manifest_queries, merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, g string, row long, digest string, k0 string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def messy():
    r = random.Random(7)
    words = ["Ähre", "alpha", "Beta", "x9y", "straße", "don't"] + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rows = []
    for i in range(1300):
        lang = ["en", "en", "en", "en", "de", None, "", "fr"][i % 8]
        text = [None, "", "   ", "Same Text", "same text", "SAME TEXT é", "same text É"][i % 97] if i % 97 < 7 else " ".join(r.choices(words, k=r.randint(1, 30)))
        rows.append((i, text, lang, ["s1", "s2", None, "s3"][i % 4], r.choice([None, 0, 5, 9223372036854775807, -3]), "clash", "clash", 1, "clash", "clash"))
    rows += [rows[10]] * 3 + [(None, "same text", "en", "s1", 1, *rows[0][5:]), (None, None, "xx", "s1", None, *rows[0][5:]), (3, "other", "en", "s2", 1, *rows[0][5:])]
    rows.append((90001, "long Word " * 60_000, "en", "s9", 1, *rows[0][5:]))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """The root, and every leaf's way up as (side, sibling) steps."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            other = i ^ 1
            ways[leaf].append((None, None) if other >= len(nodes) else ("right" if other > i else "left", nodes[other]))
        nodes, at = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], ways


def manifest_by_hand(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha(*[value(v) for v in (d, s, lang, n, t)])
    first = lambda x: (x is not None, x if x is not None else 0)
    lang_key = lambda r: (r[2] is not None, (r[2] or "").encode())
    trees = []
    for _, group in groupby(sorted(rows, key=lang_key), key=lang_key):
        leaves = sorted(((r[0], leaf(*r[:5]), r) for r in group), key=lambda x: (first(x[0]), x[1]))
        trees.append((leaves, *climb([x[1] for x in leaves])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (leaves, subroot, ways), top in zip(trees, tops):
        for (d, own, r), way in zip(leaves, ways):
            struck = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and r[4] is not None
            x = leaf(*r[:4], r[4] + 1) if struck else own
            steps = way + top
            for side, other in steps:
                x = sha(x) if side is None else sha(x, other) if side == "right" else sha(other, x)
            out.append((d, own, subroot, root, sha(*[o for s, o in steps if s]), x, x == root))
    return out


def op11(docs):
    chars = F.col("n_chars").cast("decimal(20,0)")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.manifest(docs, tampered={"n_chars": F.when(struck, chars + 1).otherwise(chars)})
    return made.withColumn("proof", F.sha2(merkle.siblings(F.col("proof")), 256)).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")


def test_manifest(docs, empty):
    got = sorted(map(tuple, op11(docs).collect()), key=str)
    assert got == sorted(manifest_by_hand(messy()), key=str)
    assert not all(r[-1] for r in got) and sum(r[-1] for r in got) > len(got) / 2
    assert op11(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 1024, 1025, 2049])
def test_manifest_of_one_group(spark, n):
    rows = [(i, f"t{i}", None, "s", 1, *["x"] * 2, 1, "x", "x") for i in range(n)]
    got = sorted(map(tuple, op11(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == sorted(manifest_by_hand(rows))


def test_proofs_are_joined_where_too_many_nodes_would_be_sent(docs, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_BROADCAST_NODES", 0)
    assert sorted(map(tuple, op11(docs).collect()), key=str) == sorted(manifest_by_hand(messy()), key=str)


def divergence_by_hand(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    groups, langs, docs_of = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, w = r[2] or "", r[3] or "", words(r[1])
        groups[lang, source].update(w)
        langs[lang].update(w)
        docs_of[lang].update(set(w))
    out = []
    for lang in langs:
        kept = [t for t, n in docs_of[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, shares = share(langs[lang]), {s: share(c) for (g, s), c in groups.items() if g == lang}
        for s, p in shares.items():
            pairs = [(-sum(abs(p[t] - o[t]) for t in kept), other.encode()) for other, o in shares.items() if other != s]
            terms = [(q[t] - p[t], t.encode()) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(30, 50), (3, 4), (10_000, 50)])
def test_divergence(docs, empty, least, top):
    got = divergence.divergence(docs, least_docs=least, top=top)
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(messy(), least, top)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert divergence.divergence(empty).collect() == []


def test_divergence_in_strips(docs, monkeypatch):
    monkeypatch.setattr(divergence, "STRIP", 2)
    monkeypatch.setattr(divergence, "MAX_COUNTS", 50)
    assert sorted(map(tuple, divergence.divergence(docs, least_docs=5).collect())) == divergence_by_hand(messy(), 5, 50)


def test_skyband():
    r = random.Random(3)
    for k in (1, 2, 5):
        rows = [(r.randint(1, 6), r.randint(1, 6), f"t{r.randint(0, 99)}{i}".encode()) for i in range(120)]
        beats = lambda a, b: a != b and a[0] >= b[0] and a[1] <= b[1] and a[2] < b[2]
        want = [i for i, b in enumerate(rows) if sum(beats(a, b) for a in rows) < k]
        assert sorted(divergence.skyband(rows, k)) == want


def exact_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    ids = lambda d: -1 if d is None else d
    out = []
    for text, members in groups.items():
        best, left = max(members, key=ids), 1
        for d in members:
            stays = d == best and left
            left -= bool(stays)
            out.append((d, best, len(members), bool(stays), sha(text)))
    return sorted(out, key=str)


def test_exact(docs, empty):
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str) == exact_by_hand(messy())
    assert exact_dedup.exact_duplicates(empty).collect() == []
    kept = exact_dedup.exact_duplicates(docs, keep=docs.columns)
    assert kept.columns == [*[c for c in docs.columns if c != "kept"], "keep_id", "group_size", "kept", "text_sha256"]
    named = exact_dedup.exact_duplicates(docs.select(F.col("doc_id").cast("string").alias("a.b"), F.col("text").alias("t.x")), "a.b", "t.x")
    assert named.filter("kept").count() == len({r[4] for r in exact_by_hand(messy())})


def test_index_is_opened_again_and_extended(spark, tmp_path):
    def best(*texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
        return exact_dedup.best_of(rows.select("id", F.col("id").alias("row"), exact_dedup.digest(F.col("t")).alias("digest")))

    path = f"{tmp_path}/index"
    exact_dedup.DigestIndex(spark, path, buckets=4).append(best("a", "b", "B"), 0)
    index = exact_dedup.DigestIndex(spark, path, buckets=9)
    assert index.buckets == 4 and index.entries().count() == 2
    index.append(best("b", "c"), 1)
    index.append(best("b", "c"), 1)  # run again: sees only what came before
    assert index.entries().count() == 3 and index.entries(1).count() == 2
    # only the batch is shuffled, the index is read by buckets
    plan = index.unseen(best("d").select("digest"), 1)._jdf.queryExecution().executedPlan().toString()
    known = plan.split("LeftAnti")[1].rsplit("Sort [", 1)[1]
    assert "SortMergeJoin" in plan and "Bucketed: true" in known and "Exchange" not in known


@pytest.mark.parametrize("name", sorted(manifest_queries.QUERIES))
def test_whole_table(spark, name):
    got = manifest_queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    by_hand = {"op11": manifest_by_hand, "op12": lambda x: divergence_by_hand(x, 30, 50), "op13": exact_by_hand}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_hand[name[:4]](rows), key=str)
