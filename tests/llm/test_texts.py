"""Licence scans, chat formatting, repeated passages, token counts and binary output over messy rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import SCHEMA, ascii_lower, check_pieces, messy
from tidemark.llm import chat, licences, passages, token_counts, token_files
from tidemark.llm.corpus_queries import word_tokenizer
from tidemark.llm.text_queries import piece_model


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- chat


def tree_rows():
    r = random.Random(2)
    rows = []
    for conv in (1, 2, 3, None):
        for node in range(40):
            parent = None if node == 0 else r.randrange(node) if node < 39 else 777
            text = r.choice([None, "", "hi", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "a<\\\\|b|>", "line\nline", "é😀<|"])
            rows.append((conv, node, parent, r.choice(["user", "assistant", "system", None, "a\nb%0A<|"]), text, r.choice([None, 0.5, 1.0, -2.0])))
    rows += [(4, n, n - 1 if n else None, "user" if n % 2 else "assistant", f"t{n}", 1.0) for n in range(70)]  # a long chain
    rows += [(5, 1, 2, "user", "circle", 1.0), (5, 2, 1, "user", "circle", 1.0), (5, 3, None, "user", "root", 1.0)]
    rows += [rows[3], rows[3], (6, None, None, "user", "no node", 1.0)]
    return rows


TREE = "conv_id long, node long, parent long, role string, text string, score double"


def brute_paths(rows):
    nodes = {}
    for c, v, p, role, text, s in rows:
        if v is not None:
            key = (p is not None, p or 0, role or "", text or "", -(s or 0.0))
            nodes[(c, v)] = min(nodes.get((c, v), key), key)
    out = {}
    for c, v in nodes:
        if any(k[0] == c and n[0] and n[1] == v for k, n in nodes.items()):
            continue
        path, at = [], v
        while (c, at) in nodes and len(path) <= len(nodes):
            path.append(at)
            at = nodes[(c, at)][1] if nodes[(c, at)][0] else None
        if len(path) <= len(nodes):
            score = sum(-nodes[(c, x)][4] for x in path)
            out.setdefault(c, []).append((-score, -len(path), v, [(nodes[(c, x)][2], nodes[(c, x)][3]) for x in path[::-1]]))
    return {c: sorted(p) for c, p in out.items()}


@pytest.mark.parametrize("best", [1, 3, None])
def test_chat(spark, best):
    df = spark.createDataFrame(tree_rows(), TREE).withColumn("rank", F.lit("clash")).withColumn("c", F.lit(1)).repartition(4)
    done = chat.format_conversations(df, best=best)
    got = done.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    want = brute_paths(tree_rows())
    expected = {(c, p[2]): (i + 1, p[3]) for c, paths in want.items() for i, p in enumerate(paths[:best])}
    assert {(r.conv_id, r.path) for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        rank, turns = expected[(r.conv_id, r.path)]
        assert r["rank"] == rank and r.n_turns == len(turns)
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(turns)


def test_chat_of_no_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], TREE)).count() == 0


# --- repeated passages


def brute_passages(rows, min_words):
    docs = {(i, t or "") for i, t in rows}
    words = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(d[1])) for d in docs}
    where = {}
    for d, w in words.items():
        for s in range(len(w) - min_words + 1):
            where.setdefault(tuple(w[s : s + min_words]), set()).add(d)
    out = []
    for d, w in words.items():
        spans = []
        for s in range(len(w) - min_words + 1):
            holders = where[tuple(w[s : s + min_words])]
            if len(holders) > 1:
                ids = [x[0] for x in holders if x[0] is not None]
                seen = d[0] is not None and min(ids) < d[0]
                if spans and s <= spans[-1][1] + min_words:
                    spans[-1][1:] = [s, spans[-1][2] + seen]
                else:
                    spans.append([s, s, int(seen)])
        out += [(d[0], a, b + min_words - a, seen) for a, b, seen in spans]
    return Counter(out)


def test_passages(spark, docs, empty):
    r = random.Random(9)
    make = lambda n: " ".join(r.choice(["ab", "cd", "ef", "gh"]) + str(r.randrange(40)) for _ in range(n))
    passage = [make(n) for n in (49, 50, 51, 80, 200)]
    extra = []
    for i in range(1000, 1040):
        parts = [make(r.randrange(60))] + [x for p in r.sample(passage, 2) for x in (p, make(r.randrange(30)))]
        extra.append((i, " ".join(parts)))
    extra += [(1100, passage[3] + " " + passage[3]), (1101, (make(60) + " ") * 3), (1102, "same " * 120), (1103, "same " * 300)]
    rows = [(x[0], x[1]) for x in messy()] + extra
    table = docs.select("doc_id", "text", "set").unionByName(spark.createDataFrame([(*x, "s") for x in extra], "doc_id long, text string, set string"))
    got = passages.repeated_passages(table)
    want = brute_passages(rows, 50)
    assert Counter(map(tuple, got.select("doc_id", "start", "n_words", "n_seen_before").collect())) == want
    assert len(want) > 60 and passages.repeated_passages(empty).count() == 0


def brute_removed(rows, min_words):
    """Spans of removed words of each document by id, and its text without them."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    seen, out = set(), {}
    for doc, text in sorted(rows):
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        at = [m.span() for m in word.finditer(low)]
        words = [low[a:b] for a, b in at]
        gone = set()
        for i in range(len(words) - min_words + 1):
            window = tuple(words[i : i + min_words])
            if window in seen:
                gone.update(range(i, i + min_words))
            seen.add(window)
        spans = []
        for i in sorted(gone):
            if spans and sum(spans[-1]) == i:
                spans[-1] = (spans[-1][0], spans[-1][1] + 1)
            else:
                spans.append((i, 1))
        for start, n in reversed(spans):
            end = at[start + n][0] if start + n < len(at) else at[start + n - 1][1]
            text = text[: at[start][0]] + text[end:]
        out[doc] = (len(words), len(gone), spans, text)
    return out


def test_windows_of_passages_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(passages, "materialize", lambda df, name: (written.append((name, df.columns)), df)[1])
    shared = " ".join("w%d" % i for i in range(60))
    rows = [(2, "a " + shared), (1, shared + " b"), (None, "c d " + shared), (3, "e f")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    # the null id is no earlier document, and has none before it
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, 60, 0), (2, 1, 60, 11), (None, 2, 60, 0)]
    assert [n for n, _ in written] == ["suffixes", "candidate-suffixes", "candidate-windows"]
    assert written[-1][1] == ["h", "doc", "id", "pos"]


def test_removal_of_passages(spark, empty):
    r = random.Random(12)
    make = lambda n: " ".join("w%d" % r.randrange(5000) for _ in range(n))
    early, late = make(60), make(70)
    # the middle one holds a passage of an earlier document right beside one of a later document
    rows = [(1, make(20) + " " + early + "."), (2, make(9) + "; " + early.upper() + " - " + late + "! " + make(5)), (3, late + ", " + make(30))]
    rows += [(4, ", ".join([early[:0] + make(55)] * 3) + "."), (5, "same " * 300), (6, ""), (7, "(" + make(3) + ")"), (8, rows[0][1]), (9, "É😀 " + late + " é😀\n")]
    rows += [(10 + i, " / ".join(r.sample([early, late, make(51), make(80), make(7)], 4))) for i in range(40)]
    table = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.n_removed, [tuple(s) for s in x.spans], x.text) for x in passages.without_repeats(table).collect()}
    assert got == brute_removed(rows, 50)
    assert got[2][2] == [(9, 60)] and got[3][2] == [(0, 70)] and got[4][2] == [(55, 110)] and got[8][3] == "."
    assert passages.without_repeats(empty).count() == 0


# --- token counts


def test_token_counts_equal_a_unigram_tokenizer(docs, empty):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.normalizers import Prepend, Replace, Sequence

    pieces = token_counts.vocabulary(piece_model())
    fallback = [(f"<0x{i:02X}>", -1e9) for i in range(256)]
    tokenizer = Tokenizer(Unigram([("<unk>", -1e9), *pieces, *fallback], unk_id=0, byte_fallback=True))
    tokenizer.normalizer = Sequence([Replace(" ", "▁"), Prepend("▁")])
    odd = ["a▁ b", "▁", "  lead", "trail  ", "a   b    c", "new\nline\t x", "日本語 テスト", "é ́x", "\x00 \x7f", "😀😀 ok", "х" * 50]
    rows = messy() + [(900 + i, t, *messy()[0][2:]) for i, t in enumerate(odd)]
    want = Counter((r[0], len(tokenizer.encode(r[1], add_special_tokens=False).ids) if r[1] else 0) for r in rows)
    spark = docs.sparkSession
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(4), piece_model())
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_counts.token_counts(empty, piece_model()).count() == 0


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_ties_and_unknown_runs(byte_fallback):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    r = random.Random(4)
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aab": -3.0, "▁": -1.0, "▁a": -2.0, "c▁": -3.0, "bb": -2.0, "abab": -4.0, "da": -1.0}
    counter = token_counts.Counter(list(pieces.items()), byte_fallback, cache_words=4)
    tokens = [(f"<0x{i:02X}>", -1e3) for i in range(256)] if byte_fallback else []
    tokenizer = Tokenizer(Unigram([("<unk>", -1e3), *pieces.items(), *tokens], unk_id=0, byte_fallback=byte_fallback))
    texts = ["".join(r.choice("abcdé ") for _ in range(r.randrange(1, 25))) for _ in range(300)]
    _, counts = counter.column(pa.array(texts))
    for text, n in zip(texts, counts.tolist()):
        assert n == len(tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text


# --- binary output


def test_token_files(docs, empty, tmp_path):
    for width, block in ((4096, 2_000_000), (32, 500)):
        written = token_files.shards(docs, word_tokenizer(), width=width, block_tokens=block)
        path = str(tmp_path / f"shards{width}")
        written.write.parquet(path)
        back = docs.sparkSession.read.parquet(path)
        segments = token_files.read_segments(back).collect()
        texts = [(r[0], r[1]) for r in messy()]
        check_pieces(segments, texts, width, padded=True)
        for shard in back.collect():
            matrix = np.frombuffer(shard.ids, "<u2").reshape(shard.n_sequences, width)
            for row, ends, resets in zip(matrix, shard.cu_seqlens, shard.position_resets):
                assert ends[0] == 0 and resets == ends[:-1] and not row[ends[-1] :].any()
    assert token_files.read_segments(token_files.shards(empty, word_tokenizer())).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    r = random.Random(8)
    for capacity in (1, 7, 64):
        lengths = [r.randint(1, capacity) for _ in range(400)]
        free, want = [], []
        for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f >= lengths[i]]
            if fits:
                j = len(free) - 1 - free[::-1].index(min(fits))
                want.append(min(fits) - lengths[i])
                free[j] -= lengths[i]
            else:
                free.append(capacity - lengths[i])
        got = token_files.best_fit_decreasing(lengths, capacity)
        assert sorted(i for s in got for i in s) == list(range(400))
        assert sorted(capacity - sum(lengths[i] for i in s) for s in got) == sorted(free)


# --- licences


def test_licences_on_held_out_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licences.train(licences.sample_paragraphs(docs, "text", 2000))
    assert model.accuracy > 0.95 and 0.5 <= model.least < 1
    texts = ["Hello world.\nReleased under the MIT License.\n", "x", None, "", "licensed UNDER the apache license version 2.0", "Licensed under CC BY-NC 4.0.", "Licensed under the terms of nobody, version 4.", "The license plate of the car was under the seat."]
    found = {(r, n): f for r, n, f, _, _ in licences.judge(model, pa.array([t or "" for t in texts]))}
    assert found[(0, 1)] == "mit" and found[(4, 0)] == "apache" and found[(5, 0)] == "cc-by-nc"
    assert found.get((6, 0), "unknown") == "unknown" and not any(r in (1, 2, 3) for r, _ in found)
    got = Counter(r.family for r in licences.scan(docs).collect())
    lines = [x for r in docs.collect() for x in (r.text or "").split("\n")]
    plain = {"proprietary": "All rights reserved", "mit": "MIT License", "apache": "Apache License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC"}
    for family, words in plain.items():
        assert got[family] == sum(words in x for x in lines), (family, got)
    assert sum(got.values()) <= sum(got[f] for f in plain) + 3


def test_licences_of_messy_and_empty_tables(docs, empty):
    assert licences.scan(docs).count() <= 5
    assert licences.scan(empty).count() == 0


def test_licences_inside_long_lines_and_across_lines():
    r = random.Random(9)
    others = [" ".join(r.choice(("amber", "river", "stone", "under", "this", "the", "all", "of", "work", "walked")) + r.choice(("", "s")) for _ in range(r.randint(5, 120))) for _ in range(400)]
    model = licences.train(others)
    pool = " ".join(others).split()
    notices = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    texts, want = [], []
    for n in (30, 70, 300):
        for k in (n, n // 2, 0):
            for family, notice in notices:
                begin = r.randrange(len(pool) - n)
                words = pool[begin : begin + n]
                want.append((len(texts), 0, family))
                texts.append(" ".join([*words[:k], notice, *words[k:]]))
    for family, notice in notices:
        words = notice.split()
        cut = len(words) // 2
        want.append((len(texts), 1, family))
        texts.append("amber river\n" + " ".join(words[:cut]) + "\n" + " ".join(words[cut:]) + "\n\nstone walked")
    clean = [" ".join(pool[i : i + 300]) for i in range(0, 6000, 300)]
    found = [(row, line, family) for row, line, family, _, _ in licences.judge(model, pa.array(texts + clean))]
    missed = set(want) - set(found)
    assert len(missed) <= 0.02 * len(want), missed
    assert not [f for f in found if f[0] >= len(texts)]
