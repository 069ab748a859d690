"""Rules pinned by small rows and by sweeps."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.config import LEXICON, WEIGHTS, Lexicon, Term
from tidemark.functions import dates as D
from tidemark.functions import html as H
from tidemark.functions import pubdates as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions.common import instant
from tidemark.functions.lexicon import lane_scores, whole_word_hits, with_term_hits
from tidemark.functions.urls import canonical_url
from tidemark.operators import boilerplate as B
from tidemark.operators import ledgers as L
from tidemark.operators import monitoring as M
from tidemark.operators.news import classify
from tidemark.operators.skew import lookup_join
from tidemark.plans import daily
from tidemark.plans import fixtures as X


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).collect()[0])


def test_urgency_is_monotone_and_half_at_lead(spark):
    days = spark.range(0, 402).select(
        F.col("id").alias("d"), S.urgency_curve(F.col("id"), F.lit(400.0), F.lit(35.0)).alias("u")
    )
    got = {r.d: r.u for r in days.collect()}
    assert got[0] == 1.0 and got[401] == 0.0 and abs(got[35] - 0.5) < 1e-12
    assert all(got[d] >= got[d + 1] for d in range(401))


def test_projected_never_outranks_confirmed(spark):
    days = spark.range(1, 401).select(F.col("id").cast("int").alias("d"))
    u = lambda kind: S.urgency(F.lit(kind) if kind else F.lit(None), F.lit("day"), F.col("d"), F.lit("fellowships"), F.lit("x"))["raw"]
    assert days.filter(u("projected") >= u("confirmed")).count() == 0


def test_replay_of_400_days_fires_seventeen_cards(spark):
    assert values(spark, L.replay_rungs(F.lit(400)))[0] == 17


@pytest.mark.parametrize(
    "days,last,want",
    [(-1, None, None), (364, None, 365), (364, 365, None), (50, 90, 60), (5, 6, 5), (5, 5, None), (0, 1, 0), (400, None, None)],
)
def test_rung(spark, days, last, want):
    assert values(spark, S.rung_for(F.lit(days), F.lit(last).cast("int")))[0] == want


def test_impossible_and_far_dates_are_unknown(spark):
    now = instant("2026-08-22T15:00:00")
    parse = lambda v, **k: D.parse_deadline(F.lit(v), F.lit("Europe/London"), now, **k)
    got = values(
        spark,
        parse("2026-02-31")["precision"],
        parse("2036-01-01")["precision"],
        parse("2026-10")["precision"],
        parse("2026-10-01")["instant"],
        parse("2026-10-01", time_of_day=F.lit("25:00"))["instant"],
        parse("soon")["warning"],
    )
    assert got[:3] == ("unknown", "unknown", "month")
    assert got[3] == dt.datetime(2026, 10, 1, 22, 59) and got[4] is None and got[5] == "not a date layout: soon"


def test_clock_change(spark):
    wall = lambda d, h, m: D.wall_clock_to_utc(F.lit(dt.date(*d)), h, m, F.lit("America/New_York"))
    assert values(spark, wall((2026, 3, 8), 2, 30), wall((2026, 11, 1), 1, 30)) == (
        dt.datetime(2026, 3, 8, 7, 30),
        dt.datetime(2026, 11, 1, 5, 30),
    )


def test_days_follow_the_programme_zone(spark):
    now = instant("2026-09-30T23:30:00")
    at = D.wall_clock_to_utc(F.lit(dt.date(2026, 10, 1)), 23, 59, F.lit("Asia/Tokyo"))
    assert values(spark, D.days_until(at, F.lit("Asia/Tokyo"), now), D.days_until(at, F.lit("America/New_York"), now)) == (0, 1)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("http://User:pw@WWW.FDA.gov:80/a/b/?utm_source=x&b=2&a=1&c#frag", "https://www.fda.gov/a/b?a=1&b=2&c="),
        ("https://www.endpts.com/x//", "https://endpoints.news/x"),
        ("https://x.org", "https://x.org/"),
        ("https://x.org:8443/p?z=1", "https://x.org:8443/p?z=1"),
        ("no address", "noaddress"),
        ("", ""),
    ],
)
def test_canonical_url(spark, raw, want):
    assert values(spark, canonical_url(F.lit(raw)))[0] == want


def test_entities_and_markup(spark):
    got = values(
        spark,
        T.decode_entities(F.lit("a &amp;lt;b&gt; &#233;&#x1F600; &bogus; & &#0; &#xD800;")),
        H.html_to_text(F.lit("<div>one</div><p>two<br>three</p><script>x<y</script>")),
        H.clean_title(F.lit("p<0.05 and n>10")),
        H.clean_title(F.lit("CD34&lt;sup&gt;+&lt;/sup&gt; cells")),
        H.html_to_text(F.lit("a  b")),
    )
    assert got == ("a <b> é😀 &bogus; & &#0; ", "one two three", "p<0.05 and n>10", "CD34+ cells", "a b")


def test_future_publication_is_clamped_and_undated_is_old(spark):
    now = instant("2024-01-01T00:00:00")
    d = P.parse_feed_date(F.lit("2025-06-01T00:00:00Z"), now)
    assert values(spark, d["at"], d["confident"], P.age_hours(F.lit(None).cast("timestamp"), now)) == (
        dt.datetime(2024, 1, 2, 12), False, 720.0,
    )


def brute_hits(text, terms):
    return sorted(t for t in terms for _ in re.findall(rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])", text))


def test_whole_words_against_brute_force(spark):
    terms = [t.term for lane in LEXICON.lanes.values() for t in lane]
    texts = [
        "Fine mapping, fine-mapping and single cell/single-cell; aging aging. epigenomics epigenom",
        "md/phd (MD-PhD) 10x genomics series a series-a seed round",
        "chromatin accessibility of chromatin; 3d genome partial reprogramming",
        "", "  ", "perturb-seqs", "causal  inference causal inference",
        " ".join(terms), "/".join(reversed(terms)),
    ]
    df = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: sorted(r.h) for r in df.select("i", whole_word_hits(F.col("t"), terms).alias("h")).collect()}
    assert got == {i: brute_hits(t.lower(), terms) for i, t in enumerate(texts)}


def test_lane_scores_against_brute_force(spark):
    import math

    rows = [(1, "Mendelian randomization", "GWAS of aging and aging; MR in mRNA"), (2, "Series A", "seed round CUT&RUN"), (3, "x", "")]
    df = spark.createDataFrame(rows, "i int, title string, scorable string")
    got = {r.i: {s.lane: s.raw for s in r.lane_scores} for r in lane_scores(with_term_hits(df)).collect()}

    def total(title, body, terms, fold):
        s = 0.0
        for t in terms:
            f = (lambda x: x.lower()) if fold else (lambda x: x)
            a, b = (len(brute_hits(f(x), [f(t.term)])) for x in (title, body))
            if a + b:
                s += t.weight * (1 + math.log(a + b)) * (2 if a else 1)
        return s

    for i, title, body in rows:
        for lane in LEXICON.lanes:
            t = 0.0
            if LEXICON.lane_terms(lane):
                t = total(title, body, LEXICON.lane_terms(lane), True) + total(title, body, LEXICON.acronyms, False)
            assert got[i][lane] == pytest.approx(t / (t + 8))


def test_ties_stay_in_the_default_lane(spark):
    lex = Lexicon(lanes={"fellowships": (Term("word", 1.0),), "causal-genetics": (Term("word", 1.0),)})
    df = spark.createDataFrame([("a", "word", "news")], "title string, scorable string, source_kind string")
    df = df.withColumn("lane_hints", F.create_map().cast("map<string,double>"))
    assert classify(lane_scores(with_term_hits(df, lexicon=lex), lex), lex).first().primary_lane == "causal-genetics"


BLURB = "We are a company that makes very good things for people. Our methods are known all over the whole world."


def postings(spark):
    jobs = [f"{BLURB} This post is for a person who can do task number {i} with care." for i in range(4)]
    rows = [(f"p{i}", "acme", b) for i, b in enumerate(jobs)] + [("q0", "other", jobs[0])]
    return spark.createDataFrame(rows, "item_id string, source_id string, body string")


def test_boilerplate_is_per_source_and_order_is_kept(spark):
    out = {r.item_id: r.stripped for r in B.strip_boilerplate(B.with_sentences(postings(spark))).collect()}
    assert all(out[f"p{i}"] == f"This post is for a person who can do task number {i} with care." for i in range(4))
    assert "very good things" in out["q0"]


def test_two_items_are_no_evidence(spark):
    few = postings(spark).filter("item_id IN ('p0', 'p1')")
    assert B.find_boilerplate(B.with_sentences(few)).count() == 0


@pytest.mark.parametrize("max_hot", [0, 1, 1000])
def test_lookup_join_is_exact_whatever_is_hot(spark, max_hot):
    left = spark.range(0, 3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    left = left.unionByName(spark.createDataFrame([(-1, None)], "id long, k long"))
    right = left.filter("k IS NOT NULL AND k <> 7").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = lookup_join(left, right, ["k"], "n", F.col("id"), max_hot=max(max_hot, 1))
    want = left.join(right.drop("n"), "k", "left")
    assert sorted(map(tuple, got.select("id", "top").collect())) == sorted(map(tuple, want.select("id", "top").collect()))


def test_upsert_keeps_untouched_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    assert sorted((r.k, r.v) for r in L.upsert(old, new, ["k"]).collect()) == [("a", 1), ("b", None), ("c", 3)]


def test_weights_are_pinned():
    assert WEIGHTS.fingerprint() == "a0b34290798e"


def test_news_over_the_days_cap_is_counted(spark):
    from tidemark.plans import digest_queries, news_queries

    sf = "/root/testdata/sf0.001"
    keep_all = F.when(F.col("drop_reason") != "below-threshold", F.col("drop_reason"))
    items = digest_queries._collected(spark, sf).cache()
    obligations = digest_queries._obligations(spark, sf)
    best, counts = daily.news_half(items, lambda rows: news_queries.rank(rows).withColumn("drop_reason", keep_all))
    day = daily.assemble(spark, obligations, (best, counts), X.CLOCK)
    stats = day.parts["stats"].collect()[0]
    assert stats.dropped["over-cap"] > 0 and counts["kept"] == WEIGHTS.max_items_per_day
    assert stats.fetched == obligations[1]["rows"] + items.count() == stats.kept + sum(stats.dropped.values())
    assert day.parts["items"].filter("kind = 'news'").count() == WEIGHTS.max_items_per_day


def test_source_health_keeps_every_warning_in_order(spark):
    texts = ["z late", "b", "z late", None, "a", "y", "x", "w", "v"]
    parsed = spark.createDataFrame([("s", "dropped", t, i) for i, t in enumerate(texts)], "source_id string, outcome string, warning string, position int")
    sources = spark.createDataFrame([("s", "S", False), ("t", "T", False)], "source_id string, source_name string, optional boolean")
    history = spark.createDataFrame([], "source_id string, last_success date, streak int, recent_counts array<int>")
    out = {r.source_id: r for r in M.source_health(parsed, sources, history, F.lit("2026-01-01").cast("date")).collect()}
    assert out["s"].parse_warnings == ["z late", "b", "a", "y", "x", "w", "v"]
    assert out["s"].error == "z late" and out["s"].warnings == 8 and out["t"].parse_warnings == []
