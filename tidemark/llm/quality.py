"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs the votes.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
estimates, without labels, the share of good documents and how often each rule
is right about good and about bad ones; a document's posterior probability of
being good then decides. Votes are counted by pattern on the cluster: with R
rules there are at most 3^R patterns, whatever the size of the table, and the
estimation runs over those counts alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import stage
from tidemark.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A rule: feature, good from, good to, bad below, bad above; between them it abstains.
RULES = (
    ("n_words", 80, math.inf, 50, math.inf),
    ("chars_per_word", 3.0, 9.0, 2.0, 12.0),
    ("symbols_per_word", 0.0, 0.02, 0.0, 0.1),
    ("symbol_share", 0.0, 0.004, 0.0, 0.02),
    ("symbol_end_share", 0.0, 0.02, 0.0, 0.1),
    ("symbol_line_share", 0.0, 0.1, 0.0, 0.3),
    ("dup_line_share", 0.0, 0.1, 0.0, 0.3),
    ("repeat_word_share", 0.0, 0.1, 0.0, 0.3),
    ("upper_share", 0.0, 0.15, 0.0, 0.4),
    ("exclaims_per_word", 0.0, 0.05, 0.0, 0.3),
    ("stops_per_word", 0.01, 0.5, 0.002, 0.9),
)


@dataclass(frozen=True)
class LabelModel:
    """Share of good rows; for each rule, how often a vote is right about good and about bad rows."""

    good: float
    right_if_good: tuple[float, ...]
    right_if_bad: tuple[float, ...]


def features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns as k0, k1, ..., the base counts of the text and the features of the rules. A null text has no words."""
    value = F.coalesce(F.col("_t"), F.lit(""))
    df = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_t"))
    df = stage(
        df,
        {
            "_w": F.array_remove(F.split(value, SPACES), ""),
            "_l": F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_chars": F.length(F.translate(value, " \t\n\x0b\x0c\r", "")),
            "_symbols": F.length(value) - F.length(F.translate(value, SYMBOLS, "")),
            "_upper": F.regexp_count(value, F.lit(r"\p{Lu}")),
            "_ends": F.regexp_count(value, F.lit(r"[#*$%&|<>](?:[\x20\x09-\x0D]|$)")),
            "_exclaims": F.length(value) - F.length(F.translate(value, "!", "")),
            "_stops": F.length(value) - F.length(F.translate(value, ".?!", "")),
        },
    ).drop("_t")
    n = F.size("_w")
    gram = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), gram)).otherwise(F.array().cast("array<bigint>"))
    df = stage(
        df,
        {
            "n_words": n.cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "_marked": F.size(F.filter("_l", lambda x: x.rlike("[#*$%&|<>]"))),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_g": grams,
        },
    ).drop("_w", "_l")
    # only where a window repeats: windows in order of their hashes, each with its place
    placed = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = stage(df, {"_s": F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed)}).drop("_g")
    same = lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])
    again = F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.get("_s", k + 1)["h"] == x["h"])))
    df = stage(df, {"_p": F.sort_array(F.transform(again, lambda x: x["i"]))}).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + (p + 3 - F.greatest(a["end"], p)).cast("long")).alias("n")),
        lambda a: a["n"],
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    df = stage(df, {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}).drop("_p")
    return df.select(
        *[f"k{i}" for i in range(len(keep))],
        "n_words",
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        per_word("_chars").alias("chars_per_word"),
        per_word("_symbols").alias("symbols_per_word"),
        (F.col("_symbols") / F.greatest(F.col("_chars"), F.lit(1))).alias("symbol_share"),
        per_word("_ends").alias("symbol_end_share"),
        (F.col("_marked") / F.greatest(F.col("n_lines"), F.lit(1))).alias("symbol_line_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        per_word("n_repeat_words").alias("repeat_word_share"),
        (F.col("_upper") / F.greatest(F.col("_chars"), F.lit(1))).alias("upper_share"),
        per_word("_exclaims").alias("exclaims_per_word"),
        per_word("_stops").alias("stops_per_word"),
    )


def vote(rule: tuple) -> Column:
    name, good_from, good_to, bad_below, bad_above = rule
    c = F.col(name)
    good, bad = c >= F.lit(float(good_from)), c < F.lit(float(bad_below))
    if good_to != math.inf:
        good = good & (c <= F.lit(float(good_to)))
    if bad_above != math.inf:
        bad = bad | (c > F.lit(float(bad_above)))
    return F.when(good, 1).when(bad, -1).otherwise(0)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 25) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from rules that are mostly right; the start also counts as a few
    pseudo-votes, so a rule that hardly votes stays near it, and a rule is never
    worse than chance. What is bad comes in kinds, so each kind needs two rules or more:
    a vote that no other one ever agrees with is taken for a mistake. No rows: the start itself.
    """
    n_rules = len(RULES)
    model = LabelModel(0.8, (0.95,) * n_rules, (0.5,) * n_rules)
    for _ in range(rounds if patterns else 0):
        good = total = 0.0
        right_good, votes_good = [9.5] * n_rules, [10.0] * n_rules
        right_bad, votes_bad = [5.0] * n_rules, [10.0] * n_rules
        for votes, count in patterns:
            p = posterior(model, votes)
            good, total = good + count * p, total + count
            for j, v in enumerate(votes):
                if v:
                    votes_good[j] += count * p
                    votes_bad[j] += count * (1 - p)
                    if v > 0:
                        right_good[j] += count * p
                    else:
                        right_bad[j] += count * (1 - p)
        a = [r / n for r, n in zip(right_good, votes_good, strict=True)]
        b = [r / n for r, n in zip(right_bad, votes_bad, strict=True)]
        b = [max(y, 1 - x) for x, y in zip(a, b, strict=True)]
        model = LabelModel((8 + good) / (10 + total), tuple(a), tuple(b))
    return model


def _weights(model: LabelModel) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good before any vote, and what a good and a bad vote of each rule add."""
    log = math.log
    each = [(log(a) - log(1 - b + 1e-12), log(1 - a + 1e-12) - log(b)) for a, b in zip(model.right_if_good, model.right_if_bad, strict=True)]
    return log(model.good) - log(1 - model.good), each


def posterior(model: LabelModel, votes: tuple[int, ...]) -> float:
    base, each = _weights(model)
    odds = base + sum(g if v > 0 else b for v, (g, b) in zip(votes, each, strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def quality(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row, its base counts, votes, posterior and verdict.

    Null and empty texts have no words and fail the base rules. Every row is
    judged alone: repeated rows get the same verdict. An empty table stays empty.
    """
    keep = df.columns if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    voted = features(df, text, keep).withColumns({f"vote_{rule[0]}": vote(rule).cast("byte") for rule in RULES})
    voted = materialize(voted, "quality-votes")
    votes = [f"vote_{rule[0]}" for rule in RULES]
    patterns = sorted((tuple(r[:-1]), r["count"]) for r in voted.groupBy(*votes).count().collect())
    base, each = _weights(fit(patterns))
    odds = F.lit(base)
    for name, (good, bad) in zip(votes, each, strict=True):
        odds = odds + F.when(F.col(name) > 0, F.lit(good)).when(F.col(name) < 0, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return voted.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        *facts,
        failed.alias("base_failed"),
        (~failed & (odds >= 0)).alias("kept"),
        (1 / (1 + F.exp(-odds))).alias("posterior"),
        *votes,
    )
