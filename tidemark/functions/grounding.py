"""Does a generated text say only what its input says?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CANDIDATE_MAX_CHARS, CAPITALISED_STOPWORDS, NUMBER_WORDS
from tidemark.functions.common import case_of, let

URL = r"(?i)(https?://|www\.|\b[a-z0-9-]{2,}\.(?:com|org|net|edu|gov|io|ai|co)\b)"
#: ``\b`` over ASCII words: Java's own counts é as part of a word on some versions, and a name before it is lost.
_WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
TIME_UNITS = ("day", "days", "week", "weeks", "month", "months", "hour", "hours", "year", "years")


def numbers_in(text: Column) -> Column:
    """Numbers without their leading zeros, so 07 and 7 agree at any length."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.transform(found, lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))


def strange_numbers(candidate: Column, source: Column) -> Column:
    return F.array_except(numbers_in(candidate), numbers_in(source))


def strange_number_words(candidate: Column, source: Column) -> Column:
    """``two weeks`` style phrases whose number the source does not give."""
    return let(
        F.split(candidate, "[^A-Za-z0-9]+"),
        lambda words: let(numbers_in(source), lambda allowed: _unit_phrases(words, allowed)),
    )


def _unit_phrases(words: Column, allowed: Column) -> Column:
    pairs = F.arrays_zip(words.alias("w"), F.slice(words, F.lit(2), F.size(words)).alias("u"))
    spelled = lambda p: case_of(F.lower(p["w"]), NUMBER_WORDS, F.lit(None).cast("int"))
    odd = F.filter(
        pairs,
        lambda p: F.coalesce(F.lower(p["u"]).isin(*TIME_UNITS), F.lit(False))
        & spelled(p).isNotNull()
        & ~F.array_contains(allowed, spelled(p).cast("string")),
    )
    return F.transform(odd, lambda p: F.concat(p["w"], F.lit(" "), p["u"]))


def strange_names(candidate: Column, source: Column) -> Column:
    """Capitalised words that the source does not contain."""
    return let(F.lower(source), lambda haystack: _names_outside(candidate, haystack))


def _names_outside(candidate: Column, haystack: Column) -> Column:
    found = F.regexp_extract_all(candidate, F.lit(EDGE + "([A-Z][A-Za-z0-9'’&.-]+)" + EDGE), F.lit(1))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"[.'’&-]+$", ""))
    return F.filter(
        bare,
        lambda t: (F.length(t) >= 2)
        & ~F.lower(t).isin(*CAPITALISED_STOPWORDS)
        & ~F.contains(haystack, F.lower(t)),
    )


def verdict(candidate: Column, source: Column, max_chars: int = CANDIDATE_MAX_CHARS) -> Column:
    """Null when grounded, else the first reason it is not."""
    return let(F.btrim(candidate, F.lit(" \n\r\t")), lambda text: _verdict(text, source, max_chars))


def _verdict(text: Column, source: Column, max_chars: int) -> Column:
    first = lambda found, before, after: F.when(
        F.size(found) > 0, F.concat(F.lit(before), F.get(found, F.lit(0)), F.lit(after))
    )
    outside = "which is not in the input"
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(
            F.length(text) > max_chars,
            F.concat(F.lit(f"over {max_chars} characters ("), F.length(text).cast("string"), F.lit(")")),
        )
        .when(text.rlike(URL), F.concat(F.lit("contains a URL ("), F.regexp_extract(text, URL, 1), F.lit(")")))
        .otherwise(
            F.coalesce(
                let(strange_numbers(text, source), lambda v: first(v, "contains the number ", f", {outside}")),
                let(strange_number_words(text, source), lambda v: first(v, 'says "', f'", {outside}')),
                let(strange_names(text, source), lambda v: first(v, 'names "', f'", {outside}')),
            )
        )
    )
