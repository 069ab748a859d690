"""Reading a deadline out of one sentence, and checking a quote against its page.

A sentence is read word by word: a year is looked for, then the two words before
it, so a date is always day, month and year as they stand. Everything that speaks
against the sentence is collected as short codes; ``config.READER_WORDING`` has
the words for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEADLINE_CUE, MONTH_NAMES, READER_WORDING, REFUSE_CONTEXTS
from tidemark.functions.common import case_of, let, squish
from tidemark.functions.dates import parse_deadline

MAX_SENTENCE = 400
#: Typographic quotes and dashes, and what they are compared as.
_TYPOGRAPHIC, _PLAIN = "‘’‛“”‐‑‒–—―", "'''\"\"------"


def _words(text: Column) -> Column:
    """The words of a sentence without the punctuation around them."""
    return F.transform(F.split(text, " "), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))


def _year(word: Column) -> Column:
    return F.when(word.rlike(r"^20\d\d\b"), F.left(word, F.lit(4)))


def _day(word: Column) -> Column:
    digits = F.regexp_extract(word, r"^(\d\d?)(?:st|nd|rd|th)?$", 1)
    return F.when(digits != "", F.lpad(digits, 2, "0"))


def _month(word: Column) -> Column:
    return F.lpad(case_of(F.lower(word), MONTH_NAMES, F.lit(None).cast("int")).cast("string"), 2, "0")


def quoted_date(text: Column) -> Column:
    """The written-out date, as ``YYYY-MM-DD``; null without day, month and year.

    Of several, a date in figures counts before one with the day in front, and
    that before one with the month in front.
    """

    def dates(words: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            year, before, first = _year(word), F.get(words, i - 1), F.get(words, i - 2)
            dashed = lambda month, day: F.concat_ws("-", year, month, day)
            figures = F.when(word.rlike(r"^20\d\d-\d\d-\d\d$"), word)
            day_month = F.when(_day(first).isNotNull() & _month(before).isNotNull(), dashed(_month(before), _day(first)))
            month_day = F.when(_month(first).isNotNull() & _day(before).isNotNull(), dashed(_month(first), _day(before)))
            ranked = [F.struct(F.lit(k).alias("kind"), i.alias("at"), d.alias("date")) for k, d in enumerate((figures, day_month, month_day))]
            return F.when(year.isNotNull(), F.array_min(F.filter(F.array(*ranked), lambda r: r["date"].isNotNull())))

        return F.array_min(F.array_compact(F.transform(words, at)))["date"]

    return let(_words(text), dates)


def read_deadline(quote: Column, zone: Column, now: Column, cycle_year: Column | None = None) -> Column:
    """``struct(ok, date, reason, faults)``. Refuses rather than guesses; a year is never inferred.

    ``faults`` are the codes of everything that speaks against the sentence,
    ``reason`` is the first of them.
    """

    def judged(text: Column) -> Column:
        dated = let(quoted_date(text), lambda d: F.struct(d.alias("date"), parse_deadline(d, zone, now)["instant"].alias("at")))
        return let(dated, lambda found: _result(text, found["date"], found["at"], cycle_year))

    return let(squish(quote), judged)


def _result(text: Column, date: Column, at: Column, cycle_year: Column | None) -> Column:
    no_year = ~text.rlike(r"\b20\d{2}\b")
    against = [("empty", F.coalesce(text, F.lit("")) == ""), ("too-long", F.length(text) > MAX_SENTENCE)]
    against += [(code, text.rlike("(?i)" + pattern)) for pattern, code in REFUSE_CONTEXTS]
    against += [("no-cue", ~text.rlike("(?i)" + DEADLINE_CUE)), ("no-year", no_year), ("no-date", date.isNull()), ("no-such-day", at.isNull())]
    if cycle_year is not None:
        # a cycle may close in the year before the one it is named after
        early = cycle_year - F.left(date, F.lit(4)).try_cast("int")
        against.append(("other-cycle", ~early.isin(0, 1)))
    faults = F.array_compact(F.array(*[F.when(F.coalesce(is_so, F.lit(False)), code) for code, is_so in against]))
    return let(
        faults,
        lambda f: F.struct(
            (F.size(f) == 0).alias("ok"), F.when(F.size(f) == 0, date).alias("date"), F.get(f, F.lit(0)).alias("reason"), f.alias("faults")
        ),
    )


def in_words(code: Column) -> Column:
    """What a code of the reader says; other texts stay as they are."""
    return case_of(code, READER_WORDING, code)


def fold_quote(text: Column) -> Column:
    """Lower case, single spaces, plain quotes and dashes."""
    return F.translate(F.lower(squish(text)), _TYPOGRAPHIC, _PLAIN)


def quote_appears_in(quote: Column, page: Column, min_chars: int = 8) -> Column:
    return let(
        fold_quote(quote),
        lambda needle: (F.length(needle) >= min_chars) & F.contains(fold_quote(page), needle),
    )
