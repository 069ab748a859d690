"""Text normalisation as Column expressions: entities, markup, titles, tokens, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import NAMED_ENTITIES, TOKEN_STOPWORDS
from tidemark.functions.common import let, literal_map, squish

ENTITY_HEAD = r"^(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});"


def code_point(code: Column) -> Column:
    """Character for a code point; outside Unicode and surrogates give nothing."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    raw = F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0"))
    return F.when(valid, F.decode(raw, "UTF-32")).otherwise(F.lit(""))


def _decode_piece(piece: Column) -> Column:
    """Resolve the entity that begins a text piece cut at an ampersand."""
    return let(F.regexp_extract(piece, ENTITY_HEAD, 1), lambda name: _decode_named(piece, name))


def _decode_named(piece: Column, name: Column) -> Column:
    rest = F.substring(piece, F.length(name) + 2, F.length(piece))
    hex_digits = F.regexp_extract(name, r"^#x([0-9a-fA-F]{1,8})$", 1)
    digits = F.regexp_extract(name, r"^#([0-9]{1,9})", 1)
    code = F.when(hex_digits != "", F.conv(hex_digits, 16, 10).try_cast("long")).when(
        digits != "", digits.try_cast("long")
    )
    named = F.try_element_at(literal_map(NAMED_ENTITIES), F.lower(name))
    value = F.when(name.startswith("#"), F.when(code > 0, code_point(code))).otherwise(named)
    return F.when((name != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), piece))


def _decode_once(text: Column) -> Column:
    # every piece but the first begins right after an ampersand
    return F.array_join(
        F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p))), ""
    )


def decode_entities(text: Column, passes: int = 2) -> Column:
    """Named and numeric entities; feeds double-escape, so two passes."""
    for _ in range(passes):
        text = _decode_once(text)
    return text


def truncate_words(text: Column, max_chars: int) -> Column:
    """Cut at the last space if that keeps over 60 %, and mark the cut."""
    return let(text, lambda t: _truncate_words(t, max_chars))


def _truncate_words(text: Column, max_chars: int) -> Column:
    head = F.substring(text, 1, max_chars)
    # position of the last space, counted as in a zero-based string
    tail = F.length(F.substring_index(head, " ", -1))
    last_space = max_chars - tail - 1
    base = F.when(
        (F.instr(head, " ") > 0) & (last_space > max_chars * 0.6), F.left(head, last_space)
    ).otherwise(head)
    cut = F.concat(F.regexp_replace(base, r"[\s,;:.\-–—]+$", ""), F.lit("…"))
    return F.when(F.length(text) <= max_chars, text).otherwise(cut)


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(
        text,
        "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
        "aaaaaaceeeeiiiinooooouuuuyy",
    )


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Lower-case content words of two letters or more."""
    plain = F.regexp_replace(fold_accents(F.lower(text)), "[^a-z0-9]+", " ")
    words = F.filter(F.split(plain, " "), lambda t: F.length(t) > 1)
    if keep_stopwords:
        return words
    return F.filter(words, lambda t: ~t.isin(*TOKEN_STOPWORDS))


def normalize_title(title: Column) -> Column:
    """A headline without its paywall prefix and outlet suffix."""
    text = F.regexp_replace(title, r"(?i)^\s*STAT\+:\s*", "")
    text = F.regexp_replace(text, r"\s+[-–|]\s+[^-–|]{2,40}$", "")
    return squish(F.regexp_replace(text, "&", " and "))


def title_key(title: Column, words: int = 8) -> Column:
    """The first eight plain words: equal for near-identical headlines."""
    # only so much of a long title is cleaned as holds these words: runs between spaces with a letter or digit
    head = F.regexp_extract(F.lower(title), rf"^(?:[^a-z0-9]*+[a-z0-9][^ ]*+){{0,{words}}}", 0)
    plain = F.regexp_replace(head, "[^a-z0-9 ]", "")
    parts = F.filter(F.split(plain, r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(parts, 1, words), " ")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the content tokens, overlapping, in one pass over the text."""
    flat = F.array_join(tokens(text), " ")
    return F.array_distinct(F.regexp_extract_all(flat, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def sentences(text: Column, min_chars: int = 40) -> Column:
    """Sentences long enough to mean something."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: F.length(s) >= min_chars)


def sentence_key(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def first_sentences(text: Column, n: int, min_chars: int = 40, fallback_chars: int = 240) -> Column:
    """The first sentences, verbatim; the start of the text when there are none."""
    # a match can only begin where a run between stops begins; saying so keeps long unstopped text linear
    found = F.regexp_extract_all(text, F.lit(r"(?<![^.!?])[^.!?]++[.!?]+(?=\s|$)"), F.lit(0))
    found = F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(" \n\r\t"))), lambda s: F.length(s) >= min_chars)
    body = F.btrim(text, F.lit(" \n\r\t"))
    return let(
        found,
        lambda kept: F.when(F.size(kept) > 0, F.slice(kept, 1, n))
        .when(F.length(body) > 0, F.array(F.left(body, F.lit(fallback_chars))))
        .otherwise(F.array().cast("array<string>")),
    )


def paywall_prefix(title: Column) -> Column:
    return title.rlike(r"(?i)^\s*STAT\+:")


def strip_paywall_prefix(title: Column) -> Column:
    return F.regexp_replace(title, r"(?i)^\s*STAT\+:\s*", "")


def subject_label(label: Column, max_chars: int = 24) -> Column:
    """A programme name short enough for a lock screen."""
    # cut at the first of each separator in turn, unless the label begins with it
    value = label
    for separator in (" — ", " – ", r" \(", ": ", " / ", " - "):
        value = F.regexp_replace(value, rf"(?s)^(.+?){separator}.*$", "$1")
    return let(F.trim(value), lambda v: _shorten(v, max_chars))


def _shorten(value: Column, max_chars: int) -> Column:
    tail = r"(?i)\s+(scholarships?|fellowships?|scholars|programmes?|programs?|awards?|application)$"
    stripped = F.trim(F.regexp_replace(value, tail, ""))
    return let(
        F.when(F.length(stripped) > 0, stripped).otherwise(value),
        lambda v: F.when(F.length(v) <= max_chars, v).otherwise(
            F.concat(F.rtrim(F.left(v, F.lit(max_chars - 1))), F.lit("…"))
        ),
    )


def slug(text: Column) -> Column:
    # most are plain already, and one search tells
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text.rlike(r"^[a-z0-9]+\z"), text).otherwise(made)
