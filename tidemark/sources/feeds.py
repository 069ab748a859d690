"""Syndication feed bodies as one item table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import blank, let, squish, stage
from tidemark.functions.html import clean_title, html_to_text, strip_journal_prefix
from tidemark.functions.ids import item_id
from tidemark.functions.pubdates import parse_feed_date, parse_press_date
from tidemark.functions.text import paywall_prefix, strip_paywall_prefix, truncate_words
from tidemark.functions.urls import canonical_url, extract_doi, extract_trial_ids
from tidemark.sources.schemas import FEED

PRESS_ZONE = "America/New_York"


def _text(c: Column) -> Column:
    return squish(F.coalesce(c, F.lit("")))


def _entry(kind: str, e: Column) -> Column:
    """An item or entry of any layout in the same fields; markup inside a text field comes as text, tags and all."""
    none = F.lit(None).cast("string")
    if kind == "atom":
        links = F.filter(e["link"], lambda x: ~blank(x["_href"]))
        page = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        fields = {
            "link": F.coalesce(F.get(page, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]),
            "guid": e["id"],
            "press_date": e["published"],
            "dates": F.array(e["published"], e["updated"]),
            "content": none,
            "description": F.when(blank(e["content"]), e["summary"]).otherwise(e["content"]),
            "authors": F.concat(F.coalesce(F.transform(e["author"], lambda x: x["name"]), F.array().cast("array<string>")), F.array(e["dc:creator"])),
            "category": F.transform(e["category"], lambda x: x["_term"]),
        }
    else:
        fields = {
            "link": e["link"],
            "guid": e["guid"],
            "press_date": e["pubDate"],
            "dates": F.array(e["pubDate"], e["dc:date"], e["prism:publicationDate"]),
            "content": e["content:encoded"],
            "description": e["description"],
            "authors": F.array(e["dc:creator"]),
            "category": e["category"],
        }
    fields |= {"title": e["title"], "doi": e["prism:doi"]}
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def _entries(feed: Column) -> Column:
    """All entries of a feed, whatever its root; an empty list for a feed without any, null for another document."""
    of = lambda kind, xs: F.coalesce(F.transform(xs, lambda e: _entry(kind, e)), F.array())
    found = F.concat(of("rss", feed["channel"]["item"]), of("rss", feed["item"]), of("atom", feed["entry"]))
    known = feed["channel"].isNotNull() | feed["item"].isNotNull() | feed["entry"].isNotNull()
    return F.when(known | F.col("body").rlike(r"^(?s:\s*(<[?!][^>]*>\s*)*)<(rss|feed|rdf:RDF)\b"), found)


def _pick_body(e: Column, journal: Column) -> Column:
    """``struct(text, provenance)``: the full content if it says anything, else the description."""
    plain = lambda c: let(html_to_text(_text(c)), lambda t: F.when(journal, strip_journal_prefix(t)).otherwise(t))
    choose = lambda full, short: (
        F.when(F.length(full) > 40, F.struct(full.alias("text"), F.lit("content:encoded").alias("provenance")))
        .when(
            F.length(short) > 0,
            F.struct(
                short.alias("text"), F.when(F.length(short) >= 400, "description").otherwise("dek").alias("provenance")
            ),
        )
        .otherwise(F.struct(F.lit("").alias("text"), F.lit("none").alias("provenance")))
    )
    return let(plain(e["content"]), lambda full: let(plain(e["description"]), lambda short: choose(full, short)))


def _pick_date(e: Column, style: Column, zone: Column, now: Column) -> Column:
    """The first usable date field, read in the source's zone and style."""
    press = lambda c: F.struct(
        parse_press_date(c, F.lit(PRESS_ZONE)).alias("at"),
        F.lit("minute").alias("precision"),
        F.lit(True).alias("confident"),
        F.lit(None).cast("string").alias("warning"),
    )
    fields = F.filter(e["dates"], lambda c: ~blank(c))
    tried = F.transform(fields, lambda c: parse_feed_date(c, now, zone))
    styled = F.when(style == "fierce", F.filter(F.array(press(e["press_date"])), lambda d: d["at"].isNotNull()))
    all_dates = F.concat(
        F.coalesce(styled, F.filter(F.array(press(e["press_date"])), lambda d: F.lit(False))),
        F.filter(tried, lambda d: d["at"].isNotNull()),
        F.slice(tried, 1, 1),
    )
    return F.get(all_dates, F.lit(0))


def parse_feeds(bodies: DataFrame, now: Column, body_cap: int | None = None) -> DataFrame:
    """One row per entry of RSS, RDF and Atom feeds with its fields settled; ``outcome`` says why one is not an item.

    ``bodies``: source_id, source_kind, paywalled, date_style, time_zone,
    max_items, body. A feed is one response, parsed inside its row; entries from ``max_items`` on, if it is not
    null, are ``over-cap``; a body that is no feed gives a single ``unparseable`` row, never a failed job.
    An Atom entry's address is its alternate link, else its first; its body is its content, else its summary.
    """
    df = stage(bodies, {"_feed": F.from_xml("body", FEED)})
    df = stage(df, {"_entries": _entries(F.col("_feed"))}).drop("_feed")
    entries = F.col("_entries")
    df = df.select(
        "source_id",
        "source_kind",
        F.coalesce("paywalled", F.lit(False)).alias("source_paywalled"),
        F.coalesce("date_style", F.lit("")).alias("date_style"),
        F.coalesce("time_zone", F.lit("UTC")).alias("time_zone"),
        F.coalesce(F.size(entries), F.lit(-1)).alias("entries_parsed"),
        "max_items",
        F.posexplode_outer(entries).alias("pos", "e"),
    )
    journal = F.col("source_kind").isin("journal", "preprint")
    df = stage(
        df,
        {
            "full_title": squish(clean_title(_text(F.col("e.title")))),
            "url": _text(F.col("e.link")),
            "picked": _pick_body(F.col("e"), journal),
            "date": _pick_date(F.col("e"), F.col("date_style"), F.col("time_zone"), now),
        },
    )
    outcome = (
        F.when(F.col("entries_parsed") < 0, "unparseable")
        .when(F.col("pos").isNull(), "empty")
        .when((F.col("full_title") == "") | (F.col("url") == ""), "incomplete")
        .when(F.col("pos") >= F.col("max_items"), "over-cap")
        .otherwise("kept")
    )
    df = stage(
        df,
        {
            "title": strip_paywall_prefix(F.col("full_title")),
            "canonical_url": canonical_url(F.col("url")),
            "outcome": outcome,
        },
    )
    text = F.col("picked.text")
    doi = _text(F.col("e.doi"))
    named = F.transform(F.col("e.authors"), lambda c: squish(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))
    return df.select(
        "source_id",
        "pos",
        "title",
        "url",
        "canonical_url",
        item_id(F.col("canonical_url")).alias("item_id"),
        F.when(_text(F.col("e.guid")) != "", _text(F.col("e.guid"))).alias("guid"),
        F.col("date.at").alias("published_at"),
        F.coalesce("date.precision", F.lit("unknown")).alias("date_precision"),
        F.coalesce("date.confident", F.lit(False)).alias("date_confident"),
        (text if body_cap is None else truncate_words(text, body_cap)).alias("body"),
        F.col("picked.provenance").alias("body_provenance"),
        (F.col("source_paywalled") | paywall_prefix(F.col("full_title"))).alias("paywalled"),
        F.filter(F.transform(F.col("e.category"), _text), lambda c: c != "").alias("categories"),
        F.coalesce(F.filter(named, lambda c: c != ""), F.array().cast("array<string>")).alias("authors"),
        F.when(doi != "", doi).otherwise(extract_doi(F.concat_ws(" ", "url", text))).alias("doi"),
        extract_trial_ids(F.concat_ws(" ", "title", text)).alias("trial_ids"),
        "outcome",
        F.col("date.warning").alias("warning"),
    )
