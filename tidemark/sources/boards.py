"""Job-board bodies in three layouts, as one item table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import blank, squish, stage
from tidemark.functions.html import html_to_text
from tidemark.functions.ids import item_id
from tidemark.functions.text import decode_entities
from tidemark.functions.urls import canonical_url
from tidemark.sources.schemas import ASHBY, GREENHOUSE, LEVER



def _text(c: Column) -> Column:
    return squish(F.coalesce(c, F.lit("")))


def _instant(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _posting(title, url, body, published, location, company, listed, warning) -> Column:
    return F.struct(
        _text(title).alias("title"),
        _text(url).alias("url"),
        F.coalesce(body, F.lit("")).alias("body"),
        published.alias("published_at"),
        F.when(_text(location) != "", _text(location)).alias("location"),
        company.alias("company"),
        listed.alias("listed"),
        warning.alias("warning"),
    )


def _greenhouse(body: Column, company: Column) -> Column:
    jobs = F.from_json(body, GREENHOUSE)["jobs"]
    no_content = F.lit("no content — is content=true on the endpoint?")
    return F.transform(
        jobs,
        lambda j: _posting(
            j["title"], j["absolute_url"],
            html_to_text(decode_entities(F.coalesce(j["content"], F.lit("")), passes=1)),
            _instant(j["updated_at"]), j["location"]["name"], company, F.lit(True),
            F.when(blank(j["content"]), no_content),
        ),
    )


def _lever(body: Column, company: Column) -> Column:
    posts = F.from_json(body, LEVER)
    text = lambda p: F.concat_ws(
        "\n\n",
        F.when(p["descriptionPlain"] != "", p["descriptionPlain"]),
        F.when(p["additionalPlain"] != "", p["additionalPlain"]),
    )
    created = lambda p: F.timestamp_millis(p["createdAt"].cast("long"))
    team = lambda p: _text(p["categories"]["team"])
    return F.transform(
        posts,
        lambda p: _posting(
            p["text"], F.coalesce(p["hostedUrl"], p["applyUrl"]), text(p),
            F.when(F.year(created(p)) > 2000, created(p)), p["categories"]["location"],
            F.when(team(p) != "", team(p)).otherwise(company), F.lit(True), F.lit(None).cast("string"),
        ),
    )


def _ashby(body: Column, company: Column) -> Column:
    jobs = F.from_json(body, ASHBY)["jobs"]
    return F.transform(
        jobs,
        lambda j: _posting(
            j["title"], j["jobUrl"], _text(j["descriptionPlain"]), _instant(j["publishedAt"]), j["location"],
            company, F.coalesce(j["isListed"], F.lit(True)), F.lit(None).cast("string"),
        ),
    )


def parse_boards(bodies: DataFrame, body_cap: int | None = None) -> DataFrame:
    """One row per posting, or one with a warning for a body that is not its layout.

    ``bodies``: source_id, vendor, company, max_items, body. A body is one
    vendor response, parsed inside its own row; the item cap is the position in
    that response, so capping needs no ranking, and a null is no cap. ``outcome`` is
    kept, unlisted, incomplete, over-cap or unparseable.
    """
    vendor = F.col("vendor")
    body, company = F.col("body"), F.col("company")
    parsed = (
        F.when(vendor == "greenhouse", _greenhouse(body, company))
        .when(vendor == "lever", _lever(body, company))
        .when(vendor == "ashby", _ashby(body, company))
    )
    df = bodies.withColumn("_all", parsed)
    df = df.withColumns(
        {
            "entries_parsed": F.greatest(F.lit(0), F.coalesce(F.size("_all"), F.lit(0))),
        }
    )
    df = df.select(
        "source_id", "vendor", "max_items", "entries_parsed", F.col("_all").isNull().alias("bad"), F.posexplode_outer("_all").alias("pos", "p")
    )
    df = df.select("source_id", "vendor", "max_items", "entries_parsed", "bad", "pos", "p.*")
    outcome = (
        F.when(F.col("bad"), "unparseable")
        .when(F.col("pos").isNull(), "empty")
        .when(~F.col("listed"), "unlisted")
        .when((F.col("title") == "") | (F.col("url") == ""), "incomplete")
        .when(F.col("pos") >= F.col("max_items"), "over-cap")
        .otherwise("kept")
    )
    body = F.col("body") if body_cap is None else F.left("body", F.lit(body_cap))
    df = stage(df, {"outcome": outcome, "canonical_url": canonical_url(F.col("url")), "body": body})
    return df.select(
        "source_id", "vendor", "pos", "title", "url", "canonical_url", item_id(F.col("canonical_url")).alias("item_id"),
        "body", F.when(F.col("body") != "", "api").otherwise("none").alias("body_provenance"), "published_at",
        F.when(F.col("published_at").isNotNull(), "second").otherwise("unknown").alias("date_precision"),
        "location", "company", "outcome", F.when(F.col("bad"), "unexpected layout").otherwise(F.col("warning")).alias("warning"),
    )
