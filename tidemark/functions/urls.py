"""URL identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import HOST_ALIASES, HTTPS_ONLY_HOSTS, TRACKING_PARAM
from tidemark.functions.common import case_of, let

# scheme, user info, host, port, path, query (no fragment group: it is dropped)
WEB_URL = r"^(?i:(https?))://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), WEB_URL, 2))


def canonical_url(raw: Column) -> Column:
    """One spelling per page: host aliases, no tracking, no fragment, sorted query.

    Text that is not a web address comes back trimmed and otherwise unchanged.
    Percent-encoding is left as written.
    """
    return let(F.regexp_replace(raw, r"\s+", ""), _canonical)


def _canonical(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, WEB_URL, i)
    host = let(F.lower(part(2)), lambda h: case_of(h, HOST_ALIASES, h))
    origin = let(
        host,
        lambda h: F.concat(F.when(h.isin(*HTTPS_ONLY_HOSTS), "https").otherwise(F.lower(part(1))), F.lit("://"), h),
    )
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(part(4), "/+$", ""), "^/", ""))

    pairs = F.filter(F.split(part(5), "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            i.alias("pos"),
            F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))).alias("pair"),
        ),
    )
    kept = F.filter(keyed, lambda s: ~s["key"].rlike("(?i)" + TRACKING_PARAM))
    query = F.array_join(F.transform(F.sort_array(kept), lambda s: s["pair"]), "&")
    search = let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    rebuilt = F.concat(origin, port, path, search)
    return F.when(text.rlike(WEB_URL), rebuilt).otherwise(F.trim(text))


def extract_doi(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b", 0))
    return F.when(found != "", F.regexp_replace(found, r"[.,;)]+$", ""))


def extract_trial_ids(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bNCT\s?0?\d{7,8}\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.upper(F.regexp_replace(t, r"\s", ""))))
