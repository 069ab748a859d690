"""Explicit schemas. Nothing is inferred."""

from __future__ import annotations

STEP = (
    "struct<id:string,label:string,due:string,time_of_day:string,precondition:string,system:string,"
    "gating:boolean,status:string,note:string>"
)
CYCLE = (
    "struct<year:int,deadline:string,confirmed:boolean,kind:string,time_of_day:string,precision:string,"
    f"verify_by:date,evidence:string,steps:array<{STEP}>,note:string>"
)
PROGRAMS = f"""
    program_id string, label string, org string, lane string, status string, priority string,
    url string, time_zone string, verified_on date, verify_every int, watch_from date,
    event_start date, event_end date, venue string,
    eligibility struct<notes:string,degree_stage:array<string>,citizenship:array<string>,source:string>,
    ruled_out struct<reason:string,citation:string>,
    cycles array<{CYCLE}>,
    recurrence struct<cadence:string,anchor:string,anchors:array<string>>,
    note string
"""

SOURCES = """
    source_id string, source_name string, publisher_group string, role string, source_kind string,
    dialect string, vendor string, company string, expect_location string, authority double,
    lane_hints map<string,double>, paywalled boolean, max_items int, enabled boolean, optional boolean,
    time_zone string, date_style string, exclude_url array<string>, exclude_title array<string>,
    require_any array<string>
"""
PAGE_WATCHES = "program_id string, url string, crawl_delay_ms int"
RAW_BODIES = "source_id string, fetched_at timestamp, http_status int, error string, body string"

RUNGS = "program_id string, cycle_year int, rung int"
ROLLING = "program_id string, last_delivered date"
FIRST_SEEN = "item_id string, first_seen date"
PAGE_HASHES = """
    program_id string, hash string, first_seen date, last_changed date, length int,
    last_status int, last_error string
"""
SOURCE_HISTORY = "source_id string, last_success date, streak int, recent_counts array<int>"
RUN_STATUS = """
    date date, started_at timestamp, finished_at timestamp, outcome string, message string,
    sources_ok long, sources_total long, items_kept long, deadlines_tracked long
"""

GREENHOUSE = """
    struct<jobs:array<struct<id:long,title:string,absolute_url:string,content:string,updated_at:string,
    location:struct<name:string>>>>
"""
LEVER = """
    array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:double,
    descriptionPlain:string,additionalPlain:string,
    categories:struct<team:string,location:string,commitment:string>>>
"""
ASHBY = """
    struct<jobs:array<struct<id:string,title:string,jobUrl:string,location:string,publishedAt:string,
    descriptionPlain:string,isListed:boolean>>>
"""
_ITEM = """
    array<struct<title:string,link:string,guid:string,pubDate:string,
    `dc:date`:string,`prism:publicationDate`:string,`content:encoded`:string,description:string,
    `dc:creator`:string,`prism:doi`:string,category:array<string>>>
"""
_ENTRY = """
    array<struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,published:string,updated:string,
    content:string,summary:string,author:array<struct<name:string>>,`dc:creator`:string,`prism:doi`:string,
    category:array<struct<_term:string>>>>
"""
#: The children of three roots at once: items in a channel, items beside it, and entries.
FEED = f"struct<channel:struct<title:string,item:{_ITEM}>,item:{_ITEM},entry:{_ENTRY}>"
