"""Reply trees as training conversations: root-to-leaf paths, ranked, formatted with a loss mask.

Paths are found by self-joins that double their reach: after k rounds a message
knows its ancestor 2^k steps up and the score on the way. The number of rounds
grows with the logarithm of the deepest tree, and no round holds a pair for
every message and ancestor. The chosen leaves are then expanded back to their
paths over the same tables, halving the step each time.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles
a backslash goes between ``<`` and any backslashes followed by ``|``, so that no
text holds a control string, and reading back removes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _steps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ancestors 1, 2, 4, ... steps up, and of every message's depth and path score."""
    parents = messages.select(F.col("c").alias("c2"), F.col("v").alias("up"))
    known = messages.join(parents, (F.col("parent") == F.col("up")) & (F.col("c") == F.col("c2")), "left")
    now = known.select("c", "v", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    now = materialize(now, "steps")
    n, tables, settled = now.count(), [], now.filter("up is null")
    active = now.filter("up is not null")
    while active.limit(1).count():
        if 1 << len(tables) > n:
            # only messages that are their own ancestors go on: no root, no path
            break
        tables.append(active.select("c", "v", "up"))
        further = active.unionByName(settled).select(
            F.col("c").alias("c2"), F.col("v").alias("v2"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2")
        )
        joined = active.join(further, (F.col("c") == F.col("c2")) & (F.col("up") == F.col("v2")))
        total, depth = (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth")
        now = materialize(joined.select("c", "v", F.col("up2").alias("up"), total, depth), "steps")
        settled, active = settled.unionByName(now.filter("up is null")), now.filter("up is not null")
    return tables, settled


def reply_paths(messages: DataFrame, best: int | None) -> DataFrame:
    """c, path (its leaf), rank, v, depth: the messages of the chosen paths of each conversation.

    ``messages``: c, v, parent, score with unique non-null (c, v). Leaves rank by
    the sum of the scores on their path, then its length, then v. ``best`` paths
    of each conversation are chosen, or all.
    """
    tables, known = _steps(messages)
    inner = messages.select("c", F.col("parent").alias("v")).filter("v is not null").distinct()
    order = Window.partitionBy("c").orderBy(F.desc("total"), F.desc("depth"), "v")
    leaves = known.join(inner, ["c", "v"], "left_anti").withColumn("rank", F.row_number().over(order))
    if best is not None:
        leaves = leaves.filter(F.col("rank") <= best)
    paths = leaves.select("c", F.col("v").alias("path"), "rank", "v")
    for table in reversed(tables):
        both = paths.join(table, ["c", "v"], "left").select("c", "path", "rank", F.explode(F.array("v", "up")).alias("v"))
        paths = both.filter("v is not null")
    return paths.join(known.select("c", "v", "depth"), ["c", "v"])


def format_conversations(
    messages: DataFrame,
    conv: str = "conv_id",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str = "score",
    best: int | None = 1,
) -> DataFrame:
    """conv, path, rank, n_turns, formatted, loss_spans: one row per chosen path.

    ``loss_spans``: start (from 0) and length, in code points of ``formatted``, of
    the texts of the role ``assistant``, in order. Null roles and texts are empty,
    null scores 0. A message whose parent is null or not there is a root. Of
    several messages with one conversation and node the least (by parent, role,
    text) counts; messages without a node, or on a circle of parents, have no
    place in a tree. Null conversations are one conversation.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit(""))
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = messages.select(
        key.alias("c"),
        F.col(f"`{node}`").alias("v"),
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{parent}`").alias("parent"),
        value(role).alias("role"),
        value(text).alias("text"),
        F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)).alias("score"),
    ).filter("v is not null")
    first = Window.partitionBy("c", "v").orderBy("parent", "role", "text", F.desc("score"))
    rows = materialize(rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n"), "messages")
    paths = reply_paths(rows.select("c", "v", "parent", "score"), best)
    turns = paths.join(rows.select("c", "v", "conv", "role", "text"), ["c", "v"])
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("c", "path", "rank", "conv", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    before = Window.partitionBy("c", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct(
        "depth",
        F.concat("head", "body", F.lit(END)).alias("turn"),
        (F.col("role") == "assistant").alias("learn"),
        F.col("begin").alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    done = turns.groupBy("c", "path", "rank").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return done.select(
        F.col("conv").alias(conv),
        "path",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The role and text of each turn, read back."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = F.substr(part, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substr(part, at + 1)).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read back."""
    part = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, part), "")
