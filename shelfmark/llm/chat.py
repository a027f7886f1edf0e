"""Chat formatting over reply trees, with DataFrame functions only.

Messages point to the message they answer. Self-joins that double the jump each
round give every message its depth and the score of its path, rank the branches
(leaves) of a tree and list the messages of each chosen path; every path becomes
one formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import written

CLOSE = "</turn>\n"


def escaped(text: Column) -> Column:
    """Text without any control string of the template: ``&``, ``<`` and ``>`` become ``&amp;``, ``&lt;`` and ``&gt;``."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def chain_tree(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before.

    Turns are ordered by turn (nulls first), then role and text, and numbered, so
    repeated turns and repeated rows all stay. A null conv_id is one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("bigint")
    return rows.select("conv_id", "turn", "role", "text").withColumn("node", node).select(
        F.to_json(F.struct("conv_id")).alias("tree"), "conv_id", "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"),
    )


def ranked_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of every tree: tree, leaf, branch (from 1), path_score, position (from 1), node.

    ``nodes`` has tree, node (unique in its tree), parent and score. A path's score
    is the sum of its messages' scores (null counts 0); ties go to the smaller
    leaf. A message whose parent is absent starts a path. Messages on a circle have
    no root and are in no path. Round k joins jumps of 2^k messages to themselves,
    so a path of a million messages takes twenty rounds, and joins are keyed by
    message: a tree with most of the rows is spread evenly.
    """
    known = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    there = known.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    # jump: the message 2^k above (null: the path ends before); steps and sum: messages passed and their scores
    here = written(
        known.join(there, ["tree", "parent"], "left").select(
            "tree", "node", F.when(F.col("there"), F.col("parent")).alias("jump"), F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("sum")
        )
    )
    total, jumps, ended = here.count(), [], here.where(F.col("jump").isNull())
    parents = here
    while True:
        # only messages whose path goes on are joined again; the others stay as they are
        going = here.where(F.col("jump").isNotNull())
        if 2 ** (len(jumps) - 1) > total or going.limit(1).count() == 0:
            break
        jumps.append(going)
        far = going.unionByName(ended).select("tree", F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("steps").alias("more"), F.col("sum").alias("rest"))
        here = written(
            going.join(far, ["tree", "jump"]).select("tree", "node", F.col("far").alias("jump"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("sum") + F.col("rest")).alias("sum"))
        )
        ended = ended.unionByName(here.where(F.col("jump").isNull()))
    answered = parents.where(F.col("jump").isNotNull()).select("tree", F.col("jump").alias("node")).distinct()
    leaves = ended.join(answered, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("sum").desc(), F.col("node"))
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    paths = chosen.select("tree", F.col("node").alias("leaf"), "branch", F.col("sum").alias("path_score"), F.col("steps").alias("position"), "node")
    for k, step in reversed(list(enumerate(jumps))):
        up = step.select("tree", "node", F.col("jump").alias("up"))
        above = paths.join(up, ["tree", "node"]).withColumn("position", F.col("position") - 2**k).drop("node").withColumnRenamed("up", "node")
        paths = written(paths.unionByName(above))
    return paths


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation per chosen path: tree, leaf, branch, path_score, n_turns, formatted, spans.

    A turn is ``<turn role>``, the escaped text and ``</turn>`` with a line end;
    null roles and texts are empty. ``spans`` lists per turn ``start`` and ``end``
    of its escaped text in ``formatted`` (code points, end exclusive) and ``loss``,
    true for the assistant's turns: the loss mask. A path's texts meet in one row,
    which is the size of the conversation asked for.
    """
    paths = ranked_paths(nodes, branches).join(
        nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"]
    )
    turn = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"))
    rows = paths.select(
        "tree", "leaf", "branch", "path_score", "position", (F.col("role") == "assistant").alias("loss"),
        turn.alias("head"), escaped(F.col("text")).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    gathered = rows.groupBy("tree", "leaf", "branch", "path_score").agg(
        F.array_sort(F.collect_list(F.struct("position", "piece", "start", (F.col("start") + F.length("body")).alias("end"), "loss"))).alias("turns")
    )
    return gathered.select(
        "tree", "leaf", "branch", "path_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["loss"].alias("loss"))).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns read from the formatted text alone: adds ``turns`` (role, text) and ``loss_text``.

    ``loss_text`` is all text under the loss mask, unescaped. The mask's spans are
    checked against the text they were made for; a mismatch fails.
    """
    pieces = F.slice(F.split("formatted", CLOSE, -1), F.lit(1), F.size("spans"))
    parsed = formatted.withColumn("__pieces", pieces).withColumn(
        "turns",
        F.transform("__pieces", lambda p: F.struct(
            unescaped(F.regexp_extract(p, r"(?s)^<turn ([^>]*)>", 1)).alias("role"), F.regexp_extract(p, r"(?s)^<turn [^>]*>(.*)$", 1).alias("body"))),
    )
    placed = F.zip_with("turns", "spans", lambda t, s: F.struct(t["body"].alias("body"), s["start"].alias("start"), s["end"].alias("end"), s["loss"].alias("loss")))
    sizes = F.zip_with("__pieces", F.zip_with("turns", "spans", lambda t, s: F.struct(t["body"].alias("body"), s.alias("span"))), lambda p, x: F.struct(
        F.length(p).alias("all"), F.length(x["body"]).alias("body"), x["span"]["start"].alias("start"), x["span"]["end"].alias("end")))
    end = F.aggregate(
        sizes, F.lit(0).cast("bigint"),
        lambda at, x: F.when((x["end"] == at + x["all"]) & (x["start"] == x["end"] - x["body"]), at + x["all"] + len(CLOSE)),
    )
    masked = F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: unescaped(x["body"]))
    loss = F.when(end == F.length("formatted"), F.array_join(masked, "")).otherwise(F.raise_error(F.lit("spans do not fit the formatted text")))
    return parsed.withColumn("loss_text", loss).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), unescaped(t["body"]).alias("text")))
    ).drop("__pieces")
