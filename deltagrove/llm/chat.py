"""Reply trees formatted as conversations, with DataFrame functions only.

A node replies to its parent; a node whose parent is missing is a root. Runs of nodes in which each replies to the one just
before it, without a branch, are contracted to segments, so that the self-joins that enumerate root-to-leaf paths take one
round for each branching level and none for a plain log of turns. Paths are ranked by the sum of their nodes' scores, ties
by the lower leaf.

A turn is "### role:\\ntext\\n</turn>\\n" with a backslash before each backslash, "#" and "<" (and ":" in roles), so neither
mark can stand inside a text. Null roles and texts count as empty. Repeated rows are turns of their own. Nodes on a cycle
are on no path. Extra columns are ignored. Turns or nodes with a null conv_id are one conversation of their own; turns with a
null number come first. Texts of any length go whole; a conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

END = "\n</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    return F.regexp_replace(c, r"([\\#<:])" if role else r"([\\#<])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def turns_to_nodes(turns: DataFrame) -> DataFrame:
    """A log of turns as a reply tree: each turn replies to the one before it. Ties go by role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).cast("long").alias("node"))
    return n.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: conv_id, node, parent, score. The nodes with their segment, and the root-to-leaf paths: conv_id, leaf (its
    last segment), segs, score, rank."""
    n, ways = _paths(nodes.withColumn("conv_id", F.struct("conv_id")))
    return n.withColumn("conv_id", F.col("conv_id.conv_id")), ways.withColumn("conv_id", F.col("conv_id.conv_id"))


def _paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As paths, with a struct of the id as conv_id: structs of nulls are equal, so nodes without an id make up one tree."""
    kids = nodes.where("parent is not null").groupBy("conv_id", F.col("parent").alias("node")).agg(F.count("*").alias("_kids"))
    n = nodes.join(kids, ["conv_id", "node"], "left")
    w = Window.partitionBy("conv_id").orderBy("node")
    starts = F.col("parent").isNull() | ~F.coalesce(F.col("parent") == F.lag("node").over(w), F.lit(False)) | (F.lag("_kids").over(w) > 1)
    n = n.withColumn("_starts", starts)
    n = written(n.withColumn("seg", F.max(F.when(F.col("_starts"), F.col("node"))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    segs = n.groupBy("conv_id", "seg").agg(F.sum("score").alias("score"), F.max(F.when(F.col("_starts"), F.col("parent"))).alias("_up"), F.max_by(F.coalesce("_kids", F.lit(0)), "node").alias("_kids"))
    owner = n.select("conv_id", F.col("node").alias("_up"), F.col("seg").alias("parent_seg"))
    segs = written(segs.join(owner, ["conv_id", "_up"], "left"))
    front = segs.where("parent_seg is null").select("conv_id", "seg", F.array("seg").alias("segs"), "score", "_kids")
    step = segs.where("parent_seg is not null").select("conv_id", F.col("parent_seg").alias("_at"), F.col("seg").alias("_next"), F.col("score").alias("_s"), F.col("_kids").alias("_k"))
    done = front.where("_kids = 0")
    if not step.isEmpty():
        while True:  # ends: nodes of a cycle hang below no root
            joined = front.where("_kids > 0").join(step, (front.conv_id == step.conv_id) & (front.seg == step["_at"]))
            front = written(joined.select(front.conv_id, F.col("_next").alias("seg"), F.concat("segs", F.array("_next")).alias("segs"), (F.col("score") + F.col("_s")).alias("score"), F.col("_k").alias("_kids")))
            if front.isEmpty():
                break
            done = done.unionByName(front.where("_kids = 0"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "seg"))
    return n, done.select("conv_id", F.col("seg").alias("leaf"), "segs", "score", rank.alias("rank"))


def format_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """nodes: conv_id, node, parent, role, text, score. The `keep` best paths of each tree as one conversation each: conv_id,
    rank, formatted, and the loss mask as spans (start from 1, len) over the assistant's escaped texts."""
    n, ways = _paths(nodes.withColumn("conv_id", F.struct("conv_id")))
    chosen = ways.where(F.col("rank") <= keep).select("conv_id", "rank", F.explode("segs").alias("seg"))
    t = n.join(chosen, ["conv_id", "seg"]).select("conv_id", "rank", "node", "role", F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(":\n")).alias("_head"), escape(F.col("text")).alias("_body"))
    t = t.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    w = Window.partitionBy("conv_id", "rank").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_start", F.sum(F.length("_piece")).over(w) - F.length("_piece") + F.length("_head") + 1)
    span = F.struct(F.col("_start").cast("int").alias("start"), F.length("_body").alias("len"), (F.col("role") == "assistant").alias("loss"))
    g = t.groupBy("conv_id", "rank").agg(F.array_sort(F.collect_list(F.struct("node", "_piece", span.alias("span")))).alias("_t"))
    spans = F.transform(F.filter("_t", lambda x: x["span"]["loss"]), lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["len"].alias("len")))
    return g.select("conv_id.conv_id", "rank", F.array_join(F.transform("_t", lambda x: x["_piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold: turns (role, text) and the text under the loss mask."""
    pieces = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    shape = r"(?s)^### ((?:[^\\:]++|\\.)*+):\n(.*)$"
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, shape, 1)).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["len"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
