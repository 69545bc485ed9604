"""Chat formatting: reply trees to marked-up conversations (native).

A reply tree is a set of nodes ``(tree, node, parent, role, text, score)``.
Every root-to-leaf path is found by iterative self-joins that double the
distance they look back: after round k a node knows its ancestor 2**k steps up
and the score of the steps between, so a path of length n takes log2(n) joins,
whatever the number of nodes. Each leaf then climbs to its root by those steps,
adding up their scores; branches are ranked inside their tree by the mean score
of their nodes, then by leaf, and only the nodes of the chosen ones are listed
and written as one conversation each. Texts travel in the last join alone. Only
DataFrame functions are used.

Template: each turn is ``<turn>role\\n`` + text + ``</turn>\\n``. Inside a
text a backslash becomes ``\\b``, ``<turn`` becomes ``\\lturn`` and ``</turn``
becomes ``\\l/turn``; in a role a line feed becomes ``\\n`` as well. Every
backslash of the output therefore begins an escape and no text can close or
open a turn; two replacements undo it.

Defined results: a null text or role is empty; a parent that is null or absent
makes a root; nodes on a cycle reach no root and are on no path; rows that
repeat (tree, node) are kept once, the smallest by (role, text) winning; nodes
without a tree make one tree, whose name is null; rows whose node is null are
left out; an empty table gives no rows; extra columns are ignored. A formatted conversation is one cell, which Spark limits
to 2 GB; that is the only limit on a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_table

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column, head: bool = False) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    if head:
        text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(F.replace(text, F.lit("<turn"), F.lit("\\lturn")), F.lit("</turn"), F.lit("\\l/turn"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def branches(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """``tree, leaf, rank, score, step, node``: the nodes of each chosen path,
    step 0 at the root. nodes: ``tree, node, parent, score``, one row a node;
    top: paths kept in each tree (None: all)."""
    nodes = nodes.withColumn("tree", F.struct("tree"))  # joins then find a null tree too
    known = nodes.select("tree", F.col("node").alias("parent"))
    linked = cut(
        nodes.join(known.withColumn("found", F.lit(True)), ["tree", "parent"], "left").select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )
    # a path is no longer than its tree, which bounds the rounds even if parents form a cycle
    most = linked.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = [linked.select("tree", "node", "up", F.col("score").alias("sum"))]
    while (1 << len(jumps)) < most:
        last = jumps[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("sum").alias("more"))
        jumps.append(cut(last.filter("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("sum") + F.col("more")).alias("sum"))))
        if jumps[-1].isEmpty():
            jumps.pop()
            break
    inner = linked.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = linked.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    # one row a leaf: how far it has climbed, and the score of the nodes below that place
    climb = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("sum"), F.lit(1).alias("length"))
    for k in reversed(range(len(jumps))):
        hop = jumps[k].filter("up is not null").select("tree", "node", F.col("up").alias("to"), F.col("sum").alias("more"))
        moved = F.col("to").isNotNull()
        climb = climb.join(hop, ["tree", "node"], "left").select("tree", "leaf", F.coalesce("to", "node").alias("node"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("length") + F.when(moved, 1 << k).otherwise(0)).alias("length"))
    top_of = linked.filter("up is null").select("tree", "node", F.col("score").alias("more"))
    path = climb.join(top_of, ["tree", "node"]).select("tree", "leaf", "length", ((F.col("sum") + F.col("more")) / F.col("length")).alias("score"))
    path = path.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top is not None:
        path = path.filter(F.col("rank") <= top)
    # (leaf, node, step), up from the leaf, which is the last step; each pass doubles the rows
    paths = path.select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), (F.col("length") - 1).alias("step"))
    for k in reversed(range(len(jumps))):
        hop = jumps[k].filter("up is not null").select("tree", "node", "up")
        paths = cut(paths.unionByName(paths.join(hop, ["tree", "node"]).select("tree", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("step") - (1 << k)).alias("step"))))
    return paths.select("tree.tree", "leaf", "rank", "score", "step", "node")


def format_trees(nodes: DataFrame, top: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row for each chosen path: ``tree, leaf, rank, score, formatted,
    loss`` where loss lists the spans (start from 1, length, in code points of
    formatted) that hold the trained role's escaped texts."""
    nodes = nodes.select("tree", "node", "parent", "role", "text", "score").filter("node is not null").withColumn("tree", F.struct("tree"))
    nodes = cut_table(nodes.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("x")).select("tree", "node", "x.*"))
    chosen = branches(nodes, top)
    turn = nodes.select("tree", "node", escape(F.col("role"), head=True).alias("head"), escape(F.col("text")).alias("body"), F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("trained"))
    turns = F.array_sort(F.collect_list(F.struct("step", "head", "body", "trained")))
    path = chosen.join(turn, ["tree", "node"]).groupBy("tree", "leaf", "rank", "score").agg(turns.alias("turns"))
    lead = len(OPEN) + 1
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + lead + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(t["trained"], F.concat(s["spans"], F.array(F.struct((s["at"] + lead + F.length(t["head"]) + 1).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["head"], F.lit("\n"), t["body"], F.lit(CLOSE))), "")
    return path.select("tree.tree", "leaf", "rank", "score", written.alias("formatted"), ends["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The ``role, text`` structs that a formatted conversation holds."""
    parts = F.slice(F.split(formatted, F.lit(CLOSE)), 1, F.greatest(F.size(F.split(formatted, F.lit(CLOSE))) - 1, F.lit(0)))
    return F.transform(parts, lambda p: F.struct(unescape(F.substr(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))


def turns_to_nodes(turns: DataFrame) -> DataFrame:
    """Rows by turn as reply chains: each row answers the one before it.
    Rows that repeat a turn follow each other by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
