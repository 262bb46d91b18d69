"""Chat formatting: reply trees to conversations.

A message names its parent; the messages of a tree without one are its roots. Iterative
self-joins double the reach of each message's pointer to its ancestors, which
gives every leaf its root, length and score in a logarithm of the depth in rounds; leaves
are ranked by score, and the chosen ones' paths are enumerated through the same pointers.
Each chosen path becomes one conversation in a template of control strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticeflow.llm.common import Scratch

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"

#: Turns that are put together at a time, so that no task gathers a long conversation turn by turn.
CHUNK = 64


def escape(text: Column) -> Column:
    r"""Text without "<|": one backslash more between < and |, whatever number there was."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(NEWLINE), F.lit("\n")), r"<\\(\\*)\|", r"<$1|")


def linear_trees(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation as a tree without branches: tree, node (from 1), parent, role, text, score (0).

    Rows follow each other by turn, then role and text; null turns come first. Null roles
    and texts are empty; null conversations are one conversation. Numbering goes by
    chunks of turns, so a long conversation is not one window.
    """
    rows = conversations.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("_chunk", F.floor(F.col("_turn") / 256)).withColumn("_at", F.row_number().over(W.partitionBy("tree", "_chunk").orderBy("_turn", "role", "text")))
    sizes = rows.groupBy("tree", "_chunk").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("tree").alias("_t"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(W.partitionBy("tree").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.join(before, rows.tree.eqNullSafe(before._t) & rows._chunk.eqNullSafe(before._c))
    node = F.col("_before") + F.col("_at")
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, key: str, on: str) -> Column:
    return a["tree"].eqNullSafe(b["_tree"]) & (a[key] == b[on])


def best_paths(scratch: Scratch, messages: DataFrame, top_k: int) -> DataFrame:
    """tree, path_rank, leaf, path_score, n_turns, node, dist (steps above the leaf) of each tree's top_k best root-to-leaf paths.

    messages: tree, node, parent, score. A path's score is the mean of its messages'; ties go to
    the smaller leaf. A parent that is not in the tree makes a root. Messages on a cycle, and those below one,
    have no root and are left out. Every node may have its row in messages once only.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    known = nodes.join(ids, _same(nodes, ids, "parent", "_node"), "left")
    now = scratch.cut(known.select("tree", "node", F.col("_node").alias("ptr"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), "reach-0")
    first, levels, done = now, [], [now.where("ptr IS NULL")]
    count = now.count()
    while (open_ := now.where("ptr IS NOT NULL")).take(1) and len(levels) <= count.bit_length():
        levels.append(open_)
        target = now  # and those that had found their root before
        for d in done[:-1]:
            target = target.unionByName(d)
        target = target.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("ptr").alias("_ptr"), F.col("total").alias("_total"), F.col("n").alias("_n"))
        further = open_.join(target, _same(open_, target, "ptr", "_node"))
        now = scratch.cut(further.select("tree", "node", F.col("_ptr").alias("ptr"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n")), f"reach-{len(levels)}")
        done.append(now.where("ptr IS NULL"))
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    parents = first.where("ptr IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("ptr").alias("_ptr")).distinct()
    leaves = ended.join(parents, _same(ended, parents, "node", "_ptr"), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    chosen = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("path_score"), F.col("n").alias("n_turns")).withColumn("path_rank", rank).where(F.col("path_rank") <= top_k)
    steps = scratch.cut(chosen.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist")), "steps-0")
    for k in range(len(levels) - 1, -1, -1):  # from the farthest pointers: each ancestor is met once
        jump = levels[k].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("ptr").alias("_ptr"))
        up = steps.join(jump, _same(steps, jump, "node", "_node")).select(*chosen.columns, F.col("_ptr").alias("node"), (F.col("dist") + F.lit(1 << k)).alias("dist"))
        steps = scratch.cut(steps.unionByName(up), f"steps-{len(levels) - k}")
    return steps


def format_trees(spark: SparkSession, messages: DataFrame, top_k: int = 1) -> DataFrame:
    """One row per chosen path: tree, path_rank, path_score, n_turns, formatted, loss_spans.

    messages: tree, node (unique in its tree), parent, role, text, score; nulls as in
    linear_trees. formatted: for each turn, from the root on, START role newline text END newline,
    roles and texts escaped, newlines within roles as NEWLINE. loss_spans: start and length in
    code points of each assistant turn's text. No messages give no rows.
    """
    scratch = Scratch(spark, "chat")
    rows = scratch.cut(messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    paths = best_paths(scratch, rows, top_k)
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    turn = rows.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    turns = paths.join(turn, _same(paths, turn, "node", "_node")).withColumn("at", F.col("n_turns") - 1 - F.col("dist"))
    key = ["tree", "path_rank", "path_score", "n_turns"]
    small = F.struct("at", "piece", F.length("piece").alias("size"), F.length("head").alias("lead"), F.length("body").alias("length"), "loss")
    chunks = turns.groupBy(*key, F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(small)).alias("t"))
    ahead = lambda i: F.aggregate(F.slice("t", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["size"])
    spans = F.transform("t", lambda x, i: F.struct((ahead(i) + x["lead"]).alias("start"), x["length"].cast("long").alias("length"), x["loss"].alias("loss")))
    chunks = chunks.select(*key, "chunk", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("part"), F.filter(spans, lambda x: x["loss"]).alias("spans"))
    before = F.coalesce(F.sum(F.length("part").cast("long")).over(W.partitionBy("tree", "path_rank").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.withColumn("before", before)
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("before")).alias("start"), x["length"].alias("length")))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "part", moved.alias("spans"))))
    whole = chunks.groupBy(*key).agg(parts.alias("p"))
    return whole.select(*key, F.array_join(F.transform("p", lambda x: x["part"]), "").alias("formatted"), F.flatten(F.transform("p", lambda x: x["spans"])).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, each as role, newline, text, unescaped."""
    each = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(each, 1, F.size(each) - 1), lambda x: unescape(F.substr(x, F.lit(len(START) + 1))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
