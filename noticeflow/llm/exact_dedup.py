"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only.

A row's key is a 64-bit hash of its normalised text (each run of blanks one space). Keys lie in
buckets, and a directory of 2^depth slots maps the leading bits of a key to its bucket. A bucket with too
many keys splits on its next bit, which doubles the directory where the bucket was as deep as the directory.
So each bucket is a range of keys; its rows go to one owner task, and all that is known of a row comes from there: the
rows of a key form a chain, in which texts are told apart by their bytes and copies are counted. A key with
very many rows is dealt to several owners of its bucket, each with a chain of its own, and the heads of these chains,
one for each text, are compared once more. Directory and chains are tables in the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticeflow.llm.common import Scratch, blank_runs_to_space

#: Keys a bucket holds before it splits, and the deepest directory (at most 2^18 counts reach the driver and slots are broadcast).
#: Where that many buckets would not do, all buckets hold more.
BUCKET_KEYS, MAX_DEPTH = 512, 18

#: At most so many keys, those with the most rows, are dealt to several owners; any other key has fewer rows than an average bucket or so.
HOT_KEYS = 1 << 16


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Depth and slots of an extendible-hash directory.

    counts: keys by their leading max_depth bits. Buckets split while over capacity, until their depth is max_depth; the directory is
    as deep as its deepest bucket. Slots name buckets by their first key prefix.
    """
    at_depth = [dict(counts)]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for prefix, n in at_depth[-1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        at_depth.append(up)
    at_depth.reverse()
    depth, buckets, todo = 0, [], [(0, 0)]
    while todo:
        local, prefix = todo.pop()
        if local < max_depth and at_depth[local].get(prefix, 0) > capacity:
            depth = max(depth, local + 1)  # where the bucket was as deep as the directory, this doubles it
            todo += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
        else:
            buckets.append((local, prefix))
    slots = [0] * (1 << depth)
    for local, prefix in buckets:
        first = prefix << (depth - local)
        slots[first : first + (1 << (depth - local))] = [first << (max_depth - depth)] * (1 << (depth - local))
    return depth, slots


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, chain (place among the texts of its key).

    Texts are equal when identical after each run of blanks became one space; null counts
    as empty. The smallest id of a group stays; a null id stays only where the group
    has no other. Rows with a repeated id and equal texts count each; the first of them is
    not told from the rest, so kept holds for all of them. No rows give no rows. Other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(spark, "exact")
    norm = docs.select(F.col(id_col).alias("_id"), blank_runs_to_space(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    keyed = norm.withColumn("_key", F.xxhash64("_norm"))
    keys = scratch.cut(keyed.groupBy("_key").agg(F.count("*").alias("n")), "keys")
    n_keys, total = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(capacity, 2 * n_keys >> MAX_DEPTH)
    deepest = min(MAX_DEPTH, 4 + math.ceil(math.log2(max(1, n_keys / capacity))))  # hashes spread evenly, so a few bits more than needed on average
    counts = {r[0]: r[1] for r in keys.groupBy(F.shiftrightunsigned("_key", 64 - deepest).alias("p")).count().collect()}  # at most 2^deepest
    depth, slots = directory(counts, capacity, deepest)
    made = spark.createDataFrame(list(enumerate(slots)), "slot long, bucket long")
    slot_table = scratch.cut(made.coalesce(1), "directory")
    most = max(2 * capacity, total // HOT_KEYS)
    hot = keys.where(F.col("n") > most).select("_key", F.ceil(F.col("n") / most).alias("owners"))
    routed = keyed.withColumn("slot", F.shiftrightunsigned("_key", 64 - depth) if depth else F.lit(0).cast("long")).join(F.broadcast(slot_table), "slot").join(F.broadcast(hot), "_key", "left")
    owner = F.when(F.col("owners").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("owners")) + 1)
    owned = routed.select("_id", "_key", "_norm", "bucket", owner.alias("owner")).repartition("bucket", "owner")
    # An owner sorts its keys, and the texts of a key by their bytes; equal ones stand together.
    same = W.partitionBy("bucket", "owner", "_key", "_norm")
    chained = owned.select("_id", "_key", "bucket", "owner", "_norm", F.min("_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), F.row_number().over(same.orderBy("_id")).alias("at"), (F.dense_rank().over(W.partitionBy("bucket", "owner", "_key").orderBy("_norm")) - 1).alias("chain"))
    is_head = (F.col("owner") > 0) & (F.col("at") == 1)
    index = scratch.cut(chained.select("_id", "_key", "bucket", "owner", "keep_id", "group_size", "chain", F.sha2("_norm", 256).alias("text_sha256"), F.when(is_head, F.col("_norm")).alias("head")), "chains")
    heads = index.where("head IS NOT NULL").groupBy("_key", "head").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    heads = scratch.cut(heads.select("_key", "text_sha256", "keep_id", "group_size", (F.row_number().over(W.partitionBy("_key").orderBy("head")) - 1).alias("chain")), "heads")
    few = heads.count() <= 2 * HOT_KEYS  # a key has one text, but for collisions of 64 bits
    names = ["_id", "keep_id", "group_size", "text_sha256", "chain"]
    alone = index.where("owner = 0").select(*names)
    dealt = index.where("owner > 0").select("_id", "_key", "text_sha256").join(F.broadcast(heads) if few else heads, ["_key", "text_sha256"]).select(*names)
    found = alone.unionByName(dealt)
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "chain")
