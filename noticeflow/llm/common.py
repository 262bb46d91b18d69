"""What the operators share: scratch tables, skew-safe joins, components, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks between words, as the contracts define them.
BLANKS = r"[\x20\x09-\x0D]+"

#: A key that holds over one row in so many is joined by broadcast; there are at most so many such keys.
HOT_KEYS = 4096

_own_dir: str | None = None

#: What a Python worker keeps between tasks, by the operator that keeps it, and how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """Says that this worker keeps something for name's tasks."""
    _kept[name] = forget


def begin(name: str) -> None:
    """A task of name begins in this worker, which is shared by all stages: what others have kept goes."""
    for other in [x for x in _kept if x != name]:
        _kept.pop(other)()
    give_back()


def give_back() -> None:
    """Memory that is free in this process goes back to the machine: workers outlive their tasks, and what an idle one holds is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let_workers_import(spark: SparkSession) -> None:
    """Puts the library's parent folder on the Python path of the workers that start from now on."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, on a single machine only, one of our own."""
    global _own_dir
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own_dir = tempfile.mkdtemp(prefix="noticeflow-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


class Scratch:
    """Intermediate tables of one call, written to the shared folder, so that a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, name: str):
        let_workers_import(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/noticeflow/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again: a short lineage that survives the loss of executors."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def join_by_hot_key(left: DataFrame, right: DataFrame, on: list[str], n_col: str, total: int, how: str = "inner") -> DataFrame:
    """left with right's columns, where right has one row a key and n_col says how many rows of left have that key.

    Keys of over total / HOT_KEYS rows (at most HOT_KEYS of them, so the broadcast
    is bounded whatever the input) join where left's rows lie; only the others are
    shuffled, and none of those fills a task. how: inner, or left to keep rows of
    left without a key in right. Null keys match nothing.
    """
    most = max(1, total // HOT_KEYS)
    hot, rest = right.where(F.col(n_col) > most), right.where(F.col(n_col) <= most)
    tagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    extra = [c for c in right.columns if c not in on]
    first = tagged.where("_hot").drop("_hot")
    second = tagged.where("_hot IS NULL").drop("_hot", *extra).join(rest, on, how)
    return first.unionByName(second)


def components(scratch: Scratch, edges: DataFrame, name: str = "edges") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: a, b (any orderable type, not null). Returns node, root: for each node with an
    edge to another one, the smallest node of its component. Each round is cut; every
    step works on minima with map-side combining and on equi-joins, so no
    neighbourhood is ever gathered in one place.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = both.join(least, "a")
        if large:
            out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    mark, n = None, 0
    while True:
        n += 1
        now = scratch.cut(star(star(now, True), False), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("count_if(true)")).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def byte_views(array: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    for x in array.cast(pa.large_binary()).to_pylist():
        yield x or b""


def blank_runs_to_space(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")
