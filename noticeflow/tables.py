"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs one stage at most."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="noticeflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, on a single machine only, a temporary folder."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


def workers_import(spark: SparkSession) -> None:
    """Workers that start from now on find this library where the driver found it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noticeflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
