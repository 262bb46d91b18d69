"""The session this library is made for: adaptive execution, Arrow, UTC."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any size; partitions and memory are the cluster's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "noticeflow", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and more; master only where none is set from outside."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()


def local(cpus: int | None = None, **more: str) -> SparkSession:
    """A local session, for tests and benchmarks."""
    n = cpus or os.cpu_count() or 4
    local_settings = {"spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return build(master=f"local[{n}]", **(local_settings | more))
