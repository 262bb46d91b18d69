"""SNK: what exports write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: Sequence[Column], path: str, top: int | None = None, format: str = "parquet") -> None:
    """SNK-04, SNK-06, SRT-04, SRT-11: rows in order, the best top of them."""
    out = df.orderBy(*order)
    (out.limit(top) if top else out).write.mode("overwrite").format(format).save(path)


def per_portal(df: DataFrame, portal: str, deadline: str, path: str) -> None:
    """SNK-05: a folder for each portal, deadlines ascending. A large portal has several files."""
    df.repartition(portal, F.spark_partition_id() % 8).sortWithinPartitions(portal, F.asc_nulls_last(deadline)).write.mode("overwrite").partitionBy(portal).parquet(path)


def packages(df: DataFrame, path: str) -> None:
    """SNK-07: evidence as JSON lines; take packaged rows out with dedup.not_packaged before."""
    df.write.mode("append").json(path)


def raw_layer(df: DataFrame, model_columns: Sequence[str]) -> DataFrame:
    """SNK-08: df without what models made."""
    return df.drop(*model_columns)


def reordered(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """SNK-09: preferred columns first, the rest after."""
    own = [c for c in first if c in df.columns]
    return df.select(*own, *[c for c in df.columns if c not in own])


def append(df: DataFrame, path: str) -> None:
    """SNK-03, GRD-09: rows appended; take known keys out with upsert.insert_ignore before."""
    df.write.mode("append").parquet(path)


def rejects(df: DataFrame, bad: Column, path: str) -> DataFrame:
    """DQ-04: good rows; bad ones are written aside."""
    df.where(bad).write.mode("append").parquet(path)
    return df.where(~F.coalesce(bad, F.lit(False)))
