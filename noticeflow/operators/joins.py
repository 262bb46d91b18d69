"""Joins that bear one key with a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of over one in so many rows is joined by broadcast; there are at most so many such keys.
HOT_KEYS = 4096


def hot_key_join(rows: DataFrame, side: DataFrame, on: Sequence[str], n_col: str, total: int, how: str = "inner") -> DataFrame:
    """rows with side's columns (but n_col), where side has one row a key and n_col says how many of total rows have it.

    Hot keys, at most HOT_KEYS whatever the input, are broadcast and join where the rows lie; only rows of other keys are shuffled,
    and none of these fills a task. how: inner or left. Null keys match nothing.
    """
    most = max(1, total // HOT_KEYS)
    hot = side.where(F.col(n_col) > most).drop(n_col).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), list(on), "left")
    more = [c for c in side.columns if c not in on and c != n_col]
    cold = tagged.where("_hot IS NULL").drop("_hot", *more).join(side.where(F.col(n_col) <= most).drop(n_col), list(on), how)
    return tagged.where("_hot").drop("_hot").unionByName(cold)
