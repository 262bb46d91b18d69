"""Listings, selections and counters that reports, digests and repair runs read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import dates
from noticeflow.functions.text import clean_or_null


def tag_counts(rows: DataFrame, tag: str = "model_decision_tag", unknown: str = "UNKNOWN") -> DataFrame:
    """AGG-18, AGG-37: rows by tag; those without one under unknown."""
    return rows.groupBy(F.coalesce(clean_or_null(tag), F.lit(unknown)).alias("tag")).agg(F.count("*").alias("n"))


def page_counts(page: DataFrame, status: str = "status") -> DataFrame:
    """AGG-41: counts by status of a page that is cut already, not of the whole list."""
    return page.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def newest_first(*days: str) -> Column:
    """SRT-13: descending by the first of days that there is; none at all last."""
    return F.coalesce(*map(F.col, days)).desc_nulls_last()


def top_of_each(rows: DataFrame, label: str, keys: Sequence[Column], most: int, id_col: str) -> DataFrame:
    """SRT-07, SRT-14: the first rows of each label by keys, then by id; Spark keeps so many of each label in each task before it shuffles."""
    from pyspark.sql import Window as W

    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy(*keys, id_col)))
    return ranked.where(F.col("rank") <= most)


def candidates(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """SRT-08, SRT-10: the first rows by a given order."""
    return rows.orderBy(*order).limit(most)


def source_class(source: str, classes: dict[str, int], default: int) -> Column:
    """SRT-10: the rank of a source's class."""
    return F.coalesce(*[F.when(F.col(source) == k, v) for k, v in classes.items()], F.lit(default))


def enriched(rows: DataFrame, ids: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """LKP-07: rows of ids with columns of rows where there is such a row; null where there is none."""
    return ids.select(key).distinct().join(rows.select(key, *columns), key, "left")


def lifecycle_list(ledger: DataFrame, owners: DataFrame, key: str, stage: str | None, owner: str | None, updated: str, most: int) -> DataFrame:
    """LKP-09: ledger rows with their owner, filtered by stage and owner where those are given, newest update first."""
    joined = ledger.join(owners, key, "left")
    if stage is not None:
        joined = joined.where(F.col("status") == stage)
    if owner is not None:
        joined = joined.where(F.col("owner") == owner)
    return joined.orderBy(F.col(updated).desc_nulls_last(), "tender_id").limit(most)


def index_source(records: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """LKP-12, LKP-13: all records, with their class where they have one, for an index or a score; order and pages are the reader's, no loop is left."""
    return records.join(classes, key, "left")


def rescored(records: DataFrame, stored: DataFrame, key: str, score: str = "score") -> DataFrame:
    """SRT-15, RPR-05: records with a score of their own, beside what is stored of them: old_score and state (new, changed, same). One plan, whatever the number of rows."""
    old = stored.groupBy(key).agg(F.max(score).alias("old_score"))
    state = F.when(F.col("old_score").isNull(), "new").when(F.col("old_score") != F.col(score), "changed").otherwise("same")
    return records.join(old, key, "left").withColumn("state", state)


def earliest_date(*texts: str) -> Column:
    """SUB-05: the least of the dates that can be read."""
    return F.least(*map(dates.parse_date, texts)) if len(texts) > 1 else dates.parse_date(texts[0])


def due(last: Column, now: Column, days: int = 7, forced: bool = False) -> Column:
    """LRN-05: whether a run is due: never run, so many days ago, or forced."""
    return F.lit(forced) | F.coalesce(F.datediff(now, last) >= days, F.lit(True))


def flat_record(raw: str, fields: dict[str, str]) -> list[Column]:
    """NRM-34: columns of nested JSON, each from the first of its paths (parted by |) that has a value."""
    return [F.coalesce(*[clean_or_null(F.get_json_object(raw, p)) for p in paths.split("|")]).alias(name) for name, paths in fields.items()]
