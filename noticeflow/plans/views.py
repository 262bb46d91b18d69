"""Listings, pages, dashboards and exports over the relations: joins, aggregates and orders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import dates, text as T


def unified(ledger: DataFrame, *relations: DataFrame, key: str = "tender_id") -> DataFrame:
    """JOI-01, NRM-30, R18: the ledger with one-to-one relations; of columns that several have, the first value there is."""
    out = ledger
    for r in relations:
        twice = [c for c in r.columns if c in out.columns and c != key]
        side = r.select(key, *[F.col(c).alias(f"_r_{c}" if c in twice else c) for c in r.columns if c != key])
        out = out.join(side, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in twice}).drop(*[f"_r_{c}" for c in twice])
    return out


def keyset_page(df: DataFrame, score: str, key: str, size: int, after: tuple[float, object] | None = None) -> DataFrame:
    """SRT-02: rows after a cursor, by score from the top, then key. A missing score is 0, in order and cursor alike."""
    s = F.coalesce(F.col(score), F.lit(0))
    out = df if after is None else df.where((s < after[0]) | ((s == after[0]) & (F.col(key) > after[1])))
    return out.orderBy(s.desc(), key).limit(size)


def next_cursor(page: DataFrame, score: str, key: str, size: int) -> tuple | None:
    """The cursor of a full page, else none. A page of over size rows has none either; no more than these are fetched."""
    rows = page.select(F.coalesce(F.col(score), F.lit(0)), key).limit(size + 1).collect()
    return tuple(min(rows, key=lambda r: (r[0], [-r[1]] if isinstance(r[1], int) else r[1]))) if len(rows) == size else None


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """SRT-01: order has to end with a unique key."""
    return df.orderBy(*order).offset(page * size).limit(size)


def custom_rank(c: str, order: Sequence[str]) -> Column:
    """SRT-03, SRT-06, SRT-12: place in a list, 0 for what isn't in it."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(c))


def portal_breakdown(df: DataFrame, portal: str, score: str, day: str, as_of: Column) -> DataFrame:
    """AGG-01, AGG-03, AGG-29, AGG-30: rows, recent rows, average and best score by portal; zero scores don't count in the average."""
    return df.groupBy(portal).agg(F.count("*").alias("n"), F.count_if(F.datediff(as_of, F.col(day)) <= 7).alias("n_week"), T.half_even(F.avg(F.nullif(F.col(score), F.lit(0))), 2).alias("avg_score"), F.max(score).alias("max_score"))


def totals(df: DataFrame, portal: str, score: str, high: float = 75) -> DataFrame:
    """AGG-02, AGG-05, AGG-31, AGG-40: totals in one row and one pass."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(score) >= high).alias("n_high"), F.countDistinct(portal).alias("n_portals"), F.max(score).alias("best"))


def value_counts(df: DataFrame, c: str, top: int) -> DataFrame:
    """AGG-07, AGG-35, AGG-38, SUB-24: the most frequent values, by name where they tie."""
    return df.where(T.clean_or_null(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(top)


def split_counts(df: DataFrame, c: str, separators: str = "[,;]") -> DataFrame:
    """AGG-32: counts of parts of a list in text."""
    parts = df.select(F.explode(F.split(F.coalesce(c, F.lit("")), separators)).alias("part"))
    return parts.select(F.trim("part").alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def deadline_breakdown(df: DataFrame, deadline: str, tier: str, as_of: Column) -> DataFrame:
    """AGG-08: rows by bucket and tier, with a total by rollup (null tier) and of all (null bucket)."""
    return df.withColumn("bucket", dates.deadline_bucket(deadline, as_of)).rollup("bucket", tier).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, portal: str, columns: Sequence[str]) -> DataFrame:
    """AGG-09, AGG-13: share of filled columns by portal, in percent."""
    return df.groupBy(portal).agg(F.count("*").alias("n"), *[T.half_even(F.avg(T.clean_or_null(c).isNotNull().cast("double")) * 100, 1).alias(f"{c}_percent") for c in columns])


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """AGG-11, AGG-36: counts of what holds and their shares of all, in one pass."""
    return df.agg(F.count("*").alias("n"), *[x for k, c in checks.items() for x in (F.count_if(c).alias(k), T.half_even(T.safe_ratio(F.count_if(c), F.count("*"), 0.0) * 100, 1).alias(f"{k}_percent"))])


def document_quality(df: DataFrame, links: str, by: str | None = None) -> DataFrame:
    """AGG-12, AGG-13: links, extracted ones and their characters, of all or by source."""
    x = F.coalesce(links, F.array().cast("array<struct<url:string,label:string,file_type:string,extracted:boolean,char_count:int>>"))
    aggs = [F.count("*").alias("n"), F.sum(F.size(x)).alias("n_links"), F.sum(F.size(F.filter(x, lambda i: i["extracted"]))).alias("n_extracted"), F.sum(F.aggregate(x, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(i["char_count"], F.lit(0)))).alias("n_chars")]
    return (df.groupBy(by) if by else df).agg(*aggs)


def readiness(health: DataFrame, cover: DataFrame, column: str, least: float = 50) -> DataFrame:
    """AGG-14, AGG-15, JOI-20, SUB-20: blocked, attention or ready by health and coverage; whole lists join before any limit."""
    state = F.when(F.col("state") == "unstable", "blocked").when(F.coalesce(column, F.lit(0.0)) < least, "attention").otherwise("ready")
    return health.join(cover, "source", "left").withColumn("readiness", state)


def export_totals(df: DataFrame, portal: str, is_new: Column) -> DataFrame:
    """AGG-27, DQ-06: rows and new rows by portal, and of all (null portal), by rollup."""
    return df.rollup(portal).agg(F.count("*").alias("n"), F.count_if(is_new).alias("n_new"))


def distribution(df: DataFrame, label: str, group: str) -> DataFrame:
    """AGG-28, AGG-39: counts by label and group with all totals, by cube."""
    return df.cube(label, group).agg(F.count("*").alias("n"))


def urgency(df: DataFrame, deadline: str, as_of: Column) -> DataFrame:
    """AGG-33, AGG-34: live rows by band of days left."""
    band = dates.bands(dates.days_until(deadline, as_of), [(3, "3 days"), (7, "week"), (14, "two weeks"), (30, "month")], "later")
    return df.withColumn("band", band).where("band <> 'expired'").groupBy("band").agg(F.count("*").alias("n"))


def status_sheets(df: DataFrame, deadline: str, as_of: Column, near: int = 7) -> dict[str, DataFrame]:
    """SUB-23: live, closing and expired rows, each in its order."""
    d = dates.days_until(deadline, as_of)
    return {"live": df.where(d >= 0).orderBy(deadline), "closing": df.where(d.between(0, near)).orderBy(deadline), "expired": df.where(d < 0).orderBy(F.desc(deadline))}


def cross_source_text(df: DataFrame, extra: DataFrame, key: str, source: str) -> DataFrame:
    """JOI-12: rows with their other sources as sorted distinct text."""
    names = extra.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ", ").alias("other_sources"))
    return df.join(names, key, "left")


def lookup(normalised: DataFrame, ledger: DataFrame, key: str, value: object) -> DataFrame:
    """LKP-01 to LKP-05: one record: the normalised row, else the ledger's."""
    both = normalised.where(F.col(key) == value).withColumn("_r", F.lit(0)).unionByName(ledger.where(F.col(key) == value).withColumn("_r", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("_r").limit(1).drop("_r")


def unscored(ledger: DataFrame, scored: DataFrame, key: str, score: str, title: str) -> DataFrame:
    """LKP-10, LKP-11, SRT-09: titled rows that have no score yet, those without a row first."""
    j = ledger.join(scored.select(key, F.col(score).alias("_s")), key, "left").where((F.coalesce("_s", F.lit(0)) == 0) & T.clean_or_null(title).isNotNull())
    return j.orderBy(F.col("_s").isNotNull(), key).drop("_s")


def day(text: str) -> Column:
    return F.lit(date.fromisoformat(text))
