"""UPS, CDC, RPR: keyed state in batch form: upserts, change classes, amendments, repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators.classify import first_match


def _whole(df: DataFrame, columns: Sequence[str]) -> Column:
    """A whole row as something that has an order."""
    kinds = dict(df.dtypes)
    row = F.struct(*columns)
    return F.to_json(row) if any("map<" in kinds[c] for c in columns) else row


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """UPS-01, SNK-01, SNK-02, SUB-12, VEC-03: the newest row per key; a new row wins a tie, of several such the greatest. Keys are not null.

    One aggregation over both, with map-side combining; no row waits for its key's others.
    """
    columns = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new", _whole(both, rest))).alias("_x"))
    return best.select(*keys, "_x.*").select(*columns)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """UPS-02, SNK-03, JOI-09, SUB-07: rows to append: new keys, the first of each by order, then by the whole row."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, _whole(new, rest))).alias("_x")).select(*keys, "_x.*").select(*new.columns)
    return first.join(stored.select(*keys), list(keys), "left_anti")


def fill_nulls(stored: DataFrame, given: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """UPS-04: given values where stored ones are null."""
    g = given.groupBy(key).agg(*[F.max(c).alias(f"_g_{c}") for c in columns])
    return stored.join(g, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_g_{c}")) for c in columns}).drop(*[f"_g_{c}" for c in columns])


def match_signals(stored: DataFrame, new: DataFrame) -> DataFrame:
    """JOI-24, UPS-05: new (signal_uid, url_hash, title_hash, content_hash) with matched_uid: by uid, else URL hash, else both other hashes.

    Three equi-joins, each on a side with one row a key; an OR would be a nested loop.
    """
    by_url = stored.groupBy("url_hash").agg(F.min("signal_uid").alias("_u"))
    by_text = stored.groupBy("content_hash", "title_hash").agg(F.min("signal_uid").alias("_t"))
    uid = stored.select("signal_uid", F.col("signal_uid").alias("_i")).distinct()
    out = new.join(uid, "signal_uid", "left").join(by_url, "url_hash", "left").join(by_text, ["content_hash", "title_hash"], "left")
    return out.withColumn("matched_uid", F.coalesce("_i", "_u", "_t")).drop("_i", "_u", "_t")


def fingerprint(*columns: str, description: str, width: int = 500) -> Column:
    """CDC-02: md5 of fields, the description cut."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.substring(F.coalesce(description, F.lit("")), 1, width)))


def changes(before: DataFrame, after: DataFrame, key: str, score: str, stage: str, content: str, jump: float = 12) -> DataFrame:
    """CDC-01, CDC-05: key, change (new, upgraded, content, stage, same, gone), old_score, new_score and alert (0 to 3)."""
    a = before.select(key, F.col(score).alias("old_score"), F.col(stage).alias("_os"), F.col(content).alias("_oc"), F.lit(True).alias("_a"))
    b = after.select(key, F.col(score).alias("new_score"), F.col(stage).alias("_ns"), F.col(content).alias("_nc"), F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    change = first_match([(F.col("_a").isNull(), "new"), (F.col("_b").isNull(), "gone"), (F.col("new_score") - F.col("old_score") >= jump, "upgraded"), (~F.col("_os").eqNullSafe(F.col("_ns")), "stage"), (~F.col("_oc").eqNullSafe(F.col("_nc")), "content")], "same")
    alert = first_match([(F.col("change") == "new", 3), (F.col("change") == "upgraded", 2), (F.col("change").isin("stage", "content"), 1)], 0)
    return j.withColumn("change", change).withColumn("alert", alert).select(key, "change", "alert", "old_score", "new_score")


def amendments(versions: DataFrame, key: str, at: Sequence[str], content: str) -> DataFrame:
    """CDC-03: versions and amendments of each key: a content hash that differs from the one before, which isn't blank."""
    w = W.partitionBy(key).orderBy(*at)
    old = F.lag(content).over(w)
    changed = versions.withColumn("_c", F.coalesce((old != F.col(content)) & (old != ""), F.lit(False)))
    return changed.groupBy(key).agg(F.count("*").alias("n_versions"), F.count_if("_c").alias("n_amendments"))


def pending_alerts(rows: DataFrame, sent: DataFrame, key: str, score: str, least: float = 50) -> DataFrame:
    """CDC-04, STM-03: rows to alert about that were not alerted about yet."""
    return rows.where(F.col(score) >= least).join(sent.select(key).distinct(), key, "left_anti")


def missing(ledger: DataFrame, normalised: DataFrame, key: str) -> DataFrame:
    """JOI-07, JOI-08, RPR-01, RPR-02, SNK-13: ledger rows without a normalised row, in one pass."""
    return ledger.join(normalised.select(key).distinct(), key, "left_anti")


def lineage_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JOI-10: one row: keys only in a, only in b, in both."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def mark_first_extracted(links: Column, chars: Column) -> Column:
    """RPR-03: the first link as extracted, with its length, where none is."""
    none = ~F.exists(links, lambda x: x["extracted"])
    first = lambda x, i: F.when(i == 0, F.struct(x["url"].alias("url"), x["label"].alias("label"), x["file_type"].alias("file_type"), F.lit(True).alias("extracted"), chars.cast("int").alias("char_count"))).otherwise(x)
    return F.when(none, F.transform(links, first)).otherwise(links)


def save_counts(rows: DataFrame, ok: Column) -> DataFrame:
    """SNK-12: saved, failed and total, in one row."""
    return rows.agg(F.count_if(ok).alias("saved"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), F.count("*").alias("total"))


def semi_by_either(df: DataFrame, ids: DataFrame, urls: DataFrame) -> DataFrame:
    """JOI-13, LKP-08: rows whose id or URL is asked for: two semi joins and a union, not an OR."""
    by_id = df.join(ids, "tender_id", "left_semi")
    return by_id.unionByName(df.join(urls, "url", "left_semi").join(ids, "tender_id", "left_anti"))


def by_url(df: DataFrame, asked: DataFrame) -> DataFrame:
    """JOI-14, JOI-19: asked URLs with tender_id: the exact URL's, else that without slashes at the end."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    exact = df.groupBy("url").agg(F.min("tender_id").alias("_e"))
    loose = df.groupBy(bare(F.col("url")).alias("_bare")).agg(F.min("tender_id").alias("_l"))
    return asked.withColumn("_bare", bare(F.col("url"))).join(exact, "url", "left").join(loose, "_bare", "left").select("url", F.coalesce("_e", "_l").alias("tender_id"))


def carry_over(current: DataFrame, previous: DataFrame, source: str, key: str) -> DataFrame:
    """JOI-18, SET-07: the current export, and previous rows of sources that did not run with keys that it lacks."""
    old = previous.join(current.select(source).distinct(), source, "left_anti").join(current.select(key).distinct(), key, "left_anti")
    return current.unionByName(old, allowMissingColumns=True)


def unique_fields(*columns: str) -> Column:
    """SUB-06: a map of the fields that are not missing."""
    return F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: T.clean_or_null(v).isNotNull())
