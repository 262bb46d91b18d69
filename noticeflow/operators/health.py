"""HLT: how sources behave over their runs. Runs: source, run_at, status, row_count; SKIP marks runs that did not happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import text as T

#: Runs looked at, zero runs and success rate (with at least so many runs) at which a source is unstable, success rate where nothing is known.
LAST, ZERO_RUNS, LEAST_RATE, LEAST_RUNS, DEFAULT_RATE = 10, 5, 30.0, 3, 70.0


def _newest(key: str = "run_id") -> list[Column]:
    return [F.desc("run_at"), F.desc(key)]


def last_runs(runs: DataFrame, n: int = LAST, key: str = "run_id") -> DataFrame:
    """The n newest runs of each source, with their place at (1: newest). A unique key breaks ties."""
    return runs.withColumn("at", F.row_number().over(W.partitionBy("source").orderBy(*_newest(key)))).where(F.col("at") <= n)


def metrics(runs: DataFrame, n: int = LAST, key: str = "run_id", drop_skips: bool = True) -> DataFrame:
    """HLT-01, HLT-02, HLT-14: source, n_runs, success_rate, avg_rows, zero_streak, last_status, last_rows over the n newest runs.

    Skipped runs go after the n newest were taken, so ten of them leave none, which counts as 100 %.
    """
    own = last_runs(runs, n, key)
    sources = own.select("source").distinct()
    kept = own.where(F.col("status") != "SKIP") if drop_skips else own
    newest = W.partitionBy("source").orderBy("at")
    seen = kept.withColumn("_alive", F.sum((F.col("row_count") > 0).cast("int")).over(newest.rowsBetween(W.unboundedPreceding, 0)))
    per = seen.groupBy("source").agg(
        F.count("*").alias("n_runs"),
        T.half_even(F.avg((F.col("status") == "OK").cast("double")) * 100, 1).alias("success_rate"),
        T.half_even(F.avg("row_count"), 1).alias("avg_rows"),
        F.count_if(F.col("_alive") == 0).alias("zero_streak"),
        F.min_by("status", "at").alias("last_status"),
        F.min_by("row_count", "at").alias("last_rows"),
    )
    out = sources.join(per, "source", "left")
    return out.withColumns({"n_runs": F.coalesce("n_runs", F.lit(0)), "success_rate": F.coalesce("success_rate", F.lit(100.0)), "avg_rows": F.coalesce("avg_rows", F.lit(0.0)), "zero_streak": F.coalesce("zero_streak", F.lit(0))})


def stability(m: DataFrame) -> DataFrame:
    """HLT-06, HLT-10: m with unstable and state (stable, partial, unstable); a good latest run clears it."""
    good = F.coalesce((F.col("last_status") == "OK") & (F.col("last_rows") > 0), F.lit(False))
    bad = ((F.col("zero_streak") >= ZERO_RUNS) | ((F.col("success_rate") < LEAST_RATE) & (F.col("n_runs") >= LEAST_RUNS))) & ~good
    return m.withColumn("unstable", bad).withColumn("state", F.when(bad, "unstable").when(F.col("success_rate") < 80, "partial").otherwise("stable"))


def escalated(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """HLT-03, HLT-05: runs with prev_rows, and status FAIL for the third zero in a row, WARN for other zeros."""
    w = W.partitionBy("source").orderBy("run_at", key)
    one, two = F.lag("row_count", 1).over(w), F.lag("row_count", 2).over(w)
    level = F.when((F.col("row_count") == 0) & (one == 0) & (two == 0), "FAIL").when(F.col("row_count") == 0, "WARN").otherwise("OK")
    return runs.withColumn("prev_rows", one).withColumn("level", level)


def broken(runs: DataFrame, least: float, key: str = "run_id") -> DataFrame:
    """HLT-04, HLT-11: sources whose latest run found nothing though the nine before it averaged more than least."""
    w = W.partitionBy("source").orderBy(*_newest(key))
    out = runs.withColumn("at", F.row_number().over(w)).withColumn("avg_before", F.avg("row_count").over(w.rowsBetween(1, 9)))
    return out.where((F.col("at") == 1) & (F.col("row_count") == 0) & (F.col("avg_before") > least)).select("source", "row_count", T.half_even(F.col("avg_before"), 2).alias("avg_before"))


def structural_zero(runs: DataFrame, n: int = LAST, share: float = 0.6, key: str = "run_id") -> DataFrame:
    """HLT-07: source, retry: false where most of three runs or more found nothing."""
    per = last_runs(runs, n, key).groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("row_count") == 0).cast("double")).alias("zero_share"))
    return per.select("source", "zero_share", (~((F.col("n") >= LEAST_RUNS) & (F.col("zero_share") >= share))).alias("retry"))


def live_flags(flags: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """HLT-08, STM-04: flags that are not older than their time to live."""
    return flags.where(F.col("flagged_at") > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def with_fallback(metrics_new: DataFrame, metrics_old: DataFrame) -> DataFrame:
    """HLT-09, SET-02: metrics of the newer history, and of the older one for sources that the newer lacks."""
    return metrics_new.unionByName(metrics_old.join(metrics_new.select("source"), "source", "left_anti"), allowMissingColumns=True)


def bounded_history(history: DataFrame, n: int = 30) -> DataFrame:
    """HLT-12: the newest n days of each source, the last entry of each day."""
    days = history.groupBy("source", "date").agg(F.max_by(F.struct(*[c for c in history.columns if c not in ("source", "date")]), "seq").alias("x")).select("source", "date", "x.*")
    return days.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("date")))).where(F.col("_n") <= n).drop("_n")


def pass_rates(history: DataFrame, n: int) -> DataFrame:
    """HLT-13: the last n pass rates of each source, newest last."""
    own = history.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("date")))).where(F.col("_n") <= n)
    return own.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "pass_rate"))), lambda x: x["pass_rate"]).alias("pass_rates"))


def run_summary(runs: DataFrame) -> DataFrame:
    """AGG-10: runs by status, rounded averages and the last run of each source."""
    by = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("OK", "WARN", "FAIL")]
    return runs.groupBy("source").agg(F.count("*").alias("n_runs"), *by, T.half_even(F.avg("row_count"), 1).alias("avg_rows"), F.max("run_at").alias("last_run"))


def broken_list(current: DataFrame, m: DataFrame) -> DataFrame:
    """DQ-05: sources that warn now or have a zero streak, labelled by it."""
    label = F.when(F.col("zero_streak") >= ZERO_RUNS, "broken").when(F.col("zero_streak") >= 2, "failing").otherwise("warning")
    return m.join(current.select("source", F.lit(True).alias("warns")), "source", "left").where(F.coalesce("warns", F.lit(False)) | (F.col("zero_streak") >= 2)).select("source", "zero_streak", label.alias("label"))
