"""Cross-site boilerplate lines.

A line's spread is the number of distinct sites that have it. One aggregation merges a HyperLogLog sketch
of sites for each line hash; lines whose estimate is near the threshold, as near as
the sketch's error allows a wrong verdict, get an exact distinct count. Lines of a spread from
the threshold on go, but for their first place, so that a document which many sites copied is not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import Scratch, join_by_hot_key

#: Sites from which on a line is boilerplate, and the sketch's size (2^11 slots; its relative standard error is below 2.3 %).
MIN_SITES, SKETCH_BITS, SKETCH_ERROR = 8, 11, 0.023

_BLANK = " \t\x0b\x0c\r"


def _line(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANK))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with text_col without its boilerplate lines, and n_lines, n_removed.

    Lines are parted by newlines and compared without blanks at their ends; blank lines stay. A line is
    boilerplate from min_sites distinct sites on (a null site is one more site); its first place, by id, text hash and
    line number, nulls first, keeps it. A null text stays null and has no lines. Rows that agree in id and text
    are treated alike. Columns of docs keep their names and order; one that is called n_lines or n_removed is replaced.
    """
    scratch = Scratch(spark, "lines")
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("_site"), F.posexplode(F.split(text_col, "\n", -1)).alias("_at", "_text"))
    rows = rows.withColumn("_text", _line(F.col("_text"))).where("_text <> ''")
    lines = scratch.cut(rows.select("_id", "_mark", "_site", "_at", F.xxhash64("_text").alias("_k1"), F.xxhash64(F.lit(7), "_text").alias("_k2")), "lines")
    first = F.min(F.struct("_id", "_mark", "_at")).alias("first")
    merged = lines.groupBy("_k1", "_k2").agg(F.hll_sketch_agg("_site", SKETCH_BITS).alias("sketch"), F.count("*").alias("n"), first)
    margin = 1 + 4 * SKETCH_ERROR * min_sites
    low, high = min_sites - margin, min_sites + margin
    spread = scratch.cut(merged.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("sites") >= low), "spread")
    total = lines.count()
    near = spread.where(F.col("sites") <= high).select("_k1", "_k2", "n")
    exact = join_by_hot_key(lines.select("_k1", "_k2", "_site"), near, ["_k1", "_k2"], "n", total).select("_k1", "_k2", "_site").distinct().groupBy("_k1", "_k2").agg(F.count("*").alias("exact"))
    boiler = scratch.cut(spread.join(exact, ["_k1", "_k2"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("_k1", "_k2", "n", "first"), "boilerplate")
    hit = join_by_hot_key(lines.select("_id", "_mark", "_at", "_k1", "_k2"), boiler, ["_k1", "_k2"], "n", total)
    gone = hit.where(~F.struct("_id", "_mark", "_at").eqNullSafe(F.col("first"))).groupBy(F.col("_id").alias("_i"), F.col("_mark").alias("_m")).agg(F.collect_set("_at").alias("_gone"))
    out = docs.drop("n_lines", "n_removed")
    whole = out.withColumn("_mark", mark).join(gone, out[id_col].eqNullSafe(gone["_i"]) & (F.col("_mark") == gone["_m"]), "left")
    whole = whole.withColumn("_parts", F.split(text_col, "\n", -1))  # once a text; within a lambda it would be once a line
    parts = F.col("_parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")  # by a hash set, so in time linear in the lines
    kept = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return whole.select(*[kept.alias(c) if c == text_col else F.col(c) for c in out.columns], F.coalesce(F.greatest(F.size(parts), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.greatest(F.size("_gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
