"""SRC: files of raw rows, one contract for all sources: source, and raw, a map of strings.

Fetching is somebody else's work; what a source's reader does to its rows (floors, unions, first of repeats) is here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(df: DataFrame, source: str) -> DataFrame:
    """df's columns as one map of strings."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.lit(source).alias("source"), F.create_map(*pairs).alias("raw"))


def json_api(spark: SparkSession, path: str, schema: str, source: str, floor: Column | None = None, key: str | None = None) -> DataFrame:
    """SRC-01, SRC-03 to SRC-05, SRC-21: pages of JSON records, from a date on, first of repeats."""
    df = spark.read.schema(schema).json(path)
    df = df.where(floor) if floor is not None else df
    return rows(df.dropDuplicates([key]) if key else df, source)


def union(frames: Sequence[DataFrame], key: str | None = None) -> DataFrame:
    """SRC-02, SRC-06, SRC-15, SRC-24, SET-01: rows of several reads, first of repeats of a raw field."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("_k", F.col("raw")[key]).dropDuplicates(["_k"]).drop("_k") if key else out


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07 to SRC-14, SRC-17 to SRC-23: pages, one a row: path and html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def table_rows(html: Column) -> Column:
    """SRC-09, SRC-10, SRC-14, SRC-15: cells of each row of the tables of a page, tags dropped."""
    trs = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")))
    return F.filter(F.transform(trs, cells), lambda r: F.size(r) > 0)


def fragments(json: Column) -> Column:
    """SRC-07: HTML that comes inside a JSON list of commands."""
    return F.array_join(F.transform(F.from_json(json, "array<struct<command:string,data:string>>"), lambda x: F.coalesce(x["data"], F.lit(""))), "")


def rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """SRC-16: items of a feed."""
    schema = "title string, link string, description string, pubDate string"
    return rows(spark.read.format("xml").option("rowTag", "item").schema(schema).load(path), source)


def embedded_json(html: Column, variable: str, schema: str) -> Column:
    """SRC-26: the array that a script assigns to a variable."""
    return F.from_json(F.regexp_extract(html, rf"(?s){variable}\s*=\s*(\[.*?\])\s*;", 1), schema)


def literal(spark: SparkSession, records: Sequence[dict[str, str]], source: str) -> DataFrame:
    """SRC-27: constant records."""
    return spark.createDataFrame([(source, r) for r in records], "source string, raw map<string,string>")


def sheet(spark: SparkSession, path: str, source: str) -> DataFrame:
    """SRC-29: a workbook sheet, saved as CSV with a header; blank rows go."""
    df = spark.read.csv(path, header=True)
    return rows(df.where(F.concat_ws("", *[F.trim(c) for c in df.columns]) != ""), source)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-30: a record a line; blank lines and comments go, a bad line fails the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def urls_in_record(json: Column) -> Column:
    """SRC-18: URLs anywhere in a nested record."""
    return F.array_distinct(F.regexp_extract_all(json, F.lit(r"(https?://[^\s\"'<>\\]+)"), F.lit(1)))


def with_detail(listing: DataFrame, detail: DataFrame, on: str = "url") -> DataFrame:
    """SRC-19, SRC-31: listing rows with what their detail page adds."""
    return listing.join(detail, on, "left")


def enabled(df: DataFrame, toggles: DataFrame) -> DataFrame:
    """SRC-33: rows of sources that are not switched off; those without a switch are on. Of several switches of one source any that is off counts."""
    switches = toggles.groupBy("source").agg(F.bool_and("enabled").alias("enabled"))
    return df.join(switches, "source", "left").where(F.coalesce("enabled", F.lit(True))).drop("enabled")


def sample(df: DataFrame, n: int) -> DataFrame:
    """DQ-03: n rows of a source, for a look at their shape."""
    return df.limit(n)


def jobs(spark: SparkSession, path: str, as_of: Column, stale_hours: int = 25) -> DataFrame:
    """DQ-07: state of each job from its log (job, ts, line): error words in the newest line, or stale."""
    log = spark.read.schema("job string, ts timestamp, line string").json(path)
    last = log.groupBy("job").agg(F.max("ts").alias("ts"), F.max_by("line", "ts").alias("line"))
    state = F.when(F.lower("line").rlike("error|traceback|failed"), "error").when(F.col("ts") < as_of - F.expr(f"INTERVAL {stale_hours} HOURS"), "stale").otherwise("ok")
    return last.withColumn("state", state)
