"""DOC-12, DOC-13, RPR-04, SRC-31: records enriched from stored pages and files.

Pages and files give candidates: a value for a field of a record, with the class of its origin and a confidence. Of a field's candidates the best one
stays, by class, confidence, age and length; that is an aggregate which merges, so sources may be fused apart and the results again. A record takes a
fused value where it has none of its own, or a less certain one, and keeps where each value is from. Only fetching is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as T

#: Columns of candidates and of fused values.
CANDIDATE = ("key", "field", "value", "origin", "confidence", "seen")

#: Classes of origins, the best first: a record's own detail page, an attached file, its line in a listing, and what is derived.
CLASSES = ("detail", "file", "listing", "derived")


@dataclass(frozen=True)
class Rule:
    """How a field is read from a text: the first group of the first pattern that matches; class of origin; confidence; shortest value."""

    field: str
    origin: str
    patterns: Sequence[str]
    confidence: float = 0.5
    least: int = 1


def candidates(texts: DataFrame, rules: Sequence[Rule], key: str, text: str, seen: str | None = None) -> DataFrame:
    """Candidates that rules find in each text; entities and white space are cleaned, missing words and short values are none. One pass over texts."""
    found = []
    for r in rules:
        value = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), p, 1), F.lit("")) for p in r.patterns])
        clean = T.clean_or_null(T.clean_text(value))
        found.append(F.when(F.length(clean) >= r.least, F.struct(F.lit(r.field).alias("field"), clean.alias("value"), F.lit(r.origin).alias("origin"), F.lit(float(r.confidence)).alias("confidence"))))
    when = F.col(seen).cast("timestamp") if seen else F.lit(None).cast("timestamp")
    each = texts.select(F.col(key).alias("key"), when.alias("seen"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return each.select("key", "x.field", "x.value", "x.origin", "x.confidence", "seen")


def fuse(*found: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """The best candidate of each key and field, and n, how many there were. What fuse returned may be fused again with more.

    Best: the better class (an unknown one comes last), then confidence, the later seen, the longer value, then the value itself. Map-side combining
    leaves one row a key and field of each task, so a key with very many candidates is no task of its own.
    """
    both = reduce(DataFrame.unionByName, [f if "n" in f.columns else f.withColumn("n", F.lit(1).cast("long")) for f in found])
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("origin"))
    rank = F.when(place > 0, -place).otherwise(-len(classes) - 1)
    order = F.struct(rank, "confidence", F.col("seen").isNotNull(), "seen", F.length("value"), "value")
    best = both.groupBy("key", "field").agg(F.max_by(F.struct("value", "origin", "confidence", "seen"), order).alias("x"), F.sum("n").alias("n"))
    return best.select("key", "field", "x.*", "n")


def applied(records: DataFrame, fused: DataFrame, key: str, fields: Sequence[str], own_confidence: Mapping[str, float] | None = None, own: str = "record") -> DataFrame:
    """records with fused values of fields, and origins (a map of field to class) and n_filled (how many fields a candidate filled).

    A field's own value stays if its confidence (own_confidence; 1 where not given) is no less than the candidate's. Records without candidates stay as they are.
    """
    sure = dict(own_confidence or {})
    one = fused.where(F.col("field").isin(*fields)).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "origin", "confidence")))).alias("_found"))
    out = records.join(one, F.col(key) == F.col("key"), "left").drop("key")
    new, origins, filled = {}, [], []
    for f in fields:
        found = F.try_element_at("_found", F.lit(f))
        mine = T.clean_or_null(f) if f in records.columns else F.lit(None).cast("string")
        takes = found.isNotNull() & (mine.isNull() | (found["confidence"] > sure.get(f, 1.0)))
        new[f] = F.when(takes, found["value"]).otherwise(mine)
        origins.append(F.struct(F.lit(f).alias("k"), F.when(takes, found["origin"]).when(mine.isNotNull(), own).alias("v")))
        filled.append(takes)
    made = F.map_from_entries(F.filter(F.array(*origins), lambda x: x["v"].isNotNull()))
    whole = out.withColumns({"_origins": made, "_filled": T.hits(filled)}).withColumns(new).drop("_found")
    return whole.withColumnsRenamed({"_origins": "origins", "_filled": "n_filled"})


def backfill(records: DataFrame, fused: DataFrame, key: str, fields: Sequence[str], least: int = 1, **how: Mapping[str, float]) -> DataFrame:
    """RPR-04: only records of which at least so many fields got a value: what a repair run writes."""
    return applied(records, fused, key, fields, **how).where(F.col("n_filled") >= least)


def labelled(labels: Mapping[str, Sequence[str]], stops: Sequence[str], origin: str = "detail", confidence: float = 0.8) -> list[Rule]:
    """SRC-31, DOC-11: rules for fields that stand between one of their labels and the next stop label or line."""
    import re

    end = "|".join(map(re.escape, stops))
    return [Rule(f, origin, [rf"(?is)\b{re.escape(x)}\s*:\s*(.*?)\s*(?=(?:{end})\s*:|\n|$)" for x in names], confidence) for f, names in labels.items()]


def origin_counts(enriched: DataFrame) -> DataFrame:
    """How many values of each field came from where: field, origin, n."""
    each: Column = F.explode(F.map_entries("origins")).alias("x")
    return enriched.select(each).groupBy(F.col("x.key").alias("field"), F.col("x.value").alias("origin")).agg(F.count("*").alias("n"))
