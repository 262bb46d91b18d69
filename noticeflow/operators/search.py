"""RET: filters from a question, candidates, a composite score, relaxation and evaluation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.functions.vocab import Vocabulary, matching_groups

#: Share of each part of the composite score.
WEIGHTS = {"similarity": 0.40, "priority": 0.25, "fit": 0.20, "lexical": 0.15}


def extract_filters(query: Column, sectors: Vocabulary, regions: Vocabulary, portals: dict[str, str]) -> Column:
    """RET-01, SUB-17, SUB-18: what a question asks for: sectors, regions, portals, high_priority, closing_soon, strict, days, limit."""
    q = F.lower(query)
    limit = F.regexp_extract(q, r"\b(?:top|first|show)\s+(\d{1,3})\b", 1).try_cast("int")
    days = F.regexp_extract(q, r"\b(?:last|past)\s+(\d{1,3})\s+days?\b", 1).try_cast("int")
    named = F.array_distinct(F.filter(F.array(*[F.when(T.has_word(q, [k]), v) for k, v in portals.items()]), lambda x: x.isNotNull())) if portals else F.array().cast("array<string>")
    return F.struct(
        matching_groups(q, sectors).alias("sectors"),
        matching_groups(q, regions).alias("regions"),
        named.alias("portals"),
        T.has_word(q, ["high priority", "best", "top"]).alias("high_priority"),
        T.has_word(q, ["closing soon", "urgent", "this week"]).alias("closing_soon"),
        T.has_word(q, ["only", "strictly"]).alias("strict"),
        days.alias("days"),
        F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(limit, F.lit(20)))).alias("limit"),
    )


def lexical_score(query_tokens: Column, text_tokens: Column) -> Column:
    """RET-04: share of the query's tokens that the text has."""
    return T.safe_ratio(F.size(F.array_intersect(query_tokens, text_tokens)), F.size(query_tokens), 0.0)


def similarity_floor(specific: Column) -> Column:
    """RET-05"""
    return F.when(specific, 0.25).otherwise(0.15)


def composite(similarity: Column, priority: Column, fit: Column, lexical: Column, boosts: Sequence[tuple[Column, float]] = (), digits: int | None = 3) -> Column:
    """RET-06: weighted parts (priority and fit in percent) with boosts and penalties, 1 at most; not rounded where digits is None."""
    base = WEIGHTS["similarity"] * similarity + WEIGHTS["priority"] * priority / 100 + WEIGHTS["fit"] * fit / 100 + WEIGHTS["lexical"] * lexical
    total = sum((F.coalesce(c.cast("int"), F.lit(0)) * F.lit(v) for c, v in boosts), base)
    most = F.least(F.lit(1.0), total)
    return most if digits is None else F.bround(most, digits)


def hard_drop(high_asked: Column, priority: Column, seen: Column, cutoff: Column, portal_ok: Column, similarity: Column, floor: Column) -> Column:
    """RET-07: whether a candidate goes."""
    return (high_asked & (priority < 50)) | F.coalesce(seen < cutoff, F.lit(False)) | ~portal_ok | (similarity < floor)


def candidates(limit: int, with_portal: bool) -> int:
    """RET-08"""
    return min(200, 10 * limit) if with_portal else min(60, 3 * limit)


def best_of_each(df: DataFrame, query: str, order: Sequence[Column], limit: int) -> DataFrame:
    """RET-06: the first rows of each query in an order, with their rank; no more of a query than that leave a task."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def relaxed(df: DataFrame, steps: Sequence[Column], key: str, limit: int, order: Sequence[Column]) -> DataFrame:
    """RET-09: rows of the first of steps (predicates, from strict to loose) that any row meets, with that step's number.

    One pass: each row has its first step, and the least step of all rows wins.
    """
    step = F.coalesce(*[F.when(c, i) for i, c in enumerate(steps)])
    marked = df.withColumn("step", step).where("step IS NOT NULL")
    least = marked.agg(F.min("step").alias("_least"))
    chosen = marked.join(F.broadcast(least), F.col("step") <= F.col("_least")).drop("_least")  # one row
    return chosen.orderBy(*order, key).limit(limit)


def supplement(found: DataFrame, more: DataFrame, key: str, limit: int, score: str) -> DataFrame:
    """RET-10: found rows, then unseen ones of more, up to limit."""
    extra = more.join(found.select(key), key, "left_anti")
    both = found.withColumn("_r", F.lit(0)).unionByName(extra.withColumn("_r", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("_r", F.desc(score), key).limit(limit).drop("_r")


def prefix_match(query: str, text: Column) -> Column:
    """RET-11: every token of the query starts a token of the text."""
    asked = re.findall(r"[a-z0-9]+", query.lower())
    own = T.tokens(text)
    return F.forall(F.array(*map(F.lit, asked)), lambda t: F.exists(own, lambda w: w.startswith(t))) if asked else F.lit(False)


@dataclass(frozen=True)
class Facets:
    """RET-12: what a listing may be filtered by; empty means any."""

    sectors: tuple[str, ...] = ()
    services: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    least_score: float | None = None
    live_only: bool = True
    unique_only: bool = True
    sort: str = "priority_score"
    page: int = 0
    size: int = 20


SORTS = ("priority_score", "relevance_score", "deadline", "date_first_seen")


def faceted(df: DataFrame, f: Facets, key: str = "tender_id") -> DataFrame:
    """RET-12, SRT-01: one page of df (sectors, services arrays; source_site, is_expired, is_duplicate, scores); a unique key breaks ties."""
    if f.sort not in SORTS:
        raise ValueError(f"sort is one of {SORTS}")
    out = df
    for c, names in (("sectors", f.sectors), ("services", f.services)):
        if names:
            out = out.where(F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, names))), F.lit(False)))
    if f.sources:
        out = out.where(F.col("source_site").isin(*f.sources))
    if f.least_score is not None:
        out = out.where(F.col("priority_score") >= f.least_score)
    if f.live_only:
        out = out.where(~F.coalesce("is_expired", F.lit(False)))
    if f.unique_only:
        out = out.where(~F.coalesce("is_duplicate", F.lit(False)))
    order = F.asc(f.sort) if f.sort == "deadline" else F.desc(f.sort)
    return out.orderBy(order, key).offset(f.page * f.size).limit(f.size)


def evaluate(results: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """RET-13: a score per case from results (case_id, rank, has_evidence, tokens, portal): 35 off for too few, 30 for no
    required token, 10 for each forbidden one, 20 for too few portal hits, 15 for too little evidence.

    cases: id, min_results, require_any, forbid (arrays), portals (array), min_portal_hits, min_evidence_ratio, pass_score.
    """
    top = results.where(F.col("rank") <= k)
    per = cases.join(top, F.col("id") == F.col("case_id"), "left").groupBy(*cases.columns).agg(
        F.count("case_id").alias("n"),
        F.max(F.coalesce(F.arrays_overlap("tokens", "require_any"), F.lit(False))).alias("required"),
        F.sum(F.size(F.array_intersect(F.coalesce("tokens", F.array().cast("array<string>")), "forbid"))).alias("n_forbidden"),
        F.count_if(F.array_contains("portals", F.col("portal"))).alias("n_portal"),
        F.avg(F.col("has_evidence").cast("double")).alias("evidence"),
    )
    off = F.when(F.col("n") < F.col("min_results"), 35).otherwise(0) + F.when((F.size("require_any") > 0) & ~F.col("required"), 30).otherwise(0) + 10 * F.coalesce("n_forbidden", F.lit(0)) + F.when(F.col("n_portal") < F.col("min_portal_hits"), 20).otherwise(0) + F.when(F.coalesce("evidence", F.lit(0.0)) < F.col("min_evidence_ratio"), 15).otherwise(0)
    score = F.greatest(F.lit(0), F.lit(100) - off)
    return per.select("id", score.alias("score"), (score >= F.col("pass_score")).alias("passed"))


def balanced(df: DataFrame, source: str, order: Sequence[Column], per_source: int = 3, cap: int | None = None) -> DataFrame:
    """WIN-02: at most so many rows a source, one of each in turn, the source with the best row first."""
    w = W.partitionBy(source).orderBy(*order)
    picked = df.withColumn("round", F.row_number().over(w)).where(F.col("round") <= per_source)
    out = picked.orderBy("round", *order)
    return out.limit(cap) if cap else out


def ranking_metrics(df: DataFrame, score: str, relevant: str, key: str, k: int) -> DataFrame:
    """WIN-04: precision, recall and nDCG at k, in one row. Only the best k by either order leave their partitions."""
    by_score = df.orderBy(F.desc(score), key).limit(k).select(F.col(relevant).cast("int").alias("rel"), score, key)
    top = by_score.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))
    ideal = df.select(F.col(relevant).cast("int").alias("rel")).orderBy(F.desc("rel")).limit(k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("rel"))))
    gain = F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0))
    all_ = df.agg(F.sum(F.col(relevant).cast("int")).alias("n_relevant"))
    one = top.agg(F.sum("rel").alias("hits"), gain.alias("dcg")).crossJoin(ideal.agg(gain.alias("idcg"))).crossJoin(all_)  # single rows
    return one.select(T.safe_ratio(F.col("hits"), F.lit(k), 0.0).alias("precision"), T.safe_ratio(F.col("hits"), F.col("n_relevant"), 0.0).alias("recall"), T.safe_ratio(F.col("dcg"), F.col("idcg"), 0.0).alias("ndcg"))
