"""GRD: whether an answer stands on its sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators.classify import by_table

#: Parts of a question that asks for facts, and claims with numbers (grouped numbers, percentages, currencies, spans of time).
FACT_WORDS = ("which", "what", "who", "when", "where", "deadline", "budget", "amount", "cost", "eligibility", "requirement", "documents", "give me", "list", "show", "top", "best")
NUMERIC = (r"(?i)\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b", r"(?i)\b\d+(?:\.\d+)?\s*%\b", r"(?i)\b(?:usd|inr|eur|rs\.?)\s*\d", r"(?i)\b\d+\s+(?:days|weeks|months|years)\b")

DEFAULT_ANSWER = "Insufficient grounded evidence to answer this."


def citations(raw: Column, n_sources: Column) -> Column:
    """GRD-01: struct(answer, citations): citations are whole, in range, distinct, in order; the default answer for bad JSON."""
    p = F.from_json(raw, "answer string, citations array<int>")
    kept = F.array_distinct(F.filter(p["citations"], lambda c: c.isNotNull() & (c >= 1) & (c <= n_sources)))
    return F.struct(F.coalesce(p["answer"], F.lit(DEFAULT_ANSWER)).alias("answer"), F.coalesce(kept, F.array().cast("array<int>")).alias("citations"))


def fact_query(query: Column, words: Sequence[str] = FACT_WORDS) -> Column:
    """GRD-02: whether the question has one of words, within others too."""
    return T.has_part(query, words)


def has_evidence(*texts: Column) -> Column:
    """GRD-03, SUB-25"""
    return T.any_of([T.clean_or_null(t).isNotNull() for t in texts])


def strong_retrieval(hits: Column) -> Column:
    """GRD-04: hits is an array of struct(similarity, composite)."""
    return F.coalesce(F.exists(hits, lambda h: (h["similarity"] >= 0.28) | (h["composite"] >= 0.34)), F.lit(False))


def portal_match(a: Column, b: Column) -> Column:
    """SUB-19: one contains the other, in any case."""
    x, y = F.lower(a), F.lower(b)
    return F.coalesce(x.contains(y) | y.contains(x), F.lit(False))


def cited_satisfy(cited: Column, portals: Column, strict: Column) -> Column:
    """GRD-05: cited portals are asked ones: all of them where strict, else any; no portals asked is satisfied."""
    ok = lambda c: F.exists(portals, lambda p: portal_match(c, p))
    return (F.size(portals) == 0) | F.when(strict, F.forall(cited, ok)).otherwise(F.exists(cited, ok))


def abstain(fact: Column, n_sources: Column, n_citations: Column, evidence: Column, satisfied: Column, answer: Column) -> Column:
    """GRD-06: a fact was asked for, and one thing that it needs is missing."""
    return fact & T.any_of([n_sources == 0, n_citations == 0, ~evidence, ~satisfied, T.clean_or_null(answer).isNull()])


def deterministic_answer(rows: Column) -> Column:
    """GRD-07: numbered lines from an array of struct(title, deadline, source)."""
    line = lambda r, i: F.concat_ws(" | ", F.concat((i + 1).cast("string"), F.lit(". "), r["title"]), F.concat(F.lit("deadline "), r["deadline"]), r["source"])
    return F.array_join(F.transform(rows, line), "\n")


def numeric_claim(answer: Column) -> Column:
    """GRD-08: whether an answer states numbers that need a citation."""
    return T.any_of([F.coalesce(answer, F.lit("")).rlike(p) for p in NUMERIC])


def grounded_facts(text: Column, hints: Sequence[str] = ("deadline", "closing", "due")) -> Column:
    """DOC-10: struct(budget, date): an amount, and a date where a hint word is near."""
    budget = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)((?:usd|eur|inr|rs\.?|\$|€)\s*[\d,.]+(?:\s*(?:million|mn|m|lakh|crore))?)", 1), F.lit(""))
    date = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.struct(budget.alias("budget"), F.when(T.has_word(text, hints), date).alias("date"))


def report(events: DataFrame) -> DataFrame:
    """AGG-22, AGG-26: one row of counts and shares over answer events (query, answer, abstained, n_sources, n_citations)."""
    fact, claim = fact_query(F.col("query")), numeric_claim(F.col("answer"))
    marked = events.select("*", fact.alias("fact"), claim.alias("claim"), (F.col("n_citations") > 0).alias("cited"))
    n = {"fact": F.col("fact"), "abstained": F.col("abstained"), "fact_answered": F.col("fact") & ~F.col("abstained"), "cited": F.col("cited"), "claim": F.col("claim"), "claim_uncited": F.col("claim") & ~F.col("cited")}
    counts = [F.count_if(c).alias(f"n_{k}") for k, c in n.items()]
    return marked.agg(F.count("*").alias("n"), *counts, T.half_even(T.safe_ratio(F.count_if(n["cited"]), F.count("*"), 0.0) * 100, 1).alias("cited_percent"), T.half_even(T.safe_ratio(F.count_if(n["claim_uncited"]), F.count_if(n["claim"]), 0.0) * 100, 1).alias("uncited_claim_percent"))


def ratings(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """AGG-23, JOI-21: answers by rating, null for none."""
    return events.join(feedback, "event_id", "left").groupBy("rating").agg(F.count("*").alias("n"))


def weak_query_types(events: DataFrame, feedback: DataFrame, top: int = 8) -> DataFrame:
    """AGG-24: query types of answers that were rated 2 or lower, or not at all."""
    return events.join(feedback, "event_id", "left").where("rating IS NULL OR rating <= 2").groupBy("query_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_type").limit(top)


def label_counts(feedback: DataFrame, top: int = 12) -> DataFrame:
    """AGG-04, AGG-25, JOI-22: counts of labels in arrays."""
    return feedback.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


def actions(labels: DataFrame, table: dict[str, str]) -> DataFrame:
    """GRD-10: what to do for each label that occurs."""
    return labels.select("label", by_table(F.col("label"), table).alias("action")).where("action IS NOT NULL")


def smoke_case(abstained: Column, expect_abstain: Column, n_sources: Column, min_sources: Column, portals: Column, expect_portal: Column) -> Column:
    """GRD-11: whether a case is as expected."""
    has_portal = expect_portal.isNull() | F.exists(portals, lambda p: portal_match(p, expect_portal))
    return (abstained == F.coalesce(expect_abstain, F.lit(False))) & (n_sources >= F.coalesce(min_sources, F.lit(0))) & has_portal
