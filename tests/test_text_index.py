"""The inverted index against plain searches of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import text_index

WORDS = ["roads", "road", "water", "waterway", "r2", "health", "heal", "Über", "x", "audit"]


def tokens(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return {f"d{i}": None if i % 17 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(7))) for i in range(300)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, t string").repartition(4)


def plain_prefix(texts, query):
    asked = tokens(query)
    return {i for i, t in texts.items() if asked and all(any(w.startswith(a) for w in tokens(t)) for a in asked)}


def plain_ranked(texts, queries, k):
    out = set()
    for q, text in queries:
        asked = tokens(text)
        scored = sorted((-len(asked & tokens(t)) / len(asked), i) for i, t in texts.items() if asked & tokens(t)) if asked else []
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:k])}
    return out


QUERIES = [(1, "road wat"), (2, "HEAL x"), (3, ""), (4, None), (5, "waterways"), (6, "r r2 audit audit")]


@pytest.mark.parametrize("bits", [16, 2])
def test_searches(spark, texts, monkeypatch, bits):
    monkeypatch.setattr(text_index, "RUN_BITS", bits)  # postings in many rows
    monkeypatch.setattr(text_index, "LONGEST", 3)
    index = text_index.segment(frame(spark, texts), "id", F.col("t"))
    for _, q in QUERIES:
        assert {r.id for r in text_index.prefix_search(index, q or "").collect()} == plain_prefix(texts, q)
    asked = spark.createDataFrame(QUERIES, "q int, text string")
    assert {(r.query_id, r.id) for r in text_index.prefix_searches(index, asked, "q", F.col("text")).collect()} == {(q, i) for q, t in QUERIES for i in plain_prefix(texts, t)}
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in text_index.ranked(index, asked, "q", F.col("text"), 7).collect()} == plain_ranked(texts, QUERIES, 7)


def test_segments_hide_and_merge(spark, texts):
    more = {"d1": "quite new roads", "d2": None, "d999": "roads x"}
    index = text_index.stacked([text_index.segment(frame(spark, texts), "id", F.col("t")), text_index.segment(frame(spark, more), "id", F.col("t"), 1), text_index.segment(frame(spark, {"d1": "newest"}), "id", F.col("t"), 2)])
    now = texts | more | {"d1": "newest"}
    whole = text_index.merged(index)
    asked = spark.createDataFrame(QUERIES, "q int, text string")
    for x in (index, whole):
        assert {r.id for r in text_index.prefix_search(x, "road").collect()} == plain_prefix(now, "road")
        assert {r.id for r in text_index.prefix_search(x, "new").collect()} == {"d1"}
        assert {(r.query_id, r.id, r.score, r["rank"]) for r in text_index.ranked(x, asked, "q", F.col("text"), 5).collect()} == plain_ranked(now, QUERIES, 5)
    terms = [r.term for r in whole.postings.select("term").distinct().collect()]
    assert "quite" not in terms and whole.docs.count() == len(now)


def test_prefixes_reach_the_files(spark, texts):
    index = text_index.segment(frame(spark, texts), "id", F.col("t"))
    plan = index.postings.where(text_index.starting_with(["road"]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,road)" in plan and "LessThan(term,roae)" in plan


def test_nothing_indexed(spark):
    index = text_index.segment(frame(spark, {"a": "x"}).where("false"), "id", F.col("t"))
    assert text_index.prefix_search(index, "x").count() == 0
    assert text_index.ranked(index, spark.createDataFrame(QUERIES, "q int, text string"), "q", F.col("text")).count() == 0


def test_ranked_counts_one_query_at_a_time(spark):
    """A task's Python holds counts of one query, not of all: 60 queries over 20,000 documents that all have their words."""
    docs = spark.range(20_000).repartition(1).select("id", F.lit("roads water").alias("t"))
    index = text_index.segment(docs, "id", F.col("t"))
    got = text_index.ranked(index, spark.createDataFrame([(q, "water roads x") for q in range(60)], "q int, text string"), "q", F.col("text"), 3).collect()
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == {(q, i, 0.666667, i + 1) for q in range(60) for i in range(3)}


def test_found_postings_are_dealt_by_their_numbers(spark, texts, monkeypatch):
    """Few rows of postings with many numbers are not one task, and a task sees all tokens of its documents."""
    monkeypatch.setattr(text_index, "TASK_NUMBERS", 20)
    monkeypatch.setattr(text_index, "RUN_BITS", 4)
    index = text_index.segment(frame(spark, texts), "id", F.col("t"))
    assert text_index._dealt(index.postings, "run").rdd.getNumPartitions() > 10
    assert {r.id for r in text_index.prefix_search(index, "road wat").collect()} == plain_prefix(texts, "road wat")
    asked = spark.createDataFrame(QUERIES, "q int, text string")
    assert {(r.query_id, r.id) for r in text_index.prefix_searches(index, asked, "q", F.col("text")).collect()} == {(q, i) for q, t in QUERIES for i in plain_prefix(texts, t)}
