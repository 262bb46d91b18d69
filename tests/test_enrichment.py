"""Fusion of candidate values against a plain choice; what records take."""

import datetime as dt
import random

from pyspark.sql import functions as F

from noticeflow.operators import enrichment as en

CANDIDATES = "key long, field string, value string, origin string, confidence double, seen timestamp"


def plain_best(rows):
    rank = {c: -i for i, c in enumerate(en.CLASSES)}
    best, n = {}, {}
    for key, field, value, origin, confidence, seen in rows:
        order = (rank.get(origin, -9), confidence, seen is not None, seen or dt.datetime.min, len(value), value)
        n[key, field] = n.get((key, field), 0) + 1
        if (key, field) not in best or order > best[key, field][0]:
            best[key, field] = (order, (value, origin, confidence))
    return {(*k, *v[1], n[k]) for k, v in best.items()}


def made(rng, n):
    days = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)]
    return [(rng.randrange(6), rng.choice("ab"), "v" * rng.randrange(1, 4) + rng.choice("xy"), rng.choice([*en.CLASSES, "odd"]), rng.choice([0.2, 0.5]), rng.choice(days)) for _ in range(n)]


def test_fuse_is_a_merge(spark):
    rows = made(random.Random(1), 200)
    df = spark.createDataFrame(rows, CANDIDATES).repartition(5)
    show = lambda x: {(r.key, r.field, r.value, r.origin, r.confidence, r.n) for r in x.collect()}
    assert show(en.fuse(df)) == plain_best(rows)
    halves = [en.fuse(spark.createDataFrame(part, CANDIDATES)) for part in (rows[:50], rows[50:120])]
    assert show(en.fuse(*halves, spark.createDataFrame(rows[120:], CANDIDATES))) == plain_best(rows)


def test_candidates(spark):
    texts = spark.createDataFrame([(1, "<h1> A &amp; B </h1>\nBudget: 5 lakh  Place: Rome\nContact: n/a"), (2, None), (3, "Place : Oslo")], "id long, t string")
    rules = [en.Rule("title", "detail", ["<h2>([^<]*)", "<h1>([^<]*)"], 0.9), *en.labelled({"budget": ["Budget", "Cost"], "place": ["Place"], "contact": ["Contact"]}, ["Place", "Budget", "Contact"], "file")]
    got = {(r.key, r.field, r.value, r.origin, r.confidence) for r in en.candidates(texts, rules, "id", "t").collect()}
    assert got == {(1, "title", "A & B", "detail", 0.9), (1, "budget", "5 lakh", "file", 0.8), (1, "place", "Rome", "file", 0.8), (3, "place", "Oslo", "file", 0.8)}


def test_applied(spark):
    records = spark.createDataFrame([(1, "own", None, "k1"), (2, "N/A", "old", "k2"), (3, None, None, "k3")], "id long, title string, place string, other string")
    found = spark.createDataFrame([(1, "title", "new", "detail", 0.9, None), (1, "place", "Rome", "listing", 0.3, None), (2, "title", "new", "file", 0.9, None), (2, "place", "Oslo", "detail", 0.7, None), (2, "extra", "e", "derived", 0.1, None), (9, "title", "nobody's", "detail", 1.0, None)], CANDIDATES)
    fused = en.fuse(found)
    out = en.applied(records, fused, "id", ["title", "place", "extra"], {"place": 0.5})
    got = {r.id: (r.title, r.place, r.extra, r.other, r.origins, r.n_filled) for r in out.collect()}
    assert got == {
        1: ("own", "Rome", None, "k1", {"title": "record", "place": "listing"}, 1),
        2: ("new", "Oslo", "e", "k2", {"title": "file", "place": "detail", "extra": "derived"}, 3),
        3: (None, None, None, "k3", {}, 0),
    }
    assert [r.id for r in en.backfill(records, fused, "id", ["title", "place"], 2, own_confidence={"place": 0.5}).collect()] == [2]
    assert {(r.field, r.origin, r.n) for r in en.origin_counts(out).collect()} == {("title", "record", 1), ("title", "file", 1), ("place", "listing", 1), ("place", "detail", 1), ("extra", "derived", 1)}


def test_nothing_found(spark):
    records = spark.createDataFrame([(1, None)], "id long, title string")
    none = en.fuse(spark.createDataFrame([], CANDIDATES))
    r = en.applied(records, none, "id", ["title"]).select("id", "title", "n_filled", F.size("origins").alias("n")).first()
    assert tuple(r) == (1, None, 0, 0)
