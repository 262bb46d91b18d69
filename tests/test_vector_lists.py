"""Inverted lists against all pairs."""

import random

import pytest

from noticeflow.operators import vector_lists, vectors

SF = "/root/testdata/sf0.01"


def answers(df):
    return sorted((r.query_id, r.rank, r.id, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(2)
    around = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in around[i % 30]]) for i in range(3000)] + [(5000, [0.0] * 12), (5001, None), (5002, [0.0] * 12)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).cache()


def test_exact_answers_are_those_of_all_pairs(clustered, monkeypatch):
    monkeypatch.setattr(vector_lists, "LIST_ROWS", 60)  # lists are split
    lists = vector_lists.build(clustered, n=20)
    assert lists.of.rows.sum() == 3002 and lists.of.parts.max() > 1
    asked = clustered.where("vec_id % 20 = 0 OR vec_id > 4000")
    assert answers(vector_lists.nearest(lists, asked, 10, probes=2)) == answers(vectors.nearest(clustered, asked, 10))


def test_recall_of_some_lists(spark, clustered):
    """The number of lists that is measured on a sample gives that recall over all queries."""
    for corpus, fewer in ((clustered, 0.2), (spark.read.parquet(f"{SF}/embeddings.parquet"), 0.9)):
        asked = corpus.where("vec_id % 20 = 0")
        want = {r[:1] + r[2:3] for r in answers(vectors.nearest(corpus, asked, 10))}
        lists = vector_lists.build(corpus)
        probes = vector_lists.probes_for(lists, asked, 10)
        assert probes <= fewer * len(lists.of.centres)
        got = {r[:1] + r[2:3] for r in answers(vector_lists.nearest(lists, asked, 10, exact=False))}
        assert len(got & want) >= 0.9 * len(want)


def test_bounds_hold(clustered):
    import numpy as np

    lists = vector_lists.build(clustered, n=15)
    rows = lists.table.collect()
    q = np.array([r["vector"] for r in rows[:50]])
    bound = lists.of.bounds(q)
    for r in rows:
        assert (q @ np.array(r["vector"]) <= bound[:, r["list"]] + 1e-9).all()


def test_from_a_similarity_on(clustered):
    asked = clustered.where("vec_id % 20 = 0")
    want = [r for r in answers(vectors.nearest(clustered, asked, 5)) if r[3] >= 0.9]
    assert answers(vector_lists.semantic_duplicates(clustered, asked, 0.9)) == want and want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert answers(vector_lists.nearest(vector_lists.build(none), none, 3)) == []
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], none.schema)
    assert answers(vector_lists.nearest(vector_lists.build(some), none, 3)) == []
    assert [r[2] for r in answers(vector_lists.nearest(vector_lists.build(some), some, 3))] == [2, 1]


def test_portfolio_is_what_all_pairs_give(spark, monkeypatch):
    """TF-IDF over one- and two-grams and cosines, worked out plainly."""
    import math
    import re
    from collections import Counter

    rng = random.Random(8)
    words = "water supply review school health roads bridge audit energy solar north study plan of the and".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
    past, new = [text() for _ in range(23)], [(i % 30, text()) for i in range(60)] + [(99, "entirely unknown"), (100, None)]
    stop = {"of", "the", "and"}

    def terms(t):
        found = [w for w in dict.fromkeys(re.findall("[a-z0-9]{2,}", (t or "").lower())) if w not in stop]
        return Counter(found + [f"{a} {b}" for a, b in zip(found, found[1:])])

    df = Counter(t for p in past for t in terms(p))

    def vector(t):
        v = {k: n * math.log((len(past) + 1) / (df[k] + 1)) for k, n in terms(t).items() if k in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / size for k, x in v.items()} if size else {}

    known = [vector(p) for p in past]
    want = sorted((i, round(sum(sorted((sum(x * p.get(k, 0) for k, x in vector(t).items()) for p in known), reverse=True)[:5]) / 5, 9)) for i, t in new)
    a, b = spark.createDataFrame(new, "id long, t string").repartition(3), spark.createDataFrame([(p,) for p in past], "t string")
    got = lambda: sorted((r.id, round(r.score, 9)) for r in vectors.portfolio_similarity(a, b, "id", "t").collect())
    assert got() == want
    monkeypatch.setattr(vectors, "MOST_QUERIES", 4)
    assert got() == want
    for nothing in (b.where("false"), spark.createDataFrame([("the of",), (None,)], "t string")):
        assert {r.score for r in vectors.portfolio_similarity(a, nothing, "id", "t").collect()} == {0.0}
