"""Ranked search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from llm_fixtures import WORDS, frame, rows
from noticeflow.llm import lexical_search as ls
from noticeflow.llm.common import Scratch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, k=10):
    """item, rank, doc_id, score of (doc_id, text) and (item, text)."""
    docs = [(d, Counter(w)) for d, t in docs if (w := TERM.findall(lower(t)))]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 100 - 75 + 75 * c.total() * n_docs // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(TERM.findall(lower(text))).items() if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "The straße, and THE ñando"), (2, "thion thion x 12 erst"), (3, None), (4, ""), (5, "no such term"), (6, "boiler plate line"), (None, "ΑΣ ας you 你好 more"), (6, "boiler")]


def ours(spark, docs, items, k=10):
    table = spark.createDataFrame([(*i, None, "x") for i in items], "item_id long, text string, doc_id long, q string").repartition(2)
    return sorted((tuple(r) for r in ls.top_documents(spark, docs, table, k).collect()), key=repr)


def test_top_documents(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert ours(spark, frame(spark), ITEMS) == plain(docs, ITEMS)
    assert ours(spark, frame(spark), ITEMS, 3) == plain(docs, ITEMS, 3)


def test_no_documents_and_no_queries(spark):
    assert ours(spark, frame(spark, []), ITEMS) == []
    assert ours(spark, frame(spark), []) == []


def test_two_waves_of_shards(spark):
    """Many partitions, so many shards: the second wave begins at the first one's scores and loses no tie."""
    rng = random.Random(3)
    docs = [(i % 150, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))) for i in range(400)]
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(4))) for i in range(12)]
    made = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in docs], frame(spark, []).schema).repartition(40)
    assert ours(spark, made, items) == plain(docs, items)


def shard_of(docs, monkeypatch, block=4):
    import pyarrow as pa

    monkeypatch.setattr(ls, "BLOCK", block)
    shard = ls._Shard()
    for i, text in docs:
        shard.add(i, text.encode())
    words = [TERM.findall(lower(t)) for _, t in docs]
    total = sum(map(len, words))
    n = sum(map(bool, words))
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("last", pa.list_(pa.int32())), ("most", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("data", pa.binary()), ("docs", pa.list_(pa.int64()))])
    made = [r for b in shard.rows(0, n, total, schema) for r in b.to_pylist()]
    return {r["term"]: r for r in made if r["term"]}, next(r["docs"] for r in made if not r["term"]), n


def postings(lists, n, query):
    out = []
    for t, times in Counter(TERM.findall(lower(query))).items():
        if r := lists.get(t.encode()):
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * r["n"] + 1)))
            out.append((ls._Postings(w, np.array(r["last"]), np.array(r["most"]), np.array(r["at"]), r["data"]), times))
    return out


def test_blocks_below_the_threshold_stay_compressed(monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(WORDS, range(1, len(WORDS) + 1), k=rng.randrange(1, 30)))) for i in range(3000)]
    docs += [(5000 + i, "rare thing here the the the") for i in range(12)]
    lists, ids, n = shard_of(docs, monkeypatch)
    for query in ("rare thing the", "the and straße x", "12 it's you 你好 erst erst", "here"):
        found = postings(lists, n, query)
        scores = np.zeros(len(ids), np.int64)
        d, s = ls.search_shard(found, 10, 1, scores)
        assert [("q", i + 1, ids[a], int(b)) for i, (a, b) in enumerate(zip(d, s))] == sorted(plain(docs, [("q", query)]), key=lambda r: r[1])
        assert not scores.any()
        if query == "rare thing the":
            the = next(p for p, _ in found if len(p.last) > 100)
            assert len(the.open) < len(the.last) / 10
    found = postings(lists, n, "the and straße x")
    best = plain(docs, [("q", "the and straße x")], 10)
    assert ls.search_shard(found, 10, max(b[3] for b in best) + 1, np.zeros(len(ids), np.int64))[0].size == 0


def test_blocks_hold_what_was_packed(monkeypatch):
    rng = random.Random(5)
    docs = [(i, "a " * rng.randrange(1, 400) + "b" * (i % 2)) for i in range(700)]
    lists, _, _ = shard_of(docs, monkeypatch, 128)
    r = lists[b"a"]
    blocks = [ls.unpack(r["data"][a:b]) for a, b in zip(r["at"], [*r["at"][1:], len(r["data"])])]
    assert np.concatenate([d for d, _ in blocks]).tolist() == list(range(700))
    assert [int(q.max()) for _, q in blocks] == r["most"] and [int(d[-1]) for d, _ in blocks] == r["last"]
    assert [len(d) for d, _ in blocks] == [128] * 5 + [60]


def test_terms_are_not_cut(monkeypatch):
    monkeypatch.setattr(ls, "_PIECE", 7)
    text = "Añb cdefghijkl, mn OP straße 12 \x7f é" * 3
    assert [t for some in ls.terms(text.encode()) for t in some] == [t.encode() for t in TERM.findall(lower(text))]


def test_index_is_read_again(spark):
    """Searching an index twice gives the same; every row with a term is in one shard."""
    scratch = Scratch(spark, "test")
    index, n = ls.build(scratch, frame(spark))
    assert n == sum(bool(TERM.findall(r[1] or "")) for r in rows()) == index.where("term IS NULL").selectExpr("sum(size(docs))").first()[0]
