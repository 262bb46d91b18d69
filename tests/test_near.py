"""Greedy groups of near-equal records: blocks of any size give what one pass in order gives."""

import datetime as dt
import random

import pytest

from noticeflow.operators import dedup

SCHEMA = "id long, seq long, title string, organization string, source_site string, deadline date"


def plain_groups(rows, prepared):
    """The pass in order, over all records, by the prepared texts."""
    leaders, out = [], {}
    for i, seq, _, org, site, deadline in sorted(rows, key=lambda r: r[1]):
        title, norm_org, block = prepared[i]
        if block is None:
            out[i] = i
            continue
        own = {"norm_title": title, "norm_org": norm_org, "deadline": deadline, "family": "".join(c for c in (site or "") if c.isalpha()), "block": block, "id": i}
        for x in leaders:
            if x["block"] != block:
                continue
            from difflib import SequenceMatcher as S

            close = x["deadline"] is None or deadline is None or abs((x["deadline"] - deadline).days) <= 7
            orgs = x["family"] == own["family"] if not x["norm_org"] or not norm_org else S(None, x["norm_org"], norm_org).ratio() >= 0.65
            if close and orgs and S(None, x["norm_title"], title).ratio() >= 0.82:
                out[i] = x["id"]
                break
        else:
            leaders.append(own)
            out[i] = i
    return out


def made(rng, n):
    words = ["health", "water", "roads", "support", "review", "of", "north", "energy", "schools", "audit", "plan", "study"]
    rows = []
    for i in range(n):
        title = "supply of the " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
        if rng.random() < 0.4 and rows:
            title = (rng.choice(rows)[2] or "x") + rng.choice(["", " ", "s", " x", " lot"])
        if rng.random() < 0.05:
            title = rng.choice([None, "", "short", "other block words here"])
        rows.append((i, (i * 7919) % 10007, title, rng.choice([None, "", "Ministry of Water", "Ministry of Waters", "City Ltd"]), rng.choice(["aa1", "aa2", "bb", None]), rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 5), dt.date(2024, 3, 1)])))
    return rows


@pytest.mark.parametrize("at_once, rounds", [(500, 3), (15, 2), (10, 0)])
def test_groups_are_those_of_one_pass(spark, monkeypatch, at_once, rounds):
    """All in one task; in rounds that take first records out; and by pairs and parallel rounds alone."""
    monkeypatch.setattr(dedup, "AT_ONCE", at_once)
    monkeypatch.setattr(dedup, "FIRST_ROUNDS", rounds)
    monkeypatch.setattr(dedup, "REST_ROWS", 20)
    rows = made(random.Random(3), 260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    prepared = {r.id: (r.norm_title, r.norm_org, r.block) for r in dedup.prepared(df).collect()}
    got = {r.id: r.leader for r in dedup.group_batch(df).collect()}
    assert got == plain_groups(rows, prepared)
    assert len(set(got.values())) < 200


def test_pairs_miss_none(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    titles = sorted({"".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(15, 40))) for _ in range(60)})
    titles += sorted({t[: rng.randrange(12, len(t))] + rng.choice("xyz") * rng.randrange(4) + t[rng.randrange(10, 15) :] for t in titles})
    rows = [(i, i, "b", t, "", "", None) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "seq long, leader long, block string, norm_title string, norm_org string, family string, deadline date")
    got = {(r.a.seq, r.b.seq) for r in dedup.near_pairs(df).collect()}
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.82}
    assert got == want and want


def test_first_leaders_of_chains(spark):
    """1-2-3-4-5: 1, 3 and 5 lead. A star and a triangle follow their first."""
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (10, 12), (11, 12), (20, 22), (21, 22), (22, 23)]
    df = spark.createDataFrame([((a, a), (b, b)) for a, b in pairs], "a struct<seq:int,leader:int>, b struct<seq:int,leader:int>")
    assert {(r.b.seq, r.led_by) for r in dedup.first_leaders(df).collect()} == {(2, 1), (4, 3), (11, 10), (12, 10), (22, 20)}


def test_history_pairs_miss_none(spark):
    """Both ways of comparing, against all pairs of a block."""
    from difflib import SequenceMatcher

    rows = made(random.Random(9), 120)
    df = spark.createDataFrame([(*r, r[3], dt.date(2024, 1, 1 + r[0] % 28)) for r in rows], SCHEMA + ", description string, date_first_seen date")
    new, old = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    p = {r.id: r for r in dedup.prepared(df).collect()}
    family = lambda r: "".join(c for c in (r.source_site or "")[:2] if c.isalpha()) if r.source_site else None

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        return 1 - row[-1] / max(1, len(a), len(b))

    for method, alike in (("ratio", lambda a, b: SequenceMatcher(None, a, b).ratio()), ("levenshtein", levenshtein)):
        want = set()
        for a in p.values():
            for b in p.values():
                if a.id % 2 or not b.id % 2 or a.block is None or a.block != b.block or alike(a.norm_title, b.norm_title) < 0.82:
                    continue
                close = a.deadline is None or b.deadline is None or abs((a.deadline - b.deadline).days) <= 7
                missing = not a.norm_org or not b.norm_org
                if close and (family(a) is not None and family(a) == family(b) if missing else alike(a.norm_org, b.norm_org) >= 0.65):
                    want.add((a.id, b.id))
        pairs = dedup.similar_pairs(dedup.prepared(new), dedup.prepared(old), method)
        assert {(r.l_id, r.r_id) for r in pairs.collect()} == want and want
        newest = {}
        for a, b in want:
            newest[a] = max(newest.get(a, b), b, key=lambda x: (p[x].date_first_seen, x))
        assert {r.id: r.match_id for r in dedup.match_history(new, old, method=method).collect()} == newest


def test_one_edit(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(60)})
    df = spark.createDataFrame([(n, "k" if len(n) < 5 else "m") for n in names], "name string, block string")

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {(a, b) for a in names for b in names if a < b and (len(a) < 5) == (len(b) < 5) and one(a, b)}
    assert {(r.x, r.y) for r in dedup.within_one_edit(df, "name", "block").collect()} == want


def test_fuzzy_ratio_is_the_pass_in_order(spark):
    """The registered query over the whole table."""
    from noticeflow.plans import queries

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.doc_id, (r.text or "").split("\n")[0], None, "src", None) for r in d]
    prepared = {r.id: (r.norm_title, r.norm_org, r.block) for r in dedup.prepared(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r.id: r.leader for r in queries.QUERIES["fuzzy_ratio"](spark, "/root/testdata/sf0.001").collect()} == plain_groups(rows, prepared)


def test_no_records(spark):
    assert dedup.group_batch(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_share_a_call():
    """Records of several blocks in one call follow only leaders of their own block."""
    import pandas as pd

    rows = [("b", "supply of pumps north", 2), ("a", "supply of pumps north", 1), ("b", "supply of pumps norths", 3), ("a", "something else entirely", 4), ("a", "supply of pump north", 5)]
    frame = pd.DataFrame([(b, t, "", "x", None, i, i) for b, t, i in rows], columns=["block", "norm_title", "norm_org", "family", "deadline", "seq", "leader"])
    got = dedup._greedy(frame)
    assert dict(zip(got.leader, got.led_by)) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 1}


@pytest.mark.parametrize("long_texts, most", [(0, 4_000_000), (0, 10), (10_000, 0)])
def test_decisions_are_the_ratio(monkeypatch, long_texts, most):
    """With stretches looked for by arrays or not, a decision that stops early is the one of the whole ratio."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(dedup, "LONG_TEXTS", long_texts)
    monkeypatch.setattr(dedup, "MOST_PLACES", most)
    rng, seen = random.Random(8), set()
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz   eeeé😀"])
        a = [rng.choice(letters) for _ in range(rng.randrange(rng.choice([1, 60, 400])))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice([0, 1, 5])] = [rng.choice(letters + "zq") for _ in range(rng.choice([0, 1, 4]))]
        m = SequenceMatcher(None, "".join(a), "".join(b))
        want = m.ratio() >= 0.82
        assert dedup._reaches(m, 0.82) == want
        counts = dedup._Counts([m.a, m.b])
        assert not want or list(counts.may_reach(0, counts, dedup.np.array([1]))) == [1]
        seen.add(want)
    assert seen == {True, False}


def test_parts_of_a_block_meet(spark, monkeypatch):
    """Each two parts of a block are compared, and each pair is given once."""
    monkeypatch.setattr(dedup, "PART_ROWS", 7)
    test_pairs_miss_none(spark)
