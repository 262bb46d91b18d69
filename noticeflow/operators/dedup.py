"""DED: duplicates of records within a batch, against history, and across sources; merging of groups.

Candidates meet by an equi-join on a blocking key, or part by part where a block is large; cheap predicates come before the ratio.
Grouping is greedy leaders in input order (column seq), within blocks, which never share groups; blocks of any size are cut into bounded
tasks and parallel rounds that give what one pass in order gives.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import reduce
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from noticeflow.functions import dates, text as T
from noticeflow.operators.joins import hot_key_join
from noticeflow.tables import cut, workers_import

#: Title ratio, organisation ratio and days between deadlines from which two records are one.
TITLE_RATIO, ORGANISATION_RATIO, DEADLINE_DAYS = 0.82, 0.65, 7


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DED-01, DED-18, DED-20, DED-22, WIN-01: the first row per key; rows with a null key all stay."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    null_key = T.any_of([F.col(k).isNull() for k in keys])
    return ranked.where((F.col("_n") == 1) | null_key).drop("_n")


def hash_duplicates(df: DataFrame, hash_col: str = "content_hash", id_col: str = "tender_id", seen: str = "seq") -> DataFrame:
    """DED-02: rows whose hash an earlier row with another id has, with that row's id as canonical_id.

    The first of each hash is found by an aggregation with map-side combining; a hash of very many rows joins where they lie.
    """
    first = df.groupBy(hash_col).agg(F.min_by(id_col, F.struct(seen, id_col)).alias("canonical_id"), F.count("*").alias("_n")).where("_n > 1")
    return hot_key_join(df, first, [hash_col], "_n", df.count()).where(F.coalesce(F.col(id_col) != F.col("canonical_id"), F.lit(False)))


def register_fingerprints(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("content_hash", "source_portal")) -> DataFrame:
    """DED-03, UPS-02: new rows with a key that is not stored, one per key."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def two_level(hash_id: Column, semantic_id: Column) -> Column:
    """DED-05: the hash's duplicate, else the semantic one."""
    return F.struct(F.coalesce(hash_id, semantic_id).alias("duplicate_of"), F.when(hash_id.isNotNull(), "hash").when(semantic_id.isNotNull(), "semantic").alias("method"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """DED-09: matching-block ratio 2M/T of two texts; 0 where one is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b, strict=True)])


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the ratio of texts of these lengths can be; prunes without changing results."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))


def prepared(df: DataFrame, noise: Sequence[str] = ()) -> DataFrame:
    """df (title, organization) with norm_title, norm_org and block."""
    norm = T.normalise_title("title", noise)
    return df.withColumn("norm_title", norm).withColumn("norm_org", T.normalise_organisation("organization")).withColumn("block", T.blocking_key("norm_title"))


def similar_pairs(left: DataFrame, right: DataFrame, method: str = "ratio", least: float = TITLE_RATIO) -> DataFrame:
    """DED-11, JOI-23: pairs of two prepared frames (columns l_*, r_*) in one block that are the same record, with title_similarity.

    Rows meet where they share one of the rarest characters of their titles, which all pairs do that are alike enough. Same: titles alike; organisations alike, or one is missing and the source families are equal; deadlines close.
    """
    prefix = rare_prefix(left, least)
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns]).where("l_block IS NOT NULL").withColumn("_l", prefix("l_norm_title"))
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).where("r_block IS NOT NULL").withColumn("_r", prefix("r_norm_title"))
    left_marks, right_marks = a.withColumn("_ml", F.explode("_l")), b.withColumn("_mr", F.explode("_r"))
    met = left_marks.join(right_marks, (F.col("l_block") == F.col("r_block")) & (F.col("_ml") == F.col("_mr")))
    met = met.where(F.get(F.array_intersect("_l", "_r"), F.lit(0)) == F.col("_ml")).drop("_l", "_r", "_ml", "_mr")  # once a pair, at the first mark that they share
    pairs = met.where(dates.deadlines_close("l_deadline", "r_deadline", DEADLINE_DAYS) & (ratio_bound(F.col("l_norm_title"), F.col("r_norm_title")) >= least))
    compare = ratio if method == "ratio" else levenshtein_similarity
    pairs = pairs.withColumn("title_similarity", compare(F.col("l_norm_title"), F.col("r_norm_title"))).where(F.col("title_similarity") >= least)
    missing = (F.col("l_norm_org") == "") | (F.col("r_norm_org") == "")
    family = F.regexp_extract("l_source_site", "^[a-z]+", 0) == F.regexp_extract("r_source_site", "^[a-z]+", 0)
    organisations = compare(F.col("l_norm_org"), F.col("r_norm_org")) >= ORGANISATION_RATIO
    return pairs.where((missing & family) | (~missing & organisations))


class _Titles:
    """The test of one later record against earlier ones: is it the same record?"""

    def __init__(self, later: dict):
        self.later = later
        self.title = SequenceMatcher(None, "", later["norm_title"])
        self.organisation = SequenceMatcher(None, "", later["norm_org"])

    def same(self, earlier: dict) -> bool:
        r, t = self.later, self.title
        if earlier["deadline"] is not None and r["deadline"] is not None and abs((earlier["deadline"] - r["deadline"]).days) > DEADLINE_DAYS:
            return False
        if not earlier["norm_org"] or not r["norm_org"]:
            if earlier["family"] != r["family"]:
                return False
        else:
            self.organisation.set_seq1(earlier["norm_org"])
            if self.organisation.ratio() < ORGANISATION_RATIO:
                return False
        t.set_seq1(earlier["norm_title"])
        return _reaches(t, TITLE_RATIO)


def _reaches(m: SequenceMatcher, least: float) -> bool:
    """m.ratio() >= least, with as many of the matching blocks as it takes to say so: a stretch can give no more than the shorter of its sides."""
    n, k = len(m.a), len(m.b)
    if not n + k:
        return least <= 1.0
    longest = _longest_match(m)
    found, left, waiting = 0, min(n, k), [(-min(n, k), 0, n, 0, k)]
    while waiting:
        if 2.0 * (found + left) / (n + k) < least:
            return False
        if 2.0 * found / (n + k) >= least:
            return True
        most, a_low, a_high, b_low, b_high = heappop(waiting)
        left += most
        i, j, size = longest(a_low, a_high, b_low, b_high)
        if not size:
            continue
        found += size
        for side in ((a_low, i, b_low, j), (i + size, a_high, j + size, b_high)):
            if most := min(side[1] - side[0], side[3] - side[2]):
                left += most
                heappush(waiting, (-most, *side))
    return 2.0 * found / (n + k) >= least


#: Characters of two texts together from which places of equal characters are looked for once and not once a stretch, if there are no more than so many.
LONG_TEXTS, MOST_PLACES = 1_000, 4_000_000


def _longest_match(m: SequenceMatcher) -> Callable[[int, int, int, int], tuple[int, int, int]]:
    """m.find_longest_match; for long texts over arrays of the places where m sees equal characters, in the order in which m looks at them."""
    a, b = m.a, m.b
    if len(a) + len(b) < LONG_TEXTS:
        return m.find_longest_match
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = [(np.flatnonzero(codes == ord(c)), np.array(js)) for c, js in m.b2j.items()]  # common characters are not among these
    if sum(len(x) * len(y) for x, y in own) > MOST_PLACES:
        return m.find_longest_match
    i_of, j_of = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.repeat(x, len(y)) for x, y in own], [np.tile(y, len(x)) for x, y in own]))
    order = np.lexsort((i_of, j_of - i_of))  # by diagonal: a run grows by one a place
    i_of, j_of, n = i_of[order], j_of[order], np.arange(len(order))
    new = np.append(True, (np.diff(i_of) != 1) | (np.diff(j_of) != 1))[: len(order)]
    run = n - np.maximum.accumulate(np.where(new, n, 0)) + 1
    order = np.lexsort((j_of, i_of))
    i_of, j_of, run = i_of[order], j_of[order], run[order]

    def longest(a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[int, int, int]:
        low, high = np.searchsorted(i_of, (a_low, a_high))
        i, j, size = a_low, b_low, 0
        if low < high:
            within = np.minimum(np.minimum(run[low:high], i_of[low:high] - a_low + 1), j_of[low:high] - b_low + 1)
            within[j_of[low:high] >= b_high] = 0
            best = int(within.argmax())
            if within[best] > 0:
                size = int(within[best])
                i, j = int(i_of[low + best]) - size + 1, int(j_of[low + best]) - size + 1
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
            size += 1
        return i, j, size

    return longest


class _Counts:
    """Lengths of titles and numbers of their characters, in 128 classes: what two titles have in common is at most what their classes have."""

    def __init__(self, titles: Sequence[str]):
        self.length = np.array([len(t) for t in titles], np.int64)
        self.of = np.zeros((len(titles), 128), np.int32)
        for i, t in enumerate(titles):
            self.of[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 127, minlength=128)

    def may_reach(self, i: int, others: _Counts, among: np.ndarray) -> np.ndarray:
        """Those of others (places, in order) of which title i may be alike enough."""
        among = among[_at_most(np.minimum(self.length[i], others.length[among]), self.length[i] + others.length[among]) >= TITLE_RATIO]
        shared = np.minimum(self.of[i], others.of[among]).sum(1)
        return among[_at_most(shared, self.length[i] + others.length[among]) >= TITLE_RATIO]


def _at_most(shared: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The ratio of texts with so many characters together of which so many match; two empty ones are alike."""
    return np.where(both == 0, 1.0, 2.0 * shared / np.maximum(1, both))


def _records(rows: pd.DataFrame) -> list[dict]:
    """Records by block, in order."""
    out = sorted(rows.to_dict("records"), key=lambda r: (r["block"], r["seq"], r["leader"]))
    for r in out:
        r["deadline"] = None if pd.isna(r["deadline"]) else r["deadline"]
    return out


def _greedy(blocks: pd.DataFrame) -> pd.DataFrame:
    """Each record of some blocks with the first leader of its block before it that is the same record, or as a leader."""
    out = []
    for _, of_block in groupby(_records(blocks), key=lambda r: r["block"]):
        rows = list(of_block)
        counts, leaders, n = _Counts([r["norm_title"] for r in rows]), np.zeros(len(rows), np.int64), 0
        for i, r in enumerate(rows):
            test, near = None, counts.may_reach(i, counts, leaders[:n])
            if len(near):
                test = _Titles(r)
            found = next((rows[x] for x in near if test.same(rows[x])), None)
            if found is None:
                leaders[n], n, found = i, n + 1, r
            out.append((*[r[k] for k in _KEYS], r["seq"], r["leader"], found["leader"]))
    return pd.DataFrame(out, columns=[*_KEYS, "seq", "leader", "led_by"])


def _first_leader(leaders: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
    """Each of rest with the first of leaders that is the same record, or null."""
    known, rows = _records(leaders), _records(rest)
    of_known, counts, every = _Counts([x["norm_title"] for x in known]), _Counts([r["norm_title"] for r in rows]), np.arange(len(known))
    out = []
    for i, r in enumerate(rows):
        near = [known[x] for x in counts.may_reach(i, of_known, every)]
        test = _Titles(r) if near else None
        found = next((x["leader"] for x in near if (x["seq"], x["leader"]) < (r["seq"], r["leader"]) and test.same(x)), None)
        out.append((*[r[k] for k in _KEYS], r["seq"], r["leader"], found))
    return pd.DataFrame(out, columns=[*_KEYS, "seq", "leader", "led_by"])


def _same_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one record: rows of two parts of a block (x and y) with each other, or those of one part among themselves."""
    records = _records(rows)
    counts, part = _Counts([r["norm_title"] for r in records]), np.array([r["_part"] for r in records])
    own = bool(len(records)) and records[0]["_x"] == records[0]["_y"]
    out = []
    for i, r in enumerate(records):
        near = counts.may_reach(i, counts, np.arange(i) if own else np.flatnonzero(part[:i] != part[i]))
        test = _Titles(r) if len(near) else None
        out += [(x["seq"], x["leader"], r["seq"], r["leader"]) for x in map(records.__getitem__, near) if test.same(x)]
    return pd.DataFrame(out, columns=["a_seq", "a_leader", "b_seq", "b_leader"])


_KEYS = ["block", "norm_title", "norm_org", "family", "deadline"]

#: Distinct records of a block that one task groups at a time, rows of the rest of a block that it compares with these, and how often
#: the first records of a large block are taken out so before pairs are looked for.
AT_ONCE, REST_ROWS, FIRST_ROUNDS = 500, 5_000, 3

#: Records of small blocks that one call groups, and records of each of the two parts of a block that meet in one task.
BLOCKS_ROWS, PART_ROWS = 2_000, 1_000

#: Titles that say how common a character is; that bears on speed only.
SAMPLED = 5_000


def rare_prefix(titles: DataFrame, least: float = TITLE_RATIO) -> Callable[[Column], Column]:
    """An expression for the rarest characters of a title, of which two titles of a ratio of least or more always share one.

    A character counts with its number in the title (the third e). Titles a and b have 2M = ratio * (|a| + |b|) or fewer characters in common, and |b| is at least
    least / (2 - least) of |a|, so they share that part of |a| at least: of all but that many of a's rarest characters, one.
    """
    seen: Counter[str] = Counter()
    for r in titles.orderBy(F.xxhash64("norm_title")).limit(SAMPLED).select("norm_title").collect():  # SAMPLED rows at most
        seen.update(_numbered(r["norm_title"]))
    common = dict(seen)
    share = least / (2 - least)

    @F.pandas_udf("array<string>")
    def prefix(t: pd.Series) -> pd.Series:
        def of(title: str) -> list[str]:
            marks = sorted(_numbered(title), key=lambda m: (common.get(m, 0), m))
            return marks[: len(marks) - math.ceil(share * len(marks) - 1e-9) + 1]

        return t.map(of)

    return prefix


def _numbered(title: str) -> list[str]:
    n: Counter[str] = Counter()
    out = []
    for c in title:
        n[c] += 1
        out.append(f"{c}{n[c]}")
    return out


def near_pairs(records: DataFrame) -> DataFrame:
    """a, b: the places (seq, leader) of distinct records of one block that are the same record, a before b.

    A block's records are dealt to parts, and each two parts meet in one task, so that all pairs are looked at and no task holds more than two parts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    row = f"a_seq {kinds['seq']}, a_leader {kinds['leader']}, b_seq {kinds['seq']}, b_leader {kinds['leader']}"
    sizes = records.groupBy("block").agg(F.count("*").alias("_n")).withColumn("_k", F.col("_n"))
    parts = F.ceil(F.col("_n") / PART_ROWS).cast("int")
    dealt = hot_key_join(records, sizes, ["block"], "_k", records.count()).withColumn("_part", F.pmod(F.xxhash64("norm_title", "norm_org", "family", "deadline"), parts).cast("int"))
    other = dealt.withColumn("_q", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = other.select(*_KEYS, "seq", "leader", "_part", F.least("_part", "_q").alias("_x"), F.greatest("_part", "_q").alias("_y"))
    near = met.groupBy("block", "_x", "_y").applyInPandas(_same_pairs, row)
    return near.select(F.struct(F.col("a_seq").alias("seq"), F.col("a_leader").alias("leader")).alias("a"), F.struct(F.col("b_seq").alias("seq"), F.col("b_leader").alias("leader")).alias("b"))


def first_leaders(pairs: DataFrame) -> DataFrame:
    """b, led_by: the followers of a greedy pass over pairs (a before b) and their first leaders, by parallel rounds.

    A record follows as soon as one of those before it leads, and leads as soon as all of these follow; that is what the pass in order
    does, whatever the order of deciding. Each round is written, so lineage stays short.
    """
    pairs = cut(pairs, "near-pairs")
    later, earlier = pairs.select(F.col("b").alias("r")).distinct(), pairs.select(F.col("a").alias("r")).distinct()
    state = earlier.join(later, "r", "left_anti").select("r", F.lit(True).alias("leads"))  # nothing before them
    state, waiting = cut(state, "leads"), cut(later, "waiting")
    while waiting.take(1):
        known = pairs.join(state.select(F.col("r").alias("a"), "leads"), "a", "left")
        told = known.groupBy("b").agg(F.count_if("leads").alias("leaders"), F.count_if(F.col("leads").isNull()).alias("unknown"))
        told = told.join(waiting.select(F.col("r").alias("b")), "b", "left_semi").where("leaders > 0 OR unknown = 0")
        decided = cut(told.select(F.col("b").alias("r"), (F.col("leaders") == 0).alias("leads")), "decided")
        state = cut(state.unionByName(decided), "leads")
        waiting = cut(waiting.join(decided, "r", "left_anti"), "waiting")
    led = pairs.join(state.where("leads").select(F.col("r").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("first"))
    return led.join(state.where("NOT leads").select(F.col("r").alias("b")), "b", "left_semi").select("b", F.col("first.leader").alias("led_by"))


def group_batch(df: DataFrame, noise: Sequence[str] = (), generic: Sequence[str] = ()) -> DataFrame:
    """DED-12: df (id, seq, title, organization, source_site, deadline) with leader: the id of the group's first record.

    Greedy: a record joins the first leader before it, in seq order, that is the same record. Records with one normalised
    title, organisation, family and deadline collapse before the pass, so work grows with distinct records. A block of one record needs no pass; one of up to AT_ONCE is one pass in one
    task, which takes many small blocks. Of a larger one the first AT_ONCE are grouped, and the others compared with their leaders, some thousands a task, a few times over; what
    is left meets in near_pairs and is decided in first_leaders. The result is that of one pass in order. Generic and short titles lead only themselves.
    """
    workers_import(df.sparkSession)
    p = prepared(df, noise).withColumn("family", F.regexp_extract(F.coalesce("source_site", F.lit("")), "^[a-z]+", 0))
    alone = F.col("block").isNull() | F.col("norm_title").isin(*generic)
    # Missing deadlines are close to any, so records collapse only where all of these agree.
    distinct = p.where(~alone).groupBy(*_KEYS).agg(F.min("seq").alias("seq"), F.min_by("id", F.struct("seq", "id")).alias("leader"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    row = f"block string, norm_title string, norm_org string, family string, deadline date, seq {kinds['seq']}, leader {kinds['id']}, led_by {kinds['id']}"
    sized = lambda rows: rows.groupBy("block").agg(F.count("*").alias("_n"))
    columns = [*_KEYS, "seq", "leader"]
    rest = cut(distinct, "records")
    done = []
    for turn in range(FIRST_ROUNDS + 1):
        n = cut(sized(rest), "sizes")
        small = hot_key_join(rest, n.where(F.col("_n") <= AT_ONCE).withColumn("_k", F.col("_n")), ["block"], "_k", rest.count())
        done.append(small.where("_n = 1").select(*columns, F.col("leader").alias("led_by")))
        together = small.where("_n > 1").select(*columns, F.pmod(F.xxhash64("block"), F.lit(1 + n.where(F.col("_n").between(2, AT_ONCE)).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] // BLOCKS_ROWS)).alias("_some"))
        done.append(together.groupBy("_some").applyInPandas(_greedy, row))
        large = n.where(F.col("_n") > AT_ONCE)
        rest = hot_key_join(rest, large.withColumn("_k", F.col("_n")), ["block"], "_k", rest.count())
        if turn == FIRST_ROUNDS or not large.take(1):
            break
        first = rest.withColumn("_at", F.row_number().over(W.partitionBy("block").orderBy("seq", "leader"))).where(F.col("_at") <= AT_ONCE)
        grouped = cut(first.select(*columns).groupBy("block").applyInPandas(_greedy, row), "first")
        done.append(grouped)
        parts = F.ceil(F.col("_n") / REST_ROWS).cast("int")
        leaders = grouped.where(F.col("leader") == F.col("led_by")).join(large, "block").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*columns, "_part")
        last = grouped.groupBy("block").agg(F.max(F.struct("seq", "leader")).alias("_last"))
        others = hot_key_join(rest, last.join(large.select("block", F.col("_n").alias("_k")), "block"), ["block"], "_k", rest.count()).where(F.struct("seq", "leader") > F.col("_last"))
        others = others.withColumn("_part", F.pmod(F.xxhash64("norm_title", "norm_org", "deadline"), parts).cast("int")).select(*columns, "_part")
        met = cut(leaders.groupBy("block", "_part").cogroup(others.groupBy("block", "_part")).applyInPandas(_first_leader, row), "met")
        done.append(met.where("led_by IS NOT NULL"))
        rest = met.where("led_by IS NULL").select(*columns)
    left = cut(rest.select(*columns), "left")
    if left.take(1):
        led = first_leaders(near_pairs(left))
        done.append(left.withColumn("b", F.struct("seq", "leader")).join(led, "b", "left").select(*columns, F.coalesce("led_by", "leader").alias("led_by")))
    led = reduce(DataFrame.unionByName, done).select(*_KEYS, F.col("led_by"))
    on = [p[k].eqNullSafe(led[k]) for k in _KEYS]
    joined = p.where(~alone).join(led, on, "left").select(*[p[c] for c in df.columns], led["led_by"].alias("leader"))
    return joined.unionByName(p.where(alone).select(*df.columns, F.col("id").alias("leader")))


def within_one_edit(names: DataFrame, name: str, block: str) -> DataFrame:
    """JOI-23: x, y: pairs of distinct names of one block, x before y, at a Levenshtein distance of 1.

    Such names are equal once a character is left out of one or of both, so they meet on what is left and not on their block.
    """
    n = F.col(name)
    less = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.left(n, i - 1), F.substr(n, i + 1)))
    forms = F.array_distinct(F.array_append(F.when(F.length(n) > 0, less).otherwise(F.array().cast("array<string>")), n))
    each = names.select(block, name).distinct().select(block, n.alias("x"), F.explode(forms).alias("form"))
    met = each.join(each.withColumnRenamed("x", "y"), [block, "form"]).where("x < y").select("x", "y").distinct()
    return met.where(F.levenshtein("x", "y", 1) == 1)


def match_history(new: DataFrame, history: DataFrame, recency: str = "date_first_seen", method: str = "ratio") -> DataFrame:
    """DED-13: for each new record (id, ...) its newest match in history: id, match_id, richer (whether the new description is longer)."""
    pairs = similar_pairs(prepared(new), prepared(history), method)
    best = pairs.groupBy("l_id").agg(F.max_by(F.struct("r_id", (F.length("l_description") > F.length(F.coalesce("r_description", F.lit("")))).alias("richer")), F.struct(f"r_{recency}", "r_id")).alias("m"))
    return best.select(F.col("l_id").alias("id"), F.col("m.r_id").alias("match_id"), F.col("m.richer").alias("richer"))


def best_value(c: str, seq: str = "seq", longest: bool = True) -> Column:
    """SUB-04: the longest value (the earlier of equals), or the first that isn't missing."""
    v = T.clean_or_null(c)
    present = F.when(v.isNotNull(), F.col(seq))
    return F.max_by(v, F.when(v.isNotNull(), F.struct(F.length(v), -F.col(seq)))) if longest else F.min_by(v, present)


def merge_groups(df: DataFrame, group: str = "leader", seq: str = "seq", longest: Sequence[str] = ("title", "description", "organization"), first: Sequence[str] = ("country",), arrays: Sequence[str] = (), earliest: Sequence[str] = ("deadline",), source: str = "source_site", id_col: str = "id") -> DataFrame:
    """DED-14, SET-03: one record per group: the oldest's id, longest texts, earliest dates, first values, unions of arrays, sources."""
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays]
    return df.groupBy(group).agg(
        F.min_by(id_col, seq).alias("canonical_id"),
        *[best_value(c, seq).alias(c) for c in longest],
        *[best_value(c, seq, False).alias(c) for c in first],
        *[F.min(c).alias(c) for c in earliest],
        *union,
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.count("*").alias("n_members"),
    )


def apply_merges(stored: DataFrame, updates: DataFrame, on: str, richer: Sequence[str]) -> DataFrame:
    """DED-15, UPS-03: stored rows with an update's text where that is longer, compared in characters."""
    side = updates.groupBy(on).agg(*[F.max_by(c, F.length(c)).alias(f"_u_{c}") for c in richer])
    longer = {c: F.when(F.length(f"_u_{c}") > F.length(F.coalesce(c, F.lit(""))), F.col(f"_u_{c}")).otherwise(F.col(c)) for c in richer}
    return stored.join(side, on, "left").withColumns(longer).drop(*[f"_u_{c}" for c in richer])


def cross_source_groups(df: DataFrame, norm: Column, source: str, id_col: str, least: int = 2) -> DataFrame:
    """DED-16: exact normalised keys that at least so many sources have: key, n_rows, n_sources, first_id."""
    g = df.withColumn("_k", norm).where("_k <> ''").groupBy(F.col("_k").alias("key")).agg(F.count("*").alias("n_rows"), F.countDistinct(source).alias("n_sources"), F.min(id_col).alias("first_id"))
    return g.where(F.col("n_sources") >= least)


def cross_sources(own: DataFrame, extra: DataFrame, columns: Sequence[str] = ("tender_id", "portal", "url")) -> DataFrame:
    """DED-17, LKP-06: a record's own source, then others with another URL."""
    both = own.select(*columns, F.lit(0).alias("_r")).unionByName(extra.select(*columns, F.lit(1).alias("_r")))
    return first_per_key(both.withColumn("_u", F.lower("url")), ["tender_id", "_u"], [F.col("_r"), F.col("portal")]).drop("_u", "_r")


def export_key(url: Column, portal: Column, title: Column, prefix: int = 80) -> Column:
    """DED-18, DED-19: the URL in lower case, else portal and the start of the title."""
    return F.coalesce(F.nullif(F.lower(F.trim(url)), F.lit("")), F.concat(F.lit("title:"), F.lower(F.coalesce(portal, F.lit(""))), F.lit("|"), F.substring(T.normalise_title(title), 1, prefix)))


def removed_counts(df: DataFrame, key: Column, by: str) -> DataFrame:
    """DED-18: rows that a key repeats, per portal."""
    per = df.withColumn("_k", key).groupBy("_k").agg(F.count("*").alias("n"), F.min(by).alias("first"))
    own = df.withColumn("_k", key).groupBy(by).count()
    kept = per.groupBy(F.col("first").alias(by)).agg(F.count("*").alias("kept"))
    return own.join(kept, by, "left").select(by, (F.col("count") - F.coalesce("kept", F.lit(0))).alias("removed"))


def merge_links(*links: Column, cap: int = 15) -> Column:
    """DED-21: links of several lists, first per lower-case URL, cap at most."""
    both = F.flatten(F.array(*[F.coalesce(x, F.array()) for x in links]))
    keys = F.transform(both, lambda x: F.lower(x["url"]))
    first = F.filter(both, lambda x, i: F.array_position(keys, F.lower(x["url"])) == i + 1)
    return F.slice(first, 1, cap)


def not_packaged(df: DataFrame, state: DataFrame) -> DataFrame:
    """DED-23: rows of which neither URL nor title is in the state; two anti joins, not one with OR."""
    return df.join(state.select("url").distinct(), "url", "left_anti").join(state.select("title").distinct(), "title", "left_anti")


