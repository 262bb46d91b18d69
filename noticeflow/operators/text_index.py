"""RET-04, RET-11, RET-12: an inverted index over texts, in segments.

A segment is a table of documents (id, number) and a table of postings: for each term and each run of RUN document numbers the ascending numbers
as differences from the run's first, which Parquet packs small. Postings are sorted by term, so the terms of a prefix are one range of the table's files, found by
their least and greatest terms. New versions of documents make a new segment, which hides the older ones; merged() makes one of several.

Searches read postings and never texts: boolean ones count, for each document, the query's tokens that it meets; ranked ones score run by
run and let only the best of each leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.tables import cut, workers_import

#: Document numbers of a row of postings are 2 to this power.
RUN_BITS = 16

#: Longest prefix that a query's token may have to be looked up as one; longer ones are compared with whole terms.
LONGEST = 12


#: Document numbers of found postings that one task counts, about.
TASK_NUMBERS = 500_000


@dataclass
class Index:
    """docs: segment, number, id. postings: segment, run, term, n, first, offsets."""

    docs: DataFrame
    postings: DataFrame

    def live(self) -> DataFrame:
        """number, id of the newest version of each document."""
        newest = self.docs.groupBy("id").agg(F.max(F.struct("segment", "number")).alias("x"))
        return newest.select("id", F.col("x.number").alias("number"))


def numbers() -> Column:
    """The document numbers of a row of postings."""
    return F.transform("offsets", lambda x: F.col("first") + x)


def _row(number: int) -> list[Column]:
    """A row of postings from term, run and at (ascending numbers): numbers go as differences from the first, of 16 bits or so."""
    first = F.element_at("at", 1)
    return [F.lit(number).alias("segment"), F.col("run"), F.col("term"), F.size("at").alias("n"), first.alias("first"), F.transform("at", lambda x: (x - first).cast("int")).alias("offsets")]


def _by_term(rows: DataFrame) -> DataFrame:
    return cut(rows.repartitionByRange("term", "run").sortWithinPartitions("term", "run"), "postings")


def segment(df: DataFrame, id_col: str, text: Column, number: int = 0) -> Index:
    """A segment of df's rows, one for each id (several rows of one id: the one with the greatest text). Null ids are not indexed; null texts are empty."""
    base = number << 56  # segments have numbers of their own
    chosen = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).where("id IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"))
    numbered = cut(chosen.select("id", F.monotonically_increasing_id().alias("number"), T.tokens("text").alias("terms")), "numbered").withColumn("number", F.col("number") + base)
    pairs = numbered.select("number", F.explode("terms").alias("term"))
    runs = pairs.groupBy("term", F.shiftright("number", RUN_BITS).alias("run")).agg(F.array_sort(F.collect_list("number")).alias("at"))
    return Index(numbered.select(F.lit(number).alias("segment"), "number", "id"), _by_term(runs.select(*_row(number))))


def with_segment(index: Index, more: Index) -> Index:
    """An index with one more segment, whose documents hide older ones of their ids. Its number has to be new."""
    return Index(index.docs.unionByName(more.docs), index.postings.unionByName(more.postings))


def merged(index: Index) -> Index:
    """One segment of all live documents: hidden ones leave the postings, which keep their order and numbers."""
    live = index.live()
    each = index.postings.select("run", "term", F.explode(numbers()).alias("number"))
    kept = each.join(live.select("number"), "number", "left_semi").groupBy("term", "run").agg(F.array_sort(F.collect_list("number")).alias("at"))
    return Index(cut(live.select(F.lit(0).alias("segment"), "number", "id"), "docs"), _by_term(kept.select(*_row(0))))


def starting_with(tokens: Sequence[str]) -> Column:
    """Terms that begin with one of tokens, as ranges that reach the files."""
    return T.any_of([(F.col("term") >= t) & (F.col("term") < t[:-1] + chr(ord(t[-1]) + 1)) for t in tokens])


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Found postings by keys, in so many tasks that each has some TASK_NUMBERS numbers: rows are small until their numbers are spelt out, so their bytes don't tell."""
    return rows.repartition(1 + (rows.agg(F.sum("n")).first()[0] or 0) // TASK_NUMBERS, *keys)


def _with_ids(index: Index, found: DataFrame) -> DataFrame:
    """found, by number, with the ids of live documents."""
    tasks = 1 + index.docs.count() // TASK_NUMBERS
    return found.repartition(tasks, "number").join(index.live().repartition(tasks, "number"), "number")


def prefix_search(index: Index, query: str) -> DataFrame:
    """RET-11: ids of live documents in which each token of the query starts a term; none for a query without a token."""
    asked = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    if not asked:
        return index.live().select("id").limit(0)
    rows = index.postings.where(starting_with(asked))
    met = F.filter(F.array(*[F.when(F.col("term").startswith(t), i) for i, t in enumerate(asked)]), lambda x: x.isNotNull())
    each = _dealt(rows.select("run", "n", "first", "offsets", F.explode(met).alias("token")), "run").select("run", "token", F.explode(numbers()).alias("number"))
    found = each.groupBy("run", "number").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(asked))
    return _with_ids(index, found).select("id")


def prefix_searches(index: Index, queries: DataFrame, id_col: str, text: Column) -> DataFrame:
    """RET-11 for a table of queries: query_id, id. Terms and tokens meet by the terms' beginnings, so the join is one of equality."""
    asked = queries.select(F.col(id_col).alias("query_id"), T.tokens(text).alias("tokens"))
    asked = asked.withColumn("n_tokens", F.size("tokens")).withColumn("token", F.explode("tokens")).withColumn("head", F.left("token", F.lit(LONGEST)))
    terms = index.postings.select("term").distinct()
    heads = terms.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(LONGEST))), lambda i: F.left("term", i))))
    met = asked.join(heads, "head").where(F.startswith("term", "token")).select("query_id", "n_tokens", "token", "term")
    rows = index.postings.join(met, "term").select("query_id", "n_tokens", "token", "run", "n", "first", "offsets")
    each = _dealt(rows, "query_id", "run").select("query_id", "n_tokens", "token", "run", F.explode(numbers()).alias("number"))
    found = each.groupBy("query_id", "run", "number").agg(F.count_distinct("token").alias("n"), F.first("n_tokens").alias("n_tokens")).where("n = n_tokens")
    return _with_ids(index, found).select("query_id", "id")


def ranked(index: Index, queries: DataFrame, id_col: str, text: Column, k: int = 10) -> DataFrame:
    """RET-04: query_id, id, score (share of the query's tokens that the document has), rank of each query's k best live documents; ties by id.

    A task scores a run of documents for all queries that its postings know, and gives k of each, or more where ids may break a tie.
    """
    workers_import(queries.sparkSession)
    asked = queries.select(F.col(id_col).alias("query_id"), T.tokens(text).alias("tokens")).withColumn("n_tokens", F.size("tokens")).where("n_tokens > 0")
    kind = asked.schema["query_id"].dataType.simpleString()
    by_term = asked.select("query_id", "n_tokens", F.explode("tokens").alias("term")).groupBy("term").agg(F.collect_list(F.struct("query_id", "n_tokens")).alias("asked"))
    live = index.live()
    alive = live.groupBy(F.shiftright("number", RUN_BITS).alias("run")).agg(F.collect_list(F.struct("number", "id")).alias("live"))
    id_kind = live.schema["id"].dataType.simpleString()

    def score(rows: pa.Table, live_rows: pa.Table) -> pa.Table:
        rows, live_rows = rows.combine_chunks(), live_rows.combine_chunks()
        if not len(rows) or not len(live_rows):
            return pa.table([pa.array([], rows.schema.field("asked").type.value_type.field("query_id").type), pa.array([], live_rows.schema.field("live").type.value_type.field("id").type), pa.array([], pa.float64())], ["query_id", "id", "score"])
        there = pa.concat_arrays([x.values for x in live_rows.column("live")])
        number, ids = there.field("number").to_numpy(), there.field("id")
        base, width = int(number.min()), int(number.max() - number.min()) + 1
        firsts, lists = rows.column("first").to_numpy() - base, [x.values.to_numpy() for x in rows.column("offsets")]
        asked_by: dict[object, list[int]] = {}  # the postings of each query; one query is counted at a time
        n_of: dict[object, int] = {}
        for i, asks in enumerate(rows.column("asked")):
            for a in asks.as_py():
                asked_by.setdefault(a["query_id"], []).append(i)
                n_of[a["query_id"]] = a["n_tokens"]
        out = []
        for q, own in asked_by.items():
            hits = np.zeros(width, np.int32)
            for i in own:
                at = firsts[i] + lists[i]
                hits[at[(at >= 0) & (at < width)]] += 1  # numbers of one posting differ
            n = hits[number - base]
            found = np.flatnonzero(n)
            if len(found) > k:
                found = found[n[found] >= np.partition(n[found], len(found) - k)[len(found) - k]]
            best = sorted(zip((-n[found]).tolist(), ids.take(pa.array(found)).to_pylist(), strict=True))[:k]
            out += [(q, i, -m / n_of[q]) for m, i in best]
        columns = list(zip(*out)) or [[], [], []]
        kinds = [rows.schema.field("asked").type.value_type.field("query_id").type, live_rows.schema.field("live").type.value_type.field("id").type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "id", "score"])

    met = index.postings.join(by_term, "term").select("run", "first", "offsets", "asked")
    each = met.groupBy("run").cogroup(alive.groupBy("run")).applyInArrow(score, f"query_id {kind}, id {id_kind}, score double")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def stacked(indexes: Sequence[Index]) -> Index:
    """Segments, the newest last."""
    return reduce(with_segment, indexes)
