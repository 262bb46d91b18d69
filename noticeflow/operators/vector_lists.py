"""VEC-02, DED-04, OPP-13 at sizes at which all pairs are too many: inverted lists around centres.

Centres are fitted on a bounded sample; every vector lies in the list of its nearest centre. A list's radius, the greatest
angle between its centre and a vector of it, bounds what any of its vectors can have in common with a query. A query
probes the lists that promise most; how similar its k-th find is says which other lists could still hold a better one. Probing
these as well makes the answer exact; leaving them makes it approximate. Scores are always of whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.operators.vectors import _unit, best_of
from noticeflow.tables import cut, workers_import

#: Vectors that centres are fitted on at most; fewest and most centres; rounds of the fit.
SAMPLE, FEWEST, MOST, ROUNDS = 20_000, 8, 4096, 8

#: Share of true neighbours that an approximate answer should have, and queries that it is measured on.
RECALL, TRIED = 0.95, 256

#: Rows of a list that one task scores; a longer list is split.
LIST_ROWS = 20_000


def fit_centres(vectors: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n centres of unit vectors by cosine; a centre that loses all of its vectors stays where it was."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(n, len(vectors))).astype(int)].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if len(mine := vectors[own == i]):
                mean = mine.sum(axis=0)
                centres[i] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


@dataclass
class Centres:
    """Centres, and for each one's list its radius, rows and parts. Tasks get these."""

    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a query's similarity with a vector of each list can be; below all where a list is empty."""
        angle = np.arccos(np.clip(queries @ self.centres.T, -1, 1))
        return np.where(self.rows > 0, np.cos(np.maximum(0.0, angle - self.radius)), -2.0)


@dataclass
class Lists:
    """Centres and the table of all vectors: list, part, id, vector (unit length)."""

    of: Centres
    table: DataFrame


def build(corpus: DataFrame, id_col: str = "vec_id", vector: str = "embedding", n: int | None = None) -> Lists:
    """The lists of all vectors of corpus; null ones are left out. By default there are about as many lists as the root of the number of vectors."""
    workers_import(corpus.sparkSession)
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    total = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()  # bounded by SAMPLE
    n = n or int(min(MOST, max(FEWEST, total**0.5)))
    centres = fit_centres(_unit(some.column("vector")), n) if total else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _unit(b.column("vector"))
            s = v @ centres.T
            own = s.argmax(axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(v)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(angle), b.column("id"), pa.array(list(v), pa.list_(pa.float64()))], ["list", "angle", "id", "vector"])

    kind = rows.schema["id"].dataType.simpleString()
    listed = cut(rows.mapInArrow(assign, f"list int, angle double, id {kind}, vector array<double>"), "lists")
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in listed.groupBy("list").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():  # one row a centre, MOST at most
        radius[r["list"]], size[r["list"]] = r["a"] + 1e-9, r["n"]
    parts = np.maximum(1, -(-size // LIST_ROWS))
    split = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1) if len(parts) else F.lit(1)
    table = listed.select("list", F.pmod(F.xxhash64("id"), split).cast("int").alias("part"), "id", "vector")
    return Lists(Centres(centres, radius, size, parts), table)


def _probes(own: Centres, queries: DataFrame, first: int | None, least: float | None) -> DataFrame:
    """list, part, id, vector: each query at the lists that it probes: the first most promising ones, or those with a bound of its column floor or more that are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _unit(b.column("vector"))
            bound = own.bounds(v)
            order = np.argsort(-bound, axis=1, kind="stable")
            near = np.zeros(bound.shape, bool)
            if first is not None:
                np.put_along_axis(near, order[:, :first], True, axis=1)
            if least is not None:
                near = bound >= least
            elif "floor" in b.schema.names:
                near = ~near & (bound >= b.column("floor").to_numpy(zero_copy_only=False)[:, None])
            near &= bound > -2
            q, at = np.nonzero(near)
            times = own.parts[at]
            q, at = np.repeat(q, times), np.repeat(at, times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            for i in range(0, len(q), 20_000):
                take = pa.array(q[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 20_000].astype(np.int32)), pa.array(part[i : i + 20_000].astype(np.int32)), b.column("id").take(take), b.column("vector").take(take)], ["list", "part", "id", "vector"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.mapInArrow(run, f"list int, part int, id {kinds['id']}, vector {kinds['vector']}")


def _found(lists: Lists, probes: DataFrame, k: int, digits: int) -> DataFrame:
    kind = probes.schema["id"].dataType.simpleString()

    def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, mine = rows.column("id").to_numpy(), asks.column("id").to_numpy()
        found = list(best_of(mine, _unit(asks.column("vector")), ids, _unit(rows.column("vector")), k, digits)) if len(ids) and len(mine) else []
        q, best, s = (np.concatenate([np.empty(0, t), *(x[i] for x in found)]) for i, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table([pa.array(mine[q]), pa.array(ids[best]), pa.array(s)], ["query_id", "id", "similarity"])

    asked = probes.groupBy("list", "part")
    rows = lists.table.groupBy("list", "part").cogroup(asked).applyInArrow(score, f"query_id {kind}, id {kind}, similarity double")
    return _ranked(rows, k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def probes_for(lists: Lists, queries: DataFrame, k: int, recall: float = RECALL, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """The fewest lists that have to be probed so that of the k nearest of a bounded sample of queries such a share is found."""
    some = queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(TRIED)
    at = lists.table.select(F.col("id"), "list").distinct()
    true = nearest(lists, some, k, id_col=id_col, vector=vector).join(at, "id").groupBy("query_id").agg(F.collect_list("list").alias("at"))
    rows = some.select(F.col(id_col).alias("query_id"), F.col(vector).alias("vector")).join(true, "query_id").toArrow()  # TRIED rows at most
    if not rows.num_rows:
        return len(lists.of.centres)
    order = np.argsort(np.argsort(-lists.of.bounds(_unit(rows.column("vector"))), axis=1, kind="stable"), axis=1)
    places = np.sort(np.concatenate([order[i, at] for i, at in enumerate(rows.column("at").to_pylist())]))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def nearest(lists: Lists, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True, least: float | None = None, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, id, similarity, rank of each query's k most similar vectors, as vectors.nearest gives them.

    exact: the answer is that of all pairs. Else only the most promising lists are probed, and some neighbours may be missed; how many are probed is
    measured (probes_for) where it is not given. least: only neighbours that
    are at least so similar, which probes just the lists that can have such ones, and misses none.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    slack = 10.0**-digits  # similarities are rounded
    if least is not None:
        return _found(lists, _probes(lists.of, asked, None, least - slack), k, digits).where(F.col("similarity") >= least)
    probes = probes or (max(1, len(lists.of.centres) // 8) if exact else probes_for(lists, queries, k, id_col=id_col, vector=vector))
    first = _found(lists, _probes(lists.of, asked, probes, None), k, digits)
    if not exact:
        return first
    first = cut(first, "first")
    floor = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("similarity") - slack).alias("floor"))
    more = asked.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.5)))
    return _ranked(first.drop("rank").unionByName(_found(lists, _probes(lists.of, more, probes, None), k, digits).drop("rank")), k)


def semantic_duplicates(corpus: DataFrame, queries: DataFrame, least: float = 0.95, k: int = 5, **names: str) -> DataFrame:
    """DED-04: the k nearest of each query that are at least so similar, over lists; exact."""
    return nearest(build(corpus, **names), queries, k, least=least, **names)
