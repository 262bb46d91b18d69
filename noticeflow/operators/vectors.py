"""VEC: similarity of vectors and texts.

Nearest neighbours are exact where blocks of queries meet blocks of corpus in numpy, or found in the inverted lists
of an index of centres, whose recall is measured; either way a window over the best k a task keeps the best k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.tables import cut, workers_import

#: Queries and vectors of a block, and similarities that a worker holds at once.
MOST_QUERIES, BLOCK_ROWS, CELLS_AT_ONCE = 10_000, 50_000, 2_000_000

#: Queries and vectors of a block where all pairs are a result, and pairs that a worker gives back at once. A pair costs 1/PAIR_QUERIES + 1/PAIR_ROWS
#: shuffled rows; few vectors a block keep their ids short in a file of pairs.
PAIR_QUERIES, PAIR_ROWS, PAIRS_AT_ONCE = 20_000, 4_096, 250_000


def cosine(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    """VEC-01"""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length 1; those of length 0 stay."""
    m = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def best_of(mine: np.ndarray, asked: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and of their k best vectors, and similarities, some queries at a time; a vector is not its own neighbour."""
    n = min(k, len(own))
    each = max(1, CELLS_AT_ONCE // max(1, len(own)))
    for at in range(0, len(mine) if n else 0, each):
        ids = mine[at : at + each]
        s = np.round(asked[at : at + each] @ vectors.T, digits)
        s[ids[:, None] == own[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :n] if n > len(own) // 8 else _few(s, own, n)
        q = np.repeat(np.arange(len(ids)), n)
        best = order.ravel()
        ok = np.isfinite(s[q, best])
        yield q[ok] + at, best[ok], s[q, best][ok]


def _few(s: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each row, ties by the smaller id, without a sort of all."""
    least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
    out = np.empty((len(s), n), np.int64)
    for i, row in enumerate(s):
        at = np.flatnonzero(row >= least[i])
        out[i] = at[np.lexsort((own[at], -row[at]))[:n]]
    return out


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """VEC-02, WIN-03: the k most similar vectors of each query: query_id, id, similarity, rank. Ties go to the smaller id.

    A vector is not its own neighbour. Vectors of length 0 have similarity 0; null vectors have no part. Exact: blocks of queries meet
    blocks of corpus, each pair of blocks in one task, and of its scores only k a query leave it; nothing passes through the driver. Blocks are
    bounded in rows, and there are as many as it takes. nearest_by_lists is for sizes at which all pairs are too many.
    """
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // BLOCK_ROWS))
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    place = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = corpus.schema[id_col].dataType.simpleString()
    own = corpus.where(F.col(vector).isNotNull()).select(id_col, vector, place(parts).alias("_part"), every(blocks).alias("_block"))
    asked = queries.where(F.col(vector).isNotNull()).select(id_col, vector, every(parts).alias("_part"), place(blocks).alias("_block"))

    def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, mine = rows.column(id_col).to_numpy(), asks.column(id_col).to_numpy()
        found = list(best_of(mine, _unit(asks.column(vector)), ids, _unit(rows.column(vector)), k, digits)) if len(ids) and len(mine) else []
        q, best, s = (np.concatenate([np.empty(0, t), *(x[i] for x in found)]) for i, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table([pa.array(mine[q]), pa.array(ids[best]), pa.array(s)], ["query_id", "id", "similarity"])

    rows = own.groupBy("_part", "_block").cogroup(asked.groupBy("_part", "_block")).applyInArrow(score, f"query_id {kind}, id {kind}, similarity double")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return ranked.where(F.col("rank") <= k)


def similarities(corpus: DataFrame, queries: DataFrame, more: Sequence[str] = (), id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, least: float | None = None) -> DataFrame:
    """VEC-01: query_id, id, similarity and columns more of corpus, for all pairs of a query and another vector, or those at least so similar; null vectors have no part.

    The result grows as the product of both sides. A pair of blocks is one task, which holds the vectors of both and gives its pairs back some at a
    time; blocks are large, so that what is shuffled is a small part of the result.
    """
    workers_import(corpus.sparkSession)
    asks = max(1, -(-queries.count() // PAIR_QUERIES))
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-corpus.count() // PAIR_ROWS))
    place = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = {f.name: f.dataType.simpleString() for f in corpus.schema}
    own = corpus.where(F.col(vector).isNotNull()).select(id_col, vector, *more, place(parts).alias("_part"), every(asks).alias("_block"), F.lit(True).alias("_own"))
    asked = queries.where(F.col(vector).isNotNull()).select(id_col, vector, *(F.lit(None).cast(kind[c]).alias(c) for c in more), every(parts).alias("_part"), place(asks).alias("_block"), F.lit(False).alias("_own"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        both = pa.Table.from_batches(held)
        rows, mine = (both.filter(x).combine_chunks() for x in (both.column("_own"), pc.invert(both.column("_own"))))
        if not len(rows) or not len(mine):
            return
        ids, own_ids = rows.column(id_col).to_numpy(), mine.column(id_col).to_numpy()
        vectors, asks = _unit(rows.column(vector)), _unit(mine.column(vector))
        each = max(1, PAIRS_AT_ONCE // len(ids))
        for at in range(0, len(own_ids), each):
            s = np.round(asks[at : at + each] @ vectors.T, digits)
            ok = own_ids[at : at + each, None] != ids[None, :]
            if least is not None:
                ok &= ~(s < least)
            q, r = np.nonzero(ok)
            take = pa.array(r)
            pairs = [mine.column(id_col).take(pa.array(q + at)), rows.column(id_col).take(take), pa.array(s[q, r]), *(rows.column(c).take(take) for c in more)]
            yield from pa.table(pairs, ["query_id", "id", "similarity", *more]).to_batches()

    carried = "".join(f", `{c}` {kind[c]}" for c in more)
    met = own.unionByName(asked).repartitionById(parts * asks, F.col("_part") * asks + F.col("_block")).drop("_part", "_block")
    return met.mapInArrow(score, f"query_id {kind[id_col]}, id {kind[id_col]}, similarity double{carried}")


def semantic_duplicates(corpus: DataFrame, queries: DataFrame, least: float = 0.95, k: int = 5, **how) -> DataFrame:
    """DED-04: those of the k nearest that are at least so similar. Filter corpus by time before."""
    return nearest(corpus, queries, k, **how).where(F.col("similarity") >= least)


def composed_text(*columns: str, least: int = 10) -> Column:
    """VEC-04: the text to embed; null where it is too short."""
    t = F.concat_ws(" ", *[T.clean_or_null(c) for c in columns])
    return F.when(F.length(t) >= least, t)


def store_state(n_vectors: Column, n_rows: Column, least: float = 0.9) -> Column:
    """VEC-05, VEC-06: empty, diverged or ok, by the share of rows that have a vector."""
    return F.when(n_vectors == 0, "empty").when(T.safe_ratio(n_vectors, n_rows, 0.0) < least, "diverged").otherwise("ok")


def tfidf(df: DataFrame, text: str, features: int = 20_000, model=None):
    """VEC-07: df with tfidf, the terms (1- and 2-grams) and weights of a text that are not 0, of unit length; and the fitted models."""
    words = df.withColumn("_w", T.tokens(text, least=2))
    words = StopWordsRemover(inputCol="_w", outputCol="_s").transform(words)
    words = NGram(n=2, inputCol="_s", outputCol="_b").transform(words).withColumn("_t", F.concat("_s", "_b"))
    if model is None:
        counts = CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=features, minDF=1.0).fit(words)
        model = (counts, IDF(inputCol="_c", outputCol="_i").fit(counts.transform(words)))
    out = Normalizer(inputCol="_i", outputCol="_n").transform(model[1].transform(model[0].transform(words)))
    sparse = F.unwrap_udt("_n")
    dense = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sparse["values"]) - 1))  # a vector of many terms may come dense
    terms = F.when(sparse["type"] == 0, sparse["indices"]).otherwise(dense)
    return out.withColumn("tfidf", F.struct(terms.alias("terms"), sparse["values"].alias("weights"))).drop("_w", "_s", "_b", "_t", "_c", "_i", "_n"), model


class _Postings:
    """Texts by their terms: for a text, one accumulator for each of these, touched only where terms are shared."""

    def __init__(self, texts: list[dict]):
        self.n = len(texts)
        sizes = [len(t["terms"]) for t in texts]
        terms = np.concatenate([np.empty(0, np.int64), *(np.array(t["terms"], np.int64) for t in texts)])
        weights = np.concatenate([np.empty(0), *(np.array(t["weights"], np.float64) for t in texts)])
        order = np.argsort(terms, kind="stable")
        self.texts, self.weights, terms = np.repeat(np.arange(self.n), sizes)[order], weights[order], terms[order]
        known, first = np.unique(terms, return_index=True)
        self.at = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(terms)])))

    def best(self, text: dict, k: int) -> list[float]:
        """The k greatest products with a text, zeros included."""
        sums = np.zeros(self.n)
        for term, weight in zip(text["terms"], text["weights"]):
            if found := self.at.get(term):
                sums[self.texts[found[0] : found[1]]] += weight * self.weights[found[0] : found[1]]
        return np.sort(sums)[-k:].tolist()


def portfolio_similarity(df: DataFrame, portfolio: DataFrame, id_col: str, text: str, best: int = 5) -> DataFrame:
    """VEC-07: mean of the best cosines with all of a portfolio of past work: id, score; 0 where the portfolio has no term.

    Texts are their terms and weights that are not 0, nothing else is held or sent. Blocks of rows meet blocks of the portfolio, the best of each
    pair of blocks are merged, so neither side is bounded and nothing passes through the driver.
    """
    workers_import(df.sparkSession)
    said = F.array_except(T.tokens(text, least=2), F.array(*map(F.lit, StopWordsRemover.loadDefaultStopWords("english"))))
    if not portfolio.where(F.size(said) > 0).take(1):  # nothing to fit on
        return df.select(id_col, F.lit(0.0).alias("score"))
    past, model = tfidf(portfolio, text)
    rows = cut(tfidf(df.select(id_col, text), text, model=model)[0].select(id_col, "tfidf", F.monotonically_increasing_id().alias("_row")), "tfidf")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    blocks = max(1, -(-portfolio.count() // MOST_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = rows.select("_row", "tfidf", F.pmod("_row", F.lit(parts)).cast("int").alias("_part"), every(blocks).alias("_block"))
    theirs = past.select("tfidf", F.pmod(F.xxhash64("tfidf"), F.lit(blocks)).cast("int").alias("_block"), every(parts).alias("_part"))

    def score(own: pa.Table, other: pa.Table) -> pa.Table:
        known = _Postings(other.column("tfidf").to_pylist())
        found = [known.best(t, best) for t in own.column("tfidf").to_pylist()]
        return pa.table([own.column("_row"), pa.array(found, pa.list_(pa.float64()))], ["_row", "found"])

    met = mine.groupBy("_part", "_block").cogroup(theirs.groupBy("_part", "_block")).applyInArrow(score, "_row long, found array<double>")
    top = met.groupBy("_row").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found")), asc=False), 1, best).alias("top"))
    mean = T.safe_ratio(F.aggregate("top", F.lit(0.0), lambda x, y: x + y), F.size("top"), 0.0)
    return rows.select(id_col, "_row").join(top.select("_row", mean.alias("score")), "_row").select(id_col, "score")


def jaccard(a: Column, b: Column) -> Column:
    """VEC-08, SET-05, SET-06: shared tokens of all; 0 where there are none."""
    return T.safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 0.0)
