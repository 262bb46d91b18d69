"""Ranked lexical search over an inverted index, by Block-Max WAND.

The index is made of shards of neighbouring documents. A term's postings in a shard, by
ascending document, are cut into blocks of BLOCK postings, compressed one by one; beside them stand
each block's last document and its greatest impact. For a query, the blocks' last
documents cut a shard into stretches on each of which every term has one block. Moving all pointers
to a stretch is shallow: it adds up the greatest impacts of those blocks, and a
stretch that stays below the k-th best score so far is passed over before anything of it is
decompressed. Stretches that remain are the pivots, visited in document order.

Some shards are searched first; the k-th best score over these is where the others' search begins.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticeflow.llm.common import Scratch, begin, byte_views

#: Postings of a full block.
BLOCK = 128

#: A shard is closed after so many bytes of text or so many documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16

#: One shard in so many is searched first.
FIRST = 16

#: Queries that are searched together are 2 to this power at most.
QUERY_BITS = 8

#: A term's rows meet its queries in so many places.
SALTS = 16

#: Stretches with the highest bounds, which are scored first; pivots that are scored at a time.
AHEAD, PIVOTS = 8, 64

#: ASCII letters and digits, and every character beyond ASCII.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_PIECE = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 text, A-Z lower-cased, a megabyte or so at a time."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text) and (m := _TERM.match(text, end)):
            end = m.end()  # a term is not cut
        yield _TERM.findall(text[at:end].lower())
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms."""
    docs = total = 0
    for b in batches:
        for text in byte_views(b.column(0)):
            n = sum(map(len, terms(text)))
            docs, total = docs + (n > 0), total + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["n_docs", "n_terms"])


def _varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first; and where each value begins."""
    size = 1 + sum((v >= (1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    begins = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[begins[has] + k] = ((v[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, begins


def unpack(block: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Documents and impacts of a block."""
    b = np.frombuffer(block, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    v = np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)
    n = len(v) // 2
    return np.cumsum(v[:n]), v[n:]


class _Shard:
    """Counts of a shard's documents, and the rows that they become."""

    def __init__(self) -> None:
        self.ids: list = []
        self.numbers: dict[bytes, int] = {}
        self.term, self.tf, self.distinct, self.length = array("i"), array("i"), array("i"), array("q")
        self.n_bytes = 0

    def add(self, doc_id: object, text: bytes) -> None:
        self.n_bytes += len(text)
        found: Counter[bytes] = Counter()
        for some in terms(text):
            found.update(some)
        if not found:
            return
        numbers = self.numbers
        self.term.extend([numbers.setdefault(t, len(numbers)) for t in found])
        self.tf.extend(found.values())
        self.distinct.append(len(found))
        self.length.append(found.total())
        self.ids.append(doc_id)

    def rows(self, shard: int, n_docs: int, n_terms: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each term, then one that has the shard's documents in ascending order."""
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] if self.ids[i] is not None else 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term, tf = np.frombuffer(self.term, np.int32).astype(np.int64), np.frombuffer(self.tf, np.int32).astype(np.int64)
        size = np.frombuffer(self.distinct, np.int32)
        m = 25 + 75 * np.frombuffer(self.length, np.int64) * n_docs // n_terms
        doc, weight = np.repeat(rank, size), np.repeat(m, size)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * weight)
        by = np.argsort(term * len(order) + doc, kind="stable")
        term, doc, impact = term[by], doc[by], impact[by]
        n = len(term)
        opens = np.flatnonzero(np.diff(term, prepend=-1))  # of each term
        counts = np.diff(opens, append=n)
        place = np.arange(n) - np.repeat(opens, counts)
        starts = np.flatnonzero(place % BLOCK == 0)  # of each block
        sizes = np.diff(starts, append=n)
        within = np.arange(n) - np.repeat(starts, sizes)
        delta = np.where(within == 0, doc, np.diff(doc, prepend=0))
        values = np.empty(2 * n, np.int64)
        base = np.repeat(2 * starts, sizes) + within
        values[base] = delta
        values[base + np.repeat(sizes, sizes)] = impact
        data, begins = _varints(values)
        blocks = np.searchsorted(starts, opens)  # the first block of each term
        ends = np.append(blocks, len(starts)).astype(np.int32)
        cut = begins[2 * starts]
        whole = np.append(cut[blocks], len(data))
        at = (cut - np.repeat(cut[blocks], np.diff(ends))).astype(np.int32)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
        names = list(self.numbers)
        k = len(opens)
        ids = schema.field("docs").type
        made = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k, shard), pa.int64()),
                pa.array(names, pa.binary()),
                pa.array(counts, pa.int64()),
                lists(doc[starts + sizes - 1], pa.int32()),
                lists(np.maximum.reduceat(impact, starts), pa.int64()),
                lists(at, pa.int32()),
                pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(whole.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
                pa.nulls(k, ids),
            ],
            schema=schema,
        )
        for i in range(0, k, 16384):
            yield made.slice(i, 16384)
        last = [[shard], [None], [len(order)], [None], [None], [None], [None], [[self.ids[i] for i in order]]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(last, schema)], schema=schema)


def build(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index over all rows of docs, written, and the number of documents with a term.

    Index: shard; term (UTF-8; null in the row that has the shard's documents); n postings; last,
    most, at of each block (last document, greatest impact, place in data); data; docs. Documents
    are numbered in a shard by ascending id, nulls first. Ids are of any type and may repeat:
    every row is a document of its own. Null and empty texts, and those without a term,
    are in no shard. A text of any length is counted a megabyte at a time. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    totals = rows.select("text").mapInArrow(_count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    kind = rows.schema["id"].dataType.simpleString()

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin("lexical_search")
        number = TaskContext.get().partitionId() << 20
        schema, shard = None, _Shard()
        for b in batches:
            if schema is None:
                long = lambda t: pa.list_(t)
                schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("last", long(pa.int32())), ("most", long(pa.int64())), ("at", long(pa.int32())), ("data", pa.binary()), ("docs", long(b.column("id").type))])
            for doc_id, text in zip(b.column("id").to_pylist(), byte_views(b.column("text"))):
                shard.add(doc_id, text)
                if shard.n_bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                    yield from shard.rows(number, n_docs, n_terms, schema)
                    number, shard = number + 1, _Shard()
        if schema is not None:
            yield from shard.rows(number, n_docs, n_terms, schema)

    made = rows.mapInArrow(shards, f"shard long, term binary, n long, last array<int>, most array<long>, at array<int>, data binary, docs array<{kind}>")
    return scratch.cut(made, "index"), n_docs


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for q, text in zip(b.column("q").to_pylist(), byte_views(b.column("text"))):
            found: Counter[bytes] = Counter()
            for some in terms(text):
                found.update(some)
            rows += [(q, t, n) for t, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["q", "term", "times"])


class _Postings:
    """A term's blocks in one shard, and those of them that were decompressed."""

    def __init__(self, weight: int, last: np.ndarray, most: np.ndarray, at: np.ndarray, data: bytes):
        self.weight, self.last, self.most, self.at, self.data = weight, last, most, [*at.tolist(), len(data)], data
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            self.open[i] = unpack(self.data[self.at[i] : self.at[i + 1]])
        return self.open[i]


def search_shard(lists: list[tuple[_Postings, int]], k: int, floor: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of a query's k best that score floor or more, best first, ties by ascending document.

    lists: postings and how often the query has the term. scores: zeros, one for each document
    of the shard, and zeros again in the end.
    """
    lists = [(p, p.weight * n) for p, n in lists if p.weight * n > 0]
    none = np.empty(0, np.int64)
    if not lists:
        return none, none
    ends = np.unique(np.concatenate([p.last for p, _ in lists]))  # of stretches
    bound, where = np.zeros(len(ends), np.int64), []
    for p, w in lists:  # the shallow moves
        i = np.searchsorted(p.last, ends)
        where.append(i)
        bound += w * np.append(p.most, 0)[i]
    todo = bound >= floor
    best_d, best_s = none, none

    def score(stretches: np.ndarray) -> None:
        nonlocal best_d, best_s, floor
        begins = np.where(stretches > 0, ends[stretches - 1], -1)
        met = []
        for (p, w), i in zip(lists, where):
            for block in np.unique(i[stretches]):
                if block == len(p.last):
                    continue
                docs, impacts = p.block(int(block))
                s = np.searchsorted(ends[stretches], docs)
                inside = s < len(stretches)
                inside[inside] &= docs[inside] > begins[s[inside]]
                docs = docs[inside]
                scores[docs] += w * impacts[inside]
                met.append(docs)
        docs = np.unique(np.concatenate(met)) if met else none
        found = scores[docs]
        scores[docs] = 0
        good = found >= floor
        d, s = np.concatenate([best_d, docs[good]]), np.concatenate([best_s, found[good]])
        by = np.lexsort((d, -s))[:k]
        best_d, best_s = d[by], s[by]
        if len(by) == k:
            floor = max(floor, int(best_s[-1]))

    ahead = np.sort(np.argsort(-bound, kind="stable")[:AHEAD])
    score(ahead[todo[ahead]])
    todo[ahead] = False
    at = 0
    while at < len(ends):
        pivots = at + np.flatnonzero(todo[at:] & (bound[at:] >= floor))[:PIVOTS]
        if not len(pivots):
            break
        score(pivots)
        at = int(pivots[-1]) + 1
    return best_d, best_s


def _searcher(k: int) -> Callable[[pa.Table], pa.Table]:
    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        queries: dict[int, tuple[int, list]] = {}
        size = 0
        for i in range(rows.num_rows):
            last, most, at = (rows.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("last", "most", "at"))
            p = _Postings(rows.column("weight")[i].as_py(), last, most, at, rows.column("data")[i].as_py())
            size = max(size, int(last[-1]) + 1)
            for q in rows.column("queries")[i].as_py():
                queries.setdefault(q["q"], (q["floor"], []))[1].append((p, q["times"]))
        scores = np.zeros(size, np.int64)
        got = [(q, *search_shard(lists, k, max(1, floor), scores)) for q, (floor, lists) in queries.items()]
        qs = np.repeat(np.array([q for q, _, _ in got], np.int64), [len(d) for _, d, _ in got])
        flat = [np.concatenate([np.empty(0, np.int64), *(g[j] for g in got)]) for j in (1, 2)]
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        shard = rows.column("shard")[:1]
        return pa.table([shard, one(qs, pa.int64()), one(flat[0].astype(np.int32), pa.int32()), one(flat[1], pa.int64())], ["shard", "q", "doc", "score"])

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("q").orderBy(F.desc("score"), "doc_id")  # each partition keeps its k best before the shuffle
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _best_in(scratch: Scratch, index: DataFrame, queries: DataFrame, k: int, name: str) -> DataFrame:
    """q, doc_id, score, rank: the k best of each query in these shards. queries: q, term, times, weight, floor."""
    asked = queries.groupBy("term", F.shiftright("q", QUERY_BITS).alias("some")).agg(F.first("weight").alias("weight"), F.collect_list(F.struct("q", "times", "floor")).alias("queries"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = index.where("term IS NOT NULL").select("shard", "term", "last", "most", "at", "data", F.pmod("shard", F.lit(SALTS)).cast("int").alias("salt"))
    met = rows.join(asked, ["term", "salt"]).select("shard", "some", "weight", "queries", "last", "most", "at", "data")
    found = met.groupBy("shard", "some").applyInArrow(_searcher(k), "shard long, q array<long>, doc array<int>, score array<long>")
    docs = index.where("term IS NULL").select("shard", "docs")
    each = F.explode(F.arrays_zip("q", "doc", "score"))
    told = found.join(docs, "shard").select("docs", each.alias("x")).select(F.col("x.q").alias("q"), F.element_at("docs", F.col("x.doc") + 1).alias("doc_id"), F.col("x.score").alias("score"))
    return scratch.cut(_top(told, k), name)


def search(scratch: Scratch, index: DataFrame, n_docs: int, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id_col, rank (int, from 1), doc_id, score of each query's k best documents that score above 0.

    Equal scores rank by ascending doc_id. Queries without a term, or that share none
    with a document, give no rows; null ids and repeated ones are queries of their own each.
    """
    rows = scratch.cut(queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("q")), "queries")
    asked = scratch.cut(rows.select("q", "text").mapInArrow(_query_terms, "q long, term binary, times long"), "query-terms")
    known = index.where("term IS NOT NULL").select("term", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    asked = scratch.cut(asked.join(known.select("term", weight.alias("weight")), "term"), "weights")
    early: Column = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    first = _best_in(scratch, index.where(early), asked.withColumn("floor", F.lit(1).cast("long")), k, "first")
    floors = first.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    second = _best_in(scratch, index.where(~early), asked.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))), k, "second")
    best = _top(first.drop("rank").unionByName(second.drop("rank")), k)
    return best.join(rows.select("q", "item"), "q").select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long").alias("score"))


def top_documents(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id") -> DataFrame:
    """search over an index of docs, which is built first."""
    scratch = Scratch(spark, "lexical-search")
    index, n_docs = build(scratch, docs)
    return search(scratch, index, n_docs, queries, k, id_col)
