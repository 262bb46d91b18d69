"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bulk-synchronous best fit: pieces are sorted by length over range partitions, and open
sequences by gap. In each superstep the longest pieces that are left look for their
successor among the gaps, the smallest gap that holds them; of pieces that want gaps of
one size, the i-th by rank takes the i-th gap by rank, the others look on; gaps are updated,
and the next superstep starts. What has no gap opens sequences.

Pieces of one length differ by rank only, and so do gaps of one size. So
supersteps move runs of ranks, not rows: their state is at most capacity lengths
and gap sizes with their runs, whatever the number of pieces. Rows then find their run
by a successor sweep (binary search of length and rank) where they lie.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import Scratch, texts_of
from noticeflow.llm.tokens import WORDS, codec


def token_pieces(docs: DataFrame, vocabulary: str, kind: str = WORDS, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Each document's ids, then end_id, cut into pieces of capacity: doc_id, piece, start, length, ids_crc32 (and ids if asked for).

    Null counts as empty: a piece with end_id alone. Strings of special tokens are encoded as the library does, or as ordinary text. Other columns are dropped. Each row of docs has
    its own pieces, repeated ids or not.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, kind, special_as_text)
        for batch in batches:
            rows, own_row, all_ids = [], [], [np.zeros(0, "<u4")]
            for row, raw in enumerate(code.encode_bounded(texts_of(batch, "text"))):
                ids = np.append(np.frombuffer(raw, code.type), end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    own_row.append(row)
                    rows.append((piece, start, len(own), zlib.crc32(own.tobytes())))
                if with_ids:
                    all_ids.append(ids)
            made = [pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(fields), fields, strict=True)]
            if with_ids:
                made.append(pa.ListArray.from_arrays(np.cumsum([0, *(r[2] for r in rows)]).astype(np.int32), pa.array(np.concatenate(all_ids).astype(np.int32))))
            names = ["doc_id", *(f.name for f in fields), *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own_row, pa.int64())), *made], names=names)

    return docs.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, sequence of that rank, offset), sorted, for counts of pieces by length.

    The i-th piece after a run's first goes to the i-th sequence after the run's, at the same offset.
    Best fit with the longest pieces first, so it opens as few sequences as that rule can; the
    number of runs depends on lengths and counts of them, not on the number of pieces.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences (first, how many), the newest last
    present = np.zeros(capacity + 1, bool)
    out, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))
            present[gap] = True

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            if (found := present[length:].argmax()) or present[length]:  # the successor of this length among the gaps
                gap = length + int(found)
                first, n = gaps[gap].pop()
                present[gap] = bool(gaps[gap])
            else:
                gap = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)  # so many sequences take each pieces of this length
            for j in range(each if full else 0):
                out.append((length, rank, first, capacity - gap + j * length))
                rank += full
            left -= full * each
            leave(gap - each * length, first, full)
            first, n = first + full, n - full
            if n and 0 < left < each:  # the next sequence takes the few that are left
                for j in range(left):
                    out.append((length, rank, first, capacity - gap + j * length))
                    rank += 1
                leave(gap - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            leave(gap, first, n)
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (any columns, among them doc_id, piece, length) with sequence_id and offset.

    Lengths from 1 to capacity. Ranks among equal lengths go by doc_id and piece, nulls first; rows
    that agree in those are ranked in any order. No pieces give no rows.
    """
    scratch = Scratch(spark, "pack")
    own = scratch.cut(pieces.drop("sequence_id", "offset"), "pieces")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = own.repartitionByRange(n, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    placed = scratch.cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    scratch.drop("pieces")
    part = F.shiftright("_at", 33)
    by_part = placed.groupBy(part.alias("p")).count().collect()  # a row for each partition
    counts = {r[0]: r[1] for r in placed.groupBy("length").count().collect()}  # at most capacity rows
    before_part, total = {}, 0
    for p, k in sorted((r[0], r[1]) for r in by_part):
        before_part[p], total = total, total + k
    before_length, total = np.zeros(capacity + 2, np.int64), 0
    for length in range(capacity + 1):
        before_length[length], total = total, total + counts.get(length, 0)
    runs = best_fit_runs(counts, capacity)
    parts = np.array(sorted(before_part), np.int64)
    starts = np.array([before_part[p] for p in parts.tolist()], np.int64)
    names = [c for c in placed.columns if c != "_at"]
    state = spark.sparkContext.broadcast((runs, parts, starts, before_length))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, parts, starts, before_length = state.value
        keys = (runs[:, 0] << 45) | runs[:, 1]
        for batch in batches:
            at = batch.column("_at").to_numpy()
            length = batch.column("length").to_numpy()
            rank = starts[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1)) - before_length[length]
            run = np.searchsorted(keys, (length << 45) | rank, "right") - 1
            sequence = runs[run, 2] + rank - runs[run, 1]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(runs[run, 3])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in names)
    return placed.mapInArrow(sweep, fields + ", sequence_id long, offset long")
