"""Removal of long repeated byte strings, by suffix arrays over shards.

A string of LENGTH bytes that starts at two places has the same anchor at both: the least hash of a 64-gram in
it, leftmost of equals. So each document's possible starts are parted among anchors, and only anchors that
occur at two places or more of distinct texts matter; exact copies of a whole text count as one there and
are told by their counts. Anchors go to shards by hash, each occurrence with the bytes that strings from
its starts span. A shard sorts its suffixes by Larsson-Sadakane refinement to LENGTH bytes (numpy)
and has common prefixes by Kasai's rule, in many stretches of text at once; starts whose neighbour in
suffix order shares LENGTH bytes repeat. An anchor with too many occurrences is dealt to several
shards by its bytes. What is distinct in these is merged across shards: each gives the digests (128 bits of BLAKE2b) of its
strings in sorted blocks, one for each range of digests, and blocks of a range are searched in each other by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import Scratch, begin, byte_views, join_by_hot_key

#: Bytes of a repeated string; bytes of an anchor's gram; bytes that a shard is to hold.
LENGTH, GRAM, SHARD_BYTES = 400, 64, 3_000_000

#: Digests that are merged in one task, of an anchor that is dealt to several shards.
MERGED_AT_ONCE = 200_000

#: Bytes of texts that are scanned at a time, and of a piece in which longer texts are scanned (2^24 at most, as places in it take 24 bits).
SCAN_BYTES, PIECE_BYTES = 1_000_000, 1 << 22

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_STRETCH = 256


def _eights(text: np.ndarray) -> np.ndarray:
    """For each place, the eight bytes from there on as a big-endian number; text needs seven bytes more."""
    n = len(text) - 7
    out = np.empty(-(-n // 8) * 8, np.uint64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    for i in range(8):
        some = padded[i : i + len(out)].view(">u8")
        out[i::8] = some
    return out[:n]


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid one after another, ends being where each ends: document, hash, place, first and last start.

    Places are in the whole; strings don't cross documents. What is longer than a piece is scanned in pieces that overlap by
    length - 1 bytes, so that each string lies in one of them.
    """
    window = length - GRAM + 1
    n = len(text)
    if n > PIECE_BYTES:
        return _anchors_by_pieces(text, ends, length)
    eights = _eights(np.concatenate([text, np.zeros(GRAM + 7, np.uint8)]))
    gram, size = eights, 8
    while size < GRAM:
        gram = (gram[:-size] * _MIX[0]) ^ ((gram[size:] + _MIX[2]) * _MIX[1])
        gram ^= gram >> np.uint64(31)
        size *= 2
    gram = gram[:n] * _MIX[2]
    gram ^= gram >> np.uint64(29)
    ordered = (gram & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)  # 40 bits of hash, then the place: leftmost of equals
    rows = -(-(n + window) // window)
    padded = np.full(rows * window, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:n] = ordered
    grid = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[window - 1 : n + window - 1]) & np.uint64(0xFFFFFF)
    document = np.searchsorted(ends, np.arange(n), "right")
    valid = np.flatnonzero(np.arange(n) + length <= ends[document])
    if not valid.size:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at, doc = least[valid].astype(np.int64), document[valid]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return doc[first], gram[at[first]].view(np.int64), at[first], valid[first], valid[last]


def _anchors_by_pieces(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    step = PIECE_BYTES - length + 1
    pieces = []
    for base in range(0, len(text), step):
        piece = text[base : base + PIECE_BYTES]
        doc, h, at, lo, hi = anchors(piece, np.clip(ends - base, 0, len(piece)), length)
        pieces.append((doc, h, at + base, lo + base, hi + base))
    doc, h, at, lo, hi = (np.concatenate(x) for x in zip(*pieces, strict=True))
    # Starts of one anchor on both sides of a border are one run.
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])[: len(doc)])
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], h[first], at[first], lo[first], hi[last]


def suffix_order(eights: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the depth bytes from them on, and which tie with the one before: Larsson-Sadakane refinement.

    Suffixes are sorted by eight bytes; then groups that are still tied are sorted by the rank of the
    suffix that follows what is known of them, which doubles that each time.
    """
    n = len(eights)
    order = np.argsort(eights)
    known = eights[order]
    new = np.concatenate([[True], known[1:] != known[:-1]])
    h = 8
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    while True:
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, n))
        rank[order] = np.repeat(group, sizes)
        if h >= depth:
            return order, ~new
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not at.size:
            return order, ~new
        step = min(h, depth - h)
        some = order[at]
        key = rank[some] * (n + 1) + rank[some + step] + 1
        by = np.argsort(key)
        order[at] = some[by]
        key = key[by]
        new[at[1:]] = key[1:] != key[:-1]
        new[at[0]] = True
        h += step


def common_prefixes(eights: np.ndarray, order: np.ndarray, tied: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each rank, the bytes that the suffix shares with the one before it, depth at most: Kasai's rule.

    The text is cut into stretches that go forward together; in each, a place's prefix is at least
    that of the place before it, less one. That holds where the order is known, so not after a tie: ties
    share depth bytes, and the place after one starts anew.
    """
    n = len(order)
    before, tie = np.full(n, -1, np.int64), np.empty(n, bool)
    before[order[1:]] = order[:-1]
    tie[order] = tied
    wide = np.concatenate([eights, np.arange(depth + 8, dtype=np.uint64)])
    prefix = np.zeros(n, np.int16)
    stretch = np.arange(0, n, _STRETCH)
    have = np.zeros(len(stretch), np.int64)
    for j in range(_STRETCH):
        if j:
            keep = stretch + j < n
            stretch, have = stretch[keep], have[keep]
        place = stretch + j
        other, same = before[place], tie[place]
        have = np.where(same, depth, np.where((other < 0) | (have == depth), 0, np.maximum(have - 1, 0)))
        going = np.flatnonzero((other >= 0) & ~same)
        while going.size:
            differ = wide[place[going] + have[going]] ^ wide[other[going] + have[going]]
            whole = differ == 0
            differ &= ~(differ >> np.uint64(1))  # the leading bit stays, and no rounding reaches the next power of two
            have[going] += np.where(whole, 8, 8 - ((np.frexp(differ.astype(np.float64))[1] + 7) >> 3))
            going = going[whole & (have[going] < depth)]
        have = np.where(same, depth, np.minimum(have, depth - 1))  # no tie, so less than depth
        prefix[place] = have
    return prefix[order]


def _digests(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A digest of the length bytes from each start."""
    view = memoryview(text.tobytes())
    return np.array([blake2b(view[a : a + length], digest_size=16).digest() for a in starts.tolist()], "S16")


def common_digests(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Which digests of each block (sorted, each once) are in another block too: blocks are searched in what those before them hold."""
    every, again = blocks[0], np.zeros(len(blocks[0]), bool)
    for block in blocks[1:]:
        at = np.searchsorted(every, block)
        found = every[np.minimum(at, len(every) - 1)] == block if len(every) else np.zeros(len(block), bool)
        again[at[found]] = True
        every, again = np.insert(every, at[~found], block[~found]), np.insert(again, at[~found], False)
    return [again[np.searchsorted(every, block)] for block in blocks]


def repeated_starts(segments: list[bytes], owned: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over segments, of whose starts the first owned[i] count: which starts repeat another's length bytes.

    Returns, for all counted starts in order: the place in the whole, whether it repeats, and
    whether it is the first of its string in suffix order.
    """
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    text = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ahead = np.cumsum(sizes) - sizes
    counted = np.zeros(len(text), bool)
    n_owned = np.array(owned, np.int64)
    places = np.repeat(ahead - np.concatenate([[0], np.cumsum(n_owned)[:-1]]), n_owned) + np.arange(n_owned.sum())
    counted[places] = True
    eights = _eights(np.concatenate([text, np.zeros(7, np.uint8)]))
    order, tied = suffix_order(eights, length)
    shared = common_prefixes(eights, order, tied, length)
    at = np.flatnonzero(counted[order])
    between = np.minimum.reduceat(shared, at[:-1] + 1) if len(at) > 1 else np.zeros(0, np.int16)
    if len(at) > 1:  # reduceat's last run goes to the end
        between[-1] = shared[at[-2] + 1 : at[-1] + 1].min()
    same = between >= length
    repeats, first = np.zeros(len(text), bool), np.ones(len(text), bool)
    repeats[order[at[1:][same]]] = True
    repeats[order[at[:-1][same]]] = True
    first[order[at[1:][same]]] = False
    return places, repeats[places], first[places]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in a sorted array."""
    if not len(values):
        return values, values
    cut = np.flatnonzero(np.diff(values) != 1) + 1
    return values[np.concatenate([[0], cut])], values[np.append(cut, len(values)) - 1]


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """_h, _k1, _id, _at, _lo, _hi of each anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix dedup")
        for batch in batches:
            ids, marks = batch.column("_id"), batch.column("_k1")
            held, size, done = [], 0, 0
            rows = list(byte_views(batch.column("_text")))
            for i, raw in enumerate(rows):
                held.append(raw)
                size += len(raw)
                if size >= SCAN_BYTES or i == len(rows) - 1:
                    ends = np.cumsum([len(x) for x in held])
                    doc, h, at, lo, hi = anchors(np.frombuffer(b"".join(held), np.uint8), ends, length)
                    base = np.concatenate([[0], ends])[doc]
                    take = pa.array(doc + done)
                    columns = [pa.array(h), marks.take(take), ids.take(take), *(pa.array((x - base).astype(np.int32)) for x in (at, lo, hi))]
                    yield pa.RecordBatch.from_arrays(columns, names=["_h", "_k1", "_id", "_at", "_lo", "_hi"])
                    held, size, done = [], 0, i + 1

    return texts.select("_id", "_k1", "_text").mapInArrow(run, f"_h long, _k1 long, _id {texts.schema['_id'].dataType.simpleString()}, _at int, _lo int, _hi int")


def repeated_intervals(scratch: Scratch, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """_id, _k1, _from, _to: runs of starts, in texts (_id, _k1, _text), of strings of length bytes that start elsewhere too.

    Of texts with one _k1, those of the least id stand for all: starts that only copies share are not reported.
    """
    spark = scratch.spark
    id_type = texts.schema["_id"].dataType.simpleString()
    found = scratch.cut(_anchor_rows(texts, length).groupBy("_h", "_k1", "_at").agg(F.min(F.struct("_id", "_lo", "_hi")).alias("_x")).select("_h", "_k1", "_at", "_x.*"), "anchors")
    again = scratch.cut(found.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1"), "again")
    total, n_rows, n_seen = found.count(), *again.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    each = 2 * length  # bytes an occurrence spans at most
    most = max(64, SHARD_BYTES // each)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_seen * each // SHARD_BYTES))
    parts = F.ceil(F.col("_n") / most).cast("int")
    n_dealt = again.where(F.col("_n") > most).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    ranges = max(1, n_dealt * (length - GRAM + 1) // MERGED_AT_ONCE)
    wanted = join_by_hot_key(found, again, ["_h"], "_n", total).select("_id", "_k1", F.struct(F.col("_h").alias("h"), parts.alias("parts"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).alias("_x"))
    lists = wanted.groupBy(F.col("_id").alias("_i"), F.col("_k1").alias("_m")).agg(F.collect_list("_x").alias("_xs"))
    cut_from = texts.join(lists, texts["_id"].eqNullSafe(lists["_i"]) & (texts["_k1"] == lists["_m"])).select("_id", "_k1", "_text", "_xs")

    names = ["shard", "split", "copied", "_id", "_k1", "lo", "hi", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments of each text. One that a text or this task has several times goes to its shard twice at most, or once and marked as copied; the others' starts, which then repeat for sure, are runs without bytes."""
        settled: dict[tuple[bytes, int], bool] = {}
        for batch in batches:
            for i, raw in enumerate(byte_views(batch.column("_text"))):
                x = batch.column("_xs")[i].values
                h, parts, lo, hi = (x.field(c).to_pylist() for c in ("h", "parts", "lo", "hi"))
                own: dict[tuple[bytes, int], list[int]] = {}
                for j, (a, b) in enumerate(zip(lo, hi, strict=True)):
                    own.setdefault((raw[a : b + length], b - a), []).append(j)
                rows, known = [], []
                for (piece, width), js in own.items():
                    digest, j = blake2b(piece, digest_size=16).digest(), js[0]
                    before = settled.get((digest, width))
                    if before or len(js) > 1:
                        known += js
                    if not before:
                        settled[digest, width] = before is not None or len(js) > 1
                        part = int.from_bytes(digest[:8]) % parts[j] if parts[j] > 1 else 0
                        shard = ((h[j] + part * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 32 & 0xFFFFFFFF) % shards
                        rows.append((shard, parts[j] > 1, len(js) > 1, lo[j], hi[j], piece))
                runs = union_of(np.array([lo[j] for j in known], np.int64), np.array([hi[j] + 1 for j in known], np.int64))
                rows += [(i % shards, False, False, a, b - 1, None) for a, b in runs]
                same = pa.array([i] * len(rows), pa.int32())
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*made[:3], batch.column("_id").take(same), batch.column("_k1").take(same), *made[3:]], names=names)

    segments = cut_from.mapInArrow(cut, f"shard int, split boolean, copied boolean, _id {id_type}, _k1 long, lo int, hi int, bytes binary")
    block_fields = [("range", pa.int32()), ("digests", pa.binary()), ("segments", pa.binary()), ("starts", pa.binary())]

    def blocks(ids: pa.Array, marks: pa.Array, row: np.ndarray, start: np.ndarray, digest: np.ndarray) -> pa.Table:
        """A row for each range that has digests: those, sorted, and for each the number of its row, in lists of their own, and its start."""
        number = (digest.astype("S4").view(">u4").astype(np.int64) * ranges) >> 32
        order = np.argsort(digest)
        number, row, start, digest = number[order], row[order], start[order], digest[order]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        made, takes = [], []
        for a, b in zip(first.tolist(), np.append(first[1:], len(number)).tolist(), strict=False):
            rows, at = np.unique(row[a:b], return_inverse=True)
            takes.append(rows)
            made.append((int(number[a]), digest[a:b].tobytes(), at.astype(np.int32).tobytes(), start[a:b].astype(np.int32).tobytes()))
        take = np.concatenate([*takes, np.zeros(0, np.int64)]).astype(np.int64)
        ends = pa.array(np.cumsum([0, *map(len, takes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(take))) for x in (ids, marks)]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*made, strict=True) if made else [[]] * 4, block_fields, strict=True)]
        return pa.table([*columns, *lists], names=[*(n for n, _ in block_fields), "ids", "marks"])

    def sort(table: pa.Table) -> pa.Table:
        begin("suffix dedup")
        table = table.combine_chunks()
        known = table.filter(table.column("bytes").is_null()).select(["_id", "_k1", "lo", "hi"])
        table = table.filter(table.column("bytes").is_valid())
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        owned = (hi - lo + 1).astype(np.int64)
        seen: dict[tuple[bytes, int], int] = {}  # equal segments are sorted once: all starts of such a one repeat
        which = np.fromiter((seen.setdefault(x, len(seen)) for x in zip(table.column("bytes").to_pylist(), owned.tolist(), strict=True)), np.int64, len(lo))
        copies = np.bincount(which)
        np.add.at(copies, which, np.array(table.column("copied").to_pylist(), np.int64))
        row_of = np.unique(which, return_index=True)[1]
        pieces, own = [x[0] for x in seen], owned[row_of]
        places, repeats, first = repeated_starts(pieces, own.tolist(), length)
        segment = np.repeat(np.arange(len(own)), own)
        row = row_of[segment]
        start = np.arange(len(places)) - np.repeat(np.cumsum(own) - own, own) + lo[row]
        a, b = _runs(((row << 32) + start)[repeats & (copies[segment] == 1)])  # runs don't cross rows
        many = np.flatnonzero(copies[which] > 1)
        out = [np.concatenate(x) for x in ((a >> 32, many), (a & 0xFFFFFFFF, lo[many]), (b & 0xFFFFFFFF, hi[many]))]
        take = pa.array(out[0])
        ids, marks = table.column("_id").combine_chunks(), table.column("_k1").combine_chunks()
        runs = pa.table([ids.take(take), marks.take(take), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32))], names=["_id", "_k1", "_from", "_to"])
        given = np.array(table.column("split").to_pylist(), bool)[row] & first
        digest = _digests(np.frombuffer(b"".join(pieces), np.uint8), places[given], length) if given.any() else np.zeros(0, "S16")
        return pa.concat_tables([runs, known.rename_columns(["_id", "_k1", "_from", "_to"]), blocks(ids, marks, row[given], start[given], digest)], promote_options="default")

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        digests = [np.frombuffer(x, "S16") for x in table.column("digests").to_pylist()]
        made = []
        for i, again in enumerate(common_digests(digests)):
            row, start = (np.frombuffer(table.column(c)[i].as_py(), np.int32).astype(np.int64)[again] for c in ("segments", "starts"))
            a, b = _runs(np.sort((row << 32) + start))
            take = pa.array(a >> 32)
            made.append(pa.table([table.column("ids")[i].values.take(take), table.column("marks")[i].values.take(take), pa.array((a & 0xFFFFFFFF).astype(np.int32)), pa.array((b & 0xFFFFFFFF).astype(np.int32))], names=["_id", "_k1", "_from", "_to"]))
        return pa.concat_tables(made)

    runs = f"_id {id_type}, _k1 long, _from int, _to int"
    sorted_ = scratch.cut(segments.groupBy("shard").applyInArrow(sort, f"{runs}, range int, digests binary, segments binary, starts binary, ids array<{id_type}>, marks array<long>"), "sorted")
    scratch.drop("anchors")
    merged = sorted_.where("range IS NOT NULL").select("range", "digests", "segments", "starts", "ids", "marks").groupBy("range").applyInArrow(merge, runs)
    return sorted_.where("range IS NULL").select("_id", "_k1", "_from", "_to").unionByName(merged)


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (start and length of each removed run) and kept (the remaining bytes).

    Texts are UTF-8 bytes, null as empty. A byte goes if a string of length bytes that covers it also starts elsewhere, in the
    same document (overlaps count) or another; all occurrences go. So texts that have a copy go whole, if that long.
    as_text: kept is a string and spans are narrowed to whole characters. Columns of docs with those names are
    replaced. Rows may share ids or have none.
    """
    scratch = Scratch(spark, "suffix")
    out = docs.drop("n_bytes", "n_removed", "n_spans", "spans", "kept", "_k1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = out.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2"), text.alias("_text"))
    alone = texts.groupBy("_k1", "_k2").agg(F.min("_id").alias("_i"), F.count("*").alias("_n")).where("_n = 1").select("_i", F.col("_k1").alias("_m"))
    runs = repeated_intervals(scratch, texts, length)
    lists = runs.groupBy(F.col("_id").alias("_j"), F.col("_k1").alias("_l")).agg(F.collect_list(F.struct("_from", "_to")).alias("_runs"))
    known = alone.join(lists, alone["_i"].eqNullSafe(lists["_j"]) & (alone["_m"] == lists["_l"]), "left").select("_i", "_m", F.coalesce("_runs", F.array().cast("array<struct<_from:int,_to:int>>")).alias("_runs"))
    marked = out.withColumn("_k1", F.xxhash64(text))
    joined = marked.join(known, marked[id_col].eqNullSafe(known["_i"]) & (marked["_k1"] == known["_m"]), "left").select(*out.columns, "_runs")
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, raw in enumerate(byte_views(batch.column(text_col))):
                runs = batch.column("_runs")[i]
                if not runs.is_valid:  # it has copies
                    spans = [(0, len(raw))] if len(raw) >= length else []
                else:
                    x = runs.values
                    spans = union_of(x.field("_from").to_numpy(), x.field("_to").to_numpy() + length)
                if as_text:
                    spans = whole_characters(raw, spans)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                made.append((len(raw), len(raw) - len(kept), len(spans), [{"start": a, "length": b - a} for a, b in spans], kept.decode() if as_text else kept))
            types = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string() if as_text else pa.binary()]
            columns = zip(*made, strict=True) if made else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*names, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return joined.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,length:long>>, kept {'string' if as_text else 'binary'}")


def union_of(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that intervals cover together, in order; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends; spans within one character vanish."""
    out = []
    for a, b in spans:
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


