"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within 4 bits agree in at least two of six bit ranges, so those that share a pair of ranges
meet in a bucket; very large buckets are split in the same way by their other bits. Within buckets, bit planes are stored vertically: a word holds one bit of 64
fingerprints, and 64 distances grow at once in carry-save counters of three bits and an overflow; after
every eight planes, words in which all distances exceed the radius are abandoned. Equal fingerprints
count once, and a bucket gives each fingerprint one link to a smaller one of its group at most, not
all its pairs. Components of the links are groups.

Texts of several fingerprints meet with all of them: of eight ranges of a fingerprint two within 7 bits agree in one, so every pair that
is close in any fingerprint meets in a bucket, is compared there over all bits, and is linked there or over others of the same bucket.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import HOT_KEYS, Scratch, begin, byte_views, components, give_back, join_by_hot_key

SHINGLE, RADIUS, SEED = 4, 4, 42

#: Bits of the six ranges; any two fingerprints within four bits agree in two of them.
RANGES = (11, 11, 11, 11, 10, 10)

#: Words of 64 fingerprints that are compared at a time, and rows that a task holds before it compares.
WORDS_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 200_000

#: A bucket is split by its other bits if one in COUNTED of its rows, which are dealt by hash, are over 1 / COUNTED of this many, or of
#: 1 / HOT_KEYS of all rows where that is more. So there are 15 * HOT_KEYS such buckets at most.
SPLIT_FROM, COUNTED = 50_000, 16


#: Most bits of a candidate fingerprint and its eight ranges; any two fingerprints within that many bits agree in one of them. A bucket of over
#: PARTED_FROM rows is compared in eight parts, by ranges of its other bits, one of which such fingerprints share again. Pairs that are verified at a time.
WIDE_RADIUS, WIDE_RANGES, PARTED_FROM, PAIRS_AT_ONCE = 7, 8, 4096, 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE, n: int = 1) -> list[int]:
    """n fingerprints of a text in UTF-8, as signed 64-bit integers; those after the first are of the shingles' hashes mixed anew."""
    words = text.lower().split()  # of bytes: A-Z and ASCII blanks
    if not words:
        return [0] * n
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())])  # noqa: B905  as many as there are ends
    hashes, out = np.frombuffer(raw, ">u8"), []
    for i in range(n):
        h = hashes if i == 0 else _mixed(hashes.astype(np.uint64), i).astype(">u8")
        counts = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.uint32)
        out.append(struct.unpack(">q", np.packbits(counts * 2 > len(h)).tobytes())[0])
    return out


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The hashes as if of another seed."""
    h = h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, n: int = 1) -> DataFrame:
    """doc_id, fp and fps (all n of them) of each row; null as empty, whose fingerprints are 0. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            found = [fingerprint(x, shingle, n) for x in byte_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "fp", "fps"])
        give_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, fps array<long>")


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is above radius, or that overflowed."""
    above, equal = over.copy(), ~over
    for bit in (2, 1, 0):
        if radius >> bit & 1:
            equal &= counters[bit]
        else:
            above |= equal & counters[bit]
            equal &= ~counters[bit]
    return above


def close_pairs(fps: np.ndarray, end: np.ndarray, radius: int = RADIUS, at_once: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j with j < end[i] whose fingerprints (unsigned 64 bits) differ in radius bits (7 at most) or fewer."""
    n = len(fps)
    bits = np.zeros((64 * -(-n // 64), 64), np.uint8)
    bits[:n] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    lane = np.arange(n)
    first, last = (lane + 1) >> 6, (end - 1) >> 6
    words = np.where(end > lane + 1, last - first + 1, 0)
    before = np.concatenate([[0], np.cumsum(words)])
    all_ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    at_once = at_once or WORDS_AT_ONCE
    for begin in range(0, int(before[-1]), at_once):
        block = np.arange(begin, min(begin + at_once, int(before[-1])))
        q = np.searchsorted(before, block, "right") - 1
        w = first[q] + block - before[q]
        low = np.clip(q + 1 - 64 * w, 0, 64)
        high = np.clip(end[q] - 64 * w, 0, 64)
        lanes = np.where(high >= 64, all_ones, (np.uint64(1) << np.minimum(high, 63).astype(np.uint64)) - np.uint64(1))
        alive = lanes & ~((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1))
        mine = fps[q]
        counters, over = [np.zeros(len(q), np.uint64) for _ in range(3)], np.zeros(len(q), np.uint64)
        for plane in range(64):
            differ = planes[plane][w] ^ (np.uint64(0) - (mine >> np.uint64(63 - plane) & np.uint64(1)))
            for c in counters:
                carry = c & differ
                c ^= differ
                differ = carry
            over |= differ
            if plane % 8 == 7:
                alive &= ~_exceeds(counters, over, radius)
                if not (live := alive != 0).all():
                    q, w, mine, alive, over = q[live], w[live], mine[live], alive[live], over[live]
                    counters = [c[live] for c in counters]
                if not len(q):
                    break
        if len(q):
            found, at = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[found], 64 * w[found] + at


def _ends(bucket: np.ndarray) -> np.ndarray:
    """Where the bucket of each row ends."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    return np.repeat(np.append(edge, len(bucket)), np.diff(np.concatenate([[0], edge, [len(bucket)]])))


def _least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that pairs connect to a smaller one, and the smallest that each is connected with."""
    label = np.arange(n)
    for i, j in pairs:
        while (label[i] != label[j]).any():
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
    while (label[label] != label).any():
        label = label[label]
    tied = np.flatnonzero(label != np.arange(n))
    return tied, label[tied]


def bucket_links(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket: pairs of rows, links that connect all that are close within a bucket."""
    return _least_labels(len(fps), close_pairs(fps, _ends(bucket), radius))


def _verified(fps: np.ndarray, every: np.ndarray, end: np.ndarray, radius: int, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those close pairs that differ in most_bits of all their fingerprints (rows of every) or fewer."""
    for i, j in close_pairs(fps, end, radius, PAIRS_AT_ONCE >> 4):
        for at in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
            near = np.bitwise_count(every[a] ^ every[b]).sum(axis=1, dtype=np.int64) <= most_bits
            yield a[near], b[near]


def verified_links(t: np.ndarray, bucket: np.ndarray, every: np.ndarray, radius: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket, of kind t: links that connect all rows of a bucket whose fingerprint of the bucket's kind is within radius and all of which, the rows of every, are within most_bits."""
    kind, byte = np.divmod(t, WIDE_RANGES)
    fps = every[np.arange(len(t)), kind]
    end = _ends(bucket)
    large = end - np.searchsorted(bucket, bucket) > PARTED_FROM
    few, many = np.flatnonzero(~large), np.flatnonzero(large)
    found = [tuple(few[x] for x in _least_labels(len(few), _verified(fps[few], every[few], _ends(bucket[few]), radius, most_bits)))] if len(few) else []
    for part in range(WIDE_RANGES if len(many) else 0):
        own = fps[many] & _WIDE_PARTS[byte[many], part]
        order = np.lexsort((own, bucket[many]))  # a stable sort, so the smallest row of a group stays first
        rows, own = many[order], own[order]
        of = np.cumsum(np.concatenate([[True], (np.diff(bucket[rows]) != 0) | (own[1:] != own[:-1])]))
        found.append(tuple(rows[x] for x in _least_labels(len(rows), _verified(fps[rows], every[rows], _ends(of), radius, most_bits))))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _pairs(bits: list[int], sizes: tuple[int, ...]) -> list[int]:
    """Masks of any two of the ranges that sizes make of bits."""
    ranges, at = [], 0
    for size in sizes:
        ranges.append(sum(1 << b for b in bits[at : at + size]))
        at += size
    return [a | b for a, b in combinations(ranges, 2)]


def _masks() -> list[int]:
    return _pairs(list(range(64)), RANGES)


def _finer(mask: int) -> list[int]:
    """Masks of a bucket's parts: its own bits and two of six ranges of the others, two of which fingerprints within four bits share again."""
    rest = [b for b in range(64) if not mask >> b & 1]
    n = len(rest)
    return [mask | m for m in _pairs(rest, tuple(n * (i + 1) // 6 - n * i // 6 for i in range(6)))]


#: For each range of eight bits, counted from the lowest, eight ranges of the other 56 bits as masks.
_WIDE_PARTS = np.array([[sum(1 << b for b in [b for b in range(64) if b >> 3 != r][7 * p : 7 * p + 7]) for p in range(WIDE_RANGES)] for r in range(WIDE_RANGES)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """i, a, b: links between close fingerprints of one i of distinct (columns i and fp, each once) that connect what is close.

    Buckets with very many fingerprints are split into 15 by their other bits; that is as whole, so how they are counted matters for balance only.
    """
    masks = _masks()
    kinds = len(masks) * (1 + len(masks))  # buckets and their parts
    keys = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for j, m in enumerate(masks)])
    buckets = lambda df: df.select("i", "fp", F.explode(keys).alias("x")).select("i", "x.j", "x.k", "fp")
    most = max(SPLIT_FROM, distinct.count() // HOT_KEYS)
    counted = buckets(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0)).groupBy("i", "j", "k").count()
    hot = counted.where(F.col("count") * COUNTED > most).select("i", "j", "k", F.lit(True).alias("hot"))
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in _finer(mask)]) for mask in masks])
    parts = F.transform(F.get(finer, F.col("j")), lambda m, s: F.struct(((F.col("j") + 1) * len(masks) + s).alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    whole = F.array(F.struct(F.col("j").alias("t"), F.col("k").alias("k")))
    rows = buckets(distinct).join(F.broadcast(hot), ["i", "j", "k"], "left").select("i", "fp", F.explode(F.when(F.col("hot"), parts).otherwise(whole)).alias("x"))
    rows = rows.select((F.col("i") * kinds + F.col("x.t")).cast("int").alias("t"), "x.k", "fp").repartition("t", "k").sortWithinPartitions("t", "k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_rows = 0  # of a bucket that goes on, which wait for as many new rows again

        def compared(last: bool) -> Iterator[pa.RecordBatch]:
            t, k, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            changes = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            cut = len(t) if last else int(np.flatnonzero(changes)[-1])  # the last bucket may go on
            held[:] = [(t[cut:], k[cut:], fp[cut:])]
            if cut:
                a, b = bucket_links(np.cumsum(changes[:cut]), fp[:cut].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array((t[a] // kinds).astype(np.int32)), pa.array(fp[a]), pa.array(fp[b])], names=["i", "a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("t", "k", "fp")))
            if sum(len(x[0]) for x in held) >= max(ROWS_AT_ONCE, 2 * open_rows):
                yield from compared(False)
                open_rows = len(held[0][0])
        if sum(len(x[0]) for x in held):
            yield from compared(True)

    return rows.mapInArrow(run, "i int, a long, b long").distinct()


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, n: int = 1, most_bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest id reachable over fingerprints within radius bits).

    With n above 1 each text has n independent fingerprints and two texts are linked if any of them are close, so that fewer near
    copies are missed. With most_bits, two texts are linked if any are close and all n fingerprints together differ in so many bits or fewer: all 64 * n
    bits tell similarities apart far better than one fingerprint does, so radius may then be up to 7. No such pair is left out, of texts in one bucket either. Texts without words have fingerprint 0 and link like any other. A null id takes part but is a component's id
    only where it has no other. Rows with one id each have their own fingerprint. No rows give no rows.
    """
    if radius > (RADIUS if most_bits is None else WIDE_RADIUS) or (most_bits is not None and n == 1):
        raise ValueError("the ranges find all fingerprints within 4 bits only")
    scratch = Scratch(spark, "simhash")
    made = fingerprints(docs, id_col, text_col, shingle, n)
    own = scratch.cut(made.drop("fps") if n == 1 else made, "fingerprints")
    key = "fp" if n == 1 else "fps"
    distinct = scratch.cut(own.groupBy(key).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(scratch, links(distinct.select(F.lit(0).alias("i"), "fp"), radius).drop("i") if n == 1 else _links_of_any(scratch, distinct.select("fps"), radius) if most_bits is None else _links_of_all(distinct.select("fps"), n, radius, most_bits))
    named = distinct.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = scratch.cut(named.join(ids, "root").select(key, "component_id", "n"), "components")
    total = own.count()
    return join_by_hot_key(own, by_fp, [key], "n", total).select("doc_id", "fp", "component_id")


def _links_of_any(scratch: Scratch, distinct: DataFrame, radius: int) -> DataFrame:
    """Links between lists of fingerprints (column fps, each once) of which any are close: those that share one, then close ones by their least lists."""
    of = distinct.select("fps", F.posexplode("fps").alias("i", "fp"))
    least = scratch.cut(of.groupBy("i", "fp").agg(F.min("fps").alias("least"), F.count("*").alias("n")), "least")
    shared = of.join(least.where("n > 1"), ["i", "fp"]).select(F.col("fps").alias("a"), F.col("least").alias("b"))
    close = links(least.select("i", "fp"), radius)
    for c in ("a", "b"):
        close = close.join(least.select("i", F.col("fp").alias(c), F.col("least").alias(f"l{c}")), ["i", c])
    return shared.unionByName(close.select(F.col("la").alias("a"), F.col("lb").alias("b")))


def _links_of_all(distinct: DataFrame, n: int, radius: int, most_bits: int) -> DataFrame:
    """Links that connect lists of n fingerprints (column fps, each once) of which any are within radius and all within most_bits, none left out.

    A list goes to a bucket for each range of each fingerprint, with all its bits, so that a pair is verified where it meets. Rows of a bucket
    are held until it ends: 1/256 of all, or so.
    """
    each = [f"f{i}" for i in range(n)]
    keys = F.array(*[F.struct(F.lit(i * WIDE_RANGES + r).alias("t"), F.shiftrightunsigned(F.col(f"f{i}"), 8 * r).bitwiseAND(F.lit(255)).cast("int").alias("k")) for i in range(n) for r in range(WIDE_RANGES)])
    wide = distinct.select(*[F.col("fps")[i].alias(c) for i, c in enumerate(each)])
    rows = wide.select(*each, F.explode(keys).alias("x")).select("x.t", "x.k", *each).repartition("t", "k").sortWithinPartitions("t", "k", *each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_rows = 0  # of a bucket that goes on, which wait for as many new rows again

        def compared(last: bool) -> pa.RecordBatch:
            t, k, every = (np.concatenate(x) for x in zip(*held, strict=True))
            changes = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            cut = len(t) if last else int(np.flatnonzero(changes)[-1])  # the last bucket may go on
            held[:] = [(t[cut:].copy(), k[cut:].copy(), every[cut:].copy())]
            a, b = verified_links(t[:cut], np.cumsum(changes[:cut]), every[:cut], radius, most_bits)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(x) + 1, n, np.int32)), pa.array(every[x].view(np.int64).ravel())) for x in (a, b)]
            return pa.RecordBatch.from_arrays(lists, names=["a", "b"])

        for batch in batches:
            held.append((batch.column("t").to_numpy(), batch.column("k").to_numpy(), np.stack([batch.column(c).to_numpy() for c in each], axis=1).view(np.uint64)))
            if sum(len(x[0]) for x in held) >= max(ROWS_AT_ONCE, 2 * open_rows):
                yield compared(False)
                open_rows = len(held[0][0])
        if sum(len(x[0]) for x in held):
            yield compared(True)
        held.clear()
        give_back()

    return rows.mapInArrow(run, "a array<long>, b array<long>").distinct()
