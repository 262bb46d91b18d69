"""Byte-level BPE: Spark higher-order functions fold ranked merges over the byte arrays of distinct words.

Words that are common are folded once and for all tasks (common_words); they are a bounded table that tasks know from the start. All else is
one stage without a shuffle, in three steps a row at a time. Python cuts texts into words and sends a block of
documents as word numbers, with the bytes of those words that are new in its task; Spark
folds the merges over these words, against a literal map of ranks; Python puts the documents' ids together from
the numbers, and their pieces' bytes from the ids. Both Python steps of a task see the same blocks in the same order, so
both know the words sent before; after MOST_WORDS beyond the common ones the task starts a new list. Blocks are small, for
memory: a block's words are a row, eight bytes for each of their bytes.

The rank map is a literal table of pairs of ids and the ranks of their pieces' joined bytes, in which a pair has two places
to be looked for. A fold's state is the ids of
a word's pieces and the ranks of neighbours; a step merges the leftmost pair of least rank and looks up
its two new neighbours, so a word of n bytes takes at most 2n lookups.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import give_back
from noticeflow.llm.tokens import spaced_chunks

_BLANK = regex.compile(r"\s")

#: Bits of a rank, and the rank of pairs that don't merge.
RANK_BITS, NONE = 19, (1 << 19) - 1

#: A block ends at so many characters or new words, whichever comes first, and a task's list of words starts anew after so many.
BLOCK_CHARS, BLOCK_WORDS, MOST_WORDS = 1_000_000, 8_192, 300_000

#: Words that are folded for all tasks at once, at most, and bytes of one of them, at most. They are counted on an eighth of all texts, or on about so many bytes,
#: whichever is less; inputs of fewer bytes do without. This bears on time only: what is not among them is folded by its task.
COMMON_WORDS, COMMON_BYTES, COUNTED_SHARE, COUNTED_BYTES, COMMON_FROM = 300_000, 64, 8, 50_000_000, 20_000_000

#: Bytes of a word that is folded; places in a word take 24 bits.
LONG_WORD = 1_024


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Each pair of pieces whose bytes together are a piece, with that piece's rank."""
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None:
                out[a, b] = rank
    return out


def rank_table(pairs: dict[tuple[int, int], int]) -> tuple[list[int], int, int]:
    """A table of pairs and their ranks, and its two sizes: key k lies at k % first, or at first + k % second.

    An entry is the key (ids a and b as a << 20 | b), shifted by RANK_BITS, and the rank; -1 is none. An entry whose place is
    taken drives out what is there to its other place.
    """
    first = _prime(max(2, 6 * len(pairs) // 5))
    while True:
        second = _prime(first)
        table = [-1] * (first + second)
        for (a, b), rank in pairs.items():
            entry, at, left = (a << 20 | b) << RANK_BITS | rank, (a << 20 | b) % first, 500
            while entry >= 0 and left:
                entry, table[at] = table[at], entry
                k = entry >> RANK_BITS
                at, left = (first + k % second if at < first else k % first), left - 1
            if entry >= 0:
                break
        else:
            return table, first, second
        first = _prime(first + first // 8)


def _prime(above: int) -> int:
    n = above + 1
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@cache
def _tables(path: str) -> tuple[tuple[str, int], tuple[str, int]]:
    """The two parts of the rank map, as JSON, and their sizes: key k, shifted by RANK_BITS, lies at that number modulo the size. No entry is a number that no key has."""
    ranks = read_ranks(path)
    if max(ranks.values()) >= NONE:
        raise ValueError(f"ranks have to be below {NONE}")
    table, first, second = rank_table(_pairs(path))
    out = []
    for part, size in ((table[:first], first), (table[first:], second)):
        shifted = [1 << 62] * size
        for at, entry in enumerate(part):
            if entry >= 0:
                shifted[(at << RANK_BITS) % size] = entry
        out.append((json.dumps(shifted, separators=(",", ":")), size))
    return out[0], out[1]


@cache
def _first_states(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id of each single byte; the rank of each two bytes."""
    ranks = read_ranks(path)
    single = [ranks[bytes([i])] for i in range(256)]
    return np.array(single, np.int64), np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int64)


def first_states(words: list[bytes], path: str) -> pa.Array:
    """For each word the state that its fold starts from: its bytes as pieces, with places and ranks of neighbours; a word that is a piece is that one piece."""
    (single, double), ranks = _first_states(path), read_ranks(path)
    whole = [(i, ranks[w]) for i, w in enumerate(words) if len(w) > 1 and w in ranks]
    for i, _ in whole:
        words[i] = words[i][:1]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    near = np.append(double[text[:-1] * 256 + text[1:]], NONE)[: len(text)]
    near[ends - 1] = NONE  # no word is empty
    place = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    pieces = single[text]
    for i, rank in whole:
        pieces[ends[i] - 1] = rank
    return pa.ListArray.from_arrays(np.append([0], ends).astype(np.int32), pa.array((near << 44) | (place << 20) | pieces))


def _bind(value: Column, body) -> Column:
    """body of a value that is computed once: expressions within lambdas are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(words: Column, path: str) -> Column:
    """The pieces of each word in an array of words, a word being its first state; a piece's id is its lowest 20 bits.

    A fold's state is one array of numbers, for each piece: the rank of merging it with the next one (NONE: they don't
    merge), then its place in the word (24 bits), then its id. So the least number is the leftmost pair
    of least rank, and that rank is the merged piece's id.
    """
    (one, first), (two, second) = _tables(path)
    low, id_bits, place_bits, none = F.lit((1 << 44) - 1), F.lit((1 << 20) - 1).cast("long"), F.lit((1 << 44) - (1 << 20)), NONE << 44
    no_rank = F.lit(NONE).cast("long")

    def literal(made: str) -> Column:
        return F.from_json(F.lit(made), "array<bigint>")  # folded into a literal array when the query is planned

    def of(here: Column, there: Column) -> Column:
        def probe(table: Column, size: int, key: Column, otherwise: Column) -> Column:
            return _bind(F.get(table, (key % size).cast("int")).bitwiseXOR(key), lambda x: F.when(x < no_rank, x).otherwise(otherwise))

        def rank(a: Column, b: Column) -> Column:
            key = F.shiftleft(a, 20 + RANK_BITS) + F.shiftleft(b, RANK_BITS)
            return _bind(key, lambda k: F.shiftleft(probe(here, first, k, probe(there, second, k, no_rank)), 44))

        def merge_at(s: Column, m: Column, p: Column) -> Column:
            own = F.shiftright(m, 44)
            merged = rank(own, F.get(s, p + 1).bitwiseAND(id_bits)) + m.bitwiseAND(place_bits) + own
            alone = F.array_insert(F.array_remove(F.array_remove(s, F.get(s, p)), m), p, merged)  # all numbers in s differ, by their places
            left = lambda x: F.array_insert(F.array_remove(alone, x), p - 1, rank(x.bitwiseAND(id_bits), own) + x.bitwiseAND(low))
            return F.when(p > 1, _bind(F.get(s, p - 2), left)).otherwise(alone)

        def merge(s: Column, _: Column) -> Column:
            place = lambda m: _bind(F.array_position(s, m).cast("int"), lambda p: merge_at(s, m, p))
            return _bind(F.array_min(s), lambda m: F.when(m >= none, s).otherwise(place(m)))

        return F.transform(words, lambda w: F.aggregate(F.slice(w, 2, F.size(w)), w, merge))

    return _bind(literal(one), lambda here: _bind(literal(two), lambda there: of(here, there)))


_BLOCK = "reset boolean, doc_ids array<{id}>, sizes array<int>, numbers binary, words array<array<bigint>>, long_at array<int>, long_words array<binary>"


class _Numbers:
    """The words of a text as 32-bit numbers, which new words get one after another; new has those since it was cleared. The words of common have the first numbers from the start.

    after has what stands between two blanks, with the blank before it, so that most of a text takes one look for each part; None is what
    the cut at blanks may not part. plain has all else.
    """

    def __init__(self, pattern: str, common: pa.Array | None = None):
        self.cut, self.count, self.new = regex.compile(pattern).findall, 0, []
        self.after, self.plain = _Known(self._after), _Known(self._plain)
        self.common = common
        self.start()

    def start(self) -> None:
        """A new list, which has the common words only."""
        self.forget()
        for word in [] if self.common is None else self.common.to_pylist():
            table, key = self._place(word)
            table[key] = self.count.to_bytes(4, "little")
            self.count += 1

    def _place(self, word: str) -> tuple[_Known, str]:
        spaced = word[0] == " " and len(word) > 1 and not _BLANK.match(word[1])
        return (self.after, word[1:]) if spaced else (self.plain, word)

    def _number(self, word: str) -> bytes:
        table, key = self._place(word)
        if (found := table.get(key)) is None or len(found) != 4:
            found = table[key] = self.count.to_bytes(4, "little")
            self.count += 1
            self.new.append(word.encode())
        return found

    def _after(self, part: str) -> bytes | None:
        if part.isalpha():  # a run of letters is one word
            return self._number(" " + part)
        if not part or _BLANK.match(part):
            return None
        if part[-1] in ",." and part[:-1].isalpha():
            return self.after[part[:-1]] + self.plain[part[-1]]  # too many to keep
        words = self.cut(" " + part)
        if len(words) == 1:
            return self._number(words[0])
        found = self.after[part] = b"".join(map(self._number, words))
        return found

    def _plain(self, chunk: str) -> bytes:
        words = self.cut(chunk)
        if len(words) == 1:
            return self._number(words[0])
        found = self.plain[chunk] = b"".join(map(self._number, words))
        return found

    def of(self, text: str) -> bytes:
        parts = text.split(" ")
        try:
            return (self.plain[parts[0]] if parts[0] else b"") + b"".join(map(self.after.__getitem__, parts[1:]))
        except TypeError:  # a part is None
            return b"".join([self.after[x[1:]] if x[0] == " " and len(x) > 1 and not _BLANK.match(x[1]) else self.plain[x] for x in spaced_chunks(text) if x])

    def forget(self) -> None:
        self.after.clear()
        self.plain.clear()
        self.count = 0


class _Known(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str):
        return self.make(key)


class _Joined:
    """Ids of words, of any number, in one array; it joins those of a list of words, cut into rows."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.ends = flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])

    def rows(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and where each row, which has sizes words, begins and the last one ends."""
        first = self.ends[words]
        own = self.ends[words + 1] - first
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(first - ends[:-1], own)
        at += np.arange(len(at))
        return self.flat[at], ends[np.concatenate([[0], np.cumsum(sizes)])]


def _binary(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """flat as one binary value a row."""
    offsets = flat.itemsize * cuts
    if offsets[-1] >= 1 << 31:
        raise ValueError("a block of documents has over 2^31 bytes of ids or text")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


class _Pieces:
    """The bytes of all pieces, to spell ids with."""

    def __init__(self, pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([*map(len, pieces)], np.int32)
        self.first = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.int32)

    def spelt(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The bytes of each row's ids, one after another."""
        own = self.sizes[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(own, out=ends[1:])
        at = np.repeat(self.first[ids] - ends[:-1], own)
        at += np.arange(len(at))
        return _binary(self.flat[at], ends[cuts])


def merge_long(word: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The ids of a long word: a heap holds the ranks of neighbours that merge, so n bytes take n log n steps."""
    if word in ranks:
        return [ranks[word]]
    ids = [ranks[word[i : i + 1]] for i in range(len(word))]
    left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := pairs.get((a, b))) is not None]
    heapify(heap)
    while heap:
        rank, i, a, b = heappop(heap)
        j = right[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue  # one of the two has merged with another since
        ids[i], ids[j], right[i] = rank, -1, right[j]
        if right[i] < len(ids):
            left[right[i]] = i
            if (more := pairs.get((rank, ids[right[i]]))) is not None:
                heappush(heap, (more, i, rank, ids[right[i]]))
        if left[i] >= 0 and (more := pairs.get((ids[left[i]], rank))) is not None:
            heappush(heap, (more, left[i], ids[left[i]], rank))
    return [x for x in ids if x >= 0]


def common_words(rows: DataFrame, rank_file: str, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The most common words of rows (text) that are no pieces, their ids one after another, and the numbers of these; each is folded once.

    Counted as COUNTED_SHARE and COUNTED_BYTES say, and at most COMMON_WORDS of those found twice, so that the table's size does not depend on the input.
    """
    none = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size < COMMON_FROM:
        return none
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    counted = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(COUNTED_SHARE, size // COUNTED_BYTES))) == 0).select("text").coalesce(tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ranks, times = _Numbers(pattern), read_ranks(rank_file), np.zeros(0, np.int64)

        def found() -> pa.RecordBatch:
            kept = [i for i, w in enumerate(numbers.new) if len(w) <= COMMON_BYTES and w not in ranks]
            return pa.RecordBatch.from_arrays([pa.array([numbers.new[i].decode() for i in kept], pa.string()), pa.array(times[kept])], names=["word", "n"])

        for batch in batches:
            seen = np.frombuffer(b"".join([numbers.of(x) for x in batch.column("text").to_pylist() if x]), np.int32)
            more = np.bincount(seen, minlength=numbers.count)
            more[: len(times)] += times
            times = more
            if numbers.count > MOST_WORDS:
                yield found()
                numbers.start()
                numbers.new.clear()
                times = times[:0]
        yield found()
        numbers.forget()
        give_back()

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_WORDS):
                words = batch.column("word").slice(at, BLOCK_WORDS)
                yield pa.RecordBatch.from_arrays([_one(words), _one(first_states([x.encode() for x in words.to_pylist()], rank_file))], names=["word", "state"])

    counts = counted.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    best = counts.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").repartition(tasks)
    folded = best.mapInArrow(states, "word array<string>, state array<array<bigint>>").select("word", fold_merges(F.col("state"), rank_file).alias("merged")).toArrow()
    words, merged = (folded.column(x).combine_chunks().flatten() for x in ("word", "merged"))
    if not len(words):
        return none
    return words, (merged.flatten().to_numpy() & 0xFFFFF).astype("<u4"), merged.value_lengths().to_numpy()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers), one row per row of docs; null text as empty, which has no ids.

    pattern (of the kind that tokens.spaced_chunks takes) cuts texts into words, each encoded by itself; there are no special
    tokens. A word that is a piece has that piece's id. A word of over LONG_WORD bytes, for which a fold takes quadratic time,
    is merged with a heap. The id may be of any type. Other columns are ignored; no rows give no rows. with_decoded adds a
    column decoded, the bytes of the pieces that a document's ids name.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["reset", "doc_ids", "sizes", "numbers", "words", "long_at", "long_words"]
    common = docs.sparkSession.sparkContext.broadcast(common_words(rows, rank_file, pattern))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, reset = _Numbers(pattern, common.value[0]), True
        for batch in batches:
            parts, size, first = [], 0, 0
            texts = batch.column("text")
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                parts.append(numbers.of(text) if text else b"")
                size += len(text or "")
                if size >= BLOCK_CHARS or len(numbers.new) >= BLOCK_WORDS or at == batch.num_rows - 1:
                    new = numbers.new
                    long_at = [i for i, w in enumerate(new) if len(w) > LONG_WORD]
                    long_words = [new[i] for i in long_at]
                    for i in long_at:
                        new[i] = new[i][:1]
                    words = first_states(new, rank_file)
                    new.clear()
                    lists = [batch.column("doc_id").slice(first, len(parts)), pa.array([len(x) // 4 for x in parts], pa.int32())]
                    columns = [pa.array([reset]), *(_one(x) for x in lists), pa.array([b"".join(parts)], pa.binary()), _one(words), _one(pa.array(long_at, pa.int32())), _one(pa.array(long_words, pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    parts, size, first, reset = [], 0, at + 1, False
                    if numbers.count > len(common.value[0]) + MOST_WORDS:
                        numbers.start()
                        give_back()
                        reset = True
        numbers.forget()
        give_back()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Joined(*common.value[1:])
        pieces = _Pieces(_piece_list(rank_file) if with_decoded else [])
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("reset")[i].as_py():
                    ids = _Joined(*common.value[1:])
                words = batch.column("merged")[i].values
                sizes = np.diff(words.offsets.to_numpy())
                new = (words.flatten().to_numpy() & 0xFFFFF).astype("<u4")
                if len(batch.column("long_at")[i].values):
                    each = np.split(new, np.cumsum(sizes)[:-1])
                    for at, word in zip(batch.column("long_at")[i].as_py(), batch.column("long_words")[i].as_py(), strict=True):
                        each[at] = np.array(merge_long(word, read_ranks(rank_file), _pairs(rank_file)), "<u4")
                    new, sizes = np.concatenate(each), np.array([len(x) for x in each])
                ids.add(new, sizes)
                numbers, n = np.frombuffer(batch.column("numbers")[i].as_py(), np.int32), batch.column("sizes")[i].values.to_numpy()
                flat, cuts = ids.rows(numbers, n)
                more = [pieces.spelt(flat, cuts)] if with_decoded else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, _binary(flat, cuts), *more], names=["doc_id", "ids", *(["decoded"] if more else [])])
        del ids, pieces
        give_back()

    sent = rows.mapInArrow(blocks, _BLOCK.format(id=id_type))
    folded = sent.select("reset", "doc_ids", "sizes", "numbers", "long_at", "long_words", fold_merges(F.col("words"), rank_file).alias("merged"))
    return folded.mapInArrow(documents, f"doc_id {id_type}, ids binary" + ", decoded binary" * with_decoded)


def _one(values: pa.Array) -> pa.Array:
    """An array with one row, the list of values."""
    return pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), values)


def _piece_list(rank_file: str) -> list[bytes]:
    ranks = read_ranks(rank_file)
    pieces = [b""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p
    return pieces


def _joined(ids: bytes, pieces: list[bytes]) -> bytes:
    """The bytes of ids' pieces, one after another."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def _pairs(path: str) -> dict[tuple[int, int], int]:
    return pair_ranks(read_ranks(path))


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """encoded (with a binary column ids) with a column decoded: the pieces' bytes, one after another. Null ids give null."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in names) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _piece_list(rank_file)
        for batch in batches:
            out = [None if x is None else _joined(x, pieces) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)
