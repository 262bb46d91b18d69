"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token has, for each of its prefixes, a forward score: the best
sum of piece scores that spells the prefix. That score depends on the prefix alone, so
pre-tokens with a common prefix share it: distinct pre-tokens go into a trie, each node gets its
score (and how many pieces that takes) once, from its ancestors, and a pre-token's
count is that of its terminal node.

The trie is made level by level from sorted pre-tokens, all nodes of a level at once (numpy). The pieces
that end at a node follow from its prefix too: an automaton of the vocabulary has one state a node, and that state
names the longest piece which ends there and, one after another, the shorter ones. So only pieces that exist are met.
A worker keeps terminal counts across batches, up to a number of pre-tokens.

Piece scores are integers, so sums have no rounding; of segmentations with equal scores the one with
the fewest pieces counts.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import begin, keeps, texts_of
from noticeflow.llm.tokens import spaced_chunks

#: Pre-tokens whose counts a worker keeps, characters of texts that it counts at a time.
MOST_WORDS, BLOCK_CHARS = 400_000, 4_000_000

#: With so few pre-tokens left on a level, the rest of each is scored byte by byte.
FEW = 8

_kept: dict[tuple, tuple["ScoreTrie", dict[str, int], dict[str, list[str]]]] = {}


def zipf_scores(path: str) -> dict[bytes, int]:
    """Unigram scores of a rank file: a piece of rank r weighs 1 / (r + 1), as Zipf's law has it; millionths of a nat."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(x.split()[0]) for x in f if x.strip()]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: round(1e6 * (-math.log(r + 1) - norm)) for r, p in enumerate(pieces)}


class Pieces:
    """An automaton over the vocabulary: a state is the longest end of what was read that begins a piece."""

    def __init__(self, scores: dict[bytes, int]):
        self.unknown = min(scores.values(), default=0) - 10_000_000  # for a byte that is no piece
        states, levels = {b"": 0}, [[b""]]
        for piece in sorted(scores, key=len):
            for end in range(1, len(piece) + 1):
                if (start := piece[:end]) not in states:
                    states[start] = len(states)
                    if end == len(levels):
                        levels.append([])
                    levels[end].append(start)
        n = len(states)
        self.next = np.zeros((n, 256), np.int32)
        self.depth, self.score = np.zeros(n, np.int32), np.zeros(n, np.int64)
        self.last, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)  # the longest piece that ends here; for a piece, the next shorter one
        back = np.zeros(n, np.int32)
        for depth, level in enumerate(levels):
            own = np.array([states[x] for x in level], np.int32)
            if depth:
                up, byte = np.array([states[x[:-1]] for x in level], np.int32), np.array([x[-1] for x in level])
                if depth > 1:
                    back[own] = self.next[back[up], byte]
                self.next[up, byte] = own
                self.next[own] = self.next[back[own]]  # whose own children are at most as deep as these
                known = np.array([x in scores for x in level])
                self.shorter[own] = self.last[back[own]]
                self.last[own] = np.where(known, own, self.shorter[own])
                self.score[own] = [scores.get(x, 0) for x in level]
                self.depth[own] = depth
        self.is_byte = self.last[self.next[0]] > 0


class ScoreTrie:
    """A trie of distinct pre-tokens with a forward score for each node; nodes counts those of the last one."""

    def __init__(self, scores: dict[bytes, int]):
        self.pieces, self.nodes = Pieces(scores), 1

    def count(self, words: list[bytes]) -> dict[bytes, int]:
        """For each of words (distinct) the pieces of its best segmentation."""
        words = sorted(words)
        p, n = self.pieces, len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        node_at = np.zeros(len(text), np.int32)  # of the prefix that ends with this byte
        score, count, state = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int32), np.zeros(len(text) + 1, np.int32)
        node, active, nodes, depth = np.zeros(n, np.int32), np.arange(n), 1, 0
        while (active := active[size[active] > depth]).size > FEW:
            parent, byte = node[active], text[begin[active] + depth]
            new = np.ones(len(active), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])
            own = nodes - 1 + np.cumsum(new)
            node[active] = node_at[begin[active] + depth] = own
            parent, byte, word = parent[new], byte[new], active[new]
            made = slice(nodes, nodes + len(word))
            nodes += len(word)
            depth += 1
            state[made] = at = p.next[state[parent], byte]
            known = p.is_byte[byte]
            best = np.where(known, np.iinfo(np.int64).min, score[parent] + p.unknown)
            fewest = count[parent] + 1
            piece, left = p.last[at], np.arange(len(word))
            while (left := left[piece[left] > 0]).size:
                some = piece[left]
                length = p.depth[some]
                before = np.where(length == depth, 0, node_at[np.maximum(begin[word[left]] + depth - length - 1, 0)])
                total, pieces = score[before] + p.score[some], count[before] + 1
                better = (total > best[left]) | ((total == best[left]) & (pieces < fewest[left]))
                best[left[better]], fewest[left[better]] = total[better], pieces[better]
                piece[left] = p.shorter[some]
            score[made], count[made] = best, fewest
        found = count[node]
        for i in active.tolist():  # what few words are left share hardly anything
            nodes += len(words[i]) - depth
            path = [(0, 0), *((int(score[x]), int(count[x])) for x in node_at[begin[i] : begin[i] + depth])]
            at = int(state[node[i]])
            for end in range(depth, len(words[i])):
                byte = words[i][end]
                at, best = int(p.next[at, byte]), None
                if not p.is_byte[byte]:
                    best = (path[end][0] + p.unknown, path[end][1] + 1)
                piece = int(p.last[at])
                while piece:
                    total, pieces = path[end + 1 - int(p.depth[piece])]
                    total, pieces = total + int(p.score[piece]), pieces + 1
                    if best is None or (total, -pieces) > (best[0], -best[1]):
                        best = total, pieces
                    piece = int(p.shorter[piece])
                path.append(best)
            found[i] = path[-1][1]
        self.nodes = nodes
        return dict(zip(words, found.tolist(), strict=True))


def token_counts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_distinct (pre-tokens), n_tokens, one row per row of docs, null text as empty (all zero).

    pattern (of the kind that tokens.spaced_chunks takes) cuts texts into pre-tokens. The id may be of any type. Nothing is
    shuffled: each worker keeps what it has counted. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_pretokens", "n_distinct", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token counts")
        keeps("token counts", _kept.clear)
        if (rank_file, pattern) not in _kept:
            _kept[rank_file, pattern] = ScoreTrie(zipf_scores(rank_file)), {}, {}
        trie, known, parts = _kept[rank_file, pattern]
        cut = regex.compile(pattern).findall

        def words_of(text: str) -> Counter:
            words = Counter(spaced_chunks(text)) if text else Counter()
            for chunk in [x for x in words if not x[x[:1] == " " :].isalpha()]:  # a run of letters is one pre-token
                n = words.pop(chunk)
                if (own := parts.get(chunk)) is None:
                    own = parts[chunk] = cut(chunk)
                for w in own:
                    words[w] += n
            return words

        def counted(held: list[Counter]) -> list[tuple[int, int, int]]:
            if missing := set().union(*held) - known.keys():
                known.update((w.decode(), n) for w, n in trie.count([w.encode() for w in missing]).items())
            get = known.__getitem__
            out = [(words.total(), len(words), sum(map(mul, words.values(), map(get, words)))) for words in held]
            if len(known) > MOST_WORDS or len(parts) > MOST_WORDS:
                known.clear()
                parts.clear()
            return out

        for batch in batches:
            out, held, size = [], [], 0
            for text in texts_of(batch, "text"):
                held.append(words_of(text))
                size += len(text)
                if size >= BLOCK_CHARS:
                    out += counted(held)
                    held, size = [], 0
            out += counted(held)
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_distinct long, n_tokens long")
