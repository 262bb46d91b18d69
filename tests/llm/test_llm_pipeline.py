"""The corpus pipeline: each stage on what the one before it kept."""

import collections
import math
import re
import sys
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from test_llm_operators import brute_lines  # noqa: E402

from noticeflow.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_and_rows(stages):
    for df in stages[1:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert df.where(F.col("n_chars") != F.length("text")).count() == 0
    n = [df.count() for df in stages[:-1]]
    assert n[0] >= n[1] == n[2] >= n[3] == n[4] > 0


def test_every_document_is_packed(stages):
    assert {r[0] for r in stages[-1].select("doc_id").collect()} == {r[0] for r in stages[-2].select("doc_id").collect()}


def test_stages_bear_nulls_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for made in ([], [(None, None, None, None, None), (1, None, None, None, None), (1, "a " * 30, "en", None, 60), (1, "a " * 30, "en", None, 60)]):
        docs = spark.createDataFrame(made, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= max(1, len(made)) * 2


def test_near_duplicates_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(5, text, "en", "a", 1), (2, text + " x", "en", "b", 1), (2, text + " x", "en", "b", 1), (9, "quite another text", "en", "c", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [2, 9]


def test_near_duplicates_keep_one_row_of_each_group(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(300))

    a, b, c, d, e = map(text, "abcde")
    rows = [
        (1, a), (1, b), (2, b + " x"),  # one id on two texts, one of which has a near copy
        (None, c), (None, c), (None, d),  # no ids, in two groups
        (None, e), (7, e + " x"),  # an id goes before none
        (4, c[::-1]), (4, a + " x"),  # the second text of 4 is a near copy of 1, the first is clean
        (None, None), (None, ""), (9, None),  # no words: one group
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(1, a), (1, b), (None, c), (None, d), (7, e + " x"), (4, c[::-1]), (9, None)]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, want))


def plain_verdict(text, model):
    """Whether the rules and the model keep a text, word by word and character by character."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return False
    r = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93]
    top = lambda x: (x % (1 << 64)) >> 48
    h = [zlib.crc32(w.encode()) for w in words]
    c = [ord(x) for x in text]
    kinds = [[top(x * r[0]) for x in h] + [top(x * r[0] + y * r[1]) for x, y in zip(h, h[1:])], [(1 << 16) + top(x * r[2] + y * r[3] + z * r[4]) for x, y, z in zip(c, c[1:], c[2:])]]
    score = model.bias + sum(sum(model.weights[at] for at in k) / len(k) for k in kinds if k)
    return 1 / (1 + math.exp(-(model.slope * score + model.shift))) >= 0.5


def plain_fingerprints(text, n):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    hashes, out = [xxhash.xxh64_intdigest(x, 42) for x in shingles], []
    for i in range(n):
        ones = [0] * 64
        for h in hashes:
            if i:
                h = (h + i * 0x9E3779B97F4A7C15) % (1 << 64)
                h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % (1 << 64)
                h = ((h ^ h >> 27) * 0x94D049BB133111EB) % (1 << 64)
                h ^= h >> 31
            for b in range(64):
                ones[b] += h >> b & 1
        out.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes)))
    return out


def plain_passages(texts, length):
    """Texts without the characters all of whose bytes lie in strings of so many bytes that start elsewhere too."""
    raws = [t.encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for t, r in zip(texts, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept, at = [], 0
        for c in t:
            n = len(c.encode())
            kept.append("" if all(gone[at : at + n]) else c)
            at += n
        out.append("".join(kept))
    return out


def test_each_stage_is_the_brute_force_one(spark, stages):
    """Each stage's rows against a plain version of it on the rows that it got; of a repeat's text, whole characters only."""
    before = [[tuple(r) for r in df.collect()] for df in stages]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def same(got, want):
        assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))

    same(before[1], [r for r in before[0] if plain_verdict(r[1] or "", model)])
    same(before[2], [(r[0], x[1], *r[2:4], len(x[1])) for r, x in zip(before[1], brute_lines(before[1], 8), strict=True)])
    bits = np.array([plain_fingerprints(r[1] or "", corpus_pipeline.FINGERPRINTS) for r in before[2]], np.uint64)
    root = list(range(len(bits)))
    apart = lambda i, j: np.bitwise_count(bits[i] ^ bits[j])
    near = [(i, j) for i in range(len(bits)) for j in range(i) if (apart(i, j) <= 4).any() and apart(i, j).sum() <= corpus_pipeline.MOST_BITS]
    for i, j in near * 20:
        root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, k in zip(before[2], root, strict=True):
        least[k] = min(least.get(k, r[0]), r[0])
    kept = {r[0] for r in before[3]}
    # four bits are found wherever they are; wider candidates may join more, but only what all fingerprints say is close
    assert kept <= {r[0] for r, k in zip(before[2], root, strict=True) if least[k] == r[0]}
    for i, r in enumerate(before[2]):
        assert r[0] in kept or any(apart(i, j).sum() <= corpus_pipeline.MOST_BITS for j in range(len(bits)) if j != i)
    same(before[3], [r for r in before[2] if r[0] in kept])
    same(before[4], [(r[0], x, *r[2:4], len(x)) for r, x in zip(before[3], plain_passages([r[1] for r in before[3]], corpus_pipeline.PASSAGE_BYTES), strict=True)])
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = []
    for r in before[4]:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        pieces += [(r[0], i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
    same([r[:5] for r in before[5]], pieces)
