r"""Quality rules: counts with limits, then a classifier trained on labelled rows.

The classifier is a logistic regression on hashed word 1- and 2-grams and character 3-grams (each a share of its
kind in the text), trained on a bounded sample of labelled rows; a logistic curve fitted on rows held
out of training turns its scores into probabilities. Both are scored in Arrow batches against fixed
thresholds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import begin, texts_of

#: Rows the classifier is fitted on at most, every fourth of them for calibration; the place of a row among them is a hash of its id.
SAMPLE = 2400

#: A text fails with fewer words, or with a larger percentage of its words in repeated windows of so many words; it is kept from this probability on.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MIN_PROBABILITY = 10, 20, 5, 0.5

SYMBOLS, BITS = "#*$%&|<>", 16
_BLANK = " \t\n\x0b\x0c\r"
_ROLL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def n_repeat_words(words: list[bytes], hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    rolled = hashes[:n] * _ROLL[0]
    for i in range(1, window):
        rolled += hashes[i : n + i] * _ROLL[i]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    spans = list(zip(*(words[i : n + i] for i in range(window)), strict=True))
    often = Counter(spans)
    covered = np.zeros(len(words) + 1, np.int32)
    at = np.fromiter((i for i, s in enumerate(spans) if often[s] > 1), np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    blanks = sum(map(text.count, _BLANK))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat_words(words, hashes)


def _features(text: str, hashes: np.ndarray) -> list[np.ndarray]:
    """Table places of a text's n-grams by kind: words and pairs of words, then runs of three characters."""
    pairs = (hashes[:-1] * _ROLL[0] + hashes[1:] * _ROLL[1]) >> np.uint64(64 - BITS)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    runs = (chars[:-2] * _ROLL[2] + chars[1:-1] * _ROLL[3] + chars[2:] * _ROLL[4]) >> np.uint64(64 - BITS)
    one = (hashes * _ROLL[0]) >> np.uint64(64 - BITS)
    return [np.concatenate([one, pairs]).astype(np.int64), runs.astype(np.int64) + (1 << BITS)]


@dataclass
class Model:
    """Weights by table place, bias, and the calibration of scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str, hashes: np.ndarray) -> float:
        return self.bias + sum(float(self.weights[at].mean()) for at in _features(text, hashes) if at.size)

    def probability(self, score: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], rounds: int = 120, least_rows: int = 3) -> Model | None:
    """A model from texts and labels (1: keep); None unless both labels occur in training. Places in fewer than least_rows texts weigh nothing."""
    hashed = [word_hashes(t.encode("utf-8", "surrogatepass").split()) for t in texts]
    held = np.arange(len(texts)) % 4 == 3
    y = np.array(labels, np.float64)
    if len(set(y[~held])) < 2:
        return None
    rows, places, shares = [], [], []
    for r in np.flatnonzero(~held):
        for at in _features(texts[r], hashed[r]):
            if at.size:
                own, n = np.unique(at, return_counts=True)
                rows.append(np.full(own.size, r))
                places.append(own)
                shares.append(n / at.size)
    row, place, share = (np.concatenate(x) for x in (rows, places, shares))
    common = np.bincount(place, minlength=2 << BITS)[place] >= least_rows
    row, place, share = row[common], place[common], share[common]
    weights, bias = np.zeros(2 << BITS), float(np.log((y[~held].mean() + 1e-6) / (1 - y[~held].mean() + 1e-6)))
    seen, g_bias = np.full(2 << BITS, 1e-10), 1e-10
    each = np.where(y > 0, 0.5 / max(1, (y[~held] > 0).sum()), 0.5 / max(1, (y[~held] <= 0).sum())) * (~held)  # both labels weigh the same
    for _ in range(rounds):
        z = bias + np.bincount(row, weights[place] * share, len(texts))
        d = (_sigmoid(z) - y) * each
        g = np.bincount(place, share * d[row], 2 << BITS) + 1e-7 * weights
        seen += g * g
        weights -= 2.0 * g / np.sqrt(seen)
        g_bias += d.sum() ** 2
        bias -= 0.5 * d.sum() / np.sqrt(g_bias)
    model = Model(weights, bias, 1.0, 0.0)
    scores = np.array([model.score(t, h) for t, h, out in zip(texts, hashed, held, strict=True) if out])
    truth = y[held]
    if len(set(truth)) == 2:
        slope, shift = 1.0, 0.0
        for _ in range(50):  # Newton steps, damped by a weak prior
            p = _sigmoid(slope * scores + shift)
            w = p * (1 - p) + 1e-9
            g = np.array([((p - truth) * scores).sum() + 1e-2 * (slope - 1), (p - truth).sum() + 1e-2 * shift])
            h = np.array([[(w * scores * scores).sum() + 1e-2, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
        model.slope, model.shift = slope, shift
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[int]]:
    """Texts and labels of size labelled rows at most, chosen and ordered by a hash of their ids. Null ids, labels and texts have no part."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().withColumn("_at", F.xxhash64("doc_id")).orderBy("_at", "doc_id", "y").limit(size)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(own), "doc_id")
    rows = found.orderBy("_at", "doc_id", "y", "text").limit(size).collect()  # size rows at most on either side
    return [r["text"] for r in rows], [int(r["y"] > 0) for r in rows]


def train(docs: DataFrame, labels: DataFrame, **how) -> Model | None:
    return fit(*labelled_sample(docs, labels, **how))


def judge(text: str, model: Model | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability."""
    words = text.encode("utf-8", "surrogatepass").split()
    hashes = word_hashes(words)
    counts = base_counts(text, words, hashes)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    probability = model.probability(model.score(text, hashes)) if model else 1.0
    return *counts, failed, not failed and probability >= MIN_PROBABILITY, probability


def rate(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and verdict of each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    Null counts as a text without words, which fails. Without a model the counts alone decide. Ids may be of any type. Other columns are ignored.
    """
    given = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            judged = [judge(t, given.value) for t in texts_of(batch, "text")]
            columns = zip(*judged, strict=True) if judged else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(spark: SparkSession, docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the rules and the classifier keep."""
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            yield batch.filter(pa.array([judge(t, given.value)[6] for t in texts_of(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
