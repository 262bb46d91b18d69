"""Terms found in one pass over a text's words are those that a pattern a term finds."""

import random

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.functions import vocab
from noticeflow.functions.vocab import Layer, of

TERMS = ["the", "technical assistance", "r&d", "e-learning", "été", "a_b", "x", "21", "the the"]
TEXTS = ["The THE theory", "technical\n assistance", "technical, assistance", "Technical assistances", "R&D in e-Learning", "r & d", "ÉTÉ été ét", "a_b x21 21x", "x_21 x", "", None, "thé the", "ﬁ x½ x"]


@pytest.fixture(scope="module")
def both(spark):
    def compare(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        df, h = T.with_hits(df, "t", TERMS)
        each = [F.array(*[T.has_word(x, [t]) for t in TERMS]) for x in ("t", h)]
        more = [F.struct(T.count_terms(x, TERMS), T.has_word(x, TERMS), T.matched_terms(x, TERMS)) for x in ("t", h)]
        for r in df.select(*[c.alias(f"a{i}") for i, c in enumerate(each)], *[c.alias(f"b{i}") for i, c in enumerate(more)]).collect():
            assert r.a0 == r.a1 and tuple(r.b0) == tuple(r.b1)

    return compare


def test_terms(both):
    both(TEXTS)


def test_any_texts(both):
    rng = random.Random(3)
    parts = ["the", "The", " ", "\n", "-", "&", "technical", "assistance", "r", "d", "é", "\u0301", "_", "21", "x", ","]
    both(["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["\u0301the", "_\u0301the", "the\u0301", "x\u0301_ x"])


def test_vocabularies(spark):
    v = of("v", {"a": {"terms": ["the", "technical assistance"], "weight": 3}, "b": {"terms": ["r&d", "x"], "weight": -2}, "c": {"terms": ["zz"], "mode": "part"}})
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    df, h = T.with_hits(df, "t", vocab.word_terms(v))
    for f in (lambda x: vocab.best_group(x, v, "none"), lambda x: vocab.first_group(x, v), lambda x: vocab.matching_groups(x, v), lambda x: vocab.weighted_sum(x, v), lambda x: vocab.strongest_term(x, v), lambda x: vocab.layered_score(x, [Layer("l", v, -5, 5)], 5), lambda x: vocab.keyword_share(x, v)):
        assert all(r.a == r.b for r in df.select(f("t").alias("a"), f(h).alias("b")).collect())
    with pytest.raises(ValueError, match="not looked for"):
        T.has_word(h, ["unknown term"])
