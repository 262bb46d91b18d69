"""Weighted vocabularies as data: rows of family, group, term, weight, match mode and priority.

Callers bring their own; default() is a small neutral one. Rows become column expressions, so scoring stays in
projections. Every function takes a text, or the words that with_hits found in it in one pass for all vocabularies together.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.text import Cols, Hits, clamp, count_terms, half_even, has, hits, with_hits


@dataclass(frozen=True)
class Group:
    """Terms that count as one thing. Lower priority goes first where ties are broken."""

    name: str
    terms: tuple[str, ...]
    weight: float = 1.0
    mode: str = "word"
    priority: int = 0


@dataclass(frozen=True)
class Vocabulary:
    family: str
    groups: tuple[Group, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "groups", tuple(sorted(self.groups, key=lambda g: g.priority)))

    @property
    def names(self) -> list[str]:
        return [g.name for g in self.groups]

    def rows(self) -> list[tuple]:
        return [(self.family, g.name, t, float(g.weight), g.mode, g.priority) for g in self.groups for t in g.terms]


SCHEMA = "family string, `group` string, term string, weight double, mode string, priority int"


def load(path: str) -> list[Vocabulary]:
    """Vocabularies of a JSON file: {family: {group: [terms] or {"terms", "weight", "mode", "priority"}}}."""
    with open(path, encoding="utf-8") as f:
        return [of(family, groups) for family, groups in json.load(f).items()]


def of(family: str, groups: dict) -> Vocabulary:
    made = []
    for i, (name, g) in enumerate(groups.items()):
        g = g if isinstance(g, dict) else {"terms": g}
        made.append(Group(name, tuple(g["terms"]), g.get("weight", 1.0), g.get("mode", "word"), g.get("priority", i)))
    return Vocabulary(family, tuple(made))


def frame(spark: SparkSession, vocabularies: Iterable[Vocabulary]) -> DataFrame:
    return spark.createDataFrame([r for v in vocabularies for r in v.rows()], SCHEMA)


def default() -> dict[str, Vocabulary]:
    """Neutral vocabularies, for tests and first steps."""
    return {
        "service": of("service", {"evaluation": ["evaluation", "review", "assessment"], "advice": ["advisory", "consulting", "technical assistance"], "training": ["training", "workshop"]}),
        "sector": of("sector", {"health": ["health", "clinic"], "education": ["education", "school"], "water": ["water", "sanitation"], "energy": ["energy", "solar"]}),
        "goods": of("goods", {"goods": {"terms": ["supply of", "equipment", "furniture"], "weight": -1.0}}),
    }


def word_terms(*vocabularies: Vocabulary) -> list[str]:
    """All terms that are looked for as words."""
    return [t for v in vocabularies for g in v.groups if g.mode == "word" for t in g.terms]


def matching_groups(text: Cols | Hits, v: Vocabulary) -> Column:
    """SCO-01, NRM-36: names of the groups that occur, in order."""
    if not v.groups:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(has(text, g.terms, g.mode), g.name) for g in v.groups]), lambda x: x.isNotNull())


def group_hits(text: Cols | Hits, v: Vocabulary) -> Column:
    """An array of struct(name, hits, priority): how many terms of each group occur."""
    return F.array(*[F.struct(F.lit(g.name).alias("name"), count_terms(text, g.terms, g.mode).alias("hits"), F.lit(g.priority).alias("priority")) for g in v.groups])


def best_group(text: Cols | Hits, v: Vocabulary, default: str | None = None, least: int = 1) -> Column:
    """CLS-02, CLS-03: the group with most hits; the earlier one of equals; default under least hits."""
    best = F.array_max(F.array(*[F.struct(count_terms(text, g.terms, g.mode).alias("hits"), F.lit(-g.priority).alias("order"), F.lit(g.name).alias("name")) for g in v.groups]))
    return F.when(best["hits"] >= least, best["name"]).otherwise(F.lit(default))


def first_group(text: Cols | Hits, v: Vocabulary, default: str | None = None) -> Column:
    """CLS-08: the first group that occurs."""
    return F.coalesce(*[F.when(has(text, g.terms, g.mode), g.name) for g in v.groups], F.lit(default))


def longest_term(text: Cols | Hits, v: Vocabulary, default: str | None = None) -> Column:
    """CLS-04: the group of the longest term that occurs."""
    terms = sorted(((t, g) for g in v.groups for t in g.terms), key=lambda x: (-len(x[0]), x[1].priority))
    return F.coalesce(*[F.when(has(text, [t], g.mode), g.name) for t, g in terms], F.lit(default))


def title_and_body(title: Cols | Hits, body: Cols | Hits, v: Vocabulary, title_points: int = 3, body_points: int = 1) -> Column:
    """CLS-01: an array of struct(name, points), best first, of groups with points; a hit in the title outweighs one in the body."""
    each = [F.struct((-(has(title, g.terms, g.mode).cast("int") * title_points + has(body, g.terms, g.mode).cast("int") * body_points)).alias("order"), F.lit(g.priority).alias("priority"), F.lit(g.name).alias("name")) for g in v.groups]
    ranked = F.filter(F.array_sort(F.array(*each)), lambda g: g["order"] < 0)
    return F.transform(ranked, lambda g: F.struct(g["name"].alias("name"), (-g["order"]).alias("points")))


def weighted_sum(text: Cols | Hits, v: Vocabulary, low: float | None = None, high: float | None = None, per_group: bool = False) -> Column:
    """SCO-02 layers, CLS-16: sum of weights of terms (or of groups) that occur, between low and high."""
    total = F.lit(0.0)
    for g in v.groups:
        n = has(text, g.terms, g.mode).cast("int") if per_group else count_terms(text, g.terms, g.mode)
        total = total + n * F.lit(float(g.weight))
    if low is not None:
        total = F.greatest(total, F.lit(float(low)))
    return total if high is None else F.least(total, F.lit(float(high)))


@dataclass(frozen=True)
class Layer:
    """A vocabulary with the bounds of what it may add; needs: counts only if the layer of that name added something."""

    name: str
    vocabulary: Vocabulary
    low: float = 0.0
    high: float = 100.0
    needs: str | None = None


def layered_score(text: Cols | Hits, layers: Sequence[Layer], divisor: float, blocked: Column | None = None) -> Column:
    """SCO-02: capped layers, summed, as a share of divisor in whole percent, half to even, from 0 to 100; 0 where blocked."""
    points: dict[str, Column] = {}
    for layer in layers:
        own = weighted_sum(text, layer.vocabulary, layer.low, layer.high)
        points[layer.name] = F.when(points[layer.needs] > 0, own).otherwise(0.0) if layer.needs else own
    total = sum(points.values(), F.lit(0.0))
    score = clamp(half_even(total * 100 / F.lit(float(divisor)))).cast("int")
    return score if blocked is None else F.when(blocked, 0).otherwise(score)


def strongest_term(text: Cols | Hits, v: Vocabulary) -> Column:
    """The heaviest term that occurs, for good or bad; of equals the earlier one."""
    ranked = sorted(((g, t) for g in v.groups for t in g.terms), key=lambda x: -abs(x[0].weight))
    return F.coalesce(*[F.when(has(text, [t], g.mode), t) for g, t in ranked], F.lit(None).cast("string"))


def relevance(df: DataFrame, text: str, layers: Sequence[Layer], says: Mapping[str, str], divisor: float = 160, blocked: Sequence[str] = (), most: int = 5) -> DataFrame:
    """SCO-02, SUB-11: df with score and reason: layered_score, and one sentence on the strongest term of each layer, most layers at most.

    says: what to write before a layer's term, in the order of writing; a layer that needs another is silent where that one is. A blocked word
    makes the score 0 and is the reason.
    """
    of_layer = {layer.name: layer for layer in layers}
    df, h = with_hits(df, text, [*blocked, *word_terms(*(layer.vocabulary for layer in layers))])
    found = {name: strongest_term(h, of_layer[name].vocabulary) for name in says}
    out = df.withColumns({"score": layered_score(h, layers, divisor, has(h, blocked)), **{f"_t_{name}": c for name, c in found.items()}, "_block": strongest_term(h, of("", {"": list(blocked)}))}).drop("_words")
    silent = lambda name: F.lit(False) if of_layer[name].needs is None else F.col(f"_t_{of_layer[name].needs}").isNull()
    said = [F.when(F.col(f"_t_{name}").isNotNull() & ~silent(name), F.concat(F.lit(words), F.col(f"_t_{name}"))) for name, words in says.items()]
    some = F.slice(F.filter(F.array(*said), lambda x: x.isNotNull()), 1, most)
    label = F.when(F.col("score") >= 75, "High relevance").when(F.col("score") >= 50, "Medium relevance").when(F.col("score") >= 25, "Low relevance").otherwise("Not relevant")
    why = F.when(F.size(some) > 0, F.array_join(some, "; ")).otherwise("no keyword matched")
    reason = F.when(F.col("_block").isNotNull(), F.concat(F.lit("Not relevant: blocked by "), F.col("_block"))).otherwise(F.concat(label, F.lit(": "), why))
    return out.withColumn("reason", reason).drop("_block", *[f"_t_{name}" for name in says])


def keyword_share(text: Cols | Hits, v: Vocabulary, high_value: Sequence[str] = (), bonus: int = 10) -> Column:
    """SCO-03: matched groups in percent of all, and a bonus for each of high value."""
    found = matching_groups(text, v)
    more = hits([F.array_contains(found, name) for name in high_value]) * bonus
    return clamp(F.size(found) * 100.0 / max(1, len(v.groups)) + more)


def merge_weights(rows: DataFrame) -> DataFrame:
    """SUB-15, SUB-16: one row per term with its largest weight."""
    return rows.groupBy(F.lower("term").alias("term")).agg(F.max("weight").alias("weight"))
