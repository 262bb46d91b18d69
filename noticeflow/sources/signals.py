"""SRC-28: early signals derived from projects that a paged source gave."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import dates
from noticeflow.functions import text as T
from noticeflow.operators.classify import by_table, early_score, project_stage, signal_strength

#: A project's own organisation where it names none.
NOBODY = "unknown"


@dataclass(frozen=True)
class Interests:
    """What makes a project a signal: points of words in its text, of sectors and of places; words of its status."""

    words: Sequence[tuple[str, int]] = ()
    infrastructure: Sequence[str] = ()
    sectors: Mapping[str, int] = field(default_factory=dict)
    places: Mapping[str, int] = field(default_factory=dict)
    stages: Mapping[str, str] = field(default_factory=dict)
    least: int = 30


def project_signals(projects: DataFrame, as_of: Column, who: Interests) -> DataFrame:
    """Signals of projects (columns of paged.PROJECTS) that name one of the words and score least or more.

    source_record_id, title, organization, geography, sector, summary, url, published_date, raw_stage, confidence_score, matched (words,
    by commas), procurement_signal (1 where it is approved or on its way), note and content_hash.
    """
    day = dates._once(F.left("published", F.lit(10)), lambda t: F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)).try_cast("date")
    text = F.lower(F.concat_ws(" ", "summary", "title", "sector"))
    out = projects.withColumns({"_day": day, "_stage": project_stage(F.coalesce("status", F.lit("")), day, as_of, dict(who.stages)), "_found": signal_strength(text, who.words, who.infrastructure)})
    parts = {"recency": dates.recency_score("_day", as_of), "sector": by_table(F.lower(F.coalesce("sector", F.lit(""))), dict(who.sectors), 0), "place": by_table(F.coalesce("country", "region"), dict(who.places), 0), "words": F.col("_found.score")}
    out = out.withColumn("confidence_score", early_score(*parts.values()).cast("int"))
    note = F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
    kept = out.where((F.size("_found.matched") > 0) & (F.col("confidence_score") >= who.least))
    known = F.col("_day").isNotNull() | F.col("_stage").isin("approved", "active")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", empty("title"), empty("summary"), empty("_stage"), empty("confidence_score")))
    return kept.select(
        F.col("id").alias("source_record_id"), "title", F.coalesce(T.clean_or_null("organization"), F.lit(NOBODY)).alias("organization"), F.coalesce("country", "region").alias("geography"), "sector", "summary", "url",
        F.col("_day").alias("published_date"), F.col("_stage").alias("raw_stage"), "confidence_score", F.array_join(F.slice("_found.matched", 1, 8), ", ").alias("matched"), known.cast("int").alias("procurement_signal"), note.alias("note"), digest.alias("content_hash"),
    )
