"""OPP-01 to OPP-06, OPP-10 to OPP-12 in full: what a notice is worth to a firm, as one chain of projections.

What a firm likes is data (Profile). Each step adds columns that later ones use, so a pattern is searched once per row;
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators.classify import by_table, competition, complexity, confidence_score, consulting_gate, cut_offs, first_match, opportunity_size, procurement_penalty, service_fit

# Confidence by type of engagement (others 40), urgency by deadline (others 35), points of capability matches.
CONFIDENCE_BY_TYPE = {"evaluation": 86, "research": 80, "technical assistance": 78, "capacity building": 76, "policy": 72, "advisory": 68, "feasibility study": 64, "implementation support": 52, "unknown": 30}
URGENCY = {"closing_soon": 82, "needs_action": 100, "plan_ahead": 52, "expired": 0, "unknown": 35}
SERVICE_POINTS, SECTOR_POINTS, CLIENT_POINTS = (5, 3), (4, 2), (8, 3)


@dataclass(frozen=True)
class Profile:
    """A firm's preferences. Patterns are regular expressions, blind to case; strong ones are tried before moderate ones."""

    type_fit: Mapping[str, float] = field(default_factory=dict)
    importance: Mapping[str, float] = field(default_factory=dict)
    client_boost: Mapping[str, float] = field(default_factory=dict)
    preferred_clients: Sequence[str] = ()
    preferred_regions: Sequence[str] = ()
    preferred_organisations: Sequence[str] = ()
    avoided_sectors: Sequence[str] = ()
    avoided_words: Sequence[str] = ()
    consulting: Sequence[str] = ()
    procurement: Sequence[str] = ()
    single_person: Sequence[str] = ()
    strong_service: Sequence[str] = ()
    moderate_service: Sequence[str] = ()
    strong_sector: Sequence[str] = ()
    moderate_sector: Sequence[str] = ()
    top_clients: Sequence[str] = ()
    partner_clients: Sequence[str] = ()


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """How many of patterns occur."""
    return T.hits([text.rlike(f"(?i){p}") for p in patterns])


def one_of(value: Column, known: Sequence[str]) -> Column:
    """Whether value is one of known, blind to case; false for null."""
    return F.coalesce(F.lower(F.trim(value)).isin(*[k.strip().lower() for k in known]), F.lit(False))


def _graded(strong: Column, moderate: Column, points: tuple[int, int]) -> Column:
    return first_match([(strong, points[0]), (moderate, points[1])], 0)


def _settled(c: Column) -> Column:
    """A sum of decimal points without the error of its floats, so that a tie is a tie in whatever order it was added up."""
    return F.round(c.cast("double"), 6)


def _whole(c: Column) -> Column:
    return T.clamp(T.half_even(_settled(c))).cast("int")


def client_fit(organisation: Column, region: Column, p: Profile) -> Column:
    """OPP-03, OPP-12: importance (15 where unknown) and boost of a client, 8 more for a preferred one, 4 for a preferred region."""
    points = by_table(organisation, dict(p.importance), 15) + by_table(organisation, dict(p.client_boost), 0)
    return _whole(points + F.when(one_of(organisation, p.preferred_clients), 8).otherwise(0) + F.when(one_of(region, p.preferred_regions), 4).otherwise(0))


def parts(df: DataFrame, p: Profile) -> DataFrame:
    """OPP-01 to OPP-05 of each row: df with confidence, service_fit, client_fit, penalty, cap_service, cap_sector, cap_client and firm_eligible.

    df: title, text, rich_text, consulting_type, organization, sector, region; nulls count as empty.
    """
    word = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "text", "rich_text", "organization", "sector")}
    short = F.concat_ws(" ", word["title"], word["text"])
    out = df.withColumns({"_short": short, "_all": F.concat_ws(" ", short, word["rich_text"])})
    everything, client = F.col("_all"), F.concat_ws(" ", word["organization"], word["text"])
    by_sector = F.concat_ws(" ", everything, word["sector"])
    some = lambda text, patterns: matches(text, patterns) > 0
    out = out.withColumns({
        "_negative": matches(everything, p.procurement),
        "_shallow": matches(F.col("_short"), p.consulting),
        "_deep": matches(word["rich_text"], p.consulting),
        "firm_eligible": ~some(everything, p.single_person),
        "cap_service": _graded(some(everything, p.strong_service), some(everything, p.moderate_service), SERVICE_POINTS),
        "cap_sector": _graded(some(by_sector, p.strong_sector), some(by_sector, p.moderate_sector), SECTOR_POINTS),
        "cap_client": _graded(F.trim(word["organization"]).isin(*p.top_clients), some(client, p.partner_clients), CLIENT_POINTS),
        "client_fit": client_fit(F.col("organization"), F.col("region"), p),
    })
    base = by_table(F.lower(engagement()), CONFIDENCE_BY_TYPE, 40)
    out = out.withColumn("confidence", confidence_score(base, F.col("_shallow"), F.col("_deep"), F.col("_negative")))
    return out.withColumns({
        "service_fit": _whole(service_fit(by_table(F.col("consulting_type"), dict(p.type_fit), 30), F.col("confidence"))),
        "penalty": procurement_penalty(F.col("_negative"), F.col("confidence")).cast("int"),
    }).drop("_short", "_all", "_negative", "_shallow", "_deep")


def engagement() -> Column:
    """The type of engagement; unknown where it is null or blank."""
    return F.coalesce(F.nullif(F.trim("consulting_type"), F.lit("")), F.lit("unknown"))


def adjustments(p: Profile) -> Column:
    """OPP-06: points for and against, from the columns of parts; rerank adds what similar won notices give (OPP-13)."""
    c = {n: F.col(n) for n in ("confidence", "service_fit", "client_fit", "penalty")}
    flat = [
        (engagement() == "unknown", -4),
        (F.col("sector").isin(*p.avoided_sectors), -12),
        (T.has_part("title", [w.lower() for w in p.avoided_words]), -18),
        (F.col("organization").isin(*p.preferred_organisations), 10),
        (c["confidence"] >= 70, 5),
        (c["service_fit"] >= 70, 5),
        (c["penalty"] >= 15, -15),
        (~F.col("firm_eligible"), -10),
    ]
    points = sum((F.when(F.coalesce(holds, F.lit(False)), float(n)).otherwise(0.0) for holds, n in flat), F.lit(0.0))
    level = sum((c[n] - 50) * 0.06 for n in ("service_fit", "client_fit", "confidence"))
    urgency = (by_table(F.col("deadline_category"), URGENCY, 35) - 50) * 0.08
    capability = F.least(F.lit(12.0), F.col("cap_service") + F.col("cap_sector") + F.col("cap_client") / F.lit(8.0) * 5.0)
    return points + level + urgency + capability + F.coalesce(F.col("rerank").cast("double"), F.lit(0.0))


def priority(p: Profile, divisor: float = 1.2) -> Column:
    """OPP-06: 0.5 model, 0.3 portfolio and 0.2 keyword points (none where expired) with adjustments, over divisor, from 0 to 100, one decimal."""
    evidence = 0.5 * F.col("model") + 0.3 * F.col("portfolio") + 0.2 * T.clamp(F.col("keyword"))
    evidence = F.when(F.coalesce(F.col("deadline_category") == "expired", F.lit(False)), 0.0).otherwise(F.coalesce(evidence, F.lit(0.0)))
    return F.rint(_settled(T.clamp((evidence + adjustments(p)) / divisor) * 10)) / 10


def score(df: DataFrame, p: Profile) -> DataFrame:
    """OPP-10: df with the columns of parts, engine_score, priority_score, low_confidence and note.

    df also has model, portfolio, keyword, shadow and rerank (points), deadline_category, and consulting with exclusion_reason. Gates come
    first: 0 for what is no consulting or expired, 10 at most for what a firm can't bid for. What is left is blended: 0.45 engine, 0.35
    shadow model (50 where null) and 0.20 capability; 0 stays 0, and 15 is the most for what a firm can't bid for.
    """
    out = parts(df, p)
    gone = ~F.coalesce(F.col("consulting"), F.lit(False)) | F.coalesce(F.col("deadline_category") == "expired", F.lit(False))
    at_most = lambda s, most: F.when(F.col("firm_eligible"), s).otherwise(F.least(s, F.lit(most)))
    out = out.withColumn("engine_score", at_most(F.when(gone, 0).otherwise(_whole(priority(p))), 10))
    capability = F.least(F.lit(100.0), (F.col("cap_service") + F.col("cap_sector") + F.col("cap_client")) / F.lit(17.0) * 100)
    blend = _whole(0.45 * F.col("engine_score") + 0.35 * F.coalesce(F.col("shadow").cast("double"), F.lit(50.0)) + 0.20 * capability)
    out = out.withColumn("priority_score", at_most(F.when(F.col("engine_score") == 0, 0).otherwise(blend), 15))
    nothing = F.coalesce(F.col("keyword"), F.lit(0)) == 0
    return out.withColumns({"low_confidence": (F.col("priority_score") == 0) & nothing, "note": note(F.col("engine_score"), nothing)})


@dataclass(frozen=True)
class Market:
    """What score_rows needs besides a Profile: the words of the gate, of competition, size and complexity, and the tiers of clients."""

    override: Sequence[str] = ()
    anchors: Sequence[str] = ()
    soft: Sequence[str] = ()
    tiers: Mapping[str, str] = field(default_factory=dict)
    contested: Sequence[str] = ()
    large: Sequence[str] = ()
    small: Sequence[str] = ()
    requirements: Sequence[str] = ()
    scope: Sequence[str] = ()


def score_rows(df: DataFrame, p: Profile, m: Market, key: str = "tender_id") -> DataFrame:
    """OPP-10 whole: key and all that a scored row has, from texts alone: the gate decides here what is no consulting.

    df: as score takes it but for consulting and exclusion_reason, and shadow_note (LRN-11; null or blank where there is none).
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    gated = df.withColumn("_gate", consulting_gate(F.col("title"), text, m.override, m.anchors, m.soft, F.col("consulting_type")))
    out = score(gated.withColumns({"consulting": F.col("_gate.ok"), "exclusion_reason": F.col("_gate.reason")}), p)
    out, h = T.with_hits(out, text, [*m.contested, *m.large, *m.small, *m.requirements, *m.scope])
    said = F.nullif(F.trim("shadow_note"), F.lit(""))
    with_shadow = F.ltrim(F.concat(F.rtrim("note", F.lit(". ")), F.lit(". "), said, F.lit(".")), F.lit(". "))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.select(
        key, "priority_score", number("model").alias("ml_relevance_score"), number("portfolio").alias("portfolio_similarity_score"), number("keyword").alias("keyword_score"),
        competition(by_table(F.col("organization"), dict(m.tiers)), h, m.contested).alias("competition_level"), opportunity_size(h, m.large, m.small).alias("opportunity_size"), complexity(h, m.requirements, m.scope).alias("complexity_score"),
        F.col("consulting").cast("int").alias("is_consulting_relevant"), F.col("firm_eligible").alias("is_firm_eligible"), F.col("low_confidence").cast("int").alias("is_low_confidence"), F.coalesce(with_shadow, "note").alias("scoring_note"),
        F.col("client_fit").alias("client_fit_score"), F.col("service_fit").alias("service_fit_score"), F.col("confidence").cast("int").alias("consulting_confidence_score"), F.col("penalty").alias("procurement_penalty_score"), number("rerank").alias("semantic_rerank_score"),
    )


def note(engine: Column, no_keywords: Column) -> Column:
    """OPP-11: why a row has its score, and which capabilities match."""
    why = F.when(engine > 0, F.concat(cut_offs(engine, [(70, "Strong"), (40, "Medium")], "Low"), F.lit(" fit: "), engagement(), F.lit(", client="), F.col("client_fit"), F.lit(", service="), F.col("service_fit"), F.lit(", confidence="), F.col("confidence"), F.lit(", penalty="), F.col("penalty")))
    lead = first_match([(~F.coalesce(F.col("consulting"), F.lit(False)), F.concat(F.lit("Excluded: "), F.coalesce(F.col("exclusion_reason"), F.lit("no signal")))), ((engine == 0) & no_keywords, "No data"), (engine == 0, "Unscored")], why)
    tags = [(~F.col("firm_eligible"), "for one person"), (F.col("cap_service") == 5, "service match"), (F.col("cap_sector") == 4, "sector match"), (F.col("cap_client") == 8, "client match"), (F.col("cap_client") == 3, "partner match")]
    return F.concat_ws("; ", lead, *[F.when(holds, tag) for holds, tag in tags])
