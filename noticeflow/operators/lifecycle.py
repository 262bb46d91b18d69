"""LIF, CAL: the life of a record from discovery to outcome, and how well decisions did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators.classify import first_match

#: Statuses in their order, and what each may become; every one may stay as it is.
STATUSES = ("discovered", "shortlisted", "proposal_in_progress", "submitted", "won", "lost")
NEXT = {
    "discovered": ("shortlisted", "lost"),
    "shortlisted": ("proposal_in_progress", "discovered", "lost"),
    "proposal_in_progress": ("submitted", "shortlisted", "lost"),
    "submitted": ("won", "lost"),
    "won": (),
    "lost": (),
}
OUTCOMES, DECISIONS = ("won", "lost", "no_submission", "pending"), ("bid", "no_bid", "review_later")
TIERS = ("BID_NOW", "STRONG_CONSIDER", "WEAK_CONSIDER", "IGNORE")

#: Other words for outcomes and decisions (LIF-08, SUB-22).
OUTCOME_ALIASES = {"no submission": "no_submission", "no_bid": "no_submission", "win": "won", "loss": "lost"}
DECISION_ALIASES = {"review later": "review_later", "pending": "review_later", "no bid": "no_bid", "yes": "bid", "no": "no_bid"}


def label(c: Column, aliases: dict[str, str], domain: Sequence[str]) -> Column:
    """NRM-27, LIF-08, SUB-22: a controlled value from what people write; null where it is none."""
    t = F.lower(F.trim(c))
    v = F.coalesce(first_match([(t == k, x) for k, x in aliases.items()]), t)
    return F.when(v.isin(*domain), v)


def register(stored: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """LIF-01: rows to append: distinct ids not stored yet, discovered, with the tag they came with."""
    new = ids.where(T.clean_or_null("tender_id").isNotNull()).groupBy("tender_id").agg(F.min("model_decision_tag").alias("model_decision_tag"))
    return new.join(stored.select("tender_id"), "tender_id", "left_anti").select("tender_id", F.lit("discovered").alias("status"), "model_decision_tag", as_of.alias("updated_at"))


def transition_ok(old: Column, new: Column) -> Column:
    """LIF-02: allowed steps; an unknown old status allows any."""
    return first_match([(old.isNull() | ~old.isin(*STATUSES), True), (old == new, True), *[((old == a) & new.isin(*b), True) for a, b in NEXT.items() if b]], False)


def outcome_error(outcome: Column, decision: Column) -> Column:
    """LIF-03, LIF-04: why an outcome can't stand with a decision; null where it can."""
    return first_match([
        (~outcome.isin(*OUTCOMES), "unknown outcome"),
        (decision.isNotNull() & ~decision.isin(*DECISIONS), "unknown decision"),
        (outcome.isin("won", "lost") & ~F.coalesce(decision == "bid", F.lit(False)), "needs a bid"),
        ((outcome == "no_submission") & ~F.coalesce(decision.isin("no_bid", "review_later"), F.lit(False)), "needs no bid"),
    ])


def apply_outcomes(stored: DataFrame, given: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """LIF-03, LIF-06, SUB-26: stored rows with outcomes applied, and the rejected ones with their error. given: tender_id, outcome, bid_decision."""
    g = given.select("tender_id", label(F.col("outcome"), OUTCOME_ALIASES, OUTCOMES).alias("_o"), label(F.col("bid_decision"), DECISION_ALIASES, DECISIONS).alias("_d"), F.col("outcome").alias("_raw"))
    g = g.withColumn("error", F.coalesce(F.when(F.col("_o").isNull() & F.col("_raw").isNotNull(), "unknown outcome"), outcome_error(F.col("_o"), F.col("_d"))))
    good = g.where("error IS NULL").groupBy("tender_id").agg(F.max(F.struct("_o", "_d")).alias("_x")).select("tender_id", "_x.*")
    status = F.when(F.col("_o").isin("won", "lost"), F.col("_o")).otherwise(F.col("status"))
    out = stored.drop("evaluated_at").join(good, "tender_id", "left").withColumns({"status": status, "outcome": F.coalesce("_o", "outcome"), "bid_decision": F.coalesce("_d", "bid_decision"), "evaluated_at": F.when(F.col("_o").isin("won", "lost", "no_submission"), as_of)})
    return out.drop("_o", "_d"), g.where("error IS NOT NULL").select("tender_id", "error")


def partial_update(stored: DataFrame, given: DataFrame, key: str, columns: Sequence[str], newest: str | None = None) -> DataFrame:
    """LIF-05, SUB-13, SUB-14, SUB-28, UPS-04: given values over stored ones, blank to null, absent (null) leaves the old; no inserts.

    Of several values given for a key the one with the greatest newest (a column of given) counts, without newest the greatest value.
    """
    given_value = lambda c: F.max(c) if newest is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(newest, c)))
    g = given.groupBy(key).agg(*[given_value(c).alias(f"_g_{c}") for c in columns])
    is_text = {f.name: f.dataType.simpleString() == "string" for f in stored.schema}
    take = lambda c: F.when(F.col(f"_g_{c}").isNull(), F.col(c)).otherwise(F.nullif(F.trim(f"_g_{c}"), F.lit("")) if is_text[c] else F.col(f"_g_{c}"))
    return stored.join(g, key, "left").withColumns({c: take(c) for c in columns}).drop(*[f"_g_{c}" for c in columns])


def approved_labels(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """LIF-07, LRN-12, SUB-27, SUB-29: approved rows with a valid label, one per URL, human before machine, newest first."""
    ok = rows.where((F.lower("approved") == "yes") & F.col("label").isin(*labels) & T.clean_or_null("url").isNotNull())
    order = F.struct((F.col("origin") == "human").cast("int").alias("h"), F.col("labelled_at"), F.col("label"))
    return ok.groupBy("url").agg(F.max_by("label", order).alias("label"), F.max_by("origin", order).alias("origin"))


def summary(rows: DataFrame, owner: str = "owner", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """AGG-06, AGG-16, AGG-17: counts by status, zero where there are none, and status counts of the busiest owners."""
    domain = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, rank int")
    counts = domain.join(rows.groupBy("status").count(), "status", "left").select("status", "rank", F.coalesce("count", F.lit(0)).alias("n"))
    who = F.coalesce(T.clean_or_null(owner), F.lit("Unassigned")).alias("owner")
    owners = rows.groupBy(who).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(top)
    return counts, owners


def tier_stats(rows: DataFrame) -> DataFrame:
    """AGG-19: counts and rates per tier; tiers without rows are zero. rows: model_decision_tag, bid_decision, outcome."""
    domain = rows.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    n = lambda c: F.count_if(c)
    per = rows.groupBy(F.col("model_decision_tag").alias("tier")).agg(
        F.count("*").alias("total"),
        n(F.col("bid_decision").isNotNull()).alias("decided"),
        n(F.col("bid_decision") == "bid").alias("bids"),
        n(F.col("outcome") == "won").alias("won"),
        n(F.col("outcome") == "lost").alias("lost"),
    )
    full = domain.join(per, "tier", "left").na.fill(0, ["total", "decided", "bids", "won", "lost"])
    return full.withColumn("bid_rate", T.safe_ratio(F.col("bids"), F.col("decided"))).withColumn("win_rate", T.safe_ratio(F.col("won"), F.col("won") + F.col("lost")))


def winning_signals(rows: DataFrame, fields: Sequence[str], least: int = 3, top: int = 5) -> DataFrame:
    """AGG-20: win rates by value of several fields, with at least so many decided bids; the best few of each field."""
    long = rows.where(F.col("outcome").isin("won", "lost")).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"), "outcome")
    per = long.where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.count("*").alias("decided"), F.count_if(F.col("outcome") == "won").alias("won")).where(F.col("decided") >= least)
    per = per.withColumn("win_rate", T.half_even(F.col("won") / F.col("decided"), 4))
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc("win_rate"), F.desc("decided"), "value"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top)


def accuracy(stats: DataFrame) -> DataFrame:
    """CAL-01: one row: coverage, overall win rate, precision and recall of the top tier."""
    s = lambda c, where=F.lit(True): F.sum(F.when(where, F.col(c)).otherwise(0))
    top = F.col("tier") == TIERS[0]
    return stats.agg(T.safe_ratio(s("decided"), s("total"), 0.0).alias("coverage"), T.safe_ratio(s("won"), s("won") + s("lost")).alias("win_rate"), T.safe_ratio(s("won", top), s("won", top) + s("lost", top)).alias("top_precision"), T.safe_ratio(s("won", top), s("won")).alias("top_recall"), T.safe_ratio(s("total", top), s("total"), 0.0).alias("top_share"), T.safe_ratio(s("bids", top), s("decided", top)).alias("top_bid_rate"))


def suggest_thresholds(acc: DataFrame, score: float = 75, confidence: float = 0.70) -> DataFrame:
    """CAL-02, CAL-03: three rules in order: few of the top tier are bid for: 5 up; few won: confidence 0.05 up; too few at all: 3 down."""
    rule = first_match([(F.col("top_bid_rate") < 0.5, "raise score"), (F.col("top_precision") < 0.2, "raise confidence"), (F.col("top_share") < 0.05, "lower score")], "keep")
    return acc.withColumn("rule", rule).withColumn("score", F.lit(score) + first_match([(F.col("rule") == "raise score", 5.0), (F.col("rule") == "lower score", -3.0)], 0.0)).withColumn("confidence", F.lit(confidence) + F.when(F.col("rule") == "raise confidence", 0.05).otherwise(0.0))


def feedback_metrics(rows: DataFrame) -> DataFrame:
    """AGG-21: counts of decisions and outcomes and two rates, in one row."""
    c = {d: F.count_if(F.col("bid_decision") == d) for d in DECISIONS} | {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES[:3]}
    return rows.agg(*[v.alias(f"n_{k}") for k, v in c.items()], T.safe_ratio(c["won"], c["won"] + c["lost"]).alias("win_rate"), T.safe_ratio(c["bid"], c["bid"] + c["no_bid"]).alias("bid_rate"))
