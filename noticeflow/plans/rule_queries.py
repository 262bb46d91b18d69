"""The driver's queries for rules, scores, classes and listings: each calls its operators over a whole table, with SQL written from the survey's rules.

Stand-ins: orders for scored notices (key and customer make hit counts and points), parts for titles, customers for owners.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import dates
from noticeflow.functions import text as T
from noticeflow.functions.vocab import Layer, best_group, first_group, keyword_share, longest_term, matching_groups, of, relevance
from noticeflow.operators import classify as C
from noticeflow.operators import grounding, listings, opportunity
from noticeflow.plans.queries import AS_OF, ORACLE_SQL, as_of, query, table

#: Of parts' names.
COLOURS = of("colour", {"warm": {"terms": ["red", "hot"], "weight": 8}, "cool": {"terms": ["blue", "cold"], "weight": 5}})
WARES = of("ware", {"turning": {"terms": ["gear", "rod", "ring"], "weight": 6}, "fixing": {"terms": ["bolt", "plate"], "weight": 4}})
DEFECTS = of("defect", {"old": {"terms": ["old"], "weight": -12}, "small": {"terms": ["small"], "weight": -25}})

_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_custkey % 101 AS base, o_orderkey % 9 AS a, o_orderkey % 7 AS b, o_custkey % 6 AS c, (o_orderkey % 1000) / 1000e0 AS sim"


def orders(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").withColumns({"base": cust % 101, "a": key % 9, "b": key % 7, "c": cust % 6, "sim": (key % 1000) / F.lit(1000.0)})


@query(f"""WITH o AS (SELECT {_ORDER} FROM orders), s AS (SELECT *, greatest(0, least(100, base + least(18, a * 4) + least(12, b * 3) - least(30, c * 6)))::INT AS confidence FROM o)
SELECT o_orderkey, confidence, round_even(0.8::DOUBLE * base + 0.2::DOUBLE * confidence, 0)::INT AS service, (least(28, c * 6) + CASE WHEN confidence < 45 THEN 4 ELSE 0 END)::INT AS penalty,
 greatest(0, least(100, round_even(0.7::DOUBLE * greatest(0, least(100, sim * 115)) + (1 - 0.7::DOUBLE) * base, 0)))::INT AS fit,
 least(100, a + b + c + base)::INT AS early, greatest(0, least(100, base + CASE WHEN a > 4 THEN 15 ELSE 0 END - CASE WHEN b = 0 THEN 30 ELSE 0 END))::INT AS boosted,
 CASE WHEN (base + confidence) / 2e0 >= 70 THEN 'bid' WHEN (base + confidence) / 2e0 >= 45 THEN 'consider' ELSE 'skip' END AS decision,
 greatest(0, least(100, round_even(abs((base + confidence) / 2e0 - 57.5::DOUBLE) * 2, 0)))::INT AS certainty,
 CASE WHEN a = 0 THEN 0e0 ELSE list_sum(list_sort([sim, sim / 2, sim / 4, sim / 8], 'DESC')[1:3]) / 3 * 6 END AS rerank FROM s""")
def score_rules(spark, sf_dir):
    """OPP-01, OPP-02, OPP-04, OPP-13, SCO-04, SCO-05, EPS-03, CLS-15, CLS-17, CLS-30"""
    o = orders(spark, sf_dir).withColumn("confidence", C.confidence_score(F.col("base"), F.col("a"), F.col("b"), F.col("c")))
    advice = C.recommendation(F.col("base"), F.col("confidence"))
    near = F.when(F.col("a") == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("sim") / 8, F.col("sim"), F.col("sim") / 4, F.col("sim") / 2))
    return o.select(
        "o_orderkey", "confidence", C.service_fit(F.col("base"), F.col("confidence")).alias("service"), C.procurement_penalty(F.col("c"), F.col("confidence")).cast("int").alias("penalty"),
        C.blended_fit(F.col("sim"), F.col("base")).alias("fit"), C.early_score(F.col("a"), F.col("b"), F.col("c"), F.col("base")).cast("int").alias("early"),
        C.boosted(F.col("base"), [(F.col("a") > 4, 15), (F.col("b") == 0, -30)]).cast("int").alias("boosted"),
        advice["decision"].alias("decision"), advice["confidence"].alias("certainty"), C.rerank_boost(near).alias("rerank"),
    )


@query(f"""WITH o AS (SELECT {_ORDER}, CASE WHEN c < 2 THEN NULL ELSE base END AS old, CASE WHEN a < 3 THEN NULL WHEN b < 3 THEN base ELSE base + 1 END AS new FROM (SELECT *, o_custkey % 6 AS c, o_orderkey % 9 AS a, o_orderkey % 7 AS b, o_custkey % 101 AS base FROM orders))
SELECT o_orderkey, CASE WHEN base >= 70 THEN 'high' WHEN base >= 45 THEN 'medium' ELSE 'low' END AS technical_fit,
 CASE WHEN a < 5 THEN 'low' WHEN base >= 70 AND a < 15 THEN 'low' WHEN base >= 50 THEN 'medium' ELSE 'high' END AS feasibility,
 CASE WHEN a = 0 THEN 'Not Relevant' WHEN b = 0 AND base < 50 THEN 'Not Relevant' WHEN sim * 100 >= 70 AND base >= 50 THEN 'Relevant' WHEN sim * 100 >= 45 OR base >= 55 THEN 'Maybe' ELSE 'Not Relevant' END AS label,
 CASE WHEN new IS NULL AND old IS NULL THEN 'unlabelled' WHEN old IS NULL THEN 'new' WHEN new IS NULL OR new = old THEN 'carried' ELSE 'updated' END AS label_status,
 CASE WHEN a * 60 <= 90 THEN 'near' WHEN a * 60 <= 365 THEN 'pre' ELSE 'early' END AS stage,
 CASE WHEN a * 60 <= 90 AND base >= 60 THEN 'prepare bid' WHEN base >= 60 THEN 'build relations' WHEN base >= 40 THEN 'monitor' ELSE 'watch' END AS action,
 CASE WHEN c > 0 AND a > 4 THEN 'full_scope' WHEN base >= 40 OR c > 0 THEN 'partial_scope' WHEN b > 0 THEN 'document_pending' ELSE 'title_only' END AS evidence,
 CASE WHEN c > 0 AND a > 4 THEN 'Full scope' WHEN base >= 40 OR c > 0 THEN 'Partial scope' WHEN b > 0 THEN 'Documents pending' ELSE 'Title only' END AS maturity,
 CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 4 ELSE 0 END::INT AS importance,
 CASE WHEN b < 2 THEN true ELSE NOT a = 0 AND NOT c = 0 AND (base > 50 OR sim > 0.5::DOUBLE) END AS shown,
 coalesce(old, 50) >= 40 OR a > 6 OR b < 2 AS kept,
 CASE WHEN a * 100 > 730 THEN 'too old' WHEN base < 10 THEN 'weak signal' WHEN c = 0 AND base < 20 THEN 'infrastructure' WHEN o_orderdate::DATE < DATE '1995-06-01' THEN 'window closed' END AS dropped,
 CASE WHEN o_orderstatus = 'F' THEN 'closing' WHEN date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') <= 365 THEN 'recent' ELSE 'mature' END AS project,
 concat_ws('; ', 'base=' || base, 'old=' || old) AS note,
 (CASE WHEN a > 4 THEN 5 WHEN a > 1 THEN 3 ELSE 0 END + CASE WHEN b > 4 THEN 4 WHEN b > 1 THEN 2 ELSE 0 END + CASE WHEN c > 4 THEN 8 WHEN c > 1 THEN 3 ELSE 0 END)::INT AS capability,
 CASE o_orderstatus WHEN 'F' THEN 'Review in order.' WHEN 'O' THEN 'Tender in order.' ELSE 'Notice in order.' END || CASE WHEN base >= 40 THEN CASE WHEN a < 3 THEN ' It closes within a week.' WHEN a < 6 THEN ' There is time to prepare.' ELSE ' Its deadline is unknown.' END ELSE '' END AS insight FROM o""")
def label_rules(spark, sf_dir):
    """CLS-18, CLS-20 to CLS-24, CLS-28, CLS-29, CLS-31, CLS-32, OPP-05, OPP-11, OPP-12, FLT-11, FLT-12, FLT-18, TXT-03"""
    a, b, c, base = (F.col(x) for x in ("a", "b", "c", "base"))
    o = orders(spark, sf_dir).withColumn("old", F.when(c >= 2, base)).withColumn("new", F.when(a < 3, None).when(b < 3, base).otherwise(base + 1))
    fit, stage = C.fit_signals(base, base, a), C.signal_stage(a * 60, base)
    state = C.evidence_state(base, b, c, a > 4, least=40)
    level = lambda x: F.when(x > 4, "full").when(x > 1, "partial").otherwise("none")
    kind = C.by_table(F.col("o_orderstatus"), {"F": "review", "O": "tender"})
    return o.select(
        "o_orderkey", fit["technical_fit"].alias("technical_fit"), fit["feasibility"].alias("feasibility"), C.suggested_label(F.col("sim") * 100, base, a == 0, b == 0).alias("label"),
        C.label_status(F.col("old"), F.col("new")).alias("label_status"), stage["stage"].alias("stage"), stage["action"].alias("action"), state.alias("evidence"), C.maturity(state)["label"].alias("maturity"),
        C.by_table(F.col("o_orderstatus"), {"F": 10, "O": 4}, 0).alias("importance"), C.output_gate(b < 2, a == 0, c == 0, [base > 50, F.col("sim") > 0.5]).alias("shown"),
        C.low_confidence_rule(F.col("old"), a > 6, b < 2).alias("kept"), C.early_project_gate(a * 100, base, c == 0, F.to_date("o_orderdate"), F.to_date(F.lit("1995-06-01"))).alias("dropped"),
        C.project_stage(F.col("o_orderstatus"), F.to_date("o_orderdate"), as_of(), {"f": "closing"}).alias("project"), C.scoring_note(base=base, old=F.col("old")).alias("note"),
        C.capability(level(a), level(b), level(c)).cast("int").alias("capability"),
        C.insight(F.lit("order"), kind, F.when(a < 3, "closing_soon").when(a < 6, "plan_ahead"), base).alias("insight"),
    )


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + (o_custkey % 15)::INT AS e, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS age, o_custkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN age < 0 THEN 15 WHEN age <= 90 THEN 25 WHEN age <= 180 THEN 20 WHEN age <= 365 THEN 10 ELSE 0 END::INT AS recency, strftime(d + 90, '%Y-%m-%d') AS opens, strftime(d + 270, '%Y-%m-%d') AS closes,
 strftime(d + 90, '%b %Y') || ' to ' || strftime(d + 270, '%b %Y') AS label, d < DATE '{AS_OF}' AS expired, k = 0 OR abs(date_diff('day', d, e)) <= 7 AS close,
 CASE k WHEN 0 THEN '9999' WHEN 1 THEN 'soon' ELSE strftime(d, '%Y-%m-%d') END AS sortable, strftime(CASE WHEN k IN (0, 1) THEN e ELSE d END, '%Y-%m-%d') AS earliest FROM o""")
def date_rules(spark, sf_dir):
    """EPS-01, EPS-05, FLT-13, DED-10, NRM-04, SRT-05, SUB-05"""
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.date_add(d, (F.col("o_custkey") % 15).cast("int")).alias("e"), (F.col("o_custkey") % 4).alias("k"))
    o = o.withColumn("said", F.when(F.col("k") == 0, " ").when(F.col("k") == 1, "soon").when(F.col("k") == 2, F.date_format("d", "dd MMMM yyyy")).otherwise(F.concat(F.lit("Deadline: "), F.date_format("d", "yyyy-MM-dd"))))
    o = o.withColumn("other", F.date_format("e", "yyyy-MM-dd"))
    w = dates.procurement_window("d")
    return o.select(
        "o_orderkey", dates.recency_score("d", as_of()).alias("recency"), w["opens"].cast("string").alias("opens"), w["closes"].cast("string").alias("closes"), w["label"].alias("label"),
        dates.is_expired("d", as_of()).alias("expired"), dates.deadlines_close(F.when(F.col("k") != 0, F.col("d")), "e").alias("close"), dates.sortable("said").alias("sortable"), listings.earliest_date("said", "other").cast("string").alias("earliest"),
    )


_HAS = "list_contains(w, '{}')"
_ANY = lambda *x: "(" + " OR ".join(_HAS.format(y) for y in x) + ")"
_N = lambda *x: "(" + " + ".join(f"{_HAS.format(y)}::INT" for y in x) + ")"


@query(f"""WITH p AS (SELECT *, string_split(lower(p_name), ' ') AS w, list_filter([CASE WHEN contains(lower(p_name), 'hot') THEN 'hot' END, CASE WHEN contains(lower(p_name), 'red') THEN 'red' END, CASE WHEN contains(lower(p_name), 'ring') THEN 'ring' END], lambda x: x IS NOT NULL) AS soft FROM part)
SELECT p_partkey, CASE WHEN {_ANY('hot', 'red')} THEN 'warm' WHEN {_ANY('blue', 'cold')} THEN 'cool' END AS first_colour,
 CASE WHEN greatest({_N('gear', 'rod', 'ring')}, {_N('bolt', 'plate')}) = 0 THEN 'none' WHEN {_N('gear', 'rod', 'ring')} >= {_N('bolt', 'plate')} THEN 'turning' ELSE 'fixing' END AS best_ware,
 CASE WHEN {_HAS.format('plate')} THEN 'fixing' WHEN {_ANY('gear', 'ring')} THEN 'turning' WHEN {_HAS.format('bolt')} THEN 'fixing' WHEN {_HAS.format('rod')} THEN 'turning' END AS longest,
 concat_ws(',', CASE WHEN {_ANY('gear', 'rod', 'ring')} THEN 'turning' END, CASE WHEN {_ANY('bolt', 'plate')} THEN 'fixing' END) AS groups,
 least(100, ({_ANY('gear', 'rod', 'ring')}::INT + {_ANY('bolt', 'plate')}::INT) * 100.0 / 2 + {_ANY('gear', 'rod', 'ring')}::INT * 10)::DOUBLE AS share,
 greatest(0, least(100, {_ANY('red', 'hot')}::INT * 8 + {_ANY('blue', 'cold')}::INT * 5 + greatest(-15, {_HAS.format('old')}::INT * -12 + {_HAS.format('small')}::INT * -25)))::DOUBLE AS firm,
 concat_ws(',', CASE WHEN {_ANY('red', 'hot')} THEN 'warm' END, CASE WHEN {_ANY('blue', 'cold')} THEN 'cool' END) AS reasons,
 CASE WHEN {_ANY('gear', 'ring')} THEN 'consulting' WHEN {_HAS.format('widget')} THEN 'goods' ELSE 'unknown' END AS notice,
 CASE p_type WHEN 'PROMO' THEN 'high' WHEN 'SMALL' THEN 'medium' ELSE CASE WHEN {_HAS.format('hot')} THEN 'medium' ELSE 'low' END END AS competition,
 CASE WHEN {_N('large', 'plate')} > {_N('small', 'ring')} THEN 'large' WHEN {_N('large', 'plate')} < {_N('small', 'ring')} THEN 'small' ELSE 'medium' END AS size,
 CASE WHEN contains(p_name, 'gizmo') THEN NULL WHEN contains(p_name, 'bolt') THEN 'goods anchor in title: bolt' WHEN len(soft) >= 2 THEN 'several signals in title: ' || array_to_string(soft, ', ') WHEN len(soft) = 1 AND p_size < 10 THEN 'signal in title and unknown type: ' || soft[1] END AS gate,
 least(1.0::DOUBLE, CASE p_type WHEN 'PROMO' THEN 0.9::DOUBLE ELSE CASE WHEN {_HAS.format('gear')} THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END END + least(0.2::DOUBLE, {_N('red', 'blue')} * 0.05::DOUBLE)) AS ratio,
 p_brand LIKE '%#1%' OR p_type = 'LARGE' AS geographic, p_type NOT LIKE '%ECONOMY%' AS notified, lower(p_brand) LIKE 'brand#2%' OR lower(p_type) = 'promo' AS noise, p_name LIKE '%ol%' AS part_word,
 p_name || ' ' || lower(p_type) AS blob, {_N('hot', 'cold', 'old')} AS n_hits, len(w) <= 2 AND {_ANY('widget', 'gizmo')} AS generic,
 CASE WHEN p_size % 3 = 0 THEN p_size * 1e6 WHEN p_size % 3 = 1 THEN p_size * 1e3 ELSE p_size * 1e0 END AS amount,
 CASE WHEN p_size % 3 = 0 THEN 'large' WHEN p_size % 3 = 1 AND p_size * 1e3 >= 1e5 THEN 'medium' ELSE 'small' END AS contract,
 least(20, floor(length(p_name) / 100)::INT + least(30, {_N('hot', 'gear')} * 3) + least(30, {_N('large')} * 5))::INT AS complexity,
 greatest(0, least(12, CASE WHEN {_HAS.format('gear')} THEN 9 ELSE 0 END + CASE WHEN {_HAS.format('red')} THEN 5 ELSE 0 END))::INT AS strength FROM p""")
def title_rules(spark, sf_dir):
    """FLT-03 to FLT-05, FLT-09, FLT-10, FLT-19, CLS-03, CLS-04, CLS-08 to CLS-11, SCO-01, SCO-03, OPP-03, OPP-07 to OPP-09, EPS-02, EPS-04, SUB-01 to SUB-03, NRM-36"""
    p, n = table(spark, sf_dir, "part"), F.col("p_name")
    fit = C.firm_fit(n, COLOURS, DEFECTS, worst=-15)
    raw = F.concat(F.format_string("%,d", "p_size"), F.when(F.col("p_size") % 3 == 0, " million").when(F.col("p_size") % 3 == 1, "k").otherwise(""))
    kind = F.when(F.col("p_size") >= 10, "known")
    return p.select(
        "p_partkey", first_group(n, COLOURS).alias("first_colour"), best_group(n, WARES, "none").alias("best_ware"), longest_term(n, WARES).alias("longest"), F.array_join(matching_groups(n, WARES), ",").alias("groups"),
        keyword_share(n, WARES, ["turning"]).alias("share"), fit["score"].alias("firm"), F.array_join(fit["reasons"], ",").alias("reasons"), C.notice_type(n, ["gear", "ring"], ["widget"]).alias("notice"),
        C.competition(C.by_table(F.col("p_type"), {"PROMO": "top", "SMALL": "known"}), n, ["hot"]).alias("competition"), C.opportunity_size(n, ["large", "plate"], ["small", "ring"]).alias("size"),
        C.consulting_gate(n, n, ["gizmo"], ["bolt"], ["hot", "red", "ring"], kind)["reason"].alias("gate"), C.consulting_ratio(F.col("p_type"), n, {"promo": 0.9}, {"gear": 0.7}, ["red", "blue"]).alias("ratio"),
        (C.geographic(F.lower("p_brand"), F.col("p_type"), n, ["brand#1", *(f"brand#1{i}" for i in range(10))], ["large"], ["zzz"])).alias("geographic"), C.skip_process(F.col("p_type"), ["economy"]).alias("notified"), C.noise_source(F.col("p_brand"), ["brand#2"], ["x"]).alias("_noise"),
        C.noise_source(F.col("p_type"), ["q"], ["promo"]).alias("_noise2"), T.has_part("p_name", ["ol"]).alias("part_word"), T.search_blob("p_name", "p_type").alias("blob"), T.count_terms(n, ["hot", "cold", "old"]).alias("n_hits"), T.is_generic_title("p_name", ["none"], ["widget", "gizmo"]).alias("generic"),
        C.amount(raw).alias("amount"), C.contract_size(raw, n, ["large"], ["small"]).alias("contract"), C.complexity(n, ["hot", "gear"], ["large"]).alias("complexity"), C.signal_strength(n, [("gear", 9), ("red", 5)], ["zzz", "yyy"], cap=12)["score"].cast("int").alias("strength"),
    ).withColumn("noise", F.col("_noise") | F.col("_noise2")).drop("_noise", "_noise2")


@query("SELECT coalesce(nullif(event_type, 'view'), 'UNKNOWN') AS tag, count(*) AS n FROM events GROUP BY 1")
def tag_counts(spark, sf_dir):
    """AGG-18, AGG-37"""
    return listings.tag_counts(table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("view"))), "event_type")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) GROUP BY 1")
def page_counts(spark, sf_dir):
    """AGG-41, SRT-08"""
    page = listings.candidates(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)
    return listings.page_counts(page, "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 7")
def digest_selection(spark, sf_dir):
    """SRT-07, SRT-14: the best of each label."""
    top = listings.top_of_each(table(spark, sf_dir, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderdate")], 7, "o_orderkey")
    return top.select("o_orderkey", "o_orderpriority", "rank")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::INT AS class FROM orders ORDER BY class, o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 60")
def backfill_order(spark, sf_dir):
    """SRT-10, RPR-04: candidates by source class, relevance and recency."""
    o = table(spark, sf_dir, "orders").withColumn("class", listings.source_class("o_orderstatus", {"P": 0, "O": 1}, 2))
    return listings.candidates(o, [F.col("class"), F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")], 60).select("o_orderkey", "class")


@query("SELECT tender_id, owner, status, updated_at FROM (SELECT o_orderkey AS tender_id, c_mktsegment AS owner, o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS updated_at FROM orders LEFT JOIN customer ON c_custkey = o_custkey) WHERE status = 'F' AND owner = 'BUILDING' ORDER BY updated_at DESC NULLS LAST, tender_id LIMIT 80")
def lifecycle_list(spark, sf_dir):
    """LKP-09, SRT-13"""
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_custkey").alias("who"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("updated_at"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("who"), F.col("c_mktsegment").alias("owner"))
    return listings.lifecycle_list(ledger, owners, "who", "F", "BUILDING", "updated_at", 80).select("tender_id", "owner", "status", "updated_at")


@query("SELECT l.doc_id, d.lang, d.source FROM (SELECT DISTINCT vec_id AS doc_id FROM embeddings) l LEFT JOIN documents d USING (doc_id)")
def alert_enrichment(spark, sf_dir):
    """LKP-07"""
    return listings.enriched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), ["lang", "source"], "doc_id")


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def index_source(spark, sf_dir):
    """LKP-12, LKP-13"""
    return listings.index_source(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.k') AS first, date_diff('day', ts::DATE, DATE '2024-01-20') >= 7 AS due FROM events")
def flat_events(spark, sf_dir):
    """NRM-34, LRN-05: fields of nested JSON as columns."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *listings.flat_record("props", {"k": "$.k", "first": "$.missing|$.k"}), listings.due(F.to_date("ts"), F.to_date(F.lit("2024-01-20"))).alias("due"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS n, o_custkey % 4 AS k, (o_orderkey % 1000) / 1000e0 AS sim, o_orderstatus AS st FROM orders),
t AS (SELECT *, CASE k WHEN 0 THEN 'Which tenders close?' WHEN 1 THEN 'Tell me more' WHEN 2 THEN 'the WHOLE list' ELSE 'thanks' END AS q,
 CASE WHEN n = 0 THEN 'about 12,000 units' WHEN n = 1 THEN 'INR 500 or so' WHEN n = 2 THEN 'within 30 days' WHEN n = 3 THEN '12 of them' ELSE '' END AS answer FROM o)
SELECT o_orderkey, k IN (0, 2) AS fact, n IN (0, 1, 2) AS claim, sim >= 0.28::DOUBLE OR sim / 2 >= 0.34::DOUBLE AS strong,
 k IN (0, 2) AND (n = 0 OR k = 2 OR answer = '') AS abstains, CASE WHEN n = 4 THEN '' ELSE array_to_string(list_filter([1, 2, 3], lambda c: c <= n), ',') END AS cited,
 CASE WHEN n = 4 THEN 'Insufficient grounded evidence to answer this.' ELSE 'ok' END AS said, st = 'F' AS satisfied, n < 4 AS evidence,
 '1. order | deadline ' || k || ' | src' || chr(10) || '2. other | src' AS lines FROM t""")
def grounding_rules(spark, sf_dir):
    """GRD-01 to GRD-08, SUB-19, SUB-25"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("n"), (F.col("o_custkey") % 4).alias("k"), ((F.col("o_orderkey") % 1000) / F.lit(1000.0)).alias("sim"), "o_orderstatus")
    q = C.by_table(F.col("k"), {0: "Which tenders close?", 1: "Tell me more", 2: "the WHOLE list"}, "thanks")
    answer = C.by_table(F.col("n"), {0: "about 12,000 units", 1: "INR 500 or so", 2: "within 30 days", 3: "12 of them"}, "")
    fact, cite = grounding.fact_query(q), grounding.citations(F.when(F.col("n") == 4, "not-json").otherwise('{"answer":"ok","citations":[1,2,9,-1,2,3]}'), F.col("n"))
    hits = F.array(F.struct(F.lit(0.0).alias("similarity"), F.lit(None).cast("double").alias("composite")), F.struct(F.col("sim").alias("similarity"), (F.col("sim") / 2).alias("composite")))
    lines = F.array(F.struct(F.lit("order").alias("title"), F.col("k").cast("string").alias("deadline"), F.lit("src").alias("source")), F.struct(F.lit("other").alias("title"), F.lit(None).cast("string").alias("deadline"), F.lit("src").alias("source")))
    said = C.by_table(F.col("o_orderstatus"), {"F": "Portal F"}, "other")
    return o.select(
        "o_orderkey", fact.alias("fact"), grounding.numeric_claim(answer).alias("claim"), grounding.strong_retrieval(hits).alias("strong"),
        grounding.abstain(fact, F.col("n"), F.lit(1), F.lit(True), F.col("k") != 2, answer).alias("abstains"), F.array_join(cite["citations"], ",").alias("cited"), cite["answer"].alias("said"),
        grounding.cited_satisfy(F.array(said), F.array(F.lit("portal f of the list")), F.lit(True)).alias("satisfied"), grounding.has_evidence(F.lit(" "), F.nullif(answer, F.lit(""))).alias("evidence"), grounding.deterministic_answer(lines).alias("lines"),
    )


#: A firm that likes what the invented words of documents stand for.
FIRM = opportunity.Profile(
    type_fit={"evaluation": 90, "advisory": 70, "policy": 60},
    importance={"src1": 80, "src2": 60, "src3": 40},
    client_boost={"src1": 18, "src4": 10},
    preferred_clients=("SRC2", "src4"),
    preferred_regions=("fr",),
    preferred_organisations=("src1", "src2"),
    avoided_sectors=("es",),
    avoided_words=("qu",),
    consulting=("the ", "and", "der "),
    procurement=("xx", "zu", "ck"),
    single_person=("secret", "vor"),
    strong_service=("which", "und "),
    moderate_service=("with",),
    strong_sector=("have",),
    moderate_sector=("from", "fr$"),
    top_clients=("src1",),
    partner_clients=("src3", "que "),
)


def _any(text: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{x}', 'i')" for x in patterns) + ")"


def _number(text: str, *patterns: str) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, '{x}', 'i')::INT" for x in patterns) + ")"


def _notices(spark, sf_dir):
    """Documents as notices with all that scores read."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").withColumns({
        "title": F.split(F.coalesce("text", F.lit("")), "\n")[0], "rich_text": F.left(F.coalesce("text", F.lit("")), F.lit(200)), "organization": F.col("source"), "sector": F.col("lang"), "region": F.col("lang"),
        "consulting_type": F.when(n % 17 == 0, " ").otherwise(C.by_table(F.col("lang"), {"en": "evaluation", "de": "advisory", "fr": "policy"})),
        "deadline_category": C.first_match([(n % 5 == 0, "closing_soon"), (n % 5 == 1, "needs_action"), (n % 5 == 2, "plan_ahead"), (n % 5 == 3, "unknown"), (n % 3 == 0, "expired")]),
        "model": F.col("n_chars") % 101, "portfolio": n % 101, "keyword": n * 7 % 101, "shadow": F.when(n % 11 > 0, F.col("n_chars") * 3 % 101), "rerank": F.lit(0.0), "consulting": n % 13 > 0, "exclusion_reason": F.lit("goods"),
    })


@query(f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title, left(coalesce(text, ''), 200) AS rich, n_chars % 101 AS model, doc_id % 101 AS portfolio, doc_id * 7 % 101 AS keyword, CASE WHEN doc_id % 11 > 0 THEN n_chars * 3 % 101 END AS shadow,
 CASE WHEN doc_id % 17 = 0 THEN NULL WHEN lang = 'en' THEN 'evaluation' WHEN lang = 'de' THEN 'advisory' WHEN lang = 'fr' THEN 'policy' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'closing_soon' WHEN 1 THEN 'needs_action' WHEN 2 THEN 'plan_ahead' WHEN 3 THEN 'unknown' ELSE CASE WHEN doc_id % 3 = 0 THEN 'expired' END END AS due, doc_id % 13 > 0 AS consulting FROM documents),
w AS (SELECT *, title || ' ' || text AS short, title || ' ' || text || ' ' || rich AS whole FROM d),
h AS (SELECT *, {_number("whole", "xx", "zu", "ck")} AS negative, {_number("short", "the ", "and", "der ")} AS shallow, {_number("rich", "the ", "and", "der ")} AS deep, NOT {_any("whole", "secret", "vor")} AS firm,
 CASE WHEN {_any("whole", "which", "und ")} THEN 5 WHEN {_any("whole", "with")} THEN 3 ELSE 0 END AS p1, CASE WHEN {_any("whole || ' ' || coalesce(lang, '')", "have")} THEN 4 WHEN {_any("whole || ' ' || coalesce(lang, '')", "from", "fr$")} THEN 2 ELSE 0 END AS p2,
 CASE WHEN source = 'src1' THEN 8 WHEN {_any("coalesce(source, '') || ' ' || text", "src3", "que ")} THEN 3 ELSE 0 END AS p3,
 least(100, CASE source WHEN 'src1' THEN 98 WHEN 'src2' THEN 68 WHEN 'src3' THEN 40 WHEN 'src4' THEN 33 ELSE 15 END + CASE WHEN lang = 'fr' THEN 4 ELSE 0 END) AS client FROM w),
c AS (SELECT *, greatest(0, least(100, CASE kind WHEN 'evaluation' THEN 86 WHEN 'advisory' THEN 68 WHEN 'policy' THEN 72 ELSE 30 END + least(18, shallow * 4) + least(12, deep * 3) - least(30, negative * 6))) AS confidence FROM h),
s AS (SELECT *, round_even(0.8::DOUBLE * CASE kind WHEN 'evaluation' THEN 90 WHEN 'advisory' THEN 70 WHEN 'policy' THEN 60 ELSE 30 END + 0.2::DOUBLE * confidence, 0)::INT AS service, least(28, negative * 6) + CASE WHEN confidence < 45 THEN 4 ELSE 0 END AS penalty FROM c),
r AS (SELECT *, CASE WHEN due = 'expired' THEN 0 ELSE 0.5::DOUBLE * model + 0.3::DOUBLE * portfolio + 0.2::DOUBLE * keyword END + CASE WHEN kind IS NULL THEN -4e0 ELSE 0e0 END - CASE WHEN lang = 'es' THEN 12 ELSE 0 END - CASE WHEN contains(lower(title), 'qu') THEN 18 ELSE 0 END
 + CASE WHEN source IN ('src1', 'src2') THEN 10 ELSE 0 END + CASE WHEN confidence >= 70 THEN 5 ELSE 0 END + CASE WHEN service >= 70 THEN 5 ELSE 0 END - CASE WHEN penalty >= 15 THEN 15 ELSE 0 END - CASE WHEN firm THEN 0 ELSE 10 END
 + (service + client + confidence - 150) * 0.06::DOUBLE + (CASE due WHEN 'closing_soon' THEN 82 WHEN 'needs_action' THEN 100 WHEN 'plan_ahead' THEN 52 WHEN 'expired' THEN 0 ELSE 35 END - 50) * 0.08::DOUBLE + least(12e0, p1 + p2 + p3 / 8e0 * 5) AS raw FROM s),
e AS (SELECT *, CASE WHEN NOT consulting OR due = 'expired' THEN 0 ELSE least(CASE WHEN firm THEN 100 ELSE 10 END, round_even(round_even(round(greatest(0e0, least(100e0, raw / 1.2::DOUBLE)) * 10, 6), 0) / 10, 0))::INT END AS engine FROM r),
f AS (SELECT *, CASE WHEN engine = 0 THEN 0 ELSE least(CASE WHEN firm THEN 100 ELSE 15 END, round_even(round(0.45::DOUBLE * engine + 0.35::DOUBLE * coalesce(shadow, 50) + 0.2::DOUBLE * ((p1 + p2 + p3) / 17e0 * 100), 6), 0))::INT END AS blended FROM e)
SELECT doc_id, confidence::INT AS confidence, service AS service_fit, client::INT AS client_fit, penalty::INT AS penalty, firm AS firm_eligible, engine AS engine_score, blended AS priority_score, blended = 0 AND keyword = 0 AS low_confidence,
 concat_ws('; ', CASE WHEN NOT consulting THEN 'Excluded: goods' WHEN engine = 0 AND keyword = 0 THEN 'No data' WHEN engine = 0 THEN 'Unscored' ELSE CASE WHEN engine >= 70 THEN 'Strong' WHEN engine >= 40 THEN 'Medium' ELSE 'Low' END || ' fit: ' || coalesce(kind, 'unknown') || ', client=' || client || ', service=' || service || ', confidence=' || confidence || ', penalty=' || penalty END,
 CASE WHEN NOT firm THEN 'for one person' END, CASE WHEN p1 = 5 THEN 'service match' END, CASE WHEN p2 = 4 THEN 'sector match' END, CASE p3 WHEN 8 THEN 'client match' WHEN 3 THEN 'partner match' END) AS note FROM f""")
def opportunity_scores(spark, sf_dir):
    """OPP-01 to OPP-06, OPP-10 to OPP-12: scores of all documents as notices, with gates, blend and note."""
    d = _notices(spark, sf_dir)
    return opportunity.score(d, FIRM).select("doc_id", "confidence", "service_fit", "client_fit", "penalty", "firm_eligible", "engine_score", "priority_score", "low_confidence", "note")


def _words(**groups: float) -> object:
    return of("words", {w: {"terms": [w], "weight": n} for w, n in groups.items()})


#: Eight layers, each with the bounds of what it may add.
LAYERS = [
    Layer("service", _words(the=9, which=5), 0, 12), Layer("negative", of("words", {"not": {"terms": ["not"], "weight": -12}, "no": {"terms": ["no"], "weight": -25}}), -30, 0),
    Layer("sector", of("words", {"with": {"terms": ["with"], "weight": 6}, "from": {"terms": ["from"], "weight": 8}}), 0, 10, needs="service"), Layer("geography", _words(der=7, le=4), 0, 15), Layer("fit", of("words", {"and": {"terms": ["and"], "weight": 10}}), 0, 20),
    Layer("mismatch", _words(was=-9), -25, 0), Layer("method", of("words", {"is": {"terms": ["is"], "weight": 4}, "are": {"terms": ["are"], "weight": 5}}), 0, 7), Layer("client", of("words", {"for": {"terms": ["for"], "weight": 6}}), 0, 10),
]
SAYS = {"service": "service ", "sector": "sector ", "geography": "geography ", "negative": "penalised for ", "fit": "fits ", "mismatch": "does not fit ", "method": "method ", "client": "client "}


def _w(word: str) -> str:
    return f"regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])({word})([^\\p{{L}}\\p{{N}}_]|$)') AS w_{word}"


@query(f"""WITH h AS (SELECT doc_id, {", ".join(map(_w, "the which not no with from der le and was is are for secret password".split()))} FROM documents),
s AS (SELECT *, CASE WHEN w_secret OR w_password THEN 0 ELSE greatest(0, least(100, round_even((least(12, 9 * w_the::INT + 5 * w_which::INT) + greatest(-30, -12 * w_not::INT - 25 * w_no::INT) + CASE WHEN w_the OR w_which THEN least(10, 8 * w_from::INT + 6 * w_with::INT) ELSE 0 END
 + least(15, 7 * w_der::INT + 4 * w_le::INT) + 10 * w_and::INT - 9 * w_was::INT + least(7, 5 * w_are::INT + 4 * w_is::INT) + 6 * w_for::INT) * 100e0 / 64, 0)))::INT END AS score FROM h),
p AS (SELECT *, list_filter([CASE WHEN w_the THEN 'service the' WHEN w_which THEN 'service which' END, CASE WHEN NOT (w_the OR w_which) THEN NULL WHEN w_from THEN 'sector from' WHEN w_with THEN 'sector with' END, CASE WHEN w_der THEN 'geography der' WHEN w_le THEN 'geography le' END,
 CASE WHEN w_no THEN 'penalised for no' WHEN w_not THEN 'penalised for not' END, CASE WHEN w_and THEN 'fits and' END, CASE WHEN w_was THEN 'does not fit was' END, CASE WHEN w_are THEN 'method are' WHEN w_is THEN 'method is' END, CASE WHEN w_for THEN 'client for' END], lambda x: x IS NOT NULL)[1:5] AS said FROM s)
SELECT doc_id, score, CASE WHEN w_secret THEN 'Not relevant: blocked by secret' WHEN w_password THEN 'Not relevant: blocked by password' ELSE CASE WHEN score >= 75 THEN 'High relevance' WHEN score >= 50 THEN 'Medium relevance' WHEN score >= 25 THEN 'Low relevance' ELSE 'Not relevant' END || ': ' || CASE WHEN len(said) > 0 THEN array_to_string(said, '; ') ELSE 'no keyword matched' END END AS reason FROM p""")
def relevance_layers(spark, sf_dir):
    """SCO-02, SUB-11: eight capped layers, one of which needs another, blocked words, and the sentence that says why."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return relevance(d, "text", LAYERS, SAYS, 64, ["secret", "password"]).select("doc_id", "score", "reason")


@query(f"""WITH r AS ({ORACLE_SQL["relevance_layers"]}), o AS (SELECT doc_id, max(quality * 25) AS old_score FROM labels GROUP BY 1)
SELECT doc_id, score, reason, old_score, CASE WHEN old_score IS NULL THEN 'new' WHEN old_score <> score THEN 'changed' ELSE 'same' END AS state FROM r LEFT JOIN o USING (doc_id)""")
def rescored(spark, sf_dir):
    """SRT-15, RPR-05: all documents scored again, beside the scores that are stored of some."""
    d = relevance(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", LAYERS, SAYS, 64, ["secret", "password"]).select("doc_id", "score", "reason")
    return listings.rescored(d, table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 25).alias("score")), "doc_id")


MARKET = opportunity.Market(override=["qui "], anchors=["der "], soft=["le ", "de ", "en "], tiers={"src1": "top", "src2": "known"}, contested=["avec"], large=["pour", "der"], small=["mit"], requirements=["and", "und"], scope=["is", "la"])


def _word(*words: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower(short), '(^|[^\\p{{L}}\\p{{N}}_])({w})([^\\p{{L}}\\p{{N}}_]|$)')::INT" for w in words) + ")"


_SOFT = "list_filter([CASE WHEN contains(lower(title), 'le ') THEN 'le' END, CASE WHEN contains(lower(title), 'de ') THEN 'de' END, CASE WHEN contains(lower(title), 'en ') THEN 'en' END], lambda x: x IS NOT NULL)"
_WHY = f"CASE WHEN contains(lower(title || ' ' || coalesce(text, '')), 'qui ') THEN NULL WHEN contains(trim(lower(title)), 'der ') THEN 'goods anchor in title: der' WHEN len(soft) >= 2 THEN 'several signals in title: ' || array_to_string(soft, ', ') WHEN len(soft) = 1 AND kind IS NULL THEN 'signal in title and unknown type: ' || soft[1] END"
_ROWS = ORACLE_SQL["opportunity_scores"]
_ROWS = _ROWS[: _ROWS.rindex("SELECT doc_id, confidence")].replace("doc_id % 13 > 0 AS consulting FROM", f"{_SOFT.replace('lower(title)', 'trim(lower(title))')} AS soft, {_WHY} AS why, why IS NULL AS consulting FROM")
_NOTE = ORACLE_SQL["opportunity_scores"][ORACLE_SQL["opportunity_scores"].rindex(" concat_ws('; '") :].replace("'Excluded: goods'", "'Excluded: ' || why").rsplit(" AS note", 1)[0]


@query(f"""{_ROWS}, z AS (SELECT *, {_NOTE} AS note, CASE WHEN doc_id % 4 > 0 THEN 'model is unsure' END AS said FROM f)
SELECT doc_id, blended AS priority_score, model::DOUBLE AS ml_relevance_score, portfolio::DOUBLE AS portfolio_similarity_score, keyword::DOUBLE AS keyword_score,
 CASE source WHEN 'src1' THEN 'high' WHEN 'src2' THEN 'medium' ELSE CASE WHEN {_word("avec")} > 0 THEN 'medium' ELSE 'low' END END AS competition_level,
 CASE WHEN {_word("pour", "der")} > {_word("mit")} THEN 'large' WHEN {_word("mit")} > {_word("pour", "der")} THEN 'small' ELSE 'medium' END AS opportunity_size,
 (least(40, floor(length(short) / 100)) + least(30, 3 * {_word("and", "und")}) + least(30, 5 * {_word("is", "la")}))::INT AS complexity_score,
 consulting::INT AS is_consulting_relevant, firm AS is_firm_eligible, (blended = 0 AND keyword = 0)::INT AS is_low_confidence, CASE WHEN said IS NULL THEN note ELSE rtrim(note, '. ') || '. ' || said || '.' END AS scoring_note,
 client::INT AS client_fit_score, service AS service_fit_score, confidence::INT AS consulting_confidence_score, penalty::INT AS procurement_penalty_score, 0e0 AS semantic_rerank_score FROM z""")
def opportunity_rows(spark, sf_dir):
    """OPP-01 to OPP-12, FLT-05, LRN-11: whole scored rows of all documents as notices; the gate reads their texts."""
    d = _notices(spark, sf_dir).withColumn("shadow_note", F.when(F.col("doc_id") % 4 > 0, "model is unsure"))
    return opportunity.score_rows(d, FIRM, MARKET, "doc_id")


BATCH = of("batch", {"which": ["which"], "with": ["with", "avec", "mit"], "have": ["have"], "verbs": ["is", "are", "was"]})


@query(f"""WITH d AS (SELECT doc_id, source, split_part(coalesce(text, ''), chr(10), 1) AS title, text, DATE '1998-08-01' + (doc_id % 60)::INT AS deadline, n_chars * 1000.0 AS value, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 100) / 100e0 END AS sim FROM documents),
w AS (SELECT *, title || ' ' || coalesce(text, '') AS short FROM d WHERE trim(title) <> ''),
h AS (SELECT *, list_filter([CASE WHEN {_word("which")} > 0 THEN 'which' END, CASE WHEN {_word("with", "avec", "mit")} > 0 THEN 'with' END, CASE WHEN {_word("have")} > 0 THEN 'have' END, CASE WHEN {_word("is", "are", "was")} > 0 THEN 'verbs' END], lambda x: x IS NOT NULL) AS r FROM w)
SELECT doc_id, 'D' || doc_id AS tender_id, greatest(0, least(100, round_even(0.7::DOUBLE * greatest(0, least(100, coalesce(sim, 0) * 115)) + 0.3::DOUBLE * greatest(0, least(100, len(r) * 100.0::DOUBLE / 4 + CASE WHEN list_contains(r, 'have') THEN 10 ELSE 0 END)), 0)))::INT AS fit_score,
 array_to_string(list_filter([CASE WHEN {_word("the")} > 0 THEN 'goods only' END, CASE WHEN value > 3e6 THEN 'too large' END, CASE WHEN deadline < DATE '{AS_OF}' THEN 'EXPIRED' END, CASE WHEN {_word("und")} > 0 THEN 'ineligible' END], lambda x: x IS NOT NULL), ',') AS red_flags, array_to_string(r, ',') AS top_reasons FROM h""")
def batch_scores(spark, sf_dir):
    """SCO-03 to SCO-06: a batch scored as one: fit, red flags and reasons."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"), F.col("text").alias("description"), F.lit("u").alias("url"), F.concat(F.lit("D"), n.cast("string")).alias("tender_id"), F.date_add(F.to_date(F.lit("1998-08-01")), (n % 60).cast("int")).alias("deadline"), (F.col("n_chars") * 1000.0).alias("value"), F.when(n % 3 > 0, (n % 100) / 100).alias("similarity"))
    out = C.process_batch(d, BATCH, ["the"], ["und"], as_of(), ["have"], most=3e6)
    return out.select("doc_id", "tender_id", "fit_score", F.array_join("red_flags", ",").alias("red_flags"), F.array_join("top_reasons", ",").alias("top_reasons"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, trim(left(t, (doc_id % 200)::INT)) AS scope, trim(left(t, (doc_id % 90)::INT)) AS summary, CASE WHEN doc_id % 3 = 0 THEN trim(left(t, 300)) ELSE '' END AS description, CASE WHEN doc_id % 7 = 0 THEN trim(left(t, 250)) ELSE '' END AS pdf, CASE WHEN doc_id % 13 = 0 THEN 'see http://files/' || doc_id || '.pdf and http://files/a.docx' ELSE '' END AS xs,
 doc_id % 5 = 0 AS linked, doc_id % 55 = 0 AS read, CASE WHEN doc_id % 10 = 0 THEN 150 ELSE 20 END AS chars FROM d),
b AS (SELECT *, scope || '  ' || pdf || ' ' || summary || '  ' || xs || ' ' || description AS blob FROM c),
u AS (SELECT *, CASE WHEN linked THEN 1 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 0 END AS n_urls, len(regexp_extract_all(blob, 'which|donde')) AS hints, length(scope) >= 100 AS s, length(summary) >= 50 AS m, length(description) >= 180 AS p, length(pdf) >= 200 OR (linked AND (chars + 60 >= 200 OR read)) AS f FROM b)
SELECT doc_id, CASE WHEN NOT (s OR m OR p OR f) AND n_urls = 0 AND hints = 0 THEN 'SIGNAL_ONLY' WHEN n_urls = 0 AND hints = 0 THEN 'PAGE_ONLY' WHEN f OR (s AND (m OR p)) THEN 'FULL_PACKAGE' ELSE 'PARTIAL_PACKAGE' END AS state, n_urls::INT AS n_urls FROM u""")
def evidence_packages(spark, sf_dir):
    """CLS-18, CLS-19: the evidence machine over texts and document links."""
    n, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    some = lambda most: F.left(t, most.cast("int"))
    url = F.concat(F.lit("http://x/"), n.cast("string"))
    link = lambda chars: F.struct(url.alias("url"), F.lit("").alias("label"), F.lit("pdf").alias("file_type"), (n % 55 == 0).alias("extracted"), chars.cast("int").alias("char_count"))
    links = F.when(n % 5 == 0, F.array(link(F.when(n % 10 == 0, 150).otherwise(20)), link(F.lit(60))))
    d = table(spark, sf_dir, "documents").select("doc_id", some(n % 200).alias("deep_scope"), F.lit(None).cast("string").alias("deep_description"), F.when(n % 7 == 0, F.left(t, F.lit(250))).alias("deep_pdf_text"), some(n % 90).alias("summary"), F.lit("").alias("eval_criteria"), F.when(n % 13 == 0, F.concat(F.lit("see http://files/"), n.cast("string"), F.lit(".pdf and http://files/a.docx"))).alias("cross_sources"), F.when(n % 3 == 0, F.left(t, F.lit(300))).alias("description"), links.alias("links"))
    return C.evidence_package(d, r"https?://\S+\.(?:pdf|docx?)", "which|donde").select("doc_id", "evidence.state", "evidence.n_urls")
