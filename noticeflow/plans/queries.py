"""The driver's queries: each operator family over the driver's tables, over whole tables, with SQL for DuckDB where it can express it.

Stand-ins: documents for records (first line as title, source as portal), labels for relevance, orders for the lifecycle,
events for source runs (user_id as source, event_type as status, value as rows), conversations for answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.functions.vocab import Layer, best_group, layered_score, matching_groups, of, title_and_body, word_terms
from noticeflow.operators import classify, dedup, documents, grounding, health, learning, lifecycle, normalize, search, text_index, upsert, vector_lists, vectors
from noticeflow.operators.joins import hot_key_join
from noticeflow.plans import views
from noticeflow.streaming import streams
from noticeflow.tables import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Vocabularies drawn from the tables' invented words, one per family, with weights.
SERVICES = of("service", {"article": {"terms": ["the", "der", "le"], "weight": 3}, "joint": {"terms": ["and", "und", "et"], "weight": 2}, "place": {"terms": ["in", "at", "by"], "weight": 1}})
SECTORS = of("sector", {"relative": ["that", "which"], "verbs": ["was", "is", "are"], "links": ["from", "with", "for"], "negation": ["not", "no"]})
AS_OF = "1998-09-02"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(day: str = AS_OF) -> Column:
    return F.to_date(F.lit(day))


def title() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")[0]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of sources."""
    status = classify.by_table(F.col("event_type"), {"error": "FAIL", "view": "SKIP", "signup": "WARN"}, "OK")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("run_at"), "event_id", status.alias("status"), F.floor(F.col("value") / 20).cast("long").alias("row_count")).withColumnRenamed("event_id", "run_id")


RUNS_SQL = """runs AS (SELECT user_id AS source, ts AS run_at, event_id AS run_id,
  CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'SKIP' WHEN 'signup' THEN 'WARN' ELSE 'OK' END AS status,
  floor(value / 20)::BIGINT AS row_count FROM events)"""

# --- joins, listings, aggregates --------------------------------------------------------------------------------


@query("""SELECT s.status, s.rank, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('F', 1), ('O', 2), ('P', 3), ('X', 4)) s(status, rank)
LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) o ON o.o_orderstatus = s.status""")
def pipeline_summary(spark, sf_dir):
    """AGG-06, AGG-17: counts by status, zero for a status without rows."""
    domain = spark.createDataFrame([("F", 1), ("O", 2), ("P", 3), ("X", 4)], "status string, rank int")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return domain.join(n, "status", "left").select("status", "rank", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT coalesce(c_mktsegment, 'Unassigned') AS owner, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
 count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY n DESC, owner LIMIT 20""")
def owner_workload(spark, sf_dir):
    """AGG-16, JOI-04: status counts of the busiest owners."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    n = [F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"]
    return o.groupBy(F.coalesce("c_mktsegment", F.lit("Unassigned")).alias("owner")).agg(*n, F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(20)


@query("""SELECT o_orderkey, c_name, n_name, o_orderstatus, coalesce(list_position(['O', 'P'], o_orderstatus), 0)::BIGINT AS rank FROM orders
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey ORDER BY rank, o_totalprice DESC, o_orderkey LIMIT 200""")
def pipeline_list_custom_order(spark, sf_dir):
    """SRT-03, JOI-04: a list in a given order of statuses; unknown ones first."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    o = o.withColumn("rank", views.custom_rank("o_orderstatus", ["O", "P"]))
    return o.orderBy("rank", F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "c_name", "n_name", "o_orderstatus", "rank")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(o_totalprice, 0) < 300000 OR (coalesce(o_totalprice, 0) = 300000 AND o_orderkey > 100)
ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 50""")
def keyset_page(spark, sf_dir):
    """SRT-02: the page after a cursor."""
    return views.keyset_page(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 50, (300000.0, 100)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 75")
def offset_page(spark, sf_dir):
    """SRT-01"""
    return views.offset_page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 25).select("o_orderkey", "o_orderdate")


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars >= 1000) AS n_long, round_even(avg(nullif(n_chars, 0)), 2) AS avg_chars, max(n_chars) AS max_chars,
 count(quality) AS n_labelled, coalesce(sum(quality), 0)::BIGINT AS n_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def portal_breakdown(spark, sf_dir):
    """AGG-01 to AGG-03: conditional counts, averages and maxima by portal."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 1000).alias("n_long"), T.half_even(F.avg(F.nullif(F.col("n_chars"), F.lit(0))), 2).alias("avg_chars"), F.max("n_chars").alias("max_chars"), F.count("quality").alias("n_labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_good"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice >= 200000) AS n_high, count(DISTINCT o_custkey) AS n_portals, max(o_totalprice) AS best FROM orders""")
def dashboard_totals(spark, sf_dir):
    """AGG-05, AGG-31, AGG-40: totals in one pass."""
    return views.totals(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 200000)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_groups(spark, sf_dir):
    """AGG-07, AGG-35"""
    return views.value_counts(table(spark, sf_dir, "part"), "p_brand", 10)


@query("SELECT trim(w) AS value, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_name, '[ ,;]')) AS w FROM part) WHERE trim(w) <> '' GROUP BY 1")
def split_counts(spark, sf_dir):
    """AGG-04, AGG-25, AGG-32: counts of list parts."""
    return views.split_counts(table(spark, sf_dir, "part"), "p_name", "[ ,;]")


@query("""SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, coalesce(p.url, d.source) AS place FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id""")
def unified_view(spark, sf_dir):
    """JOI-01, NRM-30, R18: ledger with one-to-one relations."""
    d, l, p = (table(spark, sf_dir, n) for n in ("documents", "labels", "pages"))
    v = views.unified(d.select("doc_id", "source", "lang"), l, p.select(F.col("page_id").alias("doc_id"), "url"), key="doc_id")
    return v.select("doc_id", "source", "lang", "quality", "toxic", F.coalesce("url", "source").alias("place"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.lang = 'en'")
def list_filtered(spark, sf_dir):
    """JOI-02, JOI-03: a left join whose filter makes it an inner one."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where("quality = 1 AND lang = 'en'").select("doc_id", "lang", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_rows(spark, sf_dir):
    """JOI-07 to JOI-09, RPR-01"""
    return upsert.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT page_id AS doc_id FROM pages)
SELECT count(*) FILTER (WHERE b.doc_id IS NULL) AS only_a, count(*) FILTER (WHERE a.doc_id IS NULL) AS only_b, count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def lineage_gaps(spark, sf_dir):
    """JOI-10, SET-04"""
    return upsert.lineage_gaps(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")


@query("""WITH d AS (SELECT o_orderstatus AS tier, date_diff('day', DATE '1998-09-02', CAST(o_orderdate AS DATE)) AS d FROM orders),
b AS (SELECT tier, CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'expired' WHEN d <= 7 THEN 'closing_soon' WHEN d <= 21 THEN 'needs_action' ELSE 'plan_ahead' END AS bucket FROM d)
SELECT bucket, tier, count(*) AS n FROM b GROUP BY ROLLUP (bucket, tier)""")
def deadline_buckets(spark, sf_dir):
    """CLS-06, AGG-08: buckets by tier, with totals."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("deadline"), F.col("o_orderstatus").alias("tier"))
    return views.deadline_breakdown(o, "deadline", "tier", as_of())


@query("""WITH d AS (SELECT date_diff('day', DATE '1998-09-02', CAST(l_shipdate AS DATE)) AS d FROM lineitem),
b AS (SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'expired' WHEN d <= 3 THEN '3 days' WHEN d <= 7 THEN 'week' WHEN d <= 14 THEN 'two weeks' WHEN d <= 30 THEN 'month' ELSE 'later' END AS band FROM d)
SELECT band, count(*) AS n FROM b WHERE band <> 'expired' GROUP BY band""")
def urgency_bands(spark, sf_dir):
    """AGG-33, AGG-34, CLS-33"""
    return views.urgency(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("deadline")), "deadline", as_of())


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS n_new FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def export_totals(spark, sf_dir):
    """AGG-27, DQ-06: totals by rollup."""
    return views.export_totals(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))


@query("SELECT l_returnflag AS label, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def maturity_distribution(spark, sf_dir):
    """AGG-28, AGG-39: counts with all totals by cube."""
    return views.distribution(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status")), "label", "status")


@query("""SELECT source, count(*) AS n, round_even(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 1) AS quality_percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage(spark, sf_dir):
    """AGG-09, AGG-13"""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return views.coverage(d, "source", ["quality"])


@query("""SELECT c_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS other_sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""".replace("array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ')", "array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)), ', ')"))
def cross_source_text(spark, sf_dir):
    """JOI-12: sorted distinct text of a group."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return views.cross_source_text(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderpriority")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_by_either(spark, sf_dir):
    """JOI-11, JOI-13: rows whose one or other key is asked for, as a union of semi joins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_custkey").alias("url"), "o_orderstatus")
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("tender_id"))
    urls = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("url"))
    return upsert.semi_by_either(o, ids, urls).select(F.col("tender_id").alias("o_orderkey"), "o_orderstatus")


@query("""SELECT lang FROM documents WHERE source = 'src1' INTERSECT SELECT lang FROM documents WHERE source = 'src2'""")
def shared_languages(spark, sf_dir):
    """SET-02, SET-04, extension: intersection."""
    d = table(spark, sf_dir, "documents")
    return d.where("source = 'src1'").select("lang").intersect(d.where("source = 'src2'").select("lang"))


# --- normalisation, vocabularies, gates ---------------------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
HASH_SQL = f"""md5(array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({STOP_SQL}))), ' '))"""


@query(f"""WITH h AS (SELECT doc_id, {HASH_SQL} AS content_hash FROM documents), f AS (SELECT content_hash, min(doc_id) AS canonical_id FROM h GROUP BY 1)
SELECT h.doc_id, content_hash, canonical_id FROM h JOIN f USING (content_hash) WHERE h.doc_id <> canonical_id""")
def content_hash_dupes(spark, sf_dir):
    """NRM-03, DED-02"""
    d = cut(table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("content_hash")), "hashes")  # a text is hashed once, not once a use
    return dedup.hash_duplicates(d, id_col="doc_id", seen="doc_id").select("doc_id", "content_hash", "canonical_id")


NORM_SQL = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT *, {NORM_SQL} AS k FROM documents) SELECT k AS key, count(*) AS n_rows, count(DISTINCT source) AS n_sources, min(doc_id) AS first_id FROM d WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 2""")
def cross_source_groups(spark, sf_dir):
    """DED-16"""
    return dedup.cross_source_groups(table(spark, sf_dir, "documents"), T.collapse(F.lower("text")), "source", "doc_id")


@query(f"""WITH d AS (SELECT *, {NORM_SQL} AS k FROM documents), g AS (SELECT k, min(doc_id) AS canonical_id, arg_max(lang, (length(lang), -doc_id)) AS lang, max(n_chars) AS n_chars, list_sort(list(DISTINCT source)) AS s, count(*) AS n_members FROM d GROUP BY k)
SELECT canonical_id, lang, n_chars, array_to_string(s, ',') AS sources, n_members FROM g WHERE n_members > 1""".replace("arg_max(lang, (length(lang), -doc_id))", "arg_min(lang, doc_id)"))
def merge_groups(spark, sf_dir):
    """DED-14, SET-03: groups of equal text merged into one record each."""
    d = table(spark, sf_dir, "documents").withColumn("leader", F.md5(T.collapse(F.lower("text")))).withColumn("seq", F.col("doc_id"))
    m = dedup.merge_groups(d, longest=("lang",), first=(), earliest=(), source="source", id_col="doc_id")
    n = d.groupBy("leader").agg(F.max("n_chars").alias("n_chars"))
    return m.where("n_members > 1").join(n, "leader").select("canonical_id", "lang", "n_chars", F.array_join("sources", ",").alias("sources"), "n_members")


@query("""WITH d AS (SELECT doc_id, lower(split_part(coalesce(text, ''), chr(10), 1)) AS key FROM documents)
SELECT doc_id, key FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""")
def first_per_title(spark, sf_dir):
    """DED-01, DED-18, DED-22, WIN-01: the first row per whole title."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(title()).alias("key"))
    return dedup.first_per_key(d, ["key"], [F.col("doc_id")])


@query("""WITH d AS (SELECT doc_id, source, lower(split_part(coalesce(text, ''), chr(10), 1)) AS key FROM documents)
SELECT doc_id, source, key FROM d QUALIFY source IS NULL OR row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1""")
def first_per_whole_title(spark, sf_dir):
    """DED-01, DED-18, DED-22, WIN-01: the first row per portal and whole title."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(title()).alias("key"))
    return dedup.first_per_key(d, ["source", "key"], [F.col("doc_id")])


@query("""WITH n AS (SELECT p_name, split_part(p_name, ' ', 1) AS block, count(*) AS c, min(p_partkey) AS class_id FROM part GROUP BY 1, 2),
l AS (SELECT a.p_name, sum(b.c)::BIGINT AS n_links, string_agg(b.class_id::VARCHAR, ',' ORDER BY b.class_id) AS linked FROM n a JOIN n b ON a.block = b.block AND levenshtein(a.p_name, b.p_name) = 1 GROUP BY 1)
SELECT p_partkey, class_id, c AS class_size, coalesce(n_links, 0) AS n_links, coalesce(linked, '') AS linked FROM part JOIN n USING (p_name) LEFT JOIN l USING (p_name)""")
def fuzzy_levenshtein(spark, sf_dir):
    """DED-08, JOI-23: a blocked similarity join with a built-in distance: each part with its class (equal names) and the number and the classes of parts one edit away, which together are all pairs of parts within one edit. Names meet, not parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ")[0].alias("block"))
    names = p.groupBy("p_name", "block").agg(F.count("*").alias("class_size"), F.min("p_partkey").alias("class_id"))
    near = dedup.within_one_edit(names, "p_name", "block")
    sizes = names.select(F.col("p_name").alias("y"), "class_size", "class_id")
    links = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))).join(sizes, "y").groupBy(F.col("x").alias("p_name")).agg(F.sum("class_size").alias("n_links"), F.array_join(F.array_sort(F.collect_list("class_id")).cast("array<string>"), ",").alias("linked"))  # a name has as many neighbours as its letters allow
    known = names.join(links, "p_name", "left").select("p_name", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("linked", F.lit("")).alias("linked"))
    return hot_key_join(p, known.withColumn("_n", F.col("class_size")), ["p_name"], "_n", p.count()).select("p_partkey", "class_id", "class_size", "n_links", "linked")


@query()
def fuzzy_ratio(spark, sf_dir):
    """DED-09 to DED-12: greedy leaders by matching-block ratio, over titles."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), title().alias("title"), F.lit(None).cast("string").alias("organization"), F.lit("src").alias("source_site"), F.lit(None).cast("date").alias("deadline"))
    return dedup.group_batch(d).select("id", "leader")


SERVICE_SQL = "least(6, " + " + ".join(f"{int(g.weight)} * regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])({t})([^\\p{{L}}\\p{{N}}_]|$)')::INT" for g in SERVICES.groups for t in g.terms) + ")"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])(secret|password)([^\\p{{L}}\\p{{N}}_]|$)') THEN 0 ELSE round_even({SERVICE_SQL} * 100.0 / 6, 0)::INT END AS score FROM documents""")
def vocabulary_score(spark, sf_dir):
    """SCO-02, FLT-01, FLT-02: a capped layer of weighted words; blocked words make it 0."""
    layers, blocked = [Layer("service", SERVICES, 0, 6)], ["secret", "password"]
    d, h = T.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [*blocked, *word_terms(SERVICES)])
    return d.select("doc_id", layered_score(h, layers, 6, T.has_word(h, blocked)).alias("score"))


def _hits_sql(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])({t})([^\\p{{L}}\\p{{N}}_]|$)')::INT" for t in terms)


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"{_hits_sql(g.terms)} AS h{i}" for i, g in enumerate(SECTORS.groups)) + " FROM documents) SELECT doc_id, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN 'General' " + " ".join(f"WHEN h{i} = greatest(h0, h1, h2, h3) THEN '{g.name}'" for i, g in enumerate(SECTORS.groups)) + " END AS sector, h0 + h1 + h2 + h3 AS n_hits FROM h")
def sector_argmax(spark, sf_dir):
    """CLS-01, CLS-02: the class with most hits, the earlier one of equals."""
    d, h = T.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", word_terms(SECTORS))
    return d.select("doc_id", best_group(h, SECTORS, "General").alias("sector"), sum((T.count_terms(h, g.terms) for g in SECTORS.groups), F.lit(0)).alias("n_hits"))


def _has_sql(column: str, terms: tuple[str, ...]) -> str:
    return f"regexp_matches(lower(coalesce({column}, '')), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(terms)})([^\\p{{L}}\\p{{N}}_]|$)')"


_GROUPS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_has_sql('text', g.terms)} THEN '{g.name}' END" for g in SERVICES.groups) + "], lambda x: x IS NOT NULL)"
_CLASSES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_has_sql('text', g.terms)} THEN '{g.name}' END" for g in SECTORS.groups) + "], lambda x: x IS NOT NULL)"


@query("WITH d AS (SELECT doc_id, text, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents), p AS (SELECT *, list_sort(list_filter([" + ", ".join(f"{{'o': -({_has_sql('title', g.terms)}::INT * 3 + {_has_sql('text', g.terms)}::INT), 'p': {i}, 'name': '{g.name}'}}" for i, g in enumerate(SECTORS.groups)) + f"""], lambda x: x.o < 0)) AS r FROM d)
SELECT doc_id, '[' || array_to_string(list_transform(r, lambda x: '{{"name":"' || x.name || '","points":' || -x.o || '}}'), ',') || ']' AS ranked, array_to_string({_GROUPS_SQL}, ',') AS groups FROM p""")
def title_body_classes(spark, sf_dir):
    """CLS-01, SCO-01: classes by points of title and body."""
    d, head = T.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text", title().alias("title")), "title", word_terms(SECTORS), "_head")
    d, body = T.with_hits(d, "text", word_terms(SECTORS, SERVICES))
    return d.select("doc_id", F.to_json(title_and_body(head, body, SECTORS)).alias("ranked"), F.array_join(matching_groups(body, SERVICES), ",").alias("groups"))


@query(f"""SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 10 THEN 'too short'
WHEN len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains({list(T.STOP_WORDS)}, w))) = 0 THEN 'generic' WHEN n_chars < 200 THEN 'low score' END AS reason FROM documents""")
def quality_gate(spark, sf_dir):
    """FLT-06, FLT-07: why a row is rejected, null where it is not."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", classify.quality_gate(F.col("text"), F.col("n_chars"), 200, low=0).alias("reason"))


@query("""SELECT p_partkey, (p_name LIKE '%green%' OR p_name LIKE '%blue%') AND NOT (p_name LIKE '%red%') AS passes FROM part""")
def reject_then_require(spark, sf_dir):
    """FLT-03, FLT-08, FLT-21 to FLT-25"""
    return table(spark, sf_dir, "part").select("p_partkey", classify.reject_then_require(F.col("p_name"), ["red"], ["green", "blue"]).alias("passes"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice / 5000.0 >= 75 AND o_custkey % 100 / 100.0 >= 0.70 THEN 'BID_NOW' WHEN o_custkey % 100 / 100.0 < 0.40 THEN 'IGNORE' WHEN o_totalprice / 5000.0 >= 60 THEN 'STRONG_CONSIDER' WHEN o_totalprice / 5000.0 >= 40 THEN 'WEAK_CONSIDER' ELSE 'IGNORE' END AS tier FROM orders""")
def decision_tiers(spark, sf_dir):
    """CLS-13"""
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.decision_tier(F.col("o_totalprice") / 5000, (F.col("o_custkey") % 100) / 100.0).alias("tier"))


EMAIL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"


@query(f"""WITH e AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{EMAIL}', 1) AS m FROM documents), u AS (SELECT doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS d FROM e)
SELECT doc_id, array_to_string(list_slice(d, 1, 5), ',') AS emails FROM u WHERE len(d) > 0""")
def emails(spark, sf_dir):
    """DOC-09"""
    d = table(spark, sf_dir, "documents").select("doc_id", documents.emails(F.col("text")).alias("e"))
    return d.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("emails"))


@query()
def html_text(spark, sf_dir):
    """DOC-01, DOC-02: text of pages."""
    return table(spark, sf_dir, "pages").select("page_id", documents.html_text("html").alias("line"), documents.html_blocks("html").alias("blocks"))


@query()
def page_links(spark, sf_dir):
    """DOC-05: links of pages."""
    find = documents.link_finder(("page", "doc", "http"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(find("html", "url")).alias("l")).select("page_id", "l.url", "l.label", "l.file_type")


@query()
def evidence_state(spark, sf_dir):
    """CLS-18 to CLS-20: the evidence that a page gives."""
    p = table(spark, sf_dir, "pages").withColumn("t", documents.html_text("html"))
    state = classify.evidence_state(F.length("t"), F.size(documents.links_in_text(F.col("html"))), F.lit(0), F.lit(False))
    return p.select("page_id", state.alias("state"), classify.maturity(state)["action"].alias("action"))


@query("""SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages WHERE lower(regexp_extract(url, '://([^/?#:]+)', 1)) NOT LIKE '%site1%'""")
def allowed_hosts(spark, sf_dir):
    """FLT-17"""
    p = table(spark, sf_dir, "pages")
    return p.where(~classify.blocked_domain(F.col("url"), ["site1"])).select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))


@query()
def normalised_records(spark, sf_dir):
    """NRM-01 to NRM-13: documents as raw rows, normalised."""
    d = table(spark, sf_dir, "documents")
    raw = d.select(F.col("source"), F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("title"), title(), F.lit("summary"), F.col("text"), F.lit("place"), F.col("lang")).alias("raw"))
    return normalize.normalise(raw, as_of())


# --- vectors and search -----------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, similarity, rank::INT AS rank FROM r WHERE rank <= 5""")
def knn_cosine(spark, sf_dir):
    """VEC-01, VEC-02: exact nearest neighbours; the queries are the vectors whose id 20 divides."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 20 = 0"), 5)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_by_lists(spark, sf_dir):
    """VEC-02, OPP-13: nearest neighbours from inverted lists, made exact by the lists' radii."""
    e = table(spark, sf_dir, "embeddings")
    return vector_lists.nearest(vector_lists.build(e), e.where("vec_id % 20 = 0"), 10)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, similarity, rank::INT AS rank FROM r WHERE rank <= 5 AND similarity >= 0.3""")
def semantic_duplicates(spark, sf_dir):
    """DED-04: neighbours from a similarity on, from those lists alone that can have such."""
    e = table(spark, sf_dir, "embeddings")
    return vector_lists.semantic_duplicates(e, e.where("vec_id % 20 = 0"), 0.3)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS sim FROM embeddings JOIN q ON vec_id <> query_id),
d AS (SELECT doc_id, n_chars % 101 AS priority, doc_id % 101 AS fit, len(list_filter(['the', 'and', 'der'], lambda w: regexp_matches(lower(text), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)'))) / 3.0 AS lexical FROM documents)
SELECT query_id, vec_id, round_even(least(1.0, 0.40 * sim + 0.25 * priority / 100 + 0.20 * fit / 100 + 0.15 * lexical), 2) + 0.0 AS score FROM s JOIN d ON doc_id = vec_id WHERE sim >= -0.2 AND NOT priority < 10""")
def hybrid_rank(spark, sf_dir):
    """RET-04, RET-06, RET-07: vector, rule and lexical evidence in one score, of every vector for each one whose id 20 divides. Evidence of a document is worked out once, where its text lies, and goes with its vector."""
    e = table(spark, sf_dir, "embeddings")
    lexical = search.lexical_score(F.array(*map(F.lit, ("the", "and", "der"))), T.tokens("text"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("n_chars") % 101).alias("priority"), (F.col("doc_id") % 101).alias("fit"), lexical.alias("lexical")).where(~(F.col("priority") < 10))
    near = vectors.similarities(e.join(d, "vec_id"), e.where("vec_id % 20 = 0"), ["priority", "fit", "lexical"], least=-0.2)
    total = search.composite(F.col("similarity"), F.col("priority"), F.col("fit"), F.col("lexical"), digits=None)
    return near.select("query_id", F.col("id").alias("vec_id"), (F.rint(total * 100) / 100 + F.lit(0.0)).alias("score"))  # hundredths as a double, none of them -0, as SQL rounds


@query("""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part) SELECT p_partkey FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'co'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'wi'))) > 0""")
def token_search(spark, sf_dir):
    """RET-11: every token of the query as a prefix, from the postings of an index alone."""
    return text_index.prefix_search(text_index.segment(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name")), "co wi").select(F.col("id").alias("p_partkey"))


_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"


@query(f"""WITH q AS (SELECT item_id AS query_id, {_TOKENS.format('text')} AS t FROM benchmark), d AS (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents),
s AS (SELECT query_id, id, count(*)::DOUBLE / any_value(n) AS score FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM q) JOIN d USING (term) GROUP BY query_id, id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def ranked_search(spark, sf_dir):
    """RET-04: documents by the share of a query's tokens that they have, for all benchmark items, from postings."""
    index = text_index.segment(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return text_index.ranked(index, table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


@query("""WITH t AS (SELECT p_partkey AS id, regexp_extract_all(lower(CASE WHEN p_partkey % 10 = 0 THEN p_type ELSE p_name END), '[a-z0-9]+') AS w FROM part),
q AS (SELECT DISTINCT p_partkey % 50 AS query_id, list_distinct(regexp_extract_all(lower(left(split_part(p_name, ' ', 1), 2) || ' ' || left(split_part(p_name, ' ', 2), 3)), '[a-z0-9]+')) AS a FROM part WHERE p_partkey < 50)
SELECT query_id, id FROM q, t WHERE len(list_filter(a, lambda x: len(list_filter(w, lambda y: starts_with(y, x))) > 0)) = len(a)""")
def indexed_updates(spark, sf_dir):
    """RET-11, RET-12: an index that a second segment has updated (one part in ten has another text), merged, and searched for a table of queries."""
    p = table(spark, sf_dir, "part")
    old = text_index.segment(p, "p_partkey", F.col("p_name"))
    index = text_index.merged(text_index.with_segment(old, text_index.segment(p.where("p_partkey % 10 = 0"), "p_partkey", F.col("p_type"), 1)))
    words = F.split("p_name", " ")
    asked = p.where("p_partkey < 50").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.left(words[0], F.lit(2)), F.left(words[1], F.lit(3))).alias("q"))
    return text_index.prefix_searches(index, asked, "query_id", F.col("q"))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority = 'none' AND o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' AND o_totalprice > 1e9 THEN 1 WHEN o_orderstatus = 'P' THEN 2 WHEN TRUE THEN 3 END AS step FROM orders)
SELECT o_orderkey, step::INT AS step FROM s WHERE step <= (SELECT min(step) FROM s) ORDER BY o_totalprice DESC, o_orderkey LIMIT 40""")
def relaxation(spark, sf_dir):
    """RET-09: the first of ever looser filters that finds anything."""
    o = table(spark, sf_dir, "orders")
    p, f = F.col("o_orderstatus") == "P", (F.col("o_orderpriority") == "none") & (F.col("o_orderstatus") == "F")
    return search.relaxed(o, [f, p & (F.col("o_totalprice") > 1e9), p, F.lit(True)], "o_orderkey", 40, [F.desc("o_totalprice")]).select("o_orderkey", "step")


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS round FROM documents) SELECT doc_id, source, round::INT AS round FROM r WHERE round <= 3 ORDER BY round, n_chars DESC, doc_id LIMIT 40""")
def balanced_round_robin(spark, sf_dir):
    """WIN-02: at most three a source, in turn."""
    return search.balanced(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 3, 40).select("doc_id", "source", "round")


@query("""WITH d AS (SELECT doc_id, n_chars AS score, quality AS rel FROM documents JOIN labels USING (doc_id)), t AS (SELECT rel, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d QUALIFY r <= 50), i AS (SELECT rel, row_number() OVER (ORDER BY rel DESC) AS r FROM d QUALIFY r <= 50)
SELECT round(sum(rel) / 50.0, 6) AS precision, round(sum(rel)::DOUBLE / (SELECT sum(rel) FROM d), 6) AS recall, round(sum((2 ** rel - 1) / log2(r + 1)) / (SELECT sum((2 ** rel - 1) / log2(r + 1)) FROM i), 6) AS ndcg FROM t""")
def ranking_metrics(spark, sf_dir):
    """WIN-04: precision, recall and nDCG at 50 of documents by length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    m = search.ranking_metrics(d, "n_chars", "quality", "doc_id", 50)
    return m.select([F.round(c, 6).alias(c) for c in m.columns])


# --- source health ----------------------------------------------------------------------------------------------


@query(f"""WITH {RUNS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run_id DESC) AS place FROM runs QUALIFY place <= 10),
k AS (SELECT *, sum((row_count > 0)::INT) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS alive FROM l WHERE status <> 'SKIP'),
m AS (SELECT source, count(*) AS n_runs, round_even(avg((status = 'OK')::INT) * 100, 1) AS success_rate, round_even(avg(row_count), 1) AS avg_rows, count(*) FILTER (WHERE alive = 0) AS zero_streak, arg_min(status, place) AS last_status, arg_min(row_count, place) AS last_rows FROM k GROUP BY source),
f AS (SELECT s.source, coalesce(n_runs, 0) AS n_runs, coalesce(success_rate, 100.0) AS success_rate, coalesce(avg_rows, 0.0) AS avg_rows, coalesce(zero_streak, 0) AS zero_streak, last_status, last_rows FROM (SELECT DISTINCT source FROM l) s LEFT JOIN m USING (source)),
u AS (SELECT *, (zero_streak >= 5 OR (success_rate < 30 AND n_runs >= 3)) AND NOT coalesce(last_status = 'OK' AND last_rows > 0, FALSE) AS unstable FROM f)
SELECT *, CASE WHEN unstable THEN 'unstable' WHEN success_rate < 80 THEN 'partial' ELSE 'stable' END AS state FROM u""")
def source_health(spark, sf_dir):
    """HLT-01, HLT-02, HLT-06, HLT-10"""
    return health.stability(health.metrics(runs(spark, sf_dir)))


@query(f"""WITH {RUNS_SQL}, w AS (SELECT *, row_number() OVER w AS place, avg(row_count) OVER (PARTITION BY source ORDER BY run_at DESC, run_id DESC ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS avg_before FROM runs WINDOW w AS (PARTITION BY source ORDER BY run_at DESC, run_id DESC))
SELECT source, row_count, round_even(avg_before, 2) AS avg_before FROM w WHERE place = 1 AND row_count = 0 AND avg_before > 1""")
def broken_sources(spark, sf_dir):
    """HLT-04, HLT-11"""
    return health.broken(runs(spark, sf_dir), 1)


@query(f"""WITH {RUNS_SQL}, w AS (SELECT *, lag(row_count) OVER w AS prev_rows, lag(row_count, 2) OVER w AS prev2 FROM runs WINDOW w AS (PARTITION BY source ORDER BY run_at, run_id))
SELECT source, run_id, prev_rows, CASE WHEN row_count = 0 AND prev_rows = 0 AND prev2 = 0 THEN 'FAIL' WHEN row_count = 0 THEN 'WARN' ELSE 'OK' END AS level FROM w""")
def run_escalation(spark, sf_dir):
    """HLT-03, HLT-05, STM-05"""
    return health.escalated(runs(spark, sf_dir)).select("source", "run_id", "prev_rows", "level")


@query(f"""WITH {RUNS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run_id DESC) AS place FROM runs QUALIFY place <= 10)
SELECT source, avg((row_count = 0)::INT) AS zero_share, NOT (count(*) >= 3 AND avg((row_count = 0)::INT) >= 0.6) AS retry FROM l GROUP BY source""")
def retry_policy(spark, sf_dir):
    """HLT-07"""
    return health.structural_zero(runs(spark, sf_dir))


@query(f"""WITH {RUNS_SQL} SELECT source, count(*) AS n_runs, count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'WARN') AS n_warn, count(*) FILTER (WHERE status = 'FAIL') AS n_fail, round_even(avg(row_count), 1) AS avg_rows, max(run_at) AS last_run FROM runs GROUP BY source""")
def run_summary(spark, sf_dir):
    """AGG-10"""
    return health.run_summary(runs(spark, sf_dir))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run_id DESC) AS place FROM runs QUALIFY place <= 10),
m AS (SELECT source, round_even(avg((status = 'OK')::INT) * 100, 1) AS rate FROM l GROUP BY source)
SELECT doc_id, least(100, greatest(0, round_even(coalesce(rate, 70.0) * 0.4 + CASE WHEN n_chars >= 1000 THEN 20 WHEN n_chars >= 300 THEN 10 ELSE 0 END + CASE WHEN lang = 'en' THEN 20 ELSE 0 END + 10, 0)))::INT AS confidence
FROM documents LEFT JOIN m ON m.source = doc_id % 200""")
def data_confidence(spark, sf_dir):
    """CNF-01, HLT-14: a source's rate with what a record has."""
    m = health.metrics(runs(spark, sf_dir), drop_skips=False).select(F.col("source").alias("_s"), "success_rate")
    d = table(spark, sf_dir, "documents").withColumn("_k", F.col("doc_id") % 200)
    j = d.join(m, F.col("_k") == F.col("_s"), "left")
    words = F.when(F.col("n_chars") >= 1000, 100).when(F.col("n_chars") >= 300, 30).otherwise(0)
    return j.select("doc_id", classify.data_confidence(F.col("success_rate"), words, F.when(F.col("lang") == "en", F.lit("x")), F.lit(None).cast("string"), F.col("source")).alias("confidence"))


# --- lifecycle, learning ---------------------------------------------------------------------------------------

LIFE_SQL = """life AS (SELECT o_orderkey, c_mktsegment, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN 'BID_NOW' WHEN 1 THEN 'STRONG_CONSIDER' WHEN 2 THEN 'WEAK_CONSIDER' END AS tier,
 CASE o_orderstatus WHEN 'F' THEN 'bid' WHEN 'O' THEN 'no_bid' END AS bid_decision, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 150000 THEN 'won' ELSE 'lost' END END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def life(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    tier = classify.by_table(F.col("o_orderkey") % 4, {0: "BID_NOW", 1: "STRONG_CONSIDER", 2: "WEAK_CONSIDER"})
    decision = classify.by_table(F.col("o_orderstatus"), {"F": "bid", "O": "no_bid"})
    outcome = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_totalprice") > 150000, "won").otherwise("lost"))
    return o.select("o_orderkey", "c_mktsegment", "o_orderpriority", tier.alias("model_decision_tag"), decision.alias("bid_decision"), outcome.alias("outcome"))


STATS_SQL = LIFE_SQL + """, s AS (SELECT t.tier, count(o_orderkey) AS total, count(bid_decision) AS decided, count(*) FILTER (WHERE bid_decision = 'bid') AS bids, count(*) FILTER (WHERE outcome = 'won') AS won, count(*) FILTER (WHERE outcome = 'lost') AS lost
 FROM (VALUES ('BID_NOW'), ('STRONG_CONSIDER'), ('WEAK_CONSIDER'), ('IGNORE')) t(tier) LEFT JOIN life USING (tier) GROUP BY t.tier)"""


@query(f"""WITH {STATS_SQL} SELECT *, bids / nullif(decided, 0)::DOUBLE AS bid_rate, won / nullif(won + lost, 0)::DOUBLE AS win_rate FROM s""")
def tier_stats(spark, sf_dir):
    """AGG-19, JOI-05, JOI-06"""
    return lifecycle.tier_stats(life(spark, sf_dir))


@query(f"""WITH {STATS_SQL} SELECT round(sum(decided)::DOUBLE / sum(total), 6) AS coverage, round(sum(won)::DOUBLE / sum(won + lost), 6) AS win_rate, round((sum(won) FILTER (WHERE tier = 'BID_NOW'))::DOUBLE / sum(won + lost) FILTER (WHERE tier = 'BID_NOW'), 6) AS top_precision FROM s""")
def decision_accuracy(spark, sf_dir):
    """CAL-01"""
    a = lifecycle.accuracy(lifecycle.tier_stats(life(spark, sf_dir)))
    return a.select(*[F.round(c, 6).alias(c) for c in ("coverage", "win_rate", "top_precision")])


@query(f"""WITH {STATS_SQL}, t AS (SELECT sum(total)::DOUBLE AS total, sum(decided)::DOUBLE AS decided, sum(won)::DOUBLE AS won, sum(lost)::DOUBLE AS lost FROM s),
a AS (SELECT t.decided / t.total AS coverage, t.won / nullif(t.won + t.lost, 0) AS win_rate, s.won / nullif(s.won + s.lost, 0)::DOUBLE AS top_precision, s.won / nullif(t.won, 0) AS top_recall, s.total / t.total AS top_share, s.bids / nullif(s.decided, 0)::DOUBLE AS top_bid_rate FROM s, t WHERE tier = 'BID_NOW'),
r AS (SELECT *, CASE WHEN top_bid_rate < 0.5 THEN 'raise score' WHEN top_precision < 0.2 THEN 'raise confidence' WHEN top_share < 0.05 THEN 'lower score' ELSE 'keep' END AS rule FROM a)
SELECT *, 75e0 + CASE rule WHEN 'raise score' THEN 5 WHEN 'lower score' THEN -3 ELSE 0 END AS score, 0.70e0 + CASE rule WHEN 'raise confidence' THEN 0.05e0 ELSE 0e0 END AS confidence FROM r""")
def threshold_suggestion(spark, sf_dir):
    """CAL-02, CAL-03"""
    return lifecycle.suggest_thresholds(lifecycle.accuracy(lifecycle.tier_stats(life(spark, sf_dir))))


@query(f"""WITH {LIFE_SQL}, x AS (SELECT 'c_mktsegment' AS field, c_mktsegment AS value, outcome FROM life UNION ALL SELECT 'o_orderpriority', o_orderpriority, outcome FROM life),
p AS (SELECT field, value, count(*) AS decided, count(*) FILTER (WHERE outcome = 'won') AS won FROM x WHERE outcome IN ('won', 'lost') AND value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT field, value, decided, won, round_even(won / decided, 4) AS win_rate, row_number() OVER (PARTITION BY field ORDER BY round_even(won / decided, 4) DESC, decided DESC, value)::INT AS rank FROM p QUALIFY rank <= 5""")
def winning_signals(spark, sf_dir):
    """AGG-20"""
    return lifecycle.winning_signals(life(spark, sf_dir), ["c_mktsegment", "o_orderpriority"])


@query(f"""WITH {LIFE_SQL} SELECT o_orderkey, CASE WHEN outcome NOT IN ('won', 'lost', 'no_submission', 'pending') THEN 'unknown outcome' WHEN outcome IN ('won', 'lost') AND NOT coalesce(bid_decision = 'bid', FALSE) THEN 'needs a bid' END AS error FROM life""")
def outcome_errors(spark, sf_dir):
    """LIF-03, SUB-22"""
    return life(spark, sf_dir).select("o_orderkey", lifecycle.outcome_error(F.col("outcome"), F.col("bid_decision")).alias("error"))


@query()
def label_model(spark, sf_dir):
    """LRN-01 to LRN-04, LRN-06: a balanced logistic regression on labelled documents, scored on them."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), (F.length("text") / 1000.0).alias("kchars"), "lang", T.count_terms("text", ["###", "!!", "%%%"], "part").alias("marks"))
    x = learning.featurise(d, ["kchars", "marks"], ["lang"])
    return learning.probability(x, learning.fit_logistic(x)).select("doc_id", "label", F.round("probability", 3).alias("probability"))


# --- incremental ------------------------------------------------------------------------------------------------

SPLIT = "2024-01-16"


SNAP_SQL = "SELECT user_id, max(value) AS score, arg_max(event_type, row(ts, event_id)) AS stage, md5(arg_max(props, row(ts, event_id))) AS content FROM events"


@query(f"""WITH b AS ({SNAP_SQL} WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1), a AS ({SNAP_SQL} WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1),
j AS (SELECT coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'new' WHEN a.user_id IS NULL THEN 'gone' WHEN a.score - b.score >= 12 THEN 'upgraded' WHEN a.stage IS DISTINCT FROM b.stage THEN 'stage' WHEN a.content IS DISTINCT FROM b.content THEN 'content' ELSE 'same' END AS change, b.score AS old_score, a.score AS new_score FROM b FULL JOIN a ON a.user_id = b.user_id)
SELECT user_id, change, CASE change WHEN 'new' THEN 3 WHEN 'upgraded' THEN 2 WHEN 'stage' THEN 1 WHEN 'content' THEN 1 ELSE 0 END AS alert, old_score, new_score FROM j""")
def change_classification(spark, sf_dir):
    """CDC-01, CDC-02, CDC-05: two snapshots compared, of all users before and after the split."""
    e = table(spark, sf_dir, "events")
    split, last = F.lit(SPLIT).cast("timestamp"), F.struct("ts", "event_id")
    snap = lambda d: d.groupBy("user_id").agg(F.max("value").alias("score"), F.max_by("event_type", last).alias("stage"), F.md5(F.max_by("props", last)).alias("content"))
    return upsert.changes(snap(e.where(F.col("ts") < split)), snap(e.where(F.col("ts") >= split)), "user_id", "score", "stage", "content")


@query("""WITH v AS (SELECT user_id, md5(event_type) AS h, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) AS n_versions, count(*) FILTER (WHERE p <> h AND p <> '') AS n_amendments FROM v GROUP BY user_id""")
def amendment_counts(spark, sf_dir):
    """CDC-03"""
    return upsert.amendments(table(spark, sf_dir, "events").withColumn("h", F.md5("event_type")), "user_id", ["ts", "event_id"], "h")


@query(f"""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def keyed_upsert(spark, sf_dir):
    """UPS-01, SNK-01, VEC-03: an older half upserted with a newer one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("v"), "event_id", "value")
    old, new = (e.where(c) for c in (F.col("v.ts") < F.lit(SPLIT).cast("timestamp"), F.col("v.ts") >= F.lit(SPLIT).cast("timestamp")))
    return upsert.upsert(old, new, ["user_id", "event_type"], "v").select("user_id", "event_type", "event_id", "value")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS admitted, [t] AS recent FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END FROM (SELECT e.*, list_filter(r.recent, lambda x: x > e.t - 3600) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS client, event_id AS id, admitted FROM r""")
def rate_limit(spark, sf_dir):
    """STM-01: events of a user within an hour, three at most; rejected ones don't count."""
    return streams.rate_limit(table(spark, sf_dir, "events"), 3600, 3, "user_id", "ts", "event_id")


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def daily_windows(spark, sf_dir):
    """Extension: tumbling windows of event time, in batch."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("user_id", F.col("window.start").alias("start"), "n", "total")


# --- grounding ------------------------------------------------------------------------------------------------------

ANSWERS_SQL = """answers AS (SELECT c.conv_id, c.turn, c.text AS query, coalesce(a.text, '') AS answer, a.text IS NULL AS abstained, c.turn % 3 AS n_citations FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user')"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    j = c.where("role = 'user'").join(a, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", F.col("text").alias("query"), F.coalesce("said", F.lit("")).alias("answer"), F.col("said").isNull().alias("abstained"), (F.col("turn") % 3).alias("n_citations"))


FACTS_SQL = """len(list_filter(['which', 'what', 'who', 'when', 'where', 'deadline', 'budget', 'amount', 'cost', 'eligibility', 'requirement', 'documents', 'give me', 'list', 'show', 'top', 'best'], lambda w: contains(lower(query), w))) > 0"""
CLAIMS_SQL = r"""(regexp_matches(answer, '\b\d{1,3}(,\d{3})+(\.\d+)?\b') OR regexp_matches(answer, '\b\d+(\.\d+)?\s*%\b') OR regexp_matches(lower(answer), '\b(usd|inr|eur|rs\.?)\s*\d') OR regexp_matches(lower(answer), '\b\d+\s+(days|weeks|months|years)\b'))"""


@query(f"""WITH {ANSWERS_SQL}, m AS (SELECT *, {FACTS_SQL} AS fact, {CLAIMS_SQL} AS claim, n_citations > 0 AS cited FROM answers)
SELECT count(*) AS n, count(*) FILTER (WHERE fact) AS n_fact, count(*) FILTER (WHERE abstained) AS n_abstained, count(*) FILTER (WHERE fact AND NOT abstained) AS n_fact_answered, count(*) FILTER (WHERE cited) AS n_cited, count(*) FILTER (WHERE claim) AS n_claim, count(*) FILTER (WHERE claim AND NOT cited) AS n_claim_uncited,
round_even(count(*) FILTER (WHERE cited) * 100.0 / count(*), 1)::DOUBLE AS cited_percent, coalesce(round_even(count(*) FILTER (WHERE claim AND NOT cited) * 100.0 / nullif(count(*) FILTER (WHERE claim), 0), 1), 0)::DOUBLE AS uncited_claim_percent FROM m""")
def grounding_report(spark, sf_dir):
    """AGG-22, AGG-26, GRD-02, GRD-08"""
    return grounding.report(answers(spark, sf_dir))




# --- further operators -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, source, n_chars FROM documents JOIN labels USING (doc_id) WHERE source IN ('src0', 'src1', 'src2') AND n_chars >= 500 AND quality = 1 ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def faceted_search(spark, sf_dir):
    """RET-12, SRT-01: a filtered, sorted page."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select(F.col("doc_id").alias("tender_id"), F.col("source").alias("source_site"), F.col("n_chars").alias("priority_score"), (F.col("quality") == 0).alias("is_expired"), F.lit(False).alias("is_duplicate"))
    out = search.faceted(d, search.Facets(sources=("src0", "src1", "src2"), least_score=500, page=1))
    return out.select(F.col("tender_id").alias("doc_id"), F.col("source_site").alias("source"), F.col("priority_score").alias("n_chars"))


@query(f"""WITH {ANSWERS_SQL} SELECT CASE WHEN regexp_matches(lower(query), '(^|[^\\p{{L}}\\p{{N}}_])(the|is)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'english' WHEN regexp_matches(lower(query), '(^|[^\\p{{L}}\\p{{N}}_])(der|und)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'german' ELSE 'general' END AS query_type, count(*) AS n FROM answers GROUP BY 1""")
def query_types(spark, sf_dir):
    """CLS-25, CLS-26: the first family of words in a question."""
    kinds = of("query", {"english": ["the", "is"], "german": ["der", "und"]})
    return answers(spark, sf_dir).groupBy(classify.query_type(F.col("query"), kinds).alias("query_type")).agg(F.count("*").alias("n"))


@query(f"""WITH {ANSWERS_SQL}, f AS (SELECT conv_id, min(turn % 5 + 1) AS rating FROM answers WHERE NOT abstained GROUP BY 1) SELECT rating::INT AS rating, count(*) AS n FROM answers LEFT JOIN f USING (conv_id) GROUP BY 1""")
def answer_ratings(spark, sf_dir):
    """AGG-23, AGG-24, JOI-21: answers by rating, none included; all conversations with an answer are rated."""
    a = answers(spark, sf_dir).withColumn("event_id", F.col("conv_id"))
    f = a.where("NOT abstained").groupBy("event_id").agg(F.min(F.col("turn") % 5 + 1).cast("int").alias("rating"))
    return grounding.ratings(a, f)


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN upper(c_name) END AS name, CASE WHEN c_acctbal < 5000 THEN lower(c_mktsegment) END AS seg FROM customer)
SELECT o.c_custkey, CASE WHEN name IS NULL THEN o.c_name ELSE nullif(trim(name), '') END AS c_name, CASE WHEN seg IS NULL THEN o.c_mktsegment ELSE nullif(trim(seg), '') END AS c_mktsegment FROM customer o LEFT JOIN c USING (c_custkey)""")
def partial_update(spark, sf_dir):
    """LIF-05, SUB-13, UPS-04: an update of every row, in which the balance says which values are given."""
    c = table(spark, sf_dir, "customer")
    given = c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.upper("c_name")).alias("c_name"), F.when(F.col("c_acctbal") < 5000, F.lower("c_mktsegment")).alias("c_mktsegment"))
    return lifecycle.partial_update(c.select("c_custkey", "c_name", "c_mktsegment"), given, "c_custkey", ["c_name", "c_mktsegment"])


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 25 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 25)""")
def carried_over(spark, sf_dir):
    """JOI-18, SET-07: an export with old rows of sources that did not run."""
    p = table(spark, sf_dir, "part")
    now, before = p.where("p_size <= 25").select("p_partkey", "p_brand"), p.where("p_size > 25").select("p_partkey", "p_brand")
    return upsert.carry_over(now, before, "p_brand", "p_partkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_alerts(spark, sf_dir):
    """CDC-04, STM-03: what is due and was not sent."""
    sent = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return upsert.pending_alerts(table(spark, sf_dir, "orders"), sent, "o_orderkey", "o_totalprice", 200000).select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS asked FROM pages), e AS (SELECT url, min(page_id) AS e FROM pages GROUP BY 1), l AS (SELECT regexp_replace(url, '/+$', '') AS b, min(page_id) AS l FROM pages GROUP BY 1)
SELECT asked AS url, coalesce(e, l) AS tender_id FROM a LEFT JOIN e ON e.url = asked LEFT JOIN l ON l.b = regexp_replace(asked, '/+$', '')""")
def url_lookup(spark, sf_dir):
    """JOI-14, JOI-19: ids by URL, slashes at the end forgiven."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("tender_id"), "url")
    return upsert.by_url(p, p.select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct())


@query("""SELECT avg((try_cast(p_size AS INT) IS NULL AND p_size IS NOT NULL)::INT)::DOUBLE AS p_size, avg((try_cast(p_brand AS INT) IS NULL AND p_brand IS NOT NULL)::INT)::DOUBLE AS p_brand, avg((p_name IS NULL OR trim(p_name) = '')::INT)::DOUBLE AS p_name_missing FROM part""")
def schema_violations(spark, sf_dir):
    """DQ-01, DQ-02: shares of rows whose fields don't fit."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("p_size"), "p_brand", "p_name")
    return classify.schema_violations(p, {"p_size": "int", "p_brand": "int"}, ["p_name"])


@query("""WITH h AS (SELECT user_id AS source, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS pass_rate FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC) AS n FROM h)
SELECT source, date, round(pass_rate, 4) AS pass_rate FROM r WHERE n <= 5""")
def bounded_history(spark, sf_dir):
    """HLT-12, HLT-13: the last five days of each source, the last entry of each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), F.col("value").alias("pass_rate"))
    return health.bounded_history(e, 5).select("source", "date", F.round("pass_rate", 4).alias("pass_rate"))


@query()
def blocking_keys(spark, sf_dir):
    """DED-06, DED-08: normalised titles and their blocks, of all documents, codes and letters of any script included."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalise_title(title()).alias("norm_title"))
    return d.select("doc_id", "norm_title", T.blocking_key("norm_title").alias("block"))


@query("""SELECT o_orderkey, 'discovered' AS status FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def register_batch(spark, sf_dir):
    """LIF-01, UPS-02, JOI-09: new ids, once each."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("tender_id"), F.col("l_returnflag").alias("model_decision_tag"))
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("tender_id"))
    return lifecycle.register(stored, ids, F.current_timestamp()).select(F.col("tender_id").cast("long").alias("o_orderkey"), "status")


@query("""SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN 'gb' END, CASE WHEN lang LIKE '%r%' THEN 'fr' END, lang) AS name FROM documents""")
def canonical_names(spark, sf_dir):
    """NRM-05, NRM-15 to NRM-17, NRM-28: exact aliases, then parts, else the name itself."""
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical("lang", {"en": "gb"}, [("r", "fr")]).alias("name"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT s_suppkey, n_name AS country FROM s LEFT JOIN nation ON n_nationkey = s_nationkey""")
def imputed_country(spark, sf_dir):
    """NRM-25, NRM-29, JOI-15: blanks filled from a table with a row per source."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit("n/a").alias("country"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    return normalize.impute(s, n, "s_nationkey", ["country"]).select("s_suppkey", "country")


@query(f"""WITH g AS (SELECT doc_id, {_CLASSES_SQL} AS good, {_GROUPS_SQL} AS bad FROM documents), n AS (SELECT *, len(good) - len(bad) AS net FROM g)
SELECT doc_id, '{{"labels":[' || array_to_string(list_transform(list_concat(good, bad), lambda x: '"' || x || '"'), ',') || '],"tier":"' || CASE WHEN net >= 3 THEN 'strong' WHEN net >= 1 THEN 'moderate' WHEN len(good) > 0 THEN 'weak' ELSE 'none' END || '","change":' || net * 5 || '}}' AS signal FROM n""")
def signal_tiers(spark, sf_dir):
    """CLS-27, CLS-28, DOC-14: tiers of documents by positive and negative words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(classify.signal_tier(F.col("text"), SECTORS, SERVICES)).alias("signal"))
