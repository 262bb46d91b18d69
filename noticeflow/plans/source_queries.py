"""Queries of paged sources: rows of the driver's tables become recorded pages, which the sources' contracts read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import enrichment
from noticeflow.plans.queries import AS_OF, as_of, query, table
from noticeflow.sources import paged, signals, workbook
from noticeflow.tables import shared_dir


def _recorded(items: DataFrame, size: int, body: str, contract: paged.Contract) -> DataFrame:
    """items (request, id, item) as pages and these as records."""
    path = f"{shared_dir(items.sparkSession)}/noticeflow/pages-{uuid.uuid4().hex}"
    paged.record(items, path, "request", ["id"], "item", size, body)
    return paged.records(paged.recorded(items.sparkSession, path, contract), contract)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


@query("""WITH o AS (SELECT *, CASE WHEN o_custkey % 3 > 0 THEN 'Order for ' || o_custkey END AS description, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT lower(substr(o_orderpriority, 1, 1)) AS request, o_orderkey::VARCHAR AS id, coalesce(description, 'Project ' || o_orderkey) AS title, 'Project ' || o_orderkey AS project, o_orderstatus AS country, CASE WHEN o_custkey % 5 > 0 THEN 'C' || o_custkey ELSE NULL END AS organization, o_orderpriority AS notice_type, day AS published FROM o WHERE day >= '1995-01-01'""")
def paged_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: notices by type in pages with a total, from a day on, the first of each id; a blank description gives way to the project's name."""
    text = lambda c: F.col(c).cast("string")
    o = table(spark, sf_dir, "orders")
    item = _json(
        id=text("o_orderkey"), bid_description=F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("Order for "), text("o_custkey"))).otherwise(" "), project_name=F.concat(F.lit("Project "), text("o_orderkey")), project_ctry_name=F.col("o_orderstatus"),
        contact_organization=F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("C"), text("o_custkey"))), notice_type=F.col("o_orderpriority"), noticedate=F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    found = _recorded(o.select(F.left("o_orderpriority", F.lit(1)).alias("request"), F.col("o_orderkey").alias("id"), item.alias("item")), 500, '{"procnotices":[{items}],"total":"{total}"}', paged.NOTICES)
    return paged.rows(found, paged.NOTICES).select(F.lower("request").alias("request"), "id", "title", "project", "country", "organization", "notice_type", "published")


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as projects, in dictionaries by id, active ones and those in the pipeline as two requests."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("P"), k.cast("string"))
    approved = F.when(k % 10 > 0, F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (k % 1200).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = _json(id=name, project_name=F.col("p_name"), sector1=F.struct(F.col("p_type").alias("Name")), projdesc=F.concat_ws(" ", "p_name", "p_brand"), boardapprovaldate=approved, status=F.when(k % 4 == 0, "Pipeline").otherwise("Active"), countryshortname=F.when(k % 3 > 0, F.lit("North")), regionname=F.lit("South"), impagency=F.when(k % 2 == 0, F.col("p_brand")).otherwise("-"))
    item = F.concat(F.lit('"'), name, F.lit('":'), body)
    items = table(spark, sf_dir, "part").select(F.when(k % 4 == 0, "pipeline").otherwise("active").alias("request"), k.alias("id"), item.alias("item"))
    return paged.rows(_recorded(items, 200, '{"projects":{{items}},"total":{total}}', paged.PROJECTS), paged.PROJECTS)


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pipeline' ELSE 'active' END AS request, 'P' || p_partkey AS id, 'P' || p_partkey AS name, p_name AS title, p_type AS sector, p_name || ' ' || p_brand AS summary, CASE WHEN p_partkey % 3 > 0 THEN 'North' END AS country, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS organization FROM part""")
def paged_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: projects of two statuses, in dictionaries of dictionaries."""
    return _projects(spark, sf_dir).select("request", "id", "name", "title", "sector", "summary", "country", "organization")


INTERESTS = signals.Interests([("red", 15), ("small", 12), ("ring", 10), ("blue", 8)], ["steel", "box"], {"economy": 10, "promo": 5}, {"North": 10, "South": 2}, {"pipeline": "pipeline", "active": "active"}, 30)


@query(f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 10 > 0 THEN DATE '1996-01-01' + (p_partkey % 1200)::INT END AS day, lower(p_name || ' ' || p_brand || ' ' || p_name || ' ' || p_type) AS text, CASE WHEN p_partkey % 4 = 0 THEN 'pipeline' ELSE 'active' END AS stage, CASE WHEN p_partkey % 3 > 0 THEN 'North' ELSE 'South' END AS place FROM part),
w AS (SELECT *, list_filter([CASE WHEN contains(text, 'red') THEN 'red' END, CASE WHEN contains(text, 'small') THEN 'small' END, CASE WHEN contains(text, 'ring') THEN 'ring' END, CASE WHEN contains(text, 'blue') THEN 'blue' END], lambda x: x IS NOT NULL) AS m FROM p),
s AS (SELECT *, greatest(0, least(40, 15 * contains(text, 'red')::INT + 12 * contains(text, 'small')::INT + 10 * contains(text, 'ring')::INT + 8 * contains(text, 'blue')::INT) - CASE WHEN contains(text, 'steel') AND contains(text, 'box') THEN 5 ELSE 0 END) AS words,
 CASE WHEN day IS NULL THEN 0 WHEN day > DATE '{AS_OF}' THEN 15 WHEN DATE '{AS_OF}' - day <= 90 THEN 25 WHEN DATE '{AS_OF}' - day <= 180 THEN 20 WHEN DATE '{AS_OF}' - day <= 365 THEN 10 ELSE 0 END AS recency,
 CASE lower(p_type) WHEN 'economy' THEN 10 WHEN 'promo' THEN 5 ELSE 0 END AS sp, CASE place WHEN 'North' THEN 10 ELSE 2 END AS pp FROM w),
c AS (SELECT *, least(100, words + recency + sp + pp)::INT AS score FROM s)
SELECT 'P' || p_partkey AS source_record_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unknown' END AS organization, place AS geography, p_type AS sector, p_name || ' ' || p_brand AS summary, strftime(day, '%Y-%m-%d') AS published_date, stage AS raw_stage, score AS confidence_score,
 array_to_string(m, ', ') AS matched, (day IS NOT NULL OR stage = 'active')::INT AS procurement_signal, 'recency=' || recency || '; sector=' || sp || '; place=' || pp || '; words=' || words AS note, md5(p_name || '|' || p_name || ' ' || p_brand || '|' || stage || '|' || score) AS content_hash FROM c WHERE len(m) > 0 AND score >= 30""")
def project_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28: signals derived from the rows of SRC-02."""
    found = signals.project_signals(_projects(spark, sf_dir), as_of(), INTERESTS)
    return found.drop("url").withColumn("published_date", F.col("published_date").cast("string"))


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT event_id::VARCHAR AS notice_id, event_type || ' of ' || user_id AS title, CASE WHEN k % 2 = 0 THEN 'S' || k ELSE event_id::VARCHAR END AS sol_num, CASE k % 3 WHEN 0 THEN 'parent ' || k WHEN 1 THEN 'org ' || k END AS agency, day AS posted,
 CASE k % 4 WHEN 0 THEN 'http://a/' || k || ' http://b/' || user_id WHEN 1 THEN 'http://a/' || k WHEN 2 THEN 'http://c/' || k ELSE '' END AS links FROM e""")
def paged_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, SRC-18, NRM-34: opportunities of several queries, which overlap, the first of each id; links in lists, dictionaries and texts."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, n = F.col("k"), F.col("k").cast("string")
    url = lambda host, x: F.concat(F.lit(f"http://{host}/"), x.cast("string"))
    one = F.when(k % 4 == 0, F.concat(F.lit('[{"url":"'), url("a", k), F.lit('"},"'), url("b", F.col("user_id")), F.lit('","'), url("a", k), F.lit('"]'))).when(k % 4 == 1, F.concat(F.lit('{"href":" '), url("a", k), F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit('"'), url("c", k), F.lit('"'))).otherwise('"none"')
    head = _json(noticeId=F.col("event_id").cast("string"), title=F.concat(F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string")), solicitationNumber=F.when(k % 2 == 0, F.concat(F.lit("S"), n)), fullParentPathName=F.when(k % 3 == 0, F.concat(F.lit("parent "), n)), organizationName=F.when(k % 3 < 2, F.concat(F.lit("org "), n)), postedDate=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    item = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"resourceLinks":'), F.col("links"), F.lit("}"))
    items = e.withColumns({"h": head, "links": one}).select(F.explode(F.when(k % 7 == 0, F.array(F.lit("q1"), F.lit("q2"))).otherwise(F.array(F.when(k % 2 == 0, "q1").otherwise("q2")))).alias("request"), F.col("event_id").alias("id"), item.alias("item"))
    found = _recorded(items, 1000, '{"opportunitiesData":[{items}],"totalRecords":{total}}', paged.OPPORTUNITIES)
    out = paged.rows(found, paged.OPPORTUNITIES, links=F.array_join(paged.links(F.col("record"), ["resourceLinks", "link"]), " "))
    return out.select("notice_id", "title", "sol_num", "agency", paged.day_of("posted").alias("posted"), "links")


@query("""SELECT CASE doc_id % 3 WHEN 0 THEN 'call/' || doc_id WHEN 1 THEN 'c' || doc_id END AS identifier, source || ' call' AS title, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END AS call_type, lang AS programme, n_chars::VARCHAR AS budget, CASE WHEN doc_id % 4 = 0 THEN 'A, B, C, D, E' ELSE lang END AS countries, text AS description FROM documents WHERE text IS NOT NULL AND lower(trim(text)) NOT IN ('', 'n/a', 'na', 'none', 'null', 'nan', '-', '--', 'tbd', 'unknown')""")
def paged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, NRM-34: calls with fields in metadata, in content or in the record, in lists or not."""
    n = F.col("doc_id")
    text = n.cast("string")
    meta = F.struct(F.when(n % 3 == 0, F.array(F.concat(F.lit("call/"), text))).alias("identifier"), F.array("lang").alias("fundingScheme"), F.col("n_chars").alias("budget"), F.when(n % 4 == 0, F.array(*map(F.lit, "ABCDEF"))).otherwise(F.array("lang")).alias("locations"), F.when(n % 2 == 0, "open").alias("type"))
    content = F.struct(F.when(n % 3 == 1, F.concat(F.lit("c"), text)).alias("identifier"), F.concat("source", F.lit(" call")).alias("title"))
    item = _json(metadata=meta, content=content, type=F.lit("closed"), description=F.col("text"))
    d = table(spark, sf_dir, "documents").where(~F.lower(F.trim("text")).isin(*paged.MISSING))
    found = _recorded(d.select(F.col("source").alias("request"), n.alias("id"), item.alias("item")), 50, '{"results":[{items}],"total":{total}}', paged.CALLS)
    out = paged.rows(found, paged.CALLS, countries=F.array_join(paged.listed(F.col("record"), "metadata.locations", 5), ", "))
    return out.select("identifier", "title", "call_type", "programme", "budget", "countries", "description")


@query("""SELECT o_orderkey::VARCHAR AS tender_id, 'KA ' || o_orderkey AS title, round(o_totalprice)::BIGINT AS value, CASE WHEN o_custkey % 2 = 0 THEN 'D' || o_custkey || ' / L' ELSE 'D' || o_custkey END AS organization, o_orderstatus AS category, strftime(o_orderdate, '%Y-%m-%d') AS published, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') AS closing FROM orders""")
def paged_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, NRM-34: tenders by category and by keyword, merged, the first of each number; day first in dates."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    day = lambda c: F.date_format(c, "dd-MM-yyyy HH:mm:ss")
    item = _json(tenderNumber=F.when(F.col("o_custkey") % 3 > 0, key), id=key, title=F.concat(F.lit("KA "), key), ecv=F.round("o_totalprice").cast("long"), deptName=F.concat(F.lit("D"), customer), locationName=F.when(F.col("o_custkey") % 2 == 0, "L"), category=F.col("o_orderstatus"), publishedDate=day(F.col("o_orderdate")), tenderClosureDate=day(F.date_add("o_orderdate", 9)))
    request = F.explode(F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("category"), F.lit("keyword"))).otherwise(F.array(F.lit("category"))))
    found = _recorded(table(spark, sf_dir, "orders").withColumn("item", item).select(request.alias("request"), F.col("o_orderkey").alias("id"), "item"), 1000, '{"data":[{items}],"n":{total}}', paged.TENDERS)
    out = paged.rows(found, paged.TENDERS, category=paged.value(F.col("record"), "category"))
    return out.select("tender_id", "title", F.col("value").cast("long").alias("value"), F.concat_ws(" / ", "department", "location").alias("organization"), "category", paged.day_of("published").alias("published"), paged.day_of("closing").alias("closing"))


RULES = [enrichment.Rule("title", "detail", [r"<title>([^<]*)"], 0.9, 30), enrichment.Rule("title", "detail", [r"<h1>([^<]*)"], 0.8), enrichment.Rule("language", "detail", [r'<html lang="([a-z]+)"'], 0.7), enrichment.Rule("notice", "listing", [r"<footer>([^<]*)"], 0.6, 5)]

_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
_KNOWN = "CASE WHEN lower({0}) NOT IN ('', 'n/a', 'na', 'none', 'null', 'nan', '-', '--', 'tbd', 'unknown') THEN {0} END"


def _found_sql(pattern: str, least: int = 1) -> str:
    value = _KNOWN.format(_CLEAN.format(f"regexp_extract(coalesce(html, ''), '{pattern}', 1)"))
    return f"CASE WHEN length({value}) >= {least} THEN {value} END"


@query(f"""WITH p AS (SELECT page_id, coalesce({_found_sql("<title>([^<]*)", 30)}, {_found_sql("<h1>([^<]*)")}) AS title, {_found_sql('<html lang="([a-z]+)"')} AS language, {_found_sql("<footer>([^<]*)", 5)} AS notice FROM pages),
h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages),
r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'own title' WHEN 1 THEN 'n/a' END AS own, CASE WHEN page_id % 5 = 0 THEN 'xx' END AS lang FROM pages)
SELECT page_id, CASE WHEN own = 'own title' THEN own ELSE title END AS title, CASE WHEN own = 'own title' THEN 'record' WHEN title IS NOT NULL THEN 'detail' END AS title_from,
 coalesce(language, lang) AS language, CASE WHEN language IS NOT NULL THEN 'detail' WHEN lang IS NOT NULL THEN 'record' END AS language_from, notice, host AS agency,
 ((own IS NULL OR own = 'n/a') AND title IS NOT NULL)::INT + (language IS NOT NULL)::INT + (notice IS NOT NULL)::INT + 1 AS n_filled FROM p JOIN h USING (page_id) JOIN r USING (page_id)""")
def enriched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-12, DOC-13, SRC-31, RPR-04: records filled from their stored pages, with the origin of each value; two sources fused apart and then together."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    records = p.select("page_id", F.when(k % 4 == 0, "own title").when(k % 4 == 1, "n/a").alias("title"), F.when(k % 5 == 0, "xx").alias("language"))
    pages = enrichment.fuse(enrichment.candidates(p, RULES, "page_id", "html"))
    hosts = enrichment.candidates(p.select("page_id", F.lower("url").alias("url")), [enrichment.Rule("agency", "derived", ["://([^/?#:]+)"], 0.4)], "page_id", "url")
    out = enrichment.applied(records, enrichment.fuse(pages, hosts), "page_id", ["title", "language", "notice", "agency"], {"language": 0.5})
    at = lambda f: F.try_element_at("origins", F.lit(f)).alias(f"{f}_from")
    return out.select("page_id", "title", at("title"), "language", at("language"), "notice", "agency", "n_filled")


@query("""SELECT 'Orders' AS sheet, 1 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row, o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d') AS cells FROM orders
UNION ALL SELECT 'New', 1 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey), o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
UNION ALL SELECT 'Summary', 1 + row_number() OVER (ORDER BY count(*) DESC, o_orderstatus), o_orderstatus || '|' || count(*) || '|' FROM orders GROUP BY o_orderstatus
UNION ALL SELECT s, 1, h FROM (VALUES ('Orders', 'o_orderkey|o_orderstatus|day'), ('New', 'o_orderkey|o_orderstatus|day'), ('Summary', 'o_orderstatus|n|note')) t(s, h)""")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, SRC-29: a workbook of three sheets (all, new, summary) written by tasks, and read again row for row."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    ranked = [F.desc("o_totalprice"), F.col("o_orderkey")]
    shown = ["o_orderkey", "o_orderstatus", "day"]
    counts = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus").withColumn("note", F.lit(None).cast("string"))
    path = f"{shared_dir(spark)}/noticeflow/book-{uuid.uuid4().hex}.xlsx"
    workbook.write(path, [("Orders", rows.orderBy(*ranked).select(*shown), []), ("New", rows.where("day >= '1998-01-01'").orderBy(*ranked).select(*shown), []), ("Summary", counts, [])])
    back = workbook.read(spark, path, whole=True)
    return back.select("sheet", F.col("row").cast("long").alias("row"), F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))
