"""Every query with SQL against DuckDB, over whole tables; the rest give rows with a stable schema."""

import datetime
import decimal
import math
import re

import duckdb
import pytest

from noticeflow.plans import queries, rule_queries, source_queries  # noqa: F401  which add their own to queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name in queries.ORACLE_SQL:
        rel = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rel.fetchall())
    else:
        assert len(set(columns)) == len(columns)


def test_blocking_keys_of_all_documents(spark, con):
    want = {}
    for i, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        t = re.sub(r"\b[\w/\-]*\d{3,}[\w/\-]*\b", " ", (text or "").split("\n")[0].lower())
        t = re.sub(r"[ \t-\r]+", " ", re.sub(r"[^\w\s]|_", " ", t)).strip(" ")
        want[i] = (t, " ".join(t.split(" ")[:3]) if len(t) >= 15 else None)
    got = {r["doc_id"]: (r["norm_title"], r["block"]) for r in queries.QUERIES["blocking_keys"](spark, SF).collect()}
    assert got == want


def test_titles_that_differ_late_all_stay(spark, tmp_path):
    long = "x" * 60
    made = [(1, f"{long}a\nbody", "p"), (2, f"{long}b", "p"), (3, f"{long}A", "p"), (4, f"{long}a", "q"), (5, None, "p"), (6, "", "p"), (7, "t", None), (8, "t", None)]
    spark.createDataFrame(made, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in queries.QUERIES["first_per_whole_title"](spark, str(tmp_path)).collect()) == [1, 2, 4, 5, 7, 8]


def test_wide_queries_leave_no_row_out(spark, con):
    n = lambda sql: con.execute(sql).fetchone()[0]
    got = {name: queries.QUERIES[name](spark, SF) for name in ("change_classification", "partial_update", "answer_ratings", "hybrid_rank")}
    assert got["change_classification"].count() == n("SELECT count(DISTINCT user_id) FROM events")
    assert got["partial_update"].count() == n("SELECT count(*) FROM customer")
    assert sum(r["n"] for r in got["answer_ratings"].collect()) == n("SELECT count(*) FROM conversations WHERE role = 'user'")
    assert got["hybrid_rank"].select("query_id").distinct().count() == n("SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0")


def test_hybrid_rank_scores_every_pair_and_names_are_linked(spark):
    """No candidates by nearness alone; and the classes that a part is linked to, not their number only."""
    got = queries.QUERIES["hybrid_rank"](spark, SF)
    e, d = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("embeddings", "documents"))
    least = e.join(d.where("NOT n_chars % 101 < 10"), e["vec_id"] == d["doc_id"]).count()
    per = {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert max(per.values()) > min(60, least // 2) and all(n <= least for n in per.values())
    parts = queries.QUERIES["fuzzy_levenshtein"](spark, SF)
    sizes = {r.class_id: r.class_size for r in parts.collect()}
    for r in parts.where("n_links > 0").limit(50).collect():
        assert sum(sizes[int(x)] for x in r.linked.split(",")) == r.n_links


def test_content_hashes_are_worked_out_once(spark):
    """What finds duplicates reads hashes that were written, and no text."""
    plan = queries.QUERIES["content_hash_dupes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "content_hash" in plan and "documents.parquet" not in plan


def test_hybrid_rank_moves_no_text_and_has_no_minus_zero(spark):
    """Texts stay where they lie: a join gets their evidence only. A score of zero has no sign, as in SQL."""
    got = queries.QUERIES["hybrid_rank"](spark, SF)

    def joined(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            for c in children:
                yield {c.output().apply(i).name() for i in range(c.output().size())}
        for c in children:
            yield from joined(c)

    sides = list(joined(got._jdf.queryExecution().optimizedPlan()))
    assert any("lexical" in x for x in sides) and not any("text" in x for x in sides)
    assert got.where("score = 0").count() and not got.where("CAST(score AS STRING) = '-0.0'").count()
