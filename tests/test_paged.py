"""Recorded pages: what a contract reads, totals, gaps, and streams that go on where they stopped."""

import json
import os

import pytest
from pyspark.sql import functions as F

from noticeflow.sources import paged, readers

SHAPES = paged.Contract("shapes", "r", total="n", key="id", required=("id", "title"), floor=("day", "2024-01-02"), fields={"id": ["id"], "title": ["meta.title", "title"], "day": ["day"]})


def page(path, request, number, records, total=None):
    folder = f"{path}/request={request}/page={number}"
    os.makedirs(folder)
    body = {"r": records} | ({"n": total} if total is not None else {})
    with open(f"{folder}/body.json", "w") as f:
        json.dump(body, f)


def at(path):
    return f"file://{path}"


def test_contract(spark, tmp_path):
    page(tmp_path, "a", 0, [{"id": 1, "title": "plain"}, {"id": "2", "meta": {"title": ["first", "second"]}, "title": "x"}], 5)
    page(tmp_path, "a", 1, [{"id": 1, "title": "again"}, {"id": None, "title": "no id"}], 5)
    page(tmp_path, "a", 2, {"k": {"id": 7, "title": " n/a ", "meta": {"title": {"no": "text"}}}, "m": {"id": 8, "title": "in a dictionary", "day": "2024-01-02"}}, 5)
    page(tmp_path, "a", 3, [{"id": 9, "title": "beyond the total"}], 5)
    page(tmp_path, "b", 0, [{"id": "2", "title": "other request"}, {"id": 3, "title": "old", "day": "2024-01-01"}, {"id": 4, "title": 5}])
    got = {r.id: (r.request, r.page, r["at"], r["name"], r.title) for r in paged.read(spark, at(tmp_path), SHAPES).collect()}
    assert got == {"1": ("a", 0, 0, None, "plain"), "2": ("a", 0, 1, None, "first"), "8": ("a", 2, 1, "m", "in a dictionary"), "4": ("b", 0, 2, None, "5")}
    assert paged.recorded(spark, at(tmp_path), SHAPES, most="1").count() == 2


def test_a_request_is_written_by_many_tasks(spark, tmp_path):
    """No task has all items of a request, as a window over it would: pages follow each other over the tasks' borders."""
    items = spark.range(2000).repartition(5).select(F.when(F.col("id") % 10 > 0, "a").when(F.col("id") % 20 > 0, "b").alias("r"), (-F.col("id")).alias("o"), F.concat(F.lit('{"id":'), F.col("id"), F.lit("}")).alias("item"))
    paged.record(items, at(tmp_path), "r", ["o"], "item", 30, '{"r":[{items}],"n":{total}}')
    for folder, want in (("a", [i for i in range(1999, -1, -1) if i % 10]), ("b", list(range(1990, -1, -20))), ("__HIVE_DEFAULT_PARTITION__", list(range(1980, -1, -20)))):
        root, got = tmp_path / f"request={folder}", []
        for n in range(-(-len(want) // 30)):
            (file,) = [f for f in (root / f"page={n}").iterdir() if f.name.startswith("part-")]
            body = json.loads(file.read_text())
            assert body["n"] == len(want)
            got.append([x["id"] for x in body["r"]])
        assert [i for page in got for i in page] == want and all(len(page) == 30 for page in got[:-1])
    plans = []
    spark_read = paged.cut
    try:
        paged.cut = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or spark_read(df, name)
        paged.record(items, at(tmp_path / "again"), "r", ["o"], "item", 30, '{"r":[{items}]}')
    finally:
        paged.cut = spark_read
    assert plans and "rangepartitioning" in plans[0] and "Window" not in plans[0]


def test_values_and_links(spark):
    records = [{"l": ["http://a", {"url": " http://b "}, {"x": 1}, "c", "http://a"], "one": {"href": "http://d"}, "t": "http://e", "list": [], "n": 3.5, "m": ["x", "y", "z"]}, {}]
    df = spark.createDataFrame([("q", 0, json.dumps({"r": records}))], "request string, page int, body string")
    r = paged.records(df, SHAPES).select("at", paged.links(F.col("record"), ["l", "one", "t", "none"]).alias("u"), *[paged.value(F.col("record"), p).alias(p) for p in ("list", "n", "m", "one")], paged.listed(F.col("record"), "m", 2).alias("few"), paged.listed(F.col("record"), "n").alias("single")).orderBy("at").collect()
    assert r[0].u == ["http://a", "http://b", "http://d", "http://e"] and (r[0]["list"], r[0].n, r[0].m, r[0].one) == (None, "3.5", "x", None)
    assert r[0].few == ["x", "y"] and r[0].single == ["3.5"] and r[1].u == [] and r[1].few == []


def test_short_recordings_fail_and_empty_ones_are_empty(spark, tmp_path):
    assert paged.read(spark, at(tmp_path / "nothing"), SHAPES).count() == 0
    page(tmp_path, "a", 0, [{"id": 1, "title": "x"}], 2)
    with pytest.raises(Exception, match="1 of 2 pages"):
        paged.read(spark, at(tmp_path), SHAPES).count()
    page(tmp_path, "a", 2, [{"id": 3, "title": "z"}], 2)  # a gap
    with pytest.raises(Exception, match="1 of 2 pages"):
        paged.read(spark, at(tmp_path), SHAPES).count()


def test_a_page_that_is_no_json_fails_the_read(spark, tmp_path):
    os.makedirs(tmp_path / "request=a/page=0")
    (tmp_path / "request=a/page=0/x").write_text("<html>")
    with pytest.raises(Exception):
        paged.read(spark, at(tmp_path), paged.Contract("html", "r", {"id": ["id"]})).collect()


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    os.makedirs(source)

    def run():
        found = paged.rows(paged.records(paged.recorded(spark, at(source), SHAPES, stream=True, pages="1"), SHAPES), SHAPES)
        q = found.writeStream.format("json").option("path", str(out)).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.id, r.page) for r in spark.read.schema("id string, page int").json(str(out)).collect()) if os.path.isdir(out) else []

    page(source, "a", 0, [{"id": 1, "title": "x"}, {"id": 2, "title": "y"}])
    assert run() == [("1", 0), ("2", 0)]
    assert run() == [("1", 0), ("2", 0)]  # nothing new
    page(source, "a", 1, [{"id": 3, "title": "z"}])
    page(source, "b", 0, [{"id": 4, "title": "w"}])
    page(source, "b", 2, [{"id": 6, "title": "waits for page 1"}])
    assert run() == [("1", 0), ("2", 0), ("3", 1), ("4", 0)]
    page(source, "b", 1, [{"id": 5, "title": "v"}])
    assert run() == [("1", 0), ("2", 0), ("3", 1), ("4", 0), ("5", 1), ("6", 2)]


def test_switches_do_not_double_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, n int")
    switches = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False)], "source string, enabled boolean")
    assert sorted(tuple(r) for r in readers.enabled(rows, switches).collect()) == [("a", 1), ("c", 3)]
