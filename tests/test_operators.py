"""Operators on hand-made rows: boundaries, ties, nulls, and properties of partitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import dates, text as T, vocab
from noticeflow.functions.vocab import Layer, of, relevance
from noticeflow.operators import classify, dedup, documents, grounding, health, lifecycle, normalize, opportunity, search, upsert, vectors
from noticeflow.plans import views
from noticeflow.streaming import streams


def one(spark, **columns):
    """Values of expressions over a single row."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_text(spark):
    got = one(
        spark,
        missing=T.clean_or_null(F.lit(" N/A ")),
        there=T.clean_or_null(F.lit(" x ")),
        same=T.content_hash(F.lit("The Review, of Water")) == T.content_hash(F.lit("water  review")),
        word=T.has_word(F.lit("Technical   Assistance now"), ["technical assistance"]),
        inside=T.has_word(F.lit("support"), ["port"]),
        part=T.has_part(F.lit("support"), ["port"]),
        title=T.normalise_title(F.lit("RFP/2024/115 Évaluation of health-care"), ["rfp"]),
        short=T.blocking_key(F.lit("too short")),
        block=T.blocking_key(F.lit("evaluation of health care")),
        even=T.half_even(F.lit(2.5)),
        odd=T.half_even(F.lit(3.5)),
        broken=T.repair_mojibake(F.lit("cafÃ©")),
        whole=T.repair_mojibake(F.lit("café")),
        twice=T.string_array(F.lit('"[\\"a\\",\\"b\\"]"')),
        bad=T.string_array(F.lit("x")),
        b2=T.bracket_groups(F.lit("[Roads][R/1][77]")),
    )
    assert got["missing"] is None and got["there"] == "x" and got["same"] and got["word"] and not got["inside"] and got["part"]
    assert got["title"] == "évaluation of health care" and got["short"] is None and got["block"] == "evaluation of health"
    assert (got["even"], got["odd"]) == (2, 4) and got["broken"] == got["whole"] == "café"
    assert got["twice"] == ["a", "b"] and got["bad"] == [] and tuple(got["b2"]) == ("Roads", "R/1", "77")


@pytest.mark.parametrize("raw, want", [("2026-04-05", (2026, 4, 5)), ("15/04/2026", (2026, 4, 15)), ("04/15/2026", (2026, 4, 15)), ("5th April 2026", (2026, 4, 5)), ("Deadline: Apr 5, 2026", (2026, 4, 5)), ("5. Mai 2026 um 12:00 Uhr", (2026, 5, 5)), ("2026-04-05T10:00", (2026, 4, 5)), ("soon", None), (None, None)])
def test_dates(spark, raw, want):
    assert one(spark, d=dates.parse_date(F.lit(raw).cast("string")))["d"] == (want and dt.date(*want))


@pytest.mark.parametrize("days, want", [(-1, "expired"), (0, "closing_soon"), (7, "closing_soon"), (8, "needs_action"), (21, "needs_action"), (22, "plan_ahead"), (None, "unknown")])
def test_deadline_bucket(spark, days, want):
    today = F.lit(dt.date(2026, 1, 1))
    deadline = F.lit(None).cast("date") if days is None else F.date_add(today, days)
    assert one(spark, b=dates.deadline_bucket(deadline, today))["b"] == want


@pytest.mark.parametrize("score, confidence, want", [(75, 0.70, "BID_NOW"), (75, 0.69, "STRONG_CONSIDER"), (74, 0.9, "STRONG_CONSIDER"), (60, 0.5, "STRONG_CONSIDER"), (59, 0.5, "WEAK_CONSIDER"), (40, 0.5, "WEAK_CONSIDER"), (39, 0.9, "IGNORE"), (90, 0.39, "IGNORE")])
def test_tiers(spark, score, confidence, want):
    assert one(spark, t=classify.decision_tier(F.lit(score), F.lit(confidence)))["t"] == want


def test_vocabulary(spark):
    v = vocab.of("s", {"a": ["health", "clinic"], "b": ["water", "river"]})
    got = one(spark, best=vocab.best_group(F.lit("water and health"), v), none=vocab.best_group(F.lit("x"), v, "General"), many=vocab.best_group(F.lit("river water health"), v), ranked=vocab.title_and_body(F.lit("Water"), F.lit("health water"), v), groups=vocab.matching_groups(F.lit("clinic"), v))
    assert (got["best"], got["none"], got["many"], got["groups"]) == ("a", "General", "b", ["a"])
    assert [tuple(x) for x in got["ranked"]] == [("b", 4), ("a", 1)]
    layers = [vocab.Layer("service", v, 0, 1), vocab.Layer("sector", vocab.of("t", {"c": {"terms": ["dam"], "weight": 4}}), 0, 4, "service")]
    score = lambda t: one(spark, s=vocab.layered_score(F.lit(t), layers, 5))["s"]
    assert (score("dam"), score("health dam"), score("health clinic")) == (0, 100, 20)


def test_signal_strength_stops(spark):
    got = one(spark, s=classify.signal_strength(F.lit("a b c dam road"), [("a", 30), ("b", 15), ("c", 9)], ["dam", "road"]))["s"]
    assert (got["score"], got["matched"]) == (35, ["a", "b"])


def test_normalise_is_idempotent(spark):
    raw = spark.createDataFrame([("portal", {"title": "RFP No: 12/2024 - Review of  schools &amp; clinics", "closing_date": "05/04/2026", "link": "https://x.org/a/b-12?x=1"})], "source string, raw map<string,string>")
    as_of = F.lit(dt.date(2026, 1, 1))
    a = normalize.normalise(raw, as_of)
    r = a.first()
    assert (r["tender_id"], r["deadline"], r["title"], r["has_description"], r["is_expired"]) == ("PORTAL_b-12", dt.date(2026, 4, 5), "RFP No: 12/2024 - Review of schools & clinics", False, False)
    again = normalize.normalise(a.select(F.col("source_site").alias("source"), F.create_map(*[x for c in ("tender_id", "title", "description", "url", "deadline") for x in (F.lit(c), F.col(c).cast("string"))]).alias("raw")), as_of).first()
    assert [again[c] for c in ("tender_id", "title", "title_clean", "content_hash", "deadline")] == [r[c] for c in ("tender_id", "title", "title_clean", "content_hash", "deadline")]


def test_reconcile_prefers_id(spark):
    full = spark.createDataFrame([("1", "u1", "t1", "full one"), ("2", "u2", "t2", "full two")], "tender_id string, url string, title string, description string")
    new = spark.createDataFrame([("1", "u2", "n", None), (None, "U2", "n", None), (None, None, "t1", "own"), ("9", "z", "z", None)], "tender_id string, url string, title string, description string")
    got = {(r["matched_by"], r["description"]) for r in normalize.reconcile(new, full, values=["description"]).collect()}
    assert got == {("tender_id", "full one"), ("url", "full two"), ("title", "own"), ("none", None)}


GROUPS = [
    ("A1", "End-line evaluation firm for rural health programme", "World Bank", "worldbank", "2026-06-01"),
    ("A2", "End line evaluation firm for rural health programme", "World Bank", "ungm", "2026-06-03"),
    ("B1", "Supply of laboratory microscopes to district clinics", "AfDB", "afdb", "2026-06-01"),
    ("B2", "Strategic advisory for coastal fisheries ministry", "AfDB", "afdb", "2026-06-01"),
    ("B3", "Third party monitoring of irrigation canals", "GIZ", "giz", "2026-06-01"),
    ("C1", "Capacity building for municipal water utilities", "UNDP", "undp", "2026-06-01"),
    ("C2", "Capacity building for municipal water utilities", "UNDP", "ungm", None),
    ("C3", "Capacity building for municipal water utilities.", "UNDP", "giz", "2026-06-05"),
    ("D1", "Capacity building for municipal water utilities", "UNDP", "undp", "2026-09-05"),
    ("E1", "Notice", "X", "x", None),
    ("E2", "Notice", "X", "x", None),
]


def records(spark, rows=GROUPS):
    made = [(i, n, t, o, s, d and dt.date.fromisoformat(d), t) for n, (i, t, o, s, d) in enumerate(rows)]
    return spark.createDataFrame(made, "id string, seq long, title string, organization string, source_site string, deadline date, description string")


def test_group_batch(spark):
    got = {r["id"]: r["leader"] for r in dedup.group_batch(records(spark)).collect()}
    assert got == {"A1": "A1", "A2": "A1", "B1": "B1", "B2": "B2", "B3": "B3", "C1": "C1", "C2": "C1", "C3": "C1", "D1": "D1", "E1": "E1", "E2": "E2"}
    assert dedup.group_batch(records(spark, [])).count() == 0


def test_merge_groups(spark):
    led = dedup.group_batch(records(spark)).withColumn("country", F.when(F.col("id") == "C2", "India"))
    r = {x["canonical_id"]: x for x in dedup.merge_groups(led).collect()}
    assert len(r) == 8 and sum(x["n_members"] for x in r.values()) == len(GROUPS)
    assert (r["C1"]["country"], r["C1"]["title"], r["C1"]["deadline"], r["C1"]["sources"]) == ("India", "Capacity building for municipal water utilities.", dt.date(2026, 6, 1), ["giz", "undp", "ungm"])


def test_match_history(spark):
    history = records(spark, GROUPS[:1]).withColumn("date_first_seen", F.lit(1))
    got = dedup.match_history(records(spark, GROUPS[1:3]).withColumn("date_first_seen", F.lit(2)), history).collect()
    assert [tuple(x) for x in got] == [("A2", "A1", False)]


def test_register_and_transitions(spark):
    stored = spark.createDataFrame([("1",)], "tender_id string")
    new = spark.createDataFrame([("1", "t"), ("2", "t"), ("2", "t"), (None, "t")], "tender_id string, model_decision_tag string")
    assert [r[0] for r in lifecycle.register(stored, new, F.current_timestamp()).collect()] == ["2"]
    ok = lambda a, b: one(spark, x=lifecycle.transition_ok(F.lit(a), F.lit(b)))["x"]
    assert ok("discovered", "shortlisted") and ok("won", "won") and ok("odd", "won") and not ok("won", "lost") and not ok("discovered", "won")


@pytest.mark.parametrize("outcome, decision, fine", [("won", "bid", True), ("won", "no_bid", False), ("lost", None, False), ("no_submission", "no_bid", True), ("no_submission", "review_later", True), ("no_submission", "bid", False), ("pending", None, True), ("odd", "bid", False)])
def test_outcomes(spark, outcome, decision, fine):
    assert (one(spark, e=lifecycle.outcome_error(F.lit(outcome), F.lit(decision).cast("string")))["e"] is None) is fine


def test_apply_outcomes(spark):
    stored = spark.createDataFrame([("1", "submitted", None, None, None), ("2", "shortlisted", None, None, None)], "tender_id string, status string, outcome string, bid_decision string, evaluated_at timestamp")
    given = spark.createDataFrame([("1", "Won", "Bid"), ("2", "No Submission", "Review Later"), ("2", "won", "no bid")], "tender_id string, outcome string, bid_decision string")
    rows, bad = lifecycle.apply_outcomes(stored, given, F.current_timestamp())
    got = {r["tender_id"]: (r["status"], r["outcome"], r["bid_decision"], r["evaluated_at"] is not None) for r in rows.collect()}
    assert got == {"1": ("won", "won", "bid", True), "2": ("shortlisted", "no_submission", "review_later", True)} and [tuple(x) for x in bad.collect()] == [("2", "needs a bid")]


def test_upsert_and_changes(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 5, "y")], "k long, v long, t string")
    b = spark.createDataFrame([(1, 2, "n"), (2, 4, "old"), (3, 1, "new"), (3, 1, "new")], "k long, v long, t string")
    assert sorted(tuple(r) for r in upsert.upsert(a, b, ["k"], "v").collect()) == [(1, 2, "n"), (2, 5, "y"), (3, 1, "new")]
    assert [tuple(r) for r in upsert.insert_ignore(a, b, ["k"], "v").collect()] == [(3, 1, "new")]
    before = spark.createDataFrame([(1, 50.0, "p", "c"), (2, 50.0, "p", "c"), (3, 50.0, "p", "c"), (4, 50.0, "p", "c"), (5, 1.0, "p", "c")], "k long, s double, g string, c string")
    after = spark.createDataFrame([(1, 62.0, "p", "c"), (2, 61.9, "q", "c"), (3, 50.0, "p", "d"), (4, 50.0, "p", "c"), (6, 1.0, "p", "c")], "k long, s double, g string, c string")
    assert {r["k"]: (r["change"], r["alert"]) for r in upsert.changes(before, after, "k", "s", "g", "c").collect()} == {1: ("upgraded", 2), 2: ("stage", 1), 3: ("content", 1), 4: ("same", 0), 5: ("gone", 0), 6: ("new", 3)}


def test_match_signals_by_priority(spark):
    stored = spark.createDataFrame([("u1", "h1", "t1", "c1"), ("u2", "h2", "t2", "c2")], "signal_uid string, url_hash string, title_hash string, content_hash string")
    new = spark.createDataFrame([("u1", "h2", "x", "x"), ("n", "h2", "x", "x"), ("m", "x", "t1", "c1"), ("o", "x", "t1", "x")], "signal_uid string, url_hash string, title_hash string, content_hash string")
    assert {r["signal_uid"]: r["matched_uid"] for r in upsert.match_signals(stored, new).collect()} == {"u1": "u1", "n": "u2", "m": "u1", "o": None}


def test_health_limits_before_it_drops_skips(spark):
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(days=i)
    rows = [("a", at(i), i, "SKIP" if i >= 5 else "FAIL", 0) for i in range(15)] + [("b", at(i), i, "OK", 0 if i > 2 else 9) for i in range(8)]
    runs = spark.createDataFrame(rows, "source string, run_at timestamp, run_id long, status string, row_count long")
    got = {r["source"]: r for r in health.stability(health.metrics(runs)).collect()}
    assert (got["a"]["n_runs"], got["a"]["success_rate"], got["a"]["state"]) == (0, 100.0, "stable")
    assert (got["b"]["zero_streak"], got["b"]["state"]) == (5, "unstable")


def test_keyset_pages_are_the_whole_order(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 3)) for i in range(23)], "k long, s double")
    seen, after = [], None
    while True:
        page = views.keyset_page(df, "s", "k", 5, after)
        seen += [r["k"] for r in page.collect()]
        after = views.next_cursor(page, "s", "k", 5)
        if after is None:
            break
    assert seen == [r["k"] for r in df.orderBy(F.coalesce("s", F.lit(0)).desc(), "k").collect()]


def test_nearest_matches_brute_force(spark):
    made = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)] + [(99, None)]
    e = spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(5)
    got = vectors.nearest(e, e.where("vec_id < 4"), 3)
    q, c = e.where("vec_id < 4").toDF("q", "a"), e.toDF("id", "b")
    want = q.join(c, F.col("q") != F.col("id")).where("b IS NOT NULL").withColumn("s", F.round(vectors.cosine(F.col("a"), F.col("b")), 6)).collect()
    for query in range(4):
        best = sorted(((-r["s"], r["id"]) for r in want if r["q"] == query))[:3]
        assert [x[1] for x in best] == [r["id"] for r in got.where(F.col("query_id") == query).orderBy("rank").collect()]


@pytest.mark.parametrize("most", [1, 3, 10, 50])
def test_nearest_in_blocks(spark, monkeypatch, most):
    import numpy as np

    rng = np.random.default_rng(2)
    v = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    e = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    asked = e.where("vec_id % 3 = 0").unionByName(e.where("vec_id IN (6, 9)"))  # two ids twice
    columns = ["query_id", "id", "similarity", "rank"]
    want = sorted(map(tuple, vectors.nearest(e, asked, 4).select(columns).collect()))
    assert len(want) == 40
    monkeypatch.setattr(vectors, "MOST_QUERIES", most)
    monkeypatch.setattr(vectors, "CELLS_AT_ONCE", 40)
    assert sorted(map(tuple, vectors.nearest(e, asked, 4).select(columns).collect())) == want


def test_similarities_of_all_pairs_in_blocks(spark, monkeypatch):
    """However blocks are cut, each pair comes once; with least, those at least so similar, also where one has no number."""
    monkeypatch.setattr(vectors, "PAIR_ROWS", 3)
    monkeypatch.setattr(vectors, "PAIR_QUERIES", 4)
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0], f"n{i}") for i in range(30)] + [(30, None, "none"), (31, [float("nan"), 1.0, 1.0], "nan")]
    e = spark.createDataFrame(rows, "vec_id int, embedding array<float>, name string")
    asked = e.where("vec_id % 3 = 0 OR vec_id > 28").drop("name")
    cosine = F.round(vectors.cosine(F.col("a"), F.col("b")), 6)
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b"), "name"), F.col("query_id") != F.col("id"))
    want = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("query_id", "id", cosine.alias("similarity"), "name").cache()
    for least, kept in ((None, want), (0.3, want.where("similarity >= 0.3"))):
        got = vectors.similarities(e, asked, ["name"], least=least)
        assert got.schema["query_id"].dataType.simpleString() == "int"
        show = lambda df: sorted((r.query_id, r.id, f"{round(r.similarity, 5) + 0.0:.5f}", r.name) for r in df.collect())
        assert show(got) == show(kept)
    assert vectors.similarities(e.where("false"), asked, ["name"]).collect() == [] == vectors.similarities(e, asked.where("false")).collect()


def test_portfolio_in_blocks(spark, monkeypatch):
    past = spark.createDataFrame([(f"bridge road {w} work",) for w in ("north", "south", "east", "west", "old")] + [("school health",)], "t string")
    new = spark.createDataFrame([(1, "bridge north work"), (2, "school health"), (3, "nothing"), (3, "old road")], "id long, t string")
    score = lambda: sorted((r["id"], round(r["score"], 9)) for r in vectors.portfolio_similarity(new, past, "id", "t", 2).collect())
    want = score()
    monkeypatch.setattr(vectors, "MOST_QUERIES", 2)
    assert score() == want and len({s for _, s in want}) > 2


def test_portfolio_similarity(spark):
    past = spark.createDataFrame([("water supply review",), ("school health evaluation",)], "t string")
    new = spark.createDataFrame([(1, "review of water supply"), (2, "nuclear submarine"), (3, "")], "id long, t string")
    got = {r["id"]: r["score"] for r in vectors.portfolio_similarity(new, past, "id", "t", 1).collect()}
    assert got[1] > 0.5 > got[2] == got[3] == 0


def test_relaxed_and_supplement(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(12)], "k long, g long")
    got = search.relaxed(df, [F.col("g") == 9, F.col("g") == 2, F.lit(True)], "k", 2, [])
    assert [(r["k"], r["step"]) for r in got.collect()] == [(2, 1), (6, 1)]
    assert [r["k"] for r in search.supplement(df.where("k < 2"), df, "k", 4, "g").collect()] == [1, 0, 3, 7]


def test_html(spark):
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav>menu</nav><p>Big &amp; <b>bold</b></p><script>var a;</script><a href='/f/Terms.PDF?x=1'>Terms</a><a href='#top'>up</a></body></html>"
    df = spark.createDataFrame([(page, "https://x.org/a"), (None, None), ("<p>open", "")], "h string, u string")
    got = df.select(documents.html_text("h").alias("t"), documents.html_blocks("h").alias("b"), documents.link_finder()("h", "u").alias("l")).collect()
    assert [r["t"] for r in got] == ["T menu Big & bold Terms up", "", "open"] and got[0]["b"] == "T\nBig &\nbold\nTerms\nup"
    assert [tuple(x) for x in got[0]["l"]] == [("https://x.org/f/Terms.PDF?x=1", "Terms", "pdf")]


def test_documents_fields(spark):
    t = F.lit("Deadline: 5 May 2026\nBudget - USD 2,000\nmail a@b.org, A@b.org a@b.org see https://x.org/y.pdf. and z.DOCX")
    got = one(spark, f=documents.fields(t, documents.FIELD_PATTERNS), e=documents.emails(t), l=documents.links_in_text(t), n=documents.file_names(t), x=documents.labelled_field(F.lit("Name: Road  works Value: 12"), ["Name"], ["Value"]))
    assert (got["f"]["deadline"], got["f"]["budget"], got["f"]["contact"]) == ("5 May 2026", "USD 2,000", None)
    assert got["e"] == ["a@b.org", "A@b.org"] and got["l"][0]["file_type"] == "pdf" and "z.docx" in got["n"] and got["x"] == "Road works"


def test_file_text():
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:t>Hello</w:t> <w:t>A &amp; B</w:t>")
    assert documents.file_text(buf.getvalue()) == "Hello A & B"
    assert documents.file_text(b"%PDF-1.4") == documents.file_text(None) == documents.file_text(b"\x00\x01") == ""
    assert documents.file_text(b"plain") == "plain"


def test_citations(spark):
    c = lambda raw: one(spark, c=grounding.citations(F.lit(raw), F.lit(3)))["c"]
    assert c('{"answer": "x", "citations": [1,2,9,-1,2]}')["citations"] == [1, 2]
    assert tuple(c("not-json")) == (grounding.DEFAULT_ANSWER, [])


def test_rate_limit_ignores_rejected():
    ok, left = streams.admitted([0, 1, 2, 3, 60.5, 61.5], [], 60, 2)
    assert ok == [True, True, False, False, True, True] and left == [60.5, 61.5]


def test_streams_equal_their_batch_forms(spark, tmp_path):
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)
    runs = [("a", at(i), i, 0 if i in (2, 3, 4, 6) else 5) for i in range(8)] + [("b", at(i), 10 + i, 0) for i in range(4)]
    df = spark.createDataFrame(runs, "source string, run_at timestamp, run_id long, row_count long")
    for i in range(3):
        df.where((F.col("run_at") >= F.lit(at(3 * i))) & (F.col("run_at") < F.lit(at(3 * i + 3)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.replay(spark, str(tmp_path / "in"), "source string, run_at timestamp, run_id long, row_count long")
    q = streams.health_status(stream).writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["source"], r["run_at"]): r["level"] for r in spark.table("levels").collect()}
    assert got == {(r["source"], r["run_at"]): r["level"] for r in health.escalated(df).collect()}
    out = {}
    q = streams.upsert_batches(stream, ["source"], "run_at", lambda b, n: out.update({r["source"]: r["run_at"] for r in b.collect()}), str(tmp_path / "u"))
    q.awaitTermination(120)
    assert out == {"a": at(7), "b": at(3)}


def test_change_stream(spark, tmp_path):
    rows = [("k", 1, 10.0, "c"), ("k", 2, 30.0, "c"), ("k", 3, 30.0, "d"), ("k", 4, 30.0, "d")]
    spark.createDataFrame(rows, "key string, seq long, score double, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.replay(spark, str(tmp_path / "in"), "key string, seq long, score double, content string")
    q = streams.change_stream(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["change"], r["n_amendments"]) for r in spark.table("changes").orderBy("seq").collect()] == [("new", 0), ("upgraded", 0), ("content", 1), ("same", 1)]


def test_ranking_metrics_bounds(spark):
    df = spark.createDataFrame([(i, float(-i), int(i < 3)) for i in range(10)], "k long, s double, r int")
    got = search.ranking_metrics(df, "s", "r", "k", 3).first()
    assert tuple(got) == (1.0, 1.0, 1.0)


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "content_hash_dupes" in e.queries()


def test_opportunity_gates_and_missing_values(spark):
    firm = opportunity.Profile(type_fit={"evaluation": 90}, importance={"A": 90}, consulting=("assess",), procurement=("supply",), single_person=(r"\bsole expert\b",), strong_service=("assess",), top_clients=("A",))
    fields = "id int, title string, text string, rich_text string, consulting_type string, organization string, sector string, region string, deadline_category string, model double, portfolio double, keyword int, shadow double, rerank double, consulting boolean, exclusion_reason string"
    good = ("Assess it", "assess", "assess", "evaluation", "A", "s", "r", "needs_action", 90.0, 80.0, 90, 80.0, 2.0, True, None)
    rows = [(1, *good), (2, *good[:7], "expired", *good[8:]), (3, *good[:13], False, "goods"), (4, "Sole expert", *good[1:]), (5, *[None] * 15)]
    got = {r["id"]: r for r in opportunity.score(spark.createDataFrame(rows, fields), firm).collect()}
    assert got[1]["confidence"] == 93 and got[1]["cap_client"] == 8 and got[1]["priority_score"] > 70 and got[1]["note"].startswith("Strong")
    assert [got[i]["priority_score"] for i in (2, 3, 5)] == [0, 0, 0] and got[3]["note"].startswith("Excluded: goods")
    assert got[4]["engine_score"] == 10 and got[4]["priority_score"] == 15 and not got[4]["firm_eligible"]
    assert got[5]["low_confidence"] and got[5]["confidence"] == 30 and got[5]["client_fit"] == 15


def test_relevance_says_why(spark):
    layers = [Layer("service", of("s", {"a": {"terms": ["study"], "weight": 5}, "b": {"terms": ["survey"], "weight": 9}}), 0, 10), Layer("sector", of("x", {"w": {"terms": ["water"], "weight": 8}}), 0, 8, needs="service")]
    df = spark.createDataFrame([(1, "A study and survey of water"), (2, "water pipes"), (3, "survey of weapons"), (4, None), (5, "")], "id int, text string")
    got = {r["id"]: (r["score"], r["reason"]) for r in relevance(df, "text", layers, {"service": "service ", "sector": "sector "}, 20, ["weapons"]).collect()}
    assert got == {1: (90, "High relevance: service survey; sector water"), 2: (0, "Not relevant: no keyword matched"), 3: (0, "Not relevant: blocked by weapons"), 4: (0, "Not relevant: no keyword matched"), 5: (0, "Not relevant: no keyword matched")}


@pytest.mark.parametrize("clients", [["a", "b", None], [1, 2, None]])
def test_rate_limit_over_batches(spark, clients):
    made = [(i, c, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=37 * i % 400)) for i in range(120) for c in clients]
    made = [(n, c, t) for n, (_, c, t) in enumerate(made)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["id"]: r["admitted"] for r in streams.rate_limit(spark.createDataFrame(made, ["id", "client", "ts"]), 60, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c in clients:
        own = sorted((t.timestamp(), n) for n, x, t in made if x == c)
        want |= dict(zip([n for _, n in own], streams.admitted([t for t, _ in own], [], 60, 3)[0], strict=True))
    assert got == want


def test_partial_update_takes_the_newest(spark):
    stored = spark.createDataFrame([(1, "old", 5), (2, "old", 5)], "id int, owner string, n int")
    given = spark.createDataFrame([(1, "z", None, 1), (1, "a", 7, 2), (1, None, None, 3), (2, " ", None, 1), (3, "x", 1, 1)], "id int, owner string, n int, at int")
    got = lambda **k: sorted(map(tuple, lifecycle.partial_update(stored, given, "id", ["owner", "n"], **k).collect()))
    assert got(newest="at") == [(1, "a", 7), (2, None, 5)]
    assert got() == [(1, "z", 7), (2, None, 5)]
