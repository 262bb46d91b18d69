"""Text and links of pages against a plain reading by tags."""

import re
from html import unescape
from urllib.parse import urljoin

import duckdb

from noticeflow.plans import queries

SF = "/root/testdata/sf0.001"


def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()


def plain_text(html, dropped, separator):
    """Segments between tags, outside of dropped elements (which the pages do not nest)."""
    html = re.sub(r"(?s)<!--.*?-->", "", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "<x>", html or ""))
    for tag in dropped:
        html = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "<x>", html)
    parts = (" ".join(unescape(x).split()) for x in re.split(r"<[^>]*>", html))
    return separator.join(x for x in parts if x)


def test_text_of_pages(spark):
    inline = ("noscript", "svg", "iframe", "template")
    got = {r.page_id: (r.line, r.blocks) for r in queries.QUERIES["html_text"](spark, SF).collect()}
    want = {i: (plain_text(h, inline, " "), plain_text(h, (*inline, "header", "footer", "nav"), "\n")) for i, _, h in pages()}
    assert got == want and any(a for a, _ in want.values())


def test_links_of_pages(spark):
    got = {}
    for r in queries.QUERIES["page_links"](spark, SF).collect():
        got.setdefault(r.page_id, []).append((r.url, r.label, r.file_type))
    want = {}
    for i, url, html in pages():
        html = re.sub(r"(?s)<!--.*?-->", "", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html or ""))
        seen = {}
        for m in re.finditer(r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>', html):
            href = unescape(m[1])
            if not href or href.lower().startswith(("javascript:", "mailto:", "#")):
                continue
            full, label = urljoin(url or "", unescape(href.strip())), " ".join(unescape(re.sub("<[^>]*>", "", m[2])).split())
            kind = re.search(r"\.(pdf|docx|doc|xlsx|xls|pptx|zip)(?:[?#]|$)", full.lower())
            if kind or any(w in full.lower() or w in unescape(re.sub("<[^>]*>", "", m[2])).lower() for w in ("page", "doc", "http")):
                seen.setdefault(full.lower(), (full, label, kind[1] if kind else None))
        if seen:
            want[i] = list(seen.values())[:15]
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()} and want


def test_pages_go_to_python_in_small_batches(spark):
    """A batch of Arrow holds ten thousand pages of any size; the queries over pages do not wait for so many."""
    for name in ("html_text", "evidence_state", "page_links"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan
