"""DOC: text, links and fields of pages and attached files.

HTML and file formats need a parser: Python functions over the standard library. The rest are
expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from noticeflow.functions import text as T
from noticeflow.operators import pdf

INLINE_DROPPED = ("script", "style", "noscript", "svg", "iframe", "template")
BLOCK_DROPPED = (*INLINE_DROPPED, "header", "footer", "nav")
FILE_TYPES = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "zip")
LINK = StructType([StructField("url", StringType()), StructField("label", StringType()), StructField("file_type", StringType())])
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Text outside of dropped tags; a page that ends within one loses the rest."""

    def __init__(self, dropped: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.parts = set(dropped), 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped and tag not in VOID:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in self.dropped and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def page_text(html: str | None, dropped: Sequence[str], separator: str) -> str:
    if not html:
        return ""
    parser = _Text(dropped)
    parser.feed(html)
    parser.close()
    return separator.join(x for x in (" ".join(p.split()) for p in parser.parts) if x)


# Pages go to Python a hundred at a time (Arrow batches hold ten thousand rows, of any size), so that memory does not grow with the table.
@F.udf(StringType(), useArrow=False)
def html_text(html: str | None) -> str:
    """DOC-01: one line of text without scripts, styles and frames; null as empty."""
    return page_text(html, INLINE_DROPPED, " ")


@F.udf(StringType(), useArrow=False)
def html_blocks(html: str | None) -> str:
    """DOC-02: text by lines, without headers, footers and menus either."""
    return page_text(html, BLOCK_DROPPED, "\n")


class _Links(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links, self.open = base, [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        onclick = re.search(r"['\"]([^'\"]+\.(?:%s))['\"]" % "|".join(FILE_TYPES), a.get("onclick") or "", re.I)
        found = a.get("href") if tag == "a" else a.get("data-href") or a.get("data-url") or (onclick and onclick[1])
        if found and not found.lower().startswith(("javascript:", "mailto:", "#")):
            self.open = [urljoin(self.base, unescape(found.strip())), ""]
            self.links.append(self.open)

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None


def file_type(url: str) -> str | None:
    found = re.search(r"\.([a-z0-9]{2,5})(?:[?#]|$)", url.lower())
    return found[1] if found and found[1] in FILE_TYPES else None


def page_links(html: str | None, base: str | None, words: Sequence[str], cap: int) -> list[dict]:
    if not html:
        return []
    parser = _Links(base or "")
    try:
        parser.feed(html)
    except ValueError:  # a URL that can't be joined; what came before stays
        pass
    out: dict[str, dict] = {}
    for url, label in parser.links:
        kind = file_type(url)
        if kind or any(w in url.lower() or w in label.lower() for w in words):
            out.setdefault(url.lower(), {"url": url, "label": " ".join(label.split()), "file_type": kind})
    return list(out.values())[:cap]


def link_finder(words: Sequence[str] = ("download", "attachment", "document"), cap: int = 15):
    """DOC-05: a function of HTML and base URL to links to files, or with one of words in URL or label; each once, cap at most."""

    @F.udf(ArrayType(LINK), useArrow=False)
    def find(html: str | None, base: str | None) -> list[dict]:
        return page_links(html, base, words, cap)

    return find


def links_in_text(text: Column, cap: int = 15) -> Column:
    """DOC-06: URLs in text with the type that their ending says; each once."""
    urls = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s\"'<>)\]]+[^\s\"'<>)\].,;])"), F.lit(1)))
    kind = lambda u: F.nullif(F.regexp_extract(F.lower(u), r"\.(" + "|".join(FILE_TYPES) + r")(?:[?#]|$)", 1), F.lit(""))
    return F.slice(F.transform(urls, lambda u: F.struct(u.alias("url"), kind(u).alias("file_type"))), 1, cap)


def file_names(text: Column) -> Column:
    """DOC-07: file names with a known ending, in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b([\w\-]+\.(?:" + "|".join(FILE_TYPES) + r"))\b"), F.lit(1)))


def emails(text: Column, most: int = 5) -> Column:
    """DOC-09: the first few distinct addresses."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"), F.lit(1))), 1, most)


def field(text: Column, patterns: Sequence[str]) -> Column:
    """DOC-08: the first group of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), F.lit("")) for p in patterns])


def fields(text: Column, patterns: dict[str, Sequence[str]]) -> Column:
    """DOC-08, SRC-31: a struct with a field for each list of patterns."""
    return F.struct(*[field(text, p).alias(name) for name, p in patterns.items()])


#: DOC-08: patterns for common fields.
FIELD_PATTERNS: dict[str, tuple[str, ...]] = {
    "deadline": (r"(?i)(?:deadline|closing date|submission date)\s*[:\-]\s*([^\n;]{6,40})",),
    "budget": (r"(?i)(?:budget|estimated (?:cost|value)|contract value)\s*[:\-]\s*([^\n;]{2,40})",),
    "duration": (r"(?i)(?:duration|period of (?:contract|performance))\s*[:\-]\s*([^\n;]{2,40})",),
    "contact": (r"(?i)(?:contact(?: person)?)\s*[:\-]\s*([^\n;]{2,60})",),
    "experience": (r"(?i)(\d{1,2}\+?\s+years?)(?: of)? experience", r"(?i)experience of (?:at least )?(\d{1,2}\s+years?)"),
    "eligibility": (r"(?i)eligib(?:le|ility)(?: criteria)?\s*[:\-]\s*([^\n]{5,200})",),
}


def labelled_field(text: Column, labels: Sequence[str], stops: Sequence[str], junk: Sequence[str] = ("", "-", "na", "n/a", "nil")) -> Column:
    """DOC-11: what stands between one of labels and the next stop label."""
    p = r"(?is)(?:" + "|".join(map(re.escape, labels)) + r")\s*:?\s*(.*?)\s*(?=(?:" + "|".join(map(re.escape, stops)) + r")\b|$)"
    return T.clean_or_null(T.collapse(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), junk)


def _xml_text(raw: bytes) -> str:
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", raw.decode("utf-8", "replace"))).split())


def file_text(raw: bytes | None, kind: str | None = None, depth: int = 0) -> str:
    """DOC-03, DOC-04: text of a file by its first bytes: Office files and archives of files, PDFs, HTML, plain text; empty for others.

    Archives are read two levels deep.
    """
    if not raw:
        return ""
    if raw[:4] == b"PK\x03\x04":
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            return ""
        names = z.namelist()
        office = [n for n in names if re.fullmatch(r"word/document\.xml|xl/sharedStrings\.xml|xl/worksheets/[^/]+\.xml|ppt/slides/[^/]+\.xml", n)]
        if office:
            return " ".join(filter(None, (_xml_text(z.read(n)) for n in office)))
        return "\n".join(filter(None, (file_text(z.read(n), None, depth + 1) for n in names if not n.endswith("/")))) if depth < 2 else ""
    if b"%PDF-" in raw[:1024]:
        return pdf.read(raw)[0]
    text = raw.decode("utf-8", "replace")
    if re.search(r"<\s*(?:html|body|div|p)\b", text[:2000], re.I):
        return page_text(text, BLOCK_DROPPED, "\n")
    return text if "\x00" not in text[:2000] else ""


@F.pandas_udf(StringType())
def binary_text(raw: pd.Series) -> pd.Series:
    """DOC-04, over a column of file contents."""
    return raw.map(file_text, na_action=None)
