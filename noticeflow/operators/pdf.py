"""DOC-03, DOC-04: the text of PDF files, within Arrow batches.

Objects are found by their marks (and in object streams), so a broken cross-reference table does no harm; pages come in the order of the page tree. Text is what
a page's operators show, through its fonts' ToUnicode maps; a new line where they move down. Encrypted and broken files have a status and
no text; sizes, pages and unpacked bytes are bounded by parameters, and a file beyond them says so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "text string, status string, n_pages int"

#: Pages that are read, bytes of a file, and bytes that its streams may unpack to.
PAGES, MOST_BYTES, MOST_UNPACKED = 40, 64 << 20, 256 << 20

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(
    rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)"  # a string, with brackets two deep
    rb"|<(?!<)[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Unreadable(Exception):
    """Why a file has no text."""


@dataclass
class _File:
    raw: bytes
    unpacked: int = 0
    objects: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        marks = list(_OBJECT.finditer(self.raw))
        for m, after in zip(marks, [*[x.start() for x in marks[1:]], len(self.raw)]):
            self.objects[int(m[1])] = self.raw[m.end() : after]  # of several versions the last
        for body in [b for b in self.objects.values() if b"/ObjStm" in _head(b)]:
            data = self.stream(body)
            n, first = (int(self.number(body, k) or 0) for k in (b"N", b"First"))
            places = [int(x) for x in data[:first].split()[: 2 * n]]
            for number, at, end in zip(places[::2], places[1::2], [*places[3::2], len(data) - first]):
                self.objects.setdefault(number, data[first + at : first + end])

    def number(self, body: bytes, key: bytes) -> float | None:
        if m := re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R\b", _head(body)):
            return float(self.objects.get(int(m[1]), b"0").split()[0])
        m = re.search(rb"/" + key + rb"\s+([-\d.]+)", _head(body))
        return float(m[1]) if m else None

    def stream(self, body: bytes) -> bytes:
        """The bytes of an object's stream; empty where there is none, or it is packed in another way than Flate."""
        if not (m := _STREAM.search(body)):
            return b""
        head, data = body[: m.start()], body[m.end() :]
        size = self.number(body, b"Length")
        end = int(size) if size and data[int(size) : int(size) + 12].lstrip().startswith(b"endstream") else data.rfind(b"endstream")
        data = data[:end] if end >= 0 else data
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if filters and (filters != [b"FlateDecode"] or re.search(rb"/Predictor\s+([2-9]|1\d)", head)):
            return b""
        if filters:
            unpack = zlib.decompressobj()
            left = MOST_UNPACKED - self.unpacked
            try:
                data = unpack.decompress(data, left)
            except zlib.error:
                return b""
            if unpack.unconsumed_tail:
                raise Unreadable("too large")
        self.unpacked += len(data)
        return data

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key of a dictionary names: one, or those of a list, written there or in an object of its own."""
        m = re.search(rb"/" + key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R\b)", _head(body), re.S)
        found = [int(x[1]) for x in _REF.finditer(m[1])] if m else []
        if m and not m[1].startswith(b"[") and (own := self.objects.get(found[0], b"").strip()).startswith(b"["):
            found = [int(x[1]) for x in _REF.finditer(own)]
        return found

    def pages(self) -> Iterator[bytes]:
        """Pages in order; each with what it inherits from above, after its own."""
        roots = [m for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", _head(b)) for m in self.refs(b, b"Pages")]
        todo, seen = [(r, b"") for r in roots[-1:]], set()
        while todo:
            number, above = todo.pop(0)
            if number in seen or number not in self.objects:
                continue
            seen.add(number)
            body = self.objects[number]
            if re.search(rb"/Type\s*/Pages\b", _head(body)) or b"/Kids" in _head(body):
                todo[:0] = [(k, _head(body).replace(b"/Kids", b"/_") + above) for k in self.refs(body, b"Kids")]
            else:
                yield _head(body) + above

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """For each font name of a page its map from codes to text; an empty one where it has none."""
        resources = page
        for r in self.refs(page, b"Resources")[:1]:
            resources = self.objects.get(r, b"")
        m = re.search(rb"/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", resources, re.S)
        listed = m[1] if m else b""
        if listed and not listed.startswith(b"<<"):
            listed = self.objects.get(int(_REF.match(listed)[1]), b"")
        return {m[1]: self.to_unicode(self.objects.get(int(m[2]), b"")) for m in re.finditer(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", listed)}

    def to_unicode(self, font: bytes) -> dict[bytes, str]:
        out: dict[bytes, str] = {}
        for r in self.refs(font, b"ToUnicode"):
            data = self.stream(self.objects.get(r, b""))
            text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
                for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    out[bytes.fromhex(code.decode())] = text(to)
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
                for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[.*?\])", block, re.S):
                    n, each = len(low) // 2, re.findall(rb"<([0-9A-Fa-f]+)>", to)
                    for i in range(min(int(high, 16) - int(low, 16) + 1, 1 << 16)):
                        if to.startswith(b"[") and i < len(each):
                            out[(int(low, 16) + i).to_bytes(n, "big")] = text(each[i])
                        elif not to.startswith(b"["):
                            start = text(each[0])
                            out[(int(low, 16) + i).to_bytes(n, "big")] = start[:-1] + chr(min(ord(start[-1]) + i, 0x10FFFF))
        return out


def _head(body: bytes) -> bytes:
    """An object without its stream."""
    m = _STREAM.search(body)
    return body[: m.start()] if m else body


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r") else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def _shown(code: bytes, font: dict[bytes, str]) -> str:
    if not font:
        return code.decode("cp1252", "replace")
    n = max(map(len, font))
    return "".join(font.get(code[i : i + n], "") for i in range(0, len(code), n))


def _page_text(data: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    font: dict[bytes, str] = {}
    for m in _TOKEN.finditer(data):
        t = m[0]
        if t[:1] in b"(<[]/" or t[:1].isdigit() or t[:1] in b"-+.":
            held.append(t)
            continue
        if t == b"Tf" and len(held) >= 2:
            font = fonts.get(held[-2][1:], {})
        elif t in (b"Tj", b"'", b'"') and held and held[-1][:1] in b"(<":
            out += ["\n"] * (t != b"Tj") + [_shown(_string(held[-1]), font)]
        elif t == b"TJ":
            for x in held:
                if x[:1] in b"(<":
                    out.append(_shown(_string(x), font))
                elif x[:1] not in b"[]/" and float(x) < -200:  # a wide step is a blank
                    out.append(" ")
        elif t in (b"T*", b"Tm", b"ET") or (t in (b"Td", b"TD") and held and float(held[-1]) != 0):
            out.append("\n")
        elif t in (b"Td", b"TD"):
            out.append(" ")
        held = []
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def read(raw: bytes | None, pages: int = PAGES) -> tuple[str, str, int]:
    """Text, status (ok, empty, encrypted, too large, too many pages, broken, not a pdf) and number of pages. Of too many pages the first are read."""
    if not raw or b"%PDF-" not in raw[:1024]:
        return "", "not a pdf", 0
    if len(raw) > MOST_BYTES:
        return "", "too large", 0
    try:
        f = _File(raw)
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise Unreadable("encrypted")
        out, n = [], 0
        for page in f.pages():
            n += 1
            if n <= pages:
                data = b"\n".join(f.stream(f.objects.get(c, b"")) for c in f.refs(page, b"Contents"))
                out.append(_page_text(data, f.fonts(page)))
        text = "\n".join(filter(None, out))
        return text, "broken" if not n else "too many pages" if n > pages else "ok" if text else "empty", n
    except Unreadable as e:
        return "", str(e), 0
    except (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError):
        return "", "broken", 0


def pdf_text(raw: Column, pages: int = PAGES) -> Column:
    """DOC-03: struct(text, status, n_pages) of a column of file contents."""

    @F.pandas_udf(SCHEMA)
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x, pages) for x in s], columns=["text", "status", "n_pages"])

    return of(raw)
