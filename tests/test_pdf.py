"""Text of PDFs that the tests write, and what has none."""

import random
import zlib

import pytest

from noticeflow.operators import documents, pdf


def made(pages, pack=True, fonts=None, tree=False, objects_in_stream=False, trailer=b"", inherit=False):
    """A PDF of content streams. fonts: name to ToUnicode map. tree: pages below a second node."""
    out = [b"%PDF-1.7\n"]
    add = lambda n, body: out.append(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    def stream(n, data, extra=b""):
        packed = zlib.compress(data) if pack else data
        add(n, b"<< /Length %d %s%s>>\nstream\n" % (len(packed), b"/Filter /FlateDecode " if pack else b"", extra) + packed + b"\nendstream")

    font_list = b" ".join(b"/%s %d 0 R" % (k.encode(), 500 + i) for i, k in enumerate(fonts or {}))
    resources = b"/Resources << /Font << %s >> >>" % font_list
    small = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = [100 + i for i in range(len(pages))]
    listed = lambda x: b" ".join(b"%d 0 R" % k for k in x)
    above = b" " + resources if inherit else b""
    if tree:
        small[2] = b"<< /Type /Pages /Kids [3 0 R %s] /Count %d%s >>" % (listed(kids[2:]), len(kids), above)
        small[3] = b"<< /Type /Pages /Kids [%s] /Count 2 >>" % listed(kids[:2])
    else:
        small[2] = b"<< /Type /Pages /Kids [%s] /Count %d%s >>" % (listed(kids), len(kids), above)
    for i, k in enumerate(kids):
        small[k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R%s >>" % (300 + i, b"" if inherit else b" " + resources)
    if objects_in_stream:
        bodies, places, at = b"", b"", 0
        for n, body in small.items():
            places += b"%d %d " % (n, at)
            bodies += body + b" "
            at += len(body) + 1
        stream(900, places + bodies, b"/Type /ObjStm /N %d /First %d " % (len(small), len(places)))
    else:
        for n, body in small.items():
            add(n, body)
    for i, data in enumerate(pages):
        stream(300 + i, data)
    for i, cmap in enumerate((fonts or {}).values()):
        add(500 + i, b"<< /Type /Font /ToUnicode %d 0 R >>" % (600 + i) if cmap else b"<< /Type /Font >>")
        if cmap:
            stream(600 + i, cmap)
    return b"".join(out) + b"trailer << /Root 1 0 R " + trailer + b">>\n%%EOF"


PLAIN = rb"BT /F1 12 Tf 72 700 Td (Request for \(proposals\)) Tj 0 -14 Td (second\040line) Tj T* [(spl) -20 (it) -300 (words)] TJ ET"
WANT = "Request for (proposals)\nsecond line\nsplit words"


@pytest.mark.parametrize("how", [{}, {"pack": False}, {"tree": True}, {"objects_in_stream": True}, {"inherit": True}])
def test_plain_text(how):
    pages = [PLAIN, b"BT (two) Tj ET", b"BT (three) Tj ET"]
    assert pdf.read(made(pages, fonts={"F1": b""}, **how)) == (WANT + "\ntwo\nthree", "ok", 3)


def test_fonts_with_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00C9> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <00660066>] endbfrange"
    page = b"BT /F1 9 Tf <0001 0010 0011 0012> Tj /F2 9 Tf (x) Tj /F1 9 Tf <000200200021> Tj ET"
    assert pdf.read(made([page], fonts={"F1": cmap, "F2": b""}))[0] == "Éabcx😀éff"


def test_what_has_no_text():
    good = made([PLAIN])
    assert pdf.read(None)[1] == pdf.read(b"")[1] == pdf.read(b"hello")[1] == "not a pdf"
    assert pdf.read(made([PLAIN], trailer=b"/Encrypt 9 0 R "))[:2] == ("", "encrypted")
    assert pdf.read(made([b"q Q"]))[:2] == ("", "empty")
    assert pdf.read(good[:40])[:2] == ("", "broken")
    assert pdf.read(made([b"BT (a) Tj ET"] * 5), pages=2) == ("a\na", "too many pages", 5)


def test_bounds(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_UNPACKED", 1000)
    assert pdf.read(made([b"BT (a) Tj ET " * 1000]))[:2] == ("", "too large")
    monkeypatch.setattr(pdf, "MOST_BYTES", 100)
    assert pdf.read(made([PLAIN]))[:2] == ("", "too large")


def test_broken_files_never_raise():
    rng = random.Random(2)
    good = made([PLAIN, PLAIN], fonts={"F1": b"1 beginbfchar <01> <0041> endbfchar"}, objects_in_stream=True)
    for _ in range(400):
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 8)):
            raw[rng.randrange(8, len(raw))] = rng.randrange(256)
        cut = raw[: rng.randrange(8, len(raw))] if rng.random() < 0.3 else raw
        text, status, n = pdf.read(bytes(cut))
        assert isinstance(text, str) and status in ("ok", "empty", "broken", "encrypted", "too large", "too many pages")


def test_column(spark):
    df = spark.createDataFrame([(1, bytearray(made([PLAIN]))), (2, None), (3, bytearray(b"plain"))], "i int, raw binary")
    got = {r.i: (r.p.status, r.t) for r in df.select("i", pdf.pdf_text("raw").alias("p"), documents.binary_text("raw").alias("t")).collect()}
    assert got == {1: ("ok", WANT), 2: ("not a pdf", ""), 3: ("not a pdf", "plain")}
