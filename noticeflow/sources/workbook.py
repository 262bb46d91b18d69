"""SNK-04, SRC-29: workbooks (Office Open XML) as a data source.

Writing: each task streams its rows as XML to a part below the target's folder; the commit strings the parts together, in the order of partitions,
into one archive, a piece at a time, and gives it its name in the end. A task or job that fails leaves no workbook and no part. A sheet that
is full goes on in another, which a property of the workbook tells. Reading: a task for each sheet, row by row, each sheet by itself or with those that
go on with it as one.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from noticeflow.tables import workers_import

#: Rows that a sheet of the format can have.
MOST_ROWS = 1_048_576

#: What a task writes: a cell is a number, a text or nothing.
WRITTEN = "sheet string, cells array<struct<text:string,number:double>>"

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_PIECE = 1 << 20

#: The property of a sheet that goes on with another: its name after the colon; its value is that other's name and the rows before it, parted by a newline.
_CUSTOM = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
_TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"
_GOES_ON, _PROPERTIES = "continues:", "docProps/custom.xml"


def cell_xml(text: str | None, number: float | None) -> str:
    if number is not None and number == number and abs(number) != float("inf"):
        return f"<c><v>{int(number) if number.is_integer() and abs(number) < 1e15 else repr(number)}</v></c>"
    if text is None:
        return "<c/>"
    clean = escape(_BAD.sub("", text), {"\r": "&#13;", "\n": "&#10;"})  # a row stays one line
    return f'<c t="inlineStr"><is><t xml:space="preserve">{clean}</t></is></c>'


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    files: dict[str, str] = field(default_factory=dict)  # by sheet


@dataclass
class _Writer(DataSourceWriter):
    target: str
    folder: str
    order: list[str]
    most: int

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        part = _Part(TaskContext.get().partitionId())
        open_files: dict[str, object] = {}
        try:
            for r in rows:
                if r["sheet"] not in open_files:
                    part.files[r["sheet"]] = f"{root}/{part.partition}-{len(open_files)}-{uuid.uuid4().hex}"
                    open_files[r["sheet"]] = store.open_output_stream(part.files[r["sheet"]])
                line = "".join(cell_xml(c["text"], c["number"]) for c in r["cells"] or ())
                open_files[r["sheet"]].write(f"<row>{line}</row>\n".encode())
        finally:
            for f in open_files.values():
                f.close()
        return part

    def _lines(self, store: pafs.FileSystem, files: list[str]) -> Iterator[bytes]:
        for name in files:
            rest = b""
            with store.open_input_stream(name) as f:
                while piece := f.read(_PIECE):
                    *whole, rest = (rest + piece).split(b"\n")
                    yield from whole

    def commit(self, messages: list[_Part | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.folder)
        _, target = pafs.FileSystem.from_uri(self.target)
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        found = {s for m in parts for s in m.files}
        names: list[str] = []
        goes_on: dict[str, str] = {}
        made = f"{root}/archive"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(made) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for sheet in [*self.order, *sorted(found - set(self.order))]:
                lines = self._lines(store, [m.files[sheet] for m in parts if sheet in m.files])
                line, n = next(lines, None), 0
                while line is not None or n == 0:
                    n += 1
                    ending = "" if n == 1 else f" ({n})"
                    names.append(f"{sheet[: 31 - len(ending)]}{ending}")
                    if n > 1:
                        goes_on[names[-1]] = f"{sheet[:31]}\n{(n - 1) * self.most}"
                    with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                        out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                        for _ in range(self.most):
                            if line is None:
                                break
                            out.write(line)
                            line = next(lines, None)
                        out.write(b"</sheetData></worksheet>")
            numbered = list(enumerate(names, 1))
            head = '<?xml version="1.0" encoding="UTF-8"?>'
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in numbered) + "</sheets></workbook>")
            package = "http://schemas.openxmlformats.org/package/2006"
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered) + "</Relationships>")
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/>' + (f'<Relationship Id="rId2" Type="{_LINKS}/custom-properties" Target="{_PROPERTIES}"/>' if goes_on else "") + "</Relationships>")
            if goes_on:
                told = "".join(f'<property fmtid="{{D5CDD505-2E9C-101B-9397-08002B2CF9AE}}" pid="{i}" name={quoteattr(_GOES_ON + n)}><vt:lpwstr>{escape(v)}</vt:lpwstr></property>' for i, (n, v) in enumerate(goes_on.items(), 2))
                z.writestr(_PROPERTIES, f'{head}<Properties xmlns="{_CUSTOM}" xmlns:vt="{_TYPES}">{told}</Properties>')
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + (f'<Override PartName="/{_PROPERTIES}" ContentType="application/vnd.openxmlformats-officedocument.custom-properties+xml"/>' if goes_on else "") + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in numbered) + "</Types>")
        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        store.move(made, target)
        store.delete_dir(root)

    def abort(self, messages: list[_Part | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.folder)
        if store.get_file_info(root).type != pafs.FileType.NotFound:
            store.delete_dir(root)


@dataclass
class _Sheet(InputPartition):
    file: str
    name: str
    member: str
    before: int = 0  # rows of the sheets that this one goes on with


@dataclass
class _Reader(DataSourceReader):
    path: str
    whole: bool

    def _files(self, store: pafs.FileSystem, root: str) -> list[str]:
        if store.get_file_info(root).type != pafs.FileType.Directory:
            return [root]
        return sorted(f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.endswith(".xlsx"))

    def partitions(self) -> list[_Sheet]:
        store, root = pafs.FileSystem.from_uri(self.path)
        out = []
        for name in self._files(store, root):
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                goes_on = self._goes_on(z) if self.whole else {}
                for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
                    target = links[s.get(f"{{{_LINKS}}}id")]
                    first, before = goes_on.get(s.get("name"), (s.get("name"), 0))
                    out.append(_Sheet(name, first, target.lstrip("/") if target.startswith("/") else f"xl/{target}", before))
        return out or [_Sheet("", "", "")]

    def _goes_on(self, z: zipfile.ZipFile) -> dict[str, tuple[str, int]]:
        """For each sheet that goes on with another that one's name and the rows before."""
        if _PROPERTIES not in z.namelist():
            return {}
        told = {p.get("name", ""): "".join(p.itertext()) for p in ElementTree.fromstring(z.read(_PROPERTIES)).iter(f"{{{_CUSTOM}}}property")}
        return {n.removeprefix(_GOES_ON): (v.split("\n")[0], int(v.split("\n")[1])) for n, v in told.items() if n.startswith(_GOES_ON)}

    def read(self, sheet: _Sheet) -> Iterator[tuple]:
        if not sheet.file:
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        tag = lambda n: f"{{{_MAIN}}}{n}"
        with store.open_input_file(sheet.file) as f, zipfile.ZipFile(f) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
            number = 0
            with z.open(sheet.member) as xml:
                above: list[ElementTree.Element] = []  # elements that are open: a row that was read leaves its sheet
                for event, row in ElementTree.iterparse(xml, ("start", "end")):
                    if event == "start":
                        above.append(row)
                        continue
                    above.pop()
                    if row.tag != tag("row"):
                        continue
                    number = int(row.get("r", number + 1))
                    cells: list[str | None] = []
                    for c in row.iter(tag("c")):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at - len(cells))
                        cells.append(_value(c, shared, tag))
                    if above:
                        above[-1].remove(row)
                    if any(x is not None and x.strip() for x in cells):
                        yield sheet.file, sheet.name, sheet.before + number, cells


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(c: ElementTree.Element, shared: list[str], tag) -> str | None:
    kind, v = c.get("t", "n"), c.find(tag("v"))
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(tag("t")))
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if kind == "b" else v.text


class Workbook(DataSource):
    """Options: path; to read also whole (true: sheets that go on with another count as that one); to write also sheets (names in their order, parted by newlines) and rows (of a sheet at most)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row int, cells array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("whole", "false") == "true")

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        target = self.options["path"]
        return _Writer(target, f"{target}.parts-{uuid.uuid4().hex}", [s for s in self.options.get("sheets", "").split("\n") if s], int(self.options.get("rows", MOST_ROWS)))


def _cell(c: str, kind: str) -> Column:
    """A number where a cell can hold it exactly, else text."""
    text = F.col(c).cast("string")
    if kind in ("double", "float"):
        number = F.col(c).cast("double")
    elif kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint"):
        number = F.when(F.abs(F.col(c)) < 2**53, F.col(c).cast("double"))
    else:
        number = F.lit(None).cast("double")
    return F.struct(F.when(number.isNull(), text).alias("text"), number.alias("number"))


def write(path: str, sheets: Sequence[tuple[str, DataFrame, Sequence[Column]]], most: int = MOST_ROWS) -> None:
    """SNK-04: one workbook of several sheets: each with a name, rows and their order; the first row of a sheet has the names of columns."""
    spark = sheets[0][1].sparkSession
    workers_import(spark)
    spark.dataSource.register(Workbook)
    both: DataFrame | None = None
    for i, (name, df, order) in enumerate(sheets):
        ordered = df.orderBy(*order) if order else df
        rows = ordered.select(F.lit(i).alias("_s"), F.monotonically_increasing_id().alias("_n"), F.lit(name).alias("sheet"), F.array(*[_cell(c, k) for c, k in df.dtypes]).alias("cells"))
        head = spark.range(1).select(F.lit(i).alias("_s"), F.lit(-1).cast("long").alias("_n"), F.lit(name).alias("sheet"), F.array(*[F.struct(F.lit(c).alias("text"), F.lit(None).cast("double").alias("number")) for c in df.columns]).alias("cells"))
        both = head.unionByName(rows) if both is None else both.unionByName(head).unionByName(rows)
    out = both.orderBy("_s", "_n").select("sheet", "cells")
    out.write.format("workbook").option("sheets", "\n".join(s[0] for s in sheets)).option("rows", str(most)).mode("append").save(path)


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """SRC-29: file, sheet, row, cells of a workbook, or of all in a folder; blank rows are left out. whole: a sheet that was written as several is one again."""
    workers_import(spark)
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").option("whole", str(whole).lower()).load(path)


def records(sheet: DataFrame, source: str) -> DataFrame:
    """SRC-29: rows below each sheet's first as source and raw, a map of strings by that row's names. Cells beyond the names, and those without a name, go."""
    head = sheet.groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("names"), F.min("row").alias("first"))
    named = sheet.join(F.broadcast(head), ["file", "sheet"]).where("row > first")  # a row a sheet
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda x: (F.coalesce(F.trim(x["names"]), F.lit("")) != "") & x["cells"].isNotNull())
    return named.select(F.lit(source).alias("source"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(x["names"]), x["cells"]))).alias("raw"))


def ranked_workbook(df: DataFrame, path: str, portal: str, score: str, key: str, new: Column) -> None:
    """SNK-04: all rows by score, the new ones among them, and a summary by portal."""
    counts = df.groupBy(portal).agg(F.count("*").alias("n"), F.count_if(new).alias("n_new"), F.max(score).alias("best"), F.round(F.avg(score), 2).alias("mean"))
    order = [F.desc_nulls_last(score), F.col(key)]
    write(path, [("Ranked", df, order), ("New", df.where(new), order), ("Portals", counts, [F.desc("n"), F.col(portal)])])
