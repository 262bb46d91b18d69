"""SRC-01 to SRC-06, SRC-28, NRM-34: paged sources over recorded responses.

A recording has a folder for each request (a query, a status, a category) and below it one for each page: path/request=R/page=N/file,
N from 0 without a gap. The data source "recorded_pages" reads page bodies: in batch, ranges of pages are its partitions, and a request ends
where its total is reached; as a stream, an offset is the number of pages seen of each request, so a restart goes on where it stopped and pages
that were recorded since follow. Who fetches pages only has to write them.

What a record is, and which of its fields are which columns, is a Contract: paths into the record, as expressions over VARIANT, so that records in lists
and in dictionaries, and values in lists, are read alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from noticeflow.functions.text import MISSING, clean_or_null
from noticeflow.tables import cut, workers_import

SCHEMA = "request string, page int, body string"


def _inside(body: object, path: str) -> object:
    for part in filter(None, path.split(".")):
        body = body.get(part) if isinstance(body, dict) else None
    return body


@dataclass
class Pages(InputPartition):
    """Pages first to last, without it, of a request."""

    request: str
    first: int
    last: int


@dataclass
class _Recording:
    """A folder of pages, as tasks and the driver read it."""

    path: str
    items: str
    total: str

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def requests(self) -> list[str]:
        store, root = self._store()
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(m[1] for f in found if f.type == pafs.FileType.Directory and (m := re.search(r"/request=([^/]*)$", f.path)))

    def pages(self, request: str) -> int:
        """How many pages there are without a gap, from the first on."""
        store, root = self._store()
        found = store.get_file_info(pafs.FileSelector(f"{root}/request={request}", allow_not_found=True))
        numbers = {int(m[1]) for f in found if (m := re.search(r"/page=(\d+)$", f.path))}
        return next(i for i in range(len(numbers) + 1) if i not in numbers)

    def body(self, request: str, page: int) -> str:
        store, root = self._store()
        files = [f for f in store.get_file_info(pafs.FileSelector(f"{root}/request={request}/page={page}")) if f.is_file and not re.match(r"[._]", f.base_name)]
        return "".join(store.open_input_file(f.path).readall().decode() for f in sorted(files, key=lambda f: f.path))

    def size_and_total(self, request: str) -> tuple[int, int | None]:
        """Records of the first page, and of all pages by what it says."""
        page = json.loads(self.body(request, 0))
        total = _inside(page, self.total) if self.total else None
        return len(_inside(page, self.items) or ()), None if total is None else int(total)

    def read(self, pages: Pages) -> Iterator[tuple[str, int, str]]:
        for page in range(pages.first, pages.last):
            yield pages.request, page, self.body(pages.request, page)


class RecordedPages(DataSource):
    """Options: path; items and total (dotted paths of the records and of their number in a page); pages (of a partition); most (pages of a request)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def _recording(self) -> _Recording:
        return _Recording(self.options["path"], self.options.get("items", ""), self.options.get("total", ""))

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self._recording(), int(self.options.get("pages", 16)), int(self.options.get("most", 0)))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self._recording(), int(self.options.get("pages", 16)))


def _ranges(request: str, first: int, last: int, each: int) -> list[Pages]:
    return [Pages(request, at, min(at + each, last)) for at in range(first, last, each)]


@dataclass
class _Batch(DataSourceReader):
    recording: _Recording
    each: int
    most: int

    def partitions(self) -> list[Pages]:
        """One page of each request is read here, for its total; a recording that ends before that is an error and not a short result."""
        out = []
        for request in self.recording.requests():
            there = self.recording.pages(request)
            if not there:
                continue
            size, total = self.recording.size_and_total(request)
            needed = there if total is None or not size else max(1, -(-total // size))
            needed = min(needed, self.most) if self.most else needed
            if needed > there:
                raise ValueError(f"{request} has {there} of {needed} pages")
            out += _ranges(request, 0, needed, self.each)
        return out or [Pages("", 0, 0)]

    def read(self, pages: Pages) -> Iterator[tuple[str, int, str]]:
        return self.recording.read(pages)


@dataclass
class _Stream(DataSourceStreamReader):
    recording: _Recording
    each: int

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {r: self.recording.pages(r) for r in self.recording.requests()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [p for r in sorted(end) for p in _ranges(r, start.get(r, 0), end[r], self.each)]

    def read(self, pages: Pages) -> Iterator[tuple[str, int, str]]:
        return self.recording.read(pages)

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


@dataclass(frozen=True)
class Contract:
    """What a source's pages hold. items, total: paths in a page; fields: for each column the paths in a record, of which the first that has a value counts.

    key: a column of which the first record stays, by request and place; required: columns without which a record goes; floor: a column (a date as ISO text)
    and the least that it may be, where it has a value.
    """

    name: str
    items: str
    fields: Mapping[str, Sequence[str]]
    total: str = ""
    key: str | None = None
    required: Sequence[str] = ()
    floor: tuple[str, str] | None = None
    missing: Sequence[str] = field(default=MISSING)


def value(record: Column, path: str) -> Column:
    """Text at a path of a VARIANT: of a list its first element; null for a dictionary, or where there is nothing."""
    at = lambda p: F.try_variant_get(record, p, "string")
    kind = F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))
    return F.when(kind.startswith("ARRAY"), at(f"$.{path}[0]")).when(~kind.startswith("OBJECT"), at(f"$.{path}"))


def listed(record: Column, path: str, most: int | None = None) -> Column:
    """Texts at a path: those of a list, or the only one; most of them at most, in order."""
    many = F.try_variant_get(record, f"$.{path}", "array<string>")
    found = F.coalesce(many, F.when(value(record, path).isNotNull(), F.array(value(record, path))), F.array().cast("array<string>"))
    return F.slice(found, 1, most) if most else found


def links(record: Column, paths: Sequence[str], keys: Sequence[str] = ("url", "link", "href", "resourceLink")) -> Column:
    """SRC-18, NRM-34: distinct URLs at paths, as texts, dictionaries, or lists of either, in order."""
    many = F.flatten(F.array(*[F.coalesce(F.try_variant_get(record, f"$.{p}", "array<variant>"), F.array(F.try_variant_get(record, f"$.{p}", "variant"))) for p in paths]))
    one = lambda v: F.trim(F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in keys], F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))))
    return F.array_distinct(F.filter(F.transform(many, one), lambda u: F.coalesce(u.startswith("http"), F.lit(False))))


def recorded(spark: SparkSession, path: str, contract: Contract, stream: bool = False, **options: str) -> DataFrame:
    """Page bodies of a recording: request, page, body."""
    workers_import(spark)
    spark.dataSource.register(RecordedPages)
    reader = spark.readStream if stream else spark.read
    return reader.format("recorded_pages").options(path=path, items=contract.items, total=contract.total, **options).load()


def records(pages: DataFrame, contract: Contract) -> DataFrame:
    """request, page, at (place in the page), name (key in a dictionary) and record (VARIANT) of each record. A page that is no JSON fails the read."""
    items = F.try_variant_get(F.parse_json("body"), f"$.{contract.items}" if contract.items else "$", "variant")
    spark = pages.sparkSession
    paged = pages.select("request", "page", items.alias("items"))
    each = paged.lateralJoin(spark.tvf.variant_explode(F.col("items").outer()))
    return each.select("request", "page", F.col("pos").alias("at"), F.col("key").alias("name"), F.col("value").alias("record"))


def rows(found: DataFrame, contract: Contract, **more: Column) -> DataFrame:
    """Records as flat rows: request, page, at, the contract's columns, and more (expressions over record and those columns).

    Records without a required column go, as do those below the floor; of one key the first by request, page and place stays.
    """
    columns = {c: F.coalesce(*[clean_or_null(value(F.col("record"), p), contract.missing) for p in paths]) for c, paths in contract.fields.items()}
    out = found.select("request", "page", "at", "name", "record", *[x.alias(c) for c, x in columns.items()])
    out = (out.withColumns(more) if more else out).drop("record")
    for c in contract.required:
        out = out.where(F.col(c).isNotNull())
    if contract.floor:
        c, least = contract.floor
        out = out.where(F.coalesce(F.col(c) >= least, F.lit(True)))
    if contract.key and not out.isStreaming:
        rest = [c for c in out.columns if c != contract.key]
        keyed = out.where(F.col(contract.key).isNotNull()).groupBy(contract.key).agg(F.min_by(F.struct(*rest), F.struct("request", "page", "at")).alias("_x"))
        out = keyed.select(contract.key, "_x.*").select(*out.columns).unionByName(out.where(F.col(contract.key).isNull()))
    return out


def read(spark: SparkSession, path: str, contract: Contract, **options: str) -> DataFrame:
    """SRC-01 to SRC-06: rows of a recording."""
    return rows(records(recorded(spark, path, contract, **options), contract), contract)


def record(items: DataFrame, path: str, request: str, order: Sequence[str], item: str, size: int, body: str) -> None:
    """Writes a recording: column item (JSON text) of items, size of them a page, by request in an order. body: a page with {items} and {total}.

    A request may have any number of items: they are sorted by ranges, and an item's place is its place in its task after all of the tasks before.
    """
    named = items.select(F.coalesce(F.col(request).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("request"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(item).alias("item"))
    by = ["request", *[f"_o{i}" for i in range(len(order))]]
    sorted_ = cut(named.repartitionByRange(*by).sortWithinPartitions(*by).select("request", "item", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_n")), "sorted-items")
    runs = sorted_.groupBy("request", "_p").agg(F.min("_n").alias("_first"), F.count("*").alias("_c"))  # a row for each request of each task
    whole = W.partitionBy("request")
    ahead = F.coalesce(F.sum("_c").over(whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sorted_.join(F.broadcast(runs.select("request", "_p", (ahead - F.col("_first")).alias("_ahead"), F.sum("_c").over(whole).alias("n"))), ["request", "_p"])
    placed = placed.select("request", "item", (F.col("_n") + F.col("_ahead")).alias("at"), "n")
    pages = placed.groupBy("request", F.floor(F.col("at") / size).alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("t"), F.max("n").alias("n"))
    head, middle, tail = re.split(r"\{items\}|\{total\}", body) if "{total}" in body else (*body.split("{items}"), None)
    text = F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: x["item"]), ","), F.lit(middle), *([F.col("n").cast("string"), F.lit(tail)] if tail is not None else []))
    pages.select("request", "page", text.alias("value")).repartition("request", "page").write.partitionBy("request", "page").mode("overwrite").text(path)


# --- contracts of record shapes -----------------------------------------------------------------------------------------
# Names of the fields that public interfaces give, in the order in which they are tried.

#: SRC-01: notices by type, in a list with a total.
NOTICES = Contract(
    "notices", "procnotices", total="total", key="id", required=("title",), floor=("published", "1995-01-01"),
    fields={"id": ["id"], "title": ["bid_description", "project_name"], "project": ["project_name"], "country": ["project_ctry_name"], "organization": ["contact_organization"], "method": ["procurement_method_name"], "notice_type": ["notice_type"], "reference": ["bid_reference_no"], "deadline": ["submission_deadline_date"], "published": ["noticedate"]},
)

#: SRC-02: projects by status, in a dictionary.
PROJECTS = Contract(
    "projects", "projects", key="id", required=("title",),
    fields={"id": ["id"], "title": ["project_name"], "sector": ["sector1.Name", "sector"], "summary": ["projdesc", "project_name"], "published": ["boardapprovaldate"], "status": ["status"], "country": ["countryshortname"], "region": ["regionname"], "organization": ["impagency"], "url": ["url"]},
)

#: SRC-05: opportunities by query, in a list with a total, the first of each id.
OPPORTUNITIES = Contract(
    "opportunities", "opportunitiesData", total="totalRecords", key="notice_id", required=("notice_id", "title"),
    fields={"notice_id": ["noticeId"], "title": ["title"], "sol_num": ["solicitationNumber", "noticeId"], "agency": ["fullParentPathName", "organizationHierarchy", "organizationName"], "naics": ["naicsCode"], "deadline": ["responseDeadLine"], "posted": ["postedDate"], "kind": ["type"], "link": ["uiLink"], "description": ["description"]},
)

#: SRC-03: calls, of which fields are in metadata, in content or in the record itself, in lists or not.
CALLS = Contract(
    "calls", "results", required=("title",),
    fields={"identifier": ["metadata.identifier", "metadata.callIdentifier", "content.identifier", "identifier"], "title": ["metadata.title", "content.title", "title"], "call_type": ["metadata.callType", "metadata.type", "content.type", "type"], "deadline": ["metadata.deadlineDate", "metadata.closingDate", "content.deadlineDate"], "programme": ["metadata.programmeName", "metadata.fundingScheme", "metadata.programme"], "budget": ["metadata.budgetOverall", "metadata.budgetTopicAction", "metadata.budget"], "url": ["metadata.callUrl", "metadata.url", "content.url", "url"], "description": ["metadata.summary", "metadata.shortSummary", "metadata.description", "content.summary", "content.description", "summary", "description"]},
)

#: SRC-06, NRM-34: tenders by category with values and departments, the first of each number.
TENDERS = Contract(
    "tenders", "data", key="tender_id", required=("tender_id",),
    fields={"tender_id": ["tenderNumber", "id"], "title": ["title", "description"], "value": ["ecv"], "department": ["deptName"], "location": ["locationName"], "published": ["publishedDate"], "closing": ["tenderClosureDate"], "description": ["description"]},
)


def day_of(c: str) -> Column:
    """The ISO date that a text of day and time begins with, in either order of day and year."""
    t = F.split(F.trim(c), "[T ]")[0]
    return F.coalesce(F.regexp_replace(F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"), t), r"^(\d{2})-(\d{2})-(\d{4})$", "$3-$2-$1"), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t))
