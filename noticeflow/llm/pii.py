"""Personal data: base patterns, and terms that would disclose them.

Patterns find the protected entities: mail and IP addresses, card and phone numbers. Hiding these
is not enough where other words of their documents give them away, so the corpus says how much each
term tells of each entity: of all documents, how many have the entity, the term, and both, wherever
in the text. Their pointwise mutual information, as a share of the entity's own information
content, is the term's disclosure. At SHARE or more, a term is generalised in the documents that
name the entity (digits masked, or a word's beginning), if that form's own disclosure stays
below SHARE, and else removed.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import Scratch, begin, join_by_hot_key

KINDS = ("email", "ip", "card", "phone")

#: The kind of spans that are terms.
TERM = "term"

#: Terms on either side of an entity that are held against it: all of its document.
NEAR = sys.maxsize

#: Documents that must have term and entity before its disclosure counts as known.
LEAST_DOCS = 3

#: Share of an entity's information content from which a term discloses it.
SHARE = 0.8

#: Distinct terms that a task counts before it passes its counts on.
HELD = 400_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive where going back could not help, so that long runs take linear time
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_DIGIT = re.compile("[0-9]")

_PIECE = 1 << 20

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By their signs: what is before one reaches back as far as it can, not into the match before."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(low, at + 1))


def base_spans(text: str) -> list[Span]:
    """start, kind, end of the entities that patterns find, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """One name for all ways of writing an entity."""
    return f"{KINDS[kind]}:" + (value.lower() if kind < 2 else "".join(_DIGIT.findall(value)))


def general(term: str) -> str | None:
    """A term's general form: digits masked, or the beginning of a long word; None for a short word."""
    if _DIGIT.search(term):
        return _DIGIT.sub("#", term)
    return term[:3] + "*" if len(term) > 4 else None


def _words(text: str) -> Iterator[set[str]]:
    """The distinct terms of each megabyte or so."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text) and (m := _WORD.match(text, end)):
            end = m.end()
        yield {t.lower() for t in set(_WORD.findall(text, at, min(end, len(text))))}
        at = end


def terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """The terms of the whole text, their start and end, those apart that touch an entity. spans in order."""
    taken: list[list[int]] = []  # spans, joined where they overlap
    for start, _, end in spans:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    i = 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or m.end() <= taken[i][0]:
            yield m.group().lower(), m.start(), m.end()


def listed(spans: Iterable[tuple[int, int, int]]) -> str:
    """kind:start:end of start, kind, end."""
    names = (*KINDS, TERM)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SCAN = "rid long, {id}n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:long,kind:int,end:long>>, entities array<string>, text string, term string, n long"


def _scan(keep_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents (rid is not null; with text where they name an entity, or of all), and rows of counts of terms and their general forms (term is not null)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin("pii")
        rid, counts = TaskContext.get().partitionId() << 33, Counter()
        names, kinds = [], []

        def batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds)], names)

        def told() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            counts.clear()
            for i in range(0, len(items), 20_000):
                some = items[i : i + 20_000]
                yield batch(len(some), {"term": pa.array([t for t, _ in some], pa.string()), "n": pa.array([n for _, n in some], pa.int64())})

        for b in batches:
            ids = b.column("id")
            if not names:
                names += ["rid", "doc_id", *(f"n_{k}" for k in KINDS), "base", "entities", "text", "term", "n"]
                kinds += [pa.int64(), ids.type, *[pa.int64()] * 4, _SPANS, pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
            base, entities, texts = [], [], []
            for x in b.column("text").to_pylist():
                text = x or ""
                seen: set[str] = set()
                for some in _words(text):
                    seen |= some
                counts.update(seen)
                counts.update({g for t in seen if (g := general(t))})
                spans = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                entities.append(list(dict.fromkeys(entity(k, text[a:b]) for a, k, b in spans)))
                texts.append(x if spans or keep_text else None)
                if len(counts) > HELD:
                    yield from told()
            n = len(base)
            rids = pa.array(range(rid, rid + n), pa.int64())
            rid += n
            found = {f"n_{k}": pa.array([sum(s["kind"] == i for s in x) for x in base], pa.int64()) for i, k in enumerate(KINDS)}
            found |= {"rid": rids, "doc_id": ids, "base": pa.array(base, _SPANS), "entities": pa.array(entities, pa.list_(pa.string())), "text": pa.array(texts, pa.string())}
            yield batch(n, found)
        if names:
            yield from told()

    return scan


def _spans(base: list[dict]) -> list[Span]:
    return [(s["start"], s["kind"], s["end"]) for s in base]


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, term, general of documents: each of their terms and general forms once."""
    made: list[tuple[int, str, str | None]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in made], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, ["rid", "term", "general"])

    for b in batches:
        for rid, base, text in zip(*(b.column(c).to_pylist() for c in ("rid", "base", "text"))):
            known = {t: general(t) for t in {t for t, _, _ in terms(text, _spans(base))}}
            made += [(rid, t, g) for t, g in known.items()]
            made += [(rid, g, None) for g in set(known.values()) - {None}]
            if len(made) > 20_000:
                yield batch()
    yield batch()


def disclosing(scratch: Scratch, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, term, n (documents), to: terms that disclose an entity; to is their general form, or empty where that discloses it too. And rid, entity, term of documents: all pairs that could.

    Pairs are counted over whole documents, but for those whose counts alone rule them out: an entity in n documents of N has no
    pair in LEAST_DOCS where n is less, and a term in more than N ** (1 - SHARE) * n ** SHARE documents stays below SHARE even where all n have it.
    """
    n_docs = float(max(scanned.where("rid IS NOT NULL").count(), 1))
    named = scanned.where("size(entities) > 0")
    owned = named.select("rid", F.explode("entities").alias("entity"))
    # nothing is disclosed of an entity that all documents have
    entities = owned.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= LEAST_DOCS) & (F.col("n_entity") < n_docs))
    most = F.pow(F.lit(n_docs), F.lit(1 - SHARE)) * F.pow("n_entity", F.lit(SHARE)) * 1.000001  # rounding loses none
    owned = scratch.cut(join_by_hot_key(owned, entities, ["entity"], "n_entity", owned.count()).withColumn("most", most), "owned")
    docs = named.join(owned.select("rid").distinct(), "rid", "left_semi").select("rid", "base", "text")
    said = scratch.cut(docs.mapInArrow(_terms, "rid long, term string, general string"), "terms")
    used = said.groupBy("term").agg(F.count("*").alias("n_used")).where(F.col("n_used") >= LEAST_DOCS)
    counts = scanned.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n_term")).join(used, "term")
    rare = counts.where(F.col("n_term") <= (owned.agg(F.max("most")).first()[0] or 0.0))
    met = owned.join(join_by_hot_key(said, rare, ["term"], "n_used", said.count()), "rid").where("n_term <= most")
    pairs = scratch.cut(met.select("rid", "entity", "term", "general", "n_entity", "n_term"), "pairs")
    known = pairs.groupBy("entity", "term").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("general", "n_entity", "n_term"))).where(F.col("n") >= LEAST_DOCS)
    share = F.log(F.lit(n_docs) * F.col("n") / (F.col("n_entity") * F.col("n_term"))) / F.log(F.lit(n_docs) / F.col("n_entity"))
    telling = scratch.cut(known.where(share >= SHARE).select("entity", "term", "general", "n"), "telling")
    form = F.col("term").contains("#") | F.col("term").contains("*")
    forms = telling.where(form).select("entity", F.col("term").alias("general"), F.lit(True).alias("too"))
    to = F.when(F.col("general").isNull() | F.col("too").isNotNull(), "").otherwise(F.col("general"))
    return telling.where(~form).join(forms, ["entity", "general"], "left").select("entity", "term", "n", to.alias("to")), pairs.select("rid", "entity", "term")


def _finish(keep_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """base_sha256 and spans of documents, and with keep_text the sanitised text."""

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, spans, texts = [], [], []
            columns = [b.column(c).to_pylist() for c in ("base", "told", "text")]
            for base, told, text in zip(*columns):
                own = _spans(base)
                to = {x["term"]: x["to"] for x in told or ()}
                more = {(start, len(KINDS), end): to[t] for t, start, end in terms(text, own) if t in to} if to else {}
                hashes.append(hashlib.sha256(listed(own).encode()).hexdigest())
                spans.append(listed(sorted(own + list(more))))
                texts.append(_sanitised(text, own, more) if keep_text else None)
            names = [c for c in b.schema.names if c not in ("base", "told", "text")]
            made = [*(b.column(c) for c in names), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            if keep_text:
                made.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(made, [*names, "base_sha256", "spans", *(["text"] if keep_text else [])])

    return finish


def _sanitised(text: str | None, own: list[Span], more: dict[Span, str]) -> str | None:
    """text with <kind> in place of entities, general forms in place of terms, or nothing."""
    if text is None:
        return None
    out, at = [], 0
    for span in sorted([*own, *more]):
        start, kind, end = span
        if start >= at:
            out += [text[at:start], more[span] if span in more else f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sanitise: bool = False) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans and, with sanitise, text, for each row of docs.

    spans: kind:start:end in code points, end exclusive, by start and kind, entities and disclosing
    terms alike; base_sha256 is of the entities alone. Null texts are empty (and stay null where
    sanitised); ids of any type may repeat or be null, every row counts as a document.
    Without rows nothing is returned. Texts of any length are counted a megabyte at a time; other columns are not read.
    """
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = scratch.cut(rows.mapInArrow(_scan(sanitise), _SCAN.format(id=f"doc_id {kind}, ")), "scan")
    telling, pairs = disclosing(scratch, scanned)
    told = scratch.cut(telling, "disclosing")
    met = join_by_hot_key(pairs, told, ["entity", "term"], "n", pairs.count())
    by_term = met.groupBy("rid", "term").agg(F.min("to").alias("to"))  # removal before a general form
    by_doc = by_term.groupBy("rid").agg(F.collect_list(F.struct("term", "to")).alias("told"))
    named = scanned.where("size(entities) > 0")
    counts = [f"n_{k}" for k in KINDS]
    columns = ["doc_id", *counts, "base", "text"]
    with_terms = named.join(by_doc, "rid", "left").select(*columns, "told")
    plain = scanned.where("rid IS NOT NULL AND size(entities) = 0").select(*columns, F.lit(None).cast("array<struct<term:string,to:string>>").alias("told"))
    out = with_terms.unionByName(plain).mapInArrow(_finish(sanitise), f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string" + (", text string" if sanitise else ""))
    return out.withColumnRenamed("doc_id", id_col)


def sanitise(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find, with the sanitised text."""
    return find(spark, docs, id_col, text_col, sanitise=True)
