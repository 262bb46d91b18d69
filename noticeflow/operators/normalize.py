"""NRM: raw rows of any source to one canonical record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow import schemas
from noticeflow.functions import dates, text as T
from noticeflow.functions.vocab import Vocabulary, longest_term

#: Canonical names and the names that sources give them, first found first taken.
ALIASES: dict[str, tuple[str, ...]] = {
    "id": ("tender_id", "id", "notice_id", "ref_no", "bid_number"),
    "title": ("title", "name", "subject", "tender_title"),
    "description": ("description", "summary", "details", "scope"),
    "organization": ("organization", "organisation", "buyer", "agency", "authority"),
    "country": ("country", "location", "place"),
    "url": ("url", "link", "detail_url"),
    "deadline": ("deadline", "closing_date", "due_date", "end_date"),
    "published": ("published", "publication_date", "posted", "start_date"),
    "value": ("value", "budget", "amount", "estimated_cost"),
}

#: Reference numbers and the like that don't belong to a title.
TITLE_NOISE = (r"(?i)\b(?:ref|tender|notice|rfp|rfq|eoi)\s*(?:no|number|#)?\.?\s*[:#]\s*[\w/\-]+", r"\b[A-Z]{2,}[/\-]\d{2,}[\w/\-]*\b", r"\(\s*\)")

PLACEHOLDERS = ("n/a", "na", "none", "nil", "not specified", "not available", "to be determined", "tbd")


@dataclass(frozen=True)
class Rules:
    """What differs by deployment: source names, source defaults and place words."""

    sources: dict[str, str] = field(default_factory=dict)
    url_sources: tuple[tuple[str, str], ...] = ()
    source_country: dict[str, str] = field(default_factory=dict)
    source_organisation: dict[str, str] = field(default_factory=dict)
    countries: Vocabulary | None = None
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ALIASES))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of key in a small table, else null."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def source_name(raw: Column, url: Column, rules: Rules) -> Column:
    """NRM-05, NRM-06: the known name of a source, else one that the URL gives, else a slug."""
    by_url = F.coalesce(*[F.when(F.lower(url).contains(part), name) for part, name in rules.url_sources], F.lit(None).cast("string"))
    own = T.clean_or_null(raw)
    return F.coalesce(_lookup(F.lower(own), rules.sources), by_url, F.nullif(F.regexp_replace(F.lower(own), "[^a-z0-9]+", ""), F.lit("")), F.lit("unknown"))


def country(raw: Column, description: Column, source: Column, rules: Rules) -> Column:
    """NRM-07, NRM-35: the given one, else one named in the first 500 characters, else the source's."""
    named = longest_term(F.substring(description, 1, 500), rules.countries) if rules.countries else F.lit(None).cast("string")
    return F.coalesce(T.clean_or_null(raw), named, _lookup(source, rules.source_country))


def organisation(raw: Column, record: Column, others: Sequence[str], source: Column, rules: Rules) -> Column:
    """NRM-08: the given one, else one of the record's other fields, else the source's."""
    return F.coalesce(T.clean_or_null(raw), T.pick(record, others) if others else F.lit(None).cast("string"), _lookup(source, rules.source_organisation))


def resolve_aliases(raw: DataFrame, record: str = "raw", aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """NRM-01: a column for each canonical name, from a column with a map of strings."""
    return raw.select("*", *[T.pick(record, names).alias(f"_{name}") for name, names in aliases.items()])


def normalise(raw: DataFrame, as_of: Column, rules: Rules = Rules(), record: str = "raw", source: str = "source") -> DataFrame:  # noqa: B008
    """NRM-12, NRM-13: the canonical record of each raw row (a map of strings, and its source's name).

    A record without a description is described by its title and organisation, but has_description says
    what it had itself.
    """
    r = resolve_aliases(raw, record, rules.aliases)
    r = r.withColumn("_src", source_name(F.col(source), F.coalesce("_url", F.lit("")), rules))
    r = r.withColumn("_own", T.clean_text("_description"))
    r = r.withColumn("_org", organisation(F.col("_organization"), F.col(record), (), F.col("_src"), rules))
    title = T.clean_text("_title")
    described = F.when(F.col("_own") != "", F.col("_own")).otherwise(T.collapse(F.concat_ws(" ", title, "_org")))
    deadline = dates.parse_date("_deadline")
    out = r.select(
        F.coalesce("_id", T.derive_id("_src", "_url", title)).alias("tender_id"),
        title.alias("title"),
        T.strip_patterns(title, TITLE_NOISE).alias("title_clean"),
        T.content_hash(title).alias("content_hash"),
        described.alias("description"),
        F.col("_org").alias("organization"),
        country(F.col("_country"), described, F.col("_src"), rules).alias("country"),
        F.col("_src").alias("source_site"),
        F.col("_url").alias("url"),
        dates.parse_date("_published").alias("published"),
        deadline.alias("deadline"),
        T.clean_value("_value", PLACEHOLDERS).alias("value"),
        T.words_in(described).alias("word_count"),
        (F.length("_own") >= 50).alias("has_description"),
        dates.is_expired(deadline, as_of).alias("is_expired"),
    )
    return truncate(out)


def truncate(df: DataFrame, widths: dict[str, int] = schemas.WIDTHS) -> DataFrame:
    """NRM-13: texts cut to their columns' widths."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in widths.items() if c in df.columns})


def reconcile(new: DataFrame, full: DataFrame, keys: Sequence[tuple[str, ...]] = (("tender_id",), ("url",), ("title",)), values: Sequence[str] = ()) -> DataFrame:
    """NRM-14, JOI-16, JOI-17: for each new row the full row that matches by the first key that finds one; new values win.

    Each key's side has one row a key (the least tender_id), so rows don't multiply. Adds matched_by.
    """
    values = values or [c for c in full.columns if c != "tender_id"]
    out, found = new, []
    for i, key in enumerate(keys):
        on = [F.lower(F.trim(F.col(k).cast("string"))) for k in key]
        side = full.where(F.concat_ws("", *on) != "").groupBy(*[c.alias(f"_k{i}_{j}") for j, c in enumerate(on)]).agg(F.min_by(F.struct(*values), "tender_id").alias(f"_f{i}"))
        cond = [out_on == F.col(f"_k{i}_{j}") for j, out_on in enumerate(F.lower(F.trim(F.col(k).cast("string"))) for k in key)]
        out = out.join(side, cond, "left").drop(*[f"_k{i}_{j}" for j in range(len(key))])
        found.append(f"_f{i}")
    best = F.coalesce(*found)
    by = F.coalesce(*[F.when(F.col(f).isNotNull(), "+".join(k)) for f, k in zip(found, keys, strict=True)], F.lit("none"))
    cols = [F.coalesce(F.col(c), best[c]).alias(c) if c in values else F.col(c) for c in new.columns]
    more = [best[c].alias(c) for c in values if c not in new.columns]
    return out.select(*cols, *more, by.alias("matched_by"))


def impute(df: DataFrame, portals: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """NRM-25, NRM-29, JOI-15: blanks of columns from a table with one row per source."""
    side = portals.select(on, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return df.join(side, on, "left").withColumns({c: F.coalesce(T.clean_or_null(c), f"_p_{c}") for c in columns}).drop(*[f"_p_{c}" for c in columns])


def completeness(*columns: str) -> Column:
    """NRM-26: share of columns that are filled, in whole percent."""
    return T.half_even(T.hits([T.clean_or_null(c).isNotNull() for c in columns]) * 100.0 / len(columns)).cast("int")


def id_fallback(*columns: str, width: int = 255) -> Column:
    """NRM-18: the first id there is."""
    return F.substring(T.first_present(*columns), 1, width)


def flatten_bid(raw: Column) -> Column:
    """NRM-21: first elements of list fields and a formatted amount of a nested bid: b_title array, b_org array, b_value double."""
    return F.struct(F.get(raw["b_title"], 0).alias("title"), F.get(raw["b_org"], 0).alias("organization"), F.format_number(raw["b_value"], 2).alias("value"))


def listing_seed(*columns: str) -> Column:
    """SRC-32: a description from what fields there are."""
    return F.concat_ws(" | ", *[T.clean_or_null(c) for c in columns])


def links_summary(links: str) -> Column:
    """NRM-31, NRM-32: numbers of links, of extracted ones, and their characters."""
    return F.struct(F.size(F.coalesce(links, F.array().cast(schemas.LINKS))).alias("n_links"), F.size(F.filter(F.coalesce(links, F.array().cast(schemas.LINKS)), lambda x: x["extracted"])).alias("n_extracted"), F.aggregate(F.coalesce(links, F.array().cast(schemas.LINKS)), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["char_count"], F.lit(0))).alias("n_chars"))
