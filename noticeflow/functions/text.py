"""Text as column expressions: cleaning, keys, tokens, matching. No UDFs.

Missing words (n/a, none, ...) differ by caller, so they are always an argument.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say that a value is missing, lower case.
MISSING = ("", "n/a", "na", "none", "null", "nan", "-", "--", "tbd", "unknown")

#: Words that say nothing about a title, for the content hash.
STOP_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")

#: HTML entities that occur in listings, and what they stand for; & comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

#: Titles shorter than this are too short to compare.
MIN_TITLE = 15

#: What makes up a word for word_pattern: letters, digits, the underscore, and marks on letters.
WORD = r"(?:_|[\p{L}\p{Nd}]\p{Mn}*)+"

Cols = Column | str


@dataclass(frozen=True)
class Hits:
    """A text with those words of a vocabulary that it has, found in one pass. Functions that look for terms take it in place of a text.

    text and words are columns; known are the words of all terms that may be asked for.
    """

    text: Column
    words: Column
    known: frozenset[str]


def col(c: Cols | Hits) -> Column:
    return c.text if isinstance(c, Hits) else F.col(c) if isinstance(c, str) else c


def words_of(term: str) -> list[str]:
    """The words of a term, as WORD parts them."""
    return re.findall(r"\w+", ascii_lower(term))


def ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def with_hits(df: DataFrame, text: Cols, terms: Iterable[str], name: str = "_words") -> tuple[DataFrame, Hits]:
    """df with a column of the words of terms that text has, and what to look for terms in: each text is cut into words once, however many terms there are."""
    known = sorted({w for t in terms for w in words_of(t)})
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    own = F.regexp_extract_all(F.translate(F.coalesce(col(text), F.lit("")), upper, lower), F.lit(f"({WORD})"), F.lit(1))
    found = F.array_intersect(own, F.array(*map(F.lit, known)).cast("array<string>"))
    return df.withColumn(name, found), Hits(col(text), F.col(name), frozenset(known))


def _in_hits(h: Hits, terms: Sequence[str]) -> list[Column]:
    """For each term whether the text has it; terms of several words are looked for in the text where it has all of their words."""
    out = []
    for t in terms:
        words = words_of(t)
        if missing := set(words) - h.known:
            raise ValueError(f"{t!r} needs words that were not looked for: {sorted(missing)}")
        there = F.array_contains(h.words, words[0]) if len(words) == 1 else F.size(F.array_intersect(h.words, F.array(*map(F.lit, words)))) == len(set(words))
        whole = len(words) == 1 and words[0] == ascii_lower(t)
        out.append(there if whole else F.when(there, F.coalesce(h.text, F.lit("")).rlike(word_pattern([t]))).otherwise(False))
    return out


def any_of(conditions: Sequence[Column]) -> Column:
    """Whether one holds; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def hits(conditions: Sequence[Column]) -> Column:
    """How many hold; null counts as no."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions], F.lit(0))


def clean_or_null(c: Cols, missing: Sequence[str] = MISSING) -> Column:
    """Trimmed text, or null where it is one of the missing words."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(~F.lower(trimmed).isin(*missing), trimmed)


def first_present(*columns: Cols, missing: Sequence[str] = MISSING) -> Column:
    """The first of columns that isn't missing."""
    return F.coalesce(*[clean_or_null(c, missing) for c in columns])


def pick(raw: Cols, aliases: Sequence[str], missing: Sequence[str] = MISSING) -> Column:
    """NRM-01: the first alias that a map of strings has a value for."""
    return F.coalesce(*[clean_or_null(F.try_element_at(col(raw), F.lit(a)), missing) for a in aliases])


def collapse(c: Cols) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def unescape_entities(c: Cols) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, col(c))


def clean_text(c: Cols) -> Column:
    """NRM-09: entities resolved, white space collapsed; null as empty."""
    return F.coalesce(collapse(unescape_entities(c)), F.lit(""))


def clean_value(c: Cols, placeholders: Sequence[str]) -> Column:
    """NRM-10: the value, empty where it is a placeholder phrase."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(F.lower(t).isin(*placeholders), "").otherwise(t)


def strip_patterns(c: Cols, patterns: Sequence[str], lead: str = r"^[\s\-:;,.|/]+") -> Column:
    """NRM-02: text without patterns and leading punctuation; the text itself where nothing is left."""
    bare = reduce(lambda x, p: F.regexp_replace(x, p, " "), patterns, col(c))
    return F.coalesce(F.nullif(F.regexp_replace(collapse(bare), lead, ""), F.lit("")), F.trim(col(c)))


def tokens(c: Cols, stop_words: Sequence[str] = (), least: int = 1) -> Column:
    """RET-03: lower-case tokens of letters and digits, at least so long, without stop words; each once."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(rf"([a-z0-9]{{{least},}})"), F.lit(1))
    found = F.array_distinct(found)
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def content_hash(c: Cols, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """NRM-03: md5 of the sorted words of a title, blind to case, order, punctuation and stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9 ]+", ""), " +")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))
    return F.md5(F.array_join(F.sort_array(kept), " "))


def key_hash(*columns: Cols) -> Column:
    """SUB-21: md5 of trimmed lower-case values, joined by bars."""
    return F.md5(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))) for c in columns]))


def slug(c: Cols, length: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def derive_id(source: Cols, url: Cols, title: Cols, length: int = 60) -> Column:
    """NRM-11, NRM-19: SOURCE_slug of the last part of the URL, else of the title."""
    tail = F.element_at(F.split(F.regexp_replace(F.coalesce(col(url), F.lit("")), r"[?#].*$|/+$", ""), "/"), -1)
    part = F.coalesce(F.nullif(slug(tail, length), F.lit("")), slug(title, length))
    return F.concat(F.upper(F.coalesce(col(source), F.lit(""))), F.lit("_"), part)


def reference_id(title: Cols, authority: Cols) -> Column:
    """NRM-20: a slug of 36 characters and 8 digits of a hash of title and authority."""
    digest = F.md5(F.concat_ws("|", F.coalesce(col(title), F.lit("")), F.coalesce(col(authority), F.lit(""))))
    return F.concat(slug(title, 36), F.lit("-"), F.substring(digest, 1, 8))


def repair_mojibake(c: Cols) -> Column:
    """NRM-24: UTF-8 that was read as Latin-1, read again; other text as it is."""
    return F.when(col(c).rlike("[ÃÂâ][\\x{80}-\\x{BF}]"), F.decode(F.encode(col(c), "ISO-8859-1"), "UTF-8")).otherwise(col(c))


def word_pattern(terms: Sequence[str]) -> str:
    """One pattern for terms at word bounds, in which a blank matches any white space; terms have word characters at both ends."""
    return r"(?i)\b(?:" + "|".join(r"\s+".join(map(re.escape, t.split())) for t in terms) + r")\b"


def has_word(c: Cols | Hits, terms: Sequence[str]) -> Column:
    """FLT-01, FLT-02: whether text has one of terms as words, in any case."""
    if isinstance(c, Hits):
        return any_of(_in_hits(c, terms))
    return F.coalesce(col(c), F.lit("")).rlike(word_pattern(terms)) if terms else F.lit(False)


def has_part(c: Cols | Hits, terms: Sequence[str]) -> Column:
    """FLT-03, FLT-04: whether lower-case text contains one of terms."""
    return any_of([F.lower(F.coalesce(col(c), F.lit(""))).contains(t) for t in terms])


def has(c: Cols | Hits, terms: Sequence[str], mode: str = "word") -> Column:
    return has_word(c, terms) if mode == "word" else has_part(c, terms)


def count_terms(c: Cols | Hits, terms: Sequence[str], mode: str = "word") -> Column:
    """SUB-02: how many of terms occur, not how often."""
    if isinstance(c, Hits) and mode == "word":
        return hits(_in_hits(c, terms))
    return hits([has(c, [t], mode) for t in terms])


def matched_terms(c: Cols | Hits, terms: Sequence[str], mode: str = "word") -> Column:
    """Those of terms that occur, in their order."""
    return F.filter(F.array(*[F.when(has(c, [t], mode), t) for t in terms]), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")


def normalise_title(c: Cols, noise: Sequence[str] = ()) -> Column:
    """DED-06: lower case, without codes that have three digits or more, noise phrases and punctuation."""
    t = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\b[\w/\-]*\d{3,}[\w/\-]*\b", " ")
    t = reduce(lambda x, n: F.regexp_replace(x, rf"(?U)\b{re.escape(n)}\b", " "), noise, t)
    return collapse(F.regexp_replace(t, r"(?U)[^\w\s]|_", " "))


def normalise_organisation(c: Cols, legal: Sequence[str] = ("ltd", "limited", "inc", "llc", "gmbh", "plc", "pvt", "the", "of")) -> Column:
    """DED-07: lower case, without legal words and punctuation."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)[^\w\s]", " ")
    return collapse(F.regexp_replace(bare, r"(?U)\b(?:" + "|".join(map(re.escape, legal)) + r")\b", " "))


def is_generic_title(c: Cols, phrases: Sequence[str], words: Sequence[str]) -> Column:
    """SUB-03: blank, a set phrase, or two words at most with a generic one."""
    t = collapse(F.lower(F.coalesce(col(c), F.lit(""))))
    parts = F.split(t, " ")
    few = (F.size(parts) <= 2) & F.arrays_overlap(parts, F.array(*map(F.lit, words))) if words else F.lit(False)
    return (t == "") | t.isin(*phrases) | few


def blocking_key(normalised: Cols, words: int = 3, least: int = MIN_TITLE) -> Column:
    """DED-08: the first words of a normalised title; null where it is too short to compare."""
    return F.when(F.length(normalised) >= least, F.array_join(F.slice(F.split(normalised, " "), 1, words), " "))


def canonical(c: Cols, exact: dict[str, str], parts: Sequence[tuple[str, str]] = (), default: Column | None = None) -> Column:
    """NRM-05, NRM-15 to NRM-17, NRM-23, NRM-27, NRM-28: an exact alias, else the first part found, else default or the trimmed text."""
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    out = F.coalesce(*[F.when(t == k, v) for k, v in exact.items()], *[F.when(t.contains(k), v) for k, v in parts]) if exact or parts else F.lit(None).cast("string")
    return F.coalesce(out, default if default is not None else F.nullif(F.trim(col(c)), F.lit("")))


def ui_artifact(c: Cols, labels: Sequence[str], least: int = 12) -> Column:
    """NRM-22: a label of the page, too short, or no letter at all."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.lower(t).isin(*labels) | (F.length(t) < least) | ~t.rlike(r"\p{L}")


def bracket_groups(c: Cols) -> Column:
    """NRM-33: title, reference and id of a cell [title][reference][id], by the number of groups; the text itself without any."""
    g = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    at = lambda i: F.nullif(F.trim(F.get(g, F.lit(i))), F.lit(""))
    return F.struct(F.coalesce(at(0), F.trim(col(c))).alias("title"), F.when(F.size(g) >= 2, at(1)).alias("reference"), F.when(F.size(g) >= 3, at(2)).alias("id"))


def words_in(c: Cols) -> Column:
    """Number of words between white space."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def search_blob(*columns: Cols) -> Column:
    """SUB-01: lower-case text of several columns, joined by blanks."""
    return F.lower(F.concat_ws(" ", *map(col, columns)))


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounded half to even."""
    return F.bround(c, digits)


def safe_ratio(a: Column, b: Column, on_zero: float | None = None) -> Column:
    """a / b, or on_zero where b is zero."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if on_zero is None else F.coalesce(r, F.lit(float(on_zero)))


def string_array(c: Cols) -> Column:
    """A JSON list of strings, encoded once or twice; empty where it isn't one."""
    kind = "array<string>"
    return F.coalesce(F.from_json(col(c), kind), F.from_json(F.get_json_object(col(c), "$"), kind), F.array().cast(kind))
