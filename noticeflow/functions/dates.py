"""Dates as column expressions. Today is always an argument."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import Cols, clean_or_null, col

#: Forms in the order that decides which of day and month comes first.
FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "dd-MMM-yyyy", "yyyyMMdd")

#: German and French month names that English formats don't know.
MONTHS = (("januar", "january"), ("februar", "february"), ("märz", "march"), ("mai", "may"), ("juni", "june"), ("juli", "july"), ("oktober", "october"), ("dezember", "december"))
_MONTH = r"(?i)\b(" + "|".join(own for own, _ in MONTHS) + r")\b\.?"


#: What a letter of a format stands for in a text.
_SHAPES = (("yyyy", r"\d{4}"), ("MMMM", r"\p{L}+"), ("MMM", r"\p{L}+"), ("MM", r"\d{2}"), ("dd", r"\d{2}"), ("d", r"\d{1,2}"))


def _shape(form: str) -> str:
    """The pattern of texts that a format may read, so that others are not tried on it."""
    found = {letters: shape for letters, shape in _SHAPES}
    return "^" + re.sub(r"y+|M+|d+|[^yMd]+", lambda m: found.get(m.group()) or re.escape(m.group()), form) + "$"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _english(t: Column) -> Column:
    word = F.lower(F.regexp_extract(t, _MONTH, 1))
    names = F.create_map(*[F.lit(x) for pair in MONTHS for x in pair])
    return F.when(word == "", t).otherwise(F.regexp_replace(t, F.lit(_MONTH), F.coalesce(F.try_element_at(names, word), word)))


def parse_date(c: Cols, formats: Sequence[str] = FORMATS) -> Column:
    """NRM-04, SRT-05: the first of formats that reads the text, after prefixes, ordinals and times of day went; else an ISO date within it."""
    t = F.regexp_replace(clean_or_null(c), r"(?i)^(?:deadline|closing(?: date)?|published|date|due)\s*:?\s*", "")
    t = F.regexp_replace(t, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(t, r"(?i)[T\s,]+(?:um\s+)?\d{1,2}:\d{2}.*$", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = _once(t, lambda x: F.initcap(F.regexp_replace(_english(x), r"^(\d{1,2})\. ", "$1 ")))
    within = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1)
    read = _once(t, lambda x: F.coalesce(*[F.when(x.rlike(_shape(f)), F.try_to_timestamp(x, F.lit(f))) for f in formats]))
    return F.coalesce(read, F.try_to_timestamp(within, F.lit("yyyy-MM-dd"))).cast("date")


def days_until(deadline: Cols, as_of: Column) -> Column:
    return F.datediff(col(deadline), as_of)


def deadline_bucket(deadline: Cols, as_of: Column, near: int = 7, far: int = 21) -> Column:
    """CLS-06: expired, closing_soon, needs_action, plan_ahead or unknown."""
    d = days_until(deadline, as_of)
    return F.when(d.isNull(), "unknown").when(d < 0, "expired").when(d <= near, "closing_soon").when(d <= far, "needs_action").otherwise("plan_ahead")


def bands(days: Column, edges: Sequence[tuple[int, str]], beyond: str, unknown: str = "unknown", before: str = "expired") -> Column:
    """AGG-33, AGG-34, CLS-33: the name of the first edge that days is up to."""
    out = F.when(days.isNull(), unknown).when(days < 0, before)
    for most, name in edges:
        out = out.when(days <= most, name)
    return out.otherwise(beyond)


def is_expired(deadline: Cols, as_of: Column) -> Column:
    """FLT-13: false where the date is unknown."""
    return F.coalesce(days_until(deadline, as_of) < 0, F.lit(False))


def deadlines_close(a: Cols, b: Cols, days: int = 7) -> Column:
    """DED-10: within days of each other, or one unknown."""
    return F.coalesce(F.abs(F.datediff(col(a), col(b))) <= days, F.lit(True))


def sortable(c: Cols) -> Column:
    """SRT-05: ISO text of a date, the text itself where it can't be read, 9999 where there is none."""
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), clean_or_null(c), F.lit("9999"))


def recency_score(day: Cols, as_of: Column, steps: Sequence[tuple[int, int]] = ((90, 25), (180, 20), (365, 10)), future: int = 15) -> Column:
    """EPS-01: points by age in days; a day to come has its own."""
    age = F.datediff(as_of, col(day))
    out = F.when(age.isNull(), 0).when(age < 0, future)
    for most, points in steps:
        out = out.when(age <= most, points)
    return out.otherwise(0)


def procurement_window(approved: Cols, opens: int = 90, closes: int = 270) -> Column:
    """EPS-05: first and last day, and a label."""
    a, b = F.date_add(col(approved), opens), F.date_add(col(approved), closes)
    return F.struct(a.alias("opens"), b.alias("closes"), F.concat_ws(" to ", F.date_format(a, "MMM yyyy"), F.date_format(b, "MMM yyyy")).alias("label"))
