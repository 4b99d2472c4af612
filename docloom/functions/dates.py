"""Column builders for dates, years and their reconciliation, and the freshness boost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SearchConfig

#: The dated anchor in a text's beginning, and year forms of case numbers, in order.
ANCHOR = r"[ОоО]пределени[ея][а-яё\s.,№-]{0,80}?\bот\s+(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
SHORT_YEARS = (
    r"\b\d{2,3}[\s-]?[Ээ][Сс][\s-]?(\d{2})\b",
    r"\b\d{1,3}[\s-]?КГ[\s-]?(\d{2})\b",
    r"\b\d{1,4}[\s-]?УД[\s-]?(\d{2})\b",
    r"\bАПЛ[\s-]?(\d{2})\b",
)
LONG_YEAR = r"/(\d{4})"


def iso_date(c: Column) -> Column:
    """ISO date of a leading D.M.YYYY, else empty."""
    lead = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+", ""), r"^(\d{1,2}\.\d{1,2}\.\d{4})", 1)
    return F.coalesce(F.date_format(F.try_to_date(lead, "d.M.yyyy"), "yyyy-MM-dd"), F.lit(""))


def iso_year(iso: Column) -> Column:
    return F.substring(iso, 1, 4).try_cast("int")


def _number(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def pivot_year(two: Column) -> Column:
    return F.when(two < 50, two + 2000).otherwise(two + 1900)


def year_from_anchor(text: Column, head: int = 800) -> Column:
    year = _number(F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, head), "(?U)" + ANCHOR, 3))
    return F.when(year.between(2010, 2099), year)


def year_from_case(number: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(number, F.lit("")), r"(?U)\s+", " ")
    short = [pivot_year(_number(F.regexp_extract(clean, "(?U)" + p, 1))) for p in SHORT_YEARS]
    short = [F.when(F.regexp_extract(clean, "(?U)" + p, 1) != "", y) for p, y in zip(SHORT_YEARS, short, strict=True)]
    long = _number(F.regexp_extract(clean, LONG_YEAR, 1))
    return F.coalesce(*short, F.when(long.between(1990, 2099), long))


def reconcile(date_year: Column, anchor: Column, case: Column) -> Column:
    fits = lambda y: F.when(case.isNull() | (y >= case), y)
    return F.coalesce(F.greatest(fits(anchor), fits(date_year)), case)


def freshness(year: Column, config: SearchConfig = SearchConfig()) -> Column:
    age = F.greatest(F.lit(0), F.lit(config.as_of_year) - year)
    return F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(1.0)).otherwise(1 + config.freshness * F.exp(-age / config.freshness_years))
