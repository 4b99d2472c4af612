"""Predicates of a query row over a document row. Statistics never see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import digit_runs, norm_tag

#: The courts that filter; any other value is no filter.
COURTS = ("СКГД", "СКЭС")


def court(asked: Column, held: Column, known: tuple[str, ...] = COURTS) -> Column:
    name = F.upper(F.trim(F.coalesce(asked, F.lit(""))))
    return ~name.isin(*[k.upper() for k in known]) | F.contains(F.upper(held), name)


def tag(asked: Column, held: Column) -> Column:
    wanted = norm_tag(F.coalesce(asked, F.lit("")))
    return (wanted == "") | F.exists(held, lambda t: norm_tag(t) == wanted)


def article(asked: Column, text: Column) -> Column:
    wanted = F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    runs = digit_runs(wanted)
    return (wanted == "") | F.contains(F.lower(text), wanted) | ((F.size(runs) > 0) & F.forall(runs, lambda n: F.contains(text, n)))


def years(low: Column, high: Column, held: Column) -> Column:
    after = (F.coalesce(low, F.lit(0)) == 0) | F.coalesce(held >= low, F.lit(False))
    before = (F.coalesce(high, F.lit(0)) == 0) | F.coalesce(held <= high, F.lit(False))
    return after & before
