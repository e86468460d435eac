"""Dates of any usual format: a column votes on what comes first, day or month; then every value is parsed once.

A value is taken apart by its shape (year first, numbers, a month's name) rather than tried against one format after
another, so none costs a failed parse, and a mixed column is no slower than a clean one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, is_missing, once

#: Months by name; three letters are enough.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_TIME = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?(Z|[+-]\d{2}:?\d{2})?)?$"
PLAIN = r"^\d{4}-\d{2}-\d{2}$"
YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME
COMPACT = r"^(\d{4})(\d{2})(\d{2})" + _TIME
NUMBERS = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TIME
DAY_NAMED = r"^(\d{1,2})[- ]([A-Za-z]{3,9})\.?[-, ] ?(\d{4}|\d{2})" + _TIME
MONTH_NAMED = r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})" + _TIME


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 4, text).otherwise(F.concat(F.when(text >= "69", "19").otherwise("20"), text))


def _month(name: Column) -> Column:
    """Number of a month's name or of a beginning of it of three letters or more; "sept" is one."""
    known = {m[:n]: str(i + 1) for i, m in enumerate(MONTHS) for n in (3, 4, len(m))}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.lower(name))


def parse(c: Column | str, day_first: Column | bool = False) -> Column:
    """The date of each text, times of day dropped; null for a missing, impossible or unknown one.

    Of two numbers that may both be months, the first is the day where ``day_first`` says so; a number over 12 is a day
    wherever it stands. Years of two digits are 1969 to 2068.
    """
    text = F.trim(col(c).cast("string"))
    # each value is matched once by its shape, and its parts are taken in one more match
    taken = lambda pattern, order: F.regexp_replace(text, pattern.removesuffix("$") + r"\R?$", order)
    parts = lambda pattern, order, use: once(F.split(taken(pattern, order), "-"), lambda p: use(*(F.get(p, i) for i in range(3))))
    iso = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")
    order = F.lit(day_first) if isinstance(day_first, bool) else F.coalesce(day_first, F.lit(False))

    def numbers(one: Column, two: Column, year: Column) -> Column:
        first = ((one.try_cast("int") > 12) | order) & (two.try_cast("int") <= 12)
        return iso(_year(year), F.when(first, two).otherwise(one), F.when(first, one).otherwise(two))

    named = lambda y, m, d: iso(_year(y), _month(m), d)
    return F.when(text.rlike(PLAIN), text.try_cast("date")).when(is_missing(c), None).when(text.rlike(YEAR_FIRST), taken(YEAR_FIRST, "$1-$3-$4").try_cast("date")).when(
        text.rlike(NUMBERS), parts(NUMBERS, "$1-$3-$4", numbers)
    ).when(text.rlike(MONTH_NAMED), parts(MONTH_NAMED, "$3-$1-$2", named)).when(text.rlike(DAY_NAMED), parts(DAY_NAMED, "$3-$2-$1", named)).when(text.rlike(COMPACT), taken(COMPACT, "$1-$2-$3").try_cast("date"))


def votes(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row for each group of ``by`` with day_first, a map of column to whether its values put the day first.

    Only values with exactly one number over 12 have a vote; the majority decides, month first if none has one or votes
    are even. One aggregate, combined before its shuffle, with two counts a column.
    """
    def lead(c: str) -> tuple[Column, Column]:
        text = F.trim(F.col(f"`{c}`").cast("string"))
        one, two = (F.regexp_extract(text, NUMBERS, i).try_cast("int") for i in (1, 3))
        return F.count_if((one > 12) & (two <= 12)), F.count_if((two > 12) & (one <= 12))

    pairs = [x for c in columns for x in (F.lit(c), lead(c)[0] > lead(c)[1])]
    return df.groupBy(*(F.col(f"`{k}`") for k in by)).agg(F.create_map(*pairs).alias("day_first"))


def with_votes(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with ``_day_first``, its group's map of column to vote; rows with a null key vote among themselves."""
    keys = {k: f"_by_{i}" for i, k in enumerate(by)}
    found = votes(df, columns, by).select(*(F.col(f"`{k}`").alias(n) for k, n in keys.items()), F.col("day_first").alias("_day_first"))
    on = F.lit(True)
    for k, n in keys.items():
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(n))
    return df.join(found, on, "left").drop(*keys.values())


def voted(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with ``columns`` as dates, each by the vote of its own values within a group of ``by`` (a file, say)."""
    return with_votes(df, columns, by).withColumns({c: parse(F.col(f"`{c}`"), F.try_element_at("_day_first", F.lit(c))) for c in columns}).drop("_day_first")
