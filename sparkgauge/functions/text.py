"""Small text, JSON, date and list functions over columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, in lower case.
MISSING = ("", "nan", "none", "null", "nat")
#: All white space, as trimming takes it.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def nonempty(c: Column) -> Column:
    """The text; null if empty."""
    return F.try_element_at(F.filter(F.array(c), lambda x: x != ""), F.lit(1))


def compact(c: Column | str) -> Column:
    """White space runs to one space, none at the ends."""
    # single spaces are right already
    return F.trim(F.regexp_replace(col(c), r"(?U)\s{2,}|[^\S ]", " "))


def is_missing(c: Column | str) -> Column:
    """Null, or a text that stands for a missing value, in whatever case and with whatever space around it."""
    text = col(c).cast("string")
    return text.isNull() | F.lower(F.btrim(text, F.lit(WHITE))).isin(*MISSING)


def clean_text(c: Column | str) -> Column:
    """The compacted text; null if missing."""
    return F.when(~is_missing(c), compact(col(c).cast("string")))


def first_present(*columns: Column | str) -> Column:
    """The first of the columns that isn't missing, as text."""
    return F.coalesce(*(F.when(~is_missing(c), col(c).cast("string")) for c in columns))


def keywords_in(text: Column | str, words: Sequence[str]) -> Column:
    """Those of ``words`` that the text (in lower case) contains, in the order given."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: low.contains(w))


def has_any(text: Column | str, words: Sequence[str]) -> Column:
    return F.size(keywords_in(text, words)) > 0


def flags(*conditions: tuple[Column, Column | str]) -> Column:
    """The labels of the conditions that hold, in order."""
    every = F.array(*(F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in conditions))
    return F.filter(every, lambda x: x.isNotNull())


def flag_union(*arrays: Column | str) -> Column:
    """The sorted set of all labels; null arrays count as empty."""
    found = F.array().cast("array<string>")
    for a in arrays:
        found = F.array_union(found, F.coalesce(col(a), F.array().cast("array<string>")))
    return F.array_sort(found)


def stable_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object with its keys in order and null fields kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def slug(c: Column | str) -> Column:
    """Lower case, spaces to underscores, slashes dropped, hyphens to underscores, in that order."""
    return F.translate(F.replace(F.replace(F.lower(col(c)), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("")), "-", "_")


def without_prefix(c: Column | str, prefix: str) -> Column:
    return F.when(col(c).startswith(prefix), F.substr(col(c), F.lit(len(prefix) + 1))).otherwise(col(c))


def day_difference(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(col(later), col(earlier))


def month_age(of: Column | str, today: Column | str) -> Column:
    """Whole calendar months between two dates, whatever their days."""
    a, b = col(today), col(of)
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c))


def month_label(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy_MM")


def in_year(c: Column | str, year: Column | int) -> Column:
    """Whether a date lies in the year; false where either is missing."""
    return F.coalesce(F.year(col(c)) == (F.lit(year) if isinstance(year, int) else year), F.lit(False))


def hashed_id(prefix: str, *parts: Column | str) -> Column:
    """A deterministic id of natural keys: the prefix and sixteen hexadecimal digits."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(col(p).cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 16))


def spread_key(key: Column | str, *others: Column | str) -> Column:
    """``key`` for a left join; a null one, which meets nothing, is dealt by the others rather than gathered in one task."""
    return F.coalesce(col(key), F.concat(F.lit("\x00"), F.coalesce(*(col(c) for c in others))))


def differs(a: Column | str, b: Column | str) -> Column:
    """Inequality where null is a value like any other."""
    return ~col(a).eqNullSafe(col(b))
