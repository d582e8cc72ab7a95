"""Column functions over dates, numbers, arrays and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_date(text: Column, pivot: int = 70) -> Column:
    """ddmmyy as a date; years from ``pivot`` are of the last century; null if there is no such day."""
    part = lambda k: F.regexp_extract(text, r"^(\d{2})(\d{2})(\d{2})$", k)
    century = F.when(part(3).try_cast("int") >= pivot, "19").otherwise("20")
    return F.to_date(F.try_to_timestamp(F.when(part(1) != "", F.concat(century, part(3), F.lit("-"), part(2), F.lit("-"), part(1))), F.lit("yyyy-MM-dd")))


def long_date(text: Column) -> Column:
    """A date like ``January 9, 2012``, in any spacing; null if there is no such day."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))), F.lit("MMMM d, yyyy")))


def full_year(two_digits: Column, pivot: int = 70) -> Column:
    return F.when(two_digits >= pivot, two_digits + 1900).otherwise(two_digits + 2000)


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def same_day(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy_MM")


def year_within(text: Column, low: int, high: int) -> Column:
    """Whether text starts with a year in the range."""
    return F.coalesce(F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int").between(low, high), F.lit(False))


def within(day: Column, since: str | None = None, until: str | None = None) -> Column:
    """Inclusive bounds, either of which may be open."""
    tests = [day >= F.lit(since).cast("date")] * (since is not None) + [day <= F.lit(until).cast("date")] * (until is not None)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def rate(count: Column, total: Column, per: float = 1000) -> Column:
    """``count`` for each ``per`` of ``total``; null without any."""
    return F.when(total > 0, count * per / total)


def right_closed(x: Column, cuts: list[float], labels: list[str]) -> Column:
    """The label of the bin (cut, next cut] that holds x; null outside."""
    out = F.when((x > cuts[0]) & (x <= cuts[1]), labels[0])
    for k in range(1, len(labels)):
        out = out.when((x > cuts[k]) & (x <= cuts[k + 1]), labels[k])
    return out


def fixed_width(x: Column, width: float) -> Column:
    return F.floor(x / width) * width


def padded(items: Column, size: int, fill: str = "") -> Column:
    return F.slice(F.concat(items, F.array_repeat(F.lit(fill), size)), 1, size)


def listed(text: Column, mark: str = ";") -> Column:
    """The parts of a list in text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda p: F.trim(p)), lambda p: p != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector is an error."""
    size = norm(v)
    checked = F.when(size > 0, size).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double"))
    return F.transform(v, lambda x: x / checked)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def first_of_largest(columns: list[str]) -> Column:
    """The name of the first column that holds the largest value."""
    top = F.greatest(*columns)
    return reduce(lambda out, c: out.when(F.col(c) == top, c), columns[1:], F.when(F.col(columns[0]) == top, columns[0]))
