"""Date keys: integers with months of 31 days, so that keys compare but are no calendar dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.text import NOT_WORD, let

LAST = 2**31


def key_parts(year: Column, month: Column, day: Column) -> Column:
    """year * 372 + (month - 1) * 31 + day - 1, null outside the valid ranges."""
    good = year.between(fixed.FIRST_YEAR, fixed.LAST_YEAR) & month.between(1, 12) & day.between(1, 31)
    return F.when(good, year * 372 + (month - 1) * 31 + day - 1)


def number(x: Column) -> Column:
    return x.try_cast("int")


def month_number(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in fixed.MONTHS.items() for v in pair])
    return F.try_element_at(table, F.lower(x))


def date_key(x: Column) -> Column:
    """Key of a date string whose first ten characters are year-month-day."""
    parts = F.split(F.substring(x, 1, 10), "-")
    return F.when(F.length(x) >= 10, key_parts(number(F.get(parts, 0)), number(F.get(parts, 1)), number(F.get(parts, 2))))


def plain_tokens(x: Column) -> Column:
    return F.filter(F.split(x, NOT_WORD), lambda t: t != "")


def first_of(items: Column, width: int, f) -> Column:
    """First value that is not null of ``f`` over windows of ``width`` items; windows without a digit have none."""

    def of(ws: Column) -> Column:
        at = F.when(F.size(ws) >= width, F.sequence(F.lit(0), F.greatest(F.size(ws) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        dated = F.filter(at, lambda i: F.array_join(F.slice(ws, i + 1, width), " ").rlike("[0-9]"))
        return F.get(F.filter(F.transform(dated, lambda i: f(*[F.get(ws, i + k) for k in range(width)])), lambda v: v.isNotNull()), 0)

    return let(items, of)


def query_date_key(query: Column) -> Column:
    """First full date in a query: year month day, day month-name year, or month-name day year."""

    def of(a: Column, b: Column, c: Column) -> Column:
        x, y, z = number(a), number(b), number(c)
        return (
            F.when(x.isNotNull() & y.isNotNull() & z.isNotNull() & (x >= fixed.FIRST_YEAR), key_parts(x, y, z))
            .when(x.isNotNull() & z.isNotNull(), key_parts(z, month_number(b), x))
            .when(month_number(a).isNotNull() & y.isNotNull() & z.isNotNull(), key_parts(z, month_number(a), y))
        )

    return first_of(plain_tokens(query), 3, of)


def month_key(x: Column) -> Column:
    """year * 12 + month - 1 of the first ``2020 May``, ``2020 M05`` or ``May 2020``."""

    def year_of(t: Column) -> Column:
        return F.when(number(t).between(fixed.FIRST_YEAR, fixed.LAST_YEAR), number(t))

    def of(a: Column, b: Column) -> Column:
        compact = number(F.regexp_extract(b, "^[mM]([0-9]{1,9})$", 1))
        month = F.coalesce(month_number(b), F.when(compact.between(1, 12), compact))
        return F.coalesce(year_of(a) * 12 + month - 1, year_of(b) * 12 + month_number(a) - 1)

    return first_of(plain_tokens(x), 2, of)


def url_date_key(path: Column) -> Column:
    """First three path segments in a row that are a date."""
    return first_of(F.split(F.regexp_replace(path, "^/", ""), "/"), 3, lambda a, b, c: key_parts(number(a), number(b), number(c)))


def hit_date_key(date: Column, path: Column) -> Column:
    return F.coalesce(date_key(date), url_date_key(path))


def hit_month_key(title: Column, snippet: Column, date: Column, path: Column) -> Column:
    by_date = F.floor(date_key(date) / 31).cast("int")
    return F.coalesce(month_key(F.concat_ws(" ", title, snippet)), by_date, F.floor(url_date_key(path) / 31).cast("int"))


def staleness(newest: Column, date: Column) -> Column:
    age = newest - date
    return F.when(age.isNull() | (age <= 31), 0.0).when(age <= 183, -0.015).when(age <= 372, -0.03).when(age <= 744, -0.06).otherwise(-0.10)


def date_adjustment(requested: Column, candidate: Column) -> Column:
    d = F.abs(requested - candidate)
    return F.when(d == 0, 0.12).when(d == 1, 0.04).otherwise(0.0)


def period_adjustment(requested: Column, candidate: Column) -> Column:
    d = requested - candidate
    return F.when(d.isNull(), 0.0).when(d == 0, 0.12).when(d == 1, 0.08).when(d == 2, -0.04).when(d >= 3, -0.10).otherwise(-0.03)


def year_adjustment(years: Column, requested: Column, as_of: Column, timeline: Column) -> Column:
    old = F.exists(years, lambda y: y <= requested - 2)
    return F.when((as_of & ~timeline) | requested.isNull(), 0.0).when(F.array_contains(years, requested), 0.03).when(old, -0.08).otherwise(0.0)
