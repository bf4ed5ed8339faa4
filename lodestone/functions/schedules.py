"""Schedules of five fields (minute, hour, day of month, month, weekday) and the next time at which they are due, as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least and greatest number of each field, and the names that stand for numbers. Weekday 0 and 7 are Sunday.
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
#: Days ahead that are looked at first, next, and at all: every weekday meets February 29 within 40 years.
NEXT, NEAR, FAR = 31, 400, 14_700
#: The greatest length of each month.
LENGTHS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once a row however often the body names it, in its lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(text: Column, names: tuple[str, ...], first: int) -> Column:
    return reduce(lambda t, n: F.replace(t, F.lit(n[1]), F.lit(str(n[0] + first))), enumerate(names), text)


def field_values(text: Column, least: int, greatest: int) -> Column:
    """The numbers that a field names: `*`, numbers, ranges, each with a step if it has one, in a list. Null for anything else."""
    pattern = r"^(?:(\*)|(\d{1,4})(?:-(\d{1,4}))?)(?:/(\d{1,4}))?$"

    def part(p: Column) -> Column:
        group = lambda k: F.nullif(F.regexp_extract(p, pattern, k), F.lit("")).cast("int")
        star, step = F.startswith(p, F.lit("*")), F.coalesce(group(4), F.lit(1))
        low = F.when(star, least).otherwise(group(2))
        high = F.when(star, greatest).otherwise(F.coalesce(group(3), F.when(group(4).isNotNull(), greatest).otherwise(group(2))))
        good = F.rlike(p, F.lit(pattern)) & (step > 0) & (low >= least) & (high <= greatest) & (low <= high)
        return F.when(good, F.sequence(low, high, step))

    whole = lambda parts: F.when(~F.exists(parts, lambda x: x.isNull()), F.array_sort(F.array_distinct(F.flatten(parts))))
    return _given(F.transform(F.split(text, ","), part), whole)


def next_due(cron: Column, now: int, offset_s: int = 0) -> Column:
    """Epoch seconds of the first minute after `now` that a schedule names, by a clock offset_s ahead of UTC.

    Where day of month and weekday are both given one of them is enough; a field that begins with * is not given. Null
    for expressions that are not of five such fields, and for those that name no day.
    """
    begin = (now + offset_s) // 60 + 1
    today, minute = begin // 1_440, begin % 1_440

    def named(f: Column, day: Column) -> Column:
        date = F.date_add(F.lit("1970-01-01").cast("date"), day)  # the epoch began on a Thursday
        of_month, of_week = F.array_contains(f["days"], F.dayofmonth(date)), F.array_contains(f["weekdays"], F.pmod(day + 4, F.lit(7)))
        return F.array_contains(f["months"], F.month(date)) & F.when(f["either"], of_month | of_week).otherwise(of_month & of_week)

    def parsed(fields: Column) -> Column:
        text = [F.try_element_at(fields, F.lit(k + 1)) for k in range(5)]
        text[3], text[4] = _numbered(text[3], MONTHS, 1), _numbered(text[4], WEEKDAYS, 0)
        minutes, hours, days, months, weekdays = (field_values(t, *b) for t, b in zip(text, BOUNDS, strict=True))
        either = ~F.startswith(text[2], F.lit("*")) & ~F.startswith(text[4], F.lit("*"))
        cells = (minutes.alias("minutes"), hours.alias("hours"), days.alias("days"), months.alias("months"), F.transform(weekdays, lambda x: x % 7).alias("weekdays"), either.alias("either"))
        return F.when(F.size(fields) == 5, F.struct(*cells))

    def due(f: Column) -> Column:
        # some month is long enough for the least day; without it no day is named, and none is looked for
        longest = F.array_max(F.transform(f["months"], lambda m: F.element_at(F.array(*map(F.lit, LENGTHS)), m)))
        some = f["either"] | (F.array_min(f["days"]) <= longest)
        first = lambda lo, hi: F.get(F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda day: named(f, day)), F.lit(0))
        later = F.coalesce(first(today + 1, today + NEXT), first(today + NEXT + 1, today + NEAR), first(today + NEAR + 1, today + FAR))
        times = lambda after: F.flatten(F.transform(f["hours"], lambda h: F.filter(F.transform(f["minutes"], lambda m: h * 60 + m), lambda t: t >= after)))
        still = F.when(named(f, F.lit(today)), F.array_min(times(minute)))
        least = F.array_min(f["hours"]) * 60 + F.array_min(f["minutes"])
        whole = reduce(lambda a, b: a & b, [f[c].isNotNull() for c in ("minutes", "hours", "days", "months", "weekdays")])
        return F.when(whole & some, F.coalesce(F.lit(today).cast("bigint") * 1_440 + still, later.cast("bigint") * 1_440 + least) * 60 - offset_s)

    return _given(_given(F.split(F.lower(F.trim(cron)), r"\s+"), parsed), due)
