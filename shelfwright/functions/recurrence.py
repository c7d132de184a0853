"""When a recurring rule runs next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.schema import Recurrence

# Period lengths.
PERIOD_SECONDS = {Recurrence.HOURLY: 3600, Recurrence.DAILY: 86400, Recurrence.WEEKLY: 604800}
# A day after the 28th is lost at the next February too short for it, which takes eight years at most.
MONTHS_TO_FEBRUARY = 97


def add_month(t: Column) -> Column:
    """One month later by calendar overflow: 31 January becomes 3 March, not 28 February."""
    month_start = F.date_trunc("MONTH", t)
    next_start = month_start + F.make_ym_interval(F.lit(0), F.lit(1))
    return next_start + (t - month_start)


def next_run(recurrence: Column, start: Column, now: Column) -> Column:
    """First ``start + k periods`` with k >= 1 that lies after ``now``; null for a one-off rule."""
    elapsed = F.unix_micros(now) - F.unix_micros(start)
    fixed = F.lit(None).cast("timestamp")
    for period, seconds in PERIOD_SECONDS.items():
        micros = F.lit(seconds * 1_000_000)
        periods = F.greatest(F.floor(elapsed / micros) + 1, F.lit(1))
        fixed = F.when(
            recurrence == period.value,
            F.timestamp_micros((F.unix_micros(start) + periods * micros).cast("bigint")),
        ).otherwise(fixed)
    return F.when(recurrence == Recurrence.MONTHLY.value, _next_month(start, now)).otherwise(fixed)


def _next_month(start: Column, now: Column) -> Column:
    # Overflowing days persist (31 Jan, 3 Mar, 3 Apr), so months are added one at a time while the day can
    # overflow, and from then on in one step.
    late = F.aggregate(
        F.sequence(F.lit(1), F.lit(MONTHS_TO_FEBRUARY)),
        add_month(start),
        lambda t, _: F.when((t <= now) & (F.day(t) > 28), add_month(t)).otherwise(t),
    )
    first = F.when(F.day(start) > 28, late).otherwise(add_month(start))
    return F.get(F.transform(F.array(first), lambda t: F.when(t > now, t).otherwise(_months_later(t, now))), F.lit(0))


def _months_later(t: Column, now: Column) -> Column:
    """The first whole number of months after ``t``, whose day every month has, that lies after ``now``."""
    months = ((F.year(now) - F.year(t)) * 12 + F.month(now) - F.month(t)).cast("int")
    this_month = t + F.make_ym_interval(F.lit(0), months)
    return F.when(this_month > now, this_month).otherwise(t + F.make_ym_interval(F.lit(0), months + 1))


def start_time(text: Column, now: Column) -> Column:
    """A typed start time, or ``now`` when it is empty or cannot be read."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("timestamp"), now)
