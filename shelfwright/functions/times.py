"""Instants given by callers. Naive datetimes are UTC, whatever zone Python runs in."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(moment: datetime) -> datetime:
    return moment if moment.tzinfo is not None else moment.replace(tzinfo=timezone.utc)


def instant(moment: datetime) -> Column:
    return F.lit(utc(moment)).cast("timestamp")
