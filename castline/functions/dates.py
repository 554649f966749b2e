"""Instants and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """Timestamp of an ISO text with a zone and at most six fraction digits; null for any other text."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))


def shift_months(at: Column, months: int) -> Column:
    """The same time of day so many months on; a day that the month lacks becomes its last one."""
    day = F.to_date(at)
    return F.timestamp_micros(F.unix_micros(F.add_months(day, months).cast("timestamp")) + F.unix_micros(at.cast("timestamp")) - F.unix_micros(day.cast("timestamp")))
