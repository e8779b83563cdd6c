"""Timestamps without a zone, always meaning UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the HTTP date format.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

_HTTP_DATE = r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}:\d{2}:\d{2}) (?:GMT|UTC)$"


def as_ntz(value: Column | datetime | str) -> Column:
    """A run time as a timestamp_ntz column.

    Jobs take the run time as an argument instead of reading the clock, so that
    a retried task writes the same rows.
    """
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def parse_http_date(header: Column | str) -> Column:
    """An HTTP date such as ``Tue, 02 Jan 2024 03:04:05 GMT``; null when malformed."""
    header = F.col(header) if isinstance(header, str) else header
    day, month, year, clock = (F.regexp_extract(header, _HTTP_DATE, i) for i in range(1, 5))
    position = F.instr(F.lit(MONTHS.lower()), F.lower(month))
    # Names start every third letter; anything else is not a month.
    known = (month != "") & (F.pmod(position, F.lit(3)) == 1)
    number = F.lpad(F.ceil(position / 3).cast("string"), 2, "0")
    iso = F.concat(year, F.lit("-"), number, F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), clock)
    return F.when(known, iso).try_cast("timestamp_ntz")


def format_ts(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
