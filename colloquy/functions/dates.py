"""Sent dates as microseconds since 1970 in UTC.

Unusable dates have the value of the first instant of year 1, as a real date of that year would: null would
order otherwise. Header texts of the common form are read by built-in expressions, others by Python in Arrow batches.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_tz

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of 0001-01-01 in UTC.
EARLIEST = -62_135_596_800_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_ZONE = re.compile(r"[+-](\d{2})(\d{2})")
#: Months, and the zone names that a date without a readable time may end in.
_DAY = re.compile(r"(\d{1,2})[\s-]+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[\s-]+(\d{2,4})", re.I)
_NAMED = re.compile(r"\b(?:UT|GMT|EST|EDT|CST|CDT|MST|MDT|PST|PDT)\b", re.I)
_COMMON = "^(?:[A-Za-z]{3}, )?(\\d{1,2} [A-Z][a-z]{2} \\d{4} \\d{2}:\\d{2}:\\d{2} [+-]\\d{4})$"


def _last_zone(text: str) -> tuple[str | None, bool]:
    """The last numeric zone, and whether none is wrong about hours or minutes."""
    zones = [*_ZONE.finditer(text)]
    if not zones:
        return None, True
    return zones[-1][0], int(zones[-1][1]) < 24 and int(zones[-1][2]) < 60


def micros_of(text: str | None) -> int | None:
    """Microseconds of a date header, or null where not even a day can be read.

    A wrong zone counts as UTC, a wrong time as midnight, second 60 as the last microsecond before the next minute.
    """
    text = (text or "").strip()
    if not text:
        return None
    zone, sound = _last_zone(text)
    parts = parsedate_tz(text)
    if parts is None:
        day = _DAY.search(text)
        if not day:
            return None
        named = _NAMED.search(text)
        where = zone if zone and sound else named[0] if named else "+0000"
        parts = parsedate_tz(f"{day[1]} {day[2]} {day[3]} 00:00:00 {where}")
        if parts is None:
            return None
    clock, offset = parts[3:6], parts[9]
    if not (0 <= clock[0] < 24 and 0 <= clock[1] < 60 and 0 <= clock[2] <= 60):
        clock = (0, 0, 0)
    if offset is None or abs(offset) >= 86400 or not sound:
        offset = 0
    try:
        at = datetime(*parts[:3], clock[0], clock[1], min(clock[2], 59), tzinfo=timezone.utc) - timedelta(seconds=offset)
    except (ValueError, OverflowError):
        return None
    return (at - _EPOCH) // timedelta(microseconds=1) + (999_999 if clock[2] == 60 else 0)


def _text_us(c: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def parsed(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else micros_of(x) for x in s], dtype="Int64")

    quick = F.unix_micros(F.try_to_timestamp(F.regexp_extract(c, _COMMON, 1), F.lit("d MMM yyyy HH:mm:ss Z")))
    # The quick reading holds where the zone is sound and the year isn't a matter of a calendar reform.
    sound = c.rlike(_COMMON) & c.rlike("[+-](?:0\\d|1[0-4])[0-5]\\d$") & c.rlike(" (?:19|20)\\d\\d ")
    read = sound & quick.isNotNull()
    # Python sees every row of a column that it is called for: those that it need not read are null there.
    return F.when(c.isNull(), F.lit(None).cast("long")).when(read, quick).otherwise(parsed(F.when(F.coalesce(read, F.lit(False)), F.lit(None)).otherwise(c)))


def sent_us(sent_date: Column | str, internal_date: Column | str, sent_ts: Column | None = None, internal_ts: Column | None = None) -> Column:
    """The sent date, else the internal one, else the earliest: each a timestamp if there is one, else a text."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    parts = []
    for stamp, text in ((sent_ts, sent_date), (internal_ts, internal_date)):
        if stamp is not None:
            parts.append(F.unix_micros(stamp))
        parts.append(_text_us(c(text)))
    return F.coalesce(*parts, F.lit(EARLIEST))


def normalize_sent_date(sent_date: Column | str, internal_date: Column | str | None = None) -> Column:
    """``sent_us`` as a timestamp, for display; the earliest instant is that of year 1."""
    return F.timestamp_micros(sent_us(sent_date, F.lit(None).cast("string") if internal_date is None else internal_date))
