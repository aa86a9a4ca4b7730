"""Publication times on New York's clock, without the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
CLOSE = "16:00:00"
_OFFSET = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def _midnight(t: Column) -> Column:
    return t == F.date_trunc("day", t).cast("timestamp_ntz")


def source_wall(raw: Column) -> Column:
    """The source's own wall clock as a time without a zone; NULL if it cannot be read."""
    bare = F.regexp_replace(F.trim(raw), _OFFSET, "")
    return bare.try_cast("timestamp_ntz")


def offset_minutes(raw: Column) -> Column:
    """The source's offset from UTC in minutes; NULL if it names none. A date alone has none."""
    mark = F.regexp_extract(F.trim(raw), r"(?i)\d{2}:\d{2}.*?(Z|[+-]\d{2}:?\d{2})$", 1)
    digits = F.regexp_replace(mark, ":", "")
    sign = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int"))
    return F.when(mark == "", None).when(F.upper(mark) == "Z", 0).otherwise(minutes)


def new_york(raw: Column) -> Column:
    """New York's wall clock: converted if the source names an offset, else taken as it is."""
    here = source_wall(raw)
    off = offset_minutes(raw)
    utc = F.timestamp_add("MINUTE", -off, here)
    return F.when(off.isNull(), here).otherwise(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc))


def imprecise(raw: Column) -> Column:
    """Whether the source's own clock stands at midnight: only the day is known."""
    return _midnight(source_wall(raw))


def anchor(raw: Column, close: str = CLOSE) -> tuple[Column, Column]:
    """(day, strict): news can be traded on the first trading day on or after `day`, or after it if `strict`.

    The close itself is too late. Midnight, in the source or in New York, says only the day: then the next day.
    """
    ny = new_york(raw)
    vague = imprecise(raw)
    day = F.when(vague, F.to_date(source_wall(raw))).otherwise(F.to_date(ny))
    late = F.date_format(ny, "HH:mm:ss.SSSSSS") >= f"{close}.000000"
    return day, vague | _midnight(ny) | late
