"""Calendar helpers: keys, truncation, wall clocks and spreadsheet serials."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.functions.numbers import safe_number
from ledgerline.functions.text import trimmed

# The days that a date cell may name.
EARLIEST_DATE = "2020-01-01"
LATEST_DATE = "2035-01-01"


def calendar_date(value: Column) -> Column:
    """yyyy-MM-dd text naming a real day, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def month_start(value: Column) -> Column:
    return F.trunc(value, "month")


def month_key(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def week_start(value: Column) -> Column:
    """The Monday on or before the day."""
    return F.date_trunc("week", value).cast("date")


def compact_date(value: Column) -> Column:
    return F.date_format(value, "yyyyMMdd")


def local_date(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant, zone).cast("date")


def dated_instant(value: Column) -> Column:
    """Text that names a day, and perhaps a time of it, as an instant; a clock alone or a bare number is null."""
    text = trimmed(value.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T\x20]|$)"), F.try_to_timestamp(text))


def instant_millis(value: Column) -> Column:
    """An activity time as an instant in whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(dated_instant(value)))


def wall_to_instant(day: Column, time: Column, zone: str, later: bool = False) -> Column:
    """The instant a wall clock in the zone shows day and HH:mm; null inside a gap.

    A wall time that a clock shows twice has two instants: the earlier one counts, which is Spark's choice too, or the later
    one if so asked. Zones change their offset less than once a day, so that one has the offset of a day after.
    """
    wall = F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), time, F.lit(":00")))

    def shown(instant: Column) -> Column:
        return F.when(F.from_utc_timestamp(instant, zone) == wall, instant)

    earlier = shown(F.to_utc_timestamp(wall, zone))
    if not later:
        return earlier
    after = wall + F.expr("interval 24 hours")
    return F.greatest(earlier, shown(wall - (F.from_utc_timestamp(after, zone) - after)))


def day_sequence(first: Column, last: Column) -> Column:
    """Every day from first to last; empty when the range is reversed."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day"))).otherwise(
        F.array().cast("array<date>")
    )


def clock_cell(value: Column) -> Column:
    """A daily check time given as H:MM, HH:MM:SS or as a fraction of a day, as HH:mm."""
    text = trimmed(value)
    parts = r"^(\d{1,2}):(\d{2})(:\d{2})?$"
    hours = F.regexp_extract(text, parts, 1).try_cast("int")
    minutes = F.regexp_extract(text, parts, 2).try_cast("int")
    share = safe_number(text)
    minute_of_day = F.pmod(F.floor(share * 1440 + 0.5), F.lit(1440)).cast("int")
    return F.when(
        text.rlike(parts) & (hours <= 23) & (minutes <= 59), hours_minutes(hours, minutes)
    ).when(
        (share >= 0) & (share < 1),
        hours_minutes(F.floor(minute_of_day / 60).cast("int"), F.pmod(minute_of_day, F.lit(60))),
    )


def hours_minutes(hours: Column, minutes: Column) -> Column:
    return F.concat(
        F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0")
    )


def date_cell(value: Column, check_time: Column, zone: str) -> Column:
    """A date cell as an instant: serial number, date with time, or date alone at the check time."""
    text = trimmed(value)
    minutes = F.floor(safe_number(text) * 1440 + 0.5)
    serial_day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(minutes / 1440).cast("int"))
    minute_of_day = F.pmod(minutes, F.lit(1440)).cast("int")
    serial_time = hours_minutes(
        F.floor(minute_of_day / 60).cast("int"), F.pmod(minute_of_day, F.lit(60))
    )
    dated = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})(:\d{2})?$"
    instant = (
        F.when(
            text.rlike(dated),
            wall_to_instant(
                calendar_date(F.regexp_extract(text, dated, 1)), F.regexp_extract(text, dated, 2), zone
            ),
        )
        .when(calendar_date(text).isNotNull(), wall_to_instant(calendar_date(text), check_time, zone))
        .when(
            safe_number(text).between(-60000, 2000000), wall_to_instant(serial_day, serial_time, zone)
        )
    )
    day = local_date(instant, zone)
    return F.when(day.between(F.lit(EARLIEST_DATE).cast("date"), F.lit(LATEST_DATE).cast("date")), instant)
