"""Numbers read from untrusted text: counters, costs, fractions and cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.config import LIMITS
from ledgerline.functions.text import trimmed

COST_TYPE = "decimal(38,12)"


def counter(value: Column) -> Column:
    """A whole number 0..2^53-1 given as a number or as text; null when it is not one."""
    number = value.try_cast("decimal(38,18)")
    ok = (number >= 0) & (number <= LIMITS.max_counter) & (number == F.floor(number))
    return F.when(ok, number.cast("bigint"))


def cost(value: Column) -> Column:
    """A non-negative amount; blank text counts as zero, anything else malformed is null."""
    amount = F.when(F.trim(value) == "", F.lit("0")).otherwise(value).try_cast(COST_TYPE)
    return F.when(amount >= 0, amount)


def safe_number(value: Column) -> Column:
    """A finite double or null."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def plain_decimal(value: Column) -> Column:
    """Decimal text of a non-negative amount without trailing zeros, as fingerprints use it; no setting changes it."""
    amount = value.cast(COST_TYPE)
    whole = F.floor(amount)
    places = ((amount % F.lit(1).cast("decimal(1,0)")).cast("decimal(13,12)") * F.lit(10**12)).cast("bigint")
    return F.regexp_replace(F.concat(whole.cast("decimal(38,0)").cast("string"), F.lit("."), F.lpad(places.cast("string"), 12, "0")), r"\.?0+$", "")


def fraction_cell(value: Column) -> Column:
    """A cell holding 0.19 or "19%"; null when it is neither."""
    text = trimmed(value)
    percent = safe_number(trimmed(F.regexp_replace(text, "%$", ""))) / 100
    return F.when(text.endswith("%"), percent).otherwise(safe_number(F.nullif(text, F.lit(""))))


def actual_cell(value: Column) -> Column:
    """A recorded usage cell as struct(value, valid): blank is null and valid, 0 stays 0."""
    text = trimmed(value)
    blank = value.isNull() | (text == "")
    number = fraction_cell(value)
    return F.struct(
        F.when(~blank & (number >= 0), number).alias("value"),
        (blank | F.coalesce(number >= 0, F.lit(False))).alias("valid"),
    )


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where there is no whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))
