"""Text normalisation of names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.config import ALL, LIMITS

CONTROL_CHARACTERS = r"[\x00-\x1f\x7f]"


def trimmed(value: Column) -> Column:
    """Strip every kind of white space; Spark's own trim strips only spaces."""
    return F.regexp_replace(value, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def bounded(value: Column, max_chars: int) -> Column:
    """The value itself when it is non-empty, short enough and free of control characters."""
    ok = (F.length(value) > 0) & (F.length(value) <= max_chars) & ~value.rlike(CONTROL_CHARACTERS)
    return F.when(ok, value)


def model_name(value: Column) -> Column:
    return bounded(F.lower(trimmed(value)), LIMITS.max_model_chars)


def agent_name(value: Column) -> Column:
    name = bounded(F.lower(trimmed(value)), LIMITS.max_agent_chars)
    return F.when(name != ALL, name)


def opaque_id(value: Column, max_chars: int = LIMITS.max_session_chars) -> Column:
    """Case is kept: identifiers are compared exactly."""
    return bounded(trimmed(value), max_chars)


def model_list(values: Column) -> Column:
    """Valid model names, distinct and sorted; a missing list is an empty one."""
    names = F.filter(F.transform(values, model_name), lambda name: name.isNotNull())
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_sort(F.array_distinct(names)), empty)


def is_sha256(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")
