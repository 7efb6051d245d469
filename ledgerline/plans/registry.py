"""Registered queries: a Spark plan over the given tables and, where SQL can say it, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerline.plans.oracles import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a plan builder; `sql` is put behind the named views."""
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: report(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(*views, body=sql)
        return build
    return add


def report(rows: DataFrame) -> DataFrame:
    """Plain columns: days, instants and amounts as text, doubles to six places, lists joined."""
    def plain(field: T.StructField):
        c, t = F.col(field.name), field.dataType
        if isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DecimalType):
            c = c.cast("decimal(20,2)").cast("string")
        elif isinstance(t, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, ",")
        elif isinstance(t, T.IntegerType):
            c = c.cast("bigint")
        return c.alias(field.name)
    return rows.select(*[plain(f) for f in rows.schema.fields])


def money(name: str) -> str:
    """SQL text of an amount as `report` shows it."""
    return f"{name}::DECIMAL(20,2)::VARCHAR AS {name.split('.')[-1]}"


def moment(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name.split('.')[-1]}"


def day(name: str) -> str:
    return f"{name}::DATE::VARCHAR AS {name.split('.')[-1]}"
