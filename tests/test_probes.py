"""Faults that were found once: each stays a test."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.dates import instant_millis
from ledgerline.functions.numbers import plain_decimal
from ledgerline.operators.normalize import well_formed_object
from ledgerline.operators.readings import is_rate_limited
from ledgerline.operators.skew import hot_lookup
from ledgerline.session import is_local


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_two_documents_in_one_payload_are_refused(spark):
    assert one(spark, well_formed_object(F.lit('{"a":1}')))
    assert not one(spark, well_formed_object(F.lit('{"a":1}],[{"b":2}')))
    assert not one(spark, well_formed_object(F.lit("[1]")))


@pytest.mark.parametrize("text", ["12:30:00", "2024", "20240101"])
def test_an_instant_needs_a_day(spark, text):
    assert one(spark, instant_millis(F.lit(text))) is None


def test_an_instant_with_a_day_is_read(spark):
    assert one(spark, instant_millis(F.lit("2026-09-01T10:00:00Z")).cast("string")).startswith("2026-09-01 10:00:00")
    assert one(spark, instant_millis(F.lit("2026-09-01")).cast("string")).startswith("2026-09-01")


def test_white_space_around_a_status_is_ignored(spark):
    assert one(spark, is_rate_limited(F.lit("\tExhausted\n")))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_amounts_read_alike_under_any_setting(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for text, want in [("0", "0"), ("0.0000000001", "0.0000000001"), ("1.50", "1.5"), ("12345678901234567890.000000000001", "12345678901234567890.000000000001"), ("100", "100")]:
            assert one(spark, plain_decimal(F.lit(text).cast("decimal(38,12)"))) == want
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_hot_keys_of_equal_weight_lose_no_row(spark):
    rows = spark.range(6000).select((F.col("id") % 1500).alias("k"), "id").unionByName(spark.range(3000).select(F.lit(7).cast("bigint").alias("k"), "id"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = hot_lookup(rows, lookup, ["k"], "n", ["id"])
    assert joined.count() == 9000 and joined.filter("n IS NULL").count() == 0
    assert "TakeOrdered" not in joined._jdf.queryExecution().executedPlan().toString()


def test_only_a_single_process_may_use_a_local_folder():
    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[3,2,1000]") and not is_local("spark://host:7077") and not is_local("yarn")
