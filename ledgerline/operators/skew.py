"""Joins and previous-row lookups that stay even when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_KEYS = 1000
SALTS = 16
ROWS_PER_PART = 200_000


def salt_of(columns: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts))


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str],
                how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join rows to a small or key-unique lookup on keys plus a salt.

    Rows of one key go to `salts` tasks; the lookup is repeated once per salt, so
    use it where the lookup is much smaller than the rows. Spark still turns it
    into a broadcast when the measured size allows.
    """
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return rows.withColumn("_salt", salt_of(spread_by, salts)).join(salted, [*keys, "_salt"], how).drop("_salt")


def wide_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Inner join of rows to a lookup with wide rows and as many keys as there are.

    Only keys with more than `rows_per_part` rows are spread, each over as many parts as it
    has such portions, so the lookup is repeated for these alone; at most one key in
    `rows_per_part` rows is, so their list is safe to broadcast. The lookup itself is never
    broadcast: Spark takes an array for one element, so its measured size says too little.
    """
    zero = F.lit(0).cast("bigint")
    large = F.broadcast(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("_parts")).filter("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    spread_rows = rows.join(large, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), parts)).drop("_parts")
    spread_lookup = lookup.join(large, keys, "left").withColumn("_salt", F.explode(F.sequence(zero, parts - 1))).drop("_parts")
    return spread_rows.join(spread_lookup.hint("merge"), [*keys, "_salt"]).drop("_salt")


def hot_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, spread_by: list[str],
               how: str = "left", salts: int = 256, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join rows to a lookup as large as the rows, salting only its heaviest keys.

    A key is hot when it holds more than one part in `hot_keys` of the total weight.
    Fewer than `hot_keys` keys can, whatever the data, so their list is safe to
    broadcast; keys of equal weight are all hot or none is, so both branches agree.
    """
    total = lookup.agg(F.sum(weight)).scalar()
    hot = F.broadcast(lookup.filter(F.col(weight) * hot_keys > total).select(*keys).withColumn("_hot", F.lit(True)))
    zero = F.lit(0).cast("bigint")
    salted_rows = rows.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt_of(spread_by, salts)).otherwise(zero)).drop("_hot")
    every = F.sequence(zero, F.lit(salts - 1).cast("bigint"))
    salted_lookup = lookup.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(zero)))).drop("_hot")
    return salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")


def with_previous(rows: DataFrame, keys: list[str], time: str, order: list[str], fields: list[str],
                  name: str = "previous", bucket_seconds: int = 6 * 3600) -> DataFrame:
    """Add struct(fields) of the row before, in `order`, under the same keys.

    A plain lag puts all rows of a key into one task. Here a task holds one time
    bucket of a key; only the last row of each bucket travels to the next one.
    `order` must start with `time`.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.unix_seconds(time) / bucket_seconds))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    packed = F.struct(*fields)
    local = bucketed.withColumns({
        "_inside": F.lag(packed).over(inside),
        "_is_tail": F.lead(F.lit(1)).over(inside).isNull(),
    })
    tails = local.filter("_is_tail").select(*keys, "_bucket", packed.alias("_tail"))
    carried = tails.withColumn("_carried", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket"))).select(
        *keys, "_bucket", "_carried")
    return (
        local.join(carried, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_bucket", "_inside", "_is_tail", "_carried")
    )
