"""Unified analytics: projections, residuals, roll-ups, filters, ranges, shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.config import ALL, RECOVERED_MACHINE, RECOVERED_MACHINE_NAME
from ledgerline.functions.dates import month_start, week_start
from ledgerline.functions.numbers import COST_TYPE, guarded_ratio
from ledgerline.operators.recovery import ALL_AGENT

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
          "total_tokens", "accounting_delta_tokens")
PARTS = TOKENS[:4]
VALUES = (*TOKENS, "reported_cost_usd", "pricing_complete")
DAY = ["usage_date", "machine_id", "agent"]

# The tags of model rows.
ATTRIBUTED = "canonical-attributed"
UNATTRIBUTED = "canonical-unattributed"
RECOVERED = "recovered-unattributed"
RANGES = {"7d": 7, "30d": 30, "90d": 90}


def _canonical(rows: DataFrame, *names: str) -> DataFrame:
    visible = rows.filter(~F.col("is_tombstone"))
    if "global_duplicate" in rows.columns:
        visible = visible.filter(~F.col("global_duplicate"))
    return visible.select(
        "usage_date", "machine_id", F.lit("canonical").alias("source_kind"), *names,
        "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
        F.col("reported_total_tokens").alias("total_tokens"), "accounting_delta_tokens", "reported_cost_usd",
        F.col("reported_cost_usd").isNotNull().alias("pricing_complete"))


def canonical_daily(rows: DataFrame) -> DataFrame:
    return _canonical(rows, "agent")


def canonical_models(rows: DataFrame) -> DataFrame:
    return _canonical(rows, "agent", "model")


def added_values() -> list[Column]:
    """Sums of the values: unknown costs are skipped, pricing is complete only if all of it is."""
    return [
        *[F.sum(c).alias(c) for c in TOKENS],
        F.sum("reported_cost_usd").cast(COST_TYPE).alias("reported_cost_usd"),
        F.bool_and("pricing_complete").alias("pricing_complete"),
    ]


def months(daily: DataFrame, models: DataFrame) -> DataFrame:
    """Month x machine x agent with the models seen in that month."""
    keys = ["month", "machine_id", "agent"]
    sums = daily.withColumn("month", month_start(F.col("usage_date"))).groupBy(*keys).agg(*added_values())
    names = models.withColumn("month", month_start(F.col("usage_date"))).groupBy(*keys).agg(
        F.array_sort(F.collect_set("model")).alias("models"))
    return sums.join(names, keys, "left").withColumns({
        "source_kind": F.lit("canonical"),
        "models": F.coalesce("models", F.array().cast("array<string>")),
        "model_attribution_available": F.col("models").isNotNull(),
    })


def regrouped_months(daily: DataFrame) -> DataFrame:
    """Months of an already filtered selection: no model list, attribution as given."""
    return daily.withColumn("month", month_start(F.col("usage_date"))).groupBy("month", "machine_id", "agent").agg(
        *added_values()).withColumns({
            "source_kind": F.lit("canonical"), "models": F.array().cast("array<string>"),
            "model_attribution_available": F.lit(True)})


def weeks(daily: DataFrame) -> DataFrame:
    return daily.withColumn("week", week_start(F.col("usage_date"))).groupBy("week", "machine_id", "agent").agg(*added_values())


def unattributed(daily: DataFrame, models: DataFrame) -> DataFrame:
    """What the model rows leave open of each day; may be negative.

    The cost residual is known only where the attributed cost is complete.
    """
    attributed = models.groupBy(*DAY).agg(*added_values()).select(*DAY, F.struct(*VALUES).alias("_m"))
    joined = daily.join(attributed, DAY, "left")
    rest = {c: F.col(c) - F.coalesce(F.col(f"_m.{c}"), F.lit(0)) for c in TOKENS}
    cost = F.when(F.col("_m").isNull(), F.col("reported_cost_usd")).when(
        F.col("_m.pricing_complete"),
        F.round(F.col("reported_cost_usd") - F.col("_m.reported_cost_usd"), 2).cast(COST_TYPE))
    left_over = F.lit(False)
    for c in TOKENS:
        left_over = left_over | (F.col(c) != 0)
    return joined.select(
        *DAY, "source_kind", *[v.alias(k) for k, v in rest.items()], cost.alias("reported_cost_usd"),
        (F.col("pricing_complete") & cost.isNotNull()).alias("pricing_complete")).filter(left_over)


def model_rows(daily: DataFrame, models: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """Attributed, unattributed and recovered rows in one tagged set."""
    tagged = models.withColumn("kind", F.lit(ATTRIBUTED)).unionByName(
        unattributed(daily, models).withColumn("kind", F.lit(UNATTRIBUTED)), allowMissingColumns=True)
    if recovered is not None:
        tagged = tagged.unionByName(
            recovered.select("month", "machine_id", "source_kind", "agent", *VALUES, F.col("models").alias("known_models"))
            .withColumn("kind", F.lit(RECOVERED)), allowMissingColumns=True)
    return tagged


def monthly_rows(daily: DataFrame, models: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    canonical = months(daily, models)
    return canonical if recovered is None else canonical.unionByName(recovered)


def sorted_months(rows: DataFrame) -> DataFrame:
    return rows.orderBy("month", "machine_id", "agent")


def available_models(models: DataFrame) -> DataFrame:
    return models.select("model").distinct().orderBy("model")


@dataclass(frozen=True)
class Projection:
    daily: DataFrame
    monthly: DataFrame
    models: DataFrame
    recovered: DataFrame | None


def build_projection(daily: DataFrame, models: DataFrame, recovered: DataFrame | None = None) -> Projection:
    """`daily` and `models` are flagged current rows; `recovered` is recovery.project output."""
    day_rows, attributed = canonical_daily(daily), canonical_models(models)
    return Projection(day_rows, monthly_rows(day_rows, attributed, recovered),
                      model_rows(day_rows, attributed, recovered), recovered)


@dataclass(frozen=True)
class Filters:
    machine_id: str = ALL
    agent: str = ALL
    model: str = ALL
    range: str = ALL
    grain: str = "month"


@dataclass(frozen=True)
class Selection:
    """Lazy frames of one selection; all are empty when the selection is not supported."""

    status: DataFrame
    daily: DataFrame
    monthly: DataFrame
    models: DataFrame
    totals: DataFrame


def in_scope(rows: DataFrame, filters: Filters) -> DataFrame:
    if filters.machine_id != ALL:
        rows = rows.filter(F.col("machine_id") == filters.machine_id)
    if filters.agent != ALL:
        rows = rows.filter(F.col("agent") == filters.agent)
    return rows


def within_range(rows: DataFrame, anchor: DataFrame, span: str) -> DataFrame:
    """Last n days counted back from the newest day of `anchor`; all rows for the open range or without an anchor."""
    if span == ALL:
        return rows
    first = F.lit("0001-01-01").cast("date")
    start = F.coalesce(F.date_sub(anchor.agg(F.max("usage_date").alias("d")).scalar(), RANGES[span] - 1), first)
    return rows.filter(F.col("usage_date") >= start)


def select_usage(projection: Projection, filters: Filters) -> Selection:
    """Filter, range and grain in one lazy plan; filters lie below every roll-up.

    Recovered rows exist per month only: with them in scope, day and week grain
    and rolling ranges are unsupported. The check is a one-row subquery inside
    the plan, so nothing runs while the plan is built.
    """
    every_model = filters.model == ALL
    recovered = projection.recovered
    found = F.lit(False)
    if recovered is not None:
        found = in_scope(recovered, filters).limit(1).agg((F.count(F.lit(1)) > 0).alias("f")).scalar()
    in_play = found & F.lit(every_model)
    # The two reasons.
    reason = (
        F.when(in_play & F.lit(filters.grain != "month"), F.lit("recovered-month-only"))
        .when(in_play & F.lit(filters.range != ALL), F.lit("recovered-all-time-only"))
    )
    supported = reason.isNull()

    attributed = in_scope(projection.models.filter(F.col("kind") == ATTRIBUTED), filters)
    if not every_model:
        attributed = attributed.filter(F.col("model") == filters.model)
    scoped = in_scope(projection.daily, filters) if every_model else attributed.select(projection.daily.columns)
    daily = within_range(scoped, scoped, filters.range)
    if every_model and filters.range == ALL:
        monthly = in_scope(projection.monthly, filters)
    else:
        monthly = regrouped_months(daily)
    models = in_scope(projection.models, filters) if every_model else attributed
    if filters.range != ALL:
        models = within_range(models.filter(F.col("kind") != RECOVERED), scoped, filters.range)
    monthly, daily, models = (rows.filter(supported) for rows in (monthly, daily, models))

    any_row = projection.daily.sparkSession.range(1)
    status = any_row.select(
        F.when(supported, "ready").otherwise("unsupported").alias("status"), reason.alias("reason"),
        in_play.alias("recovered_in_scope"),
        (found & F.lit(not every_model)).alias("model_attribution_excluded"),
        (~in_play).alias("supports_day_week"), (~in_play).alias("supports_rolling_ranges"))
    return Selection(status, daily, monthly, models, totals(monthly if filters.grain == "month" else daily))


def components() -> Column:
    return F.col(PARTS[0]) + F.col(PARTS[1]) + F.col(PARTS[2]) + F.col(PARTS[3])


def totals(rows: DataFrame) -> DataFrame:
    """One row of totals; zeros and complete pricing for an empty selection."""
    zero = F.lit(0)
    return rows.agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in TOKENS],
        F.coalesce(F.sum(components()), zero).alias("component_total_tokens"),
        F.round(F.coalesce(F.sum("reported_cost_usd"), zero), 2).cast(COST_TYPE).alias("reported_cost_usd"),
        F.count("reported_cost_usd").alias("cost_rows"), F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bool_and("pricing_complete"), F.lit(True)).alias("pricing_complete"))


def by_period(rows: DataFrame, period: str) -> DataFrame:
    return rows.groupBy(period).agg(F.sum("total_tokens").alias("total_tokens")).orderBy(period)


def whole_of(name: str) -> Column:
    """The sum over all rows of a report, on each of them. For rows per agent, machine, model or month: a few, however many rows they sum up."""
    return F.sum(name).over(Window.partitionBy(F.lit(1)))


def by_dimension(rows: DataFrame, dimension: str) -> DataFrame:
    """Totals per agent or machine, largest first, with the share of the whole."""
    sums = rows.groupBy(dimension).agg(F.sum("total_tokens").alias("total_tokens"))
    return sums.withColumn("share", guarded_ratio(F.col("total_tokens"), whole_of("total_tokens"))).orderBy(
        F.col("total_tokens").desc(), dimension)


def grouped_totals(rows: DataFrame, period: str) -> DataFrame:
    """Totals per period, per agent and per machine from one pass over the rows."""
    return rows.groupingSets([[period], ["agent"], ["machine_id"]], period, "agent", "machine_id").agg(
        F.sum("total_tokens").alias("total_tokens"))


def model_summary(rows: DataFrame) -> DataFrame:
    """Tagged model rows per model or per unattributed source, largest first.

    known_models lists the models that recovered rows name; it is empty for the other kinds.
    """
    month = F.date_format("month", "yyyy-MM")
    attributed, open_rows = F.col("kind") == ATTRIBUTED, F.col("kind") == UNATTRIBUTED
    key = (
        F.when(attributed, F.concat(F.lit("canonical:"), F.col("model")))
        .when(open_rows, F.concat_ws(":", F.lit(UNATTRIBUTED), "machine_id", "agent"))
        .otherwise(F.concat_ws(":", F.lit("recovered"), "agent", month)))
    period = F.when(F.col("kind") == RECOVERED, month).otherwise(F.col("usage_date").cast("string"))
    # Summed per agent and period first, so that the distinct counts see few rows.
    keyed = rows.withColumns({"key": key, "_period": period})
    fine = keyed.groupBy("key", "kind", "agent", "_period").agg(
        *[F.sum(c).alias(c) for c in TOKENS[:5]], F.sum("reported_cost_usd").alias("reported_cost_usd"),
        F.count("reported_cost_usd").alias("cost_rows"))
    sums = fine.groupBy("key", "kind").agg(
        *[F.sum(c).alias(c) for c in TOKENS[:5]],
        F.coalesce(F.sum("reported_cost_usd"), F.lit(0)).cast(COST_TYPE).alias("reported_cost_usd"),
        F.sum("cost_rows").alias("cost_rows"),
        F.count_distinct("agent").alias("agents"), F.count_distinct("_period").alias("periods"))
    none = F.array().cast("array<string>")
    if "known_models" in rows.columns:
        # Only the recovered rows, a few per month, name models.
        named = keyed.filter(F.col("kind") == RECOVERED).select(F.col("key").alias("_key"), F.explode("known_models").alias("_name")).groupBy("_key").agg(
            F.array_sort(F.collect_set("_name")).alias("_names"))
        sums = sums.join(named, F.col("key") == F.col("_key"), "left").withColumn("known_models", F.coalesce("_names", none)).drop("_key", "_names")
    else:
        sums = sums.withColumn("known_models", none)
    return sums.withColumns({
        "share": guarded_ratio(F.col("total_tokens"), whole_of("total_tokens")),
        "cache_share": guarded_ratio(F.col("cache_read_tokens"), F.col("total_tokens")),
    }).orderBy(F.col("total_tokens").desc(), "key")


def model_coverage(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Percent of the selection's components that model rows explain."""
    part = models.filter(F.col("kind") == ATTRIBUTED).agg(F.coalesce(F.sum(components()), F.lit(0)).alias("c")).scalar()
    return rows.agg(F.coalesce(F.sum(components()), F.lit(0)).alias("_all")).select(
        (guarded_ratio(part, F.col("_all")) * 100).alias("model_coverage_percent"))


def shares(total_row: DataFrame) -> DataFrame:
    """Component shares and cost coverage in percent, from a totals row."""
    whole = F.col("total_tokens")
    return total_row.select(
        (guarded_ratio(F.col("cache_read_tokens"), whole) * 100).alias("cache_share"),
        (guarded_ratio(F.col("input_tokens"), whole) * 100).alias("input_share"),
        (guarded_ratio(F.col("output_tokens"), whole) * 100).alias("output_share"),
        (guarded_ratio(F.col("cost_rows"), F.col("row_count")) * 100).alias("cost_coverage"))


def day_statistics(daily: DataFrame) -> DataFrame:
    """Days with usage, average per such day and the peak day (the earliest on a tie)."""
    days = daily.groupBy("usage_date").agg(F.sum("total_tokens").alias("total_tokens"))
    peak = F.max(F.struct("total_tokens", (-F.datediff("usage_date", F.lit("1970-01-01").cast("date"))).alias("_early"), "usage_date"))
    detailed = F.count(F.when(F.col("total_tokens") > 0, 1))
    return days.agg(
        detailed.alias("detailed_days"),
        F.when(detailed > 0, F.sum("total_tokens") / detailed).otherwise(F.lit(0.0)).alias("average_detailed_day"),
        peak.alias("_peak"),
    ).select("detailed_days", "average_detailed_day", F.col("_peak.usage_date").alias("peak_date"),
             F.col("_peak.total_tokens").alias("peak_tokens"))


def agent_facet(monthly: DataFrame) -> DataFrame:
    return monthly.filter(F.col("agent") != ALL_AGENT).select("agent").distinct().orderBy("agent")


def model_facet(models: DataFrame, filters: Filters) -> DataFrame:
    return available_models(in_scope(models.filter(F.col("kind") == ATTRIBUTED), filters))


def with_machine_name(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """Registry name, a fixed name for the recovered source, else the id itself."""
    names = machines.select("machine_id", F.col("name").alias("_name"))
    return rows.join(names, "machine_id", "left").withColumn(
        "machine_name", F.when(F.col("machine_id") == RECOVERED_MACHINE, F.lit(RECOVERED_MACHINE_NAME))
        .otherwise(F.coalesce("_name", "machine_id"))).drop("_name")
