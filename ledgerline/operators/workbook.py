"""Label and table lookup in workbook grids given as long cells(workbook_id, row, col, value).

One spreadsheet row is the unit of work; a workbook is bounded by its size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.dates import clock_cell, date_cell, local_date, wall_to_instant
from ledgerline.functions.numbers import actual_cell, fraction_cell, safe_number
from ledgerline.functions.text import trimmed

# Labels and headers the sheet must carry.
SOURCE_LABELS = ["Current monthly usage", "Tracking starts", "Daily check time", "Reset date/time",
                 "Hard monthly limit", "Safety reserve"]
DERIVED_LABELS = ["Days until reset", "Planned ceiling at reset", "Remaining usage budget",
                  "Avg additional usage/day", "Daily checkpoint"]
HEADERS = ["Day #", "Date", "Check Time", "Max Monthly Usage", "Actual Usage", "Status", "Headroom"]


def label_values(cells: DataFrame, labels: list[str]) -> DataFrame:
    """First cell equal to each label in reading order, and the first value to its right."""
    present = cells.filter(F.col("value").isNotNull())
    labelled = present.withColumn("label", trimmed(F.col("value"))).filter(F.col("label").isin(labels))
    first = labelled.groupBy("workbook_id", "label").agg(F.min(F.struct("row", "col")).alias("_at")).select(
        "workbook_id", "label", F.col("_at.row").alias("row"), F.col("_at.col").alias("label_col"))
    right = first.join(present, ["workbook_id", "row"], "left").groupBy("workbook_id", "label", "row", "label_col").agg(
        F.min(F.when(F.col("col") > F.col("label_col"), F.struct("col", "value")))["value"].alias("value"))
    return right


def missing_labels(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Workbooks that lack a label, or the value of a source label."""
    required = F.array(*[F.lit(x) for x in SOURCE_LABELS + DERIVED_LABELS])
    found = values.groupBy("workbook_id").agg(
        F.collect_set("label").alias("_found"),
        F.collect_set(F.when(F.col("value").isNotNull() | ~F.col("label").isin(SOURCE_LABELS), F.col("label"))).alias("_valued"))
    workbooks = cells.select("workbook_id").distinct()
    none = F.array().cast("array<string>")
    return workbooks.join(found, "workbook_id", "left").select(
        "workbook_id", F.array_sort(F.array_except(required, F.coalesce("_found", none))).alias("missing_labels"),
        F.array_sort(F.array_except(F.coalesce("_found", none), F.coalesce("_valued", none))).alias("labels_without_value"),
    ).filter((F.size("missing_labels") > 0) | (F.size("labels_without_value") > 0))


def header_columns(cells: DataFrame, headers: list[str] = HEADERS) -> DataFrame:
    """The first row that holds every header, and the column of each."""
    named = cells.withColumn("header", trimmed(F.col("value"))).filter(F.col("header").isin(headers))
    per_row = named.groupBy("workbook_id", "row", "header").agg(F.min("col").alias("col"))
    complete = per_row.groupBy("workbook_id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("header", "col"))).alias("columns")).filter(F.size("columns") == len(headers))
    return complete.groupBy("workbook_id").agg(F.min_by(F.struct("row", "columns"), "row").alias("_h")).select(
        "workbook_id", F.col("_h.row").alias("header_row"), F.col("_h.columns").alias("columns"))


def table_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header until the first one with a blank day number."""
    rows = cells.filter(F.col("value").isNotNull()).groupBy("workbook_id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_cells"))
    below = rows.join(headers, "workbook_id").filter(F.col("row") > F.col("header_row"))
    def cell(name):
        return F.try_element_at(F.col("_cells"), F.try_element_at(F.col("columns"), F.lit(name)))
    table = below.select(
        "workbook_id", "row", cell("Day #").alias("day_cell"), cell("Date").alias("date_cell"),
        cell("Check Time").alias("check_cell"), cell("Max Monthly Usage").alias("ceiling_cell"),
        cell("Actual Usage").alias("actual_cell"))
    blank = F.coalesce(trimmed(F.col("day_cell")), F.lit("")) == ""
    ends = table.filter(blank).groupBy("workbook_id").agg(F.min("row").alias("_end"))
    return table.join(ends, "workbook_id", "left").filter(F.col("_end").isNull() | (F.col("row") < F.col("_end"))).drop("_end")


def read_plans(values: DataFrame, zone: str) -> DataFrame:
    """One plan row per workbook from its label values."""
    by_label = values.groupBy("workbook_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("_v"))
    def value(name):
        return F.try_element_at(F.col("_v"), F.lit(name))
    timed = by_label.withColumn("check_time", clock_cell(value("Daily check time")))
    return timed.select(
        "workbook_id", "check_time",
        fraction_cell(value("Current monthly usage")).alias("baseline"),
        date_cell(value("Tracking starts"), F.col("check_time"), zone).alias("tracking_start"),
        date_cell(value("Reset date/time"), F.col("check_time"), zone).alias("reset_at"),
        fraction_cell(value("Hard monthly limit")).alias("hard_limit"),
        fraction_cell(value("Safety reserve")).alias("safety_reserve"),
        safe_number(value("Planned ceiling at reset")).alias("sheet_planned_ceiling"))


def read_checkpoints(table: DataFrame, plans: DataFrame, zone: str) -> DataFrame:
    """Typed checkpoint rows; a blank check time takes the plan's."""
    joined = table.join(plans.select("workbook_id", F.col("check_time").alias("_plan_time")), "workbook_id")
    blank_time = F.coalesce(trimmed(F.col("check_cell")), F.lit("")) == ""
    timed = joined.withColumn("check_time", F.when(blank_time, F.col("_plan_time")).otherwise(clock_cell(F.col("check_cell"))))
    dated = timed.withColumn("date", local_date(date_cell(F.col("date_cell"), F.col("check_time"), zone), zone))
    day = safe_number(F.col("day_cell"))
    return dated.select(
        "workbook_id", "row", F.when(day == F.floor(day), day.cast("int")).alias("day"), "date", "check_time",
        wall_to_instant(F.col("date"), F.col("check_time"), zone).alias("ts"),
        fraction_cell(F.col("ceiling_cell")).alias("sheet_ceiling"), actual_cell(F.col("actual_cell")).alias("_a"),
    ).select("*", F.col("_a.value").alias("actual"), (~F.col("_a.valid")).alias("actual_malformed")).drop("_a")


def assemble(plans: DataFrame, rows: DataFrame) -> DataFrame:
    """Plans with their supplied checkpoints in sheet order."""
    supplied = rows.groupBy("workbook_id").agg(F.array_sort(F.collect_list(F.struct(
        "row", "day", "date", "ts", "check_time", "sheet_ceiling", "actual", "actual_malformed"))).alias("supplied"))
    return plans.join(supplied, "workbook_id", "left")
