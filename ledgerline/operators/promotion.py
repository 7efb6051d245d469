"""Promotion of imports as one unit: daily, model, session and link rows and the imports themselves in one commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.dates import month_key
from ledgerline.operators import mirrors
from ledgerline.operators.imports import insert_ignore
from ledgerline.operators.revisions import current_daily
from ledgerline.sources.sinks import without_private_columns
from ledgerline.sources.versioned import Change, Version, VersionedStore, changes_win, part_of

MONTH = "usage_month"
#: Partition columns and natural keys of the tables.
TABLES = {
    "imports": (["machine_id"], ["import_id"]),
    "daily": ([MONTH], ["import_id", "agent", "usage_date"]),
    "models": ([MONTH], ["import_id", "agent", "model", "usage_date"]),
    "sessions": (["machine_id"], ["import_id", "local_key_hash"]),
    "links": ([MONTH], ["observation_id"]),
}


@dataclass(frozen=True)
class Unit:
    """What a batch of imports brings. `links` are proposals: import_id, the row's key, the canonical observation with its machine, and the evidence."""

    daily: DataFrame
    models: DataFrame
    sessions: DataFrame
    links: DataFrame


def _partitioned(name: str, rows: DataFrame) -> DataFrame:
    rows = without_private_columns(rows)
    return rows.withColumn(MONTH, month_key(F.col("usage_date"))) if MONTH in TABLES[name][0] else rows


def start(store: VersionedStore, imports: DataFrame, daily: DataFrame, models: DataFrame, sessions: DataFrame, links: DataFrame) -> Version:
    """A first version of all tables from rows that are stored already; daily, model and session rows carry processed_at, links usage_date."""
    tables = {"imports": imports, "daily": daily, "models": models, "sessions": sessions, "links": links}
    return store.update(lambda base: [store.stage(n, _partitioned(n, rows), TABLES[n][0], base.tables[n].parts if n in base.tables else ()) for n, rows in tables.items()])


def promote_unit(store: VersionedStore, now: Column, unit: Unit, batch: tuple[str, int] | None = None) -> Version:
    """Promote every import in processing, in all tables at once.

    Rows of imports in another state are ignored; a row stored for its import is not stored again, and of equal
    keys in one unit the one with the least id or hash stays. Links are checked against the rows as the promotion leaves
    them: the row must be current, the canonical one of another machine, of the same agent and day, with equal counters and
    no tombstone. A link replaces that of its row. Until the commit nothing of it shows, and after a failure it can be run again.
    """
    def make(base: Version) -> list[Change]:
        imports = store.read("imports", base)
        pending = imports.filter(F.col("status") == "processing").select("import_id")

        def added(name: str, rows: DataFrame, order: list[str]) -> Change:
            by, keys = TABLES[name]
            own = _partitioned(name, rows.join(pending, "import_id", "left_semi").withColumn("processed_at", now))
            return store.append(name, own, by, lambda stored, new: insert_ignore(new, stored, keys, order), base)

        daily = added("daily", unit.daily, ["id"])
        models = added("models", unit.models, ["id"])
        sessions = added("sessions", unit.sessions, ["session_hash"])

        proposed = _partitioned("links", unit.links.join(pending, "import_id", "left_semi"))
        by, keys = TABLES["links"]
        months = [x[0] for x in proposed.select(part_of(by)).distinct().collect()]
        rows = store.read("daily", base, months).unionByName(store.staged(daily).join(proposed.select(MONTH).distinct(), MONTH, "left_semi")).drop(MONTH)
        valid = mirrors.validate_links(proposed, current_daily(rows), rows)
        dated = valid.join(rows.select(F.col("id").alias("observation_id"), "usage_date"), "observation_id")
        order = [F.col("canonical_observation_id"), F.xxhash64(*dated.columns)]
        links = store.merge("links", _partitioned("links", dated), by, changes_win(keys, order), base)

        waits = F.col("status") == "processing"
        done = imports.filter(waits).withColumns({"status": F.lit("processed"), "processed_at": now})
        imports_ = store.merge("imports", done, TABLES["imports"][0], changes_win(TABLES["imports"][1], [F.col("import_id")]), base)
        return [imports_, daily, models, sessions, links]

    return store.update(make, batch)
