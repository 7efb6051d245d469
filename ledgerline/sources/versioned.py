"""Tables that change together: data files first, then one commit that readers see whole or not at all.

A store is a folder with `data`, to which every change adds new folders, and `commits`, one small
file per version. A commit names the folders that make up each partition of each table, and the
last batch of each stream. It is written beside and renamed to its number, which must be free:
of two writers one succeeds, and a writer that fails before leaves the version before in place.
The lists it holds grow with the partitions, not with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ledgerline.session import materialized

PART = "ledger_part"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was based on."""


@dataclass(frozen=True)
class TableState:
    schema: dict
    parts: dict[str, list[str]]


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, TableState] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Change:
    """Written data of one table that no version holds yet. Parts in `replaced` lose what they held before."""

    table: str
    schema: dict
    parts: dict[str, str]
    replaced: frozenset[str]


def part_of(by: Iterable[str]) -> Column:
    """The partition a row belongs to, as text; rows with a null are in a partition of their own."""
    values = [F.coalesce(F.concat(F.lit("."), F.col(c).cast("string")), F.lit("null")) for c in by]
    return F.concat_ws("/", *values) if values else F.lit("all")


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Files, by the file system that the path belongs to

    def _hadoop(self, path: str):
        jvm = self.spark._jvm.org.apache.hadoop
        where = jvm.fs.Path(f"{self.path}/{path}")
        return jvm, where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        _, where, files = self._hadoop(path)
        return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []

    # Versions

    def versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names("commits") if x.endswith(".json")]

    def current(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number; an empty one before the first commit."""
        known = self.versions()
        if number is None and not known:
            return Version()
        number = known[-1] if number is None else number
        told = json.loads(self.spark.read.text(f"{self.path}/commits/{number:012d}.json", wholetext=True).first()[0])
        return Version(number, {k: TableState(**t) for k, t in told["tables"].items()}, told["batches"])

    def read(self, table: str, version: Version | None = None, parts: Iterable[str] | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a table, or of some of its partitions; no other folder is listed or read. `schema` is that of a table without a commit."""
        state = (version or self.current()).tables.get(table)
        if state is None:
            if schema is None:
                raise KeyError(table)
            return self.spark.createDataFrame([], schema)
        wanted = None if parts is None else set(parts)
        folders = [f"{self.path}/data/{x}" for key, held in sorted(state.parts.items()) if wanted is None or key in wanted for x in held]
        schema = StructType.fromJson(state.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # Changes

    def stage(self, table: str, rows: DataFrame, by: Iterable[str] = (), replaced: Iterable[str] = ()) -> Change:
        """Write rows to a new folder. A partition that holds most rows is split over several files."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.withColumn(PART, part_of(by)).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/data/{folder}")
        names = [x for x in self._names(f"data/{folder}") if x.startswith(PART + "=")]
        return Change(table, json.loads(rows.schema.json()), {unquote(x.removeprefix(PART + "=")): f"{folder}/{x}" for x in names}, frozenset(replaced))

    def merge(self, table: str, changes: DataFrame, by: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], base: Version) -> Change:
        """Rewrite the partitions that the changes touch: `combine` gets the rows they hold and the changes. The names of the touched
        partitions come to the driver, as they do into the commit."""
        changes = materialized(changes, "changes")
        touched = [x[0] for x in changes.select(part_of(by)).distinct().collect()]
        return self.stage(table, combine(self.read(table, base, touched, changes.schema), changes), by, touched)

    def append(self, table: str, rows: DataFrame, by: list[str], fresh: Callable[[DataFrame, DataFrame], DataFrame], base: Version) -> Change:
        """Add to the touched partitions the rows that `fresh` makes of what they hold and the given rows; nothing is rewritten."""
        rows = materialized(rows, "rows")
        touched = [x[0] for x in rows.select(part_of(by)).distinct().collect()]
        return self.stage(table, fresh(self.read(table, base, touched, rows.schema), rows), by)

    def staged(self, change: Change) -> DataFrame:
        """The rows of a change, which no version holds yet."""
        schema = StructType.fromJson(change.schema)
        folders = [f"{self.path}/data/{x}" for x in change.parts.values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, base: Version, changes: Iterable[Change], batch: tuple[str, int] | None = None) -> Version:
        """Make changes of any number of tables visible at once, as the version after `base`."""
        tables = dict(base.tables)
        for change in changes:
            held = tables.get(change.table, TableState(change.schema, {}))
            parts = {k: v for k, v in held.parts.items() if k not in change.replaced}
            for key, folder in change.parts.items():
                parts[key] = [*parts.get(key, []), folder]
            tables[change.table] = TableState(change.schema, parts)
        batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        new = Version(base.number + 1, tables, batches)
        self._publish(new)
        return new

    def _publish(self, new: Version) -> None:
        text = json.dumps({"tables": {k: {"schema": t.schema, "parts": t.parts} for k, t in new.tables.items()}, "batches": new.batches})
        jvm, target, files = self._hadoop(f"commits/{new.number:012d}.json")
        _, beside, _ = self._hadoop(f"commits/.{uuid.uuid4().hex}")
        out = files.create(beside)
        out.write(text.encode())
        out.close()
        try:
            none = self.spark._sc._gateway.new_array(jvm.fs.Options.Rename, 0)
            jvm.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
                files.makeQualified(beside), files.makeQualified(target), none)
        except Py4JJavaError as problem:
            files.delete(beside, False)
            if "FileAlreadyExists" not in str(problem.java_exception.getClass().getName()):
                raise
            raise Conflict(f"version {new.number} exists") from problem

    def update(self, make: Callable[[Version], list[Change]], batch: tuple[str, int] | None = None, attempts: int = 5) -> Version:
        """Make changes on the newest version and commit them, again on a newer one after a conflict. A batch its stream has committed adds nothing."""
        for left in reversed(range(attempts)):
            base = self.current()
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            try:
                return self.commit(base, make(base), batch)
            except Conflict:
                if not left:
                    raise
        return self.current()

    def vacuum(self, keep: int = 1) -> int:
        """Remove all versions but the last `keep`, and data that none of these holds; the number of folders removed.

        Call it while nobody writes: staged data isn't held by a version yet.
        """
        known = self.versions()
        _, _, files = self._hadoop("")
        for number in known[:-keep]:
            files.delete(self._hadoop(f"commits/{number:012d}.json")[1], False)
        held = {x for number in known[-keep:] for t in self.current(number).tables.values() for folders in t.parts.values() for x in folders}
        removed = 0
        for table in self._names("data"):
            for folder in self._names(f"data/{table}"):
                own = [f"{table}/{folder}/{x}" for x in self._names(f"data/{table}/{folder}") if x.startswith(PART + "=")]
                for x in own:
                    if x not in held:
                        files.delete(self._hadoop(f"data/{x}")[1], True)
                        removed += 1
                if not any(x in held for x in own):
                    files.delete(self._hadoop(f"data/{table}/{folder}")[1], True)
        return removed


def newest_per_key(keys: list[str], order: list[Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For `merge`: of all rows of a key, stored or new, the first in `order`."""
    def combine(stored: DataFrame, changes: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return stored.unionByName(changes).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return combine


def changes_win(keys: list[str], order: list[Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For `merge`: a change replaces the stored row of its key; of several changes of a key, the first in `order`."""
    def combine(stored: DataFrame, changes: DataFrame) -> DataFrame:
        both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *order))
        return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_new")
    return combine


def sums_per_key(keys: list[str], sums: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For `merge`: stored and new sums added up."""
    def combine(stored: DataFrame, changes: DataFrame) -> DataFrame:
        return stored.unionByName(changes).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return combine
