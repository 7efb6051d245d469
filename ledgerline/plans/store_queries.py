"""Queries over committed tables: each writes a versioned store in the shared checkpoint folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.fingerprints import COUNTERS
from ledgerline.operators import promotion, revisions
from ledgerline.plans import views as v
from ledgerline.plans.registry import day, query
from ledgerline.session import ensure_checkpoint_dir, prepare
from ledgerline.sources import sinks
from ledgerline.sources.versioned import VersionedStore
from ledgerline.streaming import collect, current, ingest

DELIVERED_AT = "timestamp_seconds(1704067200 + doc_id * 60)"


def new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(prepare(spark))}/{name}-{uuid.uuid4().hex}"


# Incremental current truth

@query("j01_current_stream", ("current_daily",), f"SELECT machine_id, agent, {day('usage_date')}, id, reported_total_tokens FROM current_daily")
def current_stream(spark, d):
    """All processed revisions in three deliveries: tombstones, then the later half, then the older ones as a backlog."""
    rows = revisions.accepted_revisions(v.observations(spark, d).drop("model"), v.imports(spark, d)).select(
        "id", "machine_id", "agent", "usage_date", "reported_total_tokens", "is_tombstone", "created_at", "processed_at")
    later = F.col("created_at") >= "1995-01-01"
    folder = new_folder(spark, "current")
    store = VersionedStore(spark, f"{folder}/store")
    for wave in (F.col("is_tombstone"), ~F.col("is_tombstone") & later, ~F.col("is_tombstone") & ~later):
        rows.filter(wave).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        current.maintain_current(stream, store, f"{folder}/checkpoint").awaitTermination()
    return current.current_rows(store).select("machine_id", "agent", "usage_date", "id", "reported_total_tokens")


@query("j02_appended_revisions", ("observations",), f"SELECT DISTINCT import_id, machine_id, agent, {day('usage_date')} FROM observations")
def appended_revisions(spark, d):
    """The revisions as a stream that is delivered twice, under two checkpoints."""
    rows = v.observations(spark, d).select("id", "import_id", "machine_id", "agent", "usage_date")
    folder = new_folder(spark, "revisions")
    rows.write.parquet(f"{folder}/in")
    for name in ("one", "two"):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        ingest.append_revisions(stream, f"{folder}/table", f"{folder}/{name}", ["import_id", "machine_id", "agent", "usage_date"]).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("import_id", "machine_id", "agent", "usage_date")


# Sinks

@query("a11_a13_appended_facts", ("daily", "incoming_daily"), f"""
  SELECT machine_id, agent, {day('usage_date')}, coalesce(d.usage_hash, i.usage_hash) AS usage_hash, FALSE AS private_stored
  FROM daily d FULL JOIN incoming_daily i USING (machine_id, agent, usage_date)""")
def appended_facts(spark, d):
    """Stored rows win over later ones of their key; the private column of either isn't stored."""
    path = new_folder(spark, "facts")
    for rows in (v.daily(spark, d), v.incoming_daily(spark, d)):
        sinks.append_facts(rows.select(*revisions.DAILY_KEYS, "usage_hash", F.lit("/secret").alias("project_path")), path, revisions.DAILY_KEYS)
    stored = spark.read.parquet(path)
    return stored.select(*revisions.DAILY_KEYS, "usage_hash").withColumn("private_stored", F.lit("project_path" in stored.columns))


@query("a12_committed_upsert", ("daily", "incoming_daily"), f"""
  SELECT machine_id, agent, {day('usage_date')}, coalesce(i.usage_hash, d.usage_hash) AS usage_hash, i.usage_hash IS NOT NULL AS changed
  FROM daily d FULL JOIN incoming_daily i USING (machine_id, agent, usage_date)""")
def committed_upsert(spark, d):
    keep = [*revisions.DAILY_KEYS, "usage_hash"]
    store = VersionedStore(spark, new_folder(spark, "upsert"))
    for rows, changed in ((v.daily(spark, d), False), (v.incoming_daily(spark, d), True)):
        sinks.upsert(store, "daily", rows.select(*keep, F.lit(changed).alias("changed")), revisions.DAILY_KEYS, ["machine_id"])
    return store.read("daily")


# Promotion as one unit, over the documents: one import each, with a daily row, a model row and a session

_UNIT_SQL = """
WITH obs AS (SELECT doc_id::VARCHAR AS id, doc_id AS import_id, source AS machine_id, lang AS agent, DATE '2024-01-01' + (length(text) % 28)::INTEGER AS usage_date,
    'model-' || (doc_id % 3) AS model, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE length(text) % 3 END AS c, doc_id % 13 = 0 AS is_tombstone,
    make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at, doc_id % 9 = 0 AS pending, doc_id % 18 = 0 AS stored, doc_id
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
after AS (SELECT *, CASE WHEN pending AND NOT stored THEN TIMESTAMP '2030-01-01' ELSE created_at END AS processed_at FROM obs),
cur AS (SELECT * FROM after QUALIFY row_number() OVER (PARTITION BY machine_id, agent, usage_date ORDER BY processed_at DESC, created_at DESC, id DESC) = 1),
target AS (SELECT agent, usage_date, min(id) AS cid, min_by(machine_id, id) AS cm FROM obs WHERE NOT pending GROUP BY ALL),
proposed AS (SELECT o.machine_id, CASE WHEN k = 6 THEN agent || 'x' ELSE agent END AS agent, usage_date,
    CASE WHEN k = 4 THEN 'none' WHEN k = 5 THEN o.id ELSE t.cid END AS cid, CASE WHEN k = 3 THEN 'nowhere' WHEN k = 5 THEN o.machine_id ELSE t.cm END AS cm
    FROM (SELECT *, (doc_id // 9) % 7 AS k FROM obs WHERE pending) o JOIN target t USING (agent, usage_date)),
valid AS (SELECT d.id AS observation_id, min(p.cid) AS canonical FROM proposed p JOIN cur d USING (machine_id, agent, usage_date)
    JOIN after c ON c.id = p.cid AND c.machine_id = p.cm AND c.agent = d.agent AND c.usage_date = d.usage_date AND c.c = d.c AND NOT c.is_tombstone AND c.machine_id <> d.machine_id
    WHERE NOT d.is_tombstone GROUP BY 1),
old AS (SELECT id AS observation_id, 'old' AS canonical FROM obs WHERE doc_id % 10 = 1 OR stored)
"""


def _document_unit(spark, d):
    """(stored tables, unit): the documents' rows, of which each ninth import is in processing; half of these rows are stored already."""
    docs = v.table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    n = F.length("text")
    tomb = F.col("doc_id") % 13 == 0
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("machine_id"), F.col("doc_id").alias("import_id"), F.col("lang").alias("agent"),
        F.concat(F.lit("model-"), F.col("doc_id") % 3).alias("model"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int")).alias("usage_date"),
        F.when(tomb, 0).otherwise(n % 3).cast("bigint").alias(COUNTERS[0]), *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS[1:]],
        F.when(tomb, 0).otherwise(n % 3).cast("bigint").alias("reported_total_tokens"), tomb.alias("is_tombstone"), F.expr(DELIVERED_AT).alias("created_at"))
    pending, stored = F.col("import_id") % 9 == 0, (F.col("import_id") % 9 != 0) | (F.col("import_id") % 18 == 0)
    files = rows.select("import_id", "machine_id", "created_at", F.when(pending, "processing").otherwise("processed").alias("status"),
                        F.when(~pending, F.col("created_at")).alias("processed_at"))
    sessions = v.sessions(spark, d).filter("machine_id IS NOT NULL AND agent IS NOT NULL AND session_id IS NOT NULL").select(
        "import_id", "machine_id", "agent", "created_at", "local_key_hash", "session_hash").withColumn("project_path", F.lit("/secret"))
    daily = rows.drop("model")
    target = daily.filter(~pending).groupBy("agent", "usage_date").agg(F.min(F.struct("id", "machine_id")).alias("t"))
    kind = F.expr("import_id div 9") % 7
    proposed = daily.filter(pending).join(target, ["agent", "usage_date"]).select(
        "import_id", "machine_id", F.when(kind == 6, F.concat("agent", F.lit("x"))).otherwise(F.col("agent")).alias("agent"), "usage_date",
        F.when(kind == 4, "none").when(kind == 5, F.col("id")).otherwise(F.col("t.id")).alias("canonical_observation_id"),
        F.when(kind == 3, "nowhere").when(kind == 5, F.col("machine_id")).otherwise(F.col("t.machine_id")).alias("canonical_machine_id"),
        F.lit("exact_raw_snapshot").alias("reason"), F.lit(0).cast("bigint").alias("matched_session_count"), F.lit(1.0).alias("session_overlap_ratio"))
    old = daily.filter((F.col("import_id") % 10 == 1) | (F.col("import_id") % 18 == 0)).select(
        F.col("id").alias("observation_id"), F.lit("old").alias("canonical_observation_id"), F.lit("m").alias("canonical_machine_id"), F.lit("exact_raw_snapshot").alias("reason"),
        F.lit(0).cast("bigint").alias("matched_session_count"), F.lit(1.0).alias("session_overlap_ratio"), "usage_date")
    kept = lambda some: some.filter(stored).withColumn("processed_at", F.col("created_at"))
    return (files, kept(daily), kept(rows), kept(sessions), old), promotion.Unit(daily, rows, sessions, proposed)


@query("c07_c09_promotion_unit", ("sessions",), _UNIT_SQL + """
  SELECT 'imports' AS part, import_id::VARCHAR AS key, 'processed' AS held, CASE WHEN pending THEN '2030-01-01 00:00:00' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS processed_at FROM obs
  UNION ALL SELECT 'daily', id, c::VARCHAR, strftime(processed_at, '%Y-%m-%d %H:%M:%S') FROM after
  UNION ALL SELECT 'models', id, model, strftime(processed_at, '%Y-%m-%d %H:%M:%S') FROM after
  UNION ALL SELECT 'sessions', a.id, s.session_hash, strftime(a.processed_at, '%Y-%m-%d %H:%M:%S') FROM after a JOIN (
    SELECT import_id, sha256(concat_ws('|', 'session-observation-v1', local_key_hash, mirror_hash, 'null')) AS session_hash FROM sessions) s USING (import_id)
  UNION ALL SELECT 'links', observation_id, coalesce(v.canonical, o.canonical), NULL FROM old o FULL JOIN valid v USING (observation_id)""")
def promotion_unit(spark, d):
    """The content of all tables after one promotion; the proposed links include each kind that is refused."""
    stored, unit = _document_unit(spark, d)
    store = VersionedStore(spark, new_folder(spark, "promotion"))
    promotion.start(store, *stored)
    after = promotion.promote_unit(store, F.lit("2030-01-01").cast("timestamp"), unit)
    row = lambda name, key, held, at=F.col("processed_at"): store.read(name, after).select(
        F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), F.col(held).cast("string").alias("held"), at.alias("processed_at"))
    parts = [row("imports", "import_id", "status"), row("daily", "id", "reported_total_tokens"), row("models", "id", "model"), row("sessions", "import_id", "session_hash"),
             row("links", "observation_id", "canonical_observation_id", F.lit(None).cast("timestamp"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# File collection

_LARGEST = 1 << 20
_EXPORTED = r"machine=([^/]+)/import=([^/]+)/[^/]+$"


def _written(rows: DataFrame, path: str) -> None:
    """One file per row: machine and import are its folder, content its bytes."""
    rows.select(F.col("machine_id").alias("machine"), F.col("import_id").alias("import"), F.col("content").cast("string").alias("value")).write.mode("append").partitionBy(
        "machine", "import").text(path)


@query("a01_a05_j06_collected_files", ("export_files",), """
  SELECT machine_id, week::VARCHAR AS import_id, CASE WHEN day(week) = 1 AND machine_id = 'm5' THEN 'file too large' WHEN day(week) = 8 AND machine_id = 'm6' THEN 'not valid UTF-8'
    ELSE 'collected' END AS verdict FROM export_files
  UNION ALL SELECT machine_id, 'again-' || week::VARCHAR, 'not valid UTF-8' FROM export_files WHERE day(week) = 8 AND machine_id = 'm6'
  UNION ALL SELECT machine_id, 'again-' || week::VARCHAR, 'file too large' FROM export_files WHERE day(week) = 1 AND machine_id = 'm5'""")
def collected_files(spark, d):
    """All exports as files, in three deliveries: the even weeks, all others, and everything again under other names, as copies that aren't kept.

    Some are larger than the bound, some aren't UTF-8. Each run takes only what is new to it, five files a batch.
    """
    week = F.substring_index("file_id", "/", -1)
    broken, large = (F.col("machine_id") == "m6") & (F.dayofmonth(week.cast("date")) == 8), (F.col("machine_id") == "m5") & (F.dayofmonth(week.cast("date")) == 1)
    rows = v.exports(spark, d).select("machine_id", week.alias("import_id"), F.when(broken, F.concat(F.col("payload").cast("binary"), F.lit(b"\xff\xfe"))).when(
        large, F.rpad("payload", F.greatest(F.length("payload"), F.lit(_LARGEST)) + 1, " ").cast("binary")).otherwise(F.col("payload").cast("binary")).alias("content"))
    folder = new_folder(spark, "files")
    store = VersionedStore(spark, f"{folder}/store")
    even = F.weekofyear(F.col("import_id").cast("date")) % 2 == 0
    for wave in (rows.filter(even), rows.filter(~even), rows.withColumn("import_id", F.concat(F.lit("again-"), "import_id"))):
        _written(wave, f"{folder}/in")
        collect.collect_files(spark, f"{folder}/in", store, f"{folder}/checkpoint", _LARGEST, 5, _EXPORTED, "*.txt").awaitTermination()
    told = lambda name, verdict: store.read(name).select("machine_id", "import_id", verdict.alias("verdict"))
    return told("files", F.lit("collected")).unionByName(told("refused", F.col("reason")))
