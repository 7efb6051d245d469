"""Registered queries of the corpus operators, and SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import alignment, archives, conversations, decontaminate, language, line_dedup, near_dedup, ngram_join, packing, personal, quality, sharding, token_files
from ledgerline.session import ensure_checkpoint_dir, materialized


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialized(packing.pieces(_table(spark, sf_dir, "documents")), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judged(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language.trained(docs.filter(part != 1))
    return language.predicted(docs, model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = personal.personal_spans(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("known", lambda s: s["kind"] == personal.KINDS.index(kind))).cast("long").alias("n_" + kind)
    return told.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(personal.written(F.col("known")), 256).alias("base_sha256"), personal.written(F.col("spans")).alias("spans"))


def op6_segmented_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "archives")
    archives.write_archives(archives.to_records(_table(spark, sf_dir, "pages")), path)
    whole = archives.put_together(archives.read_archives(spark, path))
    told = archives.resolved(materialized(whole.select("record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "problem"), "records"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+):", 1)
    return told.select(F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.nullif(page("refers_to"), F.lit("")).cast("long").alias("refers_to"))


def op7_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), 8)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them go, and their numbers from 0, joined."""
    docs = _table(spark, sf_dir, "documents")
    gone = materialized(line_dedup.repeated_lines(docs).groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set("line")).alias("_gone")), "gone")
    lines = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return lines.join(gone, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("_gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    told = conversations.repair(conversations.damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select(F.col("conv_id").cast("string")).distinct()
    joined = every.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    n = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *n, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_best_fit_packing, op3_quality_rules, op4_language_id, op5_personal_data, op6_segmented_archives,
                                   op7_lpt_shards, op8_decontamination, op9_token_files, op10_line_dedup,
                                   op11_tokenizer_alignment, op12_ngram_join, op13_conversation_repair)}

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


def _fails(rule: quality.Rule) -> str:
    parts = [f"{rule.counted} * 100 {sign} {rule.base} * {bound}" for sign, bound in (("<", rule.least), (">", rule.most)) if bound is not None]
    return " OR ".join(parts)


QUALITY_SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS.format(text='t')} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
pos AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM win, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY r),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_intersect(list_distinct(words), [{', '.join("'" + x + "'" for x in quality.STOP_WORDS)}])) AS n_stop_kinds, {len(quality.STOP_WORDS)} AS n_stop_listed,
    length(t) - length(replace(t, '!', '')) AS n_exclamations,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (r)),
judged AS (SELECT *, n_words < {quality.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {quality.MOST_REPEATED} AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {' OR '.join(_fails(r) for r in quality.RULES)}) AS kept
FROM judged
"""

_LINKED = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= PERCENT * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
told AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id))
"""
NEAR_SQL = _LINKED.replace("PERCENT", "75") + "SELECT *, doc_id = component_id AS kept FROM told"
NGRAM_SQL = _LINKED.replace("PERCENT", "80") + "SELECT * FROM told"

ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111',
  4 * (instr('0123456789abcdef', substr(sha1(html), k::INT, 1)) - 1) + 1, 4) FOR k IN range(1, 41)], '') AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT
  + 4 * substr(bits, 5 * k + 3, 1)::INT + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT)::INT, 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

LEAKS_SQL = rf"""
WITH iw AS (SELECT item_id, {_WORDS.format(text='lower(text)')} AS words FROM benchmark),
ip AS (SELECT item_id, len(words) AS n, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(words) - 3)) AS i FROM iw WHERE len(words) >= 5)),
wt AS (SELECT s, greatest(1, {decontaminate.WEIGHT} // count(DISTINCT item_id)) AS w FROM ip GROUP BY s),
it AS (SELECT item_id, n, s, count(*) AS c, any_value(w) AS w FROM ip JOIN wt USING (s) GROUP BY item_id, n, s),
isum AS (SELECT item_id, n, sum(c * w) AS total FROM it GROUP BY item_id, n),
dw AS (SELECT doc_id, {_WORDS.format(text='lower(text)')} AS words FROM documents),
dp AS (SELECT doc_id, len(words) AS m, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(words) - 3)) AS i FROM dw WHERE len(words) >= 5)),
win AS (SELECT DISTINCT doc_id, m, n, greatest(0, least(dp.i - ip.i, m - n)) AS start FROM dp JOIN ip USING (s)),
ws AS (SELECT win.doc_id, win.n, win.start, dp.s, count(*) AS c, any_value(coalesce(w, {decontaminate.WEIGHT})) AS w FROM win JOIN dp ON dp.doc_id = win.doc_id AND dp.i > win.start AND dp.i <= win.start + least(win.n, win.m) - 4
  LEFT JOIN wt ON wt.s = dp.s GROUP BY win.doc_id, win.n, win.start, dp.s),
wsum AS (SELECT doc_id, n, start, sum(c * w) AS total FROM ws GROUP BY doc_id, n, start),
pair AS (SELECT ws.doc_id, it.item_id, ws.n, ws.start, sum(ws.w * least(ws.c, it.c)) AS common FROM ws JOIN it ON it.n = ws.n AND it.s = ws.s GROUP BY ws.doc_id, it.item_id, ws.n, ws.start),
good AS (SELECT doc_id, item_id, start, 100 * common // (wsum.total + isum.total - common) AS sim FROM pair JOIN wsum USING (doc_id, n, start) JOIN isum USING (item_id, n)
  WHERE 100 * common >= 75 * (wsum.total + isum.total - common))
SELECT doc_id, item_id, max(sim)::BIGINT AS similarity, arg_max(start, (sim, -start))::BIGINT AS start FROM good GROUP BY doc_id, item_id
"""

ORACLES = {"op1_near_dedup": NEAR_SQL, "op3_quality_rules": QUALITY_SQL, "op6_segmented_archives": ARCHIVE_SQL, "op8_decontamination": LEAKS_SQL, "op12_ngram_join": NGRAM_SQL}
