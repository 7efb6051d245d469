"""Registered corpus queries and the pipeline against plain Python on the smallest tables."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import decontaminate, quality, queries
from ledgerline.llm.tokens import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
EXTRA = [(10_001, None, None, "s", None), (10_002, "", "en", None, 0), (10_003, "12 34 !?", "fr", "s", 8), (10_004, "x <|endoftext|> y", "en", "s", 16),
         (10_005, "mail a.b@c.de or 10.0.0.1, 999.1.1.1, +1 (269) 555-3296; 4111 1111 1111 1111 and 4111 1111 1111 1112 ünï", "en", "s", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given documents with some odd ones behind them, and the benchmark."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.unionByName(spark.createDataFrame(EXTRA, docs.schema)).coalesce(2).write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_query(spark, folder, texts, library):
    rows = queries.op2_best_fit_packing(spark, folder).collect()
    own, places = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(own) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = ids_of(library, text, 1)
        total += len(ids)
        want = [(k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[doc]) == want
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-total // 4096) * 1.02 + 1


def test_language_query(spark, folder, texts, tmp_path):
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, folder).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    learned = {langs[k] for k in texts if zlib.crc32(str(k).encode()) % 3 != 1 and langs[k] and texts[k] is not None}
    right = []
    assert set(rows) == set(texts)
    for doc, r in rows.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (texts[doc] is None or not any(map(str.isalpha, texts[doc]))) and r.lang_pred in learned | {"und"}
        if r.held_out and langs[doc] and r.lang_pred != "und":
            right.append(r.lang_pred == langs[doc])
    assert sum(right) >= 0.95 * len(right) > 30
    # What held-out rows say of their language, and any row's source and n_chars, change nothing.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    docs.withColumn("lang", F.when(part == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q")).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r for r in queries.op4_language_id(spark, str(tmp_path)).collect()} == rows


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))
    return [(kind, m.start(), m.end()) for kind, pattern, fits in kinds for m in re.finditer(pattern, text) if fits(m)]


def test_personal_data_query(spark, folder, texts):
    rows = {r.doc_id: r for r in queries.op5_personal_data(spark, folder).collect()}
    found = 0
    for doc, text in texts.items():
        spans = base_spans(text or "")
        r = rows[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], doc
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}
        found += len(spans)
    assert found > 5 and len(rows) == len(texts)


def test_sharding_query(spark, folder, texts):
    rows = queries.op7_lpt_shards(spark, folder).collect()
    loads, slots, shard_of = [0] * 8, {}, {}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(loads) - min(loads) <= max(r["size"] for r in rows)


def sets_of_words(line):
    return frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), line)) if x)


def shingles(text):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if x]
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_the_pipeline_equals_brute_force_stage_by_stage(spark, folder, texts, library):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    kept = {d for d, good in con.execute(f"SELECT doc_id, kept FROM ({queries.QUALITY_SQL})").fetchall() if good}
    held = {d: texts[d] for d in sorted(kept)}

    seen, cut = [], {}
    for doc, text in held.items():
        lines = []
        for line in text.split("\n"):
            words = sets_of_words(line)
            if words and any(100 * len(words & x) >= 75 * len(words | x) for x in seen):
                seen.append(words)
                continue
            if words:
                seen.append(words)
            lines.append(line)
        if sets_of_words("\n".join(lines)):
            cut[doc] = "\n".join(lines)

    sets, first = {d: shingles(t) for d, t in cut.items()}, {d: d for d in cut}
    for a in cut:
        for b in cut:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((first[a], first[b]))
                first = {d: x if f == y else f for d, f in first.items()}
    single = {d: t for d, t in cut.items() if first[d] == d}

    rows = spark.createDataFrame(list(single.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in decontaminate.leaks(rows, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    want = {}
    for doc, text in single.items():
        if doc not in leaked:
            ids = ids_of(library, text, 1)
            want[doc] = [(k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {d: sorted(x) for d, x in got.items()} == want
    assert 0 < len(want) < len(kept) < len(texts) and quality.RULES
