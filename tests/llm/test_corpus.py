"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import archives, decontaminate, graph, kernel, language, line_dedup, near_dedup, packing, personal, quality, queries, settle, sharding, token_files
from ledgerline.llm.tokens import encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component string, kept string"
WORDS = [f"w{k}" for k in range(3000)]


def texts():
    rng = random.Random(5)
    long = " ".join(rng.choices(WORDS, k=4000))
    base = [" ".join(rng.choices(WORDS, k=60)) for _ in range(12)]
    near = base[0].split()
    near[30] = "changed"
    return [None, "", "  \t\n", "one two", "One TWO", long, long, *base, base[1], base[1], " ".join(near), base[2] + "\n" + base[3], "a@b.c 10.0.0.1 +1 (269) 555-3296, 4111 1111 1111 1111 ünï çode"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, "x", "y", "z") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[8], (None, "no id here", None, None, None, None, None, None)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_sets():
    out = {}
    for k, t in enumerate(texts()):
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[a:a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def test_words_are_those_of_bytes_split():
    all_ = ["A b\x0bC", "", "é  \tx\x1cy\n", "z"]
    data, bounds = kernel.flat(pa.array([*all_, None]))
    starts, ends = kernel.word_spans(data, bounds)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [w for t in all_ for w in t.encode().split()]
    hashes = kernel.word_hashes(data, starts, ends)
    again, b2 = kernel.flat(pa.array(["xx c B a"]))
    other = kernel.word_hashes(again, *kernel.word_spans(again, b2))
    assert set(hashes[:3].tolist()) == set(other[1:].tolist())


def test_near_duplicates_equal_brute_force(docs, none):
    sets = shingle_sets()
    group = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got.pop(None)[1:] == (None, True)
    assert got == {k: (len(sets[k]), group[k], group[k] == k) for k in sets}
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    for per_task in (graph.EDGES, 9, 1):
        assert {r.node: r.component for r in graph.components(edges, per_task=per_task).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_an_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    salts = rng.integers(1, 2**63, 1000, dtype=np.uint64)
    a, b = rng.integers(0, 2**32, 1000, dtype=np.uint64), rng.integers(0, 2**32, 1000, dtype=np.uint64)
    b[:800] = a[:800]
    x, y = (np.frombuffer(near_dedup.folded(kernel.mixed(v + salts), 4096), np.uint64) for v in (a, b))
    assert abs(near_dedup.estimate(near_dedup._unlike(x, y), 4096, 1000) - 0.8) < 0.05


def test_packing_keeps_every_limit(spark, docs, none):
    made = packing.pieces(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    placed = packing.pack(made).collect()
    held = {}
    for r in placed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in placed) == sum(len(encoder(tokenizer_path()).ids(t)) // 4 + 1 for t in texts())
    assert packing.pack(packing.pieces(none)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_under_binding_limits(rule):
    lengths = np.sort(np.random.default_rng(2).integers(1, 60, 300))[::-1]
    limits = packing.Limits(100, 4, 4000, (1.0, 0.3, 0.3), rule)
    bins, offsets = packing.best_fit(lengths, limits)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 4000
        assert sorted(offsets[bins == b].tolist()) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1].tolist()]


def test_quality_counts(spark):
    rows = spark.createDataFrame([(1, "a b c a b c d\nx\nx\n\n#!", 0), (2, None, 0), (3, "", 0), (4, "the of " + " ".join(f"word{k}" for k in range(60)), 0)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality.judged(rows).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (10, 11, 1, 1, 6)
    assert got[2].base_failed and got[3].base_failed and not got[2].kept
    assert got[4].kept and not got[4].base_failed


def test_language_on_held_out_rows(spark, none):
    rng = random.Random(3)
    make = lambda signs: " ".join("".join(rng.choices(signs, k=5)) for _ in range(30))
    rows = [(k, make("abcde" if k % 2 else "fghij"), "x" if k % 2 else "y") for k in range(120)]
    data = spark.createDataFrame([*rows, (900, None, "x"), (901, "12 !", "y"), (902, "text", None)], "doc_id long, text string, lang string")
    model = language.trained(data.filter("doc_id < 80 OR doc_id >= 900"))
    got = {r.doc_id: r for r in language.predicted(data, model).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert language.predicted(data, language.trained(none)).filter("lang_pred <> 'und'").count() == 0


def test_personal_data(docs, none):
    told = personal.personal_spans(docs).withColumn("base", personal.written(F.col("known")))
    got = {r.doc_id: r for r in told.collect()}
    text = texts()[-1]
    want = [f"{k}:{text.index(x)}:{text.index(x) + len(x)}" for k, x in (("email", "a@b.c"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (269) 555-3296"))]
    base = got[len(texts()) - 1].base.split(",")
    assert base == want
    assert got[0].base == "" and personal.personal_spans(none).count() == 0
    assert told.count() == docs.count()


def test_redaction(spark):
    row = spark.range(1).select(personal.redacted(F.lit("mail a@b.c now"), F.expr("array(named_struct('kind', 0, 'start', 5, 'stop', 10))")).alias("x")).first()
    assert row.x == "mail [email] now"


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 5000
    pages = spark.createDataFrame([(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nx"), (None, "u", "x"), (5, "u", "other")], "page_id long, url string, html string")
    archives.write_archives(archives.to_records(pages, segment_bytes=700, chunk_bytes=300), str(tmp_path / "w"))
    read = archives.read_archives(spark, str(tmp_path / "w"))
    assert read.filter("record_type = 'continuation'").count() > 10
    whole = archives.put_together(read)
    assert whole.filter("problem IS NOT NULL").count() == 0 and whole.count() == 7
    assert sorted(bytes(r.payload).decode() for r in whole.filter("record_type = 'response'").collect()) == sorted([big, "", "WARC/1.1\r\n\r\n\r\nx", "x", "other"])
    told = archives.resolved(whole)
    assert sorted(r.payload_bytes for r in told.collect()) == sorted([10000, 10000, 0, 0, 15, 1, 5])
    broken = archives.put_together(read.filter("segment IS NULL OR segment <> 2"))
    assert {r.problem for r in broken.filter("problem IS NOT NULL").collect()} == {"segments"}


def test_shards_are_near_equal(docs, none):
    got = sharding.assign(docs, 4).collect()
    assert len(got) == docs.count()
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert len({r.shard for r in got if r.doc_id in (8, 19, 20)}) == 1
    assert sharding.assign(none, 4).count() == 0


def test_schedule_equals_the_heap_one_by_one():
    rng = random.Random(4)
    classes = [(size, rng.randint(1, 200), 0) for size in range(1, 60)]
    classes = [(s, n, s * n) for s, n, _ in classes]
    loads = [0.0] * 5
    for s, n, _ in sorted(classes, reverse=True):
        for _ in range(n):
            loads[loads.index(min(loads))] += s
    mine = [0.0] * 5
    for s, parts in sharding.schedule(classes, 5).items():
        for shard, n in parts:
            mine[shard] += s * n
    assert sorted(mine) == sorted(loads)


def test_leaks_equal_brute_force(spark, docs, none):
    item = texts()[9].split()[5:35]
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, "not anywhere in there at all today"), (3, "too short"), (None, "x"), (4, None)], "item_id long, text string")
    got = sorted(decontaminate.leaks(docs, bench).collect())
    assert [(r.doc_id, r.item_id, r.similarity, r.start) for r in got] == [(9, 1, 100, 5), (22, 1, 100, 5)]
    assert decontaminate.clean(docs, bench).count() == docs.count() - 2
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_hamming_blocks_miss_nothing_within_the_radius(spark):
    rng = random.Random(6)
    a = rng.getrandbits(63)
    near = [a ^ sum(1 << b for b in rng.sample(range(63), 20)) for _ in range(50)]
    items = decontaminate.blocks_of(spark.createDataFrame([(1, a)], "key long, print long"), 2).select(F.col("block").alias("b"), F.col("value").alias("v"))
    rows = decontaminate.blocks_of(spark.createDataFrame(list(enumerate(near)), "key long, print long"), 0)
    assert rows.join(items, (F.col("block") == F.col("b")) & (F.col("value") == F.col("v"))).select("key").distinct().count() == 50


def test_token_files_round_trip(spark, docs, none, tmp_path):
    real = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    token_files.write_token_files(real, str(tmp_path / "t"), step=16, block_tokens=500)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect())
    at, want = 0, []
    for k, t in enumerate(texts()):
        ids = np.array([*encoder(tokenizer_path()).library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((k, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert got == want
    with pytest.raises(ValueError):
        token_files.frames(b"LTK1 broken")


def test_code_lengths_are_complete_and_bounded():
    counts = np.array([0, *(2**k for k in range(40)), 1, 1])
    lengths = token_files.code_lengths(counts, 12)
    assert lengths[0] == 0 and lengths.max() <= 12 and sum(2.0**-float(x) for x in lengths if x) == 1
    docs = [np.array([1, 2, 40, 41] * 50, np.uint32), np.zeros(0, np.uint32), np.array([5], np.uint32)]
    codes, _ = token_files.canonical(lengths)
    body = token_files.block([(None, len(d), b) for d, b in zip(docs, token_files.encoded(docs, lengths, codes, 7))])
    _, ids, _ = token_files.decoded(body, *token_files.decoding_table(lengths), 7)
    assert ids.tolist() == np.concatenate(docs).tolist()


def test_repeated_lines_equal_brute_force(spark, none):
    rng = random.Random(8)
    rows, lines = [], []
    pool = [rng.sample(WORDS[:120], 12) for _ in range(15)]
    for doc in range(40):
        own = []
        for _ in range(4):
            words = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(12)] = rng.choice(WORDS)
            own.append(" ".join(words))
        rows.append((doc, "\n".join([*own, "short line", ""])))
    seen, want = [], set()
    for doc, text in rows:
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.split())
            if words:
                if any(100 * len(words & x) >= 75 * len(words | x) for x in seen):
                    want.add((doc, k))
                seen.append(words)
    data = spark.createDataFrame([*rows, (None, rows[0][1]), (99, None), (98, "")], "doc_id long, text string")
    for settings in (line_dedup.Settings(), line_dedup.Settings(common=2, heavy=10)):
        assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(data, settings).collect()} == want
    assert line_dedup.without_repeated(data).count() == data.count()
    assert line_dedup.repeated_lines(none).count() == 0


def test_encoder_equals_the_library():
    e = encoder(tokenizer_path())
    for t in ["Don't STOP's 12ab", "ÄÖ ß µ ª²", "a\x0bb \x1c c", "日本 text", "x" * 300, "<|endoftext|> y", "café́"]:
        assert e.ids(t) == np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_keys_of_many_lines_equal_brute_force(spark):
    """Variants of one line share their keys: lists longer than `SHORT`, alone and in pairs of common tokens."""
    draw = random.Random(5)
    common = [f"w{k}" for k in range(24)]
    lines = [" ".join([w for w in common if draw.random() < 0.85] + [f"v{draw.randrange(40)}" for _ in range(draw.randrange(4))]) for _ in range(3 * line_dedup.SHORT)]
    sets = [frozenset(line.split()) for line in lines]
    want = {(k, 0) for k, own in enumerate(sets) if any(100 * len(own & x) >= 75 * len(own | x) for x in sets[:k])}
    data = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for settings in (line_dedup.Settings(common=255), line_dedup.Settings(common=2)):
        assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(data, settings).collect()} == want


def test_second_round_deals_out_long_keys(spark, monkeypatch):
    """Keys cut into many parts give the verdicts of brute force; repeated rows of a doc_id don't match themselves."""
    draw = random.Random(9)
    common = [f"w{k}" for k in range(24)]
    lines = [" ".join([w for w in common if draw.random() < 0.85] + [f"v{draw.randrange(40)}" for _ in range(draw.randrange(4))]) for _ in range(120)]
    data = spark.createDataFrame([(k, text) for k, text in enumerate(lines)] + [(0, lines[0])], "doc_id long, text string")
    sets = [set(x.split()) for x in lines]
    want = {k for k in range(len(lines)) if any(4 * len(sets[k] & sets[j]) >= 3 * len(sets[k] | sets[j]) for j in range(k))}
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    for s in (line_dedup.Settings(common=255), line_dedup.Settings(common=2)):
        index = line_dedup.materialized(line_dedup.indexed(data, line_dedup.rarity(line_dedup.scanned(data, s)), {}, s))
        left = index.select("doc_id", "line").distinct()
        assert {r.doc_id for r in line_dedup.matched_in_place(data, index, left, s).collect()} == want


def test_packed_entries_come_back(spark):
    """Places, sizes and doc_ids of any width, ascending or not; parity bitmaps at the width of their line's size."""
    draw = np.random.default_rng(4)
    for top in (9, 300, 70_000, 1 << 40):
        size, many = draw.integers(6, min(top, 100), 50), draw.integers(1, 4, 50)
        doc, line = draw.integers(-top, top, 50), draw.integers(0, min(top, 1 << 31), 50)
        even, odd = draw.integers(0, 1 << 63, (2, 50)).astype(np.uint64)
        odd[size <= line_dedup.MIDDLE] = 0
        even[size <= line_dedup.NARROW] &= np.uint64(0xFFFFFFFF)
        key, place = draw.integers(0, 1 << 32, many.sum()).astype(np.uint64), draw.integers(0, min(top, 1 << 31), many.sum())
        got = line_dedup._entries(pa.py_buffer(line_dedup._packed(key, place, many, doc, line, size, even, odd)))
        want = [key, *(np.repeat(x, many) for x in (doc, line, size)), place, np.repeat(even, many), np.repeat(odd, many)]
        assert all((x.astype(np.uint64) == y.astype(np.uint64)).all() for x, y in zip(got, want))


def test_rarity_goes_on_beyond_common_tokens(spark):
    """Tokens of 300 and of 6000 occurrences are told apart, so that the pairs a line is indexed by are of its rarest ones; it takes few bytes an entry."""
    rows = [(k, " ".join(["always", "often" if k % 2 else "mostly", *(f"{x}{k % 20}" for x in "abcdefgh")])) for k in range(6000)]
    data, s = spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.Settings()
    scan = line_dedup.materialized(line_dedup.scanned(data, s))
    table = np.frombuffer(line_dedup.rarity(scan), np.uint8)
    told = [int(table[line_dedup.cell(line_dedup.lines_of(pa.array([w]), 1).token)][0]) for w in ("a1", "often", "always", "never")]
    assert told[3] == 0 < told[0] < told[1] < told[2]
    index = line_dedup.packed_index(data, table.tobytes(), {}, s)
    n, size = index.agg(F.sum("n"), F.sum(F.length("entries"))).first()
    assert n > 6000 and size < 14 * n


def test_index_takes_no_more_entries_where_tokens_are_less_rare(spark):
    """Tokens of 60 and of 600 occurrences are indexed alone: a line of 10 words has 3 entries at most in either table, so the index grows as its lines do."""
    s = line_dedup.Settings()
    for n in (600, 6000):
        rows = [(k, " ".join([f"{x}{k % 10}" for x in "abcdefgh"] + ["always", "ever"])) for k in range(n)]
        data = spark.createDataFrame(rows, "doc_id long, text string")
        index = line_dedup.packed_index(data, line_dedup.rarity(line_dedup.materialized(line_dedup.scanned(data, s))), {}, s)
        assert 0 < index.agg(F.sum("n")).first()[0] <= 3 * n


def test_second_round_meets_small_groups_as_it_meets_large_ones(monkeypatch):
    """Groups at once, streamed, and cut anywhere into batches give the likeliest pairs that comparing all gives."""
    draw, s = random.Random(3), line_dedup.Settings()
    pool = [f"w{k}" for k in range(14)]
    rows, want = [], {}
    for key in range(30):
        n_mine, n_others = draw.randint(0, 4), draw.randint(0, 9)
        texts = [" ".join(draw.sample(pool, draw.randint(11, 14))) for _ in range(n_mine + n_others)]
        lines = line_dedup.lines_of(pa.array(texts), 1)
        own = list(zip([key] * len(texts), [key % 3] * len(texts), draw.sample(range(99), len(texts)), [0] * len(texts), lines.size.tolist(), [0] * len(texts), [0] * len(texts),
                       [k < n_mine for k in range(len(texts))], line_dedup._sketched(lines) if texts else []))
        rows += own
        for a in own[:n_mine]:
            near = []
            for b in own[n_mine:]:
                far = int(line_dedup._sketches_apart(pa.array([a[8]], pa.binary()), pa.array([b[8]], pa.binary()))[0])
                if b[2] < a[2] and far <= line_dedup._most_apart(np.array(a[4]), np.array(b[4]), s.percent):
                    near.append(far / (a[4] + b[4]))
            if near:
                want[key, a[2]] = (min(near), len(near) > 1)
    assert len(want) > 20 and {x for _, x in want.values()} == {True, False}
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list("abcdefghi"))
    at = {(r[0], r[2]): r for r in rows}
    keys_of = {}
    for r in rows:
        keys_of.setdefault(r[2], []).append(r[0])
    for group in (1 << 12, 6, 0):
        monkeypatch.setattr(line_dedup, "GROUP", group)
        for step in (len(rows), 5, 1):
            got = [x for out in line_dedup._likeliest((batch.slice(k, step) for k in range(0, len(rows), step)), s) for x in out.to_pylist()]
            assert len(got) == len(want)
            told = sorted((x["doc_id"], x["more"]) for x in got)
            assert told == sorted((doc, more) for (_, doc), (_, more) in want.items())
            for x in got:
                shares = [int(line_dedup._sketches_apart(pa.array([at[k, x["doc_id"]][8]], pa.binary()), pa.array([at[k, x["doc_id2"]][8]], pa.binary()))[0])
                          / (at[k, x["doc_id"]][4] + at[k, x["doc_id2"]][4]) for k in keys_of[x["doc_id"]] if (k, x["doc_id2"]) in at]
                assert any(want.get((k, x["doc_id"]), (None,))[0] in shares for k in keys_of[x["doc_id"]])


def test_second_round_finds_its_keys_beside_the_candidates(spark):
    """The rows that candidates leaves for round two hold every earlier match of its lines, repeated rows of a doc_id among them."""
    draw = random.Random(9)
    common = [f"w{k}" for k in range(24)]
    lines = [" ".join([w for w in common if draw.random() < 0.85] + [f"v{draw.randrange(40)}" for _ in range(draw.randrange(4))]) for _ in range(120)]
    data = spark.createDataFrame([(k, text) for k, text in enumerate(lines)] + [(0, lines[0])], "doc_id long, text string")
    s = line_dedup.Settings(common=2)
    scan = line_dedup.materialized(line_dedup.scanned(data, s))
    told = line_dedup.materialized(line_dedup.candidates(line_dedup.packed_index(data, line_dedup.rarity(scan), {}, s, None, 7), s))
    found = told.filter("key IS NULL")
    assert found.filter("doc_id = doc_id2 AND line = line2").count() == 0
    left = found.filter("more").select("doc_id", "line").distinct()
    asked = {r.doc_id for r in left.collect()}
    sets = [set(x.split()) for x in lines]
    want = {k for k in asked if any(4 * len(sets[k] & sets[j]) >= 3 * len(sets[k] | sets[j]) for j in range(k))}
    firsts = {(r.doc_id, r.doc_id2) for r in found.collect()}
    got = {r.doc_id for r in line_dedup.matched_in_place(data, told.filter("key IS NOT NULL").select("key", "doc_id", "line", "size", "even", "odd"), left, s).collect()}
    tried = {a for a, b in firsts if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert got <= want <= got | tried


def test_lines_of_any_length_equal_brute_force(spark):
    """Lines of one word and more take part, as copies and as near matches, across the bound between the two methods too."""
    draw = random.Random(11)
    rows = [(doc, "\n".join([" ".join(draw.sample(WORDS[:9], draw.randint(0, 9))) for _ in range(8)] + ["  ", "same short line", "w1 w1 w1"])) for doc in range(40)]
    rows.append((40, "\n".join(" ".join(WORDS[100:100 + n]) for n in range(10, 0, -1))))
    rows.append((41, "\n".join(" ".join(WORDS[200:200 + n]) for n in range(1, 11))))
    seen, want = [], set()
    for doc, text in rows:
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.split())
            if words:
                if any(100 * len(words & x) >= 75 * len(words | x) for x in seen):
                    want.add((doc, k))
                seen.append(words)
    data = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string")
    for settings in (line_dedup.Settings(), line_dedup.Settings(common=2, heavy=10)):
        assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(data, settings).collect()} == want


def test_line_query_and_pipeline_leave_no_line_out(spark, tmp_path):
    rows = [(1, "one two\nfirst text of the page", "en", "s", 32), (2, "one two\nother words stand here now", "en", "s", 34), (3, "two one", "en", "s", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.removed_lines for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0", 3: "0"}
    cut = corpus_pipeline.without_repeated_lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: rows[0][1], 2: "other words stand here now"}


def test_personal_data_beyond_the_certain_kinds(spark):
    """Numbers behind a word for phones and addresses with a written-out sign are found; other numbers and dates are not taken for them."""
    draw = random.Random(12)
    number = lambda: f"{draw.randint(200, 999)}-{draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
    rows, want = [], {}
    for k in range(300):
        phone, mail = number(), f"user{k} [at] example{k % 7}.com"
        text = f"a{k}@b.com and +1 {number()} here. Write {mail}! or call us at {phone}, item {draw.randint(10**8, 10**9)} of 2024-05-01"
        rows.append((k, text))
        want[k] = {f"{kind}:{text.index(x)}:{text.index(x) + len(x)}" for kind, x in (("phone", phone), ("email", mail))}
    # A source full of true addresses leaves no room for wrong spans of other kinds.
    rows += [(1000 + k, " ".join(f"x{k}y{j}@host.org" for j in range(50)) + f" order {draw.randint(10**8, 10**9)}") for k in range(100)]
    told = personal.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal.written(F.col("known")).alias("known"), personal.written(F.col("spans")).alias("spans"))
    for r in told.collect():
        assert set(r.spans.split(",")) - set(r.known.split(",")) == want.get(r.doc_id, set())


def test_long_runs_are_proposed_whole(spark):
    texts_ = ["x" * 100 + "@" + "y" * 90 + ".com", "bob[at]" + "z" * 70 + ".org now", "q" * 200_000, "a[b {c@d.e"]
    rows = spark.createDataFrame(enumerate(texts_), "k long, t string")
    got = {r.k: [s["match"] for s in r.x] for r in rows.select("k", personal.found("t", personal.PROPOSED["email"], F.lit(True)).alias("x")).collect()}
    assert got == {0: [texts_[0]], 1: [texts_[1][:-4]], 2: [], 3: ["{c@d.e"]}


def test_encoder_equals_an_unaltered_library():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    for t in ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "<| endoftext |>", "plain words", "ünï <|endoftext|>"]:
        assert encoder(tokenizer_path()).ids(t) == np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert np.frombuffer(encoder(tokenizer_path()).ids("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


def test_token_files_keep_special_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a <|endoftext|> b"), (1, "c")], "doc_id long, text string")
    token_files.write_token_files(rows, str(tmp_path / "t"))
    got = {r.doc_id: (r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()[:3]) for r in token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert got[0] == (0, [320, 49407, 321]) and got[1][0] == 4


def test_a_tried_best_pair_leaves_the_others_to_the_full_pass(spark, monkeypatch):
    """One bucket of three: the likeliest pair of two components was tried and refused, and stands for one that links."""
    draw = random.Random(0)
    words = [f"k{draw.randrange(10**9)}" for _ in range(140)]
    data = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((words[:104], words[16:120], words[17:124]))], "doc_id long, text string")
    across, asked = settle.across, []

    def wrong_first(members, marks, percent, block, every):
        asked.append(every)
        told = across(members, marks, percent, block, every)
        return told if every else spark.createDataFrame([(0, 1, 2)], told.schema)

    monkeypatch.setattr(settle, "across", wrong_first)
    got = near_dedup.near_duplicates(data, near_dedup.Settings(bands=1, rows=1, floor=-9.0)).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 1} and asked == [False, True]


def test_more_lines_than_sixteen_bits_number(spark):
    """A text of 70,000 lines keeps all its matches, as it does when the lines are dealt over many texts."""
    draw = random.Random(3)
    lines = [" ".join(f"{draw.randrange(1 << 30):x}" for _ in range(8)) for _ in range(70_000)]
    near = [" ".join([*x.split()[:7], "changed"]) for x in lines[::350]]
    data = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(near))], "doc_id long, text string")
    assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(data).collect()} == {(2, k) for k in range(len(near))}


def test_the_quality_stage_filters_what_it_has_written(spark, tmp_path):
    """No filter of the plan repeats the expressions that the verdict rests on."""
    rows = [(1, "word " * 60, "en", "s", 300), (2, "short", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_archives_of_very_long_pages_and_of_none(spark, tmp_path):
    """30 MB of signs of several bytes, cut anywhere; an empty table; records without a length."""
    page = "é€𝄞x" * 3_000_000
    schema = "page_id long, url string, html string"
    archives.write_archives(archives.to_records(spark.createDataFrame([(1, "u", page), (2, "v", page), (3, None, None)], schema)), str(tmp_path / "a"))
    got = {r.record_id.split(":")[2]: r for r in archives.put_together(archives.read_archives(spark, str(tmp_path / "a"))).collect()}
    assert bytes(got["1"].payload) == page.encode() and got["2"].record_type == "revisit" and got["3"].payload_bytes == 0 and all(r.problem is None for r in got.values())
    archives.write_archives(archives.to_records(spark.createDataFrame([], schema)), str(tmp_path / "none"))
    assert archives.put_together(archives.read_archives(spark, str(tmp_path / "none"))).count() == 0
    with pytest.raises(ValueError, match="tells no length"):
        list(archives.records_in(memoryview(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")))


def test_a_rare_language_is_learned_at_any_size(spark):
    """Three rows of one language among 600 of another, with 40 rows to fit on."""
    draw = random.Random(2)
    text = lambda signs: " ".join("".join(draw.choices(signs, k=5)) for _ in range(40))
    rows = [(k, text("abcde"), "common") for k in range(600)] + [(1000 + k, text("vwxyz"), "rare") for k in range(3)]
    model = language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Settings(most_rows=40))
    assert model.names == ["common", "rare"]
    told = language.predicted(spark.createDataFrame([(1, text("vwxyz")), (2, text("abcde"))], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in told.collect()} == {1: "rare", 2: "common"}


def test_line_sketches_never_exclude_a_match():
    """Sketches differ in no more cells than their sets have members that aren't shared, at any two widths."""
    draw = random.Random(11)
    texts = [" ".join(f"w{draw.randrange(60)}" for _ in range(n)) for n in (1, 5, 15, 17, 40, 70, 200) for _ in range(12)]
    lines = line_dedup.lines_of(pa.array(texts), 1)
    sketches = pa.array(line_dedup._sketched(lines), pa.binary())
    x, y = (pa.array([p[k] for p in [(a, b) for a in range(len(texts)) for b in range(len(texts))]]) for k in (0, 1))
    apart = line_dedup._sketches_apart(sketches.take(x), sketches.take(y)).tolist()
    sets = [set(t.split()) for t in texts]
    assert all(d <= len(sets[a] ^ sets[b]) for a, b, d in zip(x.to_pylist(), y.to_pylist(), apart)) and max(apart) > 20


def test_lines_are_fetched_without_moving_texts(spark):
    """The lines asked for are picked out where texts are read; before, up to 2^17 documents were joined, which shuffled every text."""
    data = spark.createDataFrame([(k, f"a{k} b c\n\nd e{k}") for k in range(50)], "doc_id long, text string")
    seen, write = [], line_dedup.materialized
    line_dedup.materialized = lambda rows, name="step": seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, name)
    try:
        lines = line_dedup.lines_at(data, spark.createDataFrame([(3, 0), (4, 2)], "doc_id long, line int"))
    finally:
        line_dedup.materialized = write
    got = {(r.doc_id, r.line): (bytes(r.content), r.size) for r in lines.collect()}
    assert got[3, 0] == (b"a3 b c", 3) and got[4, 2] == (b"d e4", 2) and not any("Join" in x for x in seen)
