"""Tokenizer alignment, n-gram join and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import alignment, conversations, ngram_join, queries, settle
from ledgerline.llm.tokens import tokenizer_path

TEXTS = [None, "", " ", "Hello world, hello  world!\n", "a\r\n b\t\tc \n\n d\r", "tab\tand\r;\r x", "ünï çode 日本語 ﬁ ２ 　 wide\xa0blank", "under▁score", "<|endoftext|> <s> </s> <0x41> x",
         "zero\0byte \x1c sep\x85", "x" * 400, "The quick brown fox's don't 12345 3.14159e-10 {}[]();", "   leading and trailing   ", "Hello world, hello  world!\n", "\n\n\n", "é combining 🙂🙂 emoji"]


@pytest.fixture(scope="module")
def known():
    return alignment.aligner(tokenizer_path(alignment.BYTE_BPE), tokenizer_path(alignment.PIECE_BPE))


def whole(known, text):
    """Ids of a whole text by the libraries alone, in groups; none where bytes differ."""
    if not text:
        return [], [], []
    a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(known.bytes_a[k] for k in a) != raw or b"".join(known.bytes_b[k] for k in b) != raw:
        return [], [], []
    ends = set(itertools.accumulate(len(known.bytes_a[k]) for k in a)) & set(itertools.accumulate(len(known.bytes_b[k]) for k in b))
    groups, x, y = [], 0, 0
    at_a = at_b = 0
    for end in sorted(ends):
        left, right = [], []
        while at_a < end:
            left.append(a[x])
            at_a += len(known.bytes_a[a[x]])
            x += 1
        while at_b < end:
            right.append(b[y])
            at_b += len(known.bytes_b[b[y]])
            y += 1
        groups.append((left, right))
    return a, b, groups


def digests(known, texts):
    told = [whole(known, t) for t in texts]
    count, highest = {}, {}
    for _, _, groups in told:
        for pair in {(a, b) for left, right in groups for a in left for b in right}:
            count[pair] = count.get(pair, 0) + 1
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for a, b, groups in told:
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_chunks_join_to_what_the_libraries_give(known):
    """Random texts of the signs that cuts depend on: the chunks' groups are those of the whole text."""
    draw = random.Random(4)
    signs = [" ", " ", "\n", "\t", "\r", "\xa0", " ", "\x1c", "a", "The", "12", "'s", ";", "▁", "é", ".", "<s>", "日", "\0"]
    for _ in range(600):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(1, 14)))
        chunks, bounds = known.numbers([text])
        a, b, groups = whole(known, text)
        told = ";".join(known.texts[k] for k in chunks) if known.fine[chunks].all() else ""
        assert told == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), repr(text)
        assert bounds.tolist() == [0, len(chunks)]


def test_the_identity_map_has_equal_bytes(known):
    some = np.flatnonzero(known.same >= 0)
    assert len(some) > 5000 and all(known.bytes_a[k] == known.bytes_b[known.same[k]] for k in some.tolist())


@pytest.mark.parametrize("settings", [alignment.Settings(), alignment.Settings(held=3, table=7)])
def test_alignment_equals_brute_force(spark, known, settings):
    """Nulls, empty and very long texts, repeated rows, rows without doc_id, clashing names; a table in one piece and in ranges."""
    texts = [*TEXTS, " ".join(["don't stop"] * 20_000)]
    rows = [(k, t, "x", 0) for k, t in enumerate(texts)] + [(3, texts[3], "x", 0), (None, "no id", "x", 0)]
    data = spark.createDataFrame(rows, "doc_id long, text string, key string, n_best int").repartition(3)
    got = sorted((tuple(r) for r in alignment.aligned(data, s=settings).collect()), key=repr)
    want = sorted(((k, *d) for (k, *_), d in zip(rows, digests(known, [r[1] for r in rows]))), key=repr)
    assert got == want
    assert alignment.aligned(data.limit(0), s=settings).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[a:a + 5]) for a in range(len(words) - 4)} or ({tuple(words)} if words else set())


def variants(seed):
    """Groups of near copies around the threshold, some linked only by chains."""
    draw = random.Random(seed)
    out = [None, "", " \n", "one two", "ONE two", "one two three four five"]
    for _ in range(4):
        base = [f"v{draw.randrange(4000)}" for _ in range(draw.choice((30, 60, 140)))]
        for _ in range(14):
            words = list(base if draw.random() < 0.6 else out[-1].split())
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(9999)}"
            out.append(" ".join(words))
    return [*out, out[-1], " ".join(f"v{k % 700}" for k in range(9000))]


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(part=60, most=200, block=3)])
def test_ngram_join_equals_brute_force(spark, settings):
    texts = variants(2)
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    group = {k: k for k in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            group[y] = x
    rows = [(k, t, 0, "x") for k, t in enumerate(texts)]
    data = spark.createDataFrame([*rows, rows[8], (None, "no id at all here", 0, "x")], "doc_id long, text string, id int, lead string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(data, settings).collect()}
    assert got.pop(None) == (1, None)
    assert got == {k: (len(sets[k]), top(k)) for k in sets}
    assert len({top(k) for k in sets}) < len(sets) - 10
    if settings == ngram_join.Settings():
        assert ngram_join.linked(data.limit(0)).count() == 0


def test_similar_sets_share_a_prefix_token_under_every_order():
    draw = np.random.default_rng(3)
    table = draw.integers(0, 256, ngram_join.CELLS).astype(np.uint8)
    for _ in range(200):
        n = int(draw.integers(1, 120))
        both = draw.integers(0, 2**63, n).astype(np.uint64)
        extra = draw.integers(0, 2**63, int(draw.integers(0, n // 4 + 1))).astype(np.uint64)
        cut = int(draw.integers(0, len(extra) + 1))
        a, b = np.sort(np.concatenate([both, extra[:cut]])), np.sort(np.concatenate([both, extra[cut:]]))
        if 100 * n >= 80 * (n + len(extra)):
            for order in range(len(ngram_join.ORDERS)):
                first = [set(ngram_join.ranked(x, table, order, ngram_join.prefix_length(len(x), 80)).tolist()) for x in (a, b)]
                assert first[0] & first[1]


def test_packed_entries_come_back():
    draw = np.random.default_rng(8)
    for wide in (False, True):
        rows = np.zeros(50, ngram_join._ENTRY)
        rows["token"], rows["place"], rows["id"] = draw.integers(0, 2**32, 50), draw.integers(0, 90_000 if wide else 60_000, 50), np.sort(draw.integers(-3, 9, 50))
        rows["n"] = rows["id"] % 4 + 1
        rows["place"][0] = 70_000 if wide else 65_535
        assert (ngram_join._entries(ngram_join._packed(rows), 50) == rows).all()
    assert len(ngram_join._entries(ngram_join._packed(rows[:1]), 1)) == 1


def test_whole_sketches_bound_the_difference():
    draw = np.random.default_rng(5)
    for _ in range(100):
        a = draw.integers(0, 2**63, int(draw.integers(1, 600))).astype(np.uint64)
        b = np.concatenate([a[int(draw.integers(0, len(a))):], draw.integers(0, 2**63, 40).astype(np.uint64)])
        x, y = (np.frombuffer(settle.whole_sketch(s), np.uint64)[None, :] for s in (a, b))
        m = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(settle.folded_to(x, m) ^ settle.folded_to(y, m)).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_id_bits_pass_every_asked_id(spark):
    import pyarrow as pa
    ids = [0, 1, -1, 5, 1 << 40, -(1 << 62), (1 << 63) - 1, 77]
    bits = settle.id_bits(spark.createDataFrame([(k,) for k in ids[:7]], "id long"))
    assert len(bits) == 1 << (settle.BITS - 3)
    batch = pa.RecordBatch.from_arrays([pa.array([*ids, None], pa.int64()), pa.array(["t"] * 9)], names=["doc_id", "text"])
    assert settle.asked(batch, bits).column("doc_id").to_pylist() == ids[:7]


def cheapest(rows):
    """All edits of rows (initial, has to go, truncated), by exhaustive search in order of cost."""
    best = None
    todo = [(0, "", 0, "")]
    while todo:
        cost, audit, at, out = todo.pop()
        if best and cost > best[0] or len(out) > len(rows) + 3:
            continue
        body = out[1:] if out[:1] == "s" else out
        if any(c != "ua"[k % 2] for k, c in enumerate(body)):
            continue
        if at == len(rows) and (not out or body and len(body) % 2 == 0):
            best = min(best or (cost, audit), (cost, audit))
        todo += [(cost + 2, audit + "I", at, out + c) for c in "ua"]
        if at < len(rows):
            initial, goes, cut = rows[at]
            todo.append((cost + 3, audit + "D", at + 1, out))
            if not goes:
                todo.append((cost + cut, audit + "K", at + 1, out + (initial if initial in ("s", "u", "a") else "?")))
                todo += [(cost + 2 + cut, audit + "R", at + 1, out + c) for c in "ua"]
    return best


def test_search_equals_exhaustive_search():
    draw = random.Random(6)
    cases = [[(draw.choice("suaauax"), draw.random() < 0.2, draw.random() < 0.2) for _ in range(n)] for n in range(5) for _ in range(40)]
    for rows in cases:
        codes = bytes(conversations.INITIALS.get(c, 0) | (conversations.GOES if goes else 0) | (conversations.CUT if cut else 0) for c, goes, cut in rows)
        assert conversations.repaired(codes) == cheapest(rows), rows


def test_a_very_long_conversation_is_searched_in_proportion():
    codes = bytes([1] + [2, 3, 2, 2, 3, 3 | conversations.CUT, 0, 2 | conversations.GOES] * 5000)
    cost, audit = conversations.repaired(codes)
    assert len(audit) >= len(codes) and cost == conversations.suffix_bounds(codes)[0][0]


def by_hand(rows):
    """op13's columns for conversations rows (conv_id, turn, role, text), row by row."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = cheapest([(c, f in ("blank", "duplicate"), f == "truncated") for c, f in zip(initials, faults)]) if len(own) < 7 else (None, None)
        lines, left, last = [], iter(own), ""
        for letter in audit or "":
            role, text = ("", "") if letter == "I" else next(left)[1:]
            if letter in "IR":
                role = "assistant" if last == "u" else "user"
            if letter != "D":
                last = role[:1]
                lines.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversation_repair_equals_brute_force(spark, tmp_path):
    """Nulls in any column, ties of turns, repeated rows, empty texts, clashing names, conversations that lose all rows."""
    draw = random.Random(12)
    rows = []
    for k in range(60):
        for _ in range(draw.randint(1, 5)):
            rows.append((None if k == 7 else "" if k == 8 else f"c{k}", draw.choice((None, 0, 1, 2, 3, 5)), draw.choice(("user", "assistant", "system", "user", "assistant", None, "tool")),
                         draw.choice(("Yes.", "No!", "cut off", "  ", "", None, "Why?\n", "a:b.", "So it is. ", "x" * 5000 + "."))))
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id string, turn long, role string, text string, audit string, kind int").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r[1:]) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = by_hand(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        assert own[5] is None or got[conv] == own, conv
    data = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    told = conversations.repair(conversations.damaged(data))
    text = conversations.repaired_text(conversations.damaged(data), told).withColumn("line", F.concat_ws(":", "role", "text")).groupBy("conv_id").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n"), 256).alias("again"))
    joined = told.join(text.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    assert joined.filter("again <> repaired_sha256").count() == 0 and joined.count() > 30
    assert conversations.repair(data.limit(0)).count() == 0


def test_entries_that_no_other_document_can_match_are_left_out():
    """Of each token exactly those entries stay that fit another document by size and place."""
    draw = np.random.default_rng(5)
    rows = np.zeros(400, ngram_join._ENTRY)
    rows["token"], rows["id"], rows["n"] = np.sort(draw.integers(0, 90, 400)), draw.integers(0, 60, 400), draw.integers(5, 60, 400)
    rows["place"] = draw.integers(0, 5, 400)
    fits = lambda x, y: (x["token"] == y["token"] and x["id"] != y["id"] and 100 * min(x["n"], y["n"]) >= 80 * max(x["n"], y["n"])
                         and int(min(x["place"], y["place"])) + int(min(int(x["n"]) - int(x["place"]), int(y["n"]) - int(y["place"]))) >= -(-80 * (int(x["n"]) + int(y["n"])) // 180))
    assert ngram_join._met(rows, 80).tolist() == [any(fits(x, y) for y in rows) for x in rows]
    assert len(ngram_join._met(rows[:0], 80)) == 0


def test_second_round_opens_only_groups_with_a_failed_pair(spark):
    """A group whose likeliest pairs all linked is not looked through again; the others get the components of now."""
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (7, 7, 7), (7, 8, 8)], "key long, id long, component long")
    failed, found = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(2, 2), (3, 2), (7, 7), (8, 7)], "node long, component long")
    assert sorted(map(tuple, settle.open_groups(members, failed, found).collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 2)]
