"""Structure repair of conversations: the cheapest edits to alternating turns, by depth-first branch and bound.

Rows of a conversation stream through a task in order and leave one byte each behind, so
that a conversation of any length needs no more memory than its codes and its edits.
Texts are read only as flags in the first pass and hashed as they stream by in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.session import materialized

BLANKS = r"\x20\x09-\x0D"
#: Cost of each edit; an undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the repaired rows so far: nothing, one system row, last a user row, last an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to.
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Bits of a row's code: its role's initial, whether it has to go, whether it is truncated.
INITIALS = {"s": 1, "u": 2, "a": 3}
GOES, CUT = 4, 8
KEPT_TO = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}


def suffix_bounds(codes: bytes) -> list[tuple[float, ...]]:
    """For each row and state the least that the rows from there on can cost, worked out from the end."""
    inf = float("inf")

    def inserted(row: list[float]) -> tuple[float, ...]:
        # Three inserts pass through all states that inserts can reach.
        for _ in range(3):
            for state in range(4):
                row[state] = min(row[state], INSERT + row[AFTER[state]])
        return tuple(row)

    bounds = [inserted([0.0, inf, inf, 0.0])]
    for code in reversed(codes):
        then, row = bounds[-1], []
        extra = TRUNCATED if code & CUT else 0
        for state in range(4):
            least = DELETE + then[state]
            if not code & GOES:
                least = min(least, REROLE + extra + then[AFTER[state]])
                kept = KEPT_TO.get((state, code & 3))
                if kept is not None:
                    least = min(least, KEEP + extra + then[kept])
            row.append(least)
        bounds.append(inserted(row))
    bounds.reverse()
    return bounds


def repaired(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows with these codes, the ASCII-least of equally cheap ones.

    Depth first with an explicit stack, edits in ASCII order (D, I, K, R): of paths of one cost
    to a node the first has the least audit, so a node's table needs only the least cost it was
    reached with, and a path that doesn't beat it is dominated. A path whose cost and suffix
    bound don't beat the incumbent is cut; as the incumbent came first, a tie is cut as well.
    """
    n, bounds = len(codes), suffix_bounds(codes)
    best_cost, best = float("inf"), b""
    reached: dict[tuple[int, int], float] = {}
    letters = bytearray()
    # A stack entry: length of the audit before its last letter, that letter, row, state, cost.
    stack = [(0, 0, 0, START, 0)]
    while stack:
        length, letter, row, state, cost = stack.pop()
        del letters[length:]
        if letter:
            letters.append(letter)
        # Nothing costs less than the bound of the start, so what exceeds it can't be cheapest.
        if cost + bounds[row][state] > bounds[0][START] or cost + bounds[row][state] >= best_cost or reached.get((row, state), float("inf")) <= cost:
            continue
        reached[row, state] = cost
        if row == n and state in (START, ASSISTANT):
            best_cost, best = cost, bytes(letters)
            continue
        length = len(letters)
        after = AFTER[state]
        branches = []
        if row < n:
            code = codes[row]
            branches.append((length, 68, row + 1, state, cost + DELETE))
            branches.append((length, 73, row, after, cost + INSERT))
            if not code & GOES:
                extra = TRUNCATED if code & CUT else 0
                kept = KEPT_TO.get((state, code & 3))
                if kept is not None:
                    branches.append((length, 75, row + 1, kept, cost + KEEP + extra))
                branches.append((length, 82, row + 1, after, cost + REROLE + extra))
        else:
            branches.append((length, 73, row, after, cost + INSERT))
        stack.extend(reversed(branches))
    return int(best_cost), best.decode()


def damaged(rows: DataFrame) -> DataFrame:
    """conversations rows (conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20; null roles and texts become one space.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("_what") == 1, "").when(F.col("_what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), what.alias("_what")).filter("_what <> 0")
    told = told.withColumn("_copy", F.explode(F.when(F.col("_what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return told.select("conv_id", "turn", F.when(F.col("_what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _turn_key() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with blank, cut (no sentence end) and early (the first turn with this role and text). Null roles and texts count as one space.

    The earliest turn is an aggregate over (conv_id, role, text), which Spark combines before the shuffle; no conversation meets in one task.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws(":", F.coalesce(F.length("conv_id").cast("string"), F.lit("null")), "conv_id", F.length("role").cast("string"), "role", "text"), 256))
    early = keyed.groupBy(F.col("_key").alias("_of")).agg(F.min(_turn_key()).alias("early"))
    joined = keyed.join(early, F.col("_key") == F.col("_of"))
    return joined.select("conv_id", "turn", "role", "text", (F.col("early") < _turn_key()).alias("again"), (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"),
                         (~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")).alias("cut"))


SUMMARY = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SUMMARY = pa.schema([("conv_id", pa.string())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


class _Reader:
    """What the rows of one conversation, in order, amount to."""

    def __init__(self) -> None:
        self.codes, self.turns, self.low, self.high, self.last = bytearray(), 0, None, None, None
        self.counts, self.illegal, self.initial = [0, 0, 0], 0, None

    def take(self, turn: int | None, role: str, text: str, again: bool, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        again = again or (turn, role, text) == self.last
        self.last = (turn, role, text)
        fault = 0 if blank else 1 if again else 2 if cut else None
        if fault is not None:
            self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.codes.append(INITIALS.get(initial, 0) | (GOES if fault in (0, 1) else 0) | (CUT if fault == 2 else 0))

    def told(self, conv_id: str | None) -> tuple:
        cost, audit = repaired(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return conv_id, gaps, *self.counts, self.illegal, cost, audit


def summaries(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of `flagged` rows: one pass in order, then the search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, out = None, None, []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SUMMARY)], schema=_SUMMARY)
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv_id != at:
                    if reader is not None:
                        out.append(reader.told(at))
                    at, reader = conv_id, _Reader()
                    if len(out) >= 1000:
                        yield batch_of()
                        out = []
                reader.take(*row)
        if reader is not None:
            out.append(reader.told(at))
        if out:
            yield batch_of()

    ordered = _ordered(rows).select("conv_id", "turn", "role", "text", "again", "blank", "cut")
    return ordered.mapInArrow(run, SUMMARY)


def lines_of(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """role and text of each repaired row: the audit's letters applied to the rows (role, text) in order."""
    last = None
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


def hashes(rows: DataFrame, told: DataFrame) -> DataFrame:
    """conv_id and the hash of each repaired text. The audit comes first in each conversation's stream; texts are hashed as they come."""
    schema = pa.schema([("conv_id", pa.string()), ("repaired_sha256", pa.string())])
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = told.select("conv_id", nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"), "audit", F.lit(0).alias("kind"))
    both = heads.unionByName(rows.select("conv_id", "turn", "role", "text", nothing("audit", "string"), F.lit(1).alias("kind")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = stream(batches), []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for conv_id, _, _, audit, kind in rows:
            if kind:
                raise ValueError("a row without a plan")
            digest, first = hashlib.sha256(), True
            # Every row takes one letter that isn't I, so the lines end where the conversation does.
            for role, text in lines_of(audit, ((role, text) for _, role, text, _, _ in rows)):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out.append((conv_id, digest.hexdigest()))
            if len(out) >= 1000:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    ordered = _ordered(both, "kind").select("conv_id", "role", "text", "audit", "kind")
    return ordered.mapInArrow(run, "conv_id string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """SUMMARY and repaired_sha256 of each conversation of rows (conv_id, turn, role, text).

    A null conv_id is a conversation of its own. Rows come by turn, nulls first, then by role and text. Null
    roles and texts count as one space; a role without a known initial can't be kept. Of equal rows all but
    the first are duplicates. Other columns are not read; an empty table gives no rows.
    """
    flags = materialized(flagged(rows), "flagged")
    told = materialized(summaries(flags), "summaries")
    hashed = hashes(flags, told)
    return told.join(hashed.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repaired_text(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The repaired rows themselves: conv_id, place, role and text, for rows and their `repair`."""
    schema = pa.schema([("conv_id", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = told.select("conv_id", nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"), "audit", F.lit(0).alias("kind"))
    own = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), nothing("audit", "string"), F.lit(1).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), []
        for conv_id, _, _, audit, _ in rows:
            for place, (role, text) in enumerate(lines_of(audit, ((role, text) for _, role, text, _, _ in rows))):
                out.append((conv_id, place, role, text))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _ordered(heads.unionByName(own), "kind").select("conv_id", "role", "text", "audit", "kind").mapInArrow(run, "conv_id string, place long, role string, text string")
