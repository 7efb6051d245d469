"""The change-only append rule with a heartbeat, as a batch job over all accounts.

Whether a reading is stored depends on the reading stored before it. Nothing is
replayed per account: an account with very many readings is worked on by many tasks.

1. A reading that differs from the one before it in value or status, or that
   follows it after the heartbeat, is stored whatever came earlier. So is one
   whose reset moved by more than twice the tolerance. Most readings are settled
   here, in plain expressions.
2. For the others, each reading points to the next one stored if it is stored itself.
   Inside a block of time these pointers are found by range searches over whole arrays,
   and followed by doubling: a pointer's pointer goes twice as far.
3. A block that opens with an unsettled reading needs to know what was stored last before
   it. Every reading that could be the first stored one of the block before, within one
   heartbeat of its start, is a node that points to such a reading of the next block; the
   nodes that are reached are found by doubling as well, in as many joins as the logarithm
   of the longest chain of blocks. No task sees more of an account than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerline.config import LIMITS
from ledgerline.operators.skew import with_previous
from ledgerline.session import materialized

MICROS = 1_000_000


@dataclass(frozen=True)
class AppendRule:
    """`cooldown_seconds` = None is the plain rule; with a cooldown it is the atomic variant.

    Both store every real change. A reading taken before the stored one was
    observed (clock skew) is never stored for its age.
    """

    cooldown_seconds: int | None = None
    heartbeat_seconds: int = LIMITS.heartbeat_seconds
    tolerance_seconds: int = LIMITS.reset_tolerance_seconds

    def keeps(self, stored: tuple, decided: int, reset: int) -> bool:
        """Is an unchanged reading stored after `stored` (observed, reset)?"""
        observed, stored_reset = stored
        if abs(reset - stored_reset) > self.tolerance_seconds * MICROS:
            return True
        age = decided - observed
        if self.cooldown_seconds is not None and age < self.cooldown_seconds * MICROS:
            return False
        return age > self.heartbeat_seconds * MICROS


PLAIN = AppendRule()
ATOMIC = AppendRule(cooldown_seconds=LIMITS.cooldown_seconds)

_COLUMNS = ["account", "block", "observed", "decided", "reset", "certain", "reading_id"]
_VALUES = ["observed", "decided", "reset", "certain"]
_NODE = "account string, block bigint, next_block bigint, position int, decided bigint, reset bigint, fixed boolean, exit_observed bigint, exit_reset bigint"
_STORED = "account string, reading_id bigint"


def _groups(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each (account, block) as arrays, across batch borders. Input is sorted by both."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        account, block = frame["account"].to_numpy(), frame["block"].to_numpy()
        new = np.flatnonzero((account[1:] != account[:-1]) | (block[1:] != block[:-1])) + 1
        if held and (held[-1]["account"].iloc[-1] != account[0] or held[-1]["block"].iloc[-1] != block[0]):
            new = np.concatenate([[0], new])
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(frame)]):
            part = frame.iloc[a:b]
            if held and a in new:
                yield {c: np.concatenate([x[c].to_numpy() for x in held]) for c in columns}
                held = []
            if len(part):
                held.append(part)
    if held:
        yield {c: np.concatenate([x[c].to_numpy() for x in held]) for c in columns}


def following(rule: AppendRule, observed: np.ndarray, decided: np.ndarray, reset: np.ndarray, certain: np.ndarray) -> np.ndarray:
    """For each position the next one stored if this one is, the row count where there is none.

    A reading is passed over while it is not certain, its age within the waiting time and its reset within the
    tolerance. Highest and lowest values of all stretches of 1, 2, 4, ... rows are made once; then every position
    skips, from the longest stretch to the shortest, those it passes over as a whole.
    """
    n = len(observed)
    wait = max(rule.heartbeat_seconds * MICROS, (rule.cooldown_seconds or 0) * MICROS - 1)
    latest, high, low, sure = [decided], [reset], [reset], [certain]
    while (1 << len(latest)) <= n:
        half = 1 << (len(latest) - 1)
        for rows, pick in ((latest, np.maximum), (high, np.maximum), (low, np.minimum), (sure, np.logical_or)):
            rows.append(pick(rows[-1][:-half], rows[-1][half:]))
    at = np.arange(1, n + 1)
    for k in reversed(range(len(latest))):
        own = np.flatnonzero(at + (1 << k) <= n)
        to = at[own]
        passed = ~sure[k][to] & (latest[k][to] - observed[own] <= wait) & (high[k][to] - reset[own] <= rule.tolerance_seconds * MICROS) & (
            reset[own] - low[k][to] <= rule.tolerance_seconds * MICROS)
        at[own[passed]] += 1 << k
    return at


def reached(after: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which positions the pointers lead to from the roots, themselves included, by doubling."""
    n, found = len(after), np.append(roots, False)
    jump = np.append(after, n)
    while (jump[:n] < n).any():
        found[jump[found]] = True
        found[n] = False
        jump = jump[jump]
    return found[:n]


def ends(after: np.ndarray) -> np.ndarray:
    """Where the pointers of each position end, by doubling."""
    n = len(after)
    jump = np.where(after < n, after, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def _first_kept(rule: AppendRule, entry: tuple[int, int], decided: np.ndarray, reset: np.ndarray, certain: np.ndarray) -> int:
    """The first position stored after an entry (observed, reset); the row count if there is none."""
    age = decided - entry[0]
    kept = age > rule.heartbeat_seconds * MICROS
    if rule.cooldown_seconds is not None:
        kept &= age >= rule.cooldown_seconds * MICROS
    kept |= certain | (np.abs(reset - entry[1]) > rule.tolerance_seconds * MICROS)
    return int(kept.argmax()) if kept.any() else len(kept)


def _nodes(rule: AppendRule, block_micros: int):
    """The ways through each block: readings that can be its first stored one, and what is stored last then."""
    def run(frames):
        for g in _groups(frames, [*_COLUMNS, "floor", "next_block"]):
            observed, decided, reset, certain = (g[c] for c in _VALUES)
            last = ends(following(rule, observed, decided, reset, certain.astype(bool)))
            # No reading stored before this block can leave a later one as the first stored here.
            final = certain.astype(bool) | (decided - np.maximum(g["block"] * block_micros, g["floor"]) > rule.heartbeat_seconds * MICROS)
            n = int(final.argmax()) + 1 if final.any() else len(final)
            at = np.arange(n)
            yield pd.DataFrame({
                "account": g["account"][:n], "block": g["block"][:n], "next_block": g["next_block"][:n], "position": at, "decided": decided[:n], "reset": reset[:n],
                "fixed": certain[:n].astype(bool), "exit_observed": observed[last[:n]], "exit_reset": reset[last[:n]]})
    return run


def entries(nodes: DataFrame, rule: AppendRule) -> DataFrame:
    """account, block, entry_observed and entry_reset: what is stored last before each block that opens with an unsettled reading.

    A node leads to the first reading of the next block's nodes that its exit makes stored. Blocks that open with a settled
    reading are roots; the nodes reached from them are the ways really taken, one a block. Each round doubles the distance.
    """
    here = nodes.select("account", "block", "position", "next_block", "exit_observed", "exit_reset")
    there = nodes.select(F.col("account").alias("_account"), F.col("block").alias("_block"), F.col("position").alias("_position"), "decided", "reset", "fixed")
    age = F.col("decided") - F.col("exit_observed")
    kept = age > rule.heartbeat_seconds * MICROS
    if rule.cooldown_seconds is not None:
        kept &= age >= rule.cooldown_seconds * MICROS
    kept |= F.col("fixed") | (F.abs(F.col("reset") - F.col("exit_reset")) > rule.tolerance_seconds * MICROS)
    jumps = here.join(there, (F.col("account") == F.col("_account")) & (F.col("next_block") == F.col("_block")) & kept).groupBy(
        "account", "block", "position", F.col("next_block").alias("to_block")).agg(F.min("_position").alias("to_position"))
    node = ["account", "block", "position"]
    taken = nodes.filter("fixed and position = 0").select(*node)
    jumps = materialized(jumps, "jumps")
    while not jumps.isEmpty():
        more = taken.join(jumps, node).select("account", F.col("to_block").alias("block"), F.col("to_position").alias("position"))
        taken = materialized(taken.unionByName(more).distinct(), "taken")
        onward = jumps.select("account", F.col("block").alias("to_block"), F.col("position").alias("to_position"), F.col("to_block").alias("_block"), F.col("to_position").alias("_position"))
        jumps = materialized(jumps.join(onward, ["account", "to_block", "to_position"]).select(
            *node, F.col("_block").alias("to_block"), F.col("_position").alias("to_position")), "jumps")
    return nodes.join(taken, node).select("account", F.col("next_block").alias("block"), F.col("exit_observed").alias("entry_observed"), F.col("exit_reset").alias("entry_reset"))


def _block_stored(rule: AppendRule):
    """Unsettled readings that are stored; settled ones are known already."""
    def run(frames):
        for g in _groups(frames, [*_COLUMNS, "entry_observed", "entry_reset"]):
            observed, decided, reset = (g[c] for c in _VALUES[:3])
            certain = g["certain"].astype(bool)
            roots = certain.copy()
            entry = g["entry_observed"][0]
            if not pd.isna(entry):
                first = _first_kept(rule, (int(entry), int(g["entry_reset"][0])), decided, reset, certain)
                if first < len(roots):
                    roots[first] = True
            kept = reached(following(rule, observed, decided, reset, certain), roots) & ~certain
            yield pd.DataFrame({"account": g["account"][kept], "reading_id": g["reading_id"][kept]})
    return run


def mark_certain(readings: DataFrame, rule: AppendRule, decided_at: str, order_at: str = "observed_at", floor_at: str | None = None) -> DataFrame:
    """Readings in micros with `certain`: stored whatever was stored before. Nothing stored before was observed after the row before, or `floor_at`."""
    floor = F.coalesce(F.unix_micros(floor_at), F.lit(-(1 << 62))) if floor_at else F.lit(-(1 << 62))
    paired = with_previous(readings, ["account"], order_at, [order_at, "reading_id"],
                           [*dict.fromkeys([order_at, "observed_at", "fraction", "status", "provider_resets_at"])], name="_before")
    before = F.col("_before")
    changed = (F.col("fraction") != before["fraction"]) | (F.col("status") != before["status"])
    jumped = F.abs(F.unix_micros("provider_resets_at") - F.unix_micros(before["provider_resets_at"])) > (
        2 * rule.tolerance_seconds * MICROS)
    late = F.unix_micros(decided_at) - F.greatest(F.unix_micros(before["observed_at"]), floor) > rule.heartbeat_seconds * MICROS
    return paired.withColumns({
        "floor": floor, "observed": F.unix_micros("observed_at"), "decided": F.unix_micros(decided_at),
        "reset": F.unix_micros("provider_resets_at"), "ordered": F.unix_micros(order_at),
        "certain": F.coalesce(before.isNull() | changed | jumped | late, F.lit(True)),
        "before_ordered": F.unix_micros(before[order_at]),
    }).drop("_before")


def _in_blocks(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Rows of one key in one task, sorted.

    The shuffle is on a hash of the key. On the key itself Spark would drop it
    after a join on the same key, and a join that turns into a broadcast at run
    time no longer keeps the rows of a key together.
    """
    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*order)


def stored_readings(readings: DataFrame, rule: AppendRule = ATOMIC, decided_at: str = "fetched_at",
                    block_hours: int = 24, order_at: str = "observed_at", floor_at: str | None = None) -> DataFrame:
    """The readings the rule keeps. Reads readings(account, reading_id, observed_at, fraction, status, provider_resets_at).

    `decided_at` names the column that holds the time of the decision, `order_at` the one by
    which readings follow each other: the time they were observed, unless a stream says otherwise. Where a first
    reading was observed later than those that follow it, `floor_at` names that time on all rows of its account.
    """
    size = block_hours * 3600 * MICROS
    marked = materialized(mark_certain(readings, rule, decided_at, order_at, floor_at).withColumns({
        "block": F.floor(F.col("ordered") / size).cast("bigint"),
        "before_block": F.floor(F.col("before_ordered") / size).cast("bigint")}), "marked")
    key = ["account", "block"]
    row_order = [*key, "ordered", "reading_id"]

    # Blocks that open with an unsettled reading, and the blocks they follow.
    linked = marked.filter(~F.col("certain") & (F.col("before_block") != F.col("block"))).select(
        "account", F.col("before_block").alias("block"), F.col("block").alias("next_block"))
    nodes = materialized(_in_blocks(marked.select(*_COLUMNS, "ordered", "floor").join(linked, key), row_order, key).mapInPandas(
        _nodes(rule, size), _NODE), "nodes")

    unsettled = marked.filter(~F.col("certain"))
    open_rows = marked.select(*_COLUMNS, "ordered").join(unsettled.select(*key).distinct(), key, "left_semi").join(entries(nodes, rule), key, "left")
    replayed = _in_blocks(open_rows, row_order, key).mapInPandas(_block_stored(rule), _STORED)
    kept = marked.filter("certain").select(*readings.columns).unionByName(
        unsettled.join(replayed, ["account", "reading_id"], "left_semi").select(*readings.columns))
    return kept
