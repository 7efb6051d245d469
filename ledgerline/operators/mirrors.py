"""Cross-machine mirror detection: session-set overlap plus exact daily equality.

Sessions are first reduced to distinct fingerprints per machine and agent.
Links are searched from the strong mirrors towards equal rows, never from all
equal rows. Strong mirrors, match totals and the risk flag are found without
listing the pairs that merely share a fingerprint; only the evidence report
lists those, because they are what it reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.config import LIMITS
from ledgerline.functions.fingerprints import FIVE_COUNTERS
from ledgerline.operators.skew import spread_join
from ledgerline.session import materialized

ROW_KEY = ["machine_id", "agent", "usage_date"]
PAIR = ["machine_id", "other_machine_id", "agent"]


def _fingerprints(sessions: DataFrame, *extra: str) -> DataFrame:
    """Two fingerprints per session: its mirror and its identity."""
    both = F.explode(F.array(
        F.struct(F.lit("mirror").alias("kind"), F.col("mirror_hash").alias("hash")),
        F.struct(F.lit("identity").alias("kind"), F.col("identity_hash").alias("hash")),
    ))
    return sessions.select("machine_id", "agent", *extra, both.alias("_f")).select(
        "machine_id", "agent", *extra, F.col("_f.kind").alias("kind"), F.col("_f.hash").alias("hash"))


def incoming_fingerprints(incoming: DataFrame) -> DataFrame:
    """Distinct fingerprints of the incoming side with the days they span."""
    dated = incoming.withColumns({
        "_start": F.coalesce("first_activity", "last_activity").cast("date"),
        "_end": F.coalesce("last_activity", "first_activity").cast("date"),
    })
    return _fingerprints(dated, "_start", "_end").groupBy("kind", "agent", "hash", "machine_id").agg(
        F.min("_start").alias("starts"), F.max("_end").alias("ends"))


def identity_counts(sessions: DataFrame, name: str) -> DataFrame:
    return sessions.groupBy("machine_id", "agent").agg(F.count_distinct("identity_hash").alias(name))


def in_agent_scope(sessions: DataFrame, daily: DataFrame) -> DataFrame:
    """Sessions of the agents that their machine's daily rows name: only these are compared with other machines."""
    named = daily.filter(~F.col("is_tombstone")).select("machine_id", "agent").distinct()
    return sessions.join(named, ["machine_id", "agent"], "left_semi")


def session_classes(ours: DataFrame, theirs: DataFrame | None = None) -> DataFrame:
    """Shared fingerprints put together by who holds them: kind, agent, class, machine_id, ours, theirs, n, holders, starts, ends.

    All fingerprints of a class are held by the same machines, so a pair of machines meets once a class and not once a
    fingerprint, and the class tells their number (n) and each machine's first and last day. `ours` and `theirs` are distinct
    fingerprints, the first with days; without the second both sides are one.
    """
    if theirs is None:
        rows = ours.withColumns({"ours": F.lit(True), "theirs": F.lit(True)})
    else:
        none = F.lit(None).cast("date")
        rows = ours.withColumns({"ours": F.lit(True), "theirs": F.lit(False)}).unionByName(theirs.withColumns({
            "starts": none, "ends": none, "ours": F.lit(False), "theirs": F.lit(True)})).groupBy("kind", "agent", "hash", "machine_id").agg(
                F.bool_or("ours").alias("ours"), F.bool_or("theirs").alias("theirs"), F.min("starts").alias("starts"), F.max("ends").alias("ends"))
    held = rows.groupBy("kind", "agent", "hash").agg(F.sort_array(F.collect_list(F.struct("machine_id", "ours", "theirs", "starts", "ends"))).alias("_held")).filter(F.size("_held") > 1)
    who = F.to_json(F.transform("_held", lambda h: F.struct(h["machine_id"].alias("m"), h["ours"].alias("o"), h["theirs"].alias("t"))))
    named = held.select("kind", "agent", F.sha2(who, 256).alias("class"), F.size("_held").alias("holders"), F.explode("_held").alias("_h")).select(
        "kind", "agent", "class", "holders", "_h.*")
    return named.groupBy("kind", "agent", "class", "machine_id", "ours", "theirs").agg(
        F.count(F.lit(1)).alias("n"), F.max("holders").alias("holders"), F.min("starts").alias("starts"), F.max("ends").alias("ends"))


def session_evidence(incoming: DataFrame, existing: DataFrame,
                     min_matches: int = LIMITS.min_session_matches,
                     min_overlap: float = LIMITS.min_session_overlap) -> DataFrame:
    """Evidence per (machine, other machine, agent) that shares at least one session.

    exact matches compare mirrors, identity matches compare identities; the ratio
    is exact / the smaller identity count. Pairs that share nothing carry no
    evidence and are not listed.
    """
    classes = materialized(session_classes(incoming_fingerprints(incoming), None if existing is incoming else _fingerprints(existing).distinct()), "classes")
    left = classes.filter("ours").select("kind", "agent", "class", "machine_id", "n", "starts", "ends")
    right = classes.filter("theirs").select("kind", "agent", "class", F.col("machine_id").alias("other_machine_id"))
    shared = left.join(right, ["kind", "agent", "class"]).filter(F.col("machine_id") != F.col("other_machine_id"))
    exact = F.col("kind") == "mirror"
    pairs = shared.groupBy(*PAIR).agg(
        F.coalesce(F.sum(F.when(exact, F.col("n"))), F.lit(0)).alias("exact_matches"),
        F.coalesce(F.sum(F.when(~exact, F.col("n"))), F.lit(0)).alias("identity_matches"),
        F.min(F.when(exact, F.col("starts"))).alias("evidence_start"),
        F.max(F.when(exact, F.col("ends"))).alias("evidence_end"),
        F.min(F.when(~exact, F.col("starts"))).alias("_risk_start"),
        F.max(F.when(~exact, F.col("ends"))).alias("_risk_end"),
    )
    return rated(
        pairs.join(identity_counts(incoming, "incoming_sessions"), ["machine_id", "agent"], "left")
        .join(identity_counts(existing, "existing_sessions").withColumnRenamed("machine_id", "other_machine_id"),
              ["other_machine_id", "agent"], "left"),
        min_matches, min_overlap)


def rated(pairs: DataFrame, min_matches: int, min_overlap: float) -> DataFrame:
    smaller = F.least("incoming_sessions", "existing_sessions")
    ratio = F.when(smaller > 0, F.least(F.lit(1.0), F.col("exact_matches") / smaller)).otherwise(F.lit(0.0))
    return pairs.withColumns({
        "exact_overlap_ratio": ratio,
        "risk_start": F.coalesce("_risk_start", "evidence_start"),
        "risk_end": F.coalesce("_risk_end", "evidence_end"),
    }).withColumn(
        "strong",
        (F.col("exact_matches") >= min_matches) & (F.col("exact_overlap_ratio") >= min_overlap)
        & F.col("evidence_start").isNotNull() & F.col("evidence_end").isNotNull(),
    ).select(*PAIR, "incoming_sessions", "existing_sessions", "exact_matches", "identity_matches",
             "exact_overlap_ratio", "evidence_start", "evidence_end", "risk_start", "risk_end", "strong")


def _with_others(fingerprints: DataFrame, existing: DataFrame) -> DataFrame:
    """Add `others`: how many other machines hold the fingerprint. Counted per fingerprint, not paired."""
    held = _fingerprints(existing).distinct()
    holders = held.groupBy("kind", "agent", "hash").agg(F.count(F.lit(1)).alias("holders"))
    return (
        fingerprints.join(holders, ["kind", "agent", "hash"])
        .join(held.withColumn("_own", F.lit(1)), ["kind", "agent", "hash", "machine_id"], "left")
        .withColumn("others", F.col("holders") - F.coalesce("_own", F.lit(0))).drop("holders", "_own")
        .filter("others > 0")
    )


def match_totals(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Exact and identity matches per machine over all other machines; machines without any are not listed.

    A fingerprint known to n machines adds n minus the machine itself.
    """
    counted = _with_others(_fingerprints(incoming).distinct(), existing)
    return counted.groupBy("machine_id").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "mirror", F.col("others"))), F.lit(0)).alias("exact_matches"),
        F.coalesce(F.sum(F.when(F.col("kind") == "identity", F.col("others"))), F.lit(0)).alias("identity_matches"),
    )


def _telling(classes: DataFrame, sizes: DataFrame, min_matches: int, min_overlap: float) -> DataFrame:
    """The classes of mirrors of each machine that must show a match with any strong partner at least as large.

    A strong partner shares t or more mirrors, so leaving out up to t - 1 of them
    loses no partner. Those held by most machines are left out. How many can go is
    read from a histogram of holder counts, so no machine's sessions meet in one task.
    """
    needed = F.greatest(F.lit(min_matches), F.ceil(F.col("sessions") * min_overlap - 1e-9))
    histogram = classes.groupBy("machine_id", "agent", "holders").agg(F.sum("n").alias("n")).join(sizes, ["machine_id", "agent"])
    from_top = Window.partitionBy("machine_id", "agent").orderBy(F.col("holders").desc())
    limits = histogram.withColumn("_dropped", F.sum("n").over(from_top)).groupBy("machine_id", "agent").agg(
        F.min(F.when(F.col("_dropped") <= needed - 1, F.col("holders"))).alias("_from"))
    return spread_join(classes, limits, ["machine_id", "agent"], ["class"]).filter(
        F.col("_from").isNull() | (F.col("holders") < F.col("_from"))).select("machine_id", "agent", "class")


def strong_mirrors(incoming: DataFrame, existing: DataFrame, min_matches: int = LIMITS.min_session_matches,
                   min_overlap: float = LIMITS.min_session_overlap) -> DataFrame:
    """The strong pairs of session_evidence, without forming the weak ones.

    Every pair is looked for and counted from its smaller side, over classes of mirrors with the same holders. The distinct
    fingerprints and their classes are read many times and are written once.
    """
    ours = materialized(incoming_fingerprints(incoming), "fingerprints")
    theirs = None if existing is incoming else materialized(_fingerprints(existing).distinct(), "fingerprints")
    classes = materialized(session_classes(ours.filter("kind = 'mirror'"), None if theirs is None else theirs.filter("kind = 'mirror'")), "classes")
    left, right = classes.filter("ours"), classes.filter("theirs")
    left_sizes, right_sizes = (
        side.filter("kind = 'identity'").groupBy("machine_id", "agent").agg(F.count(F.lit(1)).alias("sessions")) for side in (ours, ours if theirs is None else theirs))

    def other(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("machine_id", "other_machine_id")

    differ = F.col("machine_id") != F.col("other_machine_id")
    found = _telling(left, left_sizes, min_matches, min_overlap).join(other(right).select("agent", "class", "other_machine_id"), ["agent", "class"]).filter(differ).select(*PAIR)
    if theirs is None:
        # Both sides are one: what is found from the left is found from the right with the names exchanged.
        found = found.unionByName(found.select(F.col("other_machine_id").alias("machine_id"), F.col("machine_id").alias("other_machine_id"), "agent"))
    else:
        found = found.unionByName(other(_telling(right, right_sizes, min_matches, min_overlap)).join(
            left.select("agent", "class", "machine_id"), ["agent", "class"]).filter(differ).select(*PAIR))
    sized = materialized(
        found.distinct()
        .join(left_sizes.withColumnRenamed("sessions", "incoming_sessions"), ["machine_id", "agent"])
        .join(other(right_sizes).withColumnRenamed("sessions", "existing_sessions"), ["other_machine_id", "agent"]), "sized")
    held = other(right).select("agent", "class", "other_machine_id")
    counted = spread_join(left.select("machine_id", "agent", "class", "n", "starts", "ends"), sized, ["machine_id", "agent"], ["class"], "inner").join(
        held, ["other_machine_id", "agent", "class"])
    unknown = F.lit(None).cast("date")
    pairs = counted.groupBy(*PAIR, "incoming_sessions", "existing_sessions").agg(
        F.sum("n").alias("exact_matches"), F.min("starts").alias("evidence_start"), F.max("ends").alias("evidence_end"),
    ).withColumns({"identity_matches": F.lit(None).cast("bigint"), "_risk_start": unknown, "_risk_end": unknown})
    return rated(pairs, min_matches, min_overlap).filter("strong").select(
        *PAIR, "incoming_sessions", "existing_sessions", "exact_matches", "exact_overlap_ratio", "evidence_start", "evidence_end", "strong")


def _canonical(existing: DataFrame) -> DataFrame:
    rows = existing.filter(~F.col("is_tombstone"))
    if "global_duplicate" in existing.columns:
        rows = rows.filter(~F.col("global_duplicate"))
    return rows.select(F.col("machine_id").alias("other_machine_id"), F.col("id").alias("canonical_observation_id"),
                       "agent", "usage_date", *FIVE_COUNTERS)


def exact_daily_holders(daily: DataFrame) -> DataFrame:
    """For each row, how many other machines hold an equal row for the same agent and day.

    The exact match itself as a count: equal rows are grouped, not paired.
    """
    value = ["agent", "usage_date", *FIVE_COUNTERS]
    live = _canonical(daily)
    holders = live.groupBy(*value).agg(
        F.count(F.lit(1)).alias("holders"), F.min("other_machine_id").alias("first_machine_id"))
    return holders.filter("holders > 1")


def choose_links(incoming: DataFrame, existing: DataFrame, evidence: DataFrame,
                 raw_matches: DataFrame | None = None) -> DataFrame:
    """At most one canonical row per incoming row. `evidence` is strong_mirrors or session_evidence.

    A machine with the same raw file comes first; then the strongest evidence
    whose window covers the day and whose machine holds an equal row. Ties go to
    the lowest machine id.
    """
    value = ["agent", "usage_date", *FIVE_COUNTERS]
    rows = incoming.filter(~F.col("is_tombstone")).select("machine_id", *value)
    strong = evidence.filter("strong").select(
        *PAIR, "exact_matches", "exact_overlap_ratio", "evidence_start", "evidence_end")
    covered = spread_join(rows, strong, ["machine_id", "agent"], ["usage_date"], "inner").filter(
        F.col("usage_date").between(F.col("evidence_start"), F.col("evidence_end")))
    candidates = covered.withColumns({
        "reason": F.lit("exact_daily_with_session_evidence"), "_priority": F.lit(1)})
    if raw_matches is not None:
        same_file = raw_matches.select("machine_id", "other_machine_id").distinct()
        from_raw = spread_join(rows, same_file, ["machine_id"], ["usage_date", "agent"], "inner").withColumns({
            "exact_matches": F.lit(0).cast("bigint"), "exact_overlap_ratio": F.lit(1.0),
            "evidence_start": F.lit(None).cast("date"), "evidence_end": F.lit(None).cast("date"),
            "reason": F.lit("exact_raw_snapshot"), "_priority": F.lit(0)})
        candidates = from_raw.unionByName(candidates)
    equal = candidates.join(_canonical(existing), ["other_machine_id", *value])
    best = Window.partitionBy(*ROW_KEY).orderBy(
        "_priority", F.col("exact_matches").desc(), F.col("exact_overlap_ratio").desc(), "other_machine_id")
    return (
        equal.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")
        .select(
            *ROW_KEY, "canonical_observation_id", F.col("other_machine_id").alias("canonical_machine_id"), "reason",
            F.col("exact_matches").alias("matched_session_count"),
            F.col("exact_overlap_ratio").alias("session_overlap_ratio"),
            F.struct("evidence_start", "evidence_end",
                     (F.col("reason") == "exact_raw_snapshot").alias("raw_snapshot_match")).alias("evidence"),
            "reported_total_tokens",
        )
    )


def days_in_windows(days: DataFrame, windows: DataFrame) -> DataFrame:
    """The days (machine_id, agent, usage_date) that lie in some window (machine_id, agent, risk_start, risk_end).

    Windows are dealt over the months they touch, so a day meets the windows of its month only. A window without a start or
    an end holds every day of its machine and agent.
    """
    side = ["machine_id", "agent"]
    month = F.trunc("usage_date", "month").alias("_month")
    closed = windows.filter("risk_start IS NOT NULL AND risk_end IS NOT NULL")
    dealt = closed.withColumn("_month", F.explode(F.sequence(F.trunc("risk_start", "month"), F.trunc("risk_end", "month"), F.expr("interval 1 month"))))
    dated = days.withColumn("_month", month)
    inside = dated.join(dealt.select(F.col("machine_id").alias("_m"), F.col("agent").alias("_a"), F.col("_month").alias("_of"), "risk_start", "risk_end"),
                        (F.col("machine_id") == F.col("_m")) & (F.col("agent") == F.col("_a")) & (F.col("_month") == F.col("_of"))
                        & F.col("usage_date").between(F.col("risk_start"), F.col("risk_end")), "left_semi").drop("_month")
    open_ = windows.filter("risk_start IS NULL OR risk_end IS NULL").select(*side).distinct()
    return inside.unionByName(days.join(open_, side, "left_semi")).distinct()


def partial_mirror_risk(rows: DataFrame, links: DataFrame, incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Per machine: is there an unlinked row whose day lies in a window of sessions shared with one other machine?

    The days of a single shared session settle most machines. Pairs are formed
    only for machines and agents left open: a row between two shared sessions
    counts if the same other machine holds both.
    """
    side = ["machine_id", "agent"]
    live = rows.filter(~F.col("is_tombstone")).select(*ROW_KEY).distinct()
    free = materialized(live.join(links.select(*ROW_KEY).distinct(), ROW_KEY, "left_anti"), "unlinked")
    shared = materialized(_with_others(incoming_fingerprints(incoming).filter("kind = 'identity'"), existing), "shared")
    dated = shared.filter("starts is not null and ends is not null").select(
        *side, F.col("starts").alias("risk_start"), F.col("ends").alias("risk_end"))
    sure = days_in_windows(free, merged_windows(dated)).select(*side).distinct()
    spans = shared.groupBy(*side).agg(
        F.min("starts").alias("_first"), F.max("ends").alias("_last"),
        F.bool_or(F.col("starts").isNull() | F.col("ends").isNull()).alias("_undated"))
    possible = F.col("_undated") | F.col("usage_date").between(F.col("_first"), F.col("_last"))
    undecided = materialized(spread_join(free.join(sure, side, "left_anti"), spans, side, ["usage_date"], "inner").filter(possible).select(*ROW_KEY), "undecided")
    pairs = session_evidence(incoming.join(undecided.select(*side).distinct(), side, "left_semi"), existing)
    risky = sure.unionByName(days_in_windows(undecided, merged_windows(pairs)).select(*side)).select("machine_id").distinct()
    return live.select("machine_id").distinct().join(risky.withColumn("_risk", F.lit(True)), "machine_id", "left").select(
        "machine_id", F.coalesce("_risk", F.lit(False)).alias("partial_mirror_risk"))


def merged_windows(evidence: DataFrame) -> DataFrame:
    """Risk windows as disjoint stretches per machine and agent; an open window stays open."""
    per_start = evidence.groupBy("machine_id", "agent", "risk_start").agg(
        F.max("risk_end").alias("risk_end"), F.bool_or(F.col("risk_end").isNull()).alias("_open"))
    ends = F.max("risk_end").over(
        Window.partitionBy("machine_id", "agent").orderBy("risk_start").rowsBetween(Window.unboundedPreceding, -1))
    marked = per_start.withColumn(
        "_new", F.when(F.col("risk_start").isNull() | ends.isNull() | (F.col("risk_start") > ends), 1).otherwise(0))
    grouped = marked.withColumn(
        "_stretch", F.sum("_new").over(Window.partitionBy("machine_id", "agent").orderBy(F.col("risk_start").asc_nulls_first())))
    return grouped.groupBy("machine_id", "agent", "_stretch").agg(
        F.min("risk_start").alias("risk_start"),
        F.when(F.bool_or("_open"), F.lit(None)).otherwise(F.max("risk_end")).alias("risk_end"),
    ).drop("_stretch")


def tokens_prevented(links: DataFrame, incoming: DataFrame, suppressed: DataFrame | None = None,
                     written: DataFrame | None = None) -> DataFrame:
    """Tokens each machine's links keep out of the totals.

    With `suppressed` (rows already hidden) and `written` (rows this import
    writes), a row that was hidden before and is not written again is not counted twice.
    """
    linked = links.select(*ROW_KEY)
    if suppressed is not None:
        again = suppressed.select(*ROW_KEY)
        if written is not None:
            fresh = written.filter(~F.col("is_tombstone")).select(*ROW_KEY)
            again = again.join(fresh, ROW_KEY, "left_anti")
        linked = linked.join(again, ROW_KEY, "left_anti")
    counted = incoming.filter(~F.col("is_tombstone")).join(linked, ROW_KEY, "left_semi")
    return counted.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("rows_suppressed"),
        F.sum("reported_total_tokens").alias("duplicate_tokens_prevented"))


def validate_links(links: DataFrame, current: DataFrame, observations: DataFrame) -> DataFrame:
    """Links that hold against the stored rows: other machine, same key, equal counters, no tombstone."""
    own = current.select(F.col("id").alias("observation_id"), *ROW_KEY, *FIVE_COUNTERS)
    canonical = observations.filter(~F.col("is_tombstone")).select(
        F.col("id").alias("canonical_observation_id"), F.col("machine_id").alias("canonical_machine_id"),
        "agent", "usage_date", *FIVE_COUNTERS)
    proposed = links.select(*ROW_KEY, "canonical_observation_id", "canonical_machine_id", "reason",
                            "matched_session_count", "session_overlap_ratio")
    return (
        proposed.join(own, ROW_KEY)
        .join(canonical, ["canonical_observation_id", "canonical_machine_id", "agent", "usage_date", *FIVE_COUNTERS])
        .filter(F.col("canonical_machine_id") != F.col("machine_id"))
        .select("observation_id", "canonical_observation_id", "canonical_machine_id", "reason",
                "matched_session_count", "session_overlap_ratio")
    )


def match_flags(totals: DataFrame, strong: DataFrame, raw_matches: DataFrame | None = None) -> DataFrame:
    """Per machine: did anything match another machine, and which mirrors are strong.

    `totals` is match_totals, `strong` is strong_mirrors.
    """
    matched = totals.filter("exact_matches > 0 or identity_matches > 0").select("machine_id")
    if raw_matches is not None:
        matched = matched.union(raw_matches.filter(F.col("other_machine_id").isNotNull()).select("machine_id"))
    mirror = F.struct("other_machine_id", "agent", "exact_matches", "exact_overlap_ratio", "evidence_start", "evidence_end")
    listed = strong.groupBy("machine_id").agg(F.array_sort(F.collect_list(mirror)).alias("strong_mirrors"))
    return matched.distinct().join(listed, "machine_id", "left").withColumn("cross_machine_match", F.lit(True))
