"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of the languages at hand.
STOP_WORDS = tuple(sorted(set((
    "the of and to in a is that it for on was be with as by at or from are this an "
    "de la que el en y los del se las por un para con no una su al lo es "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le et les des est une du dans qui pour au sur pas plus par ce il sont elle"
).split())))


class Rule(NamedTuple):
    """A ratio, per 100 of its base, and the bounds it must keep (None: open)."""

    name: str
    counted: str
    base: str
    least: int | None
    most: int | None


#: counted and base name the counts of `measured`; a rule reads least * base <= 100 * counted <= most * base.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_kinds", "n_stop_listed", 2, None),
    Rule("exclamations", "n_exclamations", "n_words", None, 30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)
LEAST_WORDS, MOST_REPEATED = 50, 50


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules use. No shuffle: each count is an expression on the row's own arrays.

    Words in repeated 3-word windows are found by sorting the windows' hashes with their places;
    windows with equal neighbours are the repeated ones. Rows without a repeated window skip the sort.
    """
    words = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), 0))
    hashes = words.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))")).withColumn("_n", F.size("_words"))
    pairs = hashes.withColumn("_pairs", F.expr("CASE WHEN _n > 2 THEN zip_with(slice(_hashes, 1, _n - 2), slice(_hashes, 2, _n - 2), (a, b) -> xxhash64(a, b)) END"))
    windows = pairs.withColumn("_windows", F.expr(
        "CASE WHEN _n > 2 THEN zip_with(_pairs, slice(_hashes, 3, _n - 2), (p, c) -> xxhash64(p, c)) ELSE cast(array() AS array<bigint>) END"))
    lines = windows.withColumn("_lines", F.expr(r"filter(split(_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    ordered = lines.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(arrays_zip(_windows, sequence(0, size(_windows) - 1))) END"))
    places = ordered.withColumn("_places", F.expr(
        "sort_array(array_distinct(flatten(transform(filter(arrays_zip(slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted) - 1)),"
        " p -> p['0']['_windows'] = p['1']['_windows']), p -> array(p['0']['1'], p['1']['1'])))))"))
    repeated = F.expr("aggregate(arrays_zip(_places, slice(_places, 2, size(_places))), 0L, (n, p) -> n + least(3, coalesce(p['1'] - p['_places'], 3)))")
    return places.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_intersect("_words", F.array(*[F.lit(w) for w in STOP_WORDS]))).cast("long").alias("n_stop_kinds"),
        F.lit(len(STOP_WORDS)).cast("long").alias("n_stop_listed"),
        _removed(F.col("_text"), "!").alias("n_exclamations"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A boolean column per rule: whether it holds. A ratio over no base holds."""
    out = []
    for r in rules:
        counted, base = F.col(r.counted) * 100, F.col(r.base)
        holds = F.lit(True)
        if r.least is not None:
            holds &= counted >= base * r.least
        if r.most is not None:
            holds &= counted <= base * r.most
        out.append(holds.alias("ok_" + r.name))
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Documents with their counts, one verdict per rule, base_failed and kept.

    Null and empty texts have no words and fail. Every input row gives one row; other
    columns pass through, except those named as a count or verdict, which are replaced, and
    those that begin with an underscore, which are left out. An empty table gives no rows.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_kinds", "n_stop_listed", "n_exclamations", "n_bullet_lines",
            "n_ellipsis_lines", "base_failed", "kept"} | {"ok_" + r.name for r in rules}
    docs = docs.select(*[c for c in docs.columns if c not in made and not c.startswith("_")])
    counts = measured(docs, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    checked = counts.select("*", *compiled(rules), failed.alias("base_failed"))
    kept = ~F.col("base_failed")
    for r in rules:
        kept &= F.col("ok_" + r.name)
    return checked.withColumn("kept", kept)
