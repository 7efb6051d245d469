"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds choose.

Built-in functions only, in finding and in scoring. The trees are fitted on counts of
feature values over all proposed spans, a table bounded by the features' ranges, and
compiled into one expression per tree.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.session import materialized

KINDS = ("email", "ip", "card", "phone", "secret")
#: Patterns of the certain kinds. A match can begin only where a run begins or the match before ended; the rest is possessive,
#: so long runs cost no more than their length and match as the plain patterns do.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further spans: what a little less strict a reader might take for one.
PROPOSED = {
    "email": r"(?:(?<![^\s@<>\"'(),;:])|\G)(?:[^\s@<>\"'(),;:\[{]|[\[{](?!(?:at|AT)[\])}]))++(?:@|\s?[\[({](?:at|AT)[\])}]\s?)"
             r"(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[^\s@<>\"'(),;:]++)",
    "number": r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9])++",
    "secret": r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_.=-]{6,}[\"']?",
}
#: Forms of spans that count as right where no certain kind says so: an address with a written-out sign and a domain.
WRITTEN_AT = r"^[A-Za-z0-9._%+-]++\s?[\[({](?:at|AT)[\])}]\s?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}$"
#: What directly before a number of 8 to 15 digits makes it a phone number, unless it reads as a date or time.
CALLED = r"\b(?:tel|telephone|phone|call|mobile|cell|fax)\b(?:[^a-z0-9]|\b(?:number|no|me|us|him|her|them|at|on|is|or|now|today)\b)*$"
DATED = r"[:/]|^(?:19|20)[0-9]{2}[-.\x20][0-9]{2}[-.\x20][0-9]{2}|^[0-9]{1,2}[-.\x20][0-9]{1,2}[-.\x20](?:19|20)[0-9]{2}$"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def found(text: str, pattern: str, needs: Column) -> Column:
    """All matches of a pattern in column `text`, leftmost and without overlap: array of start, end (code points) and match."""
    regex = F.lit(pattern)
    matches, gaps = F.regexp_extract_all(text, regex, 0), F.split(text, pattern, -1)
    empty = F.expr("cast(array() AS array<struct<start: int, stop: int, match: string>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        stop = begin + F.length(pair["match"])
        return F.struct(stop.alias("at"), F.array_append(acc["spans"], F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("stop"), pair["match"].alias("match"))).alias("spans"))

    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    spans = F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), start, add, lambda acc: acc["spans"])
    return F.when(needs, spans).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    def worth(place):
        d = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        return F.when(place % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(places, F.lit(0), lambda total, place: total + F.coalesce(worth(place), F.lit(0))) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def certain(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `_email`, `_ip`, `_card` and `_phone`: the spans of the certain kinds in each text. Null text has none."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    digit = F.col("_text").rlike("[0-9]")
    rows = rows.withColumn("_digit", digit).select(
        "*", found("_text", EMAIL, F.col("_text").contains("@")).alias("_email"), found("_text", IP, F.col("_digit") & F.col("_text").contains(".")).alias("_ip0"),
        found("_text", CARD, F.col("_digit")).alias("_card0"), found("_text", PHONE, F.col("_digit") & F.col("_text").contains("+")).alias("_phone0"))
    return rows.select(
        *docs.columns, "_text", "_digit", "_email",
        F.filter("_ip0", lambda s: s["match"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).alias("_ip"),
        F.filter("_card0", lambda s: F.length(_digits(s["match"])).between(16, 19) & luhn(_digits(F.substring(s["match"], 1, 60)))).alias("_card"),
        F.filter("_phone0", lambda s: F.length(_digits(s["match"])).between(8, 15)).alias("_phone"))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


#: Features of a proposed span and how many values each has, from 0.
FEATURES = {"generator": 3, "digits": 6, "plus": 2, "dots": 5, "luhn": 2, "octets": 2, "gaps": 4, "domain": 2, "long": 4, "before": 7, "dated": 2}
#: Words that may stand before a span, by value of the feature `before`; 0 is none.
CONTEXT = (r"e-?mail|mailto|contact", r"tel|phone|call|mobile|fax", r"card|visa|credit|payment", r"\bip\b|host|server|addr", r"password|passwd|pwd", r"token|secret|key")


def proposed(rows: DataFrame) -> DataFrame:
    """One row per proposed span of `certain` rows: row key (128 bits of the text), text positions, features and `label`, whether it is a certain span.

    A secret counts as certain when its value mixes letters and digits, an address with a written-out sign when a domain
    follows, and a number of 8 to 15 digits that is no date when a word for phones stands directly before it.
    """
    might = F.col("_text").rlike(r"(?i)password|passwd|pwd|token|secret|api[_-]?key")
    offered = lambda k, name, needs: F.transform(found("_text", PROPOSED[name], needs), lambda s: F.struct(
        F.lit(k).alias("generator"), s["start"].alias("start"), s["stop"].alias("stop"), s["match"].alias("match")))
    spans = F.concat(offered(0, "email", F.col("_text").rlike(r"@|[\[({](?:at|AT)[\])}]")), offered(1, "number", F.col("_digit")), offered(2, "secret", might))
    known = F.concat(*[_named(k, F.col("_" + k)) for k in KINDS[:4]])
    all_ = rows.select("_row", "_text", known.alias("_known"), spans.alias("_spans"))
    one = all_.select("_row", "_known", F.explode(F.transform("_spans", lambda s: F.struct(
        s.alias("s"), F.substring(F.col("_text"), F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("left")))).alias("x"))
    one = one.select("_row", "_known", F.col("x.s.generator").alias("generator"), F.col("x.s.start").alias("start"), F.col("x.s.stop").alias("stop"), F.col("x.s.match").alias("match"), F.lower("x.left").alias("left"))
    n = F.length(_digits(F.col("match")))
    before = F.lit(0)
    for k, words in reversed(list(enumerate(CONTEXT, 1))):
        before = F.when(F.col("left").rlike(words), k).otherwise(before)
    before = F.when(F.col("left").rlike(CALLED), 2).otherwise(before)
    number = F.col("generator") == 1
    long_ = F.length("match")
    made = one.withColumn("n", n).select(
        "_row", "start", "stop", "generator", F.col("n").alias("n"),
        F.when(F.col("n") == 0, 0).when(F.col("n") < 8, 1).when(F.col("n") < 13, 2).when(F.col("n") < 16, 3).when(F.col("n") < 20, 4).otherwise(5).alias("digits"),
        F.col("match").startswith("+").cast("int").alias("plus"), F.least(F.lit(4), long_ - F.length(F.replace("match", F.lit("."), F.lit("")))).cast("int").alias("dots"),
        (number & F.col("n").between(13, 19) & luhn(_digits(F.substring("match", 1, 60)))).cast("int").alias("luhn"),
        F.col("match").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$").cast("int").alias("octets"),
        F.least(F.lit(3), long_ - F.length(F.regexp_replace("match", r"[\x20()-]", ""))).cast("int").alias("gaps"),
        F.col("match").rlike(r"(?:@|[\])}]\s?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$").cast("int").alias("domain"),
        F.when(long_ < 8, 0).when(long_ < 16, 1).when(long_ < 32, 2).otherwise(3).alias("long"), before.alias("before"),
        (number & F.col("match").rlike(DATED)).cast("int").alias("dated"),
        (F.exists("_known", lambda k: (k["start"] == F.col("start")) & (k["stop"] == F.col("stop")))
         | (F.col("generator") == 0) & F.col("match").rlike(WRITTEN_AT)
         | number & F.col("n").between(8, 15) & F.col("left").rlike(CALLED) & ~F.col("match").rlike(DATED) & ~F.col("match").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
         | (F.col("generator") == 2) & F.col("match").rlike(r"[=:].*[0-9]") & F.col("match").rlike("[=:].*[A-Za-z]")).alias("label"))
    return made


class Tree(NamedTuple):
    """A tree of depth 2: (feature, least value of the right side) at the root and on either side, and four leaf values."""

    splits: tuple[tuple[str, int], tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def leaf(self, cell: dict[str, int]) -> float:
        right = cell[self.splits[0][0]] >= self.splits[0][1]
        name, least = self.splits[1 + right]
        return self.leaves[2 * right + (cell[name] >= least)]

    def expression(self) -> Column:
        side = lambda k, a, b: F.when(F.col(self.splits[k][0]) >= self.splits[k][1], F.lit(b)).otherwise(F.lit(a))
        return F.when(F.col(self.splits[0][0]) >= self.splits[0][1], side(2, *self.leaves[2:])).otherwise(side(1, *self.leaves[:2]))


def boosted(cells: list[dict], trees: int = 24, rate: float = 0.4, ridge: float = 1.0) -> list[Tree]:
    """Gradient boosting of the log odds over cells: feature values with their positive and negative counts."""
    out: list[Tree] = []
    margin = [0.0] * len(cells)
    cuts = [(f, v) for f, n in FEATURES.items() for v in range(1, n)]

    def best(members: list[int], grad: list[float], hess: list[float]) -> tuple[tuple[str, int], float, list[int], list[int]]:
        g, h = sum(grad[k] for k in members), sum(hess[k] for k in members)
        found = (cuts[0], 0.0)
        for f, v in cuts:
            right = [k for k in members if cells[k][f] >= v]
            a, b = sum(grad[k] for k in right), sum(hess[k] for k in right)
            gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
            if gain > found[1] + 1e-9:
                found = ((f, v), gain)
        f, v = found[0]
        return *found, [k for k in members if cells[k][f] < v], [k for k in members if cells[k][f] >= v]

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [c["yes"] - q * (c["yes"] + c["no"]) for c, q in zip(cells, p)]
        hess = [q * (1 - q) * (c["yes"] + c["no"]) for c, q in zip(cells, p)]
        root, gain, low, high = best(list(range(len(cells))), grad, hess)
        if gain <= 0:
            break
        (a, _, ll, lr), (b, _, rl, rr) = best(low, grad, hess), best(high, grad, hess)
        value = lambda s: rate * sum(grad[k] for k in s) / (sum(hess[k] for k in s) + ridge)
        tree = Tree((root, a, b), (value(ll), value(lr), value(rl), value(rr)))
        out.append(tree)
        margin = [m + tree.leaf(c) for m, c in zip(margin, cells)]
    return out


def kind_of(cell: dict[str, int]) -> int:
    """The kind that a proposed span of these feature values would have."""
    if cell["generator"] != 1:
        return 0 if cell["generator"] == 0 else 4
    if cell["octets"]:
        return 1
    called = cell["before"] == 2 and cell["digits"] in (2, 3) and not cell["dated"]
    return 2 if cell["luhn"] and not called else 3


def threshold(cells: list[dict], trees: list[Tree], precision: float) -> float:
    """The least margin above which spans of rows kept apart are right in at least this share; infinite if none is."""
    scored = sorted(((sum(t.leaf(c) for t in trees), c["apart_yes"], c["apart_no"]) for c in cells), reverse=True)
    yes = no = 0
    best = math.inf
    for k, (margin, a, b) in enumerate(scored):
        yes, no = yes + a, no + b
        last = k + 1 == len(scored) or scored[k + 1][0] < margin
        if last and yes and yes >= precision * (yes + no):
            best = margin
    return best


def admitted(cells: list[dict], trees: list[Tree], precision: float) -> dict[int, tuple[float, list[int]]]:
    """By kind: the threshold of its own spans, and the codes of its cells that hold a right span; no other cell is open to it."""
    out = {}
    for kind in range(len(KINDS)):
        own = [c for c in cells if kind_of(c) == kind and c["yes"] + c["apart_yes"]]
        least = threshold(own, trees, precision) if trees else math.inf
        if math.isfinite(least):
            out[kind] = (least, [code(c) for c in own])
    return out


def code(cell):
    """One number for all feature values of a cell, of a dictionary as of columns."""
    total = 0
    for f, n in FEATURES.items():
        total = total * n + cell[f]
    return total


def personal_spans(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """For documents (doc_id, text): doc_id, text, `known` and `spans`, arrays of kind (number in KINDS), start and stop.

    `known` are the certain spans; `spans` adds those proposed spans whose score reaches
    the threshold calibrated for their kind, whose feature values some right span has, and that overlap no certain one, one of several that overlap
    each other. Every row gives one row; null text has no spans; other columns are not read.
    Half of the rows, by hash of their text, fit the trees, the other half sets the threshold.
    """
    rows = certain(docs.select("doc_id", "text"))
    rows = rows.withColumn("_row", F.concat_ws(":", F.hex(F.xxhash64("_text")), F.hex(F.xxhash64(F.lit("row"), F.col("_text")))))
    known = F.sort_array(F.concat(*[_named(k, F.col("_" + k)) for k in KINDS[:4]]))
    rows = rows.withColumn("_known", known)
    offers = proposed(rows.filter(F.col("_digit") | F.col("_text").contains("@") | F.col("_text").rlike(r"(?i)password|passwd|pwd|token|secret|api[_-]?key")))
    offers = offers.withColumn("apart", F.pmod(F.xxhash64("_row"), F.lit(2)) == 1)
    offers = materialized(offers, "offers")
    count = lambda when: F.sum(F.when(when, 1).otherwise(0))
    cells = [r.asDict() for r in offers.groupBy(*FEATURES).agg(
        count(F.col("label") & ~F.col("apart")).alias("yes"), count(~F.col("label") & ~F.col("apart")).alias("no"),
        count(F.col("label") & F.col("apart")).alias("apart_yes"), count(~F.col("label") & F.col("apart")).alias("apart_no")).collect()]
    cells.sort(key=lambda c: tuple(c[f] for f in FEATURES))
    trees = boosted(cells)
    margin = F.lit(0.0)
    for t in trees:
        margin = margin + t.expression()
    kind = F.lit(None).cast("int")
    for k, (least, codes) in admitted(cells, trees, precision).items():
        # Python's sum may round otherwise than Spark's.
        kind = F.when((margin >= least - 1e-9) & code({f: F.col(f).cast("long") for f in FEATURES}).isin(codes), k).otherwise(kind)
    chosen = offers.withColumn("kind", kind).filter("kind IS NOT NULL").select("_row", F.struct("kind", "start", "stop").alias("s"))
    more = materialized(chosen.groupBy("_row").agg(F.sort_array(F.collect_set("s")).alias("_more")).withColumnRenamed("_row", "_of"), "chosen")
    joined = rows.select("doc_id", "_row", "_known").join(more, F.col("_row") == F.col("_of"), "left")
    apart = lambda a, b: (a["stop"] <= b["start"]) | (b["stop"] <= a["start"])
    free = F.filter(F.coalesce("_more", F.expr("cast(array() AS array<struct<kind: int, start: int, stop: int>>)")), lambda m: ~F.exists("_known", lambda k: ~apart(m, k)))
    empty = F.expr("cast(array() AS array<struct<kind: int, start: int, stop: int>>)")
    own = F.aggregate(free, empty, lambda acc, m: F.when(F.exists(acc, lambda k: ~apart(m, k)), acc).otherwise(F.array_append(acc, m)))
    return joined.select("doc_id", F.col("_known").alias("known"), F.sort_array(F.concat("_known", own)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of spans, by kind as listed, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """A text with each of its spans, which don't overlap, replaced by its kind in square brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def add(acc, s):
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out")))
    return F.aggregate(ordered, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
