"""Quality rules as learned decision lists.

``stats`` measures every text with built-in functions; ``learn`` grows and
prunes threshold conjunctions by sequential covering on labelled statistics;
``verdict`` turns the ordered list into one conditional expression.

Learning: literals are ``feature <= cut`` and ``feature >= cut`` at sample
quantiles.  A rule for bad texts is grown literal by literal by information
gain on the growing part, its tail is pruned on the held-back part, and it is
accepted only if it is precise there; covered rows leave and the next rule is
sought.  What no rule covers is kept.  The sample is bounded by ``MAX_LABELLED``
rows (those with the smallest hash of their id); row sets are Python integers
used as bit sets.

Defined results: a null or empty text has no words and fails the base rule;
labels of one id that disagree count by their mean (0.5 and more is good), null
ids and null labels are not used; without usable labels the list is empty and
only the base rule decides.  Extra columns pass through ``with_stats`` untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.native import bind, empty

#: documented bound of the labelled sample that the list is fitted on
MAX_LABELLED = 20_000

FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share",
            "upper_share", "punct_share", "distinct_share")
WINDOW = 5


def _covered(grams: Column) -> Column:
    """Words inside windows whose gram occurs twice or more in the text."""
    def repeated(rows: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(rows, lambda x, i: (
                ((i > 0) & (F.get(rows, i - 1)["g"] == x["g"]))
                | ((i < F.size(rows) - 1) & (F.get(rows, i + 1)["g"] == x["g"])))),
            lambda x: x["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"),
                                  (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
            lambda a: a["n"])
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return total(bind(ordered, repeated))


def with_stats(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct ``out`` of counts and shares of each text."""
    body = F.coalesce(F.col("_row")[text], F.lit(""))
    blank = r"[^\x20\x09-\x0D]"

    def chars(pattern: str) -> Column:
        return F.length("_body") - F.length(F.regexp_replace("_body", pattern, ""))

    def gram(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    rows = (docs.select(F.struct("*").alias("_row"))
            .select("_row", body.alias("_body"))
            .select("_row", "_body",
                    F.regexp_extract_all("_body", F.lit(blank + "+"), F.lit(0)).alias("_words"),
                    F.filter(F.split("_body", "\n"), lambda x: x.rlike(blank)).alias("_lines"))
            .select("_row", "_body", "_words", "_lines",
                    F.when(F.size("_words") >= WINDOW,
                           F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW),
                                       lambda i: gram(F.col("_words"), i)))
                    .otherwise(empty("bigint")).alias("_grams")))
    counted = rows.select(
        "_row", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        chars(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), F.lit(0))
        .otherwise(_covered(F.col("_grams"))).cast("long").alias("n_repeat_words"),
        chars(r"\p{Lu}+").cast("long").alias("n_upper"),
        chars(r"""[!"'(),./:;?@\[\]_`{}~-]+""").cast("long").alias("n_punct"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    shares = counted.withColumns({
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "punct_share": share("n_punct", "word_chars"),
        "distinct_share": share("n_distinct", "n_words")})
    inner = [c for c in shares.columns if c != "_row"]
    return shares.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != out],
                         F.struct(*inner).alias(out))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.cut:g}"

    def column(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value >= self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals)) + " -> drop"

    def column(self, stats: Column) -> Column:
        out = self.literals[0].column(stats)
        for literal in self.literals[1:]:
            out = out & literal.column(stats)
        return out


def _bits(flags) -> int:
    """The bit set of the true positions (row 0 is the lowest bit)."""
    return int("".join("1" if f else "0" for f in flags)[::-1], 2)


def _literals(rows: list[dict], cuts: int) -> dict[Literal, int]:
    """Each literal with the bit set of the rows it holds for."""
    sets: dict[Literal, int] = {}
    for f in FEATURES:
        values = [float(r[f]) for r in rows]
        distinct = sorted(set(values))
        ranked = sorted(values)
        marks = {ranked[min(len(ranked) - 1, k * len(ranked) // cuts)] for k in range(cuts + 1)}
        marks |= set(distinct[:2] + distinct[-2:])
        for cut in sorted(marks):
            sets[Literal(f, True, cut)] = _bits(v >= cut for v in values)
            sets[Literal(f, False, cut)] = _bits(v <= cut for v in values)
    return sets


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p1, n1)."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def learn(rows: list[dict], cuts: int = 24, most_literals: int = 3, most_rules: int = 16,
          precision: float = 0.95, least_share: float = 0.002) -> list[Rule]:
    """Sequential covering over ``rows`` (features, ``good`` and ``grow``)."""
    if not rows:
        return []
    sets = _literals(rows, cuts)
    bad, grow = _bits(not r["good"] for r in rows), _bits(r["grow"] for r in rows)
    everything = (1 << len(rows)) - 1
    left, rules = everything, []
    least = max(3, math.ceil(least_share * bad.bit_count()))

    def covered(literals, within: int) -> int:
        for literal in literals:
            within &= sets[literal]
        return within

    while len(rules) < most_rules:
        cover, literals = left & grow, []
        while len(literals) < most_literals and cover & ~bad & everything:
            p0, n0 = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            if not p0:
                break
            best = max(sets, key=lambda x: (_gain(
                p0, n0, (cover & sets[x] & bad).bit_count(), (cover & sets[x] & ~bad).bit_count()),
                str(x)))
            if (cover & sets[best]) == cover:
                break
            cover &= sets[best]
            literals.append(best)
        if not literals:
            break

        def worth(k: int) -> tuple[float, int]:
            c = covered(literals[:k], left & ~grow)
            p, n = (c & bad).bit_count(), (c & ~bad).bit_count()
            return ((p - n) / (p + n) if p + n else -1.0, -k)
        rule = Rule(tuple(literals[:max(range(1, len(literals) + 1), key=worth)]))
        hit = covered(rule.literals, left)
        held = hit & ~grow
        p, n = (hit & bad).bit_count(), (hit & ~bad).bit_count()
        hp, hn = (held & bad).bit_count(), (held & ~bad).bit_count()
        if p < least or p < precision * (p + n) or hp < precision * (hp + hn):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_sample(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    most: int = MAX_LABELLED) -> list[dict]:
    """At most ``most`` labelled rows that pass the base rule, picked by the
    hash of their id."""
    marks = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg((F.avg("quality") >= 0.5).alias("good")))
    found = marks.count()
    if found > most:    # about ``most`` of them, so that no task sends more
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < (most << 20) // found)
    rows = (measured.where(~base_failed(F.col("stats"))).join(marks, F.col(id_col) == F.col("_id"))
            .select(*[F.col("stats")[f].alias(f) for f in FEATURES], "good",
                    F.xxhash64("_id").alias("pick"), F.col("_id").alias("id"))
            .orderBy("pick", "id", *FEATURES).limit(most))
    return [{**r.asDict(), "grow": r["pick"] % 3 != 0} for r in rows.collect()]


def verdict(stats: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """``(kept, rule)``: the conditional expression of the ordered list, and
    the number of the rule that dropped the row (null if none)."""
    kept, which = F.when(base_failed(stats), False), F.when(base_failed(stats), 0)
    for k, rule in enumerate(rules, 1):
        kept, which = kept.when(rule.column(stats), False), which.when(rule.column(stats), k)
    return kept.otherwise(True), which
