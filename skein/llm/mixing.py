"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes are word counts; sources are ranked in code-point order (null last) and
   weigh 5, 2, 1 and so on.  Targets share ``SHARE`` of all words by weight; none
   exceeds twice its source: what is over is shared out again.  All exact: sums of
   integers on Spark, fractions on the driver, one row of totals a round.
2. A source takes whole copies of itself as often as its target allows; the
   remaining budget is fitted with single documents.  Its documents are counted
   by exact length, and per length the same share (rounded down) is taken.
3. What rounding left over is fitted by a bounded-knapsack dynamic programme over
   the lengths still to be had: single documents in seeded order until at most
   ``WIDTH`` words are left, then the sum nearest to the rest (below or above).
   Sources of up to ``WIDTH`` words of remaining budget are fitted by the programme
   alone, that is as near as whole documents can come.
4. As many documents of each length as the programme says are selected, in the
   order of a seeded hash: whole hash buckets first, then the border bucket's
   documents, repeated rows by their place.  No group of equal documents is ranked
   in one task.

Defined results: null and blank texts have size 0 and take 0; null sources are one
source, the last; null ids and repeated rows count as rows; ties go by the seeded
hash; an empty table gives no rows; other columns are kept out.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skein.llm.jaccard import small_side
from skein.session import write_shared

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
SEED = 1729
#: words that the dynamic programme fits at once
WIDTH = 1 << 15
#: hash buckets of one source and length
BUCKETS = 4096
#: sources ranked in one part
_PART = 200_000


# --- targets -----------------------------------------------------------------------

def ranked_sources(sizes: DataFrame, part: int = _PART) -> DataFrame:
    """``source, size, rank``: ranks from 0 by code point, null last."""
    named = sizes.where("source is not null")
    n = named.count()
    named = (named.repartitionByRange(-(-n // part), "source") if n > part else named)
    named = write_shared(named.withColumn("part", F.spark_partition_id() if n > part else F.lit(0)), "sources")
    before, base = 0, {}
    for r in sorted(named.groupBy("part").count().collect(), key=lambda r: r["part"]):
        base[r["part"]] = before
        before += r["count"]
    starts = F.create_map(*[F.lit(v).cast("long") for kv in (base or {0: 0}).items() for v in kv])
    within = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    return (named.select("source", "size", (F.element_at(starts, F.col("part").cast("long")) + within - 1).alias("rank"))
            .unionByName(sizes.where("source is null").withColumn("rank", F.lit(before).cast("long"))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """``sid, source, size, target`` of a table of ``source, size``."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    rows = write_shared(ranked_sources(sizes).select(
        F.col("rank").alias("sid"), "source", "size", weight.cast("decimal(38,0)").alias("weight"),
        (F.col("size") * most).cast("decimal(38,0)").alias("cap")), "weighted")
    total = rows.agg(F.sum(F.col("size").cast("decimal(38,0)"))).first()[0]
    budget, level, known = share * int(total or 0), Fraction(0), None
    while True:
        # sources whose cap is under their share of what is left: cap * den < weight * num
        num, den = (F.lit(str(x)).cast("decimal(38,0)") for x in (level.numerator, level.denominator))
        over = F.col("cap") * den <= F.col("weight") * num if known is not None else F.lit(False)
        got = rows.agg(F.sum(F.when(over, F.col("cap"))).alias("full"), F.count_if(over).alias("n"),
                       F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if got["n"] == known or not got["w"]:
            break
        known, level = got["n"], (budget - int(got["full"] or 0)) / int(got["w"])
    by_weight = F.get(F.array(*[F.lit(float(w * level)) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    return rows.select("sid", "source", "size", F.when(over, F.col("cap").cast("double"))
                       .otherwise(by_weight).alias("target"))


# --- the budget of one source ----------------------------------------------------------

def subset_sum(lengths: list[int], counts: list[int], wanted: int) -> list[int]:
    """How many of each length to take so that their sum is nearest to ``wanted``
    (the smaller sum of two equally near)."""
    if wanted <= 0 or not lengths:
        return [0] * len(lengths)
    # without its shortest member a sum beyond this would be nearer, and so would none
    top = wanted + min(wanted, max(lengths))
    made = np.full(top + 1, -1, np.int32)       # the item that first made a sum
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for k, (size, count) in enumerate(zip(lengths, counts)):
        left, chunk = min(count, top // size), 1
        while left and not reach[wanted]:       # counts in chunks of 1, 2, 4, ...
            take = min(chunk, left)
            step = take * size
            new = np.flatnonzero(reach[:top + 1 - step] & ~reach[step:]) + step
            reach[new] = True
            made[new] = len(items)
            items.append((k, take))
            left, chunk = left - take, 2 * chunk
        if reach[wanted]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.lexsort((sums, np.abs(sums - wanted)))[0]])
    out = [0] * len(lengths)
    while at:
        k, take = items[made[at]]
        out[k] += take
        at -= take * lengths[k]
    return out


def fitted(lengths: np.ndarray, counts: np.ndarray, wanted: int, seed: int, width: int = WIDTH) -> np.ndarray:
    """How many documents of each length make up about ``wanted`` words."""
    total = int((lengths.astype(object) * counts).sum())
    if wanted >= total:
        return counts.copy()
    taken = np.zeros(len(counts), np.int64)
    order = np.random.default_rng(seed).permutation(len(lengths))
    rest = wanted
    if rest > width:
        taken = np.array([int(c) * wanted // total for c in counts], np.int64)
        rest -= int((lengths.astype(object) * taken).sum())
        going = True
        while going and rest > width:       # one of each length a turn
            going = False
            for k in order:
                if taken[k] < counts[k] and lengths[k] <= rest - width // 2:
                    taken[k] += 1
                    rest -= int(lengths[k])
                    going = True
                if rest <= width:
                    break
    left = [k for k in order if taken[k] < counts[k] and lengths[k] > 0]
    for k, n in zip(left, subset_sum([int(lengths[k]) for k in left], [int(counts[k] - taken[k]) for k in left], rest)):
        taken[k] += n
    return taken


def budgets(histogram: DataFrame, wanted: DataFrame, seed: int = SEED, most: int = MOST,
            width: int = WIDTH) -> DataFrame:
    """``sid, size, copies, more``: every document of a length is taken ``copies``
    times, and ``more`` of them once again.

    ``histogram``: ``sid, size, n``; ``wanted``: ``sid, size, target``.  One group
    is the lengths of one source, not its documents."""
    both = histogram.join(small_side(wanted.select(
        F.col("sid").alias("k"), F.col("size").alias("all"), "target")), F.col("sid") == F.col("k"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, whole = int(rows["all"].iloc[0]), Fraction(float(rows["target"].iloc[0]))
        budget = int(whole + Fraction(1, 2))
        copies = min(most, budget // size) if size else 0
        lengths, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
        more = np.zeros(len(rows), np.int64)
        if size and copies < most:
            more = fitted(lengths, counts, budget - copies * size, seed + int(rows["sid"].iloc[0]), width)
            more[lengths == 0] = 0
        return pd.DataFrame({"sid": rows["sid"], "size": lengths, "n": counts, "copies": copies, "more": more})
    return both.groupBy("sid").applyInPandas(run, "sid long, size long, n long, copies int, more long")


# --- which documents ------------------------------------------------------------------

def _cut(rows: DataFrame, keys: list[str], order: list[str], quota: DataFrame, need: str) -> DataFrame:
    """For each group ``keys``, where the running count over ``order`` passes the
    quota ``need``: the border's ``order`` values as ``c_...`` and what is left."""
    counts = rows.groupBy(*keys, *order).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    named = quota.select(*[F.col(k).alias(f"q_{k}") for k in keys], F.col(need).alias("q"))
    on = [F.col(k) == F.col(f"q_{k}") for k in keys]
    return (run.join(named, on).where((F.col("before") <= F.col("q")) & (F.col("q") < F.col("before") + F.col("c")))
            .select(*[F.col(k).alias(f"x_{k}") for k in keys], *[F.col(o).alias(f"c_{o}") for o in order],
                    (F.col("q") - F.col("before")).alias("rest")))


def selected(docs: DataFrame, quota: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (``sid, size, h, place``) with ``more``: 1 for those selected."""
    # lengths of which all or none are taken need no choice
    some = write_shared(quota.where((F.col("more") > 0) & (F.col("more") < F.col("n"))), "some")
    keyed = docs.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    plain = quota.select(F.col("sid").alias("a_sid"), F.col("size").alias("a_size"), "copies",
                         (F.col("more") >= F.col("n")).alias("every"), (F.col("more") > 0).alias("any"))
    rows = write_shared(keyed.join(small_side(plain), (F.col("sid") == F.col("a_sid")) & (F.col("size") == F.col("a_size")))
                        .drop("a_sid", "a_size"), "quota")
    choice = rows.where("any and not every")
    one = write_shared(_cut(choice, ["sid", "size"], ["bucket"], some, "more"), "cut")
    on = (F.col("sid") == F.col("x_sid")) & (F.col("size") == F.col("x_size"))
    near = write_shared(choice.join(small_side(one), on).drop("x_sid", "x_size"), "near")
    border = near.where(F.col("bucket") == F.col("c_bucket")).drop("c_bucket")
    part = F.shiftright("place", 33)
    two = _cut(border.withColumn("part", part), ["sid", "size"], ["h", "part"],
               one.select(F.col("x_sid").alias("sid"), F.col("x_size").alias("size"), "rest"), "rest")
    last = border.drop("rest").withColumn("part", part).join(small_side(write_shared(two, "cut")), on)
    before = (F.col("h") < F.col("c_h")) | ((F.col("h") == F.col("c_h")) & (F.col("part") < F.col("c_part")))
    tie = (F.col("h") == F.col("c_h")) & (F.col("part") == F.col("c_part"))
    turn = F.row_number().over(Window.partitionBy("sid", "size", "h", "part").orderBy("place"))
    names = [*docs.columns, "copies"]
    done = [rows.where("every or not any").select(*names, F.col("every").cast("int").alias("more")),
            near.where(F.col("bucket") != F.col("c_bucket")).select(
                *names, (F.col("bucket") < F.col("c_bucket")).cast("int").alias("more")),
            last.where(~tie).select(*names, before.cast("int").alias("more")),
            last.where(tie).withColumn("turn", turn).select(
                *names, (F.col("turn") <= F.col("rest")).cast("int").alias("more"))]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED,
        weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST, width: int = WIDTH,
        buckets: int = BUCKETS) -> DataFrame:
    """``id_col, size, source_size, target, taken`` of every document."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")),
                       F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), words.alias("size"))
    sized = write_shared(sized.withColumn("place", F.monotonically_increasing_id()), "sized")
    wanted = write_shared(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most),
                          "targets")
    named = small_side(wanted.select("sid", F.col("source").alias("k"), F.col("size").alias("source_size"), "target"))
    rows = write_shared(sized.join(named, F.col("source").eqNullSafe(F.col("k"))).select(
        "id", "sid", "size", "source_size", "target", "place",
        F.xxhash64(F.lit(seed), "id", "sid", "size").alias("h")), "rows")
    quota = write_shared(budgets(rows.groupBy("sid", "size").agg(F.count("*").alias("n")), wanted, seed, most, width),
                         "quota")
    return selected(rows, quota, buckets).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + F.col("more"))).alias("taken"))
