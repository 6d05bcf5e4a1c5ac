"""Mixing sources to target weights by subset-sum budget fitting (op 8).

1. Documents are counted by source and exact length (a histogram, reduced
   before it is shuffled).
2. Sources in code-point order, null last, get the weights in turn; the sum of
   all lengths is shared by weight, no source above ``cap`` times its own size,
   the excess shared again among the others until none is above.
3. Each source takes whole passes of all its documents; the remaining budget is
   fitted on its length histogram.  A proportional part leaves ``knapsack`` words
   of it, and a bounded knapsack (subset sums as a bit array) over the documents
   left fits those.  What it misses is compared with the best that lengths with
   their common divisor allow; while it is worse, four times the room is left to
   the knapsack, up to the whole budget or ``LIMIT`` words.  So a source of any
   size is fitted exactly where its lengths allow, and beyond ``LIMIT`` misses by
   less than its longest document.  Sums stay below the budget, or with ``over``
   may be the nearest on either side (then beyond ``LIMIT`` by half the longest
   document at most).  One source's task holds its histogram, one row per distinct
   length, never its documents.
4. Of each length the planned number of documents is taken in seeded order.
   The order is kept by 256 hash ranges per (source, length), with counts per
   range; inside the range where the plan ends, a cut in the order is found from
   lengths and hashes alone.  So texts are read, compared with the cut and never
   shuffled, except for repeated rows (equal id and text) of which only some are
   taken, and except where the plan, one row per source and length, is too large
   for Spark to broadcast.  Repeated rows are counted off in 256 slots.

Defined results: a null or empty text has length 0 and takes nothing; a null
source is a source of its own; repeated rows are separate documents; an empty
table gives an empty result; other columns pass through :func:`mixed`, and
helper names that clash get underscores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, by_value, col, fresh, prefix_sum, stage, table, text_of

by_value(__name__)

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 17
KNAPSACK = 1 << 16      # words of a budget that the knapsack fits at first
LIMIT = 1 << 22         # and at most: bounds the memory of a task (10 bytes a word)
RANGES = 256


def fit(sizes: list[int], counts: list[int], budget: int, knapsack: int = KNAPSACK, over: bool = False) -> list[int]:
    """How many documents of each length (positive, ascending) to take, at most
    ``counts``, so that the sum comes nearest ``budget``: from below, or with
    ``over`` from either side (from below if both are as near)."""
    if budget >= sum(s * c for s, c in zip(sizes, counts)):
        return list(counts)
    unit = math.gcd(*sizes)
    least = min(budget % unit, unit - budget % unit) if over else budget % unit
    while True:
        taken, miss = _fit(sizes, counts, budget, knapsack, over)
        if miss <= least or knapsack >= min(budget, LIMIT):
            return taken
        knapsack *= 4


def _fit(sizes: list[int], counts: list[int], budget: int, room: int, over: bool) -> tuple[list[int], int]:
    """A proportional part up to ``room`` words before the budget, then subset
    sums: documents of each length, and by how many words the sum misses."""
    taken, total = [0] * len(sizes), sum(s * c for s, c in zip(sizes, counts))
    share, carry = max(budget - room, 0) / total, 0.0
    for i in range(len(sizes) - 1, -1, -1):         # rounding is carried from length to length
        want = share * counts[i] * sizes[i] + carry
        taken[i] = min(counts[i], int(want // sizes[i]))
        carry = want - taken[i] * sizes[i]
    rest = budget - sum(s * t for s, t in zip(sizes, taken))
    width = (2 * rest if over else rest) + 1        # a sum beyond is no nearer than taking nothing
    items = []                          # what is left of each length, in powers of two
    for i, s in enumerate(sizes):
        left, p = min(counts[i] - taken[i], (width - 1) // s), 1
        while left > 0:
            p = min(p, left)
            items.append((s * p, i, p))
            left -= p
            p *= 2
    items.sort(reverse=True)
    reach, by = np.zeros(width, bool), np.full(width, -1, np.int32)
    reach[0] = True
    for n, (size, _, _) in enumerate(items):        # the first item that reaches a sum is how to get there
        if size >= width:
            continue
        new = np.flatnonzero(reach[:-size] & ~reach[size:]) + size
        by[new] = n
        reach[new] = True
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach[:rest + 1])[-1])
    above = np.flatnonzero(reach[rest + 1:])
    if len(above) and above[0] + 1 < rest - at:
        at = rest + 1 + int(above[0])
    miss = abs(rest - at)
    while at:
        size, i, p = items[by[at]]
        taken[i] += p
        at -= size
    return taken, miss


def _fit_source(over: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        size, target = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
        passes = target // size if size else 0
        some = pdf["size"] > 0
        pdf["extra"] = 0
        if size:
            pdf.loc[some, "extra"] = fit(pdf.loc[some, "size"].tolist(), pdf.loc[some, "n"].tolist(),
                                         target - passes * size, over=over)
        pdf["passes"] = passes
        return pdf[["nul", "src", "size", "source_size", "target", "passes", "extra"]]
    return run


def targets(hist: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(nul, src, source_size, target) from the histogram (nul, src, size, n)."""
    sources = stage(hist.groupBy("nul", "src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    sources = prefix_sum(sources.withColumn("one", F.lit(1)), ["nul", "src"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(sources.withColumn("w", weight).withColumn("most", cap * F.col("source_size")), "weights")
    level, stopped = 0.0, None          # targets are the smaller of level * weight and the cap
    while True:
        open_ = F.lit(True) if stopped is None else F.col("w") * level <= F.col("most")
        total, w, capped, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(open_, F.col("w"))),
            F.sum(F.when(~open_, F.col("most"))), F.count(F.when(~open_, 1))).first()
        if n == stopped or not w or not total:
            break
        level, stopped = (total - (capped or 0.0)) / w, n
    return sources.select("nul", "src", "source_size", F.least(F.col("w") * level, F.col("most")).alias("target"))


def _cuts(keyed: DataFrame, ranges: DataFrame, plan: DataFrame) -> DataFrame:
    """Where the order of each (source, length) is cut: ranges up to ``upto`` are
    taken, of range ``part`` the hashes below ``cut`` and ``some`` of the ``same``
    rows at it."""
    key = ["nul", "src", "size"]

    def before(n: str, order: str) -> Column:
        rows = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(rows), F.lit(0))
    whole = F.col("before") + F.col("n_range") <= F.col("extra")
    split = ~whole & (F.col("before") < F.col("extra"))
    ends = stage(ranges.withColumn("before", before("n_range", "range_")).join(plan, key).groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "passes")],
        F.coalesce(F.max(F.when(whole, F.col("range_"))), F.lit(-1)).alias("upto"),
        F.max(F.when(split, F.col("range_"))).alias("part"),
        F.max(F.when(split, F.col("extra") - F.col("before"))).alias("need")), "mix-ends")
    inside = keyed.join(ends.where("part IS NOT NULL").select(*key, F.col("part").alias("range_"), "need"), [*key, "range_"])
    hashes = inside.groupBy(*key, "need", "hash_").agg(F.count("*").alias("same")).withColumn("before", before("same", "hash_"))
    cut = hashes.where("before < need").groupBy(*key).agg(
        F.max("hash_").alias("cut"), F.max_by("same", "hash_").alias("same"),
        F.max_by(F.col("need") - F.col("before"), "hash_").alias("some"))
    return stage(ends.drop("need").join(cut, key, "left"), "mix-need")


def _counted_off(rows: DataFrame, keys: list[str], need: str) -> tuple[DataFrame, str]:
    """``rows`` with whether each is among the first ``need`` of its ``keys``, in
    any order that is fixed once; a key's rows are spread over 256 slots."""
    slot, n, before, rank, among = fresh(rows, "slot", "n", "before", "rank", "among")
    rows = stage(rows.withColumn(slot, F.pmod(F.monotonically_increasing_id(), F.lit(RANGES))), "mix-repeated")
    slots = rows.groupBy(*keys, slot).agg(F.count("*").alias(n))
    slots = slots.withColumn(before, F.coalesce(F.sum(n).over(
        Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    place = F.row_number().over(Window.partitionBy(*keys, slot).orderBy(slot))
    out = rows.withColumn(rank, place).join(stage(slots, "mix-slots"), [*keys, slot])
    return out.withColumn(among, F.col(before) + F.col(rank) <= F.col(need)).drop(slot, before, rank), among


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          weights=WEIGHTS, cap: float = CAP, seed: int = SEED, over: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source size, target and times taken; the second
    value says under which names."""
    key = ["nul", "src", "size"]
    features, planned = [*key, "range_", "hash_"], [*key, "source_size", "target", "passes", "upto", "part", "cut", "same", "some"]
    names = [*features, *planned[len(key):]]
    own = dict(zip([*names, "times"], fresh(docs, *names, "times")))
    text, source = text_of(col(docs, text_col)), col(docs, source_col)
    order = F.xxhash64(F.lit(seed), col(docs, id_col), text)
    made = [source.isNull(), F.coalesce(source, F.lit("")), F.regexp_count(text, F.lit(WORD)).cast("long"),
            F.shiftrightunsigned(order, 56).cast("int"), order]
    keyed = stage(docs.select(*[c.alias(n) for c, n in zip(made, features)]), "mix-keys")
    ranges = stage(keyed.groupBy(*key, "range_").agg(F.count("*").alias("n_range")), "mix-ranges")
    hist = stage(ranges.groupBy(*key).agg(F.sum("n_range").alias("n")), "mix-lengths")
    plan = stage(hist.join(targets(hist, weights, cap), ["nul", "src"]).groupBy("nul", "src").applyInPandas(
        _fit_source(over), "nul boolean, src string, size long, source_size long, target double, passes long, extra long"), "mix-plan")
    plan = _cuts(keyed, ranges, plan)
    repeated = not plan.where("some < same").isEmpty()
    plan = plan.select(*[F.col(c).alias(own[c]) for c in planned])
    keys = [own[c] for c in key]
    c = {n: F.col(own[n]) for n in names}
    out = docs.select(*[col(docs, x) for x in docs.columns], *[x.alias(own[n]) for x, n in zip(made, features)]).join(plan, keys)
    inside = F.coalesce(c["range_"] == c["part"], F.lit(False))     # one range: signed hashes are in order there
    taken = (c["range_"] <= c["upto"]) | (inside & (c["hash_"] <= c["cut"]))
    if not repeated:
        return out.withColumn(own["times"], c["passes"] + taken.cast("long")), own
    some = inside & (c["hash_"] == c["cut"]) & (c["some"] < c["same"])
    ties, among = _counted_off(out.where(some), [*keys, own["hash_"]], own["some"])
    ties = ties.withColumn(own["times"], c["passes"] + F.col(among).cast("long")).drop(among)
    return out.where(~some).withColumn(own["times"], c["passes"] + taken.cast("long")).unionByName(ties), own


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each as many times as it is taken, own columns only."""
    out, name = mixed(docs, **options)
    (copy,) = fresh(out, "copy")
    return (out.where(F.col(name["times"]) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name["times"]))))
            .select(*[col(out, c) for c in docs.columns]))


def op8_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out, name = mixed(docs, over=True)
    return out.select("doc_id", F.col(name["size"]).alias("size"), F.col(name["source_size"]).alias("source_size"),
                      F.col(name["target"]).alias("target"),
                      (F.col(name["size"]) * F.col(name["times"])).alias("taken"))
