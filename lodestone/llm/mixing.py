"""Mixing sources to target weights by subset-sum budget fitting.

The budget (a share of all words) is dealt to the sources by weight; a source's target stops at a multiple of its
size and the excess goes to the others by weight. A source is taken whole as often as its target allows; for the
words that remain, documents are counted by exact length, each length gives the same share of its documents, and a
bounded-knapsack dynamic program over the lengths fits the rest to the word where the lengths allow it. Of each length
the documents of the lowest seeded draws are selected.

What moves: one row for each source and length from each task; documents themselves are compared with a bound of their
draws. The bound is found in two steps, a count by ranges of draws and an order within one range, so that a source and
length that hold a third of all rows are split over the ranges. Tables by source, and by source and length, are joined;
the latter is broadcast only up to BROADCAST_ROWS rows, and shuffled beyond.

Sources are put in order by ranges, each a task, with the sums before each range added; only one row a range reaches
the driver. So many sources are no one task's work.

Defined results: null text has size 0; documents of size 0 are never short of their target and count as taken 0 times;
the null source is a source, the last in order; an empty table gives an empty mix. Rows that repeat both id and text
have one draw and are selected together or not at all, and those that would go over the count are left out. Texts of
any length are counted whole. mix() packs docs' own columns away, so no name of theirs can clash with its own; the
column it adds has a name of the caller's choice, and one of docs with that name is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.session import shared_path, ship, written

#: Ranges of draws in which the documents of one source and length are counted: two to this power.
RANGE_BITS = 8
#: Words that are left at least, where there are so many, for the dynamic program to fit.
FITTED = 50_000
#: Rows (source, length: about 50 bytes each) up to which the plan is broadcast.
BROADCAST_ROWS = 500_000


def fit_counts(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many documents of each length to take for a sum of at most budget, as near to it as found.

    A proportional share first, then longest lengths first down to a rest of twice the longest length or FITTED words,
    whichever is more, then the dynamic program on that: its states are the sums up to the rest, as bits of one integer.
    A budget of no more than that rest is fitted as a whole.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    taken = [0] * len(lengths)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return list(counts)
    keep = max(2 * max(lengths), FITTED)
    if budget > keep:
        taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        if left > keep:
            k = min(counts[i] - taken[i], (left - keep) // lengths[i])
            taken[i] += k
            left -= k * lengths[i]
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i in order:
        spare, part = min(counts[i] - taken[i], left // lengths[i]), 1
        while spare > 0 and not reach >> left & 1:
            k = min(part, spare)
            new = (reach | reach << (k * lengths[i])) & mask
            if new != reach:
                steps.append((i, k, reach))
                reach = new
            spare, part = spare - k, 2 * part
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * lengths[i]
    return taken


def running(df: DataFrame, order: list, sums: dict, base: str) -> DataFrame:
    """df with running sums (name: column) in a total order, each up to and with its row. Sorted by ranges, which are summed up apart."""
    spread = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    spread = written(spread, "mix-ordered", base)
    upto = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = {n: 0.0 for n in sums}
    rows = []
    for r in spread.groupBy("part").agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).orderBy("part").collect():  # one row a range
        rows.append((r["part"], *before.values()))
        before = {n: before[n] + r[n] for n in sums}
    ahead = df.sparkSession.createDataFrame(rows, "part int, " + ", ".join(f"ahead_{n} double" for n in sums))
    got = spread.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()]).join(F.broadcast(ahead), "part")
    return got.select(*df.columns, *[(F.col(n) + F.col(f"ahead_{n}")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of (source, source_size), one row a source: its target. Sources by code point, null last, have the weights in turn.

    With sources in order of bound over weight, those before the first k at which the level
    (budget - bounds before) / (weights from k on) is within k's own bound stop at their bounds.
    """
    base = shared_path(sizes.sparkSession, "mix-sources")
    s = running(sizes.select("source", "source_size"), [F.asc_nulls_last("source")], {"i": F.lit(1)}, f"{base}/source")
    s = s.withColumn("i", F.col("i").cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("bound", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    s = running(s, [F.asc("ratio"), F.asc("i")], {"upto_bound": F.col("bound"), "upto_weight": F.col("weight")}, f"{base}/ratio")
    s = written(s, "mix-running", f"{base}/running")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, weight = share * (whole["size"] or 0), whole["weight"] or 0.0
    s = s.withColumn("level", (F.lit(float(budget)) - (F.col("upto_bound") - F.col("bound"))) / (F.lit(float(weight)) - F.col("upto_weight") + F.col("weight")))
    first = s.filter("level <= ratio").agg(F.min(F.struct("ratio", "i", "level")).alias("x")).first()["x"]
    level = F.lit(float(first["level"])) * F.col("weight") if first else F.col("bound")
    return s.select("source", "source_size", F.least("bound", level).alias("target"))


def size_of(text: str = "text"):
    return F.coalesce(F.expr(rf"regexp_count(`{text}`, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def draw_of(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def with_size_and_draw(docs: DataFrame, seed: int) -> DataFrame:
    """source, size and draw of each document, and docs' columns packed in one (row)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", size_of().alias("size"), draw_of(seed).alias("draw"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of (source, size, draw), one row a source and length: source_size, target, times (all documents) and last (those of draws up to it once more)."""
    ship(sized.sparkSession)
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = written(hist, "mix-lengths")
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    hist = hist.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        times = int(target // size) if size else 0
        pdf = pdf.sort_values("size")
        some = fit_counts(round(target - times * size), pdf["size"].tolist(), pdf["n"].tolist())
        return pdf.assign(times=times, some=np.array(some, np.int64))

    schema = "source string, size long, n long, source_size long, target double, times long, some long"
    plan = written(hist.groupBy("source").applyInPandas(fit, schema), "mix-counts")
    # the draw of the last document selected: first its range of draws, then its place in that range
    part = plan.filter("some > 0 AND some < n").select(F.col("source").alias("ps"), F.col("size").alias("pz"), "some")
    rows = sized.select("source", "size", "draw", F.shiftright("draw", 64 - RANGE_BITS).alias("range"))
    counts = rows.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("c"))
    same = F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz"))
    upto = W.partitionBy("source", "size").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    edge = counts.join(part, same).withColumn("upto", F.sum("c").over(upto)).filter("upto >= some AND upto - c < some")
    edge = edge.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("range").alias("pr"), (F.col("some") - F.col("upto") + F.col("c")).alias("place"))
    inside = rows.join(edge, same & (F.col("range") == F.col("pr"))).withColumn("r", F.rank().over(W.partitionBy("source", "size", "range").orderBy("draw")))
    # of equal draws none is taken if not all are: rows up to each draw
    inside = inside.withColumn("upto", F.count(F.lit(1)).over(W.partitionBy("source", "size", "range").orderBy("draw")))
    last = inside.groupBy("source", "size", "range").agg(F.max(F.when(F.col("upto") <= F.col("place"), F.col("draw"))).alias("draw"))
    last = last.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.coalesce("draw", F.shiftleft("range", 64 - RANGE_BITS) - 1).alias("edge"))
    full = F.when(F.col("some") == 0, F.lit(None)).when(F.col("some") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("edge"))
    return plan.join(last, same, "left").select("source", "size", "source_size", "target", "times", full.cast("long").alias("last"))


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (with source, size and draw) with source_size, target and copies: how often the mix takes each document."""
    plan = plan.withColumnsRenamed({"source": "plan_source", "size": "plan_size"})
    if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    got = docs.join(plan, docs["source"].eqNullSafe(plan["plan_source"]) & (docs["size"] == plan["plan_size"]))
    extra = F.coalesce((F.col("draw") <= F.col("last")).cast("long"), F.lit(0))
    return got.withColumn("copies", F.when(F.col("size") > 0, F.col("times") + extra).otherwise(F.lit(0)))


def mix(docs: DataFrame, seed: int = 7, into: str = "mix") -> DataFrame:
    """docs, all columns, and the column into: a struct of size, source_size, target and copies."""
    sized = with_size_and_draw(docs, seed)
    plan = written(mix_plan(written(sized.select("source", "size", "draw"), "mix-sizes")), "mix-plan")
    got = mixed(sized, plan)
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != into], F.struct("size", "source_size", "target", "copies").alias(into))


def op7_mixing(spark: SparkSession, sf_dir: str, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", size_of().alias("size"), draw_of(seed).alias("draw")), "mix-sizes")
    plan = written(mix_plan(sized.select("source", "size", "draw")), "mix-plan")
    return mixed(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
