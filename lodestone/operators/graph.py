"""Dependency graphs: degrees, roles, layers, neighbours in hops, reverse personalised PageRank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import role
from lodestone.session import remove, shared_path, written


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree over distinct edges (src, dst)."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def roles(edges: DataFrame) -> DataFrame:
    return degrees(edges).withColumn("role", role(F.col("out_degree"), F.col("in_degree")))


def khop(edges: DataFrame, seeds: DataFrame, hops: int = 1, most: int = 10) -> DataFrame:
    """seed, neighbors: nodes within hops by edges of either direction, without the seed, the first `most` in order.

    In the last hop a node gives its first most + 1 neighbours alone: of any later one as many come before it, the seed
    among them at most. So a hub is not followed through in the hop that would multiply it.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "khop-edges")
    near = both.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("r") <= most + 1).drop("r")
    reach = seeds.select(F.col("node").alias("seed"), "node").distinct()
    for hop in range(hops):
        step = reach.join(near if hop == hops - 1 else both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
        reach = reach.union(step).distinct()
    first = reach.filter("node <> seed").withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy("node"))).filter(F.col("r") <= most)
    got = first.groupBy("seed").agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("neighbors"))
    return seeds.select(F.col("node").alias("seed")).distinct().join(got, "seed", "left").select("seed", F.coalesce("neighbors", F.lit("")).alias("neighbors"))


class NotConverged(RuntimeError):
    """PageRank didn't settle in the rounds it was given."""


#: Edges up to which PageRank is computed by the driver: three numbers each.
LOCAL_EDGES = 200_000


def _local_ppr(edges: list, seeds: set, alpha: float, iterations: int, tol: float, strict: bool) -> dict:
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    u, v = np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
    out = np.bincount(u, minlength=len(nodes)).astype(float)
    p = np.array([float(x in seeds) for x in nodes])
    p = p / p.sum() if p.any() else np.full(len(nodes), 1 / len(nodes))
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(iterations):
        flow = np.bincount(v, r[u] / out[u], len(nodes))
        new = alpha * (flow + r[out == 0].sum() * p) + (1 - alpha) * p
        change, r = np.abs(new - r).sum(), new
        if change < len(nodes) * tol:
            return dict(zip(nodes, r.tolist(), strict=True))
    if strict:
        raise NotConverged(f"no convergence within {iterations} rounds")
    return dict(zip(nodes, r.tolist(), strict=True))


def reverse_ppr(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 100, tol: float = 1e-6, strict: bool = False) -> DataFrame:
    """node, ppr: PageRank with rank flowing from what is imported to its importers, teleporting to the seeds.

    Seeds that aren't nodes don't count; without any the teleport is uniform. Dangling nodes' rank teleports too. It
    ends when the ranks change by less than nodes * tol in sum; strict: else NotConverged is raised. A graph of up to
    LOCAL_EDGES edges, counted first, is worked out by the driver; of a larger one each round's ranks are written, which
    cuts the lineage in the shared folder, and only the rounds' sums of change reach the driver.
    """
    spark = edges.sparkSession
    base = shared_path(spark, "ppr")
    e = written(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")).distinct(), "edges", f"{base}/edges")
    if e.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        rows = [(r["u"], r["v"]) for r in e.collect()]
        ends = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
        some = {r[0] for r in seeds.select("node").join(ends, "node", "left_semi").distinct().collect()} if rows else set()  # nodes of the graph
        got = _local_ppr(sorted(rows), some, alpha, iterations, tol, strict) if rows else {}
        remove(spark, base)
        return spark.createDataFrame(list(got.items()), f"node {dict(edges.dtypes)['src']}, ppr double")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    out = e.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    s = seeds.select("node").distinct().withColumn("seed", F.lit(1.0))
    start = nodes.join(s, "node", "left").join(out, F.col("node") == F.col("u"), "left").select("node", F.coalesce("seed", F.lit(0.0)).alias("seed"), "deg")
    stats = start.agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("k")).first()
    start = start.select("node", "deg", (F.col("seed") / stats["k"] if stats["k"] else F.lit(1.0 / stats["n"])).alias("p"))
    rank = written(start.withColumns({"r": F.lit(1.0 / stats["n"]), "old": F.lit(0.0)}), "rank", f"{base}/rank-0")
    lost, change = rank.agg(F.sum(F.when(F.col("deg").isNull(), F.col("r")))).first()[0] or 0.0, None
    for i in range(1, iterations + 1):
        flow = e.join(rank.filter("deg IS NOT NULL").select(F.col("node").alias("u"), (F.col("r") / F.col("deg")).alias("x")), "u").groupBy("v").agg(F.sum("x").alias("x"))
        new = rank.join(flow, F.col("node") == F.col("v"), "left").select("node", "deg", "p", (alpha * (F.coalesce("x", F.lit(0.0)) + lost * F.col("p")) + (1 - alpha) * F.col("p")).alias("r"), F.col("r").alias("old"))
        new = written(new, "rank", f"{base}/rank-{i}")
        told = new.agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("change"), F.sum(F.when(F.col("deg").isNull(), F.col("r"))).alias("lost")).first()
        remove(spark, f"{base}/rank-{i - 1}")
        rank, lost, change = new, told["lost"] or 0.0, told["change"]
        if change < stats["n"] * tol:
            break
    else:
        if strict:
            raise NotConverged(f"no convergence within {iterations} rounds")
    return rank.select("node", F.col("r").alias("ppr"))


def merge_rrf_ppr(rrf: DataFrame, ppr: DataFrame, rrf_weight: float = 0.6, ppr_weight: float = 0.4) -> DataFrame:
    """id, score: both scores over their greatest, weighted; rrf has (id, file, score), ppr (node, ppr)."""
    most = rrf.agg(F.max("score").alias("best"))  # one row
    a = rrf.crossJoin(F.broadcast(most)).withColumn("a", F.coalesce(F.col("score") / F.nullif("best", F.lit(0.0)), F.lit(0.0)))
    b = ppr.crossJoin(F.broadcast(ppr.agg(F.max("ppr").alias("m")))).select("node", (F.col("ppr") / F.nullif("m", F.lit(0.0))).alias("b"))
    return a.join(b, F.col("file") == F.col("node"), "left").select("id", F.round(rrf_weight * F.col("a") + ppr_weight * F.coalesce("b", F.lit(0.0)), 6).alias("score"))


def gate(edges: DataFrame, least: int = 50) -> DataFrame:
    """One row: edges, whether PageRank is applied, and its weight: 0.4 from five times as many edges on, else 0.2."""
    n = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    return n.select("edges", (F.col("edges") >= least).alias("applied"), F.when(F.col("edges") >= 5 * least, 0.4).otherwise(0.2).alias("weight"))
