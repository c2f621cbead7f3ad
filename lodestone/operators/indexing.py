"""Indexing: windows of lines, gaps between covered lines, manifest differences, upserts, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines


def sliding_windows(docs: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """doc_id, start_line, end_line (from 1), content: windows every max(1, size - overlap) lines, up to the first that reaches the end."""
    stride = max(1, size - overlap)
    d = docs.select("doc_id", lines(F.col("text")).alias("ls")).withColumn("n", F.size("ls")).filter("n > 0")
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / stride)).cast("int")
    w = d.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    return w.select("doc_id", (F.col("i") * stride + 1).alias("start_line"), F.least(F.col("i") * stride + size, F.col("n")).alias("end_line"), F.array_join(F.slice("ls", F.col("i") * stride + 1, F.lit(size)), "\n").alias("content"))


def gap_runs(docs: DataFrame, covered: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, start_line, end_line of the longest runs of lines that no range of covered (doc_id, first, last) holds; short runs are dropped.

    A document's ranges, in order, are gone through once; lines are never rows.
    """
    d = docs.select("doc_id", F.size(lines(F.col("text"))).alias("n")).filter("n > 0")
    ranges = covered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")))).alias("ranges"))
    end = F.array(F.struct((F.col("n") + 1).cast("int").alias("first"), (F.col("n") + 1).cast("int").alias("last")))
    some = F.filter(F.coalesce("ranges", F.array().cast("array<struct<first:int,last:int>>")), lambda r: r["first"] <= F.col("n"))
    none = F.array().cast("array<struct<start_line:int,end_line:int>>")
    step = lambda acc, r: F.struct(
        F.greatest(acc["free"], r["last"] + 1).alias("free"),
        F.when(r["first"] - acc["free"] >= least, F.concat(acc["runs"], F.array(F.struct(acc["free"].alias("start_line"), (r["first"] - 1).alias("end_line"))))).otherwise(acc["runs"]).alias("runs"),
    )
    runs = F.aggregate(F.concat(some, end), F.struct(F.lit(1).alias("free"), none.alias("runs")), step, lambda acc: acc["runs"])
    return d.join(ranges, "doc_id", "left").select("doc_id", F.explode(runs).alias("x")).select("doc_id", "x.start_line", "x.end_line")


def gap_windows(docs: DataFrame, covered: DataFrame, size: int = 64, overlap: int = 16, least: int = 5) -> DataFrame:
    """doc_id, start_line, end_line: windows of lines inside each gap."""
    stride = max(1, size - overlap)
    runs = gap_runs(docs, covered, least).withColumn("n", F.col("end_line") - F.col("start_line") + 1)
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / stride)).cast("int")
    w = runs.withColumn("at", F.explode(F.sequence(F.lit(0), count - 1)) * stride + F.col("start_line"))
    return w.select("doc_id", F.col("at").cast("int").alias("start_line"), F.least(F.col("at") + size - 1, F.col("end_line")).cast("int").alias("end_line"))


def manifest_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """file, status: new, changed, unchanged (time within 0.01 s and equal hash) or orphan; both have (file, mtime, hash)."""
    o = old.select(F.col("file").alias("of"), F.col("mtime").alias("om"), F.col("hash").alias("oh"))
    same = (F.abs(F.col("mtime") - F.col("om")) <= 0.01) & (F.col("hash") == F.col("oh"))
    status = F.when(F.col("file").isNull(), "orphan").when(F.col("of").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return new.join(o, F.col("file") == F.col("of"), "full").select(F.coalesce("file", "of").alias("file"), status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new's rows, and old's whose key new doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def purge(rows: DataFrame, kept: DataFrame, key: str = "file") -> DataFrame:
    """rows of files that are still there."""
    return rows.join(kept.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last by order: a partial maximum, no group is sorted."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in (*keys, *order)])).alias("last"))
    return best.select(*keys, "last.*")


def prune(tasks: DataFrame, now, ttl: str, most: int) -> DataFrame:
    """Tasks (event_id, finished_at: null while one runs) that are kept: all that run; of the others none older than ttl, the latest ones up to most in all."""
    running = tasks.filter("finished_at IS NULL")
    room = max(0, most - running.count())
    done = tasks.filter(F.col("finished_at") >= F.lit(now) - F.expr(f"INTERVAL {ttl}")).orderBy(F.desc("finished_at"), F.desc("event_id")).limit(room)
    return running.unionByName(done)
