"""File events in silence-closed sets: the same plan over a batch and over a stream; and what follows from a set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import language_of


def debounce(events: DataFrame, gap: str = "2 seconds", key: str = "project", late: str | None = None) -> DataFrame:
    """key, start, stop, n, paths of each run of events without a pause of gap; give late (a watermark) for streams."""
    e = events.withWatermark("ts", late) if late else events
    got = e.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))
    return got.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "paths")


def source_events(events: DataFrame) -> DataFrame:
    """ts, path of events (ts, path, moved_to) at files of known languages; a move is an event at either end. Works on streams."""
    both = events.select("ts", F.explode(F.array_compact(F.array("path", "moved_to"))).alias("path"))
    return both.filter(language_of(F.col("path")).isNotNull())


def with_project(events: DataFrame, projects: list[str]) -> DataFrame:
    """events with the longest of the projects (watched roots, few) that holds their path by whole parts; others go. Works on streams."""
    found = None
    for p in sorted(projects, key=lambda p: (-len(p), p)):
        root = p.rstrip("/")
        inside = (F.col("path") == root) | F.col("path").startswith(root + "/")
        found = F.when(inside, root) if found is None else found.when(inside, root)
    return events.withColumn("project", found if found is not None else F.lit(None).cast("string")).filter("project IS NOT NULL")


def reindex_on_change(events: DataFrame, projects: list[str], reindex: Callable[[str], object], checkpoint: str, gap: str = "2 seconds", late: str = "10 seconds"):
    """Start a query that calls reindex(project) for each project with a closed set of events in a batch.

    events: a stream of (ts, path, moved_to). One batch runs at a time, so index runs never overlap.
    """
    sets = debounce(with_project(source_events(events), projects), gap, late=late)

    def run(df: DataFrame, _: int) -> None:
        for r in df.select("project").distinct().collect():  # of the watched roots
            reindex(r["project"])

    return sets.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).start()
