"""The index of projects: what is kept of each, and how a run adds to it.

Below one root: for each run of a project a segment of chunks (with vectors), postings and imports, the project's list of files
with the segment that holds each one's rows, its edges, and last its entry in the registry, a small file that is
replaced at once. Readers start from the entry; so a run that dies leaves the project as it was, and the next one
does its work again. A file that was indexed anew has another segment in the list, and one that is gone has none: old rows
are not rewritten, readers leave them out by a join on file and segment, and compact() writes the live ones anew.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.embed import hashed
from lodestone.operators import chunks as ch
from lodestone.operators import imports as im
from lodestone.operators import search
from lodestone.session import read_text, remove, ship, write_text, written
from lodestone.sources import tree

SYMBOLS = ("function", "method", "class", "interface")
_CHUNK = "id string, file_path string, language string, chunk_type string, name string, raw_content string, start_line int, end_line int, parent_name string, semantic_text string, vector array<double>"
_FILE = "file_path string, language string, mtime double, hash string, segment string, chunk_count long"


def with_vectors(chunks: DataFrame, embed: Callable[[list], np.ndarray] = hashed) -> DataFrame:
    """chunks with the vector of each one's sentence."""
    ship(chunks.sparkSession)
    schema = to_arrow_schema(T._parse_datatype_string(_CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embed(b.column(b.schema.get_field_index("semantic_text")).to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if f.name == "vector" else b.column(b.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema)

    return chunks.mapInArrow(run, _CHUNK)


@dataclass
class Entry:
    """A project in the registry."""

    project: str
    files: int = 0
    chunks: int = 0
    indexed_at: float = 0.0
    segments: list[str] = field(default_factory=list)
    version: str = ""
    tokens: int = 0


class Store:
    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list], np.ndarray] = hashed, strategy: str = "ast", size: int = ch.WINDOW, overlap: int = ch.OVERLAP):
        self.spark, self.root, self.embed = spark, root.rstrip("/"), embed
        self.strategy, self.size, self.overlap = strategy, size, overlap

    # ---- registry

    @staticmethod
    def key(project: str) -> str:
        return hashlib.sha256(project.encode()).hexdigest()[:16]

    def _at(self, project: str, *parts: str) -> str:
        return "/".join((self.root, "projects", self.key(project), *parts))

    def projects(self) -> dict[str, Entry]:
        """All registered projects by name."""
        names = json.loads(read_text(self.spark, f"{self.root}/registry.json") or "[]")
        return {p: e for p in names if (e := self.entry(p))}

    def entry(self, project: str) -> Entry | None:
        said = read_text(self.spark, self._at(project, "entry.json"))
        return Entry(**json.loads(said)) if said else None

    def registered(self, path: str) -> str | None:
        """The longest registered project that is path or a folder above it."""
        return max((p for p in self.projects() if path == p or path.startswith(p.rstrip("/") + "/")), key=len, default=None)

    def _commit(self, e: Entry) -> None:
        write_text(self.spark, self._at(e.project, "entry.json"), json.dumps(e.__dict__))
        names = json.loads(read_text(self.spark, f"{self.root}/registry.json") or "[]")
        if e.project not in names:
            write_text(self.spark, f"{self.root}/registry.json", json.dumps(sorted([*names, e.project])))

    # ---- what is there

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def files(self, project: str) -> DataFrame:
        """The project's files: file_path, language, mtime, hash, segment, chunk_count."""
        e = self.entry(project)
        return self.spark.read.schema(_FILE).parquet(self._at(project, "files", e.version)) if e and e.version else self._empty(_FILE)

    def _live(self, project: str, what: str, schema: str) -> DataFrame:
        """Rows of what (file_path, ...) of the project's live files."""
        e = self.entry(project)
        parts = [p for s in (e.segments if e else []) if tree.exists(self.spark, p := self._at(project, what, s))]
        if not parts:
            return self._empty(schema)
        rows = None
        for p in parts:
            one = self.spark.read.schema(schema).parquet(p).withColumn("segment", F.lit(p.rsplit("/", 1)[-1]))
            rows = one if rows is None else rows.unionByName(one)
        live = search.bounded(self.files(project).select("file_path", "segment"))
        return rows.join(live, ["file_path", "segment"], "left_semi").drop("segment")

    def chunks(self, project: str) -> DataFrame:
        return self._live(project, "chunks", _CHUNK)

    def postings(self, project: str) -> DataFrame:
        return self._live(project, "postings", "term string, id string, file_path string, dl int, tf long")

    def specs(self, project: str) -> DataFrame:
        return self._live(project, "specs", "file_path string, project string, src string, language string, kind string, spec string")

    def symbols(self, project: str) -> DataFrame:
        return self.chunks(project).filter(F.col("chunk_type").isin(*SYMBOLS)).select("id", "name", F.col("chunk_type").alias("symbol_type"), "file_path", "language", "start_line", "end_line")

    def edges(self, projects: list[str] | None = None) -> DataFrame:
        """src, dst, import_name, resolved: of all projects, or some. Ends are whole paths, or names that mean no file."""
        schema = "src string, dst string, import_name string, resolved boolean, source string"
        rows = None
        for p in self.projects() if projects is None else projects:
            e = self.entry(p)
            if e and e.version and tree.exists(self.spark, at := self._at(p, "edges", e.version)):
                one = self.spark.read.schema(schema).parquet(at)
                rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self._empty(schema)

    # ---- a run

    def index(self, project: str, incremental: bool = True, languages: tuple[str, ...] = (), exclude: tuple[str, ...] = (), told: Callable[[dict], None] = lambda x: None) -> dict:
        """Bring the project's index up to date with its tree: counts of files, chunks, skipped, orphans, edges.

        Unchanged files (time within 0.01 s and equal hash) are left alone; if the list of files is there but no chunk is,
        all are indexed anew. Files that are gone go, of the languages asked for alone.
        """
        spark, e = self.spark, self.entry(project) or Entry(project)
        old = self.files(project)
        whole = lambda c: F.concat(F.lit(project.rstrip("/") + "/"), F.col(c))
        there = written(tree.list_tree(spark, project, exclude).withColumn("file_path", whole("path")), "store-tree")
        known = old.filter(F.col("language").isin(*languages)) if languages else old
        orphans = written(known.join(there.select("file_path"), "file_path", "left_anti").select("file_path"), "store-orphans")
        n_old, n_orphans = old.count(), orphans.count()
        if incremental and n_old and self.chunks(project).isEmpty():
            incremental = False
        now = tree.read_tree(spark, project, languages, exclude).withColumn("file_path", whole("path"))
        if incremental:
            was = search.bounded(old.select("file_path", F.col("mtime").alias("om"), F.col("hash").alias("oh")))
            same = (F.abs(F.col("mtime") - F.col("om")) <= 0.01) & (F.col("hash") == F.col("oh"))
            now = now.join(was, "file_path", "left").filter(~F.coalesce(same, F.lit(False))).drop("om", "oh")
        segment = uuid.uuid4().hex[:12]
        work = written(now, "store-work")
        n_work = work.count()
        n_all = there.filter(tree.language_of(F.col("path")).isNotNull()).count() if not languages else there.filter(tree.language_of(F.col("path")).isin(*languages)).count()
        out = {"files": n_work, "chunks": 0, "skipped": n_all - n_work, "orphans": n_orphans, "edges_heuristic": 0, "errors": 0}
        told(out | {"total": n_all})
        if not n_work and not n_orphans:
            return out
        if n_work:
            got = written(ch.chunk_files(work, self.strategy, self.size, self.overlap), "store-chunks")
            out["errors"] = got.filter("chunk_type = 'error'").count()
            got = got.filter("chunk_type <> 'error'")
            with_vectors(got, self.embed).write.mode("overwrite").parquet(self._at(project, "chunks", segment))
            search.write_index(got, self._at(project, "postings", segment), "id", "semantic_text", ("file_path",))
            im.import_specs(work.withColumn("project", F.lit(project))).withColumn("file_path", whole("src")).write.mode("overwrite").parquet(self._at(project, "specs", segment))
            counts = got.groupBy("file_path").agg(F.count(F.lit(1)).alias("chunk_count"))
            new = work.select("file_path", "language", "mtime", "hash").join(counts, "file_path", "left").select("file_path", "language", "mtime", "hash", F.lit(segment).alias("segment"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
            out["chunks"] = got.count()
            told(out | {"total": n_all})
        else:
            new = self._empty(_FILE)
        kept = old.join(orphans, "file_path", "left_anti").join(work.select("file_path"), "file_path", "left_anti")
        self._finish(e, kept.unionByName(new), segment if n_work else None, there.select(F.lit(project).alias("project"), "path"), out)
        return out

    def _finish(self, e: Entry, files: DataFrame, segment: str | None, paths: DataFrame, out: dict) -> None:
        """Write the list of files and the edges of a new version, then the entry that makes them count."""
        version, before = uuid.uuid4().hex[:12], e.version
        files.write.mode("overwrite").parquet(self._at(e.project, "files", version))
        files = self.spark.read.schema(_FILE).parquet(self._at(e.project, "files", version))
        held = [r[0] for r in files.select("segment").distinct().collect()]  # runs, few
        candidate = Entry(e.project, files.count(), 0, time.time(), sorted(held), version)
        probe = Store(self.spark, self.root, self.embed)
        probe.entry = lambda p: candidate if p == e.project else self.entry(p)  # type: ignore[method-assign]
        whole = lambda c: F.concat(F.lit(e.project.rstrip("/") + "/"), F.col(c))
        edges = im.resolve(probe.specs(e.project), paths)
        edges.select(whole("src").alias("src"), F.when(F.col("resolved"), whole("dst")).otherwise(F.col("dst")).alias("dst"), "import_name", "resolved", F.lit("heuristic").alias("source")).write.mode("overwrite").parquet(self._at(e.project, "edges", version))
        told = probe.chunks(e.project).count()
        out["edges_heuristic"] = self.spark.read.parquet(self._at(e.project, "edges", version)).select("src", "dst").distinct().count()
        candidate.chunks = told
        self._commit(candidate)
        if before:
            remove(self.spark, *[self._at(e.project, what, before) for what in ("files", "edges")])
        gone = [s for s in e.segments if s not in held]
        remove(self.spark, *[self._at(e.project, what, s) for s in gone for what in ("chunks", "postings", "specs")])

    def compact(self, project: str) -> None:
        """Write the live rows of all segments as one."""
        e = self.entry(project)
        if not e or len(e.segments) < 2:
            return
        segment, version = uuid.uuid4().hex[:12], uuid.uuid4().hex[:12]
        for what, rows in (("chunks", self.chunks(project)), ("specs", self.specs(project))):
            rows.write.mode("overwrite").parquet(self._at(project, what, segment))
        self.postings(project).repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(self._at(project, "postings", segment))
        self.files(project).withColumn("segment", F.lit(segment)).write.mode("overwrite").parquet(self._at(project, "files", version))
        self.edges([project]).write.mode("overwrite").parquet(self._at(project, "edges", version))
        self._commit(Entry(project, e.files, e.chunks, e.indexed_at, [segment], version))
        remove(self.spark, *[self._at(project, what, e.version) for what in ("files", "edges")], *[self._at(project, what, s) for s in e.segments for what in ("chunks", "postings", "specs")])
