"""The tools over an index: plain arguments in, plain dictionaries out, {"error": ...} where something is wrong.

Candidates are found by plans over the whole index; only the few rows of an answer come to the driver.
"""

from __future__ import annotations

import functools
import os
import re
import threading
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.functions import embed, semantic
from lodestone.functions.text import LANGUAGES, ROUTES, role
from lodestone.memory import CATEGORIES, Memory
from lodestone.operators import graph, search
from lodestone.sources import tree
from lodestone.store import Store

TASK_SECONDS, TASKS = 3600, 50
_NAMES = re.compile(r"^\s*(?:def|class|function)\s+(\w+)", re.MULTILINE)


def tool(*required: str):
    """A method as a tool: required texts must not be blank, and errors are told, not raised."""

    def made(f):
        @functools.wraps(f)
        def run(self, *args, **kwargs):
            said = dict(zip(f.__code__.co_varnames[1 : f.__code__.co_argcount], args, strict=False)) | kwargs
            for name in required:
                if not isinstance(said.get(name), str) or not said[name].strip():
                    return {"error": f"{name} is required"}
            try:
                return f(self, **said)
            except Exception as e:
                return {"error": f"{type(e).__name__}: {e}".split("\n")[0]}

        return run

    return made


def below(path: str, root: str) -> str:
    return path[len(root) :].lstrip("/") if path.startswith(root) else path


class Engine:
    def __init__(self, spark: SparkSession, data_dir: str, config: Config | None = None, embedder=embed.hashed):
        self.spark, self.config = spark, config or Config()
        c = self.config
        self.store = Store(spark, data_dir, embedder, c.chunk_strategy, c.chunk_window_lines, c.chunk_overlap_lines)
        self.memory = Memory(spark, f"{data_dir.rstrip('/')}/memory")
        self.embedder = embedder
        self.tasks: dict[str, dict] = {}
        self._one = threading.Lock()  # one index run at a time

    def _project(self, project: str | None) -> str:
        """The project asked for, else the registered one that holds the working folder, else that folder."""
        if project:
            return project.rstrip("/")
        here = os.getcwd()
        return self.store.registered(here) or here

    # ---- indexing

    @tool("path")
    def index_codebase(self, path: str, incremental: bool = True, languages: list[str] | None = None, exclude_patterns: list[str] | None = None, wait: bool = True) -> dict:
        root = path.rstrip("/")
        if not tree.exists(self.spark, root):
            return {"error": f"Path does not exist: {root}"}
        if tree.skipped(self.spark, root):
            return {"status": "skipped", "reason": f"{tree.MARKER} present", "project": root}
        self._prune()
        task = {"task_id": uuid.uuid4().hex[:12], "project": root, "status": "running", "incremental": incremental, "total_files": 0, "indexed_files": 0, "indexed_chunks": 0, "skipped_files": 0, "error": None, "started_at": time.monotonic(), "finished_at": None}
        self.tasks[task["task_id"]] = task

        def told(x: dict) -> None:
            task.update(total_files=x["total"], indexed_files=x["files"], indexed_chunks=x["chunks"], skipped_files=x["skipped"])

        def run() -> None:
            try:
                with self._one:
                    got = self.store.index(root, incremental, tuple(languages or ()), tuple(exclude_patterns or ()), told)
                task.update(status="done", orphans=got["orphans"], errors=got["errors"], graph_edges_scip=0, graph_edges_heuristic=got["edges_heuristic"])
            except Exception as e:
                task.update(status="error", error=f"{type(e).__name__}: {e}".split("\n")[0])
            task["finished_at"] = time.monotonic()

        if wait:
            run()
        else:
            threading.Thread(target=run, daemon=True).start()
        return self._task(task)

    def auto_index(self) -> list[dict]:
        return [self.index_codebase(p) for p in self.config.auto_index_paths]

    def _prune(self) -> None:
        """Finished tasks older than an hour go, then the oldest finished ones over TASKS."""
        now = time.monotonic()
        self.tasks = {k: t for k, t in self.tasks.items() if t["finished_at"] is None or now - t["finished_at"] <= TASK_SECONDS}
        done = sorted((t for t in self.tasks.values() if t["finished_at"] is not None), key=lambda t: t["finished_at"])
        for t in done[: max(0, len(self.tasks) - TASKS)]:
            del self.tasks[t["task_id"]]

    @staticmethod
    def _task(t: dict) -> dict:
        spent = (t["finished_at"] or time.monotonic()) - t["started_at"]
        done, total = t["indexed_files"], t["total_files"]
        eta = round((total - done) / (done / spent)) if t["status"] == "running" and done and spent else None
        return {k: v for k, v in t.items() if not k.endswith("_at")} | {"progress_pct": round(100 * done / total, 1) if total else 100.0, "elapsed_s": round(spent, 1), "eta_s": eta}

    @tool()
    def index_status(self, task_id: str | None = None) -> dict:
        if task_id:
            return self._task(self.tasks[task_id]) if task_id in self.tasks else {"error": f"No index task with id {task_id!r}"}
        rows = sorted(self.tasks.values(), key=lambda t: -t["started_at"])
        return {"tasks": [self._task(t) for t in rows]} | ({} if rows else {"message": "No index tasks have run yet."})

    # ---- retrieval

    def _lists(self, query: str, project: str, languages: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """The dense and the sparse ranking of one query; both keep to the project and the languages."""
        chunks = self.store.chunks(project)
        post = self.store.postings(project)
        if languages:
            chunks = chunks.filter(F.col("language").isin(*languages))
            ends = [e for e, x in LANGUAGES.items() if x in languages]
            post = post.filter(F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*ends))
        v = [float(x) for x in np.asarray(self.embedder([query]))[0]]
        asked = self.spark.createDataFrame([(0, v)], "qid long, v array<double>")
        dense = search.dense(chunks.select("id", F.col("vector").alias("v")), asked, self.config.dense_candidates)
        sparse = search.bm25_index(post, self.spark.createDataFrame([(0, query)], "qid long, query string"), self.config.sparse_candidates)
        return dense, sparse

    def _graph(self, projects: list[str] | None = None) -> DataFrame:
        return self.store.edges(projects).select("src", "dst").distinct()

    @tool("query")
    def query_code(self, query: str, k: int = 10, rerank: bool | None = None, languages: list[str] | None = None, project: str | None = None) -> dict:
        c, query, project = self.config, query.strip(), self._project(project)
        rerank = c.rerank_by_default if rerank is None else rerank
        dense, sparse = self._lists(query, project, languages)
        lists = [[(r["id"], r["rank"]) for r in x.select("id", "rank").orderBy("rank").collect()] for x in (dense, sparse)]  # 50 rows each
        fused: dict[str, float] = {}
        for ids, weight in zip(lists, (c.rrf_dense_weight, c.rrf_sparse_weight), strict=True):
            for i, r in ids:
                fused[i] = fused.get(i, 0.0) + weight / (c.rrf_k + r)
        order = sorted(fused, key=lambda i: -fused[i])  # equal scores stay in the lists' order
        wanted = list(dict.fromkeys([*order[: c.ppr_seed_k], *order[: 3 * k]]))
        fields = ("id", "file_path", "name", "chunk_type", "language", "start_line", "end_line", "semantic_text")
        rows = {r["id"]: r.asDict() for r in self.store.chunks(project).filter(F.col("id").isin(wanted)).select(*fields).collect()} if wanted else {}
        edges = self._graph()
        n_edges = edges.count()
        ppr: dict[str, float] = {}
        if rows and n_edges >= c.min_graph_edges_for_ppr:
            seeds = self.spark.createDataFrame([(rows[i]["file_path"],) for i in order[: c.ppr_seed_k] if i in rows], "node string")
            best = graph.reverse_ppr(edges, seeds, c.ppr_alpha).orderBy(F.desc("ppr"), "node").limit(3 * k)
            ppr = {r["node"]: r["ppr"] for r in best.collect()}
        weight = 0.4 if n_edges >= 5 * c.min_graph_edges_for_ppr else 0.2
        pool = [rows[i] for i in order[: 3 * k] if i in rows]
        top_rrf, top_ppr = max((fused[r["id"]] for r in pool), default=0.0), max(ppr.values(), default=0.0)
        for r in pool:
            r["score"] = 0.6 * (fused[r["id"]] / top_rrf if top_rrf else fused[r["id"]]) + weight * (ppr.get(r["file_path"], 0.0) / top_ppr if top_ppr else 0.0)
        pool.sort(key=lambda r: -r["score"])
        reranked = bool(rerank) and bool(pool) and len(pool) <= c.reranker_k
        if reranked:
            asked = set(embed.pieces(query))
            for r in pool:
                r["rerank_score"] = len(asked & set(embed.pieces(r["semantic_text"]))) / max(1, len(asked))
            pool.sort(key=lambda r: -r["rerank_score"])
        final = pool[:k]
        near: dict[str, list[str]] = {}
        if final and c.subgraph_hops:
            seeds = self.spark.createDataFrame([(f,) for f in {r["file_path"] for r in final}], "node string")
            near = {r["seed"]: r["neighbors"].split(",") if r["neighbors"] else [] for r in graph.khop(edges, seeds, c.subgraph_hops, c.neighbours).collect()}
        out = [
            {
                "file": r["file_path"], "name": r["name"], "chunk_type": r["chunk_type"], "language": r["language"], "start_line": r["start_line"], "end_line": r["end_line"],
                "score": round(r["score"], 4), "rerank_score": round(r.get("rerank_score", 0.0), 4), "snippet": r["semantic_text"][: c.snippet_chars], "neighbors": near.get(r["file_path"], []),
            }
            for r in final
        ]
        return {"query": query, "results": out, "total_candidates": len(pool), "pipeline": {"dense_hits": len(lists[0]), "sparse_hits": len(lists[1]), "rrf_merged": len(fused), "ppr_applied": bool(ppr), "reranked": reranked}}

    @tool("name")
    def get_symbol(self, name: str, language: str | None = None, fuzzy: bool = False, project: str | None = None) -> dict:
        name, project = name.strip(), self._project(project)
        if fuzzy:
            v = [float(x) for x in np.asarray(self.embedder([name]))[0]]
            asked = self.spark.createDataFrame([(0, v)], "qid long, v array<double>")
            chunks = self.store.chunks(project)
            got = search.dense(chunks.select("id", F.col("vector").alias("v")), asked, 5).join(chunks.drop("vector"), "id").orderBy("rank")
            rows = [r for r in got.collect() if not language or r["language"] == language]
            return {"results": [{"name": r["name"], "type": r["chunk_type"], "file": r["file_path"], "language": r["language"], "start_line": r["start_line"], "end_line": r["end_line"], "snippet": r["semantic_text"][:200]} for r in rows], "mode": "fuzzy"}
        got = self.store.symbols(project).filter(F.col("name") == name)
        rows = (got.filter(F.col("language") == language) if language else got).orderBy("file_path", "start_line").collect()
        out = {"results": [{"name": r["name"], "type": r["symbol_type"], "file": r["file_path"], "language": r["language"], "start_line": r["start_line"], "end_line": r["end_line"]} for r in rows], "mode": "exact"}
        return out if rows else out | {"message": f"Symbol '{name}' not found"}

    @tool("task")
    def find_existing(self, task: str, k: int = 10, project: str | None = None) -> dict:
        task, project = task.strip(), self._project(project)
        c = self.config
        dense, sparse = self._lists(task, project, None)
        chunks = self.store.chunks(project).drop("vector")
        got = search.find_existing([(dense, c.rrf_dense_weight), (sparse, c.rrf_sparse_weight)], chunks, k)
        got = got.withColumn("said", semantic.description(F.col("semantic_text"), F.col("name"))).orderBy("rank")
        out = [
            {
                "file": r["file_path"], "name": r["name"], "chunk_type": r["chunk_type"], "language": r["language"], "start_line": r["start_line"], "end_line": r["end_line"],
                "signature": r["raw_content"].split("\n")[0][:200], "snippet": r["semantic_text"][:400],
                "reuse_hint": f"Existing {r['chunk_type']} '{r['name']}' at {r['file_path']}:{r['start_line']}. {r['said']}. Import/extend instead of reimplementing.", "score": r["score"],
            }
            for r in got.collect()
        ]
        said = f"Found {len(out)} existing code items that may be relevant. Review before implementing to avoid duplication." if out else "No closely related existing code found. Safe to implement from scratch."
        return {"task": task, "existing_code": out, "total_found": len(out), "message": said}

    def duplicate_names(self, content: str, file_path: str = "", most: int = 5) -> list[dict]:
        """Symbols of other files, of any project, that are named as one that content defines."""
        names = sorted(set(_NAMES.findall(content)))
        out: list[dict] = []
        for p in self.store.projects() if names else ():
            got = self.store.symbols(p).filter(F.col("name").isin(*names) & (F.col("file_path") != file_path)).orderBy("name", "file_path", "start_line").limit(most)
            out += [{"name": r["name"], "file": r["file_path"], "line": r["start_line"]} for r in got.collect()]
        return out[:most]

    # ---- notes

    @tool("content")
    def remember(self, content: str, tags: list[str] | None = None, category: str = "general") -> dict:
        category = category if category in CATEGORIES else "general"
        return {"id": self.memory.remember(content.strip(), tags, category), "stored": True, "category": category, "tags": list(tags or [])}

    @tool("query")
    def recall(self, query: str, tags: list[str] | None = None, category: str | None = None, limit: int = 10) -> dict:
        rows = self.memory.recall(query, tags, category, limit)
        return {"results": rows, "count": len(rows)}

    # ---- projects

    @tool("project")
    def summarize_project(self, project: str) -> dict:
        root = project.strip().rstrip("/")
        if not tree.exists(self.spark, root):
            return {"error": f"Path does not exist: {root}"}
        chunks = self.store.chunks(root)
        stack = {r["language"]: r["n"] for r in chunks.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").collect()}
        if not stack:
            return {"error": "No chunks indexed for this project. Run index_codebase first."}
        nodes = self._nodes(root).orderBy(F.desc("in_degree"), "node").limit(10)
        parts = [{"file": below(r["node"], root), "role": "hub" if r["out_degree"] > 5 else "utility" if r["in_degree"] > 3 else "module", "imported_by": r["in_degree"], "imports": r["out_degree"]} for r in nodes.collect()]
        public = chunks.filter(F.col("chunk_type").isin("function", "class") & (F.col("name") != "") & ~F.col("name").startswith("_")).select("name").distinct().orderBy("name").limit(20)
        starts = [r[0] for r in tree.entry_points(tree.list_tree(self.spark, root)).collect()]
        return {"project": root, "description": tree.readme(self.spark, root), "tech_stack": stack, "entry_points": starts, "components": parts, "public_api": [r[0] for r in public.collect()], "chunk_count": sum(stack.values()), "indexed_files": chunks.select("file_path").distinct().count()}

    def _nodes(self, root: str) -> DataFrame:
        """Degrees, over the whole graph, of the nodes below root."""
        return graph.degrees(self._graph()).filter(F.col("node").startswith(root + "/"))

    @tool("project")
    def get_architecture(self, project: str) -> dict:
        root = project.strip().rstrip("/")
        edges = self._graph()
        if edges.isEmpty():
            return {"error": "No graph loaded. Run index_codebase first."}
        rows = self._nodes(root).withColumn("role", role(F.col("out_degree"), F.col("in_degree"))).orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node").limit(200).collect()
        if not rows:
            return {"project": root, "nodes": [], "edges": [], "layers": {}, "message": "No nodes in graph for this project."}
        nodes = [{"file": below(r["node"], root), "role": r["role"], "out_degree": r["out_degree"], "in_degree": r["in_degree"]} for r in rows]
        inside = edges.filter(F.col("src").startswith(root + "/") & F.col("dst").startswith(root + "/")).orderBy("src", "dst").limit(100)
        links = [{"from": below(r["src"], root), "to": below(r["dst"], root)} for r in inside.collect()]
        layers: dict[str, list[str]] = {}
        roles: dict[str, int] = {}
        for n in nodes:
            layers.setdefault(n["file"].split("/")[0] if "/" in n["file"] else "root", []).append(n["file"])
            roles[n["role"]] = roles.get(n["role"], 0) + 1
        return {"project": root, "node_count": len(nodes), "edge_count": len(links), "role_summary": roles, "nodes": nodes, "edges": links, "layers": layers}

    @tool("project")
    def project_status(self, project: str) -> dict:
        root = project.strip().rstrip("/")
        rows = self.store.chunks(root).select("file_path", "name", "chunk_type", "raw_content", "semantic_text", "start_line")
        n = rows.count()
        if not n:
            return {"error": "No chunks indexed for this project. Run index_codebase first."}
        todo = rows.select("file_path", "start_line", F.explode(semantic.markers(F.concat_ws(" ", "raw_content", "semantic_text"))).alias("m"))
        stub = rows.filter(semantic.is_stub(F.col("chunk_type"), F.col("raw_content")))
        files = rows.select("file_path").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(semantic.is_test(F.col("file_path")).cast("int")).alias("tests")).first()
        n_todo, n_stub, past = todo.count(), stub.count(), tree.history(root)
        health = "needs-attention" if n_todo > 20 or n_stub > 5 else "good"
        if past.get("files_changed_30d") == 0:
            health = "stale"
        todos = [{"file": below(r["file_path"], root), "type": r["m"]["type"], "text": r["m"]["text"]} for r in todo.orderBy("file_path", "start_line").limit(20).collect()]
        stubs = [{"file": below(r["file_path"], root), "name": r["name"], "type": r["chunk_type"]} for r in stub.orderBy("file_path", "start_line").limit(10).collect()]
        return {"project": root, "health": health, "todos": todos, "todo_count": n_todo, "stubs": stubs, "stub_count": n_stub, "test_coverage": {"test_files": files["tests"], "source_files": files["n"], "ratio": round(files["tests"] / max(1, files["n"]), 2)}, "git": past, "chunk_count": n}

    @tool("query")
    def ask_project(self, query: str, project: str | None = None) -> dict:
        project, said = self._project(project), query.lower()
        name = next((t for t, words in ROUTES.items() if any(w in said for w in words)), "query_code")
        got = self.query_code(query=query, project=project, k=10) if name == "query_code" else getattr(self, name)(project=project)
        return got | {"source_tool": name}

    def hint(self, path: str) -> str | None:
        """The registered project that a path lies in."""
        return self.store.registered(path)

    def registry(self, project: str | None = None) -> dict:
        """What is registered, of one project or of all."""
        rows = {p: {"chunks": e.chunks, "files": e.files, "indexed_at": e.indexed_at} for p, e in self.store.projects().items()}
        if project is None:
            return rows
        held = project if project in rows else self.store.registered(project)
        return rows.get(held, {}) if held else {}
