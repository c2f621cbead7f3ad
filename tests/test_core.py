"""Formulas and plans of the retrieval operators on small tables, and queries against DuckDB."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import queries as q
from lodestone.functions import text as T
from lodestone.operators import graph, indexing, search
from lodestone.streaming.debounce import debounce, reindex_on_change

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_rrf_exact_score_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "qid long, id long, rank int")
    one = {r["id"]: r["score"] for r in search.rrf([(a, 1.0)]).collect()}
    assert one[10] == pytest.approx(1 / 61, abs=1e-8)
    both = [r["id"] for r in search.rrf([(a, 1.0), (b, 1.0)]).orderBy("rank").collect()]
    assert both == [10, 11]  # equal scores: the first list's order


def test_bm25_scopes_and_drops_zero_scores(spark):
    docs = spark.createDataFrame([(1, "function authenticate user login"), (2, "function logout user session"), (3, None), (4, "")], "doc_id long, text string")
    got = search.bm25(docs, spark.createDataFrame([(0, "authenticate login")], "qid long, query string"))
    assert [r["id"] for r in got.collect()] == [1]


def test_dense_blocks_nulls_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 1.0])], "id long, v array<double>")
    asked = v.filter("id IN (1, 2, 5)").select(F.col("id").alias("qid"), "v")
    got = {(r["qid"], r["rank"]): r["id"] for r in search.dense(v, asked, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 5, (2, 1): 2, (2, 2): 5, (5, 1): 5, (5, 2): 1}


def test_reverse_ppr_mass_and_direction(spark):
    e = spark.createDataFrame([("hub", f"leaf{i}") for i in range(6)] + [("app", "hub")], "src string, dst string")
    got = {r["node"]: r["ppr"] for r in graph.reverse_ppr(e, spark.createDataFrame([("leaf0",), ("leaf1",)], "node string"), iterations=15).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert got["hub"] > got["leaf3"]


def test_windows_and_gaps(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(20)))), (2, ""), (3, None), (4, "a\n")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_line"], r["end_line"]) for r in indexing.sliding_windows(docs, 8, 2).collect())
    assert got == [(1, 1, 8), (1, 7, 14), (1, 13, 20), (4, 1, 1)]
    runs = indexing.gap_runs(docs, spark.createDataFrame([(1, 3, 5), (1, 12, 12)], "doc_id long, first int, last int")).collect()
    assert sorted((r["start_line"], r["end_line"]) for r in runs) == [(6, 11), (13, 20)]


def test_manifest(spark):
    new = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y"), ("c", 3.0, "z")], "file string, mtime double, hash string")
    old = spark.createDataFrame([("a", 1.005, "x"), ("b", 2.5, "y"), ("d", 1.0, "w")], "file string, mtime double, hash string")
    assert {r["file"]: r["status"] for r in indexing.manifest_diff(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "orphan"}


def test_route_and_role(spark):
    df = spark.createDataFrame([("What is this about?", 9, 0), ("show LAYERS", 1, 5), ("todo?", 2, 2), ("parse json", 0, 0)], "q string, o int, i int")
    got = [(r[0], r[1]) for r in df.select(T.route(F.col("q")), T.role(F.col("o"), F.col("i"))).collect()]
    assert got == [("summarize_project", "hub"), ("get_architecture", "utility"), ("project_status", "bridge"), ("query_code", "leaf")]


def test_debounce_as_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = [("p", at(0), "a"), ("p", at(1), "b"), ("p", at(9), "a"), ("p", at(50), "z")]
    spark.createDataFrame(rows, "project string, ts timestamp, path string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("project string, ts timestamp, path string").parquet(str(tmp_path / "in"))
    run = debounce(s, late="1 second").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["n"], r["paths"]) for r in spark.table("sessions").collect()) == [(1, ["a"]), (2, ["a", "b"])]


def test_dense_without_ids_and_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0])], "qid long, v array<double>")
    assert [(r["qid"], r["id"], r["rank"]) for r in search.dense(v, asked, 1).collect()] == [(1, "a", 1)]
    assert search.dense(v, asked.limit(0), 1).count() == 0


def test_written_index_ranks_as_the_direct_plan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} camelCase_{i} alpha beta" + " beta" * (i % 4)) for i in range(40)] + [(99, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "beta camel"), (1, "word1 CASE"), (None, "beta")], "qid long, query string")
    search.write_index(docs, str(tmp_path / "ix"))
    rows = lambda df: sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))
    a, b = rows(search.bm25(docs, asked, 7)), rows(search.bm25_index(spark.read.parquet(str(tmp_path / "ix")), asked, 7))
    assert a == b and len(a) == 14


def test_large_and_small_graphs_agree(spark, monkeypatch):
    e = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 3) % 23}") for i in range(40)] + [("app", "n1"), ("n2", "app")], "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("app",), ("none",)], "node string")
    small = {r["node"]: r["ppr"] for r in graph.reverse_ppr(e, seeds, iterations=6, tol=0.0).collect()}
    monkeypatch.setattr(graph, "LOCAL_EDGES", 3)
    large = {r["node"]: r["ppr"] for r in graph.reverse_ppr(e, seeds, iterations=6, tol=0.0).collect()}
    assert large == pytest.approx(small) and sum(small.values()) == pytest.approx(1)
    monkeypatch.undo()
    with pytest.raises(graph.NotConverged):
        graph.reverse_ppr(e, seeds, iterations=1, tol=1e-12, strict=True)
    assert graph.reverse_ppr(e.limit(0), seeds).count() == 0


def test_neighbours_through_hubs(spark):
    e = spark.createDataFrame([("hub", f"leaf{i:02d}") for i in range(30)] + [("app", "hub"), ("app", "zz")], "src string, dst string")
    got = {r["seed"]: r["neighbors"] for r in graph.khop(e, spark.createDataFrame([("app",), ("leaf00",), ("none",)], "node string"), 2, 3).collect()}
    assert got == {"app": "hub,leaf00,leaf01", "leaf00": "app,hub,leaf01", "none": ""}


def test_event_sets_reach_their_projects(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = [(at(0), "/p/a.py", None), (at(1), "/p/sub/b.txt", "/p/sub/c.go"), (at(1), "/other/x.py", None), (at(50), "/p/z.py", None), (at(55), "/p2/z.py", None)]
    spark.createDataFrame(rows, "ts timestamp, path string, moved_to string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string, moved_to string").parquet(str(tmp_path / "in"))
    done: list[str] = []
    run = reindex_on_change(stream, ["/p", "/p/sub", "/p2"], done.append, str(tmp_path / "check"), late="1 second")
    run.processAllAvailable()
    run.stop()
    assert sorted(done) == ["/p", "/p/sub"]


@pytest.mark.parametrize("name", ["token_df", "bm25_topk", "dense_topk", "rrf_fuse", "sliding_windows", "khop_neighbors", "merge_rrf_ppr", "debounce_sessions", "registry_longest_prefix", "find_existing", "memory_recall", "source_chunks", "source_imports", "project_status"])
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = q.queries()[name](spark, SF).toPandas(), c.execute(q.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(tuple(repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False))
    assert rows(a) == rows(b)
