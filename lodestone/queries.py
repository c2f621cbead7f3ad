"""The queries over the retrieval operators and their SQL.

Documents stand for chunks: doc_id the id, source the project, lang the language, text both meaning and content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import sample_sources as sample
from lodestone.functions import semantic
from lodestone.functions import text as T
from lodestone.memory import CATEGORIES
from lodestone.operators import chunks, graph, imports, indexing, search
from lodestone.session import written
from lodestone.streaming.debounce import debounce

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _path() -> object:
    return F.concat_ws("/", F.lit(""), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda x: x NOT IN ({_STOP}))"


def _words(col: str) -> str:
    return _TOKENS.format(col)


def _copies(col: str) -> str:
    """The four copies of code_tokens()."""
    snake = f"regexp_replace({col}, '_+', ' ', 'g')"
    camel = f"regexp_replace({snake}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"concat_ws(' ', {col}, {snake}, {camel}, regexp_replace({camel}, '([a-zA-Z])([0-9])', '\\1 \\2', 'g'))"


def _tok(col: str) -> str:
    return _TOKENS.format(_copies(col))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND lang IN ('en', 'fr')")
def scan_filter_project_lang(spark, sf):
    return t(spark, sf, "documents").filter((F.col("source") == "src3") & F.col("lang").isin("en", "fr")).select("doc_id", "n_chars")


@query("SELECT doc_id, substr(sha256(concat_ws('::', '/' || source || '/' || doc_id || '.txt', '__module__', '0')), 1, 16) AS id FROM documents")
def chunk_id_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.chunk_id(_path(), F.lit("__module__"), F.lit(0)).alias("id"))


@query(f"SELECT page_id, lower({_copies('url')}) AS tokens FROM pages")
def code_tokenize(spark, sf):
    return t(spark, sf, "pages").select("page_id", T.code_tokens(F.col("url")).alias("tokens"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY term")
def token_df(spark, sf):
    return search.postings(t(spark, sf, "documents")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, round(avg(len({_tok('text')})), 6) AS avgdl FROM documents")
def bm25_stats(spark, sf):
    return search.bm25_stats(search.postings(t(spark, sf, "documents"))).select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25_sql(docs: str, k: int) -> str:
    return f"""d AS (SELECT doc_id AS id, {_tok('text')} AS tk FROM {docs}), s AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM d),
p AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(tk) AS dl, unnest(tk) AS term FROM d) GROUP BY term, id, dl),
q AS (SELECT item_id AS qid, unnest(list_distinct({_tok('text')})) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY qid, id),
bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


def _asked(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"WITH {_bm25_sql('documents', 50)} SELECT qid, id, score, rank FROM bm")
def bm25_topk(spark, sf):
    return search.bm25(t(spark, sf, "documents"), _asked(spark, sf), 50).select("qid", "id", "score", "rank")


@query(f"WITH {_bm25_sql('(SELECT * FROM documents WHERE source = $$src3$$)', 20)} SELECT qid, id, score, rank FROM bm")
def bm25_topk_project(spark, sf):
    return search.bm25(t(spark, sf, "documents").filter("source = 'src3'"), _asked(spark, sf), 20).select("qid", "id", "score", "rank")


_BENCH = "q.vec_id IN (SELECT item_id FROM benchmark)"


def _dense_sql(where: str, k: int, asked: str = "q.vec_id % 20 = 0") -> str:
    dot = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
    return f"""dn AS (SELECT q.vec_id AS qid, v.vec_id AS id, round({dot} / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE {asked} AND {where} QUALIFY rank <= {k})"""


def _vectors(spark, sf) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked_vectors(spark, sf) -> DataFrame:
    """The stated query set of searches: every id divisible by 20."""
    return _vectors(spark, sf).filter("id % 20 = 0").select(F.col("id").alias("qid"), "v")


@query(f"WITH {_dense_sql('true', 20)} SELECT qid, id, score, rank FROM dn")
def dense_topk(spark, sf):
    return search.dense(_vectors(spark, sf), _asked_vectors(spark, sf), 20).select("qid", "id", "score", "rank")


@query(f"WITH {_dense_sql('v.label IN (1, 2)', 20)} SELECT qid, id, score, rank FROM dn")
def dense_topk_prefilter(spark, sf):
    return search.dense(_vectors(spark, sf).filter("label IN (1, 2)"), _asked_vectors(spark, sf), 20).select("qid", "id", "score", "rank")


def _rrf_sql(a: str, wa: float, b: str, wb: float, k: int) -> str:
    return f"""fu AS (SELECT qid, id, round(sum(part), 8) AS score, min(l * 1000000 + rank) AS spot FROM (
SELECT qid, id, {wa} / (60 + rank) AS part, 0 AS l, rank FROM {a} UNION ALL SELECT qid, id, {wb} / (60 + rank), 1, rank FROM {b}) GROUP BY qid, id),
rr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, spot, id) AS rank FROM fu QUALIFY rank <= {k})"""


_HYBRID = f"WITH {_bm25_sql('documents', 50)}, {_dense_sql('true', 50, _BENCH)}, {_rrf_sql('dn', 1.0, 'bm', 0.5, 10)}"


def _bench_vectors(spark, sf) -> DataFrame:
    """The vectors of the benchmark's ids: both lists of a hybrid query answer the same queries."""
    items = t(spark, sf, "benchmark").select(F.col("item_id").alias("id")).distinct()
    return _vectors(spark, sf).join(items, "id", "left_semi").select(F.col("id").alias("qid"), "v")


def _lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    return search.dense(_vectors(spark, sf), _bench_vectors(spark, sf), 50), search.bm25(t(spark, sf, "documents"), _asked(spark, sf), 50)


@query(f"{_HYBRID} SELECT r.qid, r.id, r.score, r.rank, d.source, d.lang FROM rr r LEFT JOIN documents d ON d.doc_id = r.id")
def hybrid_query(spark, sf):
    """Dense and sparse lists, weights 1 and 0.5; a query's vector is the one of its id."""
    dense, sparse = _lists(spark, sf)
    got = search.rrf([(dense, 1.0), (sparse, 0.5)], 10)
    return got.join(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang"), "id", "left").select("qid", "id", "score", "rank", "source", "lang")


@query(f"WITH {_bm25_sql('documents', 50)}, {_dense_sql('true', 50, _BENCH)}, {_rrf_sql('dn', 1.0, 'bm', 1.0, 1000000)} SELECT qid, id, score, rank FROM rr")
def rrf_fuse(spark, sf):
    dense, sparse = _lists(spark, sf)
    return search.rrf([(dense, 1.0), (sparse, 1.0)]).select("qid", "id", "score", "rank")


@query(f"{_HYBRID} SELECT qid, id, score, rank FROM rr")
def rrf_weighted_topk(spark, sf):
    dense, sparse = _lists(spark, sf)
    return search.rrf([(dense, 1.0), (sparse, 0.5)], 10).select("qid", "id", "score", "rank")


_WANTED = "w AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_bm25_sql('documents', 50)}, {_WANTED}, e AS (SELECT w.qid, min(bm.rank) AS r FROM w LEFT JOIN bm ON bm.qid = w.qid AND bm.id = w.id GROUP BY w.qid) SELECT count(*) AS n, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr_10 FROM e")
def recall_mrr(spark, sf):
    """Of the benchmark's passages: is a document that holds the whole passage found by it."""
    docs, asked = t(spark, sf, "documents"), _asked(spark, sf)
    return search.evaluate(search.bm25(docs, asked, 50), search.passage_holders(docs, asked))


@query(f"WITH {_bm25_sql('documents', 50)}, dd AS (SELECT doc_id AS id, {_words('text')} AS tk FROM documents), qq AS (SELECT item_id AS qid, list_distinct({_words('text')}) AS q FROM benchmark), x AS (SELECT bm.qid, bm.id, bm.rank AS old_rank, round(len(list_intersect(q, list_distinct(dd.tk))) / greatest(len(q), 1), 6) AS rerank_score FROM bm JOIN dd USING (id) JOIN qq USING (qid)) SELECT qid, id, old_rank, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, old_rank) AS rank FROM x")
def rerank_lexical(spark, sf):
    docs, asked = t(spark, sf, "documents"), _asked(spark, sf)
    return search.rerank_lexical(search.bm25(docs, asked, 50), asked, docs).select("qid", "id", "old_rank", "rerank_score", "rank")


@query("""WITH w AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}')) AS word FROM benchmark),
x AS (SELECT qid, doc_id AS id, count(*) AS score FROM w JOIN documents ON contains(lower(text), word) GROUP BY qid, doc_id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x QUALIFY rank <= 10""")
def grep_discovery(spark, sf):
    """Documents by how many of a query's longer words stand in them, also inside words."""
    return search.grep_discovery(t(spark, sf, "documents"), _asked(spark, sf), 10).select("qid", "id", "score", "rank")


_LINES = "l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents), ln AS (SELECT doc_id, ls, len(ls) AS n FROM l WHERE len(ls) > 0)"


@query(f"WITH {_LINES}, w AS (SELECT *, unnest(range(CASE WHEN n <= 8 THEN 1 ELSE 1 + CAST(ceil((n - 8) / 6.0) AS BIGINT) END)) AS i FROM ln) SELECT doc_id, i * 6 + 1 AS start_line, least(i * 6 + 8, n) AS end_line, sha256(array_to_string(ls[i * 6 + 1 : i * 6 + 8], chr(10))) AS content FROM w")
def sliding_windows(spark, sf):
    got = indexing.sliding_windows(t(spark, sf, "documents"), 8, 2)
    return got.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("content", 256).alias("content"))


@query(f"WITH {_LINES}, f AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT doc_id, unnest(range(1, n + 1)) AS line FROM ln) WHERE NOT (line BETWEEN 3 AND 4 OR line BETWEEN 12 AND 15)) SELECT doc_id, min(line) AS start_line, max(line) AS end_line FROM f GROUP BY doc_id, run HAVING count(*) >= 5")
def gap_windows(spark, sf):
    docs = t(spark, sf, "documents")
    covered = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((3, 4), (12, 15))])).alias("r")).select("doc_id", "r.*")
    return indexing.gap_runs(docs, covered).select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def _manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Now: all documents but those of src1. Before: hashes that differ for ids 1 mod 7, times for 2 mod 7, none for 3 mod 7."""
    d = t(spark, sf, "documents").select(_path().alias("file"), F.col("doc_id").cast("double").alias("mtime"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"), "doc_id", "source")
    m = F.col("doc_id") % 7
    old = d.filter(m != 3).select("file", (F.col("mtime") + F.when(m == 2, 1.0).otherwise(0.0)).alias("mtime"), F.when(m == 1, "x").otherwise(F.col("hash")).alias("hash"))
    return d.filter("source <> 'src1'").select("file", "mtime", "hash"), old


@query("SELECT '/' || source || '/' || doc_id || '.txt' AS file, CASE WHEN source = 'src1' THEN 'orphan' WHEN doc_id % 7 = 3 THEN 'new' WHEN doc_id % 7 IN (1, 2) THEN 'changed' ELSE 'unchanged' END AS status FROM documents WHERE NOT (source = 'src1' AND doc_id % 7 = 3)")
def manifest_diff(spark, sf):
    return indexing.manifest_diff(*_manifests(spark, sf))


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' THEN n_chars + 1 ELSE n_chars END AS size FROM documents")
def merge_upsert(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("size"))
    return indexing.upsert(d.select("id", "size"), d.filter("lang = 'en'").select("id", (F.col("size") + 1).alias("size")))


@query("SELECT '/' || source || '/' || doc_id || '.txt' AS file FROM documents WHERE source <> 'src1' AND doc_id % 7 <> 3")
def orphan_purge(spark, sf):
    new, old = _manifests(spark, sf)
    return indexing.purge(old, new).select("file")


_EDGES = "e AS (SELECT DISTINCT * FROM (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation UNION ALL SELECT 'supplier/' || l_suppkey, 'part/' || l_partkey FROM lineitem))"


def _edges(spark, sf) -> DataFrame:
    out = None
    for table, a, b, x, y in (("customer", "customer", "nation", "c_custkey", "c_nationkey"), ("supplier", "supplier", "nation", "s_suppkey", "s_nationkey"), ("nation", "nation", "region", "n_nationkey", "n_regionkey"), ("lineitem", "supplier", "part", "l_suppkey", "l_partkey")):
        part = t(spark, sf, table).select(F.concat(F.lit(a + "/"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b + "/"), F.col(y).cast("string")).alias("dst"))
        out = part if out is None else out.union(part)
    return out.distinct()


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def graph_edges(spark, sf):
    return _edges(spark, sf)


_DEGREES = f"WITH {_EDGES}, g AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)"


@query(f"{_DEGREES} SELECT node, in_degree, out_degree FROM g")
def graph_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(f"{_DEGREES} SELECT role, count(*) AS n FROM (SELECT CASE WHEN out_degree > 5 THEN 'hub' WHEN in_degree > 3 AND out_degree <= 2 THEN 'utility' WHEN out_degree >= 2 AND in_degree >= 2 THEN 'bridge' ELSE 'leaf' END AS role FROM g) GROUP BY role")
def graph_roles(spark, sf):
    return graph.roles(_edges(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES} SELECT split_part(node, '/', 1) AS layer, count(DISTINCT node) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def graph_layers(spark, sf):
    return graph.degrees(_edges(spark, sf)).groupBy(F.substring_index("node", "/", 1).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT src AS seed FROM e WHERE src LIKE 'supplier/%'), r1 AS (SELECT DISTINCT seed, dst AS node FROM s JOIN b ON b.src = s.seed), r2 AS (SELECT seed, node FROM r1 UNION SELECT r1.seed, b.dst FROM r1 JOIN b ON b.src = r1.node), k AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS r FROM r2 WHERE node <> seed) SELECT s.seed, coalesce(string_agg(node, ',' ORDER BY node), '') AS neighbors FROM s LEFT JOIN (SELECT * FROM k WHERE r <= 10) k ON k.seed = s.seed GROUP BY s.seed")
def khop_neighbors(spark, sf):
    e = _edges(spark, sf)
    return graph.khop(e, e.filter(F.col("src").startswith("supplier/")).select(F.col("src").alias("node")).distinct(), 2)


#: The query's rule: ranks stop where they change by less than nodes * 1e-6 in sum; the SQL has more rounds than that takes.
_ROUNDS = 64


def _ppr_sql() -> str:
    m = "AS MATERIALIZED"
    ctes = f"WITH {_EDGES.replace(' AS (', f' {m} (', 1)}, n {m} (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT dst AS u, count(*) AS deg FROM e GROUP BY dst), k AS (SELECT count(*) AS k FROM n WHERE node LIKE 'part/%0'), r0 {m} (SELECT node, deg, CASE WHEN node LIKE 'part/%0' THEN 1.0::DOUBLE / k ELSE 0.0::DOUBLE END AS p, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n LEFT JOIN o ON o.u = node, k)"
    for i in range(1, _ROUNDS + 1):
        ctes += f", f{i} AS (SELECT e.src AS v, sum(r / deg) AS x FROM e JOIN r{i - 1} ON node = e.dst GROUP BY e.src), r{i} {m} (SELECT node, deg, p, 0.85::DOUBLE * (coalesce(x, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE deg IS NULL) * p) + (1 - 0.85::DOUBLE) * p AS r FROM r{i - 1} LEFT JOIN f{i} ON v = node)"
    every = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.r - b.r)) AS change FROM r{i} a JOIN r{i - 1} b USING (node)" for i in range(1, _ROUNDS + 1))
    last = " UNION ALL ".join(f"SELECT node, round(r, 8) AS ppr FROM r{i} WHERE (SELECT i FROM stop) = {i}" for i in range(1, _ROUNDS + 1))
    return f"{ctes}, c {m} ({every}), stop {m} (SELECT min(i) AS i FROM c WHERE change < (SELECT count(*) FROM n) * 1e-6) {last}"


@query(_ppr_sql())
def reverse_ppr(spark, sf):
    """Seeds: every tenth part. Rank flows from parts to suppliers and from nations to what lies in them."""
    e = _edges(spark, sf)
    seeds = e.filter(F.col("dst").startswith("part/") & F.col("dst").endswith("0")).select(F.col("dst").alias("node"))
    return graph.reverse_ppr(e, seeds, strict=True).select("node", F.round("ppr", 8).alias("ppr"))


@query("WITH a AS (SELECT s_suppkey AS id, 'nation/' || s_nationkey AS file, 1.0::DOUBLE / (60 + s_suppkey) AS score FROM supplier), b AS (SELECT 'nation/' || c_nationkey AS node, count(*)::DOUBLE AS ppr FROM customer GROUP BY 1) SELECT id, round(0.6::DOUBLE * score / (SELECT max(score) FROM a) + 0.4::DOUBLE * coalesce(ppr / (SELECT max(ppr) FROM b), 0), 6) AS score FROM a LEFT JOIN b ON file = node")
def merge_rrf_ppr(spark, sf):
    a = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("file"), (1.0 / (60 + F.col("s_suppkey"))).alias("score"))
    b = t(spark, sf, "customer").groupBy(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("node")).agg(F.count(F.lit(1)).cast("double").alias("ppr"))
    return graph.merge_rrf_ppr(a, b)


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'module' END"


@query(f"""WITH {_bm25_sql('documents', 50)}, {_dense_sql('true', 50, _BENCH)}, fu AS (SELECT qid, id, round(sum(part), 8) AS s, min(l * 1000000 + rank) AS spot FROM (
SELECT qid, id, 1.0 / (60 + rank) AS part, 0 AS l, rank FROM dn UNION ALL SELECT qid, id, 0.5 / (60 + rank), 1, rank FROM bm) GROUP BY qid, id),
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, id) AS place FROM fu QUALIFY place <= 60),
x AS (SELECT pool.*, source AS file_path, max(s) OVER (PARTITION BY qid) AS best FROM pool JOIN documents ON doc_id = id WHERE {_KIND} <> 'module'),
y AS (SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY place) AS pf FROM x WHERE s >= 0.35 * best)
SELECT qid, id, file_path, round(s / best, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM y WHERE pf <= 2 QUALIFY rank <= 10""")
def find_existing(spark, sf):
    """The fused pool in the lists' order, at least 0.35 of the best, two a file (here a source) at most, the first ten."""
    dense, sparse = _lists(spark, sf)
    kinds = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.expr(_KIND).alias("chunk_type"))
    return search.find_existing([(dense, 1.0), (sparse, 0.5)], kinds, 10).select("qid", "id", "file_path", "score", "rank")


@query(f"WITH {_dense_sql('true', 5)} SELECT dn.qid, dn.id, dn.rank FROM dn JOIN embeddings a ON a.vec_id = dn.qid JOIN embeddings b ON b.vec_id = dn.id WHERE a.label = b.label")
def symbol_fuzzy(spark, sf):
    """The five nearest, then those of one's own label (a language): fewer than five may be left."""
    label = t(spark, sf, "embeddings").select(F.col("vec_id").alias("x"), F.col("label").alias("l"))
    got = search.dense(_vectors(spark, sf), _asked_vectors(spark, sf), 5).join(label, F.col("qid") == F.col("x")).withColumnRenamed("l", "asked").drop("x")
    return got.join(label, F.col("id") == F.col("x")).filter("asked = l").select("qid", "id", "rank")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def symbol_exact(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return part.join(F.broadcast(part.agg(F.min("p_name").alias("p_name"))), "p_name", "left_semi").select("p_partkey", "p_name", "p_brand")


@query("SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(*) > 1")
def dup_symbols(spark, sf):
    return t(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands")).filter("n > 1")


@query("""WITH h AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS spec FROM pages) SELECT h.src, h.spec, p.url IS NOT NULL AS resolved FROM h LEFT JOIN (SELECT DISTINCT url FROM pages) p ON p.url = h.spec""")
def import_edges(spark, sf):
    pages = t(spark, sf, "pages")
    links = pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("spec")).distinct()
    known = pages.select(F.col("url").alias("spec"), F.lit(True).alias("k")).distinct()
    return links.join(known, "spec", "left").select("src", "spec", F.coalesce("k", F.lit(False)).alias("resolved"))


_NOTE_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH m AS (SELECT conv_id || '/' || turn AS id, role, {_NOTE_TOK.format('text')} AS tk FROM conversations), st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM m),
q AS (SELECT item_id AS qid, unnest(list_distinct({_NOTE_TOK.format('text')})) AS term FROM benchmark),
tf AS (SELECT id, role, dl, term, count(*) AS tf FROM (SELECT id, role, len(tk) AS dl, unnest(tk) AS term FROM m) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT qid, id, round(sum(greatest(CASE WHEN n - df > df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st WHERE role = 'user' GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x QUALIFY rank <= 10""")
def memory_recall(spark, sf):
    """Notes of one category (users' turns) by the full-text BM25 of a query's words, any of them."""
    m = t(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "role", "text")
    q = _asked(spark, sf).select("qid", F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("terms"))
    return search.fts(m, q, 10, F.col("role") == "user").select("qid", "id", "score", "rank")


def _route_sql(col: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({col}), '{s.replace(chr(39), chr(39) * 2)}')" for s in said) + f" THEN '{tool}'" for tool, said in T.ROUTES.items())
    return f"CASE {whens} ELSE 'query_code' END"


@query(f"SELECT conv_id, turn, {_route_sql('text')} AS tool FROM conversations WHERE role = 'user'")
def ask_route(spark, sf):
    return t(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.route(F.col("text")).alias("tool"))


@query("SELECT source AS project, lang AS language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS last FROM documents GROUP BY source, lang")
def summarize_project(spark, sf):
    return t(spark, sf, "documents").groupBy(F.col("source").alias("project"), F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("last"))


def _chunked(spark, sf, strategy: str = "ast", size: int = 64, overlap: int = 16) -> DataFrame:
    return chunks.chunk_files(sample.sources(spark, sf), strategy, size, overlap)


@query(sample.chunks_sql())
def source_chunks(spark, sf):
    """Symbols of files of eight languages: names, kinds, lines, parents, ids and sentences."""
    return _chunked(spark, sf).select("id", "file_path", "language", "chunk_type", "name", "start_line", "end_line", "parent_name", "semantic_text")


@query(sample.windows_sql())
def source_gap_windows(spark, sf):
    """Windows of four lines in the gaps between symbols."""
    return _chunked(spark, sf, "hybrid", 4, 1).filter("chunk_type = 'window'").select("file_path", "start_line", "end_line")


@query(sample.descriptions_sql())
def source_descriptions(spark, sf):
    return _chunked(spark, sf).filter("chunk_type <> 'module'").select("file_path", "name", "start_line", semantic.description(F.col("semantic_text"), F.col("name")).alias("description"))


@query(sample.imports_sql())
def source_imports(spark, sf):
    """What each file imports, and the file that it means, if that is there."""
    files = written(sample.sources(spark, sf), "sample-sources")
    return imports.resolve(imports.import_specs(files), files).select("project", "src", "import_name", "resolved", "dst")


@query(sample.status_sql())
def project_status(spark, sf):
    """Markers of work left, stubs, the share of tests, and what follows for a project's health."""
    c = _chunked(spark, sf).withColumn("project", F.split_part("file_path", F.lit("/"), F.lit(2)))
    n = F.size(semantic.markers(F.concat_ws(" ", "raw_content", "semantic_text")))
    stub = semantic.is_stub(F.col("chunk_type"), F.col("raw_content")).cast("long")
    got = c.groupBy("project", "file_path").agg(F.sum(n).alias("todo"), F.sum(stub).alias("stub")).groupBy("project")
    got = got.agg(F.sum("todo").alias("todo_count"), F.sum("stub").alias("stub_count"), F.count(F.lit(1)).alias("source_files"), F.round(F.avg(semantic.is_test(F.col("file_path")).cast("double")), 2).alias("ratio"))
    return got.withColumn("health", F.when((F.col("todo_count") > 20) | (F.col("stub_count") > 5), "needs-attention").otherwise("good"))


@query("WITH o AS (SELECT 's' || l_suppkey AS file, 'p' || l_partkey AS symbol, l_linenumber = 1 AS def, l_orderkey AS nth FROM lineitem), d AS (SELECT symbol, arg_max(file, {'nth': nth, 'file': file}) AS dst FROM o WHERE def GROUP BY symbol) SELECT DISTINCT file AS src, dst FROM o JOIN d USING (symbol) WHERE NOT def AND file <> dst")
def occurrence_edges(spark, sf):
    """References to other files' definitions; of a symbol's definitions the last counts."""
    o = t(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"), (F.col("l_linenumber") == 1).cast("int").alias("role"), F.col("l_orderkey").alias("nth"))
    return imports.occurrence_edges(o)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def edge_upsert(spark, sf):
    """Of rows with one key the one written last."""
    return indexing.latest(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("WITH f AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR), u AS (SELECT event_id FROM events WHERE event_type = 'error') SELECT event_id FROM u UNION ALL SELECT event_id FROM f WHERE r <= greatest(0, 5000 - (SELECT count(*) FROM u))")
def task_prune(spark, sf):
    """Tasks that run (errors) stay; of those that have ended (clicks) none older than a day, and the latest up to 5000 in all."""
    e = t(spark, sf, "events").filter("event_type IN ('click', 'error')")
    now = e.sparkSession.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]
    ended = e.select("event_id", F.when(F.col("event_type") == "click", F.col("ts")).alias("finished_at"))
    return indexing.prune(ended, now, "24 hours", 5000).select("event_id")


@query(f"SELECT conv_id, turn, CASE WHEN role IN ({', '.join(repr(c) for c in CATEGORIES)}) THEN role ELSE 'general' END AS category FROM conversations")
def memory_categories(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role").isin(*CATEGORIES), F.col("role")).otherwise("general").alias("category"))


@query(f"WITH {_EDGES}, n AS (SELECT count(*) AS edges FROM e) SELECT edges, edges >= 50 AS applied, CASE WHEN edges >= 250 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM n")
def ppr_gate(spark, sf):
    """Whether, and with what weight, PageRank counts: by the number of edges."""
    return graph.gate(_edges(spark, sf))


@query("WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)/', 1) FROM pages) SELECT url, root FROM (SELECT url, root, row_number() OVER (PARTITION BY url ORDER BY length(root) DESC) AS k FROM (SELECT DISTINCT url FROM pages) JOIN r ON root <> '' AND (url = root OR starts_with(url, root || '/'))) WHERE k = 1")
def registry_longest_prefix(spark, sf):
    """The longest registered root that holds a path by whole parts: an equi-join on the path's ancestors."""
    urls = t(spark, sf, "pages").select("url").distinct()
    roots = urls.select(F.explode(F.array(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.regexp_extract("url", "^(https?://[^/]+/[^/]+)/", 1))).alias("root")).filter("root <> ''").distinct()
    parts = F.split("url", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    got = urls.select("url", F.explode(above).alias("root")).join(roots, "root")
    return got.groupBy("url").agg(F.max_by("root", F.length("root")).alias("root"))


@query("SELECT user_id, count(*) AS total, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS done, round(100.0 * sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / count(*), 1) AS pct FROM events GROUP BY user_id")
def index_progress(spark, sf):
    done = F.sum((F.col("event_type") == "click").cast("long"))
    return t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), done.alias("done"), F.round(100.0 * done / F.count(F.lit(1)), 1).alias("pct"))


@query("WITH a AS (SELECT user_id AS project, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT project, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM b GROUP BY project, s")
def debounce_sessions(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("project"), "ts", F.col("event_type").alias("path"))
    return debounce(e, "6 hours").withColumn("paths", F.array_join("paths", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
