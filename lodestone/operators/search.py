"""Rankings: BM25 over postings, exact cosine in blocks of queries, fusion, re-ranking, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.text import code_terms, tokens
from lodestone.session import ship, written

K1, B, RRF_K = 1.2, 0.75, 60
#: Query vectors that are compared with all vectors in one pass; about so many are sent to the executors at once.
BLOCK = 2048


def top(df: DataFrame, by: tuple[str, ...], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group in each task before it deals them out."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


#: Rows of terms or of numbers up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it has few rows; it is counted, so it should be cheap or written."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def term_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """id, dl, m, term: a row for each code token of each text, that counts m times, and one of the empty term."""
    terms, often = code_terms(F.col(text_col))
    t = docs.select(F.col(id_col).alias("id"), *also, terms.alias("t"), often.alias("m")).withColumn("dl", F.size("t") * F.col("m"))
    return t.select("id", *also, "dl", "m", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """term, id, tf; dl, the document's number of tokens, stands beside so that no join is needed for it. The empty term stands once for each document."""
    keys = ["term", "id", *also, "dl", "m"]
    got = term_rows(docs, id_col, text_col, also).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return got.select("term", "id", *also, "dl", (F.col("n") * F.when(F.col("term") == "", 1).otherwise(F.col("m"))).alias("tf"))


def bm25_stats(post: DataFrame) -> DataFrame:
    """One row, from postings: documents and their mean number of tokens."""
    return post.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term: the distinct code tokens of queries (qid, query); queries without an id are left out."""
    return queries.filter("qid IS NOT NULL").select("qid", F.explode(F.array_distinct(code_terms(F.col("query"))[0])).alias("term"))


def bm25_scores(hits: DataFrame, asked: DataFrame, stats: DataFrame, k: int, df: DataFrame | None = None) -> DataFrame:
    """The k best ids of each query, by postings (hits), its terms (asked) and stats (one row): Lucene's form, rounded, ties by id."""
    df = df if df is not None else hits.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = hits.join(asked.join(df, "term"), "term").join(F.broadcast(stats))  # one row
    scores = met.withColumn("part", part).groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0")
    return top(scores, ("qid",), k, F.desc("score"), F.asc("id"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each query (qid, query) over code tokens, scores above 0 only.

    Texts are taken apart once: postings of the queries' terms alone, and each document's length, are written and
    everything else is read from them. For queries time and again write_index() keeps all postings.
    """
    asked = written(query_terms(queries), "bm25-asked")
    terms = bounded(asked.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct())
    keys = ["term", "id", "dl", "m"]
    got = term_rows(docs).join(terms, "term").groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    hits = written(got.select("term", "id", "dl", (F.col("c") * F.when(F.col("term") == "", 1).otherwise(F.col("m"))).alias("tf")), "bm25-hits")
    return bm25_scores(hits.filter("term <> ''"), asked, bm25_stats(hits), k)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> None:
    """All postings of docs below path, in ranges of terms: a reader that asks for some terms skips the other parts of the files."""
    post = postings(docs, id_col, text_col, also)
    post.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def bm25_index(post: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """As bm25(), over postings that were written by write_index(). The terms reach the scan as a filter where they are few."""
    asked = written(query_terms(queries), "bm25-asked")
    terms = [r[0] for r in asked.select("term").distinct().limit(LITERALS + 1).collect()]
    if len(terms) <= LITERALS:
        hits = post.filter(F.col("term").isin(terms))
    else:
        hits = post.join(bounded(asked.select("term").distinct()), "term", "left_semi")
    return bm25_scores(hits, asked, bm25_stats(post), k)


#: Terms up to which a query's are given to the scan one by one.
LITERALS = 500


def dense(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k nearest of vectors (id, v) for each of queries (qid, v) by exact cosine, rounded, ties by id.

    Queries are dealt into blocks of about BLOCK by a hash; a pass over the vectors multiplies matrices and keeps k rows a
    query and task, which are then merged. Vectors and queries that are null, without an id or of norm 0 have no
    neighbours; of vectors with one qid the least counts.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    q = written(queries.filter("qid IS NOT NULL AND v IS NOT NULL").groupBy("qid").agg(F.min("v").alias("v")), "dense-asked")
    blocks = max(1, -(-q.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        if not block:
            continue
        part = _dense_block(vectors, spark.sparkContext.broadcast(([r["qid"] for r in block], np.array([r["v"] for r in block], float))), k, dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, id {dict(vectors.dtypes)['id']}, score double")
    return top(out, ("qid",), k, F.desc("score"), F.asc("id"))


def _dense_block(vectors: DataFrame, block, k: int, qid_type: str, id_type: str) -> DataFrame:
    out = f"qid {qid_type}, id {id_type}, score double"
    schema = to_arrow_schema(T._parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = block.value
        size = np.linalg.norm(q, axis=1, keepdims=True)
        none = size[:, 0] == 0
        q = q / np.where(size == 0, 1, size)
        best_s, best_i = np.zeros((len(qid), 0)), np.zeros((len(qid), 0), object)
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and v]
            if not rows:
                continue
            v = np.array([r[1] for r in rows], float)
            norm = np.linalg.norm(v, axis=1)
            s = np.round(q @ (v / np.where(norm == 0, 1, norm)[:, None]).T, 6)
            s[:, norm == 0] = -np.inf
            s[none] = -np.inf
            ids = np.array([r[0] for r in rows], object)
            best_s, best_i = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(ids, s.shape)])
            place = np.unique(best_i, return_inverse=True)[1].reshape(best_i.shape)  # ids may be texts
            keep = np.lexsort((place, -best_s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_i, keep, 1)
        ok = np.isfinite(best_s)
        who = [x for x, n in zip(qid, ok.sum(1).tolist(), strict=True) for _ in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(who, schema[0].type), pa.array(best_i[ok].tolist(), schema[1].type), pa.array(best_s[ok])], schema=schema)

    return vectors.select("id", "v").mapInArrow(run, out)


def rrf(lists: list[tuple[DataFrame, float]], k: int | None = None, keep: bool = False) -> DataFrame:
    """Weighted reciprocal rank fusion of rankings (qid, id, rank from 1): score, rounded; ties by list, then rank there, then id.

    keep: with at, the first list and rank that name an id.
    """
    all_ = None
    for i, (df, weight) in enumerate(lists):
        part = df.select("qid", "id", (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("at"))
        all_ = part if all_ is None else all_.unionByName(part)
    got = all_.groupBy("qid", "id").agg(F.round(F.sum("part"), 8).alias("score"), F.min("at").alias("at"))
    order = [F.desc("score"), F.asc("at"), F.asc("id")]
    ranked = top(got, ("qid",), k, *order) if k else got.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    return ranked if keep else ranked.drop("at")


def evaluate(ranking: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Recall at each k and MRR at the largest, over wanted (qid, id): one row."""
    best = wanted.join(ranking.select("qid", "id", "rank"), ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("r"))
    cells = [F.round(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    return best.agg(F.count(F.lit(1)).alias("n"), *cells, F.round(F.avg(F.when(F.col("r") <= max(ks), 1 / F.col("r")).otherwise(0.0)), 6).alias(f"mrr_{max(ks)}"))


def rerank_lexical(ranking: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """A ranking's rows by the share of the query's distinct tokens that the document holds; the place where a model could stand."""
    q = queries.select("qid", F.array_distinct(tokens(F.col("query"))).alias("q"))
    d = docs.select(F.col("doc_id").alias("id"), F.array_distinct(tokens(F.col("text"))).alias("d"))
    got = ranking.select("qid", "id", "rank").join(q, "qid").join(d, "id")
    got = got.withColumn("rerank_score", F.round(F.size(F.array_intersect("q", "d")) / F.greatest(F.size("q"), F.lit(1)), 6))
    return top(got.select("qid", "id", F.col("rank").alias("old_rank"), "rerank_score"), ("qid",), 1 << 30, F.desc("rerank_score"), F.asc("old_rank"))


def grep_discovery(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k documents of each query (qid, query) that hold most of its longer words, also inside words; ties by id.

    A word of a query stands in a text only if a run of letters of the text holds it. So each text is taken apart into its
    distinct runs; of the distinct runs of all texts the parts that have a word's length are met with the words, and what
    is found is joined back by run. All joins are on equal values.
    """
    word = r"[\p{L}\p{N}_]{4,}"
    asked = written(queries.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(word), F.lit(0)))).alias("word")), "grep-asked")
    runs = written(docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)))).alias("run")), "grep-runs")
    sizes = [r[0] for r in asked.select(F.char_length("word")).distinct().collect()]  # a few lengths
    none = F.array().cast("array<string>")

    def parts_of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.char_length("run") - n + 1, F.lit(1)))
        return F.when(F.char_length("run") >= n, F.transform(at, lambda i: F.substring(F.col("run"), i, F.lit(n)))).otherwise(none)

    parts = F.array_distinct(F.flatten(F.array(*[parts_of(n) for n in sizes])))
    held = runs.select("run").distinct().select("run", F.explode(parts).alias("word")).join(bounded(asked.select("word").distinct()), "word", "left_semi") if sizes else runs.selectExpr("run", "run AS word").limit(0)
    found = runs.join(written(held, "grep-held"), "run").select("id", "word").distinct().join(bounded(asked), "word")
    scores = found.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("score"))
    return top(scores, ("qid",), k, F.desc("score"), F.asc("id"))


def passage_holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, id: the documents that hold a whole passage (qid, query), as a part of their text.

    Candidates are met by the hash of a run of four words behind the passage's first, then compared as text.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    n = 4
    p = passages.withColumn("w", words(F.col("query"))).withColumn("n", F.size("w"))
    # inner words stand whole in a text that holds the passage
    p = p.withColumn("key", F.when(F.col("n") >= n + 2, F.xxhash64(F.array_join(F.slice("w", 2, n), " "))))
    p = written(p.select("qid", "query", "key"), "passages")
    d = docs.select(F.col("doc_id").alias("id"), "text").withColumn("w", words(F.coalesce("text", F.lit(""))))
    windows = F.array_distinct(F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " ")))).otherwise(F.array().cast("array<bigint>")))
    met = d.select("id", "text", F.explode(windows).alias("key")).join(bounded(p.filter("key IS NOT NULL")), "key").filter(F.contains("text", F.col("query"))).select("qid", "id")
    short = p.filter("key IS NULL")
    if short.isEmpty():
        return met.distinct()
    few = docs.select(F.col("doc_id").alias("id"), "text").join(bounded(short), F.contains("text", F.col("query")))  # passages of up to n + 1 words have no inner run
    return met.union(few.select("qid", "id")).distinct()


def fts(notes: DataFrame, queries: DataFrame, k: int = 10, scope=None) -> DataFrame:
    """The k notes (id, text) of each query (qid, terms: an array) that hold any of its terms, by the full-text form of BM25.

    idf is ln((N - df + 0.5) / (df + 0.5)), a millionth where that isn't positive; all notes count for it. scope: a
    condition on notes that results must meet. Ties by id.
    """
    said = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = notes.select("*", F.explode(F.concat(F.array(F.lit("")), said)).alias("term")).withColumn("in", scope if scope is not None else F.lit(True))
    size = notes.select("id", F.size(said).alias("dl"))
    asked = bounded(written(queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")).filter("term <> ''"), "fts-asked"))
    tf = written(each.join(asked.select("term").distinct(), "term").groupBy("id", "in", "term").agg(F.count(F.lit(1)).alias("tf")), "fts-hits")
    stats = size.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = tf.filter("in").join(size, "id").join(df, "term").join(asked, "term").join(F.broadcast(stats))
    scores = met.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scores, ("qid",), k, F.desc("score"), F.asc("id"))


def find_existing(lists: list[tuple[DataFrame, float]], chunks: DataFrame, k: int = 10, ratio: float = 0.35, per_file: int = 2) -> DataFrame:
    """What is there already, for queries: of the fused lists' first 6 k, in the order in which the lists name them (not by
    score), functions, methods and classes of at least ratio of the best score, per_file a file, the first k.

    chunks: id, file_path, chunk_type and whatever shall come along. score is the share of the best.
    """
    fused = rrf(lists, keep=True)
    order = [F.asc("at"), F.asc("id")]
    pool = top(fused.drop("rank"), ("qid",), 6 * k, *order, rank="place")
    got = pool.join(chunks, "id").filter(F.col("chunk_type").isin("function", "method", "class"))
    got = got.withColumn("best", F.max("score").over(W.partitionBy("qid"))).filter(F.col("score") >= ratio * F.col("best"))
    got = top(got, ("qid", "file_path"), per_file, F.asc("place"), rank="in_file").drop("in_file")
    got = top(got, ("qid",), k, F.asc("place"))
    return got.withColumn("score", F.round(F.col("score") / F.col("best"), 4)).drop("best", "place", "at")
