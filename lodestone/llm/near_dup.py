"""MinHash near-duplicates by DartMinHash (Christiani 2020): weighted signatures, banded joining, exact check.

A text is the multiset of its five-word shingles; similarity is weighted Jaccard, 0.8 or more. Each element has a
plane of weight by rank, cut into bands of rank and slabs of weight that double in size, and these into cells of area
one, so that a cell holds one dart on average; element and cell give its darts by a hash. A document keeps the darts
below its weights and up to a rank at which all coordinates will likely have one; each dart belongs to one coordinate,
which keeps its earliest. Two documents agree in a coordinate with a probability that equals their similarity. The work
is about k log k darts and one cell for each doubling of an element's weight, whatever the total weight.

Equal word sequences are one node, named by 64 bits of their 128-bit digest (clashes are found and named anew). Coordinates
in bands give buckets. In a bucket every node is checked against the one that meets the most nodes over all bands, so
a bucket of n copies of one text costs n checks. After components of those links, buckets that still hold more than one
component are looked at again: those of up to SMALL nodes by their pairs across components, the others by exact prefix
filtering (prefix_pairs), so no link within a bucket between components is lost; then components again. A check is exact
on sorted 64-bit hashes of the shingles, each built of mixed, not linear, hashes of its words.

What moves: digests, 8 bytes a band, and, of texts that share a bucket with another alone, sets of shingles; texts are
read twice and stay where they are. Rows per bucket, leaders and links are grouped by partial sums and joined by keys
that AQE can split; nothing is gathered for a bucket, and labels never reach the driver. Tables of up to BROADCAST_ROWS
rows of numbers are broadcast, larger ones dealt.

Recall: at similarity 0.8 a pair meets in some bucket with probability 0.9994, at 0.85 with over 0.999999.

Defined results: a text of one to four words has one shingle of all of them; all texts without a word (null, empty,
blank) are copies of one another; repeated rows, also of one id, are copies; rows of one id with different texts are
different documents; a class is named by its least id (null if it has null ids only); ties of equal id are settled by
the row; texts of any length are taken whole, one at a time; an empty table gives no rows. Other columns aren't looked
at by near_duplicates() and come through drop_near_duplicates() as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import spread
from lodestone.llm.common import map_columns, mix, shingle_hashes, table, word_hashes, words_of
from lodestone.session import remove, shared_path, ship, written

WORDS, SIMILAR = 5, 0.8
BANDS, WIDTH = 40, 8
K = BANDS * WIDTH
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Darts in a cell, one on average, by 16 bits of its hash.
_POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 9)])), (np.arange(1 << 16) + 0.5) / (1 << 16))
#: Nodes of a bucket up to which its pairs across components are checked one by one.
SMALL = 16
#: Rows of one or two numbers up to which a written table is broadcast (some 20 bytes a row, twice in memory).
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcasting if its size is proven small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def elements(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text, sorted, and how often each occurs."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass"))[2], WORDS), return_counts=True)


def copies(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A set whose plain Jaccard is the weighted one: each element once for each time it occurs; sorted."""
    if len(n) and n.max() > 1:
        nth = spread(np.zeros(len(n), np.int64), n).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = mix(np.repeat(h, n) + nth * _STEP)
    return np.unique(h)


def _cells(top: float, most: float) -> np.ndarray:
    """The parts of a plane up to rank top and weight most: rows of rank and weight where one starts, width in weight.

    Ranks are cut into bands [0, 1), [1, 2), [2, 4) ...; a band of height H has slabs of weight [0, 1/H), [1/H, 2/H),
    [2/H, 4/H) ...; a slab of width W is cut into cells of height 1/W, so that each cell has area 1.
    """
    out, rank, height = [], 0.0, 1.0
    while rank < top:
        weight, width = 0.0, 1 / height
        while weight < most:
            out.append((rank, weight, width, height))
            weight, width = weight + width, (width if weight == 0 else 2 * width)
        rank, height = rank + height, (height if rank == 0 else 2 * height)
    return np.array(out)


def dart_min_hash(h: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """The k coordinates' earliest darts (their hashes) of a weighted set; weights may be any positive numbers."""
    top = k * (np.log(k) + 3) / float(weights.sum())  # the rank up to which about that many darts lie
    while True:
        rank0, weight0, width, height = _cells(top, float(weights.max())).T
        of, part = np.nonzero(weights[:, None] > weight0)
        # as many cells, each of height 1 / width, as start below top; a band has height * width of them
        many = np.minimum(np.ceil((top - rank0) * width - 1e-9), height * width).astype(np.int64)[part]
        nth = spread(np.zeros(len(many), np.int64), many)
        of, part = np.repeat(of, many), np.repeat(part, many)
        with np.errstate(over="ignore"):
            name = mix(rank0.view(np.uint64) + mix(weight0.view(np.uint64) + _STEP))  # of the band and slab
            cell = mix(mix(h[of] + name[part]) ^ mix(nth.astype(np.uint64) + np.uint64(1)))
            darts = _POISSON[cell >> np.uint64(48)]
            at = np.repeat(np.arange(len(cell)), darts)
            dart = mix(cell[at] + (spread(np.zeros(len(cell), np.int64), darts).astype(np.uint64) + np.uint64(1)) * _STEP)
            place = dart * _STEP  # 24 bits each for the place in rank and in weight
        here = part[at]
        rank = rank0[here] + (nth[at] + (place >> np.uint64(40)) / 2.0**24) / width[here]
        weight = weight0[here] + width[here] * ((place >> np.uint64(16)) & np.uint64(0xFFFFFF)) / 2.0**24
        inside = (rank < top) & (weight < weights[of[at]])
        dart, rank = dart[inside], rank[inside]
        dart = dart[np.argsort(rank)[::-1]]  # latest first, so that each coordinate is left with its earliest
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        coordinate = (dart >> np.uint64(32)).astype(np.int64) % k
        out[coordinate], hit[coordinate] = dart, True
        if hit.all():
            return out
        top *= 2


def bands(signature: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A hash for each band of the signature; it depends on the band."""
    rows = signature.reshape(n, -1)
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, n + 1, dtype=np.uint64))
        for i in range(rows.shape[1]):
            out = mix(out * _STEP + rows[:, i])
    return out.view(np.int64)


def word_key(text: str | None) -> bytes:
    """A digest of the words in order."""
    return hashlib.blake2b(b" ".join(words_of(text)), digest_size=16).digest()


def signatures(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row a document: row (the column row, or its place in the scan), doc_id, same (a hash of the text), key of its words, weight and bands."""
    known: dict = {}  # of each worker's task

    def run(c: dict) -> dict:
        out: dict = {k: [] for k in ("key", "weight", "bands")}
        for t in c["text"]:
            key = word_key(t)
            if key not in known:
                h, n = elements(t)
                if len(known) >= 2000:
                    known.clear()
                known[key] = (key, int(n.sum()), bands(dart_min_hash(h, n.astype(float))) if len(h) else [])
            for o, v in zip(out.values(), known[key], strict=True):
                o.append(v)
        return {k: c[k] for k in ("row", "doc_id", "same")} | out

    number = F.col(row) if row else F.monotonically_increasing_id()
    return map_columns(docs.select(number.alias("row"), "doc_id", F.xxhash64("text").alias("same"), "text"), run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, same long, key binary, weight long, bands array<long>", rows=256)


def _named(rows: DataFrame, put) -> DataFrame:
    """rows with uid: 64 bits of the key; of keys that share those, others are taken."""
    short = F.xxhash64("key")
    clash = put(rows.select("key", short.alias("uid")).groupBy("uid").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("uid"), "clashes")
    rows = rows.withColumn("uid", short)
    if clash.isEmpty():
        return rows
    other = F.when(F.col("clash"), F.xxhash64("key", F.lit(1))).otherwise(F.col("uid"))
    return rows.join(clash.withColumn("clash", F.lit(True)), "uid", "left").withColumn("uid", other).drop("clash")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid and elements (sorted hashes) of the texts of wanted (uid, key, same), a written table; from one more pass over the texts."""

    def run(c: dict) -> dict:
        out: dict = {"key": [], "elements": []}
        for t in c["text"]:
            if (key := word_key(t)) not in seen:
                seen.add(key)  # a task gives a text once, however often it stands there
                out["key"].append(key)
                out["elements"].append(copies(*elements(t)).tobytes())
        return out

    seen: set = set()
    same = bounded(wanted.select("same").distinct())
    some = docs.select("text").withColumn("same", F.xxhash64("text")).join(same, "same", "left_semi").select("text")
    got = map_columns(some, run, "key binary, elements binary", rows=256)
    return got.join(wanted.select("uid", "key"), "key").groupBy("uid").agg(F.first("elements").alias("elements"))


def checked(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of pairs (a, b) those whose sets' Jaccard is at least least. b is joined first, which is even; joins by a can be split."""
    b = pairs.join(sets.select(F.col("uid").alias("b"), F.col("elements").alias("eb")), "b")
    both = b.join(sets.select(F.col("uid").alias("a"), F.col("elements").alias("ea")), "a").select("a", "b", "ea", "eb")

    def run(c: dict) -> dict:
        keep: dict = {"a": [], "b": []}
        for a, b, x, y in zip(c["a"], c["b"], c["ea"], c["eb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
            if common >= least * (len(x) + len(y) - common):
                keep["a"].append(a)
                keep["b"].append(b)
        return keep

    return map_columns(both, run, "a long, b long")


def components(links: DataFrame, base: str) -> DataFrame:
    """node, label: the least node of its component, for nodes with links. links: (a, b), written. Working tables go below base.

    Each round every node takes its least neighbour, and links go to what their ends took. Ids are in random order, so
    the rounds are about a logarithm of the longest chain; a star takes one.
    """
    put = lambda df, name: written(df, name, f"{base}/{name}-{n}")
    edges, label, n = links, None, 0
    while True:
        n += 1
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select("b", "a"))
        took = put(both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("to")), "took")
        if label is None:
            label = took.select(F.col("n").alias("node"), F.col("to").alias("label"))
        else:
            moved = label.join(took, F.col("label") == F.col("n"), "left").select("node", F.coalesce("to", "label").alias("label"))
            label = put(moved, "label")
        a = edges.join(took, F.col("a") == F.col("n")).select(F.col("to").alias("a"), "b")
        edges = put(a.join(took, F.col("b") == F.col("n")).select("a", F.col("to").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return label


#: Bits of a place in the sketch of how often elements occur, and parts in which it is summed up: 8 MB as a whole, whatever the input.
SKETCH_BITS, SLICES = 22, 16


def _places(h: np.ndarray) -> np.ndarray:
    return (mix(h.view(np.uint64)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(nodes: DataFrame) -> np.ndarray:
    """How often the elements of all nodes fall on each place, 65535 at most: never less than any element there occurs.

    A task counts what it reads and gives its places and counts packed, a row for each slice; slices are summed up apart,
    and SLICES rows of one size reach the driver.
    """
    ship(nodes.sparkSession)
    schema, wide = pa.schema([("slice", pa.int32()), ("data", pa.binary())]), (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at, k = np.unique(_places(np.frombuffer(x, np.int64)), return_counts=True)
                n[at] = np.minimum(n[at].astype(np.int64) + k, 0xFFFF)
        for i in range(SLICES):
            part = n[i * wide : (i + 1) * wide]
            if len(at := np.flatnonzero(part)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(at.astype("<u4").tobytes() + part[at].astype("<u2").tobytes(), 1)])], schema=schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = zlib.decompress(data)
                m = len(raw) // 6
                n = sums.setdefault(i, np.zeros(wide, np.int64))
                n[np.frombuffer(raw, "<u4", m)] += np.frombuffer(raw, "<u2", m, 4 * m)
        for i, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(n, 0xFFFF).astype("<u2").tobytes()])], schema=schema)

    kinds = "slice int, data binary"
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for r in nodes.select("elements").mapInArrow(count, kinds).repartition("slice").mapInArrow(total, kinds).collect():
        out[r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["data"], "<u2")
    return out


def prefix_pairs(nodes: DataFrame, put, least: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of nodes (uid, label, elements; written) of different labels that can have a Jaccard of least; none is missed.

    With all elements in one order, sets of n <= m elements with that Jaccard share one among the first
    n - 2 least n / (1 + least) + 1 of the smaller and m - least m + 1 of the larger, and enough are left behind it. The
    order is from rare to frequent ones by a sketch, then by the hash: any order misses nothing, and by this one texts that
    have much in common but not enough begin with what is theirs alone, and don't meet. An element that the sketch has
    once stands in one set and joins nothing.
    """
    often = nodes.sparkSession.sparkContext.broadcast(sketch(nodes))

    def firsts(c: dict) -> dict:
        out: dict = {k: [] for k in ("uid", "label", "n", "i", "e")}
        for uid, label, x in zip(c["uid"], c["label"], c["elements"], strict=True):
            h = np.frombuffer(x, np.int64)
            count = often.value[_places(h)]
            order = np.lexsort((h, count))[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]
            at = np.flatnonzero(count[order] > 1)
            for k, v in (("uid", [uid] * len(at)), ("label", [label] * len(at)), ("n", [len(h)] * len(at)), ("i", (at + 1).tolist()), ("e", h[order[at]].tolist())):
                out[k] += v
        return out

    whole = 2 * least / (1 + least)
    first = put(map_columns(nodes.select("uid", "label", "elements"), firsts, "uid long, label long, n int, i int, e long"), "prefixes")
    small = first.filter(F.col("i") <= F.col("n") - F.ceil(whole * F.col("n") - 1e-9) + 1)
    large = first.select("e", *[F.col(c).alias(f"{c}2") for c in ("uid", "label", "n", "i")])
    turn = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("uid") < F.col("uid2")))
    fits = F.col("n") >= F.ceil(least * F.col("n2") - 1e-9)
    behind = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) + 1 >= least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-9
    got = small.join(large, "e").filter(turn & fits & behind & (F.col("label") != F.col("label2")))
    return got.select(F.least("uid", "uid2").alias("a"), F.greatest("uid", "uid2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, class_id (the least id of its class), row (the column row of docs, or monotonically_increasing_id()) and first (whether it is the one of its class to keep)."""
    spark = docs.sparkSession
    base = shared_path(spark, "near")
    put = lambda df, name: written(df, name, f"{base}/work/{name}")
    rows = _named(put(signatures(docs, row), "signatures"), put)
    every = rows.select("uid", "weight", F.explode("bands").alias("band"))
    # buckets of more than one node; copies are one node and fall together in the sums of each task
    shared = put(every.groupBy("band").agg(F.min("uid").alias("x"), F.max("uid").alias("y")).filter("x <> y").select("band"), "shared")
    met = put(every.join(bounded(shared), "band").distinct(), "met")
    # a bucket's leader is its node that meets the most others over all bands: the text that the others are copies of
    sizes = put(met.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "sizes")
    degree = met.join(sizes, "band").groupBy("uid").agg(F.sum("n").alias("degree"))
    ranked = put(met.join(degree, "uid"), "ranked")
    lead = ranked.groupBy("band").agg(F.max(F.struct("degree", "uid", "weight")).alias("lead"))
    fits = lambda x, y: F.least(x, y) >= SIMILAR * F.greatest(x, y)
    led = ranked.join(lead, "band").filter((F.col("uid") != F.col("lead.uid")) & fits(F.col("weight"), F.col("lead.weight")))
    pairs = put(led.select(F.col("lead.uid").alias("a"), F.col("uid").alias("b")).distinct(), "pairs")
    wanted = rows.join(bounded(put(met.select("uid").distinct(), "candidates")), "uid", "left_semi").groupBy("uid").agg(F.min(F.struct("key", "same")).alias("one"))
    sets = put(shingle_sets(docs, put(wanted.select("uid", "one.*"), "wanted")), "sets")
    links = put(checked(pairs, sets), "links")
    label = components(links, f"{base}/work/first")
    # buckets that hold nodes of more than one component: their nodes across components
    there = put(met.join(label, F.col("uid") == F.col("node"), "left").select("band", "uid", "weight", F.coalesce("label", "uid").alias("label")), "labelled")
    apart = there.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band").join(sizes.filter("n > 2"), "band")  # of two, the check was the one there is
    apart = put(there.join(apart, "band"), "apart")
    few, many = apart.filter(F.col("n") <= SMALL).drop("n"), apart.filter(F.col("n") > SMALL)
    other = few.withColumnsRenamed({"uid": "uid2", "label": "label2", "weight": "weight2"})
    near = few.join(other, "band").filter((F.col("uid") < F.col("uid2")) & (F.col("label") != F.col("label2")) & fits(F.col("weight"), F.col("weight2")))
    across = near.select(F.col("uid").alias("a"), F.col("uid2").alias("b")).union(prefix_pairs(put(many.select("uid", "label").distinct().join(sets, "uid"), "mixed"), put)).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = put(checked(put(across.join(done, ["a", "b"], "left_anti"), "across"), sets), "more")
    if not more.isEmpty():
        label = components(put(links.union(more), "all"), f"{base}/work/second")
    named = rows.select("row", "doc_id", "uid").join(bounded(label), F.col("uid") == F.col("node"), "left").select("row", "doc_id", F.coalesce("label", "uid").alias("label"))
    # of a class of more than one row the least id, nulls last, and its first row
    best = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = bounded(put(best.select("label", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("kept")), "best"))
    alone = F.col("kept").isNull()
    got = named.join(best, "label", "left").select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("row") == F.col("kept"))).alias("first"))
    got = written(got, "classes", f"{base}/classes")
    remove(spark, f"{base}/work")
    return got


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each class: of its least id. docs are written once with their row numbers, which both passes read."""
    number = "__row"
    while number in docs.columns:
        number += "_"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    drop = written(near_duplicates(rows, number).filter("NOT first").select(F.col("row").alias(number)), "near-drop")
    return rows.join(bounded(drop), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
