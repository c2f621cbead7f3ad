"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon and of a short fixed list of insults, how near hits stand to second-person
words, capitals, punctuation, and how much of it is written with figures and signs in place of letters. The lexicon is
learned: words and word beginnings with their log odds among labelled rows. Lexicon and trees are cross-fitted over
folds, so trees see hits as they will be in unseen texts, and the isotonic map is fitted to out-of-fold predictions.

Labels are used only of rows whose crc32(doc_id as text) mod 4 is not HELD_OUT, and of at most MAX_LABELLED of those
(the lowest by a hash of their id, rows that repeat id and text being one); their texts are found by a broadcast of so
many ids. The lexicon has at most
MAX_TERMS entries. Scoring reads every whole text, without a shuffle; the model is a few hundred kB.

Defined results: null text is the empty text, which gets a score like any other; ids that labels lists more than once
count once, with the largest label; null labels and ids don't count; with labels of one class alone (or none) every score
is that class's share (0 where none); language, source and id are never looked at by a score; repeated rows score alike;
texts of any length are scored whole, one at a time; an empty table gives no rows. drop_toxic() lets all columns
through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, map_columns, table
from lodestone.session import ship, written

HELD_OUT, FOLDS = 2, (0, 1, 3)
#: Bounds of what is learned from: labelled rows, lexicon entries; the least toxic rows that an entry is in.
MAX_LABELLED, MAX_TERMS, LEAST = 20_000, 4_000, 3
THRESHOLD = 0.3
#: Words that a worker remembers (about 150 bytes each); when full it forgets all, which changes no result.
KNOWN = 200_000
# Insults of four languages, second-person words, letters that figures and signs stand for.
INSULTS = frozenset("idiot idiots moron moronic stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown imbecile cretin fool freak filth vermin idiota estúpido imbécil basura asqueroso escoria payaso inútil stupide débile ordure dégoûtant minable abruti crétin dummkopf trottel abschaum widerlich wertlos dreck versager".split())
YOU = frozenset("you your yours yourself u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes vosotros tú".split())
LEET = str.maketrans("013457@$!|€£", "oieastasiiel")
EDGES = ".,;:!?\"'()[]{}<>*_-…«»“”‘’"
PREFIXES = (3, 4, 5, 6)
FEATURES = ("hits", "hit_density", "weight_density", "top_weight", "second_weight", "distinct", "insult_density", "near_you", "you_density", "capitals", "shouted", "marks", "mark_runs", "obfuscated", "hidden_hits", "words")
_RUNS, _HIDDEN = re.compile(r"[!?]{2,}"), re.compile(r"[^\W\d_][\d@$!|*€£]+[^\W\d_]")


def plain(word: str) -> str:
    """A word without signs at its ends, and with letters for the figures and signs inside."""
    w = word.strip(EDGES)
    if w.isalpha():
        return w
    return "".join(c for c in w.translate(LEET) if c.isalpha()) if any(c.isalpha() for c in w) else ""


def terms(word: str) -> list[str]:
    """The word itself (marked) and its beginnings."""
    return ["=" + word, *[word[:k] for k in PREFIXES if len(word) >= k]] if word else []


class Lexicon:
    """Weights of terms; what a word counts for is remembered."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, int] = {}
        self.table = [(0.0, 0, 0, 0, 0)]
        self.array = np.zeros((1, 5))
        self.rows: dict[tuple, int] = {self.table[0]: 0}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        for w in words:
            p = plain(w)
            best = max((self.weights.get(t, 0.0) for t in terms(p)), default=0.0)
            hidden = bool(_HIDDEN.search(w.strip(EDGES)))
            row = (best, int(p in INSULTS), int(p in YOU), int(hidden), int(hidden and (best > 0 or p in INSULTS)))
            if row not in self.rows:
                self.rows[row] = len(self.table)
                self.table.append(row)
            self.known[w] = self.rows[row]
        if len(self.array) < len(self.table):
            self.array = np.array(self.table)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        n = max(1, len(words))
        known = self.known
        new = {w for w in set(words) if w not in known}  # a set less a dict's keys would go over all keys
        if new:
            self.learn(new | (set(words) if len(self.known) > KNOWN else set()))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        got = self.array[ids[ids > 0]]
        upper = 0
        shouted = marks = 0
        if text:
            upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_UPPER))
            shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper > 0.02 * len(text) else 0
            marks = text.count("!") + text.count("?")
        if not len(got):
            return [0, 0, 0, 0, 0, 0, 0, 0, 0, 100 * upper / max(1, len(text or "")), 100 * shouted / n, 100 * marks / n, len(_RUNS.findall(text)) if marks > 1 else 0, 0, 0, np.log1p(len(words))]
        weight, insult, you, hidden, hidden_hit = self.array[ids].T
        hit = (weight > 0) | (insult > 0)
        at, yous, top = np.flatnonzero(hit), np.flatnonzero(you > 0), np.sort(weight[weight > 0])[::-1]
        near = 0
        if len(at) and len(yous):
            k = np.searchsorted(yous, at)
            gap = np.minimum(np.abs(at - yous[np.minimum(k, len(yous) - 1)]), np.abs(at - yous[np.maximum(k - 1, 0)]))
            near = int((gap <= 5).sum())
        return [len(at), 100 * len(at) / n, 100 * weight.sum() / n, top[0] if len(top) else 0, top[1] if len(top) > 1 else 0, len(set(ids[at].tolist())), 100 * insult.sum() / n, near / max(1, len(at)), 100 * len(yous) / n, 100 * upper / max(1, len(text)), 100 * shouted / n, 100 * marks / n, len(_RUNS.findall(text)) if marks > 1 else 0, 100 * hidden.sum() / n, hidden_hit.sum(), np.log1p(len(words))]


_NO_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Smoothed log ratio of a term's share among toxic rows to that among others."""
    return float(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)))


class Trees:
    """Boosted trees for the logistic loss, by histograms of quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0):
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else -20.0
        self.cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T] if len(y) else []
        b = self._bins(x)
        self.trees, score = [], np.full(len(y), self.prior)
        for _ in range(rounds if len(set(y.tolist())) > 1 else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, p - y, np.maximum(p * (1 - p), 1e-9), depth, least)
            self.trees.append([(f, c, rate * v) for f, c, v in tree])
            score += self._leaf(b, self.trees[-1], depth)
        self.depth = depth

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float) -> list:
        """A full tree as a heap of (feature, last bin to the left, value); feature -1 sends all to the left."""
        tree, node = [(-1, 0, 0.0)] * (2 ** (depth + 1) - 1), np.zeros(len(g), int)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]) if len(rows) else ():
                n = len(self.cuts[f]) + 1
                cg, ch = (np.cumsum(np.bincount(b[rows, f], w[rows], n)) for w in (g, h))
                gain = cg**2 / (ch + 1) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                gain[(ch < least) | (ch[-1] - ch < least)] = 0
                if gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            tree[k] = (best[1], best[2], 0.0)
            node[rows] = 2 * k + 1 + (b[rows, best[1]] > best[2] if best[1] >= 0 else 0)
        for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
            rows = node == k
            tree[k] = (-1, 0, float(-g[rows].sum() / (h[rows].sum() + 1)))
        return tree

    @staticmethod
    def _leaf(b: np.ndarray, tree: list, depth: int) -> np.ndarray:
        f, c, v = (np.array(x) for x in zip(*tree, strict=True))
        node = np.zeros(len(b), int)
        for _ in range(depth):
            right = (f[node] >= 0) & (b[np.arange(len(b)), np.maximum(f[node], 0)] > c[node]) if b.shape[1] else False
            node = 2 * node + 1 + right
        return v[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.prior + sum((self._leaf(b, t, self.depth) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing function nearest y; each block's first and last x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, z = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = z
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)


class Model:
    """Lexicon weights, trees and calibration."""

    def __init__(self, weights: dict[str, float], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.weights, self.trees, self.knots, self.lexicon = weights, trees, knots, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.weights)
        if not texts:
            return np.zeros(0)
        m = self.trees.margin(np.array([self.lexicon.features(t) for t in texts], float))
        return np.clip(np.interp(m, *self.knots), 0, 1) if len(self.knots[0]) else np.zeros(len(m))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, fold of at most MAX_LABELLED labelled rows that aren't held out: the first by their ids' and texts' hashes. Rows that repeat both are one."""
    ids = labels.filter("toxic IS NOT NULL").withColumn("fold", crc_mod("doc_id", 4)).filter(f"fold <> {HELD_OUT}")
    ids = ids.groupBy("doc_id", "fold").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("place"), "doc_id", F.xxhash64("text").alias("of"), "text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "toxic-rows")
    # distinct texts of an id, with one row of each, before anything is ordered: repeated rows teach nothing more
    once = rows.groupBy("place", "doc_id", "of").agg(F.min("row").alias("row")).orderBy("place", "doc_id", "of").limit(MAX_LABELLED)
    return written(rows.join(F.broadcast(once.select("row")), "row", "left_semi").select("text", "toxic", "fold"), "toxic-labelled")


def _term_counts(sample: DataFrame) -> DataFrame:
    """Rows that each term is in, by fold and label, summed up in each task first."""
    ship(sample.sparkSession)
    schema = pa.schema([("term", pa.string()), ("fold", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n[fold, toxic].update({t for w in set((text or "").lower().split()) for t in terms(plain(w))} | {""})
        for (fold, toxic), c in n.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([fold] * len(c), pa.int32()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], schema=schema)

    return sample.mapInArrow(run, "term string, fold int, toxic int, n long")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, trees and calibration from the labelled rows."""
    sample = labelled(docs, labels)
    cells = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}_{y}") for f in FOLDS for y in (0, 1)]
    counts = _term_counts(sample).groupBy("term").agg(*cells)
    pos, neg = (sum(F.col(f"n{f}_{y}") for f in FOLDS) for y in (1, 0))
    top = counts.filter((F.col("term") == "") | ((pos >= LEAST) & (pos > neg))).orderBy((F.col("term") != "").cast("int"), (pos / F.sqrt(pos + neg)).desc(), "term").limit(MAX_TERMS + 1).collect()
    n = {f: {y: 0 for y in (0, 1)} for f in FOLDS}
    for r in top:
        if r["term"] == "":
            n = {f: {y: r[f"n{f}_{y}"] for y in (0, 1)} for f in FOLDS}

    def weights(folds: tuple[int, ...]) -> dict[str, float]:
        out = {}
        for r in top:
            p, q = (sum(r[f"n{f}_{y}"] for f in folds) for y in (1, 0))
            w = log_odds(p, q, sum(n[f][1] for f in folds), sum(n[f][0] for f in folds))
            if r["term"] and p >= 2 and w > 1.5:
                out[r["term"]] = w
        return out

    others = {f: weights(tuple(x for x in FOLDS if x != f)) for f in FOLDS}

    def features(c: dict) -> dict:
        lex = {f: Lexicon(w) for f, w in others.items()}
        return {"fold": c["fold"], "toxic": c["toxic"], "x": [list(map(float, lex[f].features(t))) for t, f in zip(c["text"], c["fold"], strict=True)]}

    rows = map_columns(sample.select("text", "fold", "toxic"), features, "fold int, toxic int, x array<double>", rows=4096).collect()  # at most MAX_LABELLED rows of numbers
    rows.sort(key=lambda r: (r["fold"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    y, fold = np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, Trees(x[:0], y[:0]), (np.array([-1e9, 1e9]), np.array([share, share])))
    out = np.zeros(len(y))
    for f in FOLDS:
        if (fold == f).any():
            out[fold == f] = Trees(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(weights(FOLDS), Trees(x, y), isotonic(out, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    return map_columns(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "score": known.value.score(c["text"]).tolist()}, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score threshold or more."""
    known, names = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), docs.columns

    def run(c: dict) -> dict:
        keep = (known.value.score(c["text"]) < threshold).tolist()
        return {k: [v for v, ok in zip(c[k], keep, strict=True) if ok] for k in names}

    return map_columns(docs, run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return got.select("doc_id", (crc_mod("doc_id", 4) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
