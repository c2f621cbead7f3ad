"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Counts of a text are transformed to a vector of steady scale (shrunk rates, by logarithm or arcsine of the root), so
that short texts, whose rates are noisy, come near the usual ones. Per (lang, source) a deterministic start (median and
scaled median deviation of each coordinate) is improved by concentration steps: the half of the rows that lie nearest
by Mahalanobis distance give the next mean and covariance, which never raises the covariance's determinant. The raw
estimate is then reweighted: rows within the 97.5% quantile give the final one. A text is rejected where its distance
from that is over the cut.

A group may hold a third of all rows, so no step gathers one: each step sums, per group and narrow class of distance,
counts, sums and products of the vectors (21 numbers), in each task before anything is dealt. The nearest half is then
whole classes, the last one in part. A group's at most CLASSES rows meet in one task and give its estimate, and the
estimates are joined back. Groups of fewer rows than LEAST take their language's estimate, and those of a small language
the estimate over all; these too come from the summed classes.

Defined results: null text has no words and fails the base rule (fewer than 10 words); texts of any length are counted
whole, one at a time; other columns are not looked at; null lang and source are groups
of their own; repeated rows weigh as rows; a covariance is kept off singular by a floor on each coordinate's variance, so
groups of equal rows don't reject what differs slightly; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_columns, table, words_of
from lodestone.session import ship, written

SYMBOLS = "#*$%&|<>"
#: Coordinates: mean word length, symbols a word, repeated lines a line, words in repeated windows a word.
DIMS = ("word_length", "symbols", "dup_lines", "repeats")
P = len(DIMS)
#: Words that a usual rate counts for, which a text's own rate is mixed with.
PRIOR = 50.0
#: Least standard deviation of each coordinate.
FLOOR = np.array([0.06, 0.03, 0.05, 0.06])
#: Share of the rows that the raw estimate rests on, concentration steps, distance classes to a doubling, rows of a group of its own.
HALF, STEPS, FINE, LEAST = 0.5, 4, 16, 60
CLASSES = 40 * FINE
#: Quantile of chi-square at which a distance rejects: far out, since clean texts aren't normal in their tails.
CUT_TAIL = 1e-12


def chi2_quantile(tail: float, p: int = P) -> float:
    """x with P(chi-square of p degrees > x) = tail, for even p, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))
        lo, hi = (x, hi) if above > tail else (lo, x)
    return lo


def base_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word, of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 5 - max(i, upto)
                    upto = i + 5
    return n, chars, symbols, dups, repeat, lines


def vectors(stats: list[tuple]) -> np.ndarray:
    """The transformed statistics of rows of base_stats()."""
    s = np.array(stats, float).reshape(-1, 6)
    n, chars, symbols, dups, repeat, lines = s.T
    k = PRIOR
    share = lambda c, m, p, k: np.arcsin(np.sqrt(np.clip((c + k * p) / (m + k), 0, 1)))
    return np.column_stack([np.log((chars + 6 * k) / (n + k)), np.log1p(20 * (symbols + 0.01 * k) / (n + k)), share(dups, lines, 0.01, 5), share(repeat, n, 0.01, k)])


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and the coordinates x0, x1, ..."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(c: dict) -> dict:
        got = [base_stats(t) for t in c["text"]]
        x = vectors(got)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {k: c[k] for k in ("doc_id", "lang", "source")} | {n: [g[i] for g in got] for i, n in enumerate(names)} | {f"x{i}": x[:, i] for i in range(P)}

    return map_columns(docs.select("doc_id", "lang", "source", "text"), run, f"doc_id {kind}, lang string, source string, {_STATS}, " + ", ".join(f"x{i} double" for i in range(P)))


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _coordinates() -> list:
    return [F.col(f"x{i}") for i in range(P)]


_GROUP = ("level", "g_lang", "g_source")
_ESTIMATE = "level int, g_lang string, g_source string, n long, mean array<double>, inverse array<double>"


def _levels(rows: DataFrame) -> DataFrame:
    """Each row summed up at three levels: its source in its language, its language, all."""
    a = F.array(*[F.struct(F.lit(i).alias("level"), (F.col("lang") if i < 2 else F.lit(None).cast("string")).alias("g_lang"), (F.col("source") if i < 1 else F.lit(None).cast("string")).alias("g_source")) for i in range(3)])
    return rows.withColumn("g", F.explode(a)).select("*", "g.*").drop("g")


def _sums(rows: DataFrame, distance) -> DataFrame:
    """Per group and class of squared distance: n, sums and products. A class is a sixteenth of a doubling wide."""
    cls = F.least(F.lit(CLASSES), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(distance, F.lit(1e-9))) * FINE) + 10 * FINE)).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_coordinates())], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]]
    return rows.groupBy(*_GROUP, cls.alias("class")).agg(*aggs)


def estimate(pdf: pd.DataFrame, half: float | None, limit: float) -> pd.DataFrame:
    """A group's mean and inverse covariance from its classes: the nearest share half of the rows, or those within limit."""
    pdf = pdf.sort_values("class")
    n = pdf["n"].to_numpy(float)
    if half is None:
        weight = (pdf["class"].to_numpy() <= math.floor(math.log2(limit) * FINE) + 10 * FINE).astype(float)
        if (weight * n).sum() < HALF * n.sum():
            half = HALF
    if half is not None:
        upto = np.cumsum(n)
        weight = np.clip((half * upto[-1] - (upto - n)) / n, 0, 1)
    w = (weight * n).sum()
    mean = np.array([(weight * pdf[f"s{i}"]).sum() for i in range(P)]) / w
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = (weight * pdf[f"p{i}{j}"]).sum() / w - mean[i] * mean[j]
    # consistency at the normal: the nearest share h has a covariance smaller by a known factor
    h = w / n.sum()
    if h < 0.999:
        q = chi2_quantile(1 - h)
        inside = 1 - math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(P // 2 + 1))
        cov *= h / max(inside, 1e-6)
    inverse = np.linalg.inv(cov + np.diag(FLOOR**2))
    g = pdf.iloc[0]
    return pd.DataFrame({"level": [g.level], "g_lang": [g.g_lang], "g_source": [g.g_source], "n": [int(n.sum())], "mean": [mean.tolist()], "inverse": [inverse.ravel().tolist()]})


def _estimator(half: float | None, limit: float):
    return lambda pdf: estimate(pdf, half, limit)


def _distance(mean, inverse):
    d = [x - mean[i] for i, x in enumerate(_coordinates())]
    return sum((d[i] * d[j] * inverse[i * P + j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _with_estimate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows of _levels() with their group's estimate; tables of estimates are small or skewed joins are split."""
    e = est.withColumnsRenamed({k: f"e_{k}" for k in _GROUP})
    return rows.join(e.drop("n"), (F.col("level") == F.col("e_level")) & F.col("g_lang").eqNullSafe(F.col("e_g_lang")) & F.col("g_source").eqNullSafe(F.col("e_g_source")))


def mcd(rows: DataFrame) -> DataFrame:
    """The reweighted estimates of all groups of three levels: level, g_lang, g_source, n, mean, inverse."""
    ship(rows.sparkSession)
    rows = _levels(rows.select("lang", "source", *[f"x{i}" for i in range(P)]))
    medians = rows.groupBy(*_GROUP).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(_coordinates())])
    start = medians.select(*_GROUP, F.lit(0).cast("long").alias("n"), F.array(*[F.col(f"m{i}") for i in range(P)]).alias("mean"), F.array(*[F.lit(float(i == j)) for i in range(P) for j in range(P)]).alias("inverse"))
    near = _with_estimate(rows, written(start, "mcd-start"))
    scale = near.groupBy(*_GROUP).agg(F.first("mean").alias("mean"), *[F.percentile_approx(F.abs(x - F.col("mean")[i]), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(_coordinates())])
    var = [F.pow(1.4826 * F.col(f"d{i}"), 2) + F.lit(float(FLOOR[i] ** 2)) for i in range(P)]
    est = written(scale.select(*_GROUP, F.lit(0).cast("long").alias("n"), "mean", F.array(*[(1 / var[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inverse")), "mcd-scale")
    for step in range(STEPS + 1):
        half = HALF if step < STEPS else None
        sums = _sums(_with_estimate(rows, est), _distance(F.col("mean"), F.col("inverse")))
        limit = chi2_quantile(0.025)
        est = written(sums.groupBy(*_GROUP).applyInPandas(_estimator(half, limit), _ESTIMATE), "mcd-step")
    return est


def robust_outliers(docs: DataFrame, tail: float = CUT_TAIL) -> DataFrame:
    """doc_id, the base statistics, distance (squared, from the group's robust centre) and outlier."""
    rows = written(text_vectors(docs), "outlier-vectors")
    est = mcd(rows)
    own = est.filter(f"level = 0 AND n >= {LEAST}").select(F.col("g_lang").alias("l0"), F.col("g_source").alias("s0"), F.struct("mean", "inverse").alias("e0"))
    lang = est.filter(f"level = 1 AND n >= {LEAST}").select(F.col("g_lang").alias("l1"), F.struct("mean", "inverse").alias("e1"))
    groups = est.filter("level = 0").select("g_lang", "g_source").join(own, F.col("g_lang").eqNullSafe(F.col("l0")) & F.col("g_source").eqNullSafe(F.col("s0")), "left").join(lang, F.col("g_lang").eqNullSafe(F.col("l1")), "left")
    whole = est.filter("level = 2").select(F.struct("mean", "inverse").alias("e2"))
    groups = written(groups.join(F.broadcast(whole)).select("g_lang", "g_source", F.coalesce("e0", "e1", "e2").alias("e")), "mcd-groups")
    got = rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    got = got.withColumn("distance", _distance(F.col("e.mean"), F.col("e.inverse")))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance", (F.col("distance") > chi2_quantile(tail)).alias("outlier"))


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of all documents."""
    got = robust_outliers(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("outlier")).alias("kept"), "distance")
