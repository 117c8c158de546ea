"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk with an estimated prior.

Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017. Trusted positives are
labelled rows of quality 1, at most POSITIVES of them; the unlabelled side is every learnable document, whatever
its label; labels of quality 0 are never read. Inputs are statistics of the whole text only.

The risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss, its maximum smoothed
over SMOOTH. Newton's iterations minimise it on sums over all unlabelled documents (loss, gradient and Hessian, one
pass over their stored features each). Feature means and scales and the class prior come from all of them, too.

Rows: a null text is an empty text, and an empty text is scored like any other; a repeated document is scored
each time; a null doc_id counts as empty text for the fold; a document labelled more than once is a positive
if any of its labels is 1; null labels are no labels; without any positive there is nothing to learn and every
score is 0.5; an empty table gives no rows; columns other than doc_id and text are kept by scored() unless
they are named score or predicted, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, freed, id_fold, materialize, prepare

FOLDS, HELD_OUT = 4, 2
#: Bound of the trusted positives: labelled rows with the smallest hashes of their ids.
POSITIVES = 20_000
#: Passes of Newton's iterations at most, the share of the risk that a step must gain, the ridge, and the smoothing.
STEPS, LEAST_GAIN, RIDGE, SMOOTH = 14, 1e-3, 1e-3, 0.02
#: A document is kept from this score on.
THRESHOLD = 0.7
#: Bytes that have a share of their own among the features; others are grouped.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\\n\t "


def features(texts: list[bytes]) -> np.ndarray:
    """Statistics of whole UTF-8 texts, a row each."""
    out = np.zeros((len(texts), len(MARKS) + 16), np.float32)
    marks = np.frombuffer(MARKS, np.uint8)
    for row, text in zip(out, texts, strict=True):
        n = len(text)
        count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        row[: len(marks)] = count[marks] / max(1, n)
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        w, k = max(1, len(words)), len(MARKS)
        vocabulary = set(words)
        row[k : k + 5] = count[97:123].sum() / max(1, n), count[65:91].sum() / max(1, n), count[48:58].sum() / max(1, n), count[128:].sum() / max(1, n), count[:32].sum() / max(1, n)
        row[k + 5 : k + 9] = np.log1p(n), np.log1p(len(words)), n / w, len(vocabulary) / w
        row[k + 9] = len(set(zip(words, words[1:], strict=False))) / w
        row[k + 10] = sum(map(bytes.isupper, words)) / w
        row[k + 11] = sum(map(bytes.isalpha, words)) / w
        row[k + 12] = len(set(lines)) / max(1, len(lines))
        row[k + 13] = np.log1p(n / max(1, len(lines)))
        row[k + 14] = sum(map(bytes.__eq__, words, words[1:])) / w
        row[k + 15] = len(vocabulary) / np.sqrt(w)
    return out


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z / 6, np.ones((len(z), 1), np.float32)]).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Sums:
    """Of unlabelled rows under some weights: how many, and the sums of log(1 + e^g), of its gradient and Hessian."""

    n: float
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray

    @staticmethod
    def of(x: np.ndarray, w: np.ndarray) -> Sums:
        u = _sigmoid(x @ w)
        return Sums(len(x), float(np.logaddexp(0, x @ w).sum()), x.T @ u, (x * (u * (1 - u))[:, None]).T @ x)

    def packed(self) -> list[float]:
        return [self.n, self.loss, *self.gradient, *self.hessian[np.triu_indices(len(self.gradient))]]

    @staticmethod
    def unpacked(values: np.ndarray) -> Sums:
        d = int((np.sqrt(9 + 8 * (len(values) - 2)) - 3) / 2)
        hessian = np.zeros((d, d))
        hessian[np.triu_indices(d)] = values[2 + d :]
        return Sums(values[0], values[1], values[2 : 2 + d], hessian + np.triu(hessian, 1).T)


def fit(positive: np.ndarray, sums: Callable[[np.ndarray], Sums], prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of least non-negative risk; sums gives the unlabelled side for given weights."""
    d = positive.shape[1]

    def risk(w: np.ndarray, u: Sums) -> tuple[float, float]:
        """The risk, and how much of the negatives' part of it counts: 1 where that is positive, 0 below the floor."""
        own = positive @ w
        negative = u.loss / u.n - prior * np.logaddexp(0, own).mean()
        return prior * np.logaddexp(0, -own).mean() + SMOOTH * np.logaddexp(0, negative / SMOOTH) + RIDGE / 2 * w @ w, float(_sigmoid(np.array(negative / SMOOTH)))

    w = np.zeros(d)
    now, passes = sums(w), 1
    least, counts = risk(w, now)
    while passes < steps:
        p = _sigmoid(positive @ w)
        of_negatives = now.gradient / now.n - prior * (positive.T @ p) / len(p)
        grad = prior * (positive.T @ (p - 1)) / len(p) + counts * of_negatives + RIDGE * w
        hessian = prior * (1 - counts) * (positive * (p * (1 - p))[:, None]).T @ positive / len(p) + counts * now.hessian / now.n
        hessian += counts * (1 - counts) / SMOOTH * np.outer(of_negatives, of_negatives) + RIDGE * np.eye(d)
        step, scale = np.linalg.solve(hessian, grad), 1.0
        while passes < steps:
            there = sums(w - scale * step)
            passes += 1
            value, share = risk(w - scale * step, there)
            if value < least - 1e-3 * scale * (grad @ step):
                break
            scale /= 4
        else:
            break
        gain = least - value
        w, now, least, counts = w - scale * step, there, value, share
        if gain < LEAST_GAIN * least:
            break
    return w


def prior_from_ranks(positive: np.ndarray, above: np.ndarray, n: float) -> float:
    """Share of positives among n unlabelled rows, of which `above` exceed each cut of cuts_of(positive).

    Below any cut the unlabelled hold at least the positives' share, so prior <= U(s > t) / P(s > t) for each t; the
    least of these bounds, each with half its standard error, is the estimate (Blanchard et al., 2010).
    """
    cuts = cuts_of(positive)
    half_error = lambda t, n: 0.5 * np.sqrt(t * (1 - t) / n)
    tp, tu = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive), above / n
    return float(np.clip(np.min((tu + half_error(tu, n)) / np.maximum(tp - half_error(tp, len(positive)), 0.05)), 0.05, 0.98))


def cuts_of(scores: np.ndarray) -> np.ndarray:
    return np.quantile(scores, np.linspace(0, 0.8, 81))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: weights fitted on one half of both rank the other half."""
    p1, p2, u1, u2 = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if min(map(len, (p1, p2, u1, u2))) < 5:
        return 0.5
    w = fit(p1, lambda w: Sums.of(u1, w), 0.5)
    return prior_from_ranks(p2 @ w, (u2 @ w >= cuts_of(p2 @ w)[:, None]).sum(1), len(u2))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        return _sigmoid(_expand(features(texts), self.mean, self.scale) @ self.weights)


def _featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame({"h": part["h"], "positive": part["positive"], "x": list(features([t or b"" for t in part["text"]]))})


class Unlabelled:
    """Sums over all rows of a stored table of features (h, x), a row for each partition on the way to the driver."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.select("h", "x")
        self.mean, self.scale = np.zeros(1), np.ones(1)

    def _summed(self, rows: DataFrame, size: int, of: Callable[[np.ndarray], list[float]]) -> np.ndarray:
        """Sums over the rows' features of a list of so many numbers."""
        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for part in parts:
                if len(part):
                    total += of(np.stack(part["x"].to_numpy()).astype(np.float64))
            yield pd.DataFrame({"at": np.arange(size), "value": total})

        got = rows.mapInPandas(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(size)
        for r in got:
            out[r["at"]] = r["value"]
        return out

    def measure(self, d: int) -> float:
        """Number of rows; sets mean and scale of each feature."""
        got = self._summed(self.rows, 1 + 2 * d, lambda x: [len(x), *x.sum(0), *(x * x).sum(0)])
        n = max(1.0, got[0])
        self.mean = got[1 : 1 + d] / n
        self.scale = np.sqrt(np.maximum(got[1 + d :] / n - self.mean**2, 0)) + 1e-3
        return got[0]

    def half(self, first: bool) -> Unlabelled:
        out = Unlabelled(self.rows.filter(F.pmod("h", F.lit(2)) == (0 if first else 1)))
        out.mean, out.scale = self.mean, self.scale
        return out

    def sums(self, w: np.ndarray) -> Sums:
        d, mean, scale = len(w), self.mean, self.scale
        return Sums.unpacked(self._summed(self.rows, 2 + d + d * (d + 1) // 2, lambda x: Sums.of(_expand(x, mean, scale), w).packed()))

    def above(self, w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, float]:
        """How many rows score at least each cut, and the number of rows."""
        mean, scale = self.mean, self.scale
        got = self._summed(self.rows, len(cuts) + 1, lambda x: [*(_expand(x, mean, scale) @ w >= cuts[:, None]).sum(1), len(x)])
        return got[:-1], got[-1]


def learn(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on learnable rows only (fold HELD_OUT is left out): at most POSITIVES positives, all unlabelled rows."""
    prepare(docs.sparkSession)
    open_ = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter(id_fold("doc_id", FOLDS) != HELD_OUT).withColumn("h", F.xxhash64("doc_id"))
    trusted = labels.filter((F.col("quality") == 1) & (id_fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id").distinct()
    picked = open_.select("doc_id", "h").join(trusted, "doc_id", "left_semi").orderBy("h", "doc_id").limit(POSITIVES).select("doc_id").distinct()
    marked = open_.join(F.broadcast(picked.withColumn("positive", F.lit(True))), "doc_id", "left")  # POSITIVES ids at most
    table = materialize(marked.select("h", F.coalesce("positive", F.lit(False)).alias("positive"), "text").mapInPandas(lambda parts: freed(_featured(parts)), "h long, positive boolean, x array<float>"), "features")
    rows = table.filter("positive").toPandas().sort_values("h", kind="stable")
    p = np.array(rows["x"].tolist(), np.float32)
    unlabelled = Unlabelled(table)
    if not len(p) or not unlabelled.measure(p.shape[1]):
        return QualityModel(np.zeros(1), np.ones(1), None, 0.5)
    p = _expand(p, unlabelled.mean, unlabelled.scale)
    one, other = unlabelled.half(True), unlabelled.half(False)
    first = rows["h"].to_numpy() % 2 == 0
    prior = 0.5
    if min(first.sum(), (~first).sum()) >= 5:
        w = fit(p[first], one.sums, 0.5)
        above, n = other.above(w, cuts_of(p[~first] @ w))
        prior = prior_from_ranks(p[~first] @ w, above, n) if n >= 5 else 0.5
    weights = fit(p, unlabelled.sums, prior)
    drop(table)
    return QualityModel(unlabelled.mean.astype(np.float32), unlabelled.scale.astype(np.float32), weights, prior)


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with score and predicted (0 or 1)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.score([t or b"" for t in part]), dtype=float)

    docs = docs.drop("score", "predicted").withColumn("score", score(F.col("text").cast("binary")))
    return docs.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (id_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
