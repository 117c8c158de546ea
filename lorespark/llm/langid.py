"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (FTRL-Proximal, McMahan et al., 2013) with L1 and L2 penalties;
a temperature then calibrates the probabilities on learnable rows that training did not see.

Rows: a null text, or one without a letter, is `und` with score 0; a repeated document is predicted each
time; rows of a null lang teach nothing; a null doc_id counts as empty text for the fold; if no language can
be learned every row is `und`; an empty table gives no rows; columns of docs other than doc_id and text are
kept by identified() unless they are named lang_pred or score, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, id_fold, prepare

FOLDS, HELD_OUT = 5, 0
#: Hashed n-gram space.
BITS = 15
ORDERS = 3
#: Bound of the training sample: learnable rows with the smallest hashes of their ids. IDF counts all of them.
SAMPLE = 4_000
PASSES, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-3, 1e-3
UNDETERMINED = "und"


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids and counts of the 1- to 3-grams of a whole text, lower-cased, other characters than letters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(((codes >= 97) & (codes <= 122)) | (codes >= 170), codes, 32).astype(np.uint64)
    gap = codes == 32
    codes = codes[~(gap & np.concatenate([[True], gap[:-1]]))] if len(codes) else codes
    counts = np.zeros(1 << BITS, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for order in range(1, ORDERS + 1):
            if len(codes) < order:
                break
            h = (h[: len(codes) - order + 1] + codes[order - 1 :] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            ids = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)
            counts += np.bincount(ids, minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[ids]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        ids, counts = ngrams(text)
        p = _softmax((self.vector(ids, counts) @ self.weights[ids] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(languages: list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, str]]) -> LanguageModel:
    """rows: n-gram ids, their counts and the language, in training order; every fifth row calibrates only."""
    classes = {c: k for k, c in enumerate(languages)}
    shape = (1 << BITS, len(languages))
    z, n, b = np.zeros(shape), np.zeros(shape), np.zeros(len(languages))
    model = LanguageModel(languages, idf, np.zeros(shape), b, 1.0)
    data = [(ids, model.vector(ids, counts), classes[c]) for ids, counts, c in rows]
    held = data[::5] if len(data) >= 10 else data
    seen = [x for k, x in enumerate(data) if k % 5] if len(data) >= 10 else data

    def weights(ids: np.ndarray | slice) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    for step in range(PASSES):
        for ids, x, y in seen:
            w = weights(ids)
            g = _softmax(x @ w + b)
            g[y] -= 1
            b -= 0.05 / (1 + step) * g
            grad = x[:, None] * g
            n_new = n[ids] + grad * grad
            z[ids] += grad - (np.sqrt(n_new) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] = n_new
    w = weights(slice(None))
    logits = np.array([x @ w[ids] + b for ids, x, _ in held])
    truth = np.array([y for *_, y in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.02, 20, 121), key=loss) if len(held) else 1.0
    return LanguageModel(languages, idf, w.astype(np.float32), b, float(temperature))


def _frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, docs = np.zeros(1 << BITS, np.int64), 0
    for part in parts:
        for text in part["text"]:
            df[ngrams(text)[0]] += 1
            docs += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"id": np.append(at, -1), "n": np.append(df[at], docs)})


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        ids, counts = zip(*map(ngrams, part["text"]), strict=True) if len(part) else ((), ())
        yield pd.DataFrame({"h": part["h"], "lang": part["lang"], "ids": list(ids), "counts": list(counts)})


def learn(docs: DataFrame) -> LanguageModel:
    """Fit on rows of a non-null lang outside fold HELD_OUT: IDF over all of them, weights on at most SAMPLE."""
    prepare(docs.sparkSession)
    open_ = docs.select("doc_id", "text", "lang").filter((id_fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = open_.select("text").mapInPandas(_frequencies, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # 2**BITS + 1 rows at most
    count = {r.id: r.n for r in df}
    total, idf = count.pop(-1, 0), np.zeros(1 << BITS)
    for k, v in count.items():
        idf[k] = np.log((1 + total) / (1 + v)) + 1
    h = F.xxhash64("doc_id")
    picked = open_.select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id").distinct()
    rows = open_.withColumn("h", h).join(F.broadcast(picked), "doc_id").mapInPandas(_counted, "h long, lang string, ids array<int>, counts array<int>").toPandas()
    rows = rows.sort_values(["h", "lang"], kind="stable")
    data = [(np.asarray(i, np.int64), np.asarray(c, np.int64), y) for i, c, y in zip(rows["ids"], rows["counts"], rows["lang"], strict=True)]
    return fit(sorted(set(rows["lang"])), idf, data)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score."""
    prepare(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    pair = fresh(docs, "prediction")
    return docs.withColumn(pair, predict("text")).withColumns({"lang_pred": F.col(f"{pair}.lang_pred"), "score": F.col(f"{pair}.score")}).drop(pair)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (id_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
