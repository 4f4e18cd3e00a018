"""Toxicity by a classifier chain.

Categories are predicted one after the other; the linear model of each sees, besides the words
of the text, the probabilities of the categories before it. While training, those are out-of-fold:
each row's come from models that did not see it, so that later links learn to trust earlier
ones as far as they deserve on new texts. Scoring uses models fitted on all training rows.

Only training is on a sample: at most `max_rows` labelled rows, those with the smallest hashes of
their ids, so it is the same on every run. Everything else covers all rows. The model is a list
of words with weights, bounded by what the sample holds.

Features are words (runs of word characters in lower case) and the first characters of longer
words, each taken once a text. Null and empty texts have none. Repeated labels of a document count once, at their maximum; null labels count as 0.
Without labels, or with labels of one kind only, a category's probability is its share (0
without labels) for all. Null ids and repeated rows are scored like others. An empty table gives an
empty result; other columns stay, unless they bear the name of a probability, which they yield to.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, table, whole

WORD = re.compile(r"\w+")
FOLDS = 3
MAX_ROWS = 8_000
#: A word enters a model if it is in so many training texts and its chi-squared value is so large.
LEAST_TEXTS, LEAST_CHI2 = 3, 15.0
RIDGE = 0.3
#: Lengths of the word beginnings that count as features too.
STEMS = (4, 5)
REJECT = 0.5


def features(text: str) -> set[str]:
    """Distinct words and word beginnings."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in STEMS))


class Rows:
    """Training texts as feature numbers, row by row."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        cols, sizes = array("i"), []
        for t in texts:
            own = features(t)
            cols.extend([index.setdefault(w, len(index)) for w in own])
            sizes.append(len(own))
        col = np.frombuffer(cols, np.int32) if len(cols) else np.zeros(0, np.int32)
        # features of fewer texts than a model may use go at once; most are of one text
        common = np.bincount(col, minlength=len(index)) >= LEAST_TEXTS
        place = (np.cumsum(common) - 1).astype(np.int32)
        keep = common[col]
        self.words = [w for w, c in zip(index, common.tolist(), strict=True) if c]
        self.col = place[col[keep]]
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
        self.n = len(texts)


def _chosen(x: Rows, use: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that tell the classes apart among the rows in use."""
    on = use[x.row]
    with_word = np.bincount(x.col[on], minlength=len(x.words)).astype(float)
    both = np.bincount(x.col[on], y[x.row[on]], minlength=len(x.words))
    n, p = use.sum(), y[use].sum()
    a, b = both, with_word - both
    c, d = p - a, n - p - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    return np.flatnonzero((with_word >= LEAST_TEXTS) & (np.nan_to_num(chi2) >= LEAST_CHI2))


def _fit(x: Rows, use: np.ndarray, y: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen words, and weights of them, of the extra columns and of the constant: ridge logistic regression by Newton steps with conjugate gradients."""
    k = extra.shape[1]
    share = y[use].mean() if use.any() else 0.0
    if not 0 < share < 1:
        bias = -20.0 if share == 0 else 20.0
        return np.zeros(0, np.int64), np.array([*np.zeros(k), bias])
    words = _chosen(x, use, y)
    place = np.full(len(x.words), -1)
    place[words] = np.arange(len(words))
    on = (place[x.col] >= 0) & use[x.row]
    row, col = x.row[on], place[x.col[on]]
    dense = np.column_stack([extra, np.ones(x.n)]) * use[:, None]
    f = len(words)
    ridge = np.concatenate([np.full(f + k, RIDGE), [1e-6]])
    forward = lambda w: np.bincount(row, w[col], minlength=x.n) + dense @ w[f:]
    back = lambda r: np.concatenate([np.bincount(col, r[row], minlength=f), dense.T @ r])
    w = np.zeros(f + k + 1)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        slope = back((p - y) * use) + ridge * w
        if np.abs(slope).max() < 1e-4 * use.sum() ** 0.5:
            break
        h = np.maximum(p * (1 - p), 1e-5) * use
        step, r = np.zeros_like(w), -slope
        d, rr = r.copy(), r @ r
        for _ in range(25):
            hd = back(h * forward(d)) + ridge * d
            a = rr / (d @ hd)
            step += a * d
            r -= a * hd
            new = r @ r
            if new < 1e-6 * rr or new < 1e-12:
                break
            d, rr = r + new / rr * d, new
        w += step
    return words, w


def _odds(x: Rows, words: np.ndarray, w: np.ndarray, extra: np.ndarray) -> np.ndarray:
    weight = np.zeros(len(x.words))
    weight[words] = w[: len(words)]
    return np.clip(np.bincount(x.row, weight[x.col], minlength=x.n) + extra @ w[len(words) : -1] + w[-1], -20, 20)


def _probability(odds):
    return 1 / (1 + np.exp(-odds))


def train(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> dict:
    """The chain's model. labels: a row for each text, a column of 0 and 1 for each category, in the chain's order."""
    x = Rows(texts)
    fold = np.arange(x.n) % folds
    before = np.zeros((x.n, 0))
    links = []
    for y in labels.T.astype(float):
        held = np.zeros(x.n)
        for k in range(folds):
            use = fold != k
            held[~use] = _probability(_odds(x, *_fit(x, use, y, before), before))[~use]
        words, w = _fit(x, np.ones(x.n, bool), y, before)
        links.append({"words": {x.words[i]: float(v) for i, v in zip(words, w, strict=False)}, "before": w[len(words) : -1].tolist(), "bias": float(w[-1])})
        before = np.column_stack([before, held])
    return {"links": links}


class Chain:
    def __init__(self, model: dict):
        self.links = model["links"]
        none = (0.0,) * len(self.links)
        weights: dict[str, tuple] = {}
        for k, link in enumerate(self.links):
            for w, v in link["words"].items():
                weights[w] = (*weights.get(w, none)[:k], v, *none[k + 1 :])
        self.weights = weights

    def __call__(self, text: str) -> list[float]:
        """Probability of each category."""
        get = self.weights.get
        found = [v for w in features(text) if (v := get(w))]
        out: list[float] = []
        for k, link in enumerate(self.links):
            odds = sum(v[k] for v in found) + sum(a * b for a, b in zip(link["before"], out, strict=True)) + link["bias"]
            out.append(float(_probability(max(-20.0, min(20.0, odds)))))
        return out


def _trained(names: list[str], folds: int):
    def run(batches):
        texts, rows = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            rows += zip(*(b.column(f"_y{k}").to_pylist() for k in range(len(names))), strict=True)
        if texts:
            yield pa.RecordBatch.from_pydict({"model": [json.dumps(train(texts, np.array(rows, np.int64), folds))]})

    return run


def fit_chain(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS, folds: int = FOLDS) -> dict:
    """Fit on at most max_rows labelled documents. categories: the label of each as a condition on `labels`, in the chain's order."""
    bounded_batches(spark)
    names = list(categories)
    ys = [F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(f"_y{k}") for k, c in enumerate(categories.values())]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*ys)
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # the bound of what is broadcast below
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "text").limit(max_rows)
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "text").select("text", *(f"_y{k}" for k in range(len(names)))).mapInArrow(lean(_trained(names, folds)), "model string").collect()
    model = json.loads(found[0]["model"]) if found else {"links": [{"words": {}, "before": [0.0] * k, "bias": -20.0} for k in range(len(names))]}
    return model | {"names": names}


def score(spark: SparkSession, docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with a column p_<category> for each category of the model."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    names = [f"p_{n}" for n in model["names"]]
    from pyspark.sql import types as T

    base = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]

    def run(batches):
        chain = Chain(sent.value)
        for b in batches:
            p = [chain(t or "") for t in b.column(text).to_pylist()]
            keep = [b.column(f.name) for f in base]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array([x[k] for x in p], pa.float64()) for k in range(len(names)))], names=[*(f.name for f in base), *names])

    return docs.mapInArrow(lean(run), T.StructType([*base, *(T.StructField(n, T.DoubleType()) for n in names)]))


def categories() -> dict[str, Column]:
    """Of the labels table: low quality informs the verdict on toxicity."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_chain(spark, docs, table(spark, sf_dir, "labels"), categories())
    return score(spark, docs, model).select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= REJECT).alias("rejected"))
