"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model's features are those of the text and the probabilities of
the categories before it.  While training, these probabilities come from models that have not seen the text
(out-of-fold over `folds` folds by a hash of the id), so a model learns from inputs like those it meets later; for
prediction each category has one model trained on the whole sample.

A text's features are its distinct words, lower-cased (A-Z only), and the first 5 and 6 bytes of longer words, as
64-bit hashes; a feature enters with its log-odds in the training sample (a naive Bayes scale), and logistic
regression with an L2 penalty weighs them.  Models are fitted on the driver on at most `sample` labelled texts of
`sample_bytes` bytes in all, taken by the hash of their id, so that the driver's memory is bounded whatever the texts;
of rows that share an id the first text by order trains.  Features in fewer than `least` of them are left out.  Scoring covers every
row and whole text.

Null and empty texts have no features and get the models' constant, but are never rejected.  Rows with a null
id are scored; they don't train.  Labels without a text and null labels don't train; of repeated labels the largest
holds.  Without labels of both kinds a category gets the share of positives as probability (0 without labels).
Repeated rows are scored each; what is removed is told by its text, not its id.  Empty tables give empty results.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as K
from .scratch import Scratch

PREFIXES = (5, 6)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, sorted, and n+1 offsets."""
    raw, at = K.buffers(column)
    raw = K._LOWER[raw]
    start, end, first = K.word_spans(raw, at)
    # punctuation at either end isn't part of a word here
    plain = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    total = np.concatenate(([0], np.cumsum(plain)))
    some = total[end] > total[start]
    owner = K.text_index(first)[some]
    places = np.flatnonzero(plain)
    lo = places[total[start[some]]]
    hi = places[total[end[some]] - 1] + 1
    found, whose = [K.span_hashes(raw, lo, hi)], [owner]
    for n in PREFIXES:
        long_ = hi - lo > n
        found.append(K.mix(K.span_hashes(raw, lo[long_], lo[long_] + n) ^ np.uint64(n)))
        whose.append(owner[long_])
    value, owner = np.concatenate(found), np.concatenate(whose)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(column)))))


class LinearModel:
    """Logistic regression over binary features and a few dense ones."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def probability(self, row: np.ndarray, col: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weights[col], minlength=n) + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, row: np.ndarray, col: np.ndarray, n: int, size: int, dense: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.05, penalty: float = 3e-4) -> LinearModel:
        share = y.mean() if n else 0.0
        zero = cls(np.zeros(size), np.zeros(dense.shape[1]), float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5))) if n else -40.0)
        if not 0 < share < 1:
            zero.bias = 40.0 if share == 1 else -40.0
            return zero
        with_y = np.bincount(col, y[row], minlength=size)
        without = np.bincount(col, minlength=size) - with_y
        scale = np.log((with_y + 0.5) / (y.sum() + 1)) - np.log((without + 0.5) / (n - y.sum() + 1))
        w = np.concatenate((np.zeros(size + dense.shape[1]), [zero.bias]))
        balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        mean, var = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):  # Adam on the whole sample
            z = w[-1] + np.bincount(row, (w[:size] * scale)[col], minlength=n) + dense @ w[size:-1]
            g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            grad = np.concatenate((np.bincount(col, g[row], minlength=size) * scale, dense.T @ g, [g.sum()]))
            grad[:-1] += penalty * w[:-1]
            mean = 0.9 * mean + 0.1 * grad
            var = 0.99 * var + 0.01 * grad**2
            w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
        return cls(w[:size] * scale, w[size:-1], float(w[-1]))


class ClassifierChain:
    """One linear model a category, in order."""

    def __init__(self, names: list[str], vocabulary: np.ndarray, models: list[LinearModel], threshold: float):
        self.names, self.vocabulary, self.models, self.threshold = names, vocabulary, models, threshold

    @classmethod
    def fit(cls, names: list[str], value: np.ndarray, at: np.ndarray, labels: np.ndarray, fold: np.ndarray, least: int = 4) -> ClassifierChain:
        """`labels` has a column a category, NaN where unknown; `fold` numbers the folds from 0."""
        known, count = np.unique(value, return_counts=True)
        vocabulary = known[count >= least]
        row, col = cls._lookup(vocabulary, value, at)
        del value, known, count
        n = len(at) - 1
        dense = np.zeros((n, 0))
        models = []
        out = np.zeros(n)
        for k in range(len(names)):
            y = labels[:, k]
            seen = ~np.isnan(y)
            out = np.zeros(n)
            for f in range(int(fold.max(initial=0)) + 1):
                use, away = seen & (fold != f), fold == f
                model = cls._fit_rows(row, col, use, len(vocabulary), dense, y)
                inside = away[row]
                number = (np.cumsum(away) - 1).astype(np.int32)
                out[away] = model.probability(number[row[inside]], col[inside], int(away.sum()), dense[away])
            models.append(cls._fit_rows(row, col, seen, len(vocabulary), dense, y))
            dense = np.concatenate((dense, out[:, None]), 1)
        seen = ~np.isnan(labels[:, -1]) if len(names) else np.zeros(0, bool)
        return cls(names, vocabulary, models, cls._best_threshold(out[seen], labels[seen, -1]))

    @staticmethod
    def _lookup(vocabulary: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        if not len(vocabulary):
            return row[:0], row[:0]
        where = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
        hit = vocabulary[where] == value
        return row[hit].astype(np.int32), where[hit].astype(np.int32)

    @staticmethod
    def _fit_rows(row, col, use, size, dense, y) -> LinearModel:
        inside = use[row]
        number = (np.cumsum(use) - 1).astype(np.int32)
        return LinearModel.fit(number[row[inside]], col[inside], int(use.sum()), size, dense[use], y[use])

    @staticmethod
    def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The threshold with the best out-of-fold F1, kept between 0.3 and 0.7 as few labels place it badly."""
        if not len(p) or not 0 < y.mean() < 1:
            return 0.5
        order = np.argsort(-p, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
        i = int(f1.argmax())
        below = p[order[i + 1]] if i + 1 < len(p) else 0.0
        return float(np.clip((p[order[i]] + below) / 2, 0.3, 0.7))

    def predict(self, column: pa.Array) -> np.ndarray:
        """Probabilities: a row per text and a column per category."""
        value, at = features(column)
        row, col = self._lookup(self.vocabulary, value, at)
        dense = np.zeros((len(column), 0))
        for model in self.models:
            dense = np.concatenate((dense, model.probability(row, col, len(column), dense)[:, None]), 1)
        return dense


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.chunks(batches, "text"):
        value, at = features(batch.column(batch.schema.get_field_index("text")))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
        keep = [i for i, x in enumerate(batch.schema.names) if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), lists], names=[*(batch.schema.names[i] for i in keep), "features"])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]], sample: int = 7000, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = 32 << 20) -> ClassifierChain:
    """Fit on at most `sample` labelled texts of `sample_bytes` in all.  `categories` names, in chain order, a label column and the value
    that is positive."""
    names = list(categories)
    wanted = [F.max((F.col(f"`{c}`") == v).cast("double")).alias(f"y{k}") for k, (c, v) in enumerate(categories.values())]
    chosen = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(*wanted)
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("fold", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)).cast("int"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = "".join(f", y{k} double" for k in range(len(names)))
    labelled = text.join(chosen, "id").groupBy("id", "fold", *[f"y{k}" for k in range(len(names))]).agg(F.min("text").alias("text"))
    labelled = scratch.save(labelled.withColumn("h", F.xxhash64("id")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "labelled")
    running = F.sum("size").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))  # over `sample` rows without their texts
    within = labelled.filter(F.col("size") <= sample_bytes).select("h", "id", "size").withColumn("running", running).filter(F.col("running") <= sample_bytes).select("id")
    rows = labelled.join(within, "id", "left_semi").select("id", "fold", *[f"y{k}" for k in range(len(names))], "text").mapInArrow(_features_of, f"id long, fold int{kinds}, features array<long>").toArrow()
    rows = rows.sort_by("id").combine_chunks()
    if not rows.num_rows:
        return ClassifierChain(names, np.zeros(0, np.uint64), [LinearModel(np.zeros(0), np.zeros(k), -40.0) for k in range(len(names))], 0.5)
    lists = rows.column("features").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    y = np.stack([rows.column(f"y{k}").to_numpy().astype(float) for k in range(len(names))], 1)
    fold = rows.column("fold").to_numpy()
    value = lists.values.to_numpy().view(np.uint64)[at[0] : at[-1]]
    return ClassifierChain.fit(names, value, at - at[0], y, fold)


def _predict(chain: ClassifierChain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            text = batch.column(1)
            p = chain.predict(text)
            there = np.diff(K.buffers(text)[1]) > 0
            bad = (p[:, -1] >= chain.threshold) & there
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(bad)], names=["id", *(f"p{k}" for k in range(p.shape[1])), "rejected"])

    return run


#: The driver's labels: texts of low quality, then toxic ones.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: id, p_<category> for each category, rejected (by the last category)."""
    chain = fit_chain(docs, labels, categories, id_col=id_col, text_col=text_col, **options)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = "".join(f", p{k} double" for k in range(len(categories)))
    out = text.mapInArrow(_predict(chain), f"id {text.schema['id'].dataType.simpleString()}{kinds}, rejected boolean")
    return out.toDF(id_col, *[f"p_{c}" for c in categories], "rejected")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text is not rejected, as they are: each is predicted and kept or not where it is read,
    so nothing is shuffled and rows that share an id are told apart."""
    chain = fit_chain(docs, labels, CATEGORIES, id_col=id_col, text_col=text_col, **options)
    rows, text = docs, text_col
    if docs.schema[text_col].dataType.simpleString() != "string":
        text = "_text" + "_" * max(map(len, docs.columns))  # no column's name
        rows = docs.withColumn(text, F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            there = np.diff(K.buffers(column)[1]) > 0
            yield batch.filter(pa.array(~(there & (chain.predict(column)[:, -1] >= chain.threshold))))

    kept = rows.mapInArrow(run, rows.schema)
    return kept if text == text_col else kept.drop(text)
