"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features gives a score; ordered thresholds cut it into grades, so that
P(grade <= j) = sigmoid(threshold_j - score). The expected grade ranks documents, the tail probability selects them.
The model is fitted on a bounded sample of the rated documents, and its size is fixed, so it goes along with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import packed

#: Grades; hashed features; rated rows that a fit takes at most; rows that must show a feature; least
#: deviation, in standard errors, of the mean grade of these rows; ridge; steps.
GRADES, FEATURES, SAMPLE, LEAST_ROWS, LEAST_Z, RIDGE, STEPS = 3, 1 << 18, 6000, 4, 3.5, 1e-4, 150
#: A document is kept if the probability of the highest grade is at least this.
TAIL = 0.75
#: Letters of a word's stem; value of a word or stem that occurs, however long the text.
STEM, OCCURS = 5, 0.3
_CACHED = 1 << 16


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: low quality; 1: good but toxic; 2: good. Null if there is no rating of the quality."""
    return F.when(quality.isNull(), None).when(quality <= 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2)


class Features:
    """Sparse features of a text: words and stems that occur, shares of word shapes, repetition, length."""

    def __init__(self):
        self.codes = _Codes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.array([_cell("empty")]), np.ones(1)
        codes = self.codes.of(words)
        whole, stem, shape = codes
        seen = np.unique(codes[:2])
        shape, n = np.unique(shape, return_counts=True)
        repeated = float(np.mean(whole[1:] == whole[:-1])) if len(whole) > 1 else 0.0
        different = len(np.unique(whole)) / len(whole)
        extra = [_cell(f"r:{min(9, int(repeated * 20))}"), _cell(f"d:{int(10 * different)}"), _cell(f"l:{len(words).bit_length()}")]
        return np.concatenate([seen, shape, extra]), np.concatenate([np.full(len(seen), OCCURS), 3 * (n / len(words)) ** 0.5, np.ones(3)])


def _cell(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % FEATURES


_LETTERS, _DIGITS, _AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape_of(word: str) -> str:
    """Runs of letters as A or a, of digits as 9, two of any repeated character; words of letters and one mark need no patterns."""
    if word.isalpha():
        return "A" if len(word) > 1 and word.isupper() else "a"
    head = word[:-1]
    if word[-1] in ".,;:!?" and head.isalpha():
        return ("A" if len(head) > 1 and head.isupper() else "a") + word[-1]
    shape = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return _AGAIN.sub(r"\1\1", _DIGITS.sub("9", shape))[:12]


class _Codes(dict):
    """Places of words in a table of their cells: of the letters, the stem and the shape; forgets all when full, between texts."""

    def __init__(self):
        super().__init__()
        self.cells: list[tuple[int, int, int]] = []
        self.table = np.empty((3, 1 << 10), np.int64)
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        shape = shape_of(word)
        by_shape = self.shapes.get(shape)
        if by_shape is None:
            if len(self.shapes) >= _CACHED:
                self.shapes.clear()
            by_shape = self.shapes[shape] = _cell("s:" + shape)
        letters = word.lower()
        if not letters.isalnum():
            letters = "".join(filter(str.isalnum, letters))
        self[word] = at = len(self)
        self.cells.append((_cell("w:" + letters), _cell("p:" + letters[:STEM]), by_shape))
        return at

    def of(self, words: list[str]) -> np.ndarray:
        """(3, number of words)."""
        if len(self) >= _CACHED:
            self.clear()
        before = len(self)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.cells:
            if len(self) > self.table.shape[1]:
                more = np.empty((3, max(len(self), 2 * self.table.shape[1])), np.int64)
                more[:, :before] = self.table[:, :before]
                self.table = more
            self.table[:, before : len(self)] = np.array(self.cells, np.int64).T
            self.cells = []
        return self.table[:, at]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None, features: Features) -> np.ndarray:
        """P(grade > j) for each j but the last grade."""
        cells, values = features.of(text)
        return 1 / (1 + np.exp(np.clip(self.thresholds - float(self.weights[cells] @ values), -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, classes: int = GRADES) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows. Without rows, the model that keeps everything."""
    if not len(grades):
        return _keeps_all(classes)
    return _fit(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([len(r[0]) for r in rows]), grades, classes)


def _keeps_all(classes: int = GRADES) -> Model:
    return Model(np.zeros(FEATURES, np.float32), np.full(classes - 1, -20.0))


#: Cells that are counted or filtered at once, so a fit holds little besides them.
_AT_ONCE = 1 << 17


def _fit(cells: np.ndarray, values: np.ndarray, sizes: np.ndarray, grades: np.ndarray, classes: int = GRADES) -> Model:
    """fit() of rows that lie one after the other in cells and values; sizes are their lengths."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    parts = [slice(at, at + _AT_ONCE) for at in range(0, max(1, len(cells)), _AT_ONCE)]
    # only features whose rows have a mean grade that chance hardly gives them
    n, total = np.zeros(FEATURES, np.int64), np.zeros(FEATURES)
    for part in parts:
        n += np.bincount(cells[part], minlength=FEATURES)
        total += np.bincount(cells[part], weights=grades[owner[part]], minlength=FEATURES)
    mean, spread = grades.mean(), grades.std() + 1e-9
    z = (total - n * mean) / (spread * np.sqrt(np.maximum(n, 1)))
    telling = (n >= min(LEAST_ROWS, max(1, len(sizes) // 50))) & (np.abs(z) >= LEAST_Z)
    cells, values, owner = (np.concatenate([x[part][telling[cells[part]]] for part in parts]) for x in (cells, values, owner))
    values = values.astype(float)
    used, cells = np.unique(cells, return_inverse=True)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=classes))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # thresholds are a first one and gaps whose logarithm is fitted, so they stay ordered
    x = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v, k = np.zeros_like(x), np.zeros_like(x), len(used)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, STEPS + 1):
        gaps = np.exp(x[k + 1 :])
        cuts = x[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, weights=x[cells] * values, minlength=len(sizes))
        upper, lower = np.r_[cuts, np.inf][grades] - score, np.r_[-np.inf, cuts][grades] - score
        up, low = np.where(np.isinf(upper), 1.0, sig(upper)), np.where(np.isinf(lower), 0.0, sig(lower))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p  # of log p by the cut above and below
        by_score = (du - dl) / len(sizes)
        g = np.empty_like(x)
        g[:k] = np.bincount(cells, weights=by_score[owner] * values, minlength=k) + RIDGE * x[:k]
        by_cut = -np.array([du[grades == j].sum() - dl[grades == j + 1].sum() for j in range(classes - 1)]) / len(sizes)
        g[k] = by_cut.sum()
        g[k + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = x[:k]
    return Model(weights, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))]))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `sample` rated documents, those of least id hash; `ratings` has the id and `grade` (null: unrated).

    Ids are integers. An id that is repeated counts once, with its least text and grade, so the fit has no more than `sample`
    rows and reruns agree. It runs in a task; the driver holds no row of it.
    """
    order = F.md5(F.col("_id").cast("string"))
    rated = ratings.select(F.col(id_col).alias("_id"), "grade").filter("_id IS NOT NULL AND grade IS NOT NULL").groupBy("_id").agg(F.min("grade").alias("grade"))
    # ids that are rated but have no document count towards the bound
    chosen = rated.orderBy(order, "_id").limit(sample)
    picked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            got = [features.of(t) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "grade": pdf["grade"], "cells": pd.Series([c.astype("<i4").tobytes() for c, _ in got], dtype=object), "values": pd.Series([x.astype("<f4").tobytes() for _, x in got], dtype=object)})

    picked = picked.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("grade").alias("grade"))
    rows = picked.select("_id", "grade", "_text").mapInPandas(run, "_id long, grade int, cells binary, values binary")
    # the sample is bounded, so one task fits it; the driver gets the weights that are not zero
    found = rows.repartition(1).sortWithinPartitions("_id").mapInPandas(_fit_task, "cells binary, weights binary, thresholds binary").first()
    if found is None:
        return _keeps_all()
    model = Model(np.zeros(FEATURES, np.float32), np.frombuffer(found["thresholds"], "<f8"))
    model.weights[np.frombuffer(found["cells"], "<i4")] = np.frombuffer(found["weights"], "<f4")
    return model


def _fit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows, in their order, as one row: cells with a weight, their weights, thresholds."""
    cells, values, sizes, grades = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for pdf in batches:
        cells.append(b"".join(pdf["cells"]))
        values.append(b"".join(pdf["values"]))
        sizes.append(pdf["cells"].map(len).to_numpy(dtype=np.int64) // 4)
        grades.append(pdf["grade"].to_numpy(dtype=np.int64))
    grades = np.concatenate(grades)
    if len(grades):
        model = _fit(np.frombuffer(b"".join(cells), "<i4"), np.frombuffer(b"".join(values), "<f4"), np.concatenate(sizes), grades)
        used = np.flatnonzero(model.weights)
        yield pd.DataFrame({"cells": [used.astype("<i4").tobytes()], "weights": [model.weights[used].astype("<f4").tobytes()], "thresholds": [model.thresholds.astype("<f8").tobytes()]})


def rate(text: Column, model: Model) -> Column:
    """Struct column (expected_grade, tail): the mean of the grade, and the probability of the highest one."""

    @F.pandas_udf("expected_grade double, tail double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features()
        for texts in batches:
            tails = np.array([model.tails(t, features) for t in texts]).reshape(len(texts), -1)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, -1]})

    return run(text)


def keep_good(docs: DataFrame, ratings: DataFrame, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose probability of the highest grade is `tail` or more, with all their columns.

    A null text counts as empty, one feature of its own. Null ids and repeated rows are rated like any other (for the
    fit an id counts once); an empty table gives an empty result. Without any rating every document is kept.
    """
    model = train(docs, ratings, id_col=id_col, text_col=text_col)
    return packed(docs, rate(F.col(text_col), model).alias("_rated")).filter(F.col("_rated.tail") >= tail).select("row.*")


def label_grades(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = docs.select("doc_id", rate(F.col("text"), train(docs, label_grades(spark, sf_dir))).alias("r"))
    return rated.select("doc_id", F.round("r.expected_grade", 6).alias("expected_grade"), F.round("r.tail", 6).alias("tail_probability"), (F.col("r.tail") >= TAIL).alias("kept"))


SQL: dict[str, str] = {}
