"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, label_fold, pick, ship
from .textstats import FEATURES, text_stats

#: The most labelled rows that a model is fitted on (those whose ids hash lowest).
TRAIN_ROWS = 20_000


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth as arrays (tree, node): node k's children are 2k+1 (value <= cut) and 2k+2. leaf: (tree, leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of statistics."""
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and (node[0] if len(node) else inner) < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Boosted trees for a logistic loss. A split is found from histograms of gradients over quantile bins; without a gain both children are alike.
    With no rows or one class the forest has no trees."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    cuts = [np.unique(np.concatenate([np.quantile(x[y == k, f], np.linspace(0, 1, bins + 1)[1:-1]) for k in (0, 1)])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    total, out = np.full(len(y), bias), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local, best = node - first, np.full(width, 1e-9)
            choice = np.full(width, -1)
            for f, c in enumerate(cuts):
                size = len(c) + 1
                at = local * size + code[:, f]
                gs = np.bincount(at, g, width * size).reshape(width, size).cumsum(1)
                hs = np.bincount(at, h, width * size).reshape(width, size).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                choice = np.where(better, k, choice)
                feature[first : first + width] = np.where(better, f, feature[first : first + width])
            for n in range(width):
                if choice[n] >= 0:
                    cut[first + n] = cuts[feature[first + n]][choice[n]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = rate * np.bincount(node - inner, g, leaves) / (np.bincount(node - inner, h, leaves) + ridge)
        total += leaf[node - inner]
        for into, what in zip(out, (feature, cut, leaf), strict=True):
            into.append(what)
    return Forest(*(np.stack(a) for a in out), bias)


def fit_quality(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fitted on at most `rows` rows of stats with a quality label whose fold of five isn't 0, those whose ids hash lowest (rows of one id by their
    statistics, so that the sample is the same each time). Without rows the forest is a constant."""
    known = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)").where(label_fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = stats.join(known, "doc_id").select("y", *FEATURES, F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id", *FEATURES).limit(rows).toPandas()
    return fit(sample[FEATURES].to_numpy(float), sample["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out (its fold of five is 0), score of label 1, predicted.

    Null and empty texts are scored by their statistics, which are 0. A null id is not held out. Repeated rows are scored alike. Without labels
    of both classes every score is the (smoothed) share of label 1.
    """
    stats = keep(text_stats(pick(docs, doc_id="long", text="string"), "doc_id"), "stats")
    forest = fit_quality(stats, labels)

    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in columns]) if len(columns[0]) else np.zeros((0, len(columns)))))

    score = F.pandas_udf(scored, "double", F.PandasUDFType.SCALAR)
    return stats.select("doc_id", (label_fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(*FEATURES).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


ship(__name__)
