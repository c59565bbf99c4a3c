"""Clusters of vectors: k-means inside tasks on a bounded sample, one task for each part of the vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that are trained on, at most.
SAMPLE = 16384


def sampled(vectors: DataFrame, vec: str, n: int = SAMPLE) -> DataFrame:
    """(vec): at most n vectors, those of the least hash of their content; equal ones count once."""
    total = vectors.count()
    share = max(1, total // (4 * n))
    code = F.xxhash64(vec)
    rows = vectors.select(F.col(vec).cast("array<double>").alias("vec"), code.alias("code")).where(F.pmod(F.xxhash64("code"), F.lit(share)) == 0)
    return rows.dropDuplicates(["code"]).orderBy("code").limit(n).select("vec")


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((vectors * vectors).sum(1)[:, None] - 2 * vectors @ centroids.T + (centroids * centroids).sum(1), 0)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squared_distances(vectors[a : a + 2048], centroids).argmin(axis=1) for a in range(0, len(vectors), 2048)] or [np.zeros(0, np.int64)])


def k_means(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from k vectors spread over the sample; a cell that loses its vectors keeps its centre."""
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        own = nearest(vectors, centroids)
        order = np.argsort(own, kind="stable")
        cells, first = np.unique(own[order], return_index=True)
        moved = centroids.copy()
        moved[cells] = np.add.reduceat(vectors[order], first) / np.diff([*first, len(order)])[:, None]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def trained(sample: DataFrame, k: int, parts: int = 1, rounds: int = 10) -> DataFrame:
    """(part, cell, centroid): up to k cells for each of so many equal parts of the vectors. A part's sample, bounded as the sample is, is one task's."""
    width = F.size("vec") / parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("vec", (i * width + 1).cast("int"), width.cast("int")))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = k_means(np.array(rows["vec"].tolist(), np.float64), k, rounds)
        return pd.DataFrame({"part": int(key[0]), "cell": range(len(found)), "centroid": list(found)})

    return sample.select(F.posexplode(cut).alias("part", "vec")).groupBy("part").applyInPandas(fit, "part int, cell int, centroid array<double>")


def collected(centroids: DataFrame) -> list[np.ndarray]:
    """The centres of each part as a matrix; what trained() gives is bounded by its arguments."""
    rows = sorted(centroids.collect(), key=lambda r: (r["part"], r["cell"]))
    return [np.array([r["centroid"] for r in rows if r["part"] == p], np.float64) for p in sorted({r["part"] for r in rows})]
