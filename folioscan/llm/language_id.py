"""Language identification by nearest centroids of TF-IDF vectors of letter n-grams.

A text is lower-cased, everything but letters becomes one space, and its 1- to 4-grams of code points are counted in
`DIM` hashed bins. Weights are (1 + log count) * idf, length one. For each language, spherical k-means gives several
centroids; a text takes the language of the centroid with the greatest cosine. A text is rejected whose cosine falls below a limit for
its language and length, between what training texts and pieces of that length reach and what random letters do.

The classifier is fitted on at most `sample` different labelled rows (id and text) of each language, picked by the rank of a hash, and on no further row once these have `sample_bytes` of text: a documented,
bounded sample; everything else covers all rows and whole texts. Every language that occurs is learned, each in a task of its own: only document frequencies of the `DIM` bins and the centroids
reach the driver. Null text or text without a letter: `und`, score 0, rejected.
Ties between languages go to the lesser name. Without any labelled row every text is `und`. Repeated rows are predicted each. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import U64, Scratch, configured, maybe_broadcast, mix64, partitions

DIM = 1 << 18
_SHIFT = U64(64 - 18)
#: Length bands, the last one open.
BANDS = 40
#: Code points counted at once; longer texts are counted in pieces that overlap by the longest n-gram.
PIECE = 1 << 18
_OTHER = re.compile(r"[\W\d_]+")
_ORDERS = (1, 2, 3, 4)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The bins of the whole text's n-grams, in order, and their counts; None if it has no letter."""
    if not text:
        return None
    total = None
    tail = ""
    for at in range(0, len(text), PIECE):
        plain = tail + _OTHER.sub(" ", text[at : at + PIECE].lower())
        points = np.frombuffer(f" {plain} ".encode("utf-32-le"), dtype="<u4").astype(U64) if at == 0 else np.frombuffer(f"{plain} ".encode("utf-32-le"), dtype="<u4").astype(U64)
        if not np.any(points != U64(32)):
            continue
        own = _counted(points)
        total = own if total is None else _added(total, own)
        tail = plain[-(_ORDERS[-1] - 1) :]
    return total


def _counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the n-grams of code points, in order, and their counts."""
    h = np.zeros(len(points), dtype=U64)
    found = []
    for n in _ORDERS:
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * U64(0x100000001B3) + points[n - 1 :] + U64(n)
        found.append((mix64(h) >> _SHIFT).astype(np.int32))
    all_ = np.concatenate(found)
    if len(all_) < DIM // 8:
        return np.unique(all_, return_counts=True)
    count = np.bincount(all_, minlength=DIM)
    bins = np.flatnonzero(count)
    return bins.astype(np.int32), count[bins]


def _added(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bins, at = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    return bins, np.bincount(at, weights=np.concatenate([x[1], y[1]])).astype(np.int64)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text for all bins; None if it has no letter."""
    found = grams(text)
    return None if found is None else np.bincount(found[0], weights=found[1], minlength=DIM).astype(np.int64)


class Rows:
    """Sparse rows of length one: (1 + log count) * idf of each bin that occurs."""

    def __init__(self, bins: np.ndarray, count: np.ndarray, sizes: np.ndarray, idf: np.ndarray):
        self.bins, self.sizes, self.firsts = bins, sizes, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        x = np.log1p(count) * idf[bins]
        self.values = x / np.repeat(np.sqrt(np.add.reduceat(x * x, self.firsts)), sizes)

    def dots(self, c: np.ndarray) -> np.ndarray:
        return np.array([np.add.reduceat(v[self.bins] * self.values, self.firsts) for v in c]).T

    def mean(self, of: np.ndarray) -> np.ndarray:
        own = np.repeat(of, self.sizes)
        return np.bincount(self.bins[own], weights=self.values[own], minlength=DIM) / of.sum()

    def row(self, i: int) -> np.ndarray:
        return self.mean(np.arange(len(self.sizes)) == i)


def fit_centroids(x: Rows, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from farthest points: no random choice."""
    centres = [x.mean(np.ones(len(x.sizes), dtype=bool))]
    while len(centres) < min(k, len(x.sizes)):
        near = np.max(x.dots(np.array(centres)), axis=1)
        centres.append(x.row(int(np.argmin(near))))
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        own = np.argmax(x.dots(c), axis=1)
        c = np.array([x.mean(own == i) if np.any(own == i) else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def _parts(text: str) -> Iterator[str]:
    """The text, and a piece of it of each length 8, 16, 32, ..., cut where a word begins."""
    yield text
    size = 8
    while size < len(text):
        at = text.rfind(" ", 0, (len(text) - size) // 2 + 1) + 1
        yield text[at : at + size]
        size *= 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, text) to (lang, letters, bins, counts) of the texts and of their pieces, whose letters are null."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [(lang, None if i else "".join(sorted(set(_OTHER.sub("", t.lower())))), c) for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True) for i, t in enumerate(_parts(text.as_py())) if (c := grams(t)) is not None]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())]
            columns += [pa.array([x[2][i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "letters", "bins", "counts"])


def band(n: float | np.ndarray) -> np.ndarray:
    """The length band of a text of n n-grams: two for each doubling."""
    return np.minimum(2 * np.log2(np.maximum(n, 1)), BANDS - 1).astype(np.int64)


class LanguageModel:
    """Centroids with their languages, idf of the bins seen and rejection limits for each length band; some MB, sent to the tasks.

    Centroids are held by bin: the entries first[i]:first[i + 1] of own and weight are the centroids that have bin seen[i], and their values there.
    """

    def __init__(self, langs: list[str], seen: np.ndarray, first: np.ndarray, own: np.ndarray, weight: np.ndarray, idf: np.ndarray, unseen: float, limits: dict[str, np.ndarray]):
        self.langs, self.seen, self.first, self.own, self.weight, self.idf, self.unseen, self.limits = langs, seen, first, own, weight, idf, unseen, limits

    @property
    def centroids(self) -> np.ndarray:
        """A row for each bin seen, a column for each centroid."""
        out = np.zeros((len(self.seen), len(self.langs)), np.float32)
        out[np.repeat(np.arange(len(self.seen)), np.diff(self.first)), self.own] = self.weight
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)"""
        found = grams(text)
        if found is None or not self.langs:
            return "und", 0.0, True
        bins, count = found
        at = np.minimum(np.searchsorted(self.seen, bins), len(self.seen) - 1)
        known = self.seen[at] == bins
        x = np.log1p(count)
        at = at[known]
        values = x[known] * self.idf[at]
        norm = np.sqrt(values @ values + self.unseen**2 * (x[~known] @ x[~known]))
        n = self.first[at + 1] - self.first[at]
        entries = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cosines = np.bincount(self.own[entries], weights=self.weight[entries] * np.repeat(values, n), minlength=len(self.langs)) / norm
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[best], score, bool(score < self.limits[self.langs[best]][band(count.sum())])


_NOTHING = LanguageModel([], np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0), 1.0, {})


def _noise(letters: str, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """N-grams of texts of random letters, with and without spaces, of some n n-grams."""
    r = np.random.default_rng(n)
    size, many = max(1, n // 4), int(min(100, max(6, (1 << 16) // n)))
    out = []
    for spaces in (0, 1, len(letters)):
        pool = np.array([*map(ord, letters), *[32] * spaces], dtype=U64)
        for _ in range(many):
            points = np.concatenate(([U64(32)], pool[r.integers(len(pool), size=size)], [U64(32)]))
            points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
            if len(points) > 1:
                out.append(_counted(points))
    return out


def _limits(scores: np.ndarray, sizes: np.ndarray, noise, reject_share: float) -> np.ndarray:
    """Limits by length band, from the cosines of texts and pieces with their numbers of n-grams. noise(n): cosines of random letters.

    Between what all but a hundredth of the texts near that length reach and what all but a hundredth of random texts stay below.
    """
    bands = band(sizes)
    known = [b for b in range(BANDS) if np.sum(bands == b) >= 20] or sorted(set(bands.tolist()))
    low = np.array([np.quantile(scores[bands == b], 0.01) for b in known])
    low = np.array([low[max(0, i - 2) : i + 3].min() for i in range(len(low))])
    high = np.array([np.quantile(noise(int(2 ** (b / 2 + 0.25))), 0.99) for b in known])
    limits = np.where(high < low, high + reject_share * (low - high), low)
    # Lengths that the sample doesn't hold take the nearest one's.
    return limits[np.abs(np.arange(BANDS)[:, None] - np.array(known)[None, :]).argmin(axis=1)]


def training_rows(docs: DataFrame, training: Column, sample: int, languages: int | None, id_col: str, text_col: str, lang_col: str, sample_bytes: int = 8 << 20) -> DataFrame:
    """(lang, text) of at most `sample` different rows for each language: those of the least hashes of id and text, up to the one with which they have sample_bytes.

    languages: only so many, the most frequent ones; None: all.
    """
    labelled = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language sample")).alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    if languages is not None:
        sizes = sizes.orderBy(F.col("n").desc(), "lang").limit(languages)
    # A row for each language.
    sizes = Scratch(docs.sparkSession, "languages").table(sizes, "sizes")
    # The least hashes, with room: some two samples' worth of the different rows, so the ranking is over few.
    near = labelled.join(maybe_broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.least(F.lit(1.0), 2 * sample / F.col("n")) * (1 << 30)).select("lang", "text", "h").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = near.select("lang", "text", F.row_number().over(order).alias("rank"), before.alias("before"))
    return ranked.where((F.col("rank") <= sample) & (F.col("before") < sample_bytes)).select("lang", "text")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (bins) of texts to (bin, n): in how many texts of the task each bin occurs; bin -1: how many they are."""
    count, texts = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for bins in batch.column(0):
            count[np.frombuffer(bins.as_buffer(), dtype=np.int32)] += 1
            texts += 1
    found = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(count[found], texts))], names=["bin", "n"])


def _fitted(idf: np.ndarray, centroids: int, reject_share: float):
    """One language's features to a row (lang, k, bins, weights, limits): its k centroids' values at the bins that they have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip((x is None for x in table["letters"].to_pylist()), table["bins"].to_pylist(), table["counts"].to_pylist(), table["letters"].to_pylist(), strict=True), key=lambda r: r[:3])
        of = lambda some: Rows(np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]), np.array([len(x[0]) for x in some]), idf)
        own = [(np.frombuffer(r[1], dtype=np.int32), np.frombuffer(r[2], dtype=np.int32)) for r in rows]
        texts = [x for x, r in zip(own, rows, strict=True) if not r[0]]
        c = fit_centroids(of(texts), centroids)
        held = Counter(x for r in rows if r[3] for x in r[3])
        letters = "".join(sorted(x for x, n in held.items() if n * 10 >= len(texts)))
        limits = _limits(of(own).dots(c).max(axis=1), np.array([x[1].sum() for x in own]), lambda n: of(_noise(letters, n)).dots(c).max(axis=1), reject_share)
        bins = np.flatnonzero(c.any(axis=0)).astype(np.int32)
        row = [key[0].as_py(), len(c), bins.tobytes(), c[:, bins].astype(np.float32).tobytes(), limits.astype(np.float64).tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["lang", "k", "bins", "weights", "limits"])

    return run


def fit(docs: DataFrame, training: Column, sample: int = 300, centroids: int = 4, reject_share: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int | None = None, sample_bytes: int = 8 << 20) -> LanguageModel:
    """A model from rows where training holds and lang isn't null. sample, sample_bytes: labelled rows per language, at most, and their text; languages: only the most frequent ones.

    reject_share: a text is rejected below a limit for its length and language, that share of the way from the cosines of random letters
    up to the least that the sample's texts, and pieces of them, reach at that length, a hundredth left out.
    """
    spark = configured(docs)
    scratch = Scratch(spark, "language")
    rows = training_rows(docs, training, sample, languages, id_col, text_col, lang_col, sample_bytes).repartition(partitions(spark))
    features = scratch.table(rows.mapInArrow(_features, "lang string, letters string, bins binary, counts binary"), "features")
    # DIM rows at most.
    found = features.where("letters is not null").select("bins").mapInArrow(_frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    count = dict(zip(found["bin"].to_pylist(), found["n"].to_pylist(), strict=True))
    total = count.pop(-1, 0)
    if not total:
        scratch.remove()
        return _NOTHING
    idf = np.full(DIM, np.log(1 + total) + 1)
    idf[np.array(list(count), dtype=np.int64)] = np.log((1 + total) / (1 + np.array(list(count.values())))) + 1
    own = features.repartition(partitions(spark), "lang").groupBy("lang").applyInArrow(_fitted(idf, centroids, reject_share), "lang string, k int, bins binary, weights binary, limits binary").collect()
    scratch.remove()
    langs, bins, columns, weights, limits = [], [], [], [], {}
    for r in sorted(own, key=lambda r: r["lang"]):
        at, w = np.frombuffer(r["bins"], dtype=np.int32), np.frombuffer(r["weights"], dtype=np.float32).reshape(r["k"], -1)
        which, where = np.nonzero(w)
        bins.append(at[where])
        columns.append((which + len(langs)).astype(np.int32))
        weights.append(w[which, where])
        langs += [r["lang"]] * r["k"]
        limits[r["lang"]] = np.frombuffer(r["limits"], dtype=np.float64)
    bins, columns, weights = np.concatenate(bins), np.concatenate(columns), np.concatenate(weights)
    order = np.argsort(bins, kind="stable")
    seen, n = np.unique(bins, return_counts=True)
    return LanguageModel(langs, seen, np.concatenate(([0], np.cumsum(n))), columns[order], weights[order], idf[seen], float(np.log(1 + total) + 1), limits)


def _predict(model: LanguageModel, keep: int, at: int):
    """Batches of keep columns, the text in column at, to those columns and the model's verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [model.predict(t.as_py()) for t in part.column(at)]
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *columns], names=[*part.schema.names[:keep], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of every row, with lang_pred, score and rejected. Kept columns of those names are replaced."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "rejected")]
    # A kept text travels once.
    configured(docs)
    plain = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("__text__"))
    at = keep.index(text_col) if text_col in keep else len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return plain.mapInArrow(_predict(model, len(keep), at), f"{schema}, lang_pred string, score double, rejected boolean")
