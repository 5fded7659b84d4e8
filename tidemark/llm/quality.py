"""A quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .wordhash import Words, mix

#: Features are hashed to this many bits.
FEATURE_BITS = 18
#: Labelled rows that the classifier is fitted on, at most.
MAX_LABELLED = 4000
_CLASS = np.full(256, 5, np.int64)
_CLASS[0x30:0x3A] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x61:0x7B] = 3
_CLASS[0x80:] = 4
_LETTER_LIKE = np.isin(_CLASS, (2, 3, 4))


def shapes(words: Words) -> np.ndarray:
    """A number for the form of each word: kinds of its first and last character, case, digits, length, and if it repeats the last word."""
    raw, a, b = words.raw, words.starts, words.stops
    first, last = _CLASS[raw[a]], raw[b - 1].astype(np.int64)
    last = np.where(_LETTER_LIKE[last], 0, np.where(_CLASS[last] == 1, 1, last))

    def holds(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[b] > sums[a]

    kind = _CLASS[raw]
    size = np.minimum(b - a, 16)
    size = (size > 1).astype(np.int64) + (size > 3) + (size > 9)
    same = np.zeros(len(a), np.int64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    code = first * 256 + last
    for bit in (holds((kind == 3) | (kind == 4)), holds(kind == 1), same):
        code = code * 2 + bit
    return code * 4 + size


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all indicators of a run of texts, each once.

    Indicators: lower-cased words and word pairs; and 1-, 2- and 3-grams of word shapes, each with how
    often it occurs for its text's length, in powers of two.
    """
    words = Words(raw, offsets, fold=True)
    text = words.of_text()
    if not len(words):
        return text, text
    keys = [(text, words.hash), (text, mix(words.hash + np.uint64(1)))]
    pair, inside = words.grams(2)
    keys[1] = (text[inside], pair[inside])
    found = [(t << FEATURE_BITS) | (mix(h + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) for k, (t, h) in enumerate(keys, 2)]
    form = mix(shapes(words).astype(np.uint64))
    plain = Words.__new__(Words)
    plain.hash, plain.bounds, plain.counts = form, words.bounds, words.counts
    for n in (1, 2, 3):
        h, inside = plain.grams(n)
        short = (h[inside] >> np.uint64(40)).astype(np.int64)
        both, count = np.unique((text[inside] << 24) | short, return_counts=True)
        t = both >> 24
        share = np.floor(np.log2(words.counts[t] / count)).clip(0, 9).astype(np.uint64)
        h = mix((both & 0xFFFFFF).astype(np.uint64) * np.uint64(64) + share * np.uint64(4) + np.uint64(n))
        found.append((t << FEATURE_BITS) | (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


@dataclass
class Model:
    """P(label 1) = sigmoid(slope * (w . x / |r . x| + bias) + shift)."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(text, self.weights[feature], minlength=n)
        norm = np.sqrt(np.bincount(text, self.ratios[feature] ** 2, minlength=n))
        return total / np.maximum(norm, 1e-12) + self.bias

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        m = self.margins(*features(raw, offsets), len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with hinge loss (Hsieh et al., 2008)."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, bias


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid fitted to margins, with Platt's smoothed targets, by Newton steps."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - step.clip(-2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """The classifier of rows of feature numbers. With one class, or none, every score is that class's share."""
    size = 1 << FEATURE_BITS
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    back = np.arange(len(rows)) % 5 == 4
    if len(set(labels[back].tolist())) < 2 or len(set(labels[~back].tolist())) < 2:
        back[:] = False
    train = np.flatnonzero(~back)
    counts = np.full((2, size), smoothing)
    for i in train:
        counts[labels[i], rows[i]] += 1
    counts /= counts.sum(1, keepdims=True)
    ratios = np.log(counts[1] / counts[0])
    # one array for all rows' values: it is given back to the system as a whole
    cuts = np.cumsum([0, *map(len, rows)])
    flat = np.empty(cuts[-1], np.float32)
    for a, b, r in zip(cuts, cuts[1:], rows, strict=False):
        flat[a:b] = ratios[r] / max(float(np.linalg.norm(ratios[r])), 1e-12)
    values = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    share = labels[train].mean()
    weight = np.where(labels == 1, cost / (2 * share), cost / (2 * (1 - share)))
    w, bias = dual_coordinate_descent([rows[i] for i in train], [values[i] for i in train], 2.0 * labels[train] - 1, weight[train], size)
    margin = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values, strict=True)])
    where = back if back.any() else ~back
    slope, shift = _platt(margin[where], labels[where])
    return Model(w * ratios, ratios, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, fold: int = 5) -> Model:
    """A model of at most ``max_labelled`` labelled rows outside the held-out fold (crc32 of the id modulo ``fold`` is 0).

    The rows are the first by a hash of the id, which may be of any type; of texts that repeat an id the one with the
    least hash is taken, and of labels the least. Only labels and whole texts are used.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % fold != 0))
    ids = ids.groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    spark = docs.sparkSession
    kind = labels.schema[id_col].dataType.simpleString()
    picked = [(r["i"], r["y"]) for r in ids.collect()]
    sample = spark.createDataFrame(picked, f"i {kind}, y int")
    rows = docs.select(F.col(id_col).cast(kind).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # at most max_labelled ids
    rows = rows.join(F.broadcast(sample), "i").groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("i", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for lo, hi, raw, offsets in text_chunks(batch.column(2)):
                text, feature = features(raw, offsets)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                feature = feature.astype("<i4")
                out += [feature[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["i", "y", "f"])

    got = rows.mapInArrow(run, f"i {kind}, y int, f binary").toArrow()
    # in the order of the hash again, so that no fold of the fit follows the ids
    place = {i: n for n, (i, _) in enumerate(picked)}
    order = sorted(range(got.num_rows), key=[place[i] for i in got.column("i").to_pylist()].__getitem__)
    f = got.column("f")
    return fit([np.frombuffer(f[n].as_buffer(), "<i4") for n in order], np.array(got.column("y").to_pylist(), np.int64)[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``: P(label 1) of each whole text; null and empty texts are scored as texts without features.

    A column that is called so already is replaced. All other columns and rows stay, repeated ones too.
    """
    from pyspark.sql import types as T

    handle = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(score_col)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [handle.value.scores(raw, offsets) for _, _, raw, offsets in text_chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*batch.schema.names, score_col])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(score_col, T.DoubleType())]))
