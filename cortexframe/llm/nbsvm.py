"""Quality classifier: naive Bayes support vectors over hashed n-grams.

A text is lower-cased (A-Z) and cut into runs of letters and digits and runs of other signs; its features are the
hashed buckets of its tokens and token pairs, as indicators, and two more that say whether a token comes three times in
a row, directly or at every second place. Each indicator is scaled by the log ratio of its share in
the two classes, and the scaled vector to length one; a linear hinge loss is fitted by dual coordinate descent.

The class counts cover every training row. The hinge fit uses at most ``max_rows`` training rows, chosen by hash.
Null and empty texts have no features and get the score of the bias. Labels that are null or disagree for a ``doc_id``
are left out, as are labels of no document. Repeated rows get the same score. Without both classes in training every
score is 0.5. An empty table gives an empty result; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import materialize
from . import kernels as K
from .common import map_texts, text_slices

BUCKETS = 1 << 17
#: Bytes of text whose features a worker finds at once; its arrays take some 40 times as much.
SLICE_BYTES = 512 << 10
MAX_ROWS = 5000
EPOCHS = 20
COST = 1.0


def held_out(doc_id: Column) -> Column:
    """Rows whose label is not learned: crc32 of the id as text leaves 1 on division by 3. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def features(texts: pa.Array, buckets: int) -> list[np.ndarray]:
    """Sorted distinct buckets of each text."""
    data, offsets = K.text_bytes(texts)
    data = K.lower_ascii(data)
    starts, ends, counts = K.tokens(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    pairs = K.chain(hashes, 2)
    rows = [np.flatnonzero(_same(hashes, step) & _same(hashes[step:], step, len(hashes))) for step in (1, 2)]
    one = (hashes % np.uint64(buckets - 2)).astype(np.int32) + 2
    two = (pairs % np.uint64(buckets - 2)).astype(np.int32) + 2
    out = []
    for lo, hi in zip(counts[:-1].tolist(), counts[1:].tolist()):
        runs = [step - 1 for step, at in zip((1, 2), rows) if _any_in(at, lo, hi - 2 * step)]
        out.append(np.unique(np.concatenate((one[lo:hi], two[lo:max(lo, hi - 1)], np.array(runs, np.int32)))))
    return out


def _same(hashes: np.ndarray, step: int, size: int | None = None) -> np.ndarray:
    """Whether an entry equals the one ``step`` places on; False where there is none."""
    out = np.zeros(len(hashes) if size is None else size, bool)
    equal = hashes[:-step] == hashes[step:] if len(hashes) > step else out[:0]
    out[: len(equal)] = equal
    return out


def _any_in(sorted_places: np.ndarray, lo: int, hi: int) -> bool:
    return bool(np.searchsorted(sorted_places, lo) < np.searchsorted(sorted_places, max(lo, hi)))


def class_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Number of rows of each class that hold each bucket, from one partial count per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                for own, y in zip(features(part.column("text"), buckets), part.column("y").to_pylist()):
                    counts[y, own] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "n0", "n1"])

    each = map_texts(rows.select("text", "y"), run, "bucket bigint, n0 bigint, n1 bigint")
    total = materialize(each.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))).toPandas()
    out = np.zeros((2, buckets))
    out[:, total["bucket"]] = total[["n0", "n1"]].to_numpy().T
    return out


def log_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last one for the bias, of ``min |w|^2/2 + cost * sum(hinge)`` by dual coordinate descent.

    The cost of a row is balanced by class.
    """
    values = [scaled(r, ratios) for r in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    w, alpha = np.zeros(len(ratios) + 1), np.zeros(len(y))
    draw = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(y)).tolist():
            at, x = rows[i], values[i]
            slope = sign[i] * (w[at] @ x + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / (x @ x + 1.0), 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    x = ratios[row]
    length = np.sqrt(x @ x)
    return x / length if length else x


class Model:
    """Bucket log ratios, weights and the logistic curve from margin to score."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.ratios, self.weights, self.slope, self.shift = ratios, weights, slope, shift

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row] @ scaled(row, self.ratios) + self.weights[-1])

    def score(self, row: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(row) + self.shift, -500, 500))))


def logistic(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve with both classes weighing the same, by Newton steps with a small ridge."""
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    x, theta = np.column_stack((margins, np.ones(len(y)))), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(curve, slope)
    return float(theta[0]), float(theta[1])


def fit_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` of ``rows(doc_id, text, y)``: one text per id, as many ids of each class as half the bound allows.

    An id stands for itself by its text of least hash, so neither copies nor texts that share an id crowd the others out.
    """
    hashed = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    each = materialize(hashed.groupBy("doc_id").agg(F.min("_h").alias("_h"), F.first("y").alias("_y")))
    classes = [each.filter(F.col("_y") == c).orderBy("_h", "doc_id").limit(max(1, max_rows // 2)) for c in (0, 1)]
    chosen = classes[0].unionByName(classes[1]).drop("_y")
    return spread_join(hashed, chosen, ["doc_id", "_h"], F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_rows: int = MAX_ROWS) -> Model | None:
    """A model from the labelled rows that are not held out, or None without both classes."""
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").alias("y"), F.max("quality").alias("_y")
    ).filter("y = _y").drop("_y")
    rows = materialize(spread_join(docs.select("doc_id", "text"), known, ["doc_id"], F.xxhash64("text")))
    ratios = log_ratios(class_counts(rows, buckets))
    sample = fit_rows(rows, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                own = pa.array(features(part.column("text"), buckets), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), own], names=["doc_id", "y", "own"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = map_texts(sample.select("doc_id", "text", "y"), run, f"doc_id {kinds['doc_id']}, y {kinds['y']}, own array<int>")
    table = found.toArrow().sort_by("doc_id")
    y = np.array(table.column("y").to_pylist(), np.int64)
    if not len(y) or y.min() == y.max():
        return None
    own = table.column("own").combine_chunks()
    ends, flat = own.offsets.to_numpy(), own.values.to_numpy()
    picked = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    model = Model(ratios, fit_hinge(picked, y, ratios), 1.0, 0.0)
    model.slope, model.shift = logistic(np.array([model.margin(r) for r in picked]), y)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        scored = base.select("doc_id", "held_out", F.lit(0.5).alias("score"))
        return scored.withColumn("predicted", F.lit(1))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                s = np.array([own.score(r) for r in features(part.column("text"), len(own.ratios))], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(base, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
