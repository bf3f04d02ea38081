"""Quality classifier: naive Bayes features in a support vector machine.

Features are indicators of the byte n-grams of a text (SIZES), hashed into BUCKETS. Each is scaled by the log ratio of
its smoothed frequencies in good and bad training documents, each row is brought to unit length, and a linear
squared-hinge model is fitted by dual coordinate descent. A logistic curve fitted on a part of the sample left out of
training turns margins into the probability of label 1, at the classes' shares among all labelled rows; a short text's
log odds are drawn towards these shares.

The hinge loss is squared, so that dual variables have no upper bound. Training reads a bounded sample: SAMPLE documents
of either class, those whose hashed ids are smallest, and of a document with more than FEATURES distinct n-grams as
many of them, as hashes fall over the whole text. So the driver holds 2 * SAMPLE * FEATURES numbers of four bytes twice
at most. Scores cover every row and whole texts, with all their n-grams. A null or empty text has no features and gets
the share of label 1. Null ids and labels train nothing; of rows of one id one trains, that of the smallest features.
Repeated rows are scored each. Without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm import kernels as K
from impulsia.llm.common import learns, prepare, resident, trim

BUCKETS = 1 << 20
SIZES = (3, 4)
#: Labelled documents of either class that training reads at most.
SAMPLE = 2000
#: Distinct n-grams of a document that training reads at most.
FEATURES = 8192
SMOOTH, COST, EPOCHS = 1.0, 1.0, 12
#: From a text of so many distinct n-grams, half of the evidence counts: few n-grams say little against the classes' shares.
HALF = 200
#: Of so many sampled rows one fits the logistic curve.
CALIBRATE = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's n-grams, and where each text's begin."""
    lengths, found = np.diff(offsets), []
    for n in SIZES:
        count = np.maximum(lengths - n + 1, 0)
        text = np.repeat(np.arange(len(lengths)), count)
        at = np.arange(len(text)) + np.repeat(offsets[:-1] - np.cumsum(count) + count, count)
        gram = np.full(len(at), n, np.uint64)
        for j in range(n):
            gram = (gram << np.uint64(8)) | data[at + j]
        bucket = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        found.append((text.astype(np.uint64) << np.uint64(20)) | bucket)
    keys = np.sort(np.concatenate(found))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(20))


def fit(buckets: np.ndarray, bounds: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the buckets and, last, the bias; and the squares of the log ratios. buckets, bounds: each row's features, as from features(). y: 1 or -1."""
    counts = np.full((2, BUCKETS), SMOOTH)
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    for (lo, hi), sign in zip(spans, y, strict=True):
        counts[int(sign > 0), buckets[lo:hi]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = ratio[buckets].astype(np.float32)
    for lo, hi in spans:
        scaled[lo:hi] *= _scale(float((scaled[lo:hi] ** 2).sum()))
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    weight = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    soft = np.array([1 / (2 * COST * weight[int(s)]) for s in y])
    norm = np.array([1 + float((scaled[lo:hi] ** 2).sum()) for lo, hi in spans]) + soft
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            lo, hi = spans[i]
            r, x = buckets[lo:hi], scaled[lo:hi]
            slope = y[i] * (w[r] @ x + bias) - 1 + soft[i] * alpha[i]
            step = max(alpha[i] - slope / norm[i], 0.0) - alpha[i]
            if step:
                w[r] += step * y[i] * x
                bias += step * y[i]
                alpha[i] += step
    return np.append(w * ratio, bias), ratio**2


def margin(weights: np.ndarray, squares: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
    norms = np.concatenate([[0.0], np.cumsum(squares[buckets], dtype=np.float64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) * _scale(norms[bounds[1:]] - norms[bounds[:-1]]) + weights[BUCKETS]


def _scale(squares):
    """What brings a row to unit length."""
    return 1 / np.sqrt(np.maximum(squares, 1e-12))


def curve(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve of weighted rows, by Newton steps with Platt's smoothed targets."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * m).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, from the sample's features; only rows that learns() allows are read."""
    prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(learns(3)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.5
    if len(shares) < 2:
        return {"share": share}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def extract(batches):
        resident()
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                buckets, bounds = _sampled(*features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), K.blobs(buckets.astype(np.uint32), bounds)], names=["doc_id", "quality", "buckets"])

    found = picked.mapInArrow(extract, "doc_id long, quality int, buckets binary")
    # Of rows of one id one comes to the driver.
    got = found.groupBy("doc_id", "quality").agg(F.min("buckets").alias("buckets")).toArrow().sort_by("doc_id")
    y = np.where(got.column("quality").to_numpy() > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return {"share": share}
    flat = got.column("buckets").combine_chunks()
    del got
    held = np.zeros(len(y), bool)
    for s in (-1, 1):  # every fourth of either class, while training keeps some
        held[np.flatnonzero(y == s)[CALIBRATE - 1 :: CALIBRATE]] = True
    weights, squares = fit(*_flat(flat.filter(pa.array(~held))), y[~held])
    part = held if len(set(y[held].tolist())) == 2 else np.ones(len(y), bool)
    m = margin(weights, squares, *_flat(flat.filter(pa.array(part))))
    prior = np.where(y[part] > 0, share / max(1, (y[part] > 0).sum()), (1 - share) / max(1, (y[part] < 0).sum()))
    a, b = curve(m, y[part], prior * part.sum())
    del flat
    trim()
    return {"share": share, "weights": weights.astype(np.float32), "squares": squares.astype(np.float32), "curve": (a, b)}


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows of a binary column that extract() made, and where each row's begin."""
    blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False) // 4
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint32), bounds


def _sampled(buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's features FEATURES at most: those of the smallest hashes, salted by how many the text has."""
    count = np.diff(bounds)
    if not (count > FEATURES).any():
        return buckets, bounds
    kept = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = buckets[lo:hi]
        if len(own) > FEATURES:
            own = own[np.sort(np.argsort(K.mix(own.astype(np.uint64) + (np.uint64(len(own)) << np.uint64(32))), kind="stable")[:FEATURES])]
        kept.append(own)
    return np.concatenate(kept), np.concatenate([[0], np.cumsum([len(x) for x in kept])])


def score(docs: DataFrame, model: dict, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each text. The model is a few MB whatever the corpus. A column of that name is replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(column)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    if "weights" not in model:
        return docs.withColumn(column, F.lit(float(model["share"])))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        resident()
        own = shared.value
        a, b = own["curve"]
        prior = np.log(own["share"] / (1 - own["share"]))
        for batch in batches:
            made = [np.empty(0)]
            for _, _, data, offsets in K.chunks(batch.column(batch.schema.get_field_index(text))):
                buckets, bounds = features(data, offsets)
                odds = a * margin(own["weights"], own["squares"], buckets, bounds) + b
                count = np.diff(bounds)
                odds = prior + (odds - prior) * count / (count + HALF)
                made.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made), pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(add, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted label of every row."""
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return rows.select("doc_id", (~learns(3)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
