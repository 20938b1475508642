"""Quality classifier: support vectors on naive Bayes features.

A document's features are hashed indicators of its word 1- and 2-grams and of the 1- to 3-grams of its
words' shapes (runs of letters, digits and other characters), plus one for a word said twice running.
Each is scaled by its class log-count ratio, counted over all training rows, and a row has length one.
A linear hinge-loss model is fitted by dual coordinate descent, in one task, on a bounded sample of the training
rows (about ``FIT_ROWS`` of them, with ``FIT_SLOTS`` features in all at most); a fifth of the sample is held back
to turn margins into probabilities.

Only text is an input of a score.  Nulls: null and empty texts have no features and get the score of a
zero margin; labels with a null id or class and labels of no document are ignored; contradicting labels
of a document all count.  Rows sharing an id are each scored.  Without labels of both classes every
score is 0.5.  Equal texts have equal scores.  Empty tables give no rows.  Texts of any length are used whole;
extra columns are carried by ``keep`` and not by ``scores``, and none clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.llm.common import cut, ensure_small_batches, small
from haloframe.llm.counting import Tally, total
from haloframe.llm.words import hash_words, windows

BITS = 18
FIT_ROWS = 6_000
FIT_SLOTS = 8_000_000
EPOCHS = 12
COST = 4.0
FOLDS = 5
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = ord("a")
_CLASS[0x41:0x5B] = 0x01
_CLASS[0x30:0x3A] = 0x02


@dataclass
class Model:
    weights: np.ndarray  # of hashed features, log-count ratios included
    norms: np.ndarray  # squared log-count ratios
    bias: float
    slope: float
    offset: float

    def score(self, slots: np.ndarray) -> float:
        length = float(np.sqrt(self.norms[slots].sum())) or 1.0
        margin = float(self.weights[slots].sum()) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fold(doc_id: Column) -> Column:
    """Rows of fold 0 are held out from training."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def shapes(texts: pa.Array) -> pa.Array:
    """Texts with each run of letters, capitals, digits or one other character cut to one."""
    texts = texts.cast(pa.large_string())
    count = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    kinds = _CLASS[data]
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    starts = offsets[:-1] - offsets[0]
    fresh[starts[starts < len(kinds)]] = True
    ends = np.concatenate([[0], np.cumsum(fresh)])[offsets - offsets[0]]
    return pa.LargeStringArray.from_buffers(count, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kinds[fresh].tobytes()))


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted set of its feature slots."""
    for at in range(0, len(texts), 200):
        part = texts.slice(at, 200)
        for words, forms in zip(hash_words(part), hash_words(shapes(part.fill_null(""))), strict=True):
            kinds = [words, windows(words, 2)]
            kinds += [windows(forms, k) * np.uint64(0x9E3779B97F4A7C15) for k in (1, 2, 3)]
            if len(words) > 1 and (words[1:] == words[:-1]).any():
                kinds.append(np.array([7], np.uint64))
            yield np.unique((np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int32)) if len(words) else np.empty(0, np.int32)


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, costs: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is the weight of a constant feature."""
    weights, bias, duals, order = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    squares = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, x, y = rows[i], values[i], labels[i]
            gradient = y * (weights[slots] @ x + bias) - 1
            new = min(max(duals[i] - gradient / squares[i], 0.0), costs[i])
            step = (new - duals[i]) * y
            if step:
                weights[slots] += step * x
                bias += step
                duals[i] = new
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton's method with smoothed targets."""
    good, bad = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
    return max(float(beta[0]), 1e-3), float(beta[1])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Per feature the class log-count ratio, from its counts in rows of class 0 and 1, each smoothed by one."""
    seen = counts.reshape(2, -1) + 1.0
    return np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())


def learn(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray) -> Model:
    """The model of sampled rows (their slots and classes, 1 or -1); each fifth row only calibrates."""
    values = [ratios[r] / (np.sqrt((ratios[r] ** 2).sum()) or 1.0) for r in rows]
    kept = np.arange(len(rows)) % 5 == 4
    costs = COST * np.where(signs > 0, 1.0, (signs > 0).sum() / max(1, (signs < 0).sum()))
    fitted = np.flatnonzero(~kept)
    weights, bias = descend([rows[i] for i in fitted], [values[i] for i in fitted], signs[fitted], costs[fitted], EPOCHS)
    checked = kept if len(set(signs[kept])) == 2 else np.ones(len(rows), bool)
    margins = np.array([weights[r] @ v + bias for r, v, k in zip(rows, values, checked, strict=True) if k])
    slope, offset = calibrate(margins, signs[checked])
    return Model((weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(bias), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_slots: int = FIT_SLOTS) -> Model:
    """Learns from ``labels`` (``doc_id, quality``) of documents outside fold 0; counts are over all of them."""
    ensure_small_batches(docs.sparkSession)
    marks = cut(
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
            F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)
        )
    )
    training = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(small(marks), "doc_id").select("doc_id", "quality", "text")
    known = marks.groupBy("quality").count().collect()
    share = {q: min(1.0, fit_rows / 2 / n) for q, n in map(tuple, known)}
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    if len(share) < 2:
        return none
    sampled = {q: int(s * (1 << 20)) for q, s in share.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, rows, names = Tally(2 << BITS), [], ["block", "counts", "doc_id", "quality", "slots"]
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary())

        def batch_of(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, q, lot, slots in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), features(batch.column(3)), strict=True):
                tally.add(slots.astype(np.int64) + (q << BITS))
                if lot < sampled[q]:
                    rows.append((None, None, doc_id, q, slots.tobytes()))
            if rows:
                yield batch_of(rows)
                rows = []
        for k, counts in tally.blocks():
            yield batch_of([(k, counts, None, None, None)])

    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int")
    counted = cut(
        training.select("doc_id", "quality", lot, "text").mapInArrow(count, "block int, counts binary, doc_id bigint, quality int, slots binary")
    )
    ratios = log_ratios(total(counted.where("block IS NOT NULL").select("block", "counts"), 2 << BITS))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, signs = [], []
        for batch in batches:
            signs += [1.0 if q else -1.0 for q in batch.column(0).to_pylist()]
            rows += [np.frombuffer(x.as_buffer(), np.int32).copy() for x in batch.column(1)]
        if len(set(signs)) == 2:
            model = learn(rows, np.array(signs), ratios)
            row = [(model.weights.tobytes(), pa.binary()), (model.norms.tobytes(), pa.binary()), *((x, pa.float64()) for x in (model.bias, model.slope, model.offset))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=["weights", "norms", "bias", "slope", "offset"])

    sample = counted.where("block IS NULL").select("doc_id", "quality", "slots")
    size = F.octet_length("slots").cast("bigint")
    held = sample.agg(F.sum(size)).first()[0] or 0
    if held > 4 * fit_slots:  # few long texts in place of many
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit("size")), F.lit(1 << 20)) < int((1 << 20) * 4 * fit_slots / held))
    order = ("doc_id", "quality", "slots")
    first = sample.orderBy(*order).limit(2 * fit_rows).withColumn("upto", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    found = first.where(F.col("upto") <= 4 * fit_slots).select("quality", "slots").mapInArrow(learned, "weights binary, norms binary, bias double, slope double, offset double").collect()
    if not found:
        return none
    weights, norms, *rest = found[0]
    return Model(np.frombuffer(bytes(weights), np.float32), np.frombuffer(bytes(norms), np.float32), *rest)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    ensure_small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [model.score(slots) for slots in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, not shuffled."""
    ensure_small_batches(docs.sparkSession)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [model.score(slots) >= threshold for slots in features(batch.column(batch.num_columns - 1))]
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield own.filter(pa.array(ok, pa.bool_()))

    return docs.select("*", F.col("text")).mapInArrow(chosen, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
