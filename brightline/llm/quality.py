"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of all the
raw text, give each document a log importance weight: the sum over its n-grams of the log ratio of the
models. The documents are resampled to the target's distribution without replacement: the k largest of
log weight + Gumbel noise.

Tokens are runs of word bytes and runs of punctuation, A-Z lower-cased. Counts of the raw model cover every
n-gram of every document; the target model is fitted on at most TARGET_ROWS labelled documents. With target
count t of a cell, e the count expected there if the target were like the raw text, and the smoothing a of the
n-gram's length, the cell's log ratio is log((t + a) / (e + a)): cells that are too rare to tell say nothing.
A document of the target sample is scored with its own counts taken out of both models.

A log weight sums over all n-grams of a text, so those of whole texts lie hundreds apart and Gumbel noise of 1 rarely decides between them: at temperature 1 the
sample is nearly the k likeliest documents, which is what a filter wants. A higher temperature divides the weights, so that documents are drawn with
chances that differ less, and another seed draws others.

Unless the caller gives k, it is the number of documents that look like the target: those whose keys are at or above
the one that all but 1 - KEEP of the target sample reach.

Defined results. A null or empty text, or one of white space only, has log weight 0. Rows without doc_id draw one common noise. Rows that repeat a doc_id draw the same noise and are kept or dropped by their own texts. Of several
labels of a document any that is not good makes it not good; null labels are not good. Without labelled documents every
weight is 0 and every document is kept. Ties at k go to the smaller doc_id. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightline.functions.materialise import materialise
from brightline.llm.common import LOWER_ASCII, SPACE_BYTES, gram_hashes, mix, powers, prefix_hash

#: Bound of the labelled documents that the target model is fitted on.
TARGET_ROWS = 20_000
#: Share of the target sample that is to be kept.
KEEP = 0.985
#: Smoothing by the number of tokens of the n-gram.
SMOOTHING = {1: 3.0, 2: 300.0}
CELLS = 1 << 20
CHUNK = 1 << 10

_CLASS = np.full(256, 2, np.int8)
_CLASS[[c for c in range(256) if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80]] = 1
_CLASS[list(SPACE_BYTES)] = 0


@dataclass
class Resampler:
    """The fitted models: target and raw counts of cells, by n-gram length; ids of the target sample; the cutoff."""

    target: Broadcast
    raw: Broadcast
    ids: Broadcast
    cutoff: float
    seed: int
    temperature: float = 1.0


def tokens(text: bytes) -> np.ndarray:
    """A hash of each run of word bytes or of punctuation, in order."""
    data = np.frombuffer(text.translate(LOWER_ASCII), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    kind = _CLASS[data]
    edges = np.flatnonzero(np.diff(kind)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(data)]))
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    return mix((h[ends] - h[starts]) * down[starts])


def cells(text: bytes | None) -> dict[int, np.ndarray]:
    """Cells of the text's n-grams, by n-gram length."""
    found = tokens(text) if text else np.zeros(0, np.uint64)
    return {n: (mix(gram_hashes(found, n)) % np.uint64(CELLS)).astype(np.int64) for n in SMOOTHING}


def noise(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Standard Gumbel noise that follows from doc_id and seed alone."""
    x = np.array([-1 if i is None else i for i in doc_ids], np.int64).view(np.uint64)
    u = (mix(mix(x + np.uint64(1)) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / float(1 << 53)))


def good_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> list[int]:
    """doc_ids of at most rows labelled documents of good quality that are not toxic, chosen by hash."""
    good = F.coalesce((F.col("quality") >= 1) & (F.col("toxic") <= 0), F.lit(False))
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and(good).alias("good"))
    return [r.doc_id for r in ids.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def count_cells(docs: DataFrame, ids: Broadcast) -> dict[str, dict[int, np.ndarray]]:
    """Counts of every cell over all documents (raw) and over those of the target sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {n: np.zeros(CELLS, np.int64) for n in SMOOTHING}
        target = {n: np.zeros(CELLS, np.int64) for n in SMOOTHING}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, found in cells(text).items():
                    np.add.at(raw[n], found, 1)
                    if doc_id in ids.value:
                        np.add.at(target[n], found, 1)
        yield from _chunks(raw, target)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {n: np.zeros(CELLS, np.int64) for n in SMOOTHING}
        target = {n: np.zeros(CELLS, np.int64) for n in SMOOTHING}
        for batch in batches:
            for n, chunk, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "chunk", "raw", "target")), strict=True):
                at = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
                raw[n][at] += np.frombuffer(a, np.int64)
                target[n][at] += np.frombuffer(b, np.int64)
        yield from _chunks(raw, target)

    schema = "n int, chunk int, raw binary, target binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)
    out = {"raw": {n: np.zeros(CELLS, np.int64) for n in SMOOTHING}, "target": {n: np.zeros(CELLS, np.int64) for n in SMOOTHING}}
    # At most len(SMOOTHING) * CELLS / CHUNK rows reach the driver, whatever the number of documents.
    for r in rows.repartition("n", "chunk").mapInArrow(total, schema).toLocalIterator():
        at = slice(r.chunk * CHUNK, (r.chunk + 1) * CHUNK)
        out["raw"][r.n][at] += np.frombuffer(r.raw, np.int64)
        out["target"][r.n][at] += np.frombuffer(r.target, np.int64)
    return out


def _chunks(raw: dict[int, np.ndarray], target: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for n in SMOOTHING:
        full = np.flatnonzero(raw[n].reshape(-1, CHUNK).any(axis=1))
        yield pa.RecordBatch.from_arrays([
            pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int32()),
            pa.array([raw[n][c * CHUNK : (c + 1) * CHUNK].tobytes() for c in full], pa.binary()),
            pa.array([target[n][c * CHUNK : (c + 1) * CHUNK].tobytes() for c in full], pa.binary()),
        ], names=["n", "chunk", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11, rows: int = TARGET_ROWS, keep: float = KEEP, temperature: float = 1.0) -> Resampler:
    """Counts the models over docs (doc_id, text) with labels (doc_id, quality, toxic), and finds the cutoff."""
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(frozenset(good_ids(labels, rows)))
    counts = count_cells(docs, ids)
    model = Resampler(spark.sparkContext.broadcast(counts["target"]), spark.sparkContext.broadcast(counts["raw"]), ids, float("-inf"), seed, temperature)
    if ids.value:
        wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids.value], "wanted long"))
        sample = docs.select("doc_id", "text").join(wanted, F.col("doc_id").cast("long") == F.col("wanted"), "left_semi")
        # One key a doc_id: no more numbers than ids.value holds, whatever repeats.
        keys = [r.key for r in score(sample, model).groupBy("doc_id").agg(F.min("key").alias("key")).collect()]
        if keys:
            model.cutoff = float(np.quantile(keys, 1 - keep))
    return model


def score(docs: DataFrame, model: Resampler, log_weight: str = "log_weight", key: str = "key") -> DataFrame:
    """docs with two more columns, of names that docs lacks: the log importance weight of the whole text, and that over the temperature plus Gumbel noise."""
    target, raw, ids, seed, temperature = model.target, model.raw, model.ids, model.seed, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = {n: target.value[n].sum() / max(1, raw.value[n].sum()) for n in SMOOTHING}
        ratio = {n: np.log((target.value[n] + a) / (raw.value[n] * share[n] + a)) for n, a in SMOOTHING.items()}
        for batch in batches:
            doc_ids = batch.column("__id").to_pylist()
            weights = np.zeros(len(doc_ids))
            for i, (doc_id, text) in enumerate(zip(doc_ids, batch.column("__text").to_pylist(), strict=True)):
                for n, found in cells(text).items():
                    if doc_id in ids.value:
                        at, own = np.unique(found, return_counts=True)
                        a = SMOOTHING[n]
                        left = np.log((np.maximum(target.value[n][at] - own, 0) + a) / ((raw.value[n][at] - own).clip(0) * share[n] + a))
                        weights[i] += float(left @ own)
                    else:
                        weights[i] += float(ratio[n][found].sum())
            columns = [batch.column(c) for c in batch.schema.names if c not in ("__id", "__text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights), pa.array(weights / temperature + noise(doc_ids, seed))], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(log_weight, T.DoubleType()), T.StructField(key, T.DoubleType())])
    names = schema.fieldNames()
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = inner.select("*", F.col(at["doc_id"]).cast("long").alias("__id"), F.col(at["text"]).cast("binary").alias("__text"))
    return rows.mapInArrow(run, schema)


def resample(docs: DataFrame, model: Resampler, k: int | None = None, log_weight: str = "log_weight", key: str = "key") -> DataFrame:
    """The k rows of docs of largest key, with log weight and key. Scores are written once and read for k and for the choice."""
    scored = materialise(score(docs, model, log_weight, key), "scored")
    if k is None:
        k = scored.where(F.col(key) >= F.lit(model.cutoff)).count()
    return top_k(scored, k, key)


def top_k(scored: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k rows of largest key, ties to the smaller doc_id.

    scored is read several times: give a written table. The k-th largest key is found by histograms of 4096 bins, each within the bin
    that holds it, so that no task sorts all rows and the driver gets only counts; only what ties there is sorted.
    """
    low, high, left = *scored.agg(F.min(key), F.max(key)).first(), k
    if low is None or k <= 0:
        return scored.limit(0)
    bins = 4096
    while low < high:
        width = (high - low) / bins
        if low + width == low:
            break
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        counts = dict(scored.where(F.col(key).between(low, high)).groupBy(at.alias("bin")).count().collect())
        hit = -1
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                hit = b
                break
            left -= counts[b]
        if hit < 0:
            return scored
        inside = scored.where(F.col(key).between(low, high) & (at == hit)).agg(F.min(key), F.max(key)).first()
        low, high = inside
    ties = scored.where(F.col(key) == low).orderBy(F.col("doc_id").asc_nulls_last()).limit(left)
    return scored.where(F.col(key) > low).unionByName(ties)
