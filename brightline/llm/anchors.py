"""Where texts may repeat: anchors, chosen by content alone.

Of every run of `window` units (words or bytes) the gram of `gram` units with the least hash is the anchor, the leftmost of equals.
Equal runs have equal anchors at equal places, so a run that occurs twice has an anchor that occurs twice. Only
about 2 / (window - gram) of the grams are anchors: a count of these over all documents, not of every run, finds each
place that needs a closer look. Nothing is lost: a run whose anchor occurs once occurs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import materialise


def anchor_of_runs(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each run of `window` units, by its start, the place of its anchor; grams has a hash for each start of a gram."""
    width = window - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    if width <= 32:
        return np.arange(len(grams) - width + 1) + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    return _sliding_argmin(grams, width)


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least value in each run of width values, by doubling: runs of 2, 4, 8 ... values."""
    at, span = np.arange(len(values)), 1
    while 2 * span <= width:
        left, right = at[:-span], at[span:]
        at = np.where(values[right] < values[left], right, left)
        span *= 2
    rest = width - span
    if rest:
        left, right = at[:-rest], at[rest:]
        at = np.where(values[right] < values[left], right, left)
    return at


def first_two(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of places (in order) with hashes, the first two of each hash, in order."""
    order = np.argsort(hashes, kind="stable")
    third = np.zeros(len(at), bool)
    third[2:] = hashes[order[2:]] == hashes[order[:-2]]
    return np.sort(at[order[~third]])


def scan(docs: DataFrame, look: Callable[[bytes], tuple[int, bytes, np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """A written table of doc_id, size, sha (of the whole content), at and anchor (places and hashes of the anchors).

    look takes a text and gives its size, the digest, the distinct places of anchors (two of each are enough to tell that it recurs) and their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, ats, anchors = [], [], [], []
            for text in batch.column("text").to_pylist():
                size, sha, at, anchor = look(text or b"")
                sizes.append(size), shas.append(sha), ats.append(at.astype(np.int32)), anchors.append(anchor.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()),
                pa.array(ats, pa.list_(pa.int32())), pa.array(anchors, pa.list_(pa.int64())),
            ], names=["doc_id", "size", "sha", "at", "anchor"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return materialise(columns.mapInArrow(run, "doc_id long, size long, sha binary, at array<int>, anchor array<long>"), name)


def classes(scanned: DataFrame) -> DataFrame:
    """Per content: sha, the smallest doc_id that has it (first_id) and the number of documents (copies); a doc_id counts with one content."""
    own = scanned.where("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("sha"))
    return own.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def recurring(scanned: DataFrame, one: DataFrame) -> DataFrame:
    """A written table of doc_id, sha, at and recurs: the places and hashes of anchors that occur more than once, of one document per content.

    Counting combines before the shuffle and the places are joined to the counts, so that an anchor that a large
    share of the documents hold is no single task's work.
    """
    first = scanned.where("size(at) > 0").join(one.select("sha", "first_id"), "sha").where("doc_id = first_id")
    places = first.select("doc_id", F.inline(F.arrays_zip("at", "anchor")))
    often = places.groupBy("anchor").count().where("count > 1").select("anchor")
    again = places.join(often, "anchor").groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("at"), F.collect_set("anchor").alias("recurs"))
    return materialise(again.join(one.select(F.col("first_id").alias("doc_id"), "sha"), "doc_id"), "recurring")


def once(texts: DataFrame, scanned: DataFrame) -> DataFrame:
    """texts (doc_id, text) with each text of a doc_id once."""
    repeated = scanned.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():
        return texts
    return texts.join(repeated, "doc_id", "left_anti").unionByName(texts.join(repeated, "doc_id").dropDuplicates(["doc_id", "text"]))
