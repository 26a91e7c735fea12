"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A table of shifts, keyed by blocks of words,
tells how far the search may skip; where it may not skip, the block's bucket holds the windows
that end with it, and comparing the words confirms the occurrence.

Defined results. A null or empty text has no words: n_words and n_hit are 0, n_items is 0 and the
document is not contaminated. Items without words have no window. Items with equal texts are both
reported; rows that repeat an item_id count as one item; a null item_id is written as "null".
Repeated document rows are judged each by itself. Texts are searched whole, however long. An empty
benchmark leaves every document clean. Other columns of either table play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.common import ITEM_WORDS

WINDOW_WORDS = 13
BLOCK_WORDS = 3
#: Bytes of benchmark text that one search holds in memory, in tables of some 130 bytes a byte; a larger benchmark is searched in several passes.
SHARD_BYTES = 2 << 20


def item_words(text: bytes | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of digits, letters and bytes above 127."""
    return text.translate(ITEM_WORDS).split() if text else []


class WuManber:
    """Finds windows of one common length in sequences of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key, skip = window[end - self.block : end], length - end
                if skip < self.shift.get(key, length):
                    self.shift[key] = skip
            self.buckets[window[-self.block :]][window] = items
        self.longest = length - self.block + 1

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Starts of the windows that occur in words, with the items that hold them."""
        shift, longest, block, length = self.shift.get, self.longest, self.block, self.length
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            skip = shift(key, longest)
            if skip:
                end += skip
                continue
            items = self.buckets[key].get(tuple(words[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


def searchers(items: list[tuple[str, bytes | None]], window: int) -> list[WuManber]:
    """One search for each length of window: the full length, and that of each shorter item."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = item_words(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            by_length[length][tuple(words[i : i + length])].add(item_id)
    return [WuManber(windows, length) for length, windows in by_length.items()]


def find_items(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns `carry` of each document with three more: n_words, spans (those that benchmark windows cover:
    maximal, sorted, each of start and end word) and items (those found).

    docs: text and carry. benchmark: item_id, text. The benchmark is read to the driver by shards of about
    shard_bytes; every shard is one pass over the documents, without a shuffle.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text")
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    kind = "array<struct<start:int,end:int>>"
    found = [F.lit(None).cast(t).alias(n) for n, t in (("n_words", "long"), ("spans", kind), ("items", "array<string>"))]
    out = docs.select(F.col("text").cast("binary").alias("searched"), *found, *[F.col(c) for c in carry])
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        patterns = [(r.item_id, bytes(r.text)) for r in part.toLocalIterator()]
        before, out = out, out.mapInArrow(_pass_over(patterns, window, last=k == shards - 1), out.schema)
        if k < shards - 1:  # so that the driver and the tasks hold one shard at a time
            out = materialise(out, "pass")
            if k:
                discard(before)
    return out.drop("searched")


def _pass_over(patterns: list[tuple[str, bytes]], window: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searchers(patterns, window)
        for batch in batches:
            texts, old_spans, old_items = (batch.column(i).to_pylist() for i in (0, 2, 3))
            n_words, spans, items = [], [], []
            for text, before, named in zip(texts, old_spans, old_items, strict=True):
                words = item_words(text)
                got, names = [(s["start"], s["end"]) for s in before or ()], set(named or ())
                for search in found:
                    for start, of in search.find(words):
                        got.append((start, start + search.length))
                        names |= of
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged(got)])
                items.append(sorted(names))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [
                pa.array([None] * len(texts) if last else texts, pa.binary()), pa.array(n_words, pa.int64()),
                pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), *batch.columns[4:],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal spans that the given ones cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def judge(found: DataFrame, min_share: float = 0.05) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: at least one word hit, and at least min_share of the words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.withColumns({
        "n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("items")), 256),
    })
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(round(1 / min_share)) >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (text and any other columns) that are not contaminated, as they are."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    carry = inner.columns
    found = judge(find_items(inner.withColumn("text", F.col(f"c{names.index('text')}")), benchmark, carry))
    return found.where(~F.col("contaminated")).select(*carry).toDF(*names)
