"""Suffix-array dedup of bytes by two-stage sorting.

Every byte that a string of RUN_BYTES bytes covers which also starts anywhere else is removed: at every place, the first included.

1. Anchors (grams of GRAM_BYTES bytes chosen by content) are counted over all documents; a string that occurs twice has an anchor
   that does. Documents with equal texts are looked at once, with their number.
2. Around each recurring anchor the segment of the strings anchored there is posted; segments that repeat one behind the other, as in texts of a short
   period, are posted once with their number. Equal segments fold into one with a count before the shuffle.
3. All segments of an anchor meet in one shard, whose suffix array is built in two stages: only suffixes smaller than their
   successors are sorted directly, the rest are induced by a scan of the buckets. Common prefixes of adjacent suffixes of
   RUN_BYTES bytes or more, and segments that occur more than once, tell the strings that repeat.
4. These go back to the places of their segments, and the bytes they cover are removed.

An anchor around which more than MOST_SEGMENTS segments differ is posted anew string by string, each with its own hash for
anchor, so that no shard has to hold all that surrounds a very common anchor.

Anchors and segments are told apart by 64-bit hashes (segments within an anchor by another 64 bits).

Defined results. A null text is empty. Rows that repeat a doc_id with the same text are one document, and each has its result. If rows
repeat a doc_id with other texts, the least digest stands for the doc_id and the other rows are left whole. Rows without doc_id take
no part and are left whole. A cut may leave bytes that are no UTF-8; the digest is of the bytes. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.anchors import anchor_of_runs, classes, first_two, once, recurring, scan
from brightline.llm.common import mix, powers, prefix_hash

RUN_BYTES = 200
GRAM_BYTES = 32
#: Bytes of segments whose suffix array is built at once; the segments of one anchor are never parted.
SHARD_BYTES = 4 << 20
#: Differing segments of one anchor above which its strings are posted one by one.
MOST_SEGMENTS = 4_000
#: Bytes of a text that are looked at at once, and of segments that a task holds before it hands them on.
PIECE_BYTES = 1 << 20
FLUSH_BYTES = 8 << 20


def gram_hashes_of(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    k = len(data) - n + 1
    return mix((h[n:] - h[:k]) * down[:k])


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of pieces in which each string of RUN_BYTES bytes begins once."""
    for a in range(0, max(1, len(text) - RUN_BYTES + 1), PIECE_BYTES):
        yield a, text[a : a + PIECE_BYTES + RUN_BYTES - 1]


def look(text: bytes) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Number of bytes, their digest, and of each anchor the first two places and the hash."""
    ats, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, piece in pieces(text):
        grams = gram_hashes_of(np.frombuffer(piece, np.uint8), GRAM_BYTES)
        at = np.unique(anchor_of_runs(grams, RUN_BYTES, GRAM_BYTES))
        at = first_two(at, grams[at])
        ats.append(a + at), found.append(grams[at])
    at, hashes = np.concatenate(ats), np.concatenate(found)
    at, one = np.unique(at, return_index=True)  # an anchor may serve strings of two pieces
    kept = np.searchsorted(at, first_two(at, hashes[one]))
    return len(text), hashlib.sha256(text).digest(), at[kept], hashes[one][kept]


def stretches(piece: bytes, recurs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, start, end, number of equal segments and reach of the segments of a piece whose anchors are among the hashes of recurs.

    Equal segments that follow each other at most RUN_BYTES apart, as in a ruler or any text of a short period, are one stretch: told by its first segment,
    how many there are, and how far the last one starts behind it. The strings of a stretch cover all bytes between.
    """
    data = np.frombuffer(piece, np.uint8)
    grams = gram_hashes_of(data, GRAM_BYTES)
    of = anchor_of_runs(grams, RUN_BYTES, GRAM_BYTES)
    at, start = np.unique(of, return_index=True)
    end = np.append(start[1:], len(of))  # of never falls
    own = np.isin(grams[at], recurs)
    anchor, start, end = grams[at][own], start[own], end[own] + RUN_BYTES - 1
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    same = mix((h[end] - h[start]) * down[start]) ^ (end - start).astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (same[1:] != same[:-1]) | (np.diff(start) > RUN_BYTES)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], start[first], end[first], last - first + 1, start[last] - start[first] if len(first) else first


def posted_segments(texts: DataFrame) -> DataFrame:
    """anchor, doc_id, start, segment, n and reach: the strings that have a recurring anchor, from the first one's start to the last one's end, by stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
        names = ["anchor", "doc_id", "start", "segment", "n", "reach"]
        out: list[list] = [[] for _ in names]
        waiting = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text, sha, recurs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sha", "recurs")), strict=True):
                if not text or hashlib.sha256(text).digest() != sha:
                    continue
                recurs = np.array(recurs, np.int64).view(np.uint64)
                for a, piece in pieces(text):
                    anchor, start, end, n, reach = stretches(piece, recurs)
                    segments = [piece[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
                    for column, values in zip(out, (anchor.view(np.int64).tolist(), [doc_id] * len(n), (a + start).tolist(), segments, n.tolist(), reach.tolist()), strict=True):
                        column.extend(values)
                    waiting += sum(map(len, segments)) + 100 * len(segments)
                    if waiting > FLUSH_BYTES:
                        yield flush()
                        out, waiting = [[] for _ in names], 0
        if out[0]:
            yield flush()

    columns = texts.select("doc_id", F.col("text").cast("binary").alias("text"), "sha", "recurs")
    return columns.mapInArrow(run, "anchor long, doc_id long, start int, segment binary, n long, reach int")


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the suffix that starts one byte later; the last one isn't."""
    step = np.diff(data.astype(np.int16))
    decided = np.flatnonzero(step)
    at = np.searchsorted(decided, np.arange(len(step)))
    out = np.zeros(len(data), bool)
    inside = at < len(decided)
    out[:-1][inside] = step[decided[at[inside]]] > 0
    return out


def two_stage_order(data: bytes, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes of data in the order of their first RUN_BYTES bytes.

    wanted: a mask. A wanted suffix that isn't smaller than its successor needs that successor, and so on to the next
    suffix that is; these are sorted along.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    small = smaller_than_next(text)
    # Suffixes from a wanted one up to the next small one are needed.
    nearest = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    start = np.flatnonzero(wanted)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, np.minimum(nearest[start] + 1, n), -1)
    needed = np.cumsum(edges)[:n] > 0
    # First stage: direct sorting of the small suffixes.
    direct = np.array(sorted(np.flatnonzero(needed & small).tolist(), key=lambda i: data[i : i + RUN_BYTES]), np.int64)
    bounds = np.searchsorted(text[direct], np.arange(257))
    # Second stage: a scan of the buckets in order puts each other suffix behind those that its successor outranks.
    induced = needed & ~small
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and induced[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        bucket, front = [], np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        while len(front):
            bucket.append(front)
            before = _induce(front, text, induced, pending, c)
            front = before
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        _induce(bucket[-1], text, induced, pending, c)
        order.extend(bucket)
    out = np.concatenate(order) if order else np.zeros(0, np.int64)
    return out[wanted[out]]


def _induce(front: np.ndarray, text: np.ndarray, induced: np.ndarray, pending: list[list[np.ndarray]], c: int) -> np.ndarray:
    """Deals the suffixes one byte before those of front to the buckets of their first bytes; returns those of bucket c itself."""
    before = front[front > 0] - 1
    before = before[induced[before]]
    first = text[before]
    before, first = before[first >= c], first[first >= c]
    place = np.argsort(first, kind="stable")
    before, first = before[place], first[place]
    own = before[:0]
    cuts = np.flatnonzero(np.diff(first)) + 1
    for part in np.split(before, cuts) if len(before) else []:
        b = text[part[0]]
        if b == c:
            own = part
        else:
            pending[b].append(part)
    return own


def equal_to_previous(data: bytes, order: np.ndarray) -> np.ndarray:
    """For each suffix of the order, whether it has a common prefix of RUN_BYTES bytes or more with the one before."""
    text = np.frombuffer(data + bytes(8), np.uint8)
    same = np.zeros(len(order), bool)
    rows = np.arange(1, len(order))
    for depth in range(0, RUN_BYTES, 8):
        a, b = order[rows] + depth, order[rows - 1] + depth
        keep = np.ones(len(rows), bool)
        for i in range(8):
            keep &= text[a + i] == text[b + i]
        rows = rows[keep]
        if not len(rows):
            return same
    same[rows] = True
    return same


def repeated_strings(segments: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each of distinct segments, the starts of its strings that occur again, in it or in another, or as the segment does."""
    lengths = np.array([len(s) for s in segments])
    offset = np.concatenate(([0], np.cumsum(lengths)))
    data = b"".join(segments)
    wanted = np.zeros(len(data) + 1, np.int64)
    np.add.at(wanted, offset[:-1], 1)
    np.add.at(wanted, offset[1:] - RUN_BYTES + 1, -1)
    order = two_stage_order(data, np.cumsum(wanted)[:-1] > 0)
    same = equal_to_previous(data, order)
    again = np.zeros(len(data), bool)
    hit = np.flatnonzero(same)
    again[order[hit]] = again[order[hit - 1]] = True
    out = []
    for k, (start, length) in enumerate(zip(offset[:-1].tolist(), lengths.tolist(), strict=True)):
        strings = length - RUN_BYTES + 1
        out.append(np.arange(strings) if counts[k] > 1 else np.flatnonzero(again[start : start + strings]))
    return out


def spans(starts: np.ndarray) -> list[dict[str, int]]:
    """Runs of consecutive starts as first and last."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.concatenate(([starts[0]], starts[cuts + 1])), np.concatenate((starts[cuts], [starts[-1]]))
    return [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)]


def repeats(segments: DataFrame) -> DataFrame:
    """anchor, mark and spans of the segments with strings that repeat. segments: anchor, mark, segment, n; distinct."""

    def flush(shard: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        found = [spans(s) for s in repeated_strings([s for _, _, s, _ in shard], [n for *_, n in shard])]
        rows = [(a, m, f) for (a, m, _, _), f in zip(shard, found, strict=True) if f]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), kind))], names=["anchor", "mark", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "mark", "segment", "n")), strict=True):
                if size >= SHARD_BYTES and row[0] != last:
                    yield flush(shard)
                    shard, size = [], 0
                shard.append(row)
                size += len(row[2])
                last = row[0]
        if shard:
            yield flush(shard)

    dealt = segments.select("anchor", "mark", "segment", "n").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, mark long, spans array<struct<first:int,last:int>>")


def without_strings(texts: DataFrame) -> DataFrame:
    """doc_id, sha, n_removed, n_spans, kept and kept_sha256 of texts (doc_id, text, strings): strings are spans of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, strings in zip(batch.column("text").to_pylist(), batch.column("strings").to_pylist(), strict=True):
                text = text or b""
                kept, at, removed, n = [], 0, 0, 0
                for first, last in sorted((s["first"], s["last"]) for s in strings):
                    end = last + RUN_BYTES
                    if end > len(text):
                        continue
                    if first > at or (first == at == 0 and not n):
                        kept.append(text[at:first])
                        removed, n, at = removed + end - first, n + 1, end
                    elif end > at:
                        removed, at = removed + end - at, end
                kept.append(text[at:])
                left = b"".join(kept)
                for column, value in zip(out, (removed, n, left, hashlib.sha256(left).hexdigest(), hashlib.sha256(text).digest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_removed", "n_spans", "kept", "kept_sha256", "sha"])

    columns = texts.select("doc_id", F.col("text").cast("binary").alias("text"), "strings")
    return columns.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept binary, kept_sha256 string, sha binary")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = scan(docs, look, "grams")
    one = materialise(classes(scanned), "classes")
    again = recurring(scanned, one)
    wide, scanned = scanned, materialise(scanned.select("doc_id", "sha", "size"), "sizes")
    discard(wide)
    posted = posted_segments(once(texts, scanned).join(again, "doc_id")).withColumn("mark", F.xxhash64("segment"))
    posted = materialise(posted, "segments")
    discard(again)
    distinct = posted.groupBy("anchor", "mark", "segment").agg(F.sum("n").alias("n"))
    crowded = posted.groupBy("anchor").agg(F.approx_count_distinct("mark", 0.02).alias("marks")).where(F.col("marks") > MOST_SEGMENTS).select("anchor")
    crowded = materialise(crowded, "crowded")
    if crowded.isEmpty():
        places, found = posted.drop("segment", "n"), repeats(distinct)
    else:
        places, found = _with_crowded(posted, distinct, crowded)
    strings = places.join(materialise(found, "repeats"), ["anchor", "mark"]).select("doc_id", "start", "reach", F.explode("spans").alias("s"))
    span = F.struct((F.col("start") + F.col("s.first")).alias("first"), (F.col("start") + F.col("reach") + F.col("s.last")).alias("last"))
    strings = strings.groupBy("doc_id").agg(F.collect_list(span).alias("strings"))
    strings = materialise(strings, "strings")
    discard(posted)
    cut = without_strings(texts.join(strings, "doc_id")).drop("kept")
    rows = scanned.select("doc_id", "sha", F.col("size").alias("n_bytes"))
    mine = scanned.where("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("sha"))
    mine = mine.join(one, "sha").select("doc_id", "sha", (F.col("copies") > 1).alias("copied"))
    cut = cut.join(mine.where("not copied").select("doc_id", "sha"), ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id", "sha"])
    out = rows.join(mine.join(cut, ["doc_id", "sha"], "left"), ["doc_id", "sha"], "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= RUN_BYTES)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def _with_crowded(posted: DataFrame, distinct: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places and repeats where the strings around crowded anchors are posted one by one."""
    calm = posted.join(crowded, "anchor", "left_anti").drop("segment", "n")
    offset = F.explode(F.sequence(F.lit(0), F.octet_length("segment") - RUN_BYTES)).alias("o")
    cut = posted.join(crowded, "anchor").select("doc_id", "start", "segment", "n", "reach", offset)
    cut = cut.select("doc_id", "n", "reach", (F.col("start") + F.col("o")).alias("start"), F.substring("segment", F.col("o") + 1, F.lit(RUN_BYTES)).alias("segment"))
    cut = cut.withColumn("anchor", F.xxhash64("segment")).withColumn("mark", F.xxhash64(F.lit(1), "segment"))
    strings = cut.groupBy("anchor", "mark", "segment").agg(F.sum("n").alias("n"))
    found = repeats(distinct.join(crowded, "anchor", "left_anti").unionByName(strings))
    return calm.unionByName(cut.select("anchor", "doc_id", "start", "mark", "reach")), found
