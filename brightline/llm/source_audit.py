"""Source divergence audit: how the words of each source differ from other sources of its language, and from the language.

1. A byte-level tokenizer: Arrow's concatenated UTF-8 buffer of a batch of texts goes through a numpy lookup table, whose edges are the
   terms' boundaries. xxhash groups the slices; each slice's bytes are compared with the first of its group, and a group with two
   spellings is taken apart. Documents by terms are a sparse matrix (CSR), reduced to counts by source before anything is shuffled.
2. Counts are added up by language, source and term. A language keeps the terms that MIN_DOCS of its documents have.
3. Kept terms are dealt to blocks of some BLOCK_ROWS counts each by hash. A block is a CSR matrix of sources by terms; reduceat sums divergences
   over each row. Of a pair of sources only the terms that one of them has are looked at; the others have all the same value, times their number.
   A block gives one partial sum a pair and at most TOP terms a source.

All arithmetic is on whole numbers: p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)) and f(p, q) = floor((p - q)**2 / (p + q)), exact while
N + 2 * V is below 9 * 10**15.

Defined results. Null text, lang and source are empty strings. Terms are runs of letters A-Z, lower-cased, and bytes from 0x80. Repeated rows are
documents each. A language without kept terms has value 0 for every pair and no terms. A source that is alone in its language has no pairs.
Other columns play no part. An empty table gives no rows. One task holds one text, and of a block at most its counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.common import LOWER_ASCII

MIN_DOCS = 10
TOP = 10
SCALE_STEPS = (1000, 1000, 1000)
BLOCK_ROWS = 1 << 17
#: Bytes of text that are tokenized at once; a longer text goes by itself.
CHUNK_BYTES = 4 << 20

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWERED = np.frombuffer(LOWER_ASCII, np.uint8)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that lie one after the other; offsets: where each begins, and the end of the last."""
    inside = IS_TERM[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Of each slice the number of its group, and of each group its first slice: groups of equal digests whose bytes are equal."""
    whole = data.tobytes()
    hashes = np.fromiter((digest(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    same = sizes == sizes[first][group]
    # Byte by byte beside the group's first slice, for the slices of its length.
    s, n = np.flatnonzero(same), sizes[same]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differs = data[np.repeat(starts[s], n) + within] != data[np.repeat(starts[first[group[s]]], n) + within]
    same[np.repeat(s, n)[differs]] = False
    if not same.all():
        seen: dict[bytes, int] = {}
        group = np.fromiter((seen.setdefault(whole[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        first = np.unique(group, return_index=True)[1]
    return group.astype(np.int64), first


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches of values from each bound to the next; the last bound is the end. Empty stretches are 0."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def counts_of(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Owner, term, occurrences and documents of each owner and term. owner: of each text."""
    data = LOWERED[data]
    starts, ends = boundaries(data, offsets)
    group, first = grouped(data, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    width = max(1, len(first))
    # CSR of documents by terms: cells in order of document and term, with their occurrences.
    cells, n = np.unique(doc * width + group, return_counts=True)
    of = owner[cells // width] * width + cells % width
    order = np.argsort(of, kind="stable")
    keys, at = np.unique(of[order], return_index=True)
    bounds = np.append(at, len(order))
    whole = data.tobytes()
    terms = pa.array([whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary())
    return keys // width, terms.take(pa.array(keys % width)), sums(n[order], bounds), np.diff(bounds)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of each source's terms; a row without term for each source, also without terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            number: dict[tuple[str, str], int] = {}
            keys = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)
            owner = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(text))
            names = list(number)
            langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            zero = pa.array([0] * len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(names), pa.binary()), zero, zero], names=["lang", "source", "term", "n", "docs"])
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
                own, terms, n, having = counts_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], owner[at:to])
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), terms, pa.array(n), pa.array(having)], names=["lang", "source", "term", "n", "docs"])
                at = to

    columns = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = columns.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n of kept terms, with lead, true for one row of each term; and a row without term for each source."""
    whole = Window.partitionBy("lang", "term")
    rows = term_counts(docs).withColumn("in_docs", F.sum("docs").over(whole)).withColumn("lead", F.col("term").isNotNull() & (F.min("source").over(whole) == F.col("source")))
    return rows.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "lead")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * count / total) for count up to total, digit by digit of a thousand."""
    out, rest = np.zeros_like(count), count.copy()
    for step in SCALE_STEPS:
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PART = "lang string, source string, part string, item binary, value long"


def block_part(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """The part that a block of a language's terms has in the result. counts: source, term, n. groups: lang, source, total, lang_total, v of all its sources."""
    groups = groups.sort_by("source")
    names, total = groups["source"].combine_chunks(), groups["total"].to_numpy()
    v, lang_total = groups["v"][0].as_py(), groups["lang_total"][0].as_py()
    s = len(names)
    spelled = counts["term"].combine_chunks().dictionary_encode()
    terms = spelled.dictionary.take(pc.array_sort_indices(spelled.dictionary)) if len(spelled) else spelled.dictionary
    column = pc.index_in(counts["term"].combine_chunks(), terms).to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.index_in(counts["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], counts["n"].to_numpy()[order]
    t = len(terms)
    indptr = np.searchsorted(row, np.arange(s + 1))
    whole = np.maximum(total + 2 * v, 1)
    p, none = share(n + 2, whole[row]), share(np.full(s, 2), np.maximum(whole, 2))
    out: list[tuple[pa.Array, ...]] = []
    # Terms that a source has more than its language: the first TOP of the block, by value, then by term.
    by_term = np.argsort(column, kind="stable")
    in_lang = sums(n[by_term], np.searchsorted(column[by_term], np.arange(t + 1)))
    q = share(in_lang + 2, max(lang_total + 2 * v, 1))[column]
    more = np.flatnonzero((n > 0) & (p > q))
    value = divergence(p[more], q[more])
    best = np.lexsort((column[more], -value, row[more]))
    place = np.arange(len(best)) - np.searchsorted(row[more][best], row[more][best])
    best = best[place < TOP]
    picked = more[best]
    lang = groups["lang"][0].as_py()
    out.append((names.take(pa.array(row[picked])), "term", terms.take(pa.array(column[picked])), value[best]))
    # Pairs: dense row a beside the sparse rows after it.
    for a in range(s - 1):
        mine = slice(indptr[a], indptr[a + 1])
        dense = np.full(t, none[a])
        dense[column[mine]] = p[mine]
        rest = slice(indptr[a + 1], len(row))
        here = dense[column[rest]]
        change = divergence(here, p[rest]) - divergence(here, none[row[rest]])
        found = sums(change, indptr[a + 1 :] - indptr[a + 1])
        for b in range(a + 1, s):
            found[b - a - 1] += divergence(p[mine], none[b]).sum() + (t - (indptr[a + 1] - indptr[a])) * divergence(none[a], none[b])
        out.append((names.take(pa.array(np.full(s - a - 1, a))), "pair", names.slice(a + 1).cast(pa.binary()), found))
    tables = [
        pa.table([pa.array([lang] * len(x), pa.string()), x, pa.array([part] * len(x), pa.string()), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])
        for x, part, item, value in out
    ]
    return pa.concat_tables(tables)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language, part `term` the TOP terms of the source."""
    kept = materialise(kept_counts(docs, min_docs), "kept-terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("v"))
    of_lang = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"))
    groups = materialise(own.drop("v").join(of_lang, "lang"), "sources")
    terms = kept.where("term is not null")
    blocks = max(1, math.ceil(terms.count() / BLOCK_ROWS))
    left = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).select("lang", "block", "source", "term", "n")
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(block_part, PART)
    parts = materialise(parts, "divergences")
    discard(kept, groups)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item", "part").agg(F.sum("value").alias("value"))
    other = pairs.select("lang", F.col("item").cast("string").alias("source"), F.col("source").cast("binary").alias("item"), "part", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = pairs.unionByName(other).withColumn("rank", rank)
    out = out.unionByName(parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP))
    return out.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
