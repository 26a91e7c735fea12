"""N-gram Jaccard join: exact near-duplicate components by rare-first prefix filtering.

A document is the set of its distinct five-word shingles. Two documents link if 100 * |intersection| >= 80 * |union|.

1. Words are counted over all documents in CELLS cells. A shingle can't be in more documents than its rarest word, so
   shingles are put in the order of that count (ties by hash): a global order, rare first, without a shuffle of all shingles.
2. Documents with equal sets form a class; from here on a class counts once, whatever its number of copies.
3. Sets that link share a shingle among their first n - ceil(0.8 n) + 1. These prefixes are posted by shingle and counted;
   those that one class's prefix alone has go. The positional filter takes the place in the whole prefix.
4. Candidates pass the length and positional filters within the join, and the suffix filter (parities of the sizes of hash partitions bound the
   symmetric difference from below); each is verified once, by intersection of the sets.
5. Links give components, in rounds of leaders (rounds.py). A pair within a component needs no verifying, so a group of near copies takes
   work in proportion to its size, and no link between components is lost.

Defined results. Documents with fewer than five words have the whole sequence as one shingle. Null, empty or blank texts have no
shingles and link with nothing: component_id is the doc_id itself. Rows that repeat a doc_id are rows of the result each, and
link by their own texts. Rows without doc_id get their n_shingles, but no link and no component_id. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.common import LOWER_ASCII, gram_hashes, mix, word_hashes
from brightline.llm.rounds import class_labels

SHINGLE_WORDS = 5
#: Cells of word counts: a fixed size, 8 MB, for any number of documents. Cells that words share only blur the order.
CELLS = 1 << 20
CHUNK = 1 << 10
#: Words of 64 partition parities of the suffix filter.
BIT_WORDS = 8
BITS = [f"b{i}" for i in range(BIT_WORDS)]


def words_of(text: bytes | None) -> np.ndarray:
    return word_hashes(np.frombuffer(text.translate(LOWER_ASCII), np.uint8)) if text else np.zeros(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in order; of the whole sequence if it is shorter; none without words."""
    return gram_hashes(words, min(SHINGLE_WORDS, len(words))) if len(words) else words


def prefix_length(n: int) -> int:
    """Shingles of a set of n among which a set that links has one in common, in any one order of all shingles."""
    return n - (4 * n + 4) // 5 + 1


def cell(words: np.ndarray) -> np.ndarray:
    return (mix(words) % np.uint64(CELLS)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of words over all documents, by cell. CELLS numbers reach the driver, summed on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                waiting.append(cell(words_of(text)))
                n += len(waiting[-1])
                if n > 1 << 22:
                    total += np.bincount(np.concatenate(waiting), minlength=CELLS)
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=CELLS)
        yield _chunks(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(counts, np.int64)
        yield _chunks(total)

    schema = "chunk int, counts binary"
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros(CELLS, np.int64)
    for r in rows.toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(r.counts, np.int64)
    return out


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    full = np.flatnonzero(total.reshape(-1, CHUNK).any(axis=1))
    blobs = [total[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])


def rare_first(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct shingles, those first whose rarest word is rarest, ties by hash."""
    grams = shingles(words)
    if not len(grams):
        return grams
    per_word = counts[cell(words)]
    bound = per_word[: len(grams)].copy()
    for i in range(1, min(SHINGLE_WORDS, len(words))):
        np.minimum(bound, per_word[i : i + len(grams)], out=bound)
    grams, first = np.unique(grams, return_index=True)
    return grams[np.lexsort((grams, bound[first]))]


def set_key(grams: np.ndarray) -> int:
    """A 64-bit hash of a set, whatever the order of its members."""
    both = np.array([np.add.reduce(mix(grams)), np.bitwise_xor.reduce(mix(~grams)), len(grams)], np.uint64)
    return int(gram_hashes(mix(both), 3).view(np.int64)[0])


def described(docs: DataFrame, counts: Broadcast) -> DataFrame:
    """Of each document: doc_id, digest (of id and text), n_shingles, key of its set (null if empty), bits, and the prefix in
    rare-first order. Of documents of one task that have equal sets only the first has the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, keys, bits, prefixes = [], [], np.zeros((batch.num_rows, BIT_WORDS), np.int64), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                grams = rare_first(words_of(text), counts.value)
                n.append(len(grams))
                if not len(grams):
                    keys.append(None), prefixes.append(None)
                    continue
                keys.append(set_key(grams))
                odd = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
                bits[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                prefixes.append(None if keys[-1] in seen else grams[: prefix_length(len(grams))].view(np.int64))
                seen.add(keys[-1])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()),
                *(pa.array(bits[:, w]) for w in range(BIT_WORDS)), pa.array(prefixes, pa.list_(pa.int64())),
            ], names=["doc_id", "digest", "n_shingles", "key", *BITS, "prefix"])

    schema = f"doc_id long, digest long, n_shingles long, key long, {', '.join(f'{b} long' for b in BITS)}, prefix array<long>"
    return _columns(docs).mapInArrow(run, schema)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("digest"), F.col("text").cast("binary").alias("text")
    )


def gram_sets(texts: DataFrame) -> DataFrame:
    """key and the distinct shingles of rows (key, text), where they are the set of that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(words_of(text))) for text in batch.column("text").to_pylist()]
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            grams = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), keys, grams], names=["key", "own", "grams"])

    found = texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, own long, grams array<long>")
    return found.where("key = own").drop("own")


def _near(a: str, b: str) -> Column:
    """Length filter and positional filter of a shared prefix shingle of the rows a and b."""
    n_a, n_b, at_a, at_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * F.least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b))


def _apart(a: str, b: str) -> Column:
    """Hash partitions whose sizes differ in parity: no more than the sets' symmetric difference (suffix filter)."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITS[1:]), F.bit_count(F.col(f"{a}.{BITS[0]}").bitwiseXOR(F.col(f"{b}.{BITS[0]}"))))


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that pass the suffix filter."""
    x, y = classes.alias("x"), classes.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key"))
    return both.where(9 * _apart("x", "y") <= F.col("x.n") + F.col("y.n")).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs, of a written table that goes then, whose sets, made anew from their classes' texts (key, text), reach the similarity."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = materialise(gram_sets(texts.join(wanted, "key", "left_semi")), "sets")
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("grams_b")), "b")
    both = both.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("grams_a")), "a")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    out = materialise(both.where(100 * shared >= 80 * (F.size("grams_a") + F.size("grams_b") - shared)).select("a", "b"), "verified")
    discard(pairs, sets)
    return out


def labelled(docs: DataFrame, named_only: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, n_shingles, key) of docs, and root of the component of each key that has one.

    named_only: rows without doc_id take no part.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(word_counts(docs))
    wide = materialise(described(docs, counts), "shingles")
    part = wide.where("key is not null and doc_id is not null") if named_only else wide.where("key is not null")
    # A task may have given the prefix to a row that takes no part: such rows still stand for their set.
    post = wide.where("prefix is not null").select(F.posexplode("prefix").alias("at", "gram"), "key")
    shared = post.groupBy("gram").count().where("count > 1").select("gram")
    found = post.join(shared, "gram").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "gram"))).alias("live"))
    one = part.groupBy("key").agg(F.first("n_shingles").alias("n"), F.min("digest").alias("digest"), *(F.first(b).alias(b) for b in BITS))
    found = materialise(found.join(one, "key"), "classes")
    rows = materialise(wide.select("doc_id", "digest", "n_shingles", "key"), "rows")
    discard(wide)
    counts.destroy()
    # Shingles that no other prefix has may stand in another set past its prefix: only a shingle's own place bounds what can follow.
    own = F.expr("n - (4 * n + 4) div 5 + 1 - size(live)")
    posted = found.select("key", "n", own.cast("int").alias("own"), F.explode("live").alias("of"))
    posted = posted.select("of.gram", "key", "n", "own", "of.at")
    short = found.drop("live")
    # The texts that rounds may look at, once, a row for each class: small beside all texts, and packed better than sets of hashes.
    texts = _columns(docs).select("digest", "text").join(short.select("digest", "key"), "digest").groupBy("key").agg(F.first("text").alias("text"))
    posted, texts = materialise(posted, "posted"), materialise(texts, "texts")
    bits = short.drop("digest")
    labels = class_labels(posted, _near, bits.drop("n"), lambda a, b: 9 * _apart(a, b) <= F.col(f"{a}.n") + F.col(f"{b}.n"), lambda pairs: linked(materialise(close(pairs, bits), "close"), texts))
    discard(posted, texts)
    if labels is None:
        labels = spark.createDataFrame([], "node long, root long")
    return rows, labels.withColumnRenamed("node", "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    rows, labels = labelled(docs, named_only=True)
    one = rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    named = one.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    alone = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (rows without one last), ties to the least digest of the text.

    Rows are judged by their own texts, whatever others have their doc_id. Rows without shingles stay. Columns stay as they are.
    """
    rows, labels = labelled(docs, named_only=False)
    full = rows.where("key is not null").join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    best = full.groupBy("root").agg(F.min_by(F.struct("doc_id", "digest"), order).alias("best"), F.count("*").alias("members"))
    several = best.where("members > 1").select("root", "best")
    judged = full.join(several, "root").select("doc_id", "digest", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("stays"))
    # Equal rows, by id and text, of one component: more than one only where a row is repeated.
    judged = judged.groupBy("doc_id", "digest").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("copies"))
    judged = materialise(judged.where("not stays or copies > 1"), "judged")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    inner = inner.withColumn("id", at["doc_id"].cast("long")).withColumn("of", F.xxhash64(at["text"].cast("binary")))
    same = inner["id"].eqNullSafe(judged["doc_id"]) & (inner["of"] == judged["digest"])
    out = inner.join(judged, same, "left_anti")
    again = judged.where("stays")
    if not again.isEmpty():
        out = out.unionByName(inner.join(again, inner["id"].eqNullSafe(again["doc_id"]) & (inner["of"] == again["digest"]), "left_semi").dropDuplicates(["id", "of"]))
    return out.select(*[c.alias(name) for name, c in at.items()])
