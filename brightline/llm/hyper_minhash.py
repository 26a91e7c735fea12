"""MinHash near-dedup by HyperMinHash: near-duplicate components, confirmed on full sets.

A document is the set of its distinct four-word shingles. Two documents link if 100 * |intersection| >= 80 * |union|.

1. Documents with equal sets form a class; from here on a class counts once, whatever its number of copies.
2. A class has REGISTERS buckets, each with a hash function of its own. A bucket keeps the least hash of the set in 16 bits: the count of its leading
   zeros (6 bits) and the MANTISSA bits behind the first one. That is a float of the minimum: small whatever the size of the set.
3. Registers are taken in BANDS of BAND registers, and a band's bytes are a posting. A pair of similarity J shares one with 1 - (1 - J**4)**40: of
   a thousand million pairs at 0.8, the least similarity that links, fewer than one is expected to be missed.
4. Pairs of a posting whose sizes and sketches (parities of the sizes of hash partitions, which bound the symmetric difference from below) allow a link have their similarity estimated from the registers: the share of equal ones less the share that
   unequal minima would give by chance at these sizes, over what is left. Below ESTIMATE they go (eight standard deviations below 0.8).
5. The others are verified once, by intersection of their sets, made anew from the texts. Links give components, in rounds of leaders (rounds.py),
   so that a group of near copies takes work in proportion to its size.

Defined results. Documents with fewer than four words have the whole sequence as one shingle. Null, empty or blank texts have no shingles and
link with nothing: component_id is the doc_id itself. Rows that repeat a doc_id are rows of the result each, and link by their own texts. Rows without
doc_id get their n_shingles, but no link, no component_id, and are not kept. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.common import LOWER_ASCII, gram_hashes, mix, word_hashes
from brightline.llm.rounds import class_labels

SHINGLE_WORDS = 4
BAND, BANDS = 4, 40
REGISTERS = BAND * BANDS
MANTISSA = 10
ESTIMATE = 0.55
#: Longs of a set's sketch: the parities of the sizes of 64 hash partitions each.
SKETCH = [f"s{i}" for i in range(8)]
#: Sets that a task remembers to leave out registers of copies; older ones are forgotten, which costs only bytes.
REMEMBERED = 1 << 16

_seeds = np.random.RandomState(12)
_TIMES = _seeds.randint(0, 2**63, REGISTERS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _seeds.randint(0, 2**63, REGISTERS, dtype=np.int64).astype(np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the shingles of a text, of the whole sequence if it is shorter; sorted."""
    words = word_hashes(np.frombuffer(text.translate(LOWER_ASCII), np.uint8)) if text else np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(SHINGLE_WORDS, len(words)))) if len(words) else words


def set_key(grams: np.ndarray) -> bytes:
    """A 128-bit hash of a set."""
    return b"".join(int(np.add.reduce(mix(grams ^ np.uint64(s)))).to_bytes(8, "big") for s in (len(grams), ~len(grams) & 0xFFFFFFFFFFFFFFFF))


def leading_zeros(x: np.ndarray) -> np.ndarray:
    n, out = x.copy(), np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        small = n < np.uint64(1) << np.uint64(64 - step)
        out += np.where(small, step, 0)
        n = np.where(small, n << np.uint64(step), n)
    return out + (x == 0)


def registers(grams: np.ndarray) -> np.ndarray:
    """The least hash of each bucket as leading zeros and mantissa, in 16 bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(grams), 256):
        np.minimum(least, (grams[a : a + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    zeros = np.minimum(leading_zeros(least), 53)
    behind = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | behind).astype(">u2")


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parities of the sizes of a set's hash partitions, as longs."""
    odd = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _alike(a: str, b: str) -> Column:
    """Whether two sketches allow a link: partitions whose parities differ are no more than the sets' symmetric difference, so no pair that links is ruled out."""
    differ = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH]
    return 9 * sum(differ[1:], differ[0]) <= F.col(f"{a}.n") + F.col(f"{b}.n")


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that unrelated sets of n and m elements have in common.

    A least hash in [x, y) as a share of the hash range has probability (1 - x)**n - (1 - y)**n. Over the 2**MANTISSA cells of one count of zeros that
    product is summed as if it were even within 16 stretches of them.
    """
    out = np.zeros(len(n))
    for zeros in range(54):
        edges = 2.0 ** -(zeros + 1) * (1 + np.arange(17) / 16)
        p, q = (-np.diff(np.exp(k[:, None] * np.log1p(-np.minimum(edges, 1 - 1e-16)))) for k in (n, m))
        out += (p * q).sum(axis=1) * 16 / 2**MANTISSA
    return out


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets of n and m elements by their registers (a row each), corrected for what is equal by chance."""
    by_chance = chance(n, m)
    return ((a == b).mean(axis=1) - by_chance) / (1 - by_chance)


def described(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, digest of its text, n_shingles, key of its set (null if empty), and the registers, which a task may leave out of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            n, keys, found, short = [], [], [], np.zeros((b.num_rows, len(SKETCH)), np.int64)
            for i, text in enumerate(b.column("text").to_pylist()):
                grams = shingle_set(text)
                key = set_key(grams) if len(grams) else None
                n.append(len(grams)), keys.append(key), found.append(None)
                if key is not None and key not in seen:
                    own = registers(grams)
                    found[-1], short[i] = own.tobytes(), sketch(grams)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
            columns = [b.column("doc_id"), b.column("digest"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary()), *(pa.array(x) for x in short.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_shingles", "key", "registers", *SKETCH])

    return _columns(docs).mapInArrow(run, f"doc_id long, digest long, n_shingles long, key binary, registers binary, {', '.join(f'{c} long' for c in SKETCH)}")


def _columns(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def postings(classes: DataFrame) -> DataFrame:
    """key (the class's number), n and grams (bands with their bytes) that another class has as well, of every class that has such."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * BAND) + 1, F.lit(2 * BAND))))
    post = classes.select(F.col("id").alias("key"), F.col("n").cast("int").alias("n"), F.explode(bands).alias("gram"))
    shared = post.groupBy("gram").count().where("count > 1").select("gram")
    return post.join(shared, "gram").groupBy("key").agg(F.first("n").alias("n"), F.collect_list("gram").alias("grams"))


def _sizes(a: str, b: str) -> Column:
    return 5 * F.least(f"{a}.n", f"{b}.n") >= 4 * F.greatest(f"{a}.n", f"{b}.n")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose estimated similarity is ESTIMATE or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
                near = estimated(one, two, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= ESTIMATE
                yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs
    for side in ("b", "a"):
        both = both.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}")), side)
    return both.mapInArrow(run, "a long, b long")


def gram_sets(texts: DataFrame) -> DataFrame:
    """key and shingles of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [shingle_set(text).view(np.int64) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(grams, pa.list_(pa.int64()))], names=["key", "grams"])

    return texts.select("key", "text").mapInArrow(run, "key long, grams array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. texts: key, text."""
    pairs = materialise(pairs, "likely")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = materialise(gram_sets(texts.join(wanted, "key", "left_semi")), "sets")
    both = pairs
    for side in ("b", "a"):
        both = both.join(sets.select(F.col("key").alias(side), F.col("grams").alias(f"grams_{side}")), side)
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    out = materialise(both.where(100 * shared >= 80 * (F.size("grams_a") + F.size("grams_b") - shared)).select("a", "b"), "verified")
    discard(pairs, sets)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (whether it is that one)."""
    spark = docs.sparkSession
    wide = materialise(described(docs), "registers")
    named = wide.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("n_shingles").alias("n"), F.min("digest").alias("digest"), F.min("doc_id").alias("first_id"))
    # A task may have given the registers of a set to a row that takes no part: they are the set's all the same.
    kept = wide.where("registers is not null").groupBy("key").agg(F.first(F.struct("registers", *SKETCH)).alias("of")).select("key", "of.*")
    # Numbers for classes, unique in the table once it is written, are half as wide as keys.
    classes = materialise(named.join(kept, "key").withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = materialise(wide.select("doc_id", "n_shingles", "key"), "rows")
    discard(wide)
    posted = materialise(postings(classes), "posted")
    several = classes.join(posted.select(F.col("key").alias("id")), "id", "left_semi").select("digest", "id")
    texts = _columns(docs).where("doc_id is not null").select("digest", "text").join(several, "digest").groupBy(F.col("id").alias("key")).agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    bands = posted.select("key", "n", (F.lit(BANDS) - F.size("grams")).alias("own"), F.explode("grams").alias("gram"))
    labels = class_labels(bands, _sizes, classes.select(F.col("id").alias("key"), *SKETCH), _alike, lambda pairs: verified(likely(pairs, classes), texts))
    discard(posted, texts)
    labels = spark.createDataFrame([], "node long, root long") if labels is None else labels
    rooted = classes.select("key", "id", "first_id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out = rows.join(rooted.join(least, "root").select("key", "component_id"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
