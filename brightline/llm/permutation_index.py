"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, a bounded sample, stand for the space: each vector is the order in which it sees them, nearest first. One more
component makes all indexed vectors equally long, which turns the largest inner product into the smallest angle. Every
vector is posted in the inverted files of its POSTED nearest pivots. A query looks into the files of its PROBED nearest pivots and ranks
all that is posted there by the inner product in double precision: in a tight cluster all members have nearly the same permutation, so
footrule distances (of whole permutations) can't tell which of them to leave out. A vector posted in several of a query's files is looked at
in the first only. The few vectors far longer than the rest would make the added component swamp the others; they are posted in a file of
their own, which every query looks into.

Files are cut into parts of about PART_ROWS vectors, and the queries of each file into blocks of about BLOCK_QUERIES by their own number, so that
a pivot that is nearest to a large share of the vectors is many tasks' work; a file few queries ask for is sent once. Nothing posted is left out.

What is missed of the 20 nearest is posted in no probed file. Modelled share that is posted in one, 150 queries each: 0.98 to 1.0 on the
given tables, 1.0 on 20 and 50 clusters of 6000 and 40000 rows in 64 dimensions, 0.97 where lengths are lognormal (sigma 0.5). A query looks at
half to four fifths of the vectors there. Tests hold recall above 0.9.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do those of another length than most,
nor rows without vec_id. Rows that repeat a vec_id count once, with the least of their vectors. A query with fewer candidates gets all that
it finds. Ties go to the smaller vec_id. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightline.functions.materialise import materialise

PIVOTS = 128
POSTED = 4
PROBED = 48
#: Vectors longer than LONG times the length that this share of the vectors stays within are outlying.
USUAL = 0.99
LONG = 2.0
PART_ROWS = 4_096
BLOCK_QUERIES = 16_384


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))
    v = v.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    lengths = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vector") == (lengths.n if lengths else 0))


def chosen_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """At most that many different vectors, chosen by the hash of vec_id from a sample of eight times as many."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * pivots).collect()
    different = list(dict.fromkeys(tuple(r.vector) for r in sample))
    return np.array(different[:pivots], float)


def length() -> Column:
    return F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))


def longest_of(vectors: DataFrame) -> float:
    """The largest length of a vector that is not outlying."""
    usual = vectors.agg(F.percentile_approx(length(), USUAL)).first()[0]
    return float(vectors.where(length() <= LONG * usual).agg(F.max(length())).first()[0]) if usual else 0.0


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that brings them all to the same length, so that the largest inner product is the smallest angle."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1, keepdims=True), 0.0))
    return np.hstack([vectors, rest])


def permuted(vectors: DataFrame, pivots: np.ndarray, longest: float, asking: bool) -> DataFrame:
    """A written table of vec_id, vector and places (of each pivot in the vector's order) as bytes, and nearest (pivots, nearest first).

    Only vectors that ask need places, and PROBED pivots; the others get POSTED. Vectors that ask have nothing in the component that makes those of the index equally long. The file of outlying vectors counts as one
    more pivot, the last: such vectors have no other in nearest, and all that ask have it there.
    """
    n = len(pivots)
    far = lengthened(pivots, longest) if n else pivots

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("vector").to_pylist(), float)
            long = np.hstack([v, np.zeros((len(v), 1))]) if asking else lengthened(v, longest)
            order = np.argsort(-(long @ far.T), axis=1, kind="stable")
            places = np.full((len(v), n + 1 if asking else 0), n, np.int16)
            if asking:
                np.put_along_axis(places, order, np.arange(n, dtype=np.int16)[None, :], axis=1)
            near = list(order[:, : PROBED if asking else POSTED].astype(np.int32))
            if asking:
                near = [np.append(x, np.int32(n)) for x in near]
            else:
                near = [x if size <= longest else np.array([n], np.int32) for x, size in zip(near, batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary()),
                pa.array(near, pa.list_(pa.int32())),
            ], names=["vec_id", "vector", "places", "nearest"])

    return materialise(vectors.withColumn("length", length()).mapInArrow(run, "vec_id long, vector binary, places binary, nearest array<int>"), "index")


def _pieces(pivots: DataFrame, rows: int) -> Column:
    """By pivot (at most PIVOTS + 1 of them), the number of pieces of about that many rows; null beyond the last pivot that has any."""
    counts = {r.pivot: r.n for r in pivots.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    return F.array(*[F.lit(-(-counts.get(p, 0) // rows)) for p in range(max(counts, default=0) + 1)])


def search(indexed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest in indexed found for each of queries; both are permuted() by the same pivots."""
    posted = indexed.select("vec_id", "vector", F.col("nearest").alias("posts"))
    parts, blocks = _pieces(posted.select(F.explode("posts").alias("pivot")), PART_ROWS), _pieces(queries.select(F.explode("nearest").alias("pivot")), BLOCK_QUERIES)
    files = posted.withColumn("pivot", F.explode("posts")).withColumns({"parts": F.get(parts, F.col("pivot")), "blocks": F.get(blocks, F.col("pivot"))})
    files = files.where("blocks > 0").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    files = files.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
    asked = queries.select("vec_id", "vector", "places", F.explode("nearest").alias("pivot"))
    asked = asked.withColumns({"parts": F.get(parts, F.col("pivot")), "blocks": F.get(blocks, F.col("pivot"))})
    asked = asked.where("parts > 0").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
    key = ["pivot", "part", "block"]

    def rank(group: tuple, mine: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(mine) and len(ask):
            pivot = group[0]
            mine = mine.sort_values("vec_id")
            ids, posts, vectors = mine["vec_id"].to_numpy(), np.array(mine["posts"].tolist()), _matrix(mine["vector"], float)
            for query, q, at in zip(ask["vec_id"], _matrix(ask["vector"], float), _matrix(ask["places"], np.int16), strict=True):
                here = np.flatnonzero((at[posts].min(axis=1) == at[pivot]) & (ids != query))
                if not len(here):
                    continue
                # Not by BLAS: equal vectors get equal scores wherever they stand, so that ties are seen.
                score = np.einsum("ij,j->i", vectors, q)[here]
                best = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(here) > k else np.arange(len(here))
                best = best[np.lexsort((ids[here[best]], -score[best]))[:k]]
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[here[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    near = files.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(rank, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def nearest(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by `every`, among all others."""
    vectors = materialise(valid_vectors(rows), "vectors")
    longest = longest_of(vectors)
    pivots = chosen_pivots(vectors.where(length() <= longest), PIVOTS)
    indexed = permuted(vectors, pivots, longest, asking=False)
    return search(indexed, permuted(vectors.where(F.col("vec_id") % every == 0), pivots, longest, asking=True), k)
