"""Joins on cells: of a cell, the rows of one side are held in blocks of bounded size and those of the other pass by them in portions, so that pairs are
judged as vectors of numbers, and no row is written once for each pair that it may be in. A cell with many rows is many blocks, dealt to many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of the rows that are held at once, about; of those that pass by a block; pairs that are looked at together; and copies of rows alike for each of these.
BLOCK = 1 << 14
STREAM = 1 << 17
PAIRS = 1 << 20
COPIES = 4

Judge = Callable[[pa.StructArray, pa.StructArray], tuple[np.ndarray, np.ndarray]]


def streamed(a: DataFrame, b: DataFrame, cell: list[str], crowded: DataFrame, order: list[str], together: list[str] | None = None) -> DataFrame:
    """Rows of a and b, as structs l and r, one of them null, with those of a block of a cell in one partition, next to each other: a's, then b's in the given order.

    crowded: cells with of_a and of_b, by how many blocks a's rows are dealt and by how many b's; a cell that it lacks is one. It is broadcast.
    together: columns of a; rows of a cell that are equal in them are in one block."""
    key = [*cell, "block_a", "block_b"]
    of = {"a": F.coalesce("of_a", F.lit(1).cast("long")), "b": F.coalesce("of_b", F.lit(1).cast("long"))}

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        values = [c for c in df.columns if c not in cell]
        rows = df.join(F.broadcast(crowded), cell, "left").withColumn(f"block_{mine}", F.pmod(F.xxhash64(*(together if together and mine == "a" else values)), of[mine]))
        rows = rows.withColumn(f"block_{other}", F.explode(F.sequence(F.lit(0).cast("long"), of[other] - 1)))
        return rows.select(*key, *(F.col(c).alias(f"{c}_o") for c in order), F.struct(*values).alias(mine))

    left, right = dealt(a, "a", "b"), dealt(b, "b", "a")
    of_l, of_r = left.schema["a"].dataType, right.schema["b"].dataType
    sides = [left.withColumn("side", F.lit(0)).withColumn("b", F.lit(None).cast(of_r)), right.withColumn("side", F.lit(1)).withColumn("a", F.lit(None).cast(of_l))]
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sides[0].unionByName(sides[1]).repartition(tasks, *key)
    return rows.sortWithinPartitions(*key, "side", *(f"{c}_o" for c in order)).select(*key, "side", F.col("a").alias("l"), F.col("b").alias("r"))


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
    """A block of a's rows, and b's that pass by it, portion by portion, from the rows of streamed(): the block is the same object for all that pass by it."""
    at, parts, block = None, [], None
    for batch in batches:
        keys, (side, l, r) = batch.columns[:-3], batch.columns[-3:]
        sides = side.to_numpy()
        turn = np.ones(batch.num_rows, bool)
        turn[1:] = sides[1:] != sides[:-1]
        for c in keys:
            turn[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(turn)
        for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(c[i].as_py() for c in keys)
            if here != at:
                at, parts, block = here, [], None
            if sides[i] == 0:
                parts.append(l.slice(i, j - i))
            elif parts or block is not None:
                if block is None:
                    block, parts = pa.concat_arrays(parts), []
                yield block, r.slice(i, j - i)


def portioned(rows: pa.StructArray, held: int, alike: str | None) -> Iterator[pa.StructArray]:
    """Portions of rows that make up PAIRS pairs with those held, about; with `alike`, as many of rows that differ."""
    step = max(1, PAIRS // held)
    n = np.arange(len(rows))
    if alike:
        like = rows.field(alike).to_numpy()
        n = np.append(0, (like[1:] != like[:-1]).cumsum())
    i = 0
    while i < len(rows):
        j = int(np.searchsorted(n, n[i] + step))
        j = min(j, i + COPIES * step)
        yield rows.slice(i, j - i)
        i = j


def paired(
    a: DataFrame, b: DataFrame, cell: list[str], weights: tuple[Column, Column], judge: Judge, out_a: list[str], out_b: list[str], order: tuple[str, ...] = (),
    alike: str | None = None,
) -> DataFrame:
    """out_a of a and out_b of b for the pairs of rows in equal cells that judge() takes: it is given a block of a and a portion of b, and returns the places of
    pairs in them. order: columns of both by which rows come to it; alike: one more, equal in rows of which judge() looks at one for all."""
    a, b = a.dropna(subset=cell), b.dropna(subset=cell)
    weighed = a.select(*cell, weights[0].alias("a"), F.lit(0.0).alias("b")).unionByName(b.select(*cell, F.lit(0.0).alias("a"), weights[1].alias("b")))
    # No more than there are blocks.
    crowded = weighed.groupBy(*cell).agg(F.ceil(F.sum("a") / BLOCK).alias("of_a"), F.ceil(F.sum("b") / STREAM).alias("of_b")).where("least(of_a, of_b) > 0 and greatest(of_a, of_b) > 1")
    fields = [a.schema[c] for c in out_a] + [b.schema[c] for c in out_b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for l, passing in meetings(batches):
            for r in portioned(passing, len(l), alike):
                at, of = judge(l, r)
                if len(at):
                    columns = [*(l.field(c).take(pa.array(at)) for c in out_a), *(r.field(c).take(pa.array(of)) for c in out_b)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*out_a, *out_b])

    return streamed(a, b, cell, crowded, [*order, *([alike] if alike else [])]).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def numbers(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [rows.field(n).to_numpy(zero_copy_only=False) for n in names]
