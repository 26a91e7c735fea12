"""Relational operators of the evidence model: dedupe, gap sessions, as-of selection, paging and chain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= n).drop("__place")


def dedupe_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that was delivered first."""
    return top_rows(df, key, order)


#: Seconds of a slab of gap_sessions(): what one task holds of a key.
SLAB_S = 21600


def gap_sessions(df: DataFrame, keys: list[str], time: str, gap_s: int, ties: list[str], slab_s: int | None = None) -> DataFrame:
    """Adds session_start: the time of the first row of the chain of rows that are at most gap_s after the row before. time: seconds, a whole number.

    A key's rows are dealt to slabs of time, so that no task gets all of a key that has very many. Within a slab sessions start where a gap is,
    and at its first row; one row for each slab then tells whether that one goes on from the slab before, and since when. Rows without a time make a
    session of their own, of null.
    """
    at = F.col(time)
    df = df.withColumn("__slab", F.floor(at / F.lit(slab_s or SLAB_S)))
    w = Window.partitionBy(*keys, "__slab").orderBy(time, *ties)
    before = F.lag(time).over(w)
    rows = df.withColumn("__start", F.when(before.isNull() | (at - before > gap_s), at))
    rows = rows.withColumn("__start", F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slabs = rows.groupBy(*keys, "__slab").agg(F.min(time).alias("__first"), F.max(time).alias("__last"), F.max("__start").alias("__open"))
    order = Window.partitionBy(*keys).orderBy("__slab")
    goes_on = F.coalesce(F.col("__first") - F.lag("__last").over(order) <= gap_s, F.lit(False))
    slabs = slabs.withColumn("__goes_on", goes_on)
    # The slab's last session began in it, unless the slab is one session that goes on.
    own = F.when(~F.col("__goes_on") | (F.col("__open") > F.col("__first")), F.col("__open"))
    slabs = slabs.withColumn("__since", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    slabs = slabs.where("__goes_on").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slab").alias("__s"), "__first", "__since")
    same = F.col("__slab").eqNullSafe(F.col("__s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(slabs, same, "left")
    start = F.when(F.col("__start") == F.col("__first"), F.col("__since")).otherwise(F.col("__start"))
    return out.withColumn("session_start", start).drop("__slab", "__start", "__s", "__first", "__since", *[f"__k{i}" for i in range(len(keys))])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: list[str], ties: list[str]) -> DataFrame:
    """left with the columns `value` of the right row of its keys that is latest at or before left_time; null if there is none.

    One shuffle on the keys: both sides are put in one order and the latest right row is carried forward, so that
    neither side is multiplied. At equal times right rows come first, the last of them in the order of ties.
    """
    carried = F.struct(*[F.col(c) for c in value])
    rows = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    rows = rows.withColumn("__right", F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType))
    for t in ties:
        rows = rows.withColumn(f"__{t}", F.lit(None).cast(right.schema[t].dataType))
    other = right.select(
        *[F.col(k) for k in keys], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"),
        carried.alias("__right"), *[F.col(t).alias(f"__{t}") for t in ties],
    )
    order = Window.partitionBy(*keys).orderBy("__t", "__side", *[f"__{t}" for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other).withColumn("__right", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
    return both.select("__left.*", *[F.col(f"__right.{v}").alias(f"asof_{v}") for v in value])


def without_newer(df: DataFrame, keys: list[str], version: str, visible: Column) -> DataFrame:
    """Visible rows of which no visible row of the same keys has a larger version."""
    newest = Window.partitionBy(*keys)
    seen = df.where(visible)
    return seen.withColumn("__newest", F.max(version).over(newest)).where(F.col(version) == F.col("__newest")).drop("__newest")


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """At most limit rows after the given key in the order (column, descending), with has_more: whether rows follow the page."""
    if after is not None:
        beyond = F.lit(False)
        for i, (column, descending) in enumerate(order):
            step = F.col(column) < F.lit(after[i]) if descending else F.col(column) > F.lit(after[i])
            for j in range(i):
                step = step & (F.col(order[j][0]) == F.lit(after[j]))
            beyond = beyond | step
        df = df.where(beyond)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]
    page = df.orderBy(*keys).limit(limit + 1)  # one look-ahead row: bounded, so the window below sees limit + 1 rows at most
    place = Window.orderBy(*keys)
    page = page.withColumn("__place", F.row_number().over(place)).withColumn("has_more", F.max("__place").over(Window.partitionBy(F.lit(0))) > limit)
    return page.where(F.col("__place") <= limit).drop("__place")


def chain_violations(df: DataFrame, chain: str, version: str, time: str) -> DataFrame:
    """Rows of a chain whose version isn't the one before plus 1, or whose time goes back, with before_version and reason."""
    w = Window.partitionBy(chain).orderBy(version, time)
    out = df.withColumn("before_version", F.lag(version).over(w)).withColumn("__before", F.lag(time).over(w))
    reason = F.when(F.coalesce("before_version", F.lit(0)) + 1 != F.col(version), "version-gap").when(F.col(time) < F.col("__before"), "time-regression")
    return out.withColumn("reason", reason).drop("__before").where("reason is not null")
