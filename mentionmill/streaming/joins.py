"""Joins by time: rows of two tables with one key, the right one at or after the left one and within a bound.

As streams: both sides have a watermark, so a row's state is dropped once
nothing within its bound can come.  As tables: time is cut into buckets of the
bound's length, a left row meets the right rows of its own bucket and the next
one, so the rows of a busy key meet bucket by bucket and not all with all, and
key and bucket together are what the shuffle deals by.

Null keys and null times match nothing; the outer join keeps such left rows of
tables.  In streams rows without a time are left out, as are rows later than the
watermark.  Bounds are inclusive.  Repeated rows match each on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _sides(left: DataFrame, right: DataFrame, key: str, time: str) -> tuple[DataFrame, DataFrame]:
    name = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    return name(left, "l"), name(right, "r")


def stream_within(left: DataFrame, right: DataFrame, key: str, time: str, bound_seconds: int, late: str = "1 hour", outer: bool = False) -> DataFrame:
    """Streams; columns of both sides, as ``l_`` and ``r_``."""
    x, y = _sides(left.withWatermark(time, late), right.withWatermark(time, late), key, time)
    apart = F.expr(f"r_{time} >= l_{time} and r_{time} <= l_{time} + interval {int(bound_seconds)} seconds")
    return x.join(y, (F.col(f"l_{key}") == F.col(f"r_{key}")) & apart, "left_outer" if outer else "inner")


def within(left: DataFrame, right: DataFrame, key: str, time: str, bound_seconds: int, outer: bool = False) -> DataFrame:
    """Tables; the same rows.

    The outer join adds the left rows that an anti join leaves in both of their
    buckets; its columns must be ones that can be grouped by.
    """
    x, y = _sides(left, right, key, time)
    length = int(bound_seconds) * 1_000_000
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / length)
    x = x.withColumn("_next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", bucket(f"l_{time}") + F.col("_next"))
    y = y.where(F.col(f"r_{key}").isNotNull() & F.col(f"r_{time}").isNotNull()).withColumn("_own", bucket(f"r_{time}"))
    apart = F.expr(f"r_{time} >= l_{time} and r_{time} <= l_{time} + interval {int(bound_seconds)} seconds")
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("_at") == F.col("_own")) & apart
    if not outer:
        return x.join(y, on).drop("_next", "_at", "_own")
    matched = within(left, right, key, time, bound_seconds)
    names, order = x.columns[:-2], [f"l_{c}" for c in left.columns]
    none = [F.lit(None).cast(t).alias(f"r_{c}") for c, t in right.dtypes]
    # left rows of no match: those that an anti join leaves in both buckets
    free = x.join(y, on, "left_anti").groupBy(*[F.col(c) for c in order]).agg(F.count_if(F.col("_next") == 0).alias("a"), F.count_if(F.col("_next") == 1).alias("b"))
    # repeated left rows are all matched or all free in a bucket, so the counts are those of the rows
    free = free.where("a > 0 and b > 0").select(*names, F.explode(F.sequence(F.lit(1), F.least("a", "b"))).alias("_n")).drop("_n")
    return matched.unionByName(free.select(*names, *none))
