"""Stored sketches that merge: distinct counts, quantiles and heavy hitters per cell of a table.

``sketched`` makes a row for each cell (a day and a type, say) with three
sketches as binary columns; ``merged`` unites the rows of any coarser grouping
and reads the answers, without the events.  All three are Spark's own aggregates
(HyperLogLog, KLL, and approximate frequent items), so they are combined on the
map side and their size is bounded by their parameters.

Bounds: a distinct count of ``lg_k`` is within 3 * 1.04 / sqrt(2**lg_k) of the
truth with probability 0.99; a quantile of ``k`` is of a rank within
``quantile_error(k)`` of the one asked for, with probability 0.99, however often
sketches have been merged; of n items the heavy hitters' counts are too small or
too large by n / (0.75 * most_items) at most, and 0 while no more than 0.75 *
most_items different ones have been seen.

Where a distinct count must be exact, ``bitmaps`` stores the set of whole numbers
of each cell instead, in pieces of 4 KB for each 32,768 numbers that hold one,
and ``bitmaps_merged`` unites them.

Null values enter no sketch.  A cell without values gives 0, null and no hitters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

LG_K, KLL_K, MOST_ITEMS = 12, 400, 1024
SKETCHES = ["distinct_sketch", "quantile_sketch", "hitters_sketch"]


def quantile_error(k: int = KLL_K) -> float:
    """Largest error of a rank, as a share of the rows, that a KLL sketch of this size promises for 99 of 100."""
    return 2.446 / k**0.9433


def distinct_error(lg_k: int = LG_K) -> float:
    return 3 * 1.04 / 2 ** (lg_k / 2)


def hitters_error(most_items: int = MOST_ITEMS) -> float:
    """Largest error of a count, as a share of the rows, of a sketch of this size; its map has the next power of two of places."""
    return 3.5 / 2 ** math.ceil(math.log2(most_items / 0.75))


def sketched(rows: DataFrame, by: list[str], counted: str, measured: str, item: str, lg_k: int = LG_K, k: int = KLL_K, most_items: int = MOST_ITEMS) -> DataFrame:
    """``by``, ``n`` and the three sketches: of the distinct ``counted``, of the ``measured`` doubles, of the frequent ``item`` values."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(counted, lg_k).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(measured).cast("double"), k).alias("quantile_sketch"),
        F.call_function("approx_top_k_accumulate", F.col(item), F.lit(most_items)).alias("hitters_sketch"),
    )


def merged(cells: DataFrame, by: list[str], quantiles: list[float], top: int, most_items: int = MOST_ITEMS, k: int = KLL_K) -> DataFrame:
    """``by``, ``n``, ``distinct``, ``quantiles`` (as many as asked for) and ``hitters`` (item and count, the most frequent first) of united cells."""
    united = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("quantile_sketch", k).alias("q"),
        F.call_function("approx_top_k_combine", F.col("hitters_sketch"), F.lit(most_items)).alias("h"),
    )
    at = [F.kll_sketch_get_quantile_double("q", F.lit(float(p))) for p in quantiles]
    some = F.kll_sketch_get_n_double("q") > 0
    return united.select(
        *by, "n", F.hll_sketch_estimate("d").alias("distinct"), F.when(some, F.array(*at)).alias("quantiles"),
        F.filter(F.call_function("approx_top_k_estimate", F.col("h"), F.lit(top)), lambda x: x["item"].isNotNull()).alias("hitters"),
    )


def bitmaps(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """``by, bucket, n, bits``: the exact set of the whole numbers ``item`` of each cell, in pieces; rows without one are counted in ``n`` alone."""
    return rows.groupBy(*by, F.bitmap_bucket_number(item).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(item)).alias("bits"))


def bitmaps_merged(cells: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``n`` and the exact ``distinct`` of united cells."""
    pieces = cells.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("d"))
    return pieces.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("d").alias("distinct"))
