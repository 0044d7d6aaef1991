"""Order-dependent columns without a global or per-key sort of unbounded size.

Each helper cuts the rows into buckets of the ordering number, works inside the
buckets, and carries the bucket totals in a table that is ``width`` times smaller.
One key may hold any share of the rows: its work is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_WIDTH = 4096


def running_offset(df: DataFrame, key: str, size: str, out: str, width: int = DEFAULT_WIDTH):
    """Sum of ``size`` over all smaller keys; returns ``(key, out)``.

    ``key`` is a unique whole number. Two bucket levels leave one row per
    ``width * width`` key values for the last, unpartitioned, sum.
    """
    rows = df.select(
        F.col(key),
        F.col(size).cast("bigint").alias("_size"),
        F.floor(F.col(key) / width).alias("_b1"),
    ).repartition("_b1")
    level1 = rows.groupBy("_b1").agg(F.sum("_size").alias("_s1"))
    level1 = level1.withColumn("_b2", F.floor(F.col("_b1") / width))
    level2 = level1.groupBy("_b2").agg(F.sum("_s1").alias("_s2"))
    top = level2.select(
        "_b2",
        F.coalesce(F.sum("_s2").over(W.orderBy("_b2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o2"),
    )
    mid = level1.join(top, "_b2").select(
        "_b1",
        (
            F.col("_o2")
            + F.coalesce(
                F.sum("_s1").over(
                    W.partitionBy("_b2").orderBy("_b1").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            )
        ).alias("_o1"),
    )
    inside = F.sum("_size").over(
        W.partitionBy("_b1").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_in", F.coalesce(inside, F.lit(0)))
        .join(mid, "_b1")
        .select(key, (F.col("_o1") + F.col("_in")).cast("bigint").alias(out))
    )


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str):
    """1-based row number per ``keys`` by ``(bucket, order)``.

    ``bucket`` must grow with the order, so only rows of one bucket are sorted
    together.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(
                W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        rows.withColumn("_in", inside)
        .join(before, [*keys, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint"))
        .drop("_bucket", "_before", "_in")
    )


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    cols: list[str],
    width: int = DEFAULT_WIDTH,
    previous: bool = False,
) -> DataFrame:
    """Add ``next_<col>`` (or ``prev_<col>``) of the following row per ``keys``.

    ``order`` is a whole number. Rows on a bucket's edge take their neighbour from
    the table of bucket edges, which holds one row per bucket.
    """
    bucket = [*keys, "_bucket"]
    name = "prev_" if previous else "next_"
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    packed = F.struct(F.col(order).alias("_at"), *[F.col(c) for c in cols])
    pick = F.max_by if previous else F.min_by
    edges = rows.groupBy(*bucket).agg(pick(packed, order).alias("_edge"))
    shift = F.lag if previous else F.lead
    across = edges.select(
        *bucket,
        shift("_edge").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_across"),
    )
    inside = shift(packed).over(W.partitionBy(*bucket).orderBy(order))
    near = rows.withColumn("_near", inside).join(across, bucket)
    got = F.coalesce(F.col("_near"), F.col("_across"))
    return near.select(
        *[F.col(c) for c in df.columns], *[got[c].alias(name + c) for c in cols]
    )


def nth_smallest(df: DataFrame, keys: list[str], order: str, n: int, out: str, salts: int = 64):
    """The ``n``-th smallest ``order`` per key, absent when a key has fewer rows.

    Each salt keeps its ``n`` smallest first, so a hot key never meets in one task
    with more than ``n * salts`` rows.
    """
    salted = df.select(*keys, order).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    near = salted.withColumn(
        "_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(order))
    ).filter(F.col("_r") <= n)
    return (
        near.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
        .filter(F.col("_r") == n)
        .select(*keys, F.col(order).alias(out))
    )
