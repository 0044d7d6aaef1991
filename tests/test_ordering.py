"""Order helpers against pandas, with one key holding a third of all rows."""

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions.folds import ordered_fold
from lectern.functions.ordering import nth_smallest, rank_within, running_offset, with_neighbours


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).cast("bigint").alias("k"),
        F.col("id").alias("at"),
        (F.xxhash64("id") % 1000).alias("v"),
    )


def test_running_offset(spark):
    df = skewed(spark)
    got = running_offset(df, "at", "v", "off", width=16).toPandas().set_index("at")["off"].sort_index()
    pdf = df.toPandas().sort_values("at")
    want = (pdf["v"].cumsum() - pdf["v"]).tolist()
    assert got.tolist() == want


def test_rank_within(spark):
    got = rank_within(skewed(spark), ["k"], F.floor(F.col("at") / 50), ["at"], "r").toPandas()
    want = got.sort_values("at").groupby("k").cumcount() + 1
    assert (got["r"].sort_index() == want.sort_index()).all()


def test_neighbours_across_empty_buckets(spark):
    df = skewed(spark).filter("at % 40 < 3")
    for previous in (False, True):
        got = with_neighbours(df, ["k"], "at", ["v"], width=8, previous=previous).toPandas().sort_values("at")
        want = got.groupby("k")["v"].shift(1 if previous else -1)
        col = "prev_v" if previous else "next_v"
        assert got[col].astype("float").fillna(-1).tolist() == want.astype("float").fillna(-1).tolist()


def test_nth_smallest(spark):
    df = skewed(spark)
    got = nth_smallest(df, ["k"], "at", 5, "x").toPandas().set_index("k")["x"]
    pdf = df.toPandas().sort_values("at")
    want = pdf.groupby("k").nth(4).set_index("k")["at"]
    assert got.sort_index().to_dict() == want.sort_index().to_dict()


def test_ordered_fold_carries_state_over_batches(spark):
    df = skewed(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ordered_fold(
            df, ["k"], ["at"], lambda: {"s": 0},
            lambda st, row: [(row["at"], st.__setitem__("s", st["s"] + int(row["v"])) or st["s"])],
            "at bigint, total bigint",
        ).toPandas().sort_values("at")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = df.toPandas().sort_values("at")
    assert got["total"].tolist() == pdf.groupby("k")["v"].cumsum().tolist()
    assert isinstance(got, pd.DataFrame)
