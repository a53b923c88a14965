"""Cutting lineage in loops."""

from pyspark.sql import functions as F

from termforest.session import cut


def test_guessed_sizes_stay_small_in_loops(spark):
    df = cut(spark.range(50).select("id", F.lit("x").alias("w")))
    for _ in range(25):
        df = cut(df.join(df.select("id", F.col("w").alias("v")), "id").select("id", F.col("v").alias("w")))
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert df.count() == 50 and df.schema.names == ["id", "w"] and df.filter("id = 7").first()["w"] == "x"
