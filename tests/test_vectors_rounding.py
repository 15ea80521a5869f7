"""Rounding of long-form values."""

import random

from pyspark.sql import functions as F

from tessera.operators import vectors


def test_rounded_is_spark_round(spark):
    rnd = random.Random(3)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 123456.7890125, 1e5, 99999.9999995]
    values += [k / 1e7 for k in range(-60, 60, 5)] + [rnd.uniform(-2, 2) for _ in range(2000)]
    values += [rnd.randrange(10 ** 7) / 1e7 for _ in range(2000)] + [rnd.uniform(-1e9, 1e9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(F.round("v", 6).alias("a"), vectors.rounded(F.col("v"), 6).alias("b"))
    assert got.filter(~F.expr("a <=> b")).count() == 0
    plan = vectors.to_long(df.select(F.lit(1).alias("id"), F.array("v").alias("vec")), ["id"])
    assert "rint" in plan._jdf.queryExecution().executedPlan().toString().lower()
