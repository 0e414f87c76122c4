"""Shares decided on the digits of md5 against the number they stand for."""

import pytest
from pyspark.sql import functions as F

from stratafold.functions.scalar import md5_below, md5_uniform
from stratafold.operators import resample as R


@pytest.mark.parametrize("share", [0.0, 1e-9, 0.3, 0.5, 1 - 1e-9, 1.0])
def test_md5_below_is_md5_uniform_below(spark, share):
    d = spark.range(3000).withColumn("rep", F.col("id") % 7)
    at = [r["u"] for r in d.orderBy("id").limit(5).select(md5_uniform(0, "rep", F.col("id")).alias("u")).collect()]
    for s in [share, *at]:  # a number itself is not below itself
        assert d.where(md5_below(s, 0, "rep", F.col("id")) != (md5_uniform(0, "rep", F.col("id")) < s)).count() == 0


def test_subset_noise_turns_no_digits_into_numbers(spark):
    g = R.subset_noise(spark.range(50).withColumn("d", F.col("id") * 0.5), "d", "id", 0.3, 10)
    assert "conv(" not in g._jdf.queryExecution().optimizedPlan().toString() and g.first()["sd"] > 0
