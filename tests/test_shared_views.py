"""Shared views whose cost must follow the input."""

from stratafold.plans import fixtures as V

SF = "/root/testdata/sf0.001"


def test_partitions_of_pixels_follow_the_images(spark, monkeypatch):
    n = V.table(spark, SF, "embeddings").count()
    monkeypatch.setattr(V, "IMAGES", 5)
    p = V.pixels(spark, SF)
    assert p.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 5)) and p.count() == 64 * n


def test_entity_table_is_aggregated_once(spark):
    f = V.folds(spark, SF).inputFiles()
    assert f and all("/samples/" in x for x in f)
