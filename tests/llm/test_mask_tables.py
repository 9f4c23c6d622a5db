"""Fingerprints stand in a row for each mask, which Spark's sizes of exploded tables don't tell: such rows are never broadcast."""

from pyspark.sql import functions as F

from lodestone.llm import simhash


def test_exploded_masks_are_not_broadcast(spark):
    prints = spark.range(200).select(F.xxhash64("id").alias("f0"), F.xxhash64("id", "id").alias("f1"))
    value = F.array(*[F.xxhash64("f0", F.lit(k)) for k in range(30)])
    links = simhash.grouped_links(prints.select(*simhash.LANES, F.posexplode(value).alias("t", "value")), simhash.LANES, (8,), star=True)
    plan = links._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and "BroadcastHashJoin" not in plan
