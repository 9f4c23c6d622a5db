"""Links of records are worked out once a row, and titles are taken apart before the rounds."""

from pyspark.sql import functions as F

from lodestone.operators import resolve


def records(spark):
    text = ["company", "title", "location", "source", "job_id", "identity_key", "url", "application_url", "city"]
    return spark.range(9).select(F.col("id").cast("string").alias("record_id"), F.col("id").alias("seq"), *[F.concat(F.lit(x), F.col("id").cast("string")).alias(x) for x in text])


def test_links_are_worked_out_once(spark):
    for made in (resolve.record_keys(records(spark)), resolve.posting_keys(records(spark))):
        plan = made.select("record_id", "keys")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("url_encode") + plan.count("encode(") <= 24


def test_rounds_take_no_title_apart(spark):
    keyed = resolve.record_keys(records(spark))
    parts = keyed.select(F.col("seq").alias("ord"), resolve.title_parts(F.col("title")).alias("title"), F.transform("keys", lambda k: F.struct(F.lit(0).alias("pos"), k.alias("k"), F.lit(-1).alias("slice"))).alias("keys"))
    state = parts.withColumn("now", F.struct(F.lit(True).alias("head"), F.col("ord").alias("primary"), F.col("title").alias("named"))).localCheckpoint()
    assert "regexp" not in resolve.dedupe_round(state)._jdf.queryExecution().optimizedPlan().toString()
