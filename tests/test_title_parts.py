"""Titles are taken apart once before they are compared."""

from pyspark.sql import functions as F

from lodestone.operators import resolve


def test_parts_compare_like_titles(spark):
    rows = [("Data Engineer", "data-engineer", True), ("Data Engineer", "Chef", False), (None, "Chef", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumns({"x": resolve.title_parts(F.col("a")), "y": resolve.title_parts(F.col("b"))})
    for r in df.select("want", resolve.compatible_parts(F.col("x"), F.col("y")).alias("got"), resolve.compatible_titles(F.col("a"), F.col("b")).alias("whole")).collect():
        assert r["got"] == r["whole"] == r["want"]
