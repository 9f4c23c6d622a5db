"""Titles that many rows share are compared once, and every pair of rows comes out."""

from itertools import combinations

from pyspark.sql import functions as F

from lodestone.operators import resolve


def test_all_pairs_with_large_kinds(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PIECE", 7)
    monkeypatch.setattr(resolve, "MEET", 2)
    titles = ["Data Engineer", "Senior Data Engineer", "Chef", "Data Platform Engineer Two Three", "", None]
    rows = [(i, titles[i * i % 6] if i < 90 else "Chef", i % 2) for i in range(120)] + [(500, "Chef", None)]
    df = spark.createDataFrame(rows, "k long, t string, g int")
    found = [tuple(r) for r in resolve.title_pairs(df, "k", "t", ["g"]).collect()]
    pairs = [(a, b, x, y) for (a, x, g), (b, y, h) in combinations(rows, 2) if g == h and g is not None]
    judged = spark.createDataFrame(pairs, "a long, b long, x string, y string").select("a", "b", resolve.compatible_titles(F.col("x"), F.col("y")).alias("ok"))
    assert sorted(found, key=repr) == sorted(map(tuple, judged.collect()), key=repr)


def test_rule_is_worked_out_before_keys_come_in(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "k long, t string, g int")
    plan = resolve.title_pairs(df, "k", "t", ["g"])._jdf.queryExecution().optimizedPlan().toString().split("\n")
    rule = [i for i, line in enumerate(plan) if "array_intersect" in line]
    opened = [i for i, line in enumerate(plan) if "Generate explode" in line]
    assert rule and sum(i < min(rule) for i in opened) == 2
