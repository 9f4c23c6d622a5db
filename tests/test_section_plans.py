"""Sections are worked out once in a row: no filter or merged projection works the index out again."""

import pytest

from lodestone.sources import sections

READERS = {
    "postings": lambda d: sections.section_postings(d), "headings": lambda d: sections.heading_postings(d),
    "concepts": lambda d: sections.technical_sections(d, "stream words"), "rivals": lambda d: sections.competitor_profiles(d),
}


@pytest.mark.parametrize("name", READERS)
def test_lines_are_split_once(spark, tmp_path, name):
    spark.createDataFrame([(1, "# A Data Engineer\nLocation: X")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plan = READERS[name](spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_first_headings_in_order(spark):
    text = "# Data Engineer\nLocation: A\n# DATA Engineer\nx\n# Senior Analyst\nLocation: B\n# Data Engineer\nLocation: C\n- Lead Developer"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# Data Engineer\n# Data Engineer")], "doc_id long, text string")
    got = [(r["doc_id"], r["pos"], r["title"], r["location"]) for r in sections.heading_postings(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 1, "Data Engineer", "A"), (1, 2, "Senior Analyst", "B"), (1, 3, "Lead Developer", None)]
