"""Exports: nested JSON, CSV with neutralized formulas, and a manifest of the written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.listings import csv_cells, with_evidence

# Columns that come first in an export.
FIRST = ["record_id", "title", "company", "location", "salary", "url", "posted_at", "status", "confidence"]


def export_json(records: DataFrame, evidence: DataFrame, path: str) -> None:
    with_evidence(records, evidence).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Preferred columns first, the others by name; string cells that a spreadsheet would run are quoted."""
    order = [c for c in FIRST if c in df.columns] + sorted(c for c in df.columns if c not in FIRST)
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    csv_cells(df.select(*order), text).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, form: str) -> DataFrame:
    """One row per written file: name, form (csv with a header, or json), bytes, SHA-256 of the content, and the rows in it.

    Rows are counted from the files as they lie there, so an export that lost or broke rows is noticed; a file without rows has 0.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(form).alias("form"), "length", F.sha2("content", 256).alias("sha256"))
    if form == "csv":
        rows = spark.read.schema("first string").option("header", True).option("multiLine", True).option("pathGlobFilter", "part-*").csv(path)
    else:
        rows = spark.read.option("pathGlobFilter", "part-*").text(path)
    counted = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    return files.join(counted, "file", "left").fillna(0, ["rows"])
