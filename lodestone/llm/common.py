"""Helpers shared by the training-data operators: scratch tables, vocabulary shipping, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.components import shared_folder, shuffles_dropped

#: ASCII white space as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """A stored table in buckets of the keys: later joins on all of them leave its rows where they are."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Removes the files of a stored table that no later step reads."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text"):
    """Null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that no slice holds much more than limit bytes of the column; one row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            n = 0 if n != n else int(n)
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def as_bytes(words: pa.Array) -> list[bytes]:
    """Much faster than to_pylist() for many short values."""
    return words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def join_skewed(rows: DataFrame, index: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with an index that has one entry for each key and, in weight, how many rows have the key.

    Keys that hold a 1024th of all rows or more are at most 1024 entries, a proven bound: they are broadcast, and their
    rows stay where they are. The other keys are spread well enough for a shuffle join.
    """
    hot = F.col(weight) * 1024 >= F.lit(max(int(total), 1))
    heavy, light = index.filter(hot), index.filter(~hot)
    near = rows.join(F.broadcast(heavy), on)
    far = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return near.unionByName(far)
