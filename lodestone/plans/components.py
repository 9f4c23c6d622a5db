"""Connected components of a link table by min-label hooking and pointer jumping.

Every round joins labels along links, takes the smallest per node (a partial aggregate merges a hub's messages before
the shuffle), then replaces each label by the label of its label, so long chains halve each round. Rounds are cut by
tables in the shared folder; nothing but the number of changed nodes reaches the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one on a local master where that is unset (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a write as soon as it has ended, instead of when the driver next collects garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node that has a link: node, component (the smallest node reachable). Nulls and self-links are dropped."""
    one = links.select(F.col(a).alias("node"), F.col(b).alias("peer")).filter("node <> peer")
    both = cut(one.unionByName(one.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct(), "links")
    labels = cut(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("component")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("peer"), "component"), "peer").select("node", "component")
        hooked = told.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        jumped = hooked.join(labels.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.least("component", "next").alias("component"))
        after = cut(jumped, "labels")
        moved = after.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").limit(1).count()
        labels = after
        if not moved:
            return labels
