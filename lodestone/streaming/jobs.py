"""Incremental jobs as Structured Streaming. Watermarks bound the state; within them a stream gives what the batch job gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.functions import columns as c
from lodestone.operators.listings import upsert
from lodestone.operators.series import productivity_columns


def stream_unseen(hits: DataFrame, ts: str, horizon: str = "7 days", url: str = "url") -> DataFrame:
    """First hit of each canonical URL within the horizon."""
    return hits.withColumn("canonical_url", c.canonical_url(F.col(url))).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["canonical_url"])


def stream_productivity(events: DataFrame, ts: str | None = None, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Running counters per source, or per source and tumbling window where ts is given."""
    keys = [F.lower(F.trim("source")).alias("source")]
    if ts:
        events = events.withWatermark(ts, late)
        keys = [F.window(ts, width).alias("w"), *keys]
    names = {"unique": "view", "qualified": "purchase", "duplicate": "click", "rejected": "error", "verified": "signup"}
    return events.groupBy(*keys).agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in names.items()])


def scored(counters: DataFrame) -> DataFrame:
    """Rates and score from counters, for foreachBatch or the output table."""
    return counters.withColumns(productivity_columns(*[F.col(k) for k in ("unique", "qualified", "duplicate", "rejected", "verified")]))


def stream_signals(events: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Running weight per user and action type."""
    weight = F.lit(0.0)
    for action, w in weights.items():
        weight = F.when(F.col("action") == action, w).otherwise(weight)
    return events.groupBy("user_id", "action").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def stream_telemetry(events: DataFrame, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "source", "event_type").agg(F.count("*").alias("events"))


DAY_MS = 24 * 3600 * 1000


class InOrder(StatefulProcessor):
    """Rows of a key in order of seq. Rows at or before the last one seen are repeats and change nothing."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long", self.keep_ms)
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values("seq").drop_duplicates("seq")
        if self.seen.exists():
            whole = whole[whole["seq"] > self.seen.get()[0]]
        if len(whole):
            self.seen.update((int(whole["seq"].iloc[-1]),))
            yield self.step(key[0], whole)

    def close(self) -> None:
        pass


class Streaks(InOrder):
    """Length of the run of low rows that each row ends."""

    def __init__(self, limit: int, keep_ms: int):
        super().__init__(keep_ms)
        self.limit = limit

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak long", self.keep_ms)

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        streak = self.streak.get()[0] if self.streak.exists() else 0
        out = []
        for seq, low in zip(rows["seq"], rows["low"]):
            streak = streak + 1 if low else 0
            out.append((key, seq, streak, streak >= self.limit))
        self.streak.update((streak,))
        return pd.DataFrame(out, columns=["run_id", "seq", "streak", "alert"])


class Changes(InOrder):
    """What differs from the snapshot before: status, else price; and the headlines that it did not have."""

    def __init__(self, keep_ms: int, least: float, share: bool):
        super().__init__(keep_ms)
        self.least = least
        self.share = share

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string, price double", self.keep_ms)
        self.news = handle.getMapState("news", "headline string", "seq long", self.keep_ms)

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        last = self.last.get() if self.last.exists() else None
        before = {k[0] for k in self.news.keys()} if last is not None else set()
        held, out = before, []
        for row in rows.to_dict("records"):
            told = row.get("news")
            now = list(dict.fromkeys(x for x in (told if told is not None else []) if x is not None))
            if last is not None:
                if row["state"] != last[0]:
                    out.append((key, row["seq"], "status", None))
                elif abs(row["price"] - last[1]) > self.least * (abs(last[1]) if self.share else 1):
                    out.append((key, row["seq"], "price", None))
                out += [(key, row["seq"], "headline", x) for x in now if x not in held]
            last, held = (row["state"], float(row["price"])), set(now)
        self.last.update(last)
        for x in before - held:
            self.news.removeKey((x,))
        for x in held:  # all of them, so that they expire together
            self.news.updateValue((x,), (int(rows["seq"].iloc[-1]),))
        return pd.DataFrame(out, columns=["target", "seq", "change", "headline"]).astype({"seq": "int64"})


def keyed_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """A stateful job per key. Typed states that expire live in the RocksDB provider, which is set here: memory doesn't bound their number."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def stream_streak(rows: DataFrame, limit: int = 5, keep_days: float = 30) -> DataFrame:
    """run_id, seq, streak, alert for each row (run_id, seq, low); repeats give nothing. A run's state goes keep_days after its last row."""
    return keyed_state(rows, "run_id", Streaks(limit, int(keep_days * DAY_MS)), "run_id string, seq long, streak long, alert boolean")


def stream_changes(rows: DataFrame, keep_days: float = 90, least: float = 0.001, share: bool = False) -> DataFrame:
    """target, seq, change, headline for snapshots (target, seq, state, price and, if there, news: an array of headlines).

    A change is `status`, else `price` (by over least: an amount, or with share a share of the price before), and `headline` for each headline that the snapshot before did not have.
    Repeats give nothing. A target's state (its last snapshot, the headlines as a map) goes keep_days after its last row.
    """
    return keyed_state(rows, "target", Changes(int(keep_days * DAY_MS), least, share), "target string, seq long, change string, headline string")


def stream_upsert(stream: DataFrame, path: str, keys: list[str], order: str, keep: list[str] = ()) -> StreamingQuery:
    """Merges a stream into the table under path, whatever is read again or restarted: upsert() of listings for each batch.

    Each batch writes the merged table as a new version named by the batch's id; the writer's mark of success makes it count. A
    batch that was cut off is merged again into the version before it, which it never touched; one that ran to its end is
    passed over. So restarts neither lose nor repeat rows. Versions before the last two are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = versions(spark, path)
        before = [v for v in done if v < batch_id]
        if batch_id in done:
            return  # it ran to its end before the stream stopped
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{before[-1]}") if before else batch.limit(0)
        upsert(old, batch, keys, list(keep), order).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in before[:-1]:
            remove(spark, f"{path}/v{v}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start()


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Ids of the versions that were written to their end, in order."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
    return sorted(int(name[1:]) for name, full in names if name[1:].isdigit() and name[0] == "v" and fs.exists(file_system(spark, f"{full}/_SUCCESS")[0]))


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that stream_upsert() keeps under path: its last whole version."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")


def run_available(stream: DataFrame, path: str, mode: str = "append", empty_batches: bool = True) -> DataFrame:
    """Runs a stream over what is there, into a table under path; complete mode keeps the last state.

    empty_batches: batches without rows, which close windows. State that expires by the clock asks for one after the other, so
    its jobs run without them; what has expired goes with the next run's rows.
    """
    spark = stream.sparkSession
    out, marks = f"{path}/out", f"{path}/marks"
    write = stream.writeStream.option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True)
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, str(empty_batches).lower())
    try:
        query = write.format("parquet").option("path", out).start() if mode == "append" else write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    finally:
        spark.conf.set(name, was)  # the query keeps the session it began with
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
