"""Keyed streams over several runs: repeats, restarts and expiry."""

import os
import time

import pytest

from lodestone.streaming import jobs

LOW = "run_id string, seq long, low boolean"
SNAP = "target string, seq long, state string, price double, news array<string>"
ROW = "k long, at long, name string, first string"


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def seen(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_streak_over_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "w")
    add(spark, src, [("a", 1, True), ("a", 2, True), ("b", 1, False)], LOW)
    run = lambda: {tuple(r) for r in jobs.run_available(jobs.stream_streak(seen(spark, src, LOW), limit=3), out, empty_batches=False).collect()}
    assert run() == {("a", 1, 1, False), ("a", 2, 2, False), ("b", 1, 0, False)}
    add(spark, src, [("a", 2, True), ("a", 1, True), ("a", 3, True), ("b", 2, True)], LOW)  # two rows come again
    assert run() == {("a", 1, 1, False), ("a", 2, 2, False), ("b", 1, 0, False), ("a", 3, 3, True), ("b", 2, 1, False)}


def test_streak_expires(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "w")
    add(spark, src, [("a", 1, True), ("a", 2, True)], LOW)
    run = lambda: {tuple(r) for r in jobs.run_available(jobs.stream_streak(seen(spark, src, LOW), keep_days=0.5 / 86400), out, empty_batches=False).collect()}
    run()
    time.sleep(2)
    add(spark, src, [("a", 3, True)], LOW)
    assert ("a", 3, 1, False) in run()


def test_changes_and_headlines_over_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "w")
    add(spark, src, [("t", 1, "up", 1.0, ["x", "y"]), ("t", 2, "up", 1.0005, ["y", "z", None, "z"])], SNAP)
    run = lambda: sorted((tuple(r) for r in jobs.run_available(jobs.stream_changes(seen(spark, src, SNAP)), out, empty_batches=False).collect()), key=str)
    assert run() == [("t", 2, "headline", "z")]
    add(spark, src, [("t", 2, "up", 9.0, ["q"]), ("t", 3, "down", 5.0, ["z", "x"]), ("t", 4, "down", 6.0, None)], SNAP)
    assert run() == sorted([("t", 2, "headline", "z"), ("t", 3, "headline", "x"), ("t", 3, "status", None), ("t", 4, "price", None)], key=str)


def last_commit(out):
    folder = os.path.join(out, "marks", "commits")
    return folder, max(int(n) for n in os.listdir(folder) if n.isdigit())


@pytest.mark.parametrize("cut_off", [False, True])
def test_upsert_survives_restarts(spark, tmp_path, cut_off):
    """A stream that stops before it marks its batch done, with the batch's table written or cut off, merges it once."""
    src, out = str(tmp_path / "in"), str(tmp_path / "w")
    run = lambda: jobs.stream_upsert(seen(spark, src, ROW), out, ["k"], "at", keep=["first"]).awaitTermination()
    table = lambda: sorted(tuple(r) for r in jobs.upserted(spark, out).collect())
    add(spark, src, [(1, 1, "a", "f1"), (2, 1, "b", "f2")], ROW)
    run()
    add(spark, src, [(1, 2, "c", "x"), (3, 2, "d", "f3")], ROW)
    run()
    want = [(1, 2, "c", "f1"), (2, 1, "b", "f2"), (3, 2, "d", "f3")]
    assert table() == want
    folder, batch = last_commit(out)
    for name in (str(batch), f".{batch}.crc"):
        if os.path.exists(os.path.join(folder, name)):
            os.remove(os.path.join(folder, name))
    if cut_off:
        for name in os.listdir(os.path.join(out, f"v{batch}")):
            if name in ("_SUCCESS", "._SUCCESS.crc"):
                os.remove(os.path.join(out, f"v{batch}", name))
    run()  # the batch comes again
    assert table() == want
    add(spark, src, [(2, 5, "e", "x")], ROW)
    run()
    assert table() == [(1, 2, "c", "f1"), (2, 5, "e", "f2"), (3, 2, "d", "f3")]
    assert len(jobs.versions(spark, out)) <= 2
