"""Cases that differed from their SQL: ASCII words, tables in folders, shares of a price, references without a semicolon."""

import pytest

from lodestone.carriers import sources
from lodestone.operators import evidence
from lodestone.sources import payloads
from lodestone.streaming import jobs


def test_words_end_at_other_letters(spark):
    docs = spark.createDataFrame([(1, "äund x"), (2, "lund"), (3, "UND"), (4, "und_x"), (5, "undé")], "doc_id long, text string")
    found = evidence.sentiment_evidence(docs, r"\bthe\b", r"\bund\b")
    assert sorted((r["doc_id"], r["sentiment"]) for r in found.collect()) == [(1, "bearish"), (3, "bearish"), (5, "bearish")]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_in_folders(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"https://x.org/{i % 5}") for i in range(30)], "page_id long, url string")
    rows.repartition(files).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    read = sources.stream(spark, str(tmp_path / "in"), "pages")
    assert jobs.run_available(read, str(tmp_path / "out")).count() == 30


def test_price_changes_as_a_share(spark, tmp_path):
    snap = "target string, seq long, state string, price double"
    src = str(tmp_path / "in")
    spark.createDataFrame([("t", 1, "up", 50.0), ("t", 2, "up", 50.04), ("t", 3, "up", 50.2), ("u", 1, "up", 0.1), ("u", 2, "up", 0.1005)], snap).write.parquet(src)
    run = lambda name, **k: sorted((r["target"], r["seq"]) for r in jobs.run_available(jobs.stream_changes(spark.readStream.schema(snap).parquet(src), **k), str(tmp_path / name), empty_batches=False).collect())
    assert run("share", share=True) == [("t", 3), ("u", 2)]
    assert run("amount") == [("t", 2), ("t", 3)]


def test_references_need_their_semicolon(spark):
    script = '<script type="application/ld+json">{"@type": "JobPosting", "title": "R&D &amp &#38; x"}</script>'
    pages = spark.createDataFrame([(1, f"<html><title>a &&&amp</title>{script}<p>x &copy y &amp; z&nbsp;&lt &#65; &amp;#38;</p></html>"), (2, "<p>out</p><article>" + ("ab\n\n\n\n" * 60) + "</article>")], "page_id long, html string")
    one, two = payloads.page_text(pages).orderBy("page_id").collect()
    assert one["title"] == "a &&&amp"
    assert one["text"] == "a &&&amp\nx &copy y & z &lt A &#38;"
    assert one["snippets"] == ['{"@type": "JobPosting", "title": "R&D &amp &#38; x"}']
    assert two["text"].startswith("out\n")
