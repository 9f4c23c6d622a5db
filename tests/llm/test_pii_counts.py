"""Counts by kind of op7: each span counts for its own kind, wherever it stands among the spans."""

from lodestone.llm import pii


def test_each_kind_counts_its_spans(spark):
    rows = [
        (1, "ip 1.2.3.4 then a@b.co", (1, 1, 0, 0)),
        (2, "+1 555 123 4567 and 5.6.7.8 and c@d.org, e@f.net", (2, 1, 0, 1)),
        (3, "4111 1111 1111 1111, 4111111111111111", (0, 0, 2, 0)),
        (4, None, (0, 0, 0, 0)),
        (None, "a@b.co c@d.co e@f.co", (3, 0, 0, 0)),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.op7(docs).collect()}
    assert got == {i: n for i, _, n in rows}
