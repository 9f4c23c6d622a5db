"""Repeated blocks of lines against brute force, whatever chunk boundaries fall where."""

import random

from lodestone.llm import line_dedup


def brute_force(texts):
    """The text of each document without the lines of pairs seen earlier."""
    seen, left = {}, {}
    for i, text in sorted(texts.items()):
        lines, gone = text.split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip():
                first = seen.setdefault(pair, (i, k))
                if first != (i, k):
                    gone |= {k + 1} if first == (i, k - 1) else {k, k + 1}
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return left


def test_blocks_match_brute_force(spark):
    rnd = random.Random(3)
    own = iter(range(10**6))
    blocks = [[f"shared {b} {k}" for k in range(2 + b % 3)] for b in range(30)]
    texts = {i: "\n".join([f"own {next(own)}" for _ in range(rnd.randint(0, 3))] + rnd.choice(blocks) + [f"own {next(own)}" for _ in range(rnd.randint(0, 3))]) for i in range(90)}
    texts |= {90: "a\na\na\na", 91: "x\n\n \ny", 92: "z\n\n \ny\na\na", 93: "one\ntwo\none\ntwo\none\ntwo", 94: "alone"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_dedup.dedup_blocks(docs).collect()}
    want = brute_force(texts)
    assert {i: r["text"] for i, r in found.items()} == want
    for i, r in found.items():
        left = len(want[i].split("\n")) if want[i] else 0
        assert r["n_removed_lines"] == len(texts[i].split("\n")) - left
    assert sum(r["n_removed_lines"] for r in line_dedup.op6(docs).collect()) == sum(r["n_removed_lines"] for r in found.values())
    assert sum(r["n_removed_lines"] for r in line_dedup.dedup_lines(docs).collect()) < sum(r["n_removed_lines"] for r in found.values())


def test_clashing_columns_and_long_runs(spark):
    rows = [(1, "a\nb\nc", 7, 8, 9, "x", 5), (2, "z\na\nb\nc", 7, 8, 9, "y", 5), (3, "\n".join(["same"] * 1000), 7, 8, 9, "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h int, __id int, __removed int, chunks string, d int")
    for done in (line_dedup.dedup_blocks(docs), line_dedup.dedup_lines(docs)):
        assert done.columns == [*docs.columns, "n_lines", "n_removed_lines", "n_removed_chunks"]
        assert {r["doc_id"]: tuple(r)[2:7] for r in done.collect()} == {r[0]: r[2:] for r in rows}
    chunks = line_dedup.with_chunks(docs.select("doc_id", "text"), docs["text"]).filter("doc_id = 3").first()["chunks"]
    assert [c["n_lines"] for c in chunks] == [64] * 15 + [40] or all(2 <= c["n_lines"] <= 65 for c in chunks)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_blocks(docs).collect()} == brute_force({r[0]: r[1] for r in rows})
