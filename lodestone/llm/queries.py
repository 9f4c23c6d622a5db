"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, clustering, exact_dedup, fill_middle, line_dedup, mixing, passages, pii, repetition, simhash, suffix_dedup, token_counts, token_records
from lodestone.llm.common import documents

TOKENIZER = "word_bpe_49k.json"
COUNTED = "byte_bpe_50k.json"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    tokenizer = public_tokenizers.path(TOKENIZER)
    return {
        "op1_bpe": lambda s, d: bpe.op1(documents(s, d), tokenizer),
        "op2_exact_dedup": lambda s, d: exact_dedup.op2(documents(s, d)),
        "op3_mixing": lambda s, d: mixing.op3(documents(s, d)),
        "op4_quality": lambda s, d: repetition.op4(documents(s, d)),
        "op5_suffix_dedup": lambda s, d: suffix_dedup.op5(documents(s, d)),
        "op6_line_dedup": lambda s, d: line_dedup.op6(documents(s, d)),
        "op7_pii": lambda s, d: pii.op7(documents(s, d)),
        "op8_simhash": lambda s, d: simhash.op8(documents(s, d)),
        "op9_token_records": lambda s, d: token_records.op9(documents(s, d), tokenizer),
        "op10_passages": lambda s, d: passages.op10(documents(s, d)),
        "op11_clustering": lambda s, d: clustering.op11(s.read.parquet(f"{d}/embeddings.parquet")),
        "op12_fill_middle": lambda s, d: fill_middle.op12(documents(s, d)),
        "op13_token_counts": lambda s, d: token_counts.op13(documents(s, d), public_tokenizers.path(COUNTED)),
    }


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
"""


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


def op11_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """Every round as two CTEs: the nearest centroid of each vector, then the floors of the means."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    floors = "[" + ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, dims + 1)) + "]"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS j, x FROM v QUALIFY j < {k})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT v.r AS r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, arg_min(c.j, {gap} * {k} + c.j) AS j, min({gap}) AS d FROM v CROSS JOIN c{n} c GROUP BY v.r)")
        if n < rounds:
            ctes.append(f"m{n} AS (SELECT j, {floors} AS x FROM a{n} GROUP BY j)")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j AS j, coalesce(list_transform(m.x, lambda e: CAST(e AS BIGINT)), c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.j = c.j)")
    last = f"a{rounds}"
    return f"WITH {', '.join(ctes)} SELECT vec_id, CAST(a.j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON c.j = a.j"


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op11_clustering": op11_sql(), "op12_fill_middle": OP12_SQL}
