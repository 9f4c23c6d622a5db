"""Queries over price series and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle, table
from lodestone.operators import series as m


def bars(s, d):
    return carrier(s, d, "bars")


def tele(s, d):
    return carrier(s, d, "telemetry")


def cands(s, d):
    return table(s, d, "part").selectExpr("p_partkey AS k", "concat('P', p_partkey) AS symbol", "CASE p_partkey % 5 WHEN 0 THEN 'Banking' WHEN 1 THEN 'Retail' WHEN 2 THEN NULL WHEN 3 THEN 'Mining' ELSE 'Energy' END AS sector", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 25 AS DOUBLE) - 5 END AS change_1w", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 23 AS DOUBLE) / 10 END AS volume_ratio", "CAST(p_partkey * 7 % 100 AS DOUBLE) AS rsi", "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_retailprice END AS price", "CAST(1200 AS DOUBLE) AS sma20", "CAST(p_partkey % 3 - 1 AS DOUBLE) AS histogram", "CAST(p_partkey % 30 - 5 AS DOUBLE) AS revenue_growth", "CAST(p_partkey % 40 - 10 AS DOUBLE) AS profit_growth", "CAST(p_partkey % 60 AS DOUBLE) AS pe_ratio", "CASE WHEN p_size < 5 THEN array('debt') END AS risk_factors", "CASE WHEN p_size = 7 THEN array('a', 'b') ELSE array() END AS conflicts", "CASE WHEN p_size > 45 THEN array('split') END AS corporate_actions", "CASE WHEN p_size > 40 THEN array('x', 'y') END AS news_events")


def proof(s, d):
    """One piece of evidence for each order line of a part."""
    return table(s, d, "lineitem").selectExpr("concat('P', l_partkey) AS symbol", "l_linenumber % 4 + 1 AS tier", "CASE WHEN l_discount > 0.095 THEN 'bearish' WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'bullish' ELSE 'neutral' END AS sentiment", "CASE WHEN l_linestatus = 'F' THEN 'NEWS' ELSE 'OTHER' END AS claim_type", "CASE WHEN l_quantity < 3 THEN CASE l_linenumber WHEN 1 THEN 'Momentum builds' WHEN 2 THEN 'A breakout' WHEN 3 THEN 'Sector note' ELSE 'Support holds' END END AS claim", "l_quantity = 50 AS is_counter", "concat('s', l_suppkey % 3) AS source", "l_tax > 0.065 AS is_placeholder")


def calls(s, d):
    return table(s, d, "events").selectExpr("'source' || CAST(user_id % 15 AS STRING) AS source", "CAST(floor(value) AS BIGINT) AS results", "CASE WHEN event_type = 'error' AND user_id % 15 > 3 THEN CASE event_id % 4 WHEN 0 THEN 'Read timeout' WHEN 1 THEN 'HTTP 403' WHEN 2 THEN '429 Too Many' ELSE 'boom' END END AS error", "event_id % 100 AS latency")


LOW = lambda: F.col("n") < 20
QUERIES = {
    "f2_sma": lambda s, d: m.sma(bars(s, d), 20).select("symbol", "ts", F.round("sma", 4).alias("sma")),
    "f3_ema": lambda s, d: m.ema(bars(s, d), 12).select("symbol", F.round("ema", 4).alias("ema")),
    "f4_rsi": lambda s, d: m.rsi(bars(s, d)).select("symbol", F.round("rsi", 6).alias("rsi")),
    "f5_macd": lambda s, d: m.macd(bars(s, d)).select("symbol", *[F.round(x, 4).alias(x) for x in ("line", "signal", "histogram")]),
    "f6_atr": lambda s, d: m.atr(bars(s, d)).select("symbol", F.round("atr", 4).alias("atr")),
    "f7_volume_ratio": lambda s, d: m.volume_ratio(bars(s, d)).select("symbol", F.round("ratio", 6).alias("ratio")),
    "f8_weekly_return": lambda s, d: m.weekly_return(bars(s, d)).select("symbol", F.round("change", 6).alias("change")),
    "f9_low_yield_streak": lambda s, d: m.low_yield_streak(tele(s, d), "run_id", "seq", LOW()).select("run_id", "seq", "streak", "alert"),
    "f10_latest_state": lambda s, d: m.latest_state(tele(s, d), "run_id", "seq").select("run_id", "seq", "event_type"),
    "e2_source_productivity": lambda s, d: m.source_productivity(tele(s, d)).select("source", "unique", "qualified", *[F.round(c, 9).alias(c) for c in ("qualified_yield", "duplicate_rate", "rejection_rate", "productivity")]),
    "e11_search_yield": lambda s, d: m.search_yield(tele(s, d), ["run_id"], "n", "k").select("run_id", "hits", "new", "yield"),
    "e12_source_health": lambda s, d: m.source_health(calls(s, d)).select("source", "queries", "results", "errors", F.array_join("kinds", ",").alias("kinds"), F.round("latency", 6).alias("latency"), "state"),
    "g5_prioritize_sources": lambda s, d: m.prioritize(tele(s, d).selectExpr("seq", "source", "k AS priority"), m.source_productivity(tele(s, d).filter("source <> 'source3'"))).select("seq", "source", F.round("productivity", 9).alias("productivity")),
    "i13_dedupe_tasks": lambda s, d: m.dedupe_tasks(tele(s, d).select("source", "event_type", "k", "seq", "run_id"), ["source", "event_type", "k"], "seq"),
    "l6_crawl_telemetry": lambda s, d: m.crawl_telemetry(tele(s, d)),
    "l4_snapshot_changes": lambda s, d: m.snapshot_changes(table(s, d, "events"), "user_id", "ts", "event_type", "value").select("event_id", "change"),
    "l4_new_headlines": lambda s, d: m.new_headlines(table(s, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("news")), "conv_id", "turn", "news"),
    "k1_score_candidates": lambda s, d: m.score_candidates(cands(s, d), proof(s, d)).select("symbol", "score", "confidence", "direction"),
    "g2_rank_candidates": lambda s, d: m.rank_candidates(m.score_candidates(cands(s, d), proof(s, d))).select("symbol", F.round("rank_score", 6).alias("rank_score")),
    "h4_watchlist_split": lambda s, d: m.watchlist_split(m.score_candidates(cands(s, d), proof(s, d)), 10).select("symbol", "watch"),
    "e15_coverage_verdict": lambda s, d: m.coverage_verdict(m.score_candidates(cands(s, d), proof(s, d)), 10),
}

NUM = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c0 FROM bars)"
KEEP = "(13.0::DOUBLE / 14)"


def wilder(x: str) -> str:
    return f"sum(({x}) * CASE WHEN i - 1 <= 14 THEN pow({KEEP}, n - 15) / 14 ELSE (1 - {KEEP}) * pow({KEEP}, n - i) END)"


SCORED = """
WITH c AS (SELECT p_partkey AS k, 'P' || p_partkey AS symbol, CASE p_partkey % 5 WHEN 0 THEN 'Banking' WHEN 1 THEN 'Retail' WHEN 3 THEN 'Mining' WHEN 4 THEN 'Energy' END AS sector, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 25 AS DOUBLE) - 5 END AS w, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 23 END AS v, p_partkey * 7 % 100 AS r, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_retailprice END AS p, p_partkey % 3 AS h, p_partkey % 30 - 5 AS rg, p_partkey % 40 - 10 AS pg, p_partkey % 60 AS pe, CASE WHEN p_size < 5 THEN 4 ELSE 0 END + CASE WHEN p_size = 7 THEN 10 ELSE 0 END AS own_risk, p_size = 7 AS torn, CASE WHEN p_size > 45 THEN 11 WHEN p_size > 40 THEN 6 ELSE 0 END AS ev FROM part),
e AS (SELECT 'P' || l_partkey AS symbol, count(*) AS n, count(DISTINCT l_suppkey % 3) AS src, count(*) FILTER (l_linenumber % 4 = 0) AS t1, count(*) FILTER (l_linenumber % 4 = 1) AS t2, count(*) FILTER (l_discount <= 0.095 AND l_returnflag = 'A' AND l_quantity > 40 AND l_linestatus = 'F') AS good, count(*) FILTER ((l_discount > 0.095 OR l_quantity = 50) AND l_tax <= 0.065) AS bad,
 bool_or(l_quantity < 3 AND l_linenumber = 1) AS cm, bool_or(l_quantity < 3 AND l_linenumber = 2) AS cb, bool_or(l_quantity < 3 AND l_linenumber = 3) AS cs, bool_or(l_quantity < 3 AND l_linenumber > 3) AS cl FROM lineitem GROUP BY 1),
j AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(src, 0) AS src, coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(cm, false) AS cm, coalesce(cb, false) AS cb, coalesce(cs, false) AS cs, coalesce(cl, false) AS cl FROM c LEFT JOIN e ON e.symbol = c.symbol),
t AS (SELECT *, least(20, bad * 3 + own_risk) AS risk, CAST(CASE WHEN w IS NULL THEN CASE WHEN cm THEN 10 ELSE 0 END WHEN w BETWEEN 1 AND 8 THEN 16 + least(4, (w - 1) / 7 * 4) WHEN w > 8 AND w <= 15 THEN 15 WHEN w > 15 THEN 10 WHEN w >= 0 THEN 8 WHEN w >= -3 THEN 4 ELSE 0 END AS DOUBLE)
 + CASE WHEN v IS NULL THEN CASE WHEN cb THEN 7 ELSE 0 END WHEN v >= 20 THEN 15 WHEN v >= 15 THEN 12 WHEN v >= 11 THEN 8 WHEN v >= 8 THEN 5 ELSE 2 END + least(20, CASE WHEN r BETWEEN 50 AND 68 THEN 10 WHEN r BETWEEN 40 AND 49 THEN 6 WHEN r BETWEEN 69 AND 75 THEN 5 ELSE 2 END + CASE WHEN p IS NULL THEN CASE WHEN cb OR cl THEN 6 ELSE 0 END WHEN p > 1200 THEN 7 ELSE 1 END + CASE WHEN h = 2 THEN 3 ELSE 0 END)
 + CASE WHEN sector IS NULL THEN CASE WHEN cs THEN 8 ELSE 4 END WHEN sector IN ('Banking', 'Energy') THEN 12 ELSE 8 END + least(15, CASE WHEN ev > 0 THEN ev ELSE good * 4 END) + greatest(0, least(10, 5 + CASE WHEN rg > 15 THEN 3 WHEN rg < 0 THEN -2 ELSE 0 END + CASE WHEN pg > 15 THEN 2 WHEN pg < 0 THEN -2 ELSE 0 END + CASE WHEN pe BETWEEN 10 AND 40 THEN 1 ELSE 0 END))
 + least(5, CASE WHEN t1 > 0 THEN 2.5 ELSE 0 END + CASE WHEN t2 >= 2 THEN 2 WHEN t2 = 1 THEN 1 ELSE 0 END + CASE WHEN src >= 3 THEN 0.5 ELSE 0 END) AS raw, CASE WHEN (t1 > 0 OR t2 >= 2) AND src >= 3 AND n >= 3 THEN 'HIGH' WHEN src >= 2 AND n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM j),
z AS (SELECT *, greatest(0, least(100, round_even(raw - risk, 1))) AS score FROM t)"""
PROD = """p AS (SELECT lower(trim(source)) AS source, count(*) FILTER (event_type = 'view') AS u, count(*) FILTER (event_type = 'purchase') AS q, count(*) FILTER (event_type = 'click') AS dup, count(*) FILTER (event_type = 'error') AS r, count(*) FILTER (event_type = 'signup') AS v FROM telemetry {0} GROUP BY 1),
 y AS (SELECT source, u AS "unique", q AS qualified, q / greatest(u, 1) AS qualified_yield, dup / greatest(u + dup, 1) AS duplicate_rate, r / greatest(v + r, 1) AS rejection_rate, CASE WHEN q > 0 THEN 1 + 2 * q / greatest(u, 1) WHEN dup > 0 AND u = 0 THEN 0.05 WHEN r > 0 OR dup > 0 THEN 0.2 ELSE 1 END AS base FROM p),
 x AS (SELECT *, greatest(base - 0.4 * duplicate_rate - 0.3 * rejection_rate, 0.05) AS productivity FROM y)"""

ORACLES = {
    "f2_sma": oracle("SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END, 4) AS sma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "bars"),
    "f5_macd": oracle("""WITH c AS (SELECT symbol, list(close ORDER BY ts) AS x FROM bars GROUP BY 1), e AS (SELECT symbol, x, list_reduce(list_concat([[avg12]], list_transform(x[13:], lambda v: [v])), lambda a, b: list_append(a, a[-1] + (b[1] - a[-1]) * 2 / 13)) AS f, list_reduce(list_concat([[avg26]], list_transform(x[27:], lambda v: [v])), lambda a, b: list_append(a, a[-1] + (b[1] - a[-1]) * 2 / 27)) AS s FROM (SELECT *, list_avg(x[1:12]) AS avg12, list_avg(x[1:26]) AS avg26 FROM c)),
 l AS (SELECT symbol, len(x) AS n, list_transform(list_zip(f[15:], s), lambda z: z[1] - z[2]) AS d FROM e), g AS (SELECT symbol, n, d[-1] AS line, list_reduce(list_concat([list_avg(d[1:9])], d[10:]), lambda a, b: a + (b - a) * 2 / 10) AS signal FROM l)
 SELECT symbol, CASE WHEN n >= 35 THEN round(line, 4) END AS line, CASE WHEN n >= 35 THEN round(signal, 4) END AS signal, CASE WHEN n >= 35 THEN round(line - signal, 4) END AS histogram FROM g""", "bars"),
    "f3_ema": oracle(f"WITH {NUM} SELECT symbol, round(sum(close * CASE WHEN i <= 12 THEN pow(11.0::DOUBLE / 13, n - 12) / 12 ELSE 2.0::DOUBLE / 13 * pow(11.0::DOUBLE / 13, n - i) END), 4) AS ema FROM n GROUP BY 1", "bars"),
    "f4_rsi": oracle(f"WITH {NUM}, g AS (SELECT symbol, {wilder('greatest(close - c0, 0)')} AS up, {wilder('greatest(c0 - close, 0)')} AS dn FROM n WHERE i > 1 GROUP BY 1) SELECT symbol, round(CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END, 6) AS rsi FROM g", "bars"),
    "f6_atr": oracle(f"WITH {NUM} SELECT symbol, round({wilder('greatest(high - low, abs(high - c0), abs(low - c0))')}, 4) AS atr FROM n WHERE i > 1 GROUP BY 1", "bars"),
    "f7_volume_ratio": oracle("SELECT symbol, round(arg_max(volume, ts) / avg(volume), 6) AS ratio FROM bars GROUP BY 1", "bars"),
    "f8_weekly_return": oracle(f"WITH {NUM} SELECT symbol, round((max(CASE WHEN i = n THEN close END) / max(CASE WHEN i = n - 4 THEN close END) - 1) * 100, 6) AS change FROM n GROUP BY 1", "bars"),
    "f9_low_yield_streak": oracle("WITH a AS (SELECT run_id, seq, n < 20 AS low, sum(CASE WHEN n < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS isl FROM telemetry), b AS (SELECT run_id, seq, CAST(sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, isl ORDER BY seq) AS BIGINT) AS streak FROM a) SELECT *, streak >= 5 AS alert FROM b", "telemetry"),
    "f10_latest_state": oracle("SELECT run_id, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM telemetry GROUP BY 1", "telemetry"),
    "e2_source_productivity": oracle("WITH " + PROD.format("") + ' SELECT source, "unique", qualified, round(qualified_yield, 9) AS qualified_yield, round(duplicate_rate, 9) AS duplicate_rate, round(rejection_rate, 9) AS rejection_rate, round(productivity, 9) AS productivity FROM x', "telemetry"),
    "e11_search_yield": oracle("SELECT run_id, CAST(sum(n) AS BIGINT) AS hits, CAST(sum(k) AS BIGINT) AS new, CASE WHEN sum(n) > 0 THEN round_even(sum(k) / sum(n), 3) ELSE 0 END AS \"yield\" FROM telemetry GROUP BY 1", "telemetry"),
    "e12_source_health": "WITH c AS (SELECT 'source' || (user_id % 15) AS source, CAST(floor(value) AS BIGINT) AS results, CASE WHEN event_type = 'error' AND user_id % 15 > 3 THEN CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'blocked' WHEN 2 THEN 'rate_limited' ELSE 'error' END END AS kind, event_id % 100 AS latency FROM events) SELECT source, count(*) AS queries, CAST(sum(results) AS BIGINT) AS results, count(kind) AS errors, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), ','), '') AS kinds, round(avg(latency), 6) AS latency, CASE WHEN count(kind) = 0 THEN 'healthy' WHEN count(kind) < count(*) THEN 'degraded' ELSE 'failing' END AS state FROM c GROUP BY 1",
    "g5_prioritize_sources": oracle("WITH " + PROD.format("WHERE source <> 'source3'") + " SELECT t.seq, t.source, round(coalesce(productivity, 1.0), 9) AS productivity FROM telemetry t LEFT JOIN x ON x.source = t.source", "telemetry"),
    "i13_dedupe_tasks": oracle("SELECT source, event_type, k, min(seq) AS seq, arg_min(run_id, seq) AS run_id FROM telemetry GROUP BY ALL", "telemetry"),
    "l6_crawl_telemetry": oracle("SELECT date_trunc('hour', ts) AS start, source, event_type, count(*) AS events FROM telemetry GROUP BY ALL", "telemetry"),
    "l4_snapshot_changes": "WITH a AS (SELECT *, lag(event_type) OVER w AS o, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT event_id, CASE WHEN event_type <> o THEN 'status' WHEN abs(value - p) > 0.001 THEN 'price' END AS change FROM a WHERE o IS NOT NULL) SELECT * FROM b WHERE change IS NOT NULL",
    "l4_new_headlines": "WITH a AS (SELECT conv_id, turn, string_split(text, ' ') AS w, lag(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT DISTINCT conv_id, turn, u.headline FROM a, LATERAL (SELECT unnest(w) AS headline) u WHERE i > 1 AND NOT list_contains(coalesce(p, []), u.headline)",
    "k1_score_candidates": SCORED + " SELECT symbol, score, confidence, CASE WHEN n < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN risk >= 16 THEN 'HIGH_RISK' WHEN risk >= 12 OR torn THEN 'MIXED' WHEN score >= 65 AND confidence <> 'LOW' THEN 'POSITIVE' WHEN score < 40 THEN 'NEGATIVE' ELSE 'MIXED' END AS direction FROM z",
    "g2_rank_candidates": SCORED + " SELECT symbol, round(score + CASE confidence WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END, 6) AS rank_score FROM z",
    "h4_watchlist_split": SCORED + ", f AS (SELECT *, confidence <> 'LOW' OR score >= 45 AS fit FROM z) SELECT symbol, CASE WHEN (SELECT bool_or(fit) FROM f) THEN fit ELSE row_number() OVER (ORDER BY score DESC, symbol) <= 10 END AS watch FROM f",
    "e15_coverage_verdict": SCORED + ", k AS (SELECT count(*) AS candidates, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(DISTINCT sector) AS sectors FROM z) SELECT *, CASE WHEN high + medium >= 10 AND sectors >= 3 THEN 'REQUEST_SATISFIED' WHEN candidates >= 10 AND high >= 3 THEN 'SUFFICIENT_EVIDENCE' WHEN candidates >= 10 AND high + medium > 0 THEN 'DIMINISHING_EVIDENCE_YIELD' WHEN candidates > 0 AND sectors >= 4 THEN 'DIMINISHING_CANDIDATE_YIELD' ELSE 'SUFFICIENT_EVIDENCE' END AS verdict FROM k",
}
