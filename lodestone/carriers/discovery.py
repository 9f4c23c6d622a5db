"""Queries over places and found hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.carriers.base import carrier, oracle
from lodestone.functions import places
from lodestone.operators import discovery as m

NAMES = [*places.CURRENCIES, "ras al khaimah", "medina", "al-khobar, ksa", "Remote", "dubai and riyadh"]
PLACE = "CASE seq % 4 WHEN 0 THEN location WHEN 1 THEN {pick} WHEN 2 THEN 'Greater ' || {pick} || ', ' || coalesce(location, '') ELSE coalesce(location, 'x') || ' or ' || {pick} END"


def listed(terms):
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def place_rows(s, d):
    pick = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("seq") % len(NAMES) + 1).cast("int"))
    return carrier(s, d, "postings").withColumn("pick", pick).withColumn("place", F.expr(PLACE.format(pick="pick")))


def found(s, d):
    return carrier(s, d, "found")


QUERIES = {
    "b6_local_currency": lambda s, d: place_rows(s, d).select("seq", places.local_currency(F.col("place")).alias("currency")),
    "b7_geo_canonical": lambda s, d: place_rows(s, d).select("seq", places.canonical_name(F.col("place")).alias("name")),
    "c15_candidate_triage": lambda s, d: m.triage(found(s, d), "GenAI Engineer", ("Dubai", "Saudi Arabia")).select("seq", "promising"),
    "b13_employer_discovery": lambda s, d: m.discover_sources(found(s, d), locations=("UAE",)),
}

ROWS = f"p AS (SELECT seq, {PLACE.format(pick='pick')} AS place FROM (SELECT *, [{listed(NAMES)}][seq % {len(NAMES)} + 1] AS pick FROM postings))"
VALUES = lambda table: ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(table.items()))


def any_of(col, terms):
    return "(" + " OR ".join(f"contains({col}, '" + t.replace("'", "''") + "')" for t in terms) + ")"


SLUGS = [f"nullif(lower(regexp_extract(url, '(?i){p}', 1)), '')" for _, p in m.PLATFORMS]
NAMED = [f"regexp_replace(trim(regexp_extract(trim(title), '{p}', 1)), '[^\\w\\s&]', '', 'g')" for p in m.EMPLOYER_PATTERNS]
ACCEPT = ", ".join(f"CASE WHEN length(trim({x})) > 2 AND NOT regexp_matches(trim({x}), '^[0-9]') AND NOT {any_of(f'lower({x})', m.NO_EMPLOYER_PARTS)} AND lower(trim({x})) NOT IN ({listed(m.NO_EMPLOYERS)}) THEN trim({x}) END" for x in NAMED)
ORACLES = {
    "b6_local_currency": oracle(
        f"WITH {ROWS}, v(i, k, c) AS (VALUES {VALUES(places.CURRENCIES)}), w AS (SELECT seq, place, unnest(regexp_extract_all(lower(place), '[a-zA-Z]+')) AS w, generate_subscripts(regexp_extract_all(lower(place), '[a-zA-Z]+'), 1) AS n FROM p), "
        f"one AS (SELECT seq, arg_min(c, n) AS c FROM w JOIN v ON v.k = w.w GROUP BY 1), many AS (SELECT seq, arg_min(c, i) AS c FROM p JOIN v ON contains(k, ' ') AND contains(lower(place), k) GROUP BY 1) "
        f"SELECT p.seq, CASE WHEN coalesce(place, '') = '' THEN 'USD' WHEN contains(lower(place), ' or ') OR {any_of('lower(place)', places.SAUDI)} AND {any_of('lower(place)', places.EMIRATES)} THEN NULL ELSE coalesce(many.c, one.c, 'USD') END AS currency FROM p LEFT JOIN one ON one.seq = p.seq LEFT JOIN many ON many.seq = p.seq", "postings"),
    "b7_geo_canonical": oracle(
        f"WITH {ROWS}, v(i, k, c) AS (VALUES {VALUES(places.NAMES)}) SELECT seq, coalesce(c, CASE WHEN length(trim(coalesce(place, ''))) > 3 THEN array_to_string(list_transform(regexp_extract_all(lower(trim(place)), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') ELSE upper(trim(coalesce(place, ''))) END) AS name FROM p LEFT JOIN v ON v.k = lower(trim(place))", "postings"),
    "c15_candidate_triage": oracle(
        f"WITH t AS (SELECT seq, lower(url) AS u, lower(title) AS t, lower(snippet) AS s, lower(url || ' ' || title || ' ' || snippet) AS x FROM found) SELECT seq, NOT ({any_of('u', m.JUNK_URLS)} OR {any_of('t', m.JUNK_TITLES)} OR {any_of('t', m.OTHER_TRADES)} AND NOT {any_of('t', m.AI_REQUESTS)} OR {any_of('u', m.FOREIGN_HOSTS)} OR {any_of('x', m.FOREIGN_PLACES)} AND NOT {any_of('x', m.EXCUSES)} "
        f"OR contains(u, 'linkedin.com') AND {any_of('u', m.POSTS)} AND {any_of('x', m.SEEKERS)} OR {' OR '.join(f"regexp_matches({x}, '{p}')" for p in m.STALE for x in 'st')}) AS promising FROM t", "found"),
    "b13_employer_discovery": oracle(
        f"WITH a AS (SELECT seq, url, coalesce({', '.join(SLUGS)}) AS slug, CASE {' '.join(f'WHEN {x} IS NOT NULL THEN ' + repr(n) for (n, _), x in zip(m.PLATFORMS, SLUGS))} END AS platform, replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') AS host, coalesce({ACCEPT}) AS employer FROM found), "
        f"p AS (SELECT 'platform' AS kind, slug AS key, arg_min(platform, seq) AS detail, arg_min(url, seq) AS url, min(seq) AS seq FROM a WHERE length(slug) > 1 AND slug NOT IN ({listed(m.NO_EMPLOYERS)}) GROUP BY slug), "
        f"e AS (SELECT 'employer' AS kind, lower(employer) AS key, arg_min(employer, seq) AS detail, arg_min(url, seq) AS url, min(seq) AS seq FROM a WHERE employer IS NOT NULL AND lower(employer) NOT IN (SELECT key FROM p) GROUP BY 2), "
        f"b AS (SELECT 'board' AS kind, host AS key, host AS detail, arg_min(url, seq) AS url, min(seq) AS seq FROM a WHERE slug IS NULL AND host <> '' AND NOT {any_of('host', m.SOCIAL_HOSTS + m.AGGREGATOR_HOSTS)} AND {any_of('lower(url)', m.BOARD_PATHS)} AND NOT (split_part(host, '.', 1) IN ({listed(m.FOREIGN_STARTS)}) AND contains(host, '.') OR {' OR '.join(f'ends_with(host, ' + repr('.' + x) + ')' for x in m.FOREIGN_ENDS)}) GROUP BY host) SELECT * FROM p UNION ALL SELECT * FROM e UNION ALL SELECT * FROM b", "found"),
}
