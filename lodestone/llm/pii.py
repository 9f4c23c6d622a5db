"""Operator 7 [native]: personal data by weak supervision.

Base patterns give spans that always stay. They, the base matches that fail their checks, and wider candidates (keys and
passwords, id numbers, phone numbers without a plus) are voted on by three labelers: a regex labeler (does the text pass
the kind's strict check), a gazetteer labeler (domains, issuers, country codes, key prefixes) and a context labeler (cue
words to the left). Expectation-maximisation over the counts of vote patterns (a table of some hundred rows at most,
whatever the input) estimates the labelers' reliabilities; its posteriors are the weights with which a naive Bayes span
classifier is trained on kind, length, digit share, case mix and votes. Candidates that it accepts and that touch no base
span are added. All spans of all documents are counted; the row work is built-in functions only.

A pattern's offsets come from split(): the pieces between matches and the matches, summed in order, give each start.
Patterns are written so that no run of characters is tried twice: lookbehind or the end of the previous match (\\G)
replaces tries from inside a run, possessive repeats replace backtracking.

Defined cases: a null text counts as empty and has no spans; rows with the same doc_id and text are one document for the
grouping and each gets its result; a null doc_id is a value like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored, whole_text

BASE = ("email", "ip", "card", "phone")
WIDER = ("secret", "idnum", "tel")
KINDS = BASE + WIDER

# The patterns of the contract, written without backtracking.
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
    "idnum": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None, "idnum": "-", "tel": None}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Gazetteers and cue words.
TOP_DOMAINS = r"\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
KEY_PREFIXES = r"^(AKIA|ASIA|ghp|gho|sk|pk|xox|AIza)"
CUES = {
    "email": r"(?i)(mail|contact|write|reach)", "ip": r"(?i)(\bip\b|host|address|server)", "card": r"(?i)(card|visa|credit|payment)", "phone": r"(?i)(phone|tel|call|fax|mobile)",
    "secret": r"(?i)(password|passwd|token|secret|api.?key|key)\W*$", "idnum": r"(?i)(ssn|social|id|passport|number)\W*$", "tel": r"(?i)(phone|tel|call|fax|mobile)\W*$",
}
COUNTER_CUES = r"(?i)(version|licen[sc]e|isbn|doi|build|page|chapter|figure)\W*$"
LEFT = 24
ROUNDS = 60


def matches(docs: DataFrame) -> DataFrame:
    """doc_key, kind, start, end, hit, left: all matches of all patterns. docs: doc_key, text."""

    def one(kind: str) -> Column:
        pieces = F.transform(F.split("text", PATTERNS[kind], -1), lambda p: F.struct(F.length(p).alias("n"), F.substring(p, -LEFT, LEFT).alias("left")))
        hits = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), 0)
        test = F.contains("text", F.lit(NEEDED[kind])) if NEEDED[kind] else F.col("text").rlike(PATTERNS[kind])
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), F.when(test & F.col("text").rlike("[0-9]|@"), F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))).alias("parts"))

    each = docs.select("doc_key", F.inline(F.array(*map(one, KINDS)))).filter(F.size("parts") > 1)
    flat = each.select("doc_key", "k", F.posexplode("parts").alias("i", "part")).filter("part.hit is not null").select("doc_key", "k", "i", "part.piece.n", "part.piece.left", "part.hit").distinct()
    order = Window.partitionBy("doc_key", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("n") + F.length("hit")).over(order))
    return placed.select("doc_key", "k", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "left")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: (F.substring(turned, i, F.lit(1)).cast("int") * (2 - i % 2)).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def checked(found: DataFrame) -> DataFrame:
    """Adds valid (the kind's strict check), digits and the labelers' votes v_regex, v_gazetteer, v_context (-1, 0, 1)."""
    k = {name: F.col("k") == i for i, name in enumerate(KINDS)}
    digits = F.translate("hit", " ().-+", "")
    count = F.length(digits)
    valid = (
        F.when(k["ip"], F.col("hit").rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"))
        .when(k["card"], F.when(count.between(14, 19), luhn(digits)).otherwise(False))
        .when(k["phone"], count.between(10, 15))
        .otherwise(F.lit(True))
    )
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    gazetteer = (
        F.when(k["email"], vote(F.col("hit").rlike(TOP_DOMAINS), F.lit(False)))
        .when(k["card"], vote(digits.rlike(ISSUERS), F.lit(True)))
        .when(k["ip"], vote(F.lit(False), F.col("hit").rlike(r"^0+\.")))
        .when(k["phone"] | k["tel"], vote(digits.rlike(r"^[1-9]"), F.lit(True)))
        .when(k["secret"], vote(F.col("hit").rlike(KEY_PREFIXES), F.lit(False)))
        .otherwise(vote(F.lit(False), F.col("hit").rlike("^(000|666|9)")))
    )
    cue = F.lit(False)
    for name, pattern in CUES.items():
        cue = F.when(k[name], F.col("left").rlike(pattern)).otherwise(cue)
    strict = F.when(k["secret"], F.col("hit").rlike(r"^([0-9a-f]{16,}|[0-9A-Z]{16,})$")).when(k["idnum"] | k["tel"], F.lit(None)).otherwise(F.col("valid"))
    return found.withColumn("valid", valid).withColumns({"v_regex": vote(F.coalesce(strict, F.lit(False)), ~strict), "v_gazetteer": gazetteer, "v_context": vote(cue, F.col("left").rlike(COUNTER_CUES)), "digit_share": F.floor(4 * (F.length("hit") - F.length(F.translate("hit", "0123456789", ""))) / F.length("hit")).cast("int"), "size": F.least(F.floor(F.log2(F.length("hit").cast("double"))), F.lit(7)).cast("int"), "mixed": (F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]")).cast("int")})


VOTES = ("v_regex", "v_gazetteer", "v_context")
FEATURES = ("k", "size", "digit_share", "mixed", *VOTES)


def reliabilities(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[float]]:
    """Prior and the labelers' reliabilities by expectation-maximisation over counts of vote patterns."""
    prior, sure = 0.5, [0.8] * len(VOTES)
    for _ in range(ROUNDS):
        total = yes = 0.0
        right, cast = [1.0] * len(VOTES), [1.25] * len(VOTES)
        for votes, n in patterns.items():
            p = posterior(prior, sure, votes)
            total, yes = total + n, yes + n * p
            for j, v in enumerate(votes):
                if v:
                    right[j] += n * (p if v > 0 else 1 - p)
                    cast[j] += n
        prior = min(max((yes + 1) / (total + 2), 0.01), 0.99)
        sure = [min(max(r / c, 0.55), 0.99) for r, c in zip(right, cast)]
    return prior, sure


def posterior(prior: float, sure: list[float], votes: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(v * math.log(s / (1 - s)) for v, s in zip(votes, sure))
    return 1 / (1 + math.exp(-max(min(odds, 50.0), -50.0)))


def span_scores(cells: list[tuple[tuple[int, ...], int]], prior: float, sure: list[float]) -> tuple[float, list[dict[int, float]]]:
    """Naive Bayes: the bias and for each feature the log odds of its values, from feature cells weighted by posteriors."""
    yes, no = 1.0, 1.0
    by = [{} for _ in FEATURES]
    for values, n in cells:
        p = posterior(prior, sure, values[-len(VOTES) :])
        yes, no = yes + n * p, no + n * (1 - p)
        for seen, v in zip(by, values):
            a, b = seen.get(v, (0.0, 0.0))
            seen[v] = (a + n * p, b + n * (1 - p))
    odds = [{v: math.log((a + 1) / (yes + len(seen))) - math.log((b + 1) / (no + len(seen))) for v, (a, b) in seen.items()} for seen in by]
    return math.log(yes / no), odds


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_key, spans: array of (start, k, end, base) for the documents that have any. docs: doc_key, text."""
    found = stored(checked(matches(docs)), "pii-candidates")
    base = F.col("valid") & (F.col("k") < len(BASE))
    cells = [(tuple(r[:-1]), r[-1]) for r in found.groupBy(*FEATURES).agg(F.count("*")).collect()]  # 7 * 8 * 5 * 2 * 27 rows at most
    patterns: dict[tuple[int, ...], int] = {}
    for values, n in cells:
        votes = values[-len(VOTES) :]
        patterns[votes] = patterns.get(votes, 0) + n
    prior, sure = reliabilities(patterns)
    bias, odds = span_scores(cells, prior, sure)
    score = F.lit(bias)
    for name, values in zip(FEATURES, odds):
        term = F.lit(0.0)
        for v, w in values.items():
            term = F.when(F.col(name) == v, F.lit(w)).otherwise(term)
        score = score + term
    scored = found.withColumns({"base": base, "added": ~base & (score > 0)}).filter("base or added")
    spans = scored.groupBy("doc_key").agg(F.collect_set(F.struct("start", "k", "end", "base")).alias("all"))
    firm = F.filter("all", lambda s: s["base"])
    # an added span gives way to a base span or an earlier kind's added one that it touches
    apart = F.filter("all", lambda s: s["base"] | ~F.exists("all", lambda o: (o["base"] | (o["k"] < s["k"])) & (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return spans.select("doc_key", F.sort_array(firm).alias("firm"), F.sort_array(apart).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def of_kind(i: int) -> Callable[[Column], Column]:
    # a second parameter, even with a default, would be the element's place in the array
    return lambda x: x["k"] == i


def op7(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", whole_text().alias("text")).withColumn("doc_key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    spans = personal_data(keyed.select("doc_key", "text"))
    s = spans.select(F.col("doc_key.doc_id").alias("s_id"), F.col("doc_key.h").alias("s_h"), "firm", "spans")
    ids = keyed.select("doc_id", F.col("doc_key.h").alias("h"))
    joined = ids.join(s, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    counts = [F.size(F.filter("firm", of_kind(i))).cast("long").alias(f"n_{name}") for i, name in enumerate(BASE)]
    return joined.withColumn("firm", F.coalesce("firm", F.array().cast("array<struct<start:bigint,k:int,end:bigint,base:boolean>>"))).select("doc_id", *counts, F.sha2(written(F.col("firm")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
