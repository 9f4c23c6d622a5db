"""Rounds of the ordered dedupe meet on numbers, not on the texts of keys, and give the same primaries."""

from lodestone.operators import resolve


def test_rounds_meet_on_numbers(spark, monkeypatch):
    seen, plain = [], resolve.dedupe_round

    def watched(state):
        seen.append(state.schema["keys"].dataType.elementType["k"].dataType.simpleString())
        return plain(state)

    monkeypatch.setattr(resolve, "dedupe_round", watched)
    rows = [("a", 1, "Data Engineer", ["x::1", "y::1"]), ("b", 2, "Chef", ["x::1"]), ("c", 3, "Data Engineer", ["x::1", "y::1"]), ("d", 4, "Chef", ["z::1", "x::1"]), ("e", 5, "Chef", ["q::1"])]
    keyed = spark.createDataFrame(rows, "record_id string, seq long, title string, keys array<string>")
    found = {r["record_id"]: r["primary_id"] for r in resolve.dedupe_by_keys(keyed).collect()}
    assert found == {"a": "a", "b": "b", "c": "a", "d": "b", "e": "e"}
    assert set(seen) == {"bigint"}
