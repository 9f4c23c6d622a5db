"""Rules of the gates are worked out once: no filter is pushed below them with a copy of all of them."""

import pytest

from lodestone.carriers.postings import SPEC, normal
from lodestone.operators import postings

SMALL = "/root/testdata/sf0.001"
GATES = {
    "rejected": lambda n: postings.hard_filter(n, SPEC)[1].select("record_id", "reason"),
    "qualified": lambda n: postings.hard_filter(n, SPEC)[0].select("record_id"),
    "tally": lambda n: postings.rejection_tally(postings.qualify(n, SPEC)),
}


@pytest.mark.parametrize("name", GATES)
def test_rules_stand_once_in_the_plan(spark, name):
    plan = GATES[name](normal(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("title_job_family_mismatch") == 1


def test_every_row_is_qualified_or_rejected(spark):
    rows = normal(spark, SMALL)
    good, bad = postings.hard_filter(rows, SPEC)
    judged = {r["record_id"]: r["qualified"] for r in postings.qualify(rows, SPEC).select("record_id", "qualified").collect()}
    assert {r["record_id"] for r in good.select("record_id").collect()} == {i for i, q in judged.items() if q}
    assert {r["record_id"] for r in bad.select("record_id").collect()} == {i for i, q in judged.items() if not q}
    assert "__kept" not in good.columns
