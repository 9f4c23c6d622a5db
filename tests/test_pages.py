"""Postings from single pages: one case for each convention and guard."""

import pytest

from lodestone.operators import pages

SCHEMA = "page_id long, url string, title string, description string, text string, junk string"
GREEN, LEVER, OWN = "https://boards.greenhouse.io/acme-labs/jobs/7", "https://jobs.lever.co/beta/77", "https://careers.gammaworks.com/jobs/9"
CASES = [
    (GREEN, "Acme Labs hiring Senior ML Engineer in Dubai | LinkedIn", None, "", ("Senior ML Engineer", "Acme Labs", "Dubai", "company hiring role")),
    (GREEN, "Job Application for Data Scientist at Beta Corp", None, "", ("Data Scientist", "Beta Corp", "Remote / Unspecified", "job application for role")),
    (OWN, "AI Engineer at Gamma Works", None, "Location: Cairo, Egypt Overview", ("AI Engineer", "Gamma Works", "Cairo, Egypt", "role at company")),
    (OWN, "Forward Deployed Engineer - Delta", None, "in Berlin", ("Forward Deployed Engineer", "Delta", "Berlin", "role - company")),
    (OWN, "Gammaworks - Research Lead", None, "", ("Research Lead", "Gammaworks", "Remote / Unspecified", "role - company")),
    (LEVER, "Palantir - Forward Deployed AI Engineer", None, "", ("Forward Deployed AI Engineer", "Palantir", "Remote / Unspecified", "role - company")),
    (OWN, "Platform Architect | Zeta", "A role based in Riyadh, SA", "in London", ("Platform Architect", "Zeta", "Riyadh, SA", "role | company")),
    (OWN, "Gamma Works | Sales Manager", None, "", ("Sales Manager", "Gamma Works", "Remote / Unspecified", "role | company")),
    (GREEN, "[Lead Designer](https://x.org) openings", None, "", ("Lead Designer", "Acme Labs", "Remote / Unspecified", "whole title")),
    (OWN, "LLM Developer - Careers", None, "", ("LLM Developer", "Gammaworks", "Remote / Unspecified", "role - company")),
    (OWN, "12 AI engineer jobs in Riyadh", None, "", ("12 AI engineer", "Gammaworks", "Remote / Unspecified", "whole title")),
    (OWN, "About our mission", None, "intro\n# Staff Analyst\nmore", ("Staff Analyst", "Gammaworks", "Remote / Unspecified", "first heading")),
    (OWN, "About our mission", None, "", None), (GREEN, "About our mission", None, "", ("About our mission", "Acme Labs", "Remote / Unspecified", "whole title")),
    (OWN, "Sign in", None, "", None), (OWN, "Gammaworks Careers", None, "", None), (OWN, "Engineer resume", None, "", None), (OWN, None, None, None, None), ("https://x.org/login", "AI Engineer", None, "", None),
    ("https://x.org/login", "AI Engineer", "meta", "", ("AI Engineer", "X", "Remote / Unspecified", "whole title")), (None, "AI Engineer", None, "", ("AI Engineer", "Direct Employer", "Remote / Unspecified", "whole title")),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, url, title, description, text, "j") for i, (url, title, description, text, _) in enumerate(CASES)]
    return {r["page_id"]: r for r in pages.posting_from_page(spark.createDataFrame(rows, SCHEMA), "2026-03-12 00:00:00").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_page(found, i):
    want, r = CASES[i][4], found.get(i)
    assert (r and (r["title"], r["company"], r["location"], r["convention"])) == want


def test_page_details(spark):
    text = "Pay: $90,000 - $120,000 per year. Posted 3 days ago. A contract."
    rows = [(1, OWN + "?error=true&a=1", "AI Engineer", None, text, ""), (2, "https://boards.greenhouse.io/acme?error=true", "AI Intern", None, "", "")]
    out = {r["page_id"]: r for r in pages.posting_from_page(spark.createDataFrame(rows, SCHEMA), "2026-03-12 00:00:00").collect()}
    assert (out[1]["salary"], out[1]["posted"], out[1]["posted_age_seconds"], out[1]["employment_type"], out[1]["application_url"]) == ("$90,000 - $120,000 per year", "3 days ago", 3 * 86400, "Contract", OWN + "?a=1")
    assert (out[2]["application_url"], out[2]["posted_age_seconds"], out[2]["employment_type"]) == (None, 86400, "Internship")
    assert pages.posting_from_page(spark.createDataFrame([], SCHEMA), "2026-03-12 00:00:00", topic="data engineer").count() == 0
