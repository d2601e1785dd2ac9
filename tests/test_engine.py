"""Invariants of extraction, verdicts, duplicates and lifecycle on small tables."""

import pytest
from pyspark.sql import functions as F

from rolecall.functions import text as tx
from rolecall.operators import eligibility as el
from rolecall.operators import lifecycle as lc
from rolecall.operators import listing
from rolecall.operators import requirements as rq
from rolecall.sources import pages

JOB = "id string, company_id string, user_id string, status string, title string, description string, education_requirement string, requirements_text string, experience_min double, experience_max double, location string"


def extract(spark, **job):
    row = {"id": "1", "company_id": "c", "user_id": "u", "status": "ACTIVE", "title": "Engineer", "description": None, "education_requirement": None, "requirements_text": None, "experience_min": None, "experience_max": None, "location": None} | job
    df = spark.createDataFrame([tuple(row.values())], JOB)
    return rq.extract(df, F.lit("2026-06-01").cast("date"))


def one(spark, **job):
    return extract(spark, **job).select("requirements.*").first()


def verdict(spark, job, **profile):
    p = {"user_id": "u", "degree": "B.Tech", "branch": "Chemical Engineering", "graduation_year": 2026, "years_of_experience": 0.0, "skills": ["Python", "SQL"], "preferred_locations": ["Pune"], "work_authorization": [], "certifications": [], "willing_to_relocate": True} | profile
    mine = spark.createDataFrame([tuple(p.values())], "user_id string, degree string, branch string, graduation_year int, years_of_experience double, skills array<string>, preferred_locations array<string>, work_authorization array<string>, certifications array<string>, willing_to_relocate boolean")
    rows = extract(spark, **job).drop("experience_min", "experience_max").select("*", "requirements.*").drop("requirements")
    return el.analyse(el.pair(rows, mine)).first()


def test_years_and_degree_from_prose(spark):
    r = one(spark, description="B.Tech in Chemical Engineering. 5+ years of experience is required.")
    assert (r.degree_level, r.fields, r.experience_min, r.experience_mandatory) == ("BACHELOR", ["CHEMICAL_ENGINEERING"], 5.0, True)


def test_freshers_and_the_unstated(spark):
    r = one(spark, description="Freshers are welcome.")
    assert (r.experience_min, r.experience_max, r.experience_mandatory) == (0.0, 0.0, False)
    r = one(spark, description="Join our team.")
    assert r.degree_level == "UNKNOWN" and not r.experience_stated and len(r.gaps) == 3 and r.work_authorization is None
    assert "senior" in " ".join(one(spark, title="Senior Engineer").gaps)


def test_feed_beats_prose(spark):
    r = one(spark, description="5+ years required. M.Tech needed.", education_requirement="Diploma in Civil Engineering", experience_min=1.0)
    assert (r.degree_level, r.fields, r.experience_min) == ("DIPLOMA", ["CIVIL_ENGINEERING"], 1.0)
    assert r.origin["DEGREE_LEVEL"] == r.origin["EXPERIENCE"] == "EXPLICIT"


def test_duty_gives_no_skill_and_specific_beats_generic(spark):
    assert one(spark, description="You will support distillation.").skills_required == []
    assert one(spark, description="Bachelor of Technology in Chemical Engineering is required.").fields == ["CHEMICAL_ENGINEERING"]
    r = one(spark, requirements_text="Experience in distillation and heat transfer. Familiarity with Aspen Plus is preferred.")
    assert set(r.skills_required) == {"SEPARATION_PROCESSES", "HEAT_TRANSFER"} and r.skills_preferred == ["MODELLING_SIMULATION"]


def test_skill_fold_keeps_order(spark):
    r = one(spark, description="Python is required. Python is preferred. Python is mandatory.")
    assert r.skills_required == ["PYTHON"] and r.skills_preferred == ["PYTHON"]
    r = one(spark, description="Python is required. Python is preferred.")
    assert r.skills_required == []


LONG = "B.Tech in Chemical Engineering is required. " + "This role runs a plant with care and attention, every single day of the week. " * 2


def test_verdict_precedence(spark):
    ok = verdict(spark, {"description": LONG, "location": "Pune"})
    assert ok.verdict == "ELIGIBLE" and ok.match_score > 80 and ok.explanation.startswith("You appear")
    assert verdict(spark, {"description": "Apply now."}).verdict == "UNCERTAIN"
    worse = verdict(spark, {"description": LONG + "5+ years required. GATE score needed."})
    assert worse.verdict == "INELIGIBLE" and "Minimum 5 year(s) of experience" in worse.missing
    assert worse.explanation.split("\n")[1].startswith("✗")


def test_location_alone_never_disqualifies(spark):
    assert verdict(spark, {"description": LONG, "location": "Chennai"}, willing_to_relocate=False).verdict == "ELIGIBLE"
    assert verdict(spark, {"description": LONG + "Must be based in Chennai.", "location": "Chennai"}, willing_to_relocate=False).verdict == "INELIGIBLE"


def test_profile_skills_are_canonical(spark):
    r = verdict(spark, {"description": LONG + "Power BI is required."}, skills=["power bi"])
    assert [c.outcome for c in r.checks if c.factor == "SKILLS"] == ["MATCH"]


def test_fingerprints(spark):
    rows = [("1", "c", " Req-1 ", "A", "Pune"), ("2", "c", "REQ 1", "B", "Delhi"), ("3", "c", None, "Process Engineer", "Pune, India (Remote)"), ("4", "c", "", "process engineer!", "pune"), ("5", "c", None, "X", None)]
    df = spark.createDataFrame(rows, "id string, company_id string, external_job_id string, title string, location string")
    got = [r.f for r in df.select(lc.fingerprint().alias("f")).collect()]
    assert got == ["eid:c:req 1", "eid:c:req 1", "tl:c:process-engineer:pune", "tl:c:process-engineer:pune", "tl:c:x:noloc"]


SNAP = "company_id string, fingerprint string, id string, title string, location string, description string, closing_at date, employment_type string, experience_min double, experience_max double, education_requirement string, salary string, status string, verification string, first_seen_on date"


def snapshot(spark, rows):
    made = [("c" if not r[0].startswith("o") else "o", r[0], r[0], r[1], None, None, r[2], None, None, None, None, None, r[3], "UNVERIFIED", None) for r in rows]
    return spark.createDataFrame(made, SNAP).withColumn("closing_at", F.col("closing_at").cast("date"))


def test_reconcile(spark):
    import datetime

    past = datetime.date(2020, 1, 1)
    old = snapshot(spark, [("seen", "A", None, "ACTIVE"), ("gone", "A", None, "ACTIVE"), ("closed", "A", None, "REMOVED"), ("other", "A", None, "ACTIVE"), ("late", "A", None, "ACTIVE")])
    new = snapshot(spark, [("seen", "B", None, "ACTIVE"), ("closed", "A", None, "ACTIVE"), ("new", "A", past, "ACTIVE"), ("late", "a!", past, "ACTIVE")])
    sources = spark.createDataFrame([("c", True), ("o", False)], "company_id string, source_verified boolean")
    got = {r.fingerprint: (r.action, r.status, r.changed) for r in lc.reconcile(old, new, sources, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"seen": ("SEEN", "ACTIVE", True), "gone": ("REMOVED", "REMOVED", False), "closed": ("KEPT_CLOSED", "REMOVED", False), "other": ("UNTOUCHED", "ACTIVE", False), "new": ("NEW", "EXPIRED", True), "late": ("SEEN", "EXPIRED", True)}
    assert [r.fingerprint for r in lc.removals(old, new, sources).collect()] == ["gone"]


def test_second_run_changes_nothing(spark):
    old = snapshot(spark, [("a", "A", None, "ACTIVE"), ("b", "B", None, "ACTIVE")])
    sources = spark.createDataFrame([("c", True)], "company_id string, source_verified boolean")
    got = lc.reconcile(old, old, sources, F.lit("2024-01-01").cast("date")).collect()
    assert all((r.action, r.status, r.changed) == ("SEEN", "ACTIVE", False) for r in got)


def test_similar_titles_are_found_by_rare_tokens(spark):
    words = [f"word{i}" for i in range(11)]
    rows = [("1", "c", None, " ".join(words), "Pune", None, True), ("2", "c", None, " ".join(words[:10]), "Pune", None, False), ("3", "c", None, " ".join(words[:8]), "Pune", None, False), ("4", "d", None, " ".join(words), "Pune", None, True)]
    jobs = spark.createDataFrame(rows, "id string, company_id string, external_job_id string, title string, location string, posted_at date, is_official boolean")
    assert [(r.a, r.b, r.tier) for r in lc.duplicate_links(jobs).collect()] == [("1", "2", 3)]


@pytest.mark.parametrize("name,key", [("Tata Chemicals Limited", "tata chemicals"), ("tata chemicals ltd.", "tata chemicals"), ("The Company", "the"), ("O'Neil & Sons", "oneil and sons"), ("Group", "group"), ("", "")])
def test_company_key(spark, name, key):
    assert spark.range(1).select(tx.company_key(F.lit(name))).first()[0] == key


def test_absent_values_are_labelled(spark):
    df = spark.createDataFrame([(None, " ", "x")], "a string, b string, c string")
    cols = ["company_name", "title", "verdict", "location", "work_arrangement", "employment_type", "posted_at", "closing_at", "education_requirement", "salary", "status", "verification", "first_seen_on", "last_verified_at", "external_job_id", "source_url"]
    wide = df.select(*[F.col("b").alias(c) for c in cols], *[F.lit(None).cast("double").alias(c) for c in ("match_score", "experience_min", "experience_max")], F.lit(False).alias("is_official"), *[F.array().cast("array<string>").alias(c) for c in ("required_skills", "preferred_skills", "also_seen_at")])
    row = listing.export_rows(wide).first()
    assert len(row) == 23 and row["Company"] == row["Match score (%)"] == listing.NOT_STATED and row["Also seen at"] == "Only one source found"


def test_csv_quotes(spark, tmp_path):
    out = str(tmp_path / "csv")
    listing.write_csv(spark.createDataFrame([('say "hi", now', "x")], "a string, b string").coalesce(1), out)
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text == b'a,b\r\n"say ""hi"", now",x\r\n'


def test_broken_json_ld_is_left_out(spark):
    html = '<script type="application/ld+json">{oops</script><script type="application/ld+json">{"@type": "JobPosting", "title": {"@value": "A"},}</script>'
    df = spark.createDataFrame([(1, "https://x.com/a/b", html), (2, "https://x.com", None), (3, "https://x.com", "")], "page_id long, url string, html string")
    got = pages.job_posting(pages.json_ld_nodes(df)).collect()
    assert [(r.page_id, r.title, r.url, r.description) for r in got] == [(1, "A", "https://x.com/a/b", None)]


@pytest.mark.parametrize(("name", "items", "title", "nested"), [
    ("greenhouse", "jobs", "title", "location"), ("lever", None, "text", "categories"), ("workday", "jobPostings", "title", "locationsText"), ("smartrecruiters", "content", "name", "location"),
    ("ashby", "jobs", "title", "location"), ("workable", "jobs", "title", "city"), ("bamboohr", "jobs", "title", "location"),
])
def test_feeds_with_absent_null_and_mistyped_fields(spark, name, items, title, nested):
    import json

    from rolecall.sources import feeds

    whole, bare, null = {title: "Process Engineer", "id": "1", "extra": {"a": [1]}}, {}, {title: None, nested: None}
    odd = [{title: "Odd", nested: [1, 2]}, {title: "Odder", nested: 7, "id": 12}]
    listed = lambda xs: json.dumps({items: xs} if items else xs)
    bodies = [("good", listed([whole, bare, null])), ("odd", listed([whole, *odd])), ("none", listed([])), ("null", json.dumps({items: None}) if items else "null"), ("other", json.dumps({"x": 1})), ("broken", listed([whole])[:-3]), ("html", "<html>"), ("empty", ""), ("missing", None)]
    rows = feeds.READERS[name](spark.createDataFrame([(c, "https://careers.example.com/jobs", b) for c, b in bodies], "company_id string, careers_url string, body string")).collect()
    assert all(r.asDict().keys() == {"company_id", *feeds.COLUMNS} for r in rows)
    titles = {}
    for r in rows:
        titles.setdefault(r.company_id, []).append(r.title)
    assert titles["good"] == ["Process Engineer", "Untitled role", "Untitled role"]
    assert titles["odd"] == ["Process Engineer", "Odd", "Odder"]
    assert not {"none", "null", "html", "empty", "missing"} & set(titles)


def test_personio_with_absent_and_odd_fields(spark):
    from rolecall.sources import feeds

    body = "<workzag-jobs><job id='1'><title>Engineer</title></job><job><office>Pune</office></job><job id='x'><title> </title></job><job><title>Chemist</title><type>odd</type><new>1</new></job></workzag-jobs>"
    rows = feeds.personio(spark.createDataFrame([("a", "https://a.jobs.personio.de", body), ("b", "u", "<html>"), ("c", "u", None), ("d", "u", "<job")], "company_id string, careers_url string, body string")).collect()
    assert sorted(r.title for r in rows) == ["Chemist", "Engineer"]
