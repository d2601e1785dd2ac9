"""Readers of job-board feeds: one row per body (company_id, careers_url, body), one per posting out.

Each reader is a schema and a projection; a body that doesn't parse gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

COLUMNS = ("external_job_id", "title", "description", "location", "employment_type", "posted_at", "closing_at", "department", "category", "url")


def _text(c: Column) -> Column:
    """Text of HTML, collapsed; null if blank."""
    return F.nullif(tx.collapse(tx.page_text(c)), F.lit(""))


def _joined(*cs: Column) -> Column:
    return F.nullif(tx.collapse(F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in cs])), F.lit(""))


def _title(c: Column) -> Column:
    return tx.collapse(F.coalesce(c, F.lit("Untitled role")))


def _project(rows: DataFrame, **made: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select("company_id", *[made.get(c, null).cast("string").alias(c) for c in COLUMNS])


def _json(bodies: DataFrame, schema: str, items: str | None) -> DataFrame:
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    return bodies.withColumn("j", F.explode(parsed[items] if items else parsed))


def greenhouse(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "jobs array<struct<id: string, title: string, content: string, location: struct<name: string>, updated_at: string, absolute_url: string, departments: array<struct<name: string>>, offices: array<struct<name: string>>>>", "jobs")
    g = lambda p: F.col(f"j.{p}")
    return _project(j, external_job_id=g("id"), title=_title(g("title")), description=_text(g("content")), location=_joined(g("location.name")), posted_at=g("updated_at"), department=F.get(g("departments"), 0)["name"], category=F.get(g("offices"), 0)["name"], url=F.coalesce(g("absolute_url"), F.concat("careers_url", F.lit("#"), g("id"))))


def lever(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "array<struct<id: string, text: string, description: string, additional: string, lists: array<struct<text: string, content: string>>, categories: struct<location: string, team: string, department: string, commitment: string>, createdAt: bigint, hostedUrl: string, applyUrl: string>>", None)
    g = lambda p: F.col(f"j.{p}")
    parts = F.concat_ws("\n", g("description"), g("additional"), F.transform(g("lists"), lambda x: x["content"]))
    when = F.date_format(F.timestamp_millis(g("createdAt")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _project(j, external_job_id=g("id"), title=_title(g("text")), description=_text(parts), location=_joined(g("categories.location"), g("categories.team")), employment_type=g("categories.commitment"), posted_at=when, department=g("categories.department"), category=g("categories.team"), url=F.coalesce(g("hostedUrl"), g("applyUrl"), F.col("careers_url")))


def workday(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "jobPostings array<struct<jobReqId: string, title: string, locationsText: string, countryName: string, postedOn: string, externalPath: string, timeType: string>>", "jobPostings")
    g = lambda p: F.col(f"j.{p}")
    base = F.regexp_replace("careers_url", "/[^/]*$", "")
    return _project(j, external_job_id=g("jobReqId"), title=_title(g("title")), location=_joined(g("locationsText"), g("countryName")), employment_type=g("timeType"), posted_at=g("postedOn"), url=F.concat(base, F.lit("/"), F.coalesce(g("externalPath"), g("jobReqId"), F.lit(""))))


def smartrecruiters(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "content array<struct<id: string, name: string, location: struct<city: string, country: string>, department: struct<name: string>, releasedDate: string>>", "content")
    g = lambda p: F.col(f"j.{p}")
    org = F.regexp_extract("careers_url", r"(?i)smartrecruiters\.com/([A-Za-z0-9_-]+)", 1)
    return _project(j, external_job_id=g("id"), title=_title(g("name")), location=_joined(g("location.city"), g("location.country")), posted_at=g("releasedDate"), department=g("department.name"), url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), org, F.lit("/"), g("id")))


def ashby(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "jobs array<struct<id: string, title: string, descriptionHtml: string, descriptionPlain: string, location: string, employmentType: string, publishedDate: string, updatedAt: string, department: string, team: string, jobUrl: string, applyUrl: string>>", "jobs")
    g = lambda p: F.col(f"j.{p}")
    body = F.coalesce(F.nullif(g("descriptionHtml"), F.lit("")), g("descriptionPlain"))
    return _project(j, external_job_id=g("id"), title=_title(g("title")), description=_text(body), location=_joined(g("location")), employment_type=g("employmentType"), posted_at=F.coalesce(g("publishedDate"), g("updatedAt")), department=g("department"), category=g("team"), url=F.coalesce(g("jobUrl"), g("applyUrl"), F.concat("careers_url", F.lit("#"), g("id"))))


def workable(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "jobs array<struct<id: string, shortcode: string, title: string, description: string, requirements: string, city: string, state: string, country: string, employment_type: string, published_on: string, deadline: string, department: string, url: string, application_url: string>>", "jobs")
    g = lambda p: F.col(f"j.{p}")
    return _project(j, external_job_id=F.coalesce(g("id"), g("shortcode")), title=_title(g("title")), description=_text(F.concat_ws("\n", g("description"), g("requirements"))), location=_joined(g("city"), g("state"), g("country")), employment_type=g("employment_type"), posted_at=g("published_on"), closing_at=g("deadline"), department=g("department"), url=F.coalesce(g("url"), g("application_url"), F.col("careers_url")))


def personio(bodies: DataFrame) -> DataFrame:
    schema = "job array<struct<_id: string, _name: string, title: string, description: string, requirements: string, office: string, location: struct<_name: string>, type: struct<_name: string>, published_at: string, department: string, team: string, url: string, apply_url: string>>"
    rows = bodies.where(F.contains("body", F.lit("<job"))).withColumn("j", F.explode(F.from_xml("body", schema)["job"]))
    g = lambda p: F.col(f"j.{p}")
    kept = rows.where(F.trim(F.coalesce(g("title"), g("_name"), F.lit(""))) != "")
    return _project(kept, external_job_id=g("_id"), title=_title(F.coalesce(g("title"), g("_name"))), description=_text(F.concat_ws("\n", g("description"), g("requirements"))), location=_joined(F.coalesce(g("location._name"), g("office"))), employment_type=g("type._name"), posted_at=g("published_at"), department=g("department"), category=g("team"), url=F.coalesce(g("url"), g("apply_url"), F.col("careers_url")))


def bamboohr(bodies: DataFrame) -> DataFrame:
    j = _json(bodies, "jobs array<struct<id: string, title: string, location: string, employmentStatus: string, department: string, division: string, url: string>>", "jobs")
    g = lambda p: F.col(f"j.{p}")
    return _project(j, external_job_id=g("id"), title=_title(g("title")), location=_joined(g("location")), employment_type=g("employmentStatus"), department=g("department"), category=g("division"), url=F.coalesce(g("url"), F.col("careers_url")))


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": greenhouse, "lever": lever, "workday": workday, "smartrecruiters": smartrecruiters, "ashby": ashby, "workable": workable, "personio": personio, "bamboohr": bamboohr}


def unread(bodies: DataFrame, read: DataFrame) -> DataFrame:
    """Bodies that gave no posting; their pages go to the generic extractors."""
    return bodies.join(read.select("company_id").distinct(), "company_id", "left_anti")
