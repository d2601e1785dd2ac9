"""Queries of the listing surface (filters, joins, aggregates, sorts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..operators import listing as op
from ..operators import rollup_deltas
from ..operators.search_index import TrigramIndex
from .fixtures import AS_OF, Tables
from .registry import SELECTS, query

ROWS = f"""rows AS (SELECT p.*, c.name AS company_name, c.careers_url, v.verdict, v.match_score FROM postings p JOIN companies c ON p.company_id = c.company_id
  LEFT JOIN verdicts v ON v.job_id = p.id AND v.user_id = p.user_id)"""


def today():
    return F.lit(AS_OF).cast("date")


def rows(t: Tables) -> DataFrame:
    return op.job_rows(t.postings, t.companies, t.verdicts)


# --- B: filters and projections -------------------------------------------------------------------


@query("b1_job_list", "SELECT id, title, verdict FROM rows WHERE user_id = '3' AND status = 'ACTIVE' AND location ILIKE '%pune%' AND posted_at <= DATE '1998-05-02' AND (title ILIKE '%engineer%' OR description ILIKE '%engineer%' OR company_name ILIKE '%engineer%')", ROWS)
def _(t):
    older = op.job_filter(rows(t), today(), user="3", location="pune", search="engineer", posted="OLDER")
    return older.where(F.col("posted_at").isNotNull()).select("id", "title", "verdict")


@query("b2_verdict_filter", "SELECT id, status, 'verdict' AS by FROM rows WHERE verdict = 'UNCERTAIN' UNION ALL SELECT id, status, 'active' FROM rows WHERE status = 'ACTIVE'", ROWS)
def _(t):
    a = op.job_filter(rows(t), today(), verdict="UNCERTAIN").select("id", "status", F.lit("verdict").alias("by"))
    return a.unionAll(op.job_filter(rows(t), today(), verdict="ALL").select("id", "status", F.lit("active").alias("by")))


@query("b3_substring_match", "SELECT id FROM postings WHERE department ILIKE '%r_d%' AND employment_type ILIKE '%TIME%'")
def _(t):
    return t.postings.where(op.like(F.col("department"), "r_d") & op.like(F.col("employment_type"), "TIME")).select("id")


@query("b4_experience_bucket", "SELECT CASE WHEN experience_min IS NULL OR experience_min <= 1 THEN 'ENTRY' WHEN experience_min <= 4 THEN 'MID' ELSE 'SENIOR' END AS bucket, count(*) AS n FROM postings GROUP BY 1")
def _(t):
    return t.postings.groupBy(op.experience_bucket(F.col("experience_min")).alias("bucket")).agg(F.count("*").alias("n"))


@query("b5_posted_window", " UNION ALL ".join(f"SELECT '{w}' AS w, count(*) AS n FROM postings WHERE posted_at > DATE '{AS_OF}' - {d}" for w, d in (("TODAY", 1), ("3D", 3), ("7D", 7), ("14D", 14), ("30D", 30))) + f" UNION ALL SELECT 'OLDER', count(*) FROM postings WHERE posted_at IS NULL OR posted_at <= DATE '{AS_OF}' - 30")
def _(t):
    names = ["TODAY", "3D", "7D", "14D", "30D", "OLDER"]
    one = t.postings.agg(*[F.count_if(op.posted_within(F.col("posted_at"), w, today())).alias(w) for w in names])
    return one.unpivot([], names, "w", "n")


@query("b6_free_text_search", "SELECT id, company_id FROM rows WHERE status = 'ACTIVE' AND (title ILIKE '%chem%' OR description ILIKE '%chem%' OR company_name ILIKE '%chem%')", ROWS)
def _(t):
    return op.job_filter(rows(t), today(), search="chem").select("id", "company_id")


@query("b6_indexed_search", "SELECT 'chem' AS part, id FROM postings WHERE title ILIKE '%chem%' OR description ILIKE '%chem%' UNION ALL SELECT 'r_d%chem', id FROM postings WHERE title ILIKE '%r_d%chem%' OR description ILIKE '%r_d%chem%' UNION ALL SELECT 'R&D', id FROM postings WHERE title ILIKE '%R&D%' OR description ILIKE '%R&D%' UNION ALL SELECT 'C', id FROM postings WHERE title ILIKE '%C%' OR description ILIKE '%C%'")
def _(t):
    index = TrigramIndex(t.dealt_postings.select("id", "title", "description"), "id", ["title", "description"])
    return reduce(DataFrame.unionAll, [index.keys(part).select(F.lit(part).alias("part"), "id") for part in ("chem", "r_d%chem", "R&D", "C")])


@query("b7_status_in", "SELECT company_id, status, count(*) AS n FROM postings WHERE status IN ('ACTIVE', 'EXPIRED') GROUP BY ALL")
def _(t):
    return t.postings.where(F.col("status").isin("ACTIVE", "EXPIRED")).groupBy("company_id", "status").agg(F.count("*").alias("n"))


@query("b8_deadline_window", f"SELECT id, closing_at, datediff('day', DATE '{AS_OF}', closing_at) AS days_left FROM postings WHERE status = 'ACTIVE' AND closing_at BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 60 ORDER BY closing_at, id LIMIT 100")
def _(t):
    return op.closing_between(t.postings, today(), 60).select("id", "closing_at", "days_left")


@query("b9_job_detail", "SELECT id, title, company_name, verdict, match_score FROM rows WHERE user_id = '7'", ROWS)
def _(t):
    return op.scoped(rows(t), "7").select("id", "title", "company_name", "verdict", "match_score")


@query("b10_typed_load", "SELECT job_id, coalesce(list_sort(string_split(nullif(skills_required_list, ''), ';')), []) AS skills, CAST(experience_min AS DECIMAL(4,2)) AS experience_min, experience_stated FROM requirements")
def _(t):
    stored = t.requirements.select("job_id", F.to_json(F.filter(F.split("skills_required_list", ";"), lambda x: x != "")).alias("skills"), F.col("experience_min").cast("string").alias("experience_min"), F.col("experience_stated").cast("int").alias("experience_stated"))
    skills = F.coalesce(F.from_json("skills", "array<string>"), F.array().cast("array<string>"))
    return stored.select("job_id", F.array_sort(skills).alias("skills"), F.col("experience_min").cast("decimal(4,2)").alias("experience_min"), (F.col("experience_stated") == 1).alias("experience_stated"))


@query("b11_company_page_filter", f"SELECT id FROM rows WHERE contains(lower(location), 'pune') AND employment_type = 'Contract' AND verdict = 'INELIGIBLE' AND (experience_min IS NULL OR experience_min <= 1) AND (posted_at IS NULL OR posted_at <= DATE '{AS_OF}' - 30)", ROWS)
def _(t):
    return op.company_page(rows(t), today(), "Pune", "Contract", "INELIGIBLE", "ENTRY", "OLDER").select("id")


@query("b12_company_name_filter", "SELECT company_id, name FROM companies WHERE contains(lower(name), 'delta')")
def _(t):
    return t.companies.where(F.contains(F.lower("name"), F.lit("delta"))).select("company_id", "name")


def profiles(t: Tables) -> DataFrame:
    """Profiles with lists; skills are brought to canonical ids."""
    parts = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    return t.profiles.withColumns({"skills": parts("skill_list"), "preferred_locations": parts("preferred_list"), "work_authorization": parts("auth_list"), "certifications": F.array().cast("array<string>")})


@query("b13_profile_gaps", """SELECT user_id, array_to_string(list_filter([CASE WHEN trim(degree) = '' THEN 'Degree not set' END, CASE WHEN trim(branch) = '' THEN 'Branch not set' END, CASE WHEN graduation_year IS NULL THEN 'Graduation year not set' END,
 CASE WHEN skill_list = '' THEN 'Skills not set' END, CASE WHEN preferred_list = '' THEN 'Preferred locations not set' END], lambda x: x IS NOT NULL), '|') AS gaps, trim(degree) <> '' AND trim(branch) <> '' AND graduation_year IS NOT NULL AND skill_list <> '' AS complete FROM profiles""")
def _(t):
    return op.profile_gaps(profiles(t)).select("user_id", F.array_join("gaps", "|").alias("gaps"), "complete")


@query("b14_tenant_rows", "SELECT r.job_id, r.degree_level FROM requirements r WHERE EXISTS (SELECT 1 FROM postings p JOIN companies c ON p.company_id = c.company_id WHERE p.id = r.job_id AND c.user_id = '5')")
def _(t):
    mine = op.reachable(t.postings, op.scoped(t.companies, "5"), "company_id").withColumnRenamed("id", "job_id")
    return op.reachable(t.requirements, mine, "job_id").select("job_id", "degree_level")


# --- C: joins -------------------------------------------------------------------------------------


@query("c1_jobs_companies", "SELECT p.id, c.name AS company_name FROM postings p JOIN companies c ON p.company_id = c.company_id")
def _(t):
    return op.with_company(t.postings, t.companies).select("id", "company_name")


@query("c2_verdict_left_join", "SELECT id, verdict, match_score FROM rows", ROWS)
def _(t):
    return rows(t).select("id", "verdict", "match_score")


PREFS = "prefs AS (SELECT user_id, CASE WHEN CAST(user_id AS INT) % 3 = 0 THEN NULL ELSE 'x' || user_id || '@mail.com' END AS email, CASE WHEN CAST(user_id AS INT) % 2 = 0 THEN 'WEEKLY' ELSE 'DAILY' END AS frequency FROM profiles WHERE user_id <> '4')"


def prefs(t: Tables) -> DataFrame:
    n = F.col("user_id").cast("int")
    return t.profiles.where("user_id <> '4'").select("user_id", F.when(n % 3 != 0, F.concat(F.lit("x"), "user_id", F.lit("@mail.com"))).alias("email"), F.when(n % 2 == 0, "WEEKLY").otherwise("DAILY").alias("frequency"))


@query("c3_profile_users", "SELECT u.user_id, coalesce(p.email, lower(u.email)) AS email, u.degree FROM profiles u JOIN prefs p ON p.user_id = u.user_id", PREFS)
def _(t):
    users = t.profiles.select("user_id", F.lower("email").alias("login"), "degree")
    return users.join(prefs(t), "user_id").select("user_id", F.coalesce("email", "login").alias("email"), "degree")


@query("c4_semi_join_owned", "SELECT id FROM postings WHERE company_id IN (SELECT company_id FROM companies WHERE user_id = '2' AND refresh_mode = 'DAILY')")
def _(t):
    return op.reachable(t.postings, op.scoped(t.companies, "2").where("refresh_mode = 'DAILY'"), "company_id").select("id")


@query("c5_exists_two_hops", "SELECT s.job_id, count(*) AS n FROM sightings s WHERE EXISTS (SELECT 1 FROM postings p JOIN companies c ON p.company_id = c.company_id WHERE p.id = s.job_id AND c.refresh_mode <> 'MANUAL') GROUP BY 1")
def _(t):
    jobs = op.reachable(t.postings, t.companies.where("refresh_mode <> 'MANUAL'"), "company_id").withColumnRenamed("id", "job_id")
    return op.reachable(t.sightings, jobs, "job_id").groupBy("job_id").agg(F.count("*").alias("n"))


@query("c16_latest_notification", f"SELECT p.user_id, l.last_sent, l.last_sent IS NULL OR epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(l.last_sent) >= CASE WHEN frequency = 'WEEKLY' THEN 7 ELSE 1 END * 86400 AS due FROM prefs p LEFT JOIN (SELECT user_id, max(created_at) AS last_sent FROM notifications WHERE kind = 'NEW_ELIGIBLE_JOB' GROUP BY 1) l ON l.user_id = p.user_id", PREFS)
def _(t):
    return op.digest_due(prefs(t), t.notifications, F.lit(f"{AS_OF} 00:00:00").cast("timestamp")).select("user_id", "last_sent", "due")


SEEN = "seen AS (SELECT job_id, source_url, bool_or(is_official) AS is_official, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM sightings GROUP BY 1, 2)"


@query("c17_job_sources", "SELECT job_id, string_agg(source_url, ' ' ORDER BY is_official DESC, last_seen DESC, source_url) AS sources FROM seen GROUP BY 1", SEEN)
def _(t):
    seen = t.sightings.groupBy("job_id", "source_url").agg(F.bool_or("is_official").alias("is_official"), F.max("seen_at").alias("last_seen"))
    return op.job_sources(seen).select("job_id", F.array_join("sources", " ").alias("sources"))


# --- D: aggregates --------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (status = 'ACTIVE' AND verdict = '{v}') AS {v.lower()}" for v in op.VERDICTS)


@query("d1_company_rollup", f"SELECT c.company_id, coalesce(active, 0) AS active, coalesce(eligible, 0) AS eligible, coalesce(uncertain, 0) AS uncertain, coalesce(ineligible, 0) AS ineligible, coalesce(unverified, 0) AS unverified FROM companies c LEFT JOIN (SELECT company_id, count(*) FILTER (status = 'ACTIVE') AS active, {_COUNTS}, count(*) FILTER (verification = 'UNVERIFIED') AS unverified FROM rows GROUP BY 1) r ON r.company_id = c.company_id", ROWS)
def _(t):
    return op.company_rollup(t.companies, t.postings, t.verdicts).select("company_id", "active", "eligible", "uncertain", "ineligible", "unverified")


@query("d1_rollup_by_deltas", SELECTS["d1_company_rollup"], ROWS)
def _(t):
    """Counters stored before two batches, and the batches' deltas: new postings, then changed ones."""
    n = F.col("id").cast("long")
    now = op.with_verdict(t.postings, t.verdicts).select("id", "company_id", "status", "verification", "verdict")
    old = now.withColumn("status", F.when(n % 5 == 0, "ACTIVE").otherwise(F.col("status"))).withColumn("verification", F.when(n % 11 == 0, "UNVERIFIED").otherwise(F.col("verification")))
    first, changed = n % 7 != 3, (n % 5 == 0) | (n % 11 == 0)
    none, key, what = old.where("false"), ["company_id"], rollup_deltas.company_counters()
    stored = rollup_deltas.deltas(none, old.where(first), key, what)
    for before, after in ((none, old.where(~first)), (old.where(changed), now.where(changed))):
        stored = rollup_deltas.applied(stored, rollup_deltas.deltas(before, after, key, what), key)
    names = list(what)
    return t.companies.select("company_id").join(stored, "company_id", "left").select("company_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


@query("d2_dashboard", f"SELECT c.*, coalesce(active_jobs, 0) AS active_jobs, coalesce(eligible, 0) AS eligible_jobs, coalesce(uncertain, 0) AS uncertain_jobs, coalesce(ineligible, 0) AS ineligible_jobs, coalesce(new_today, 0) AS new_today, coalesce(closing_soon, 0) AS closing_soon FROM (SELECT user_id, count(*) AS companies, max(last_researched_on) AS last_researched FROM companies GROUP BY 1) c LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'ACTIVE') AS active_jobs, {_COUNTS}, count(*) FILTER (status = 'ACTIVE' AND first_seen_on >= DATE '{AS_OF}') AS new_today, count(*) FILTER (status = 'ACTIVE' AND closing_at BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 7) AS closing_soon FROM rows GROUP BY 1) r ON r.user_id = c.user_id", ROWS)
def _(t):
    return op.dashboard(t.companies, t.postings, t.verdicts, today())


@query("d3_facets", " UNION ALL ".join(f"(SELECT DISTINCT '{c}' AS facet, {c} AS value FROM postings WHERE status = 'ACTIVE' AND trim({c}) <> '' ORDER BY value LIMIT 100)" for c in ("location", "department", "employment_type")))
def _(t):
    return op.facets(t.postings)


@query("d4_total", "SELECT count(*) AS total FROM rows WHERE status = 'ACTIVE'", ROWS)
def _(t):
    return op.with_total(op.job_filter(rows(t), today()))


@query("d5_list_length", "SELECT job_id, CASE WHEN skills_required_list = '' THEN 0 ELSE len(string_split(skills_required_list, ';')) END AS missing_count FROM requirements")
def _(t):
    return t.requirements.select("job_id", F.size(F.filter(F.split("skills_required_list", ";"), lambda x: x != "")).alias("missing_count"))


@query("d6_unread_count", "SELECT user_id, count(*) FILTER (read_at IS NULL) AS unread, count(*) AS attempted FROM notifications GROUP BY 1")
def _(t):
    return t.notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"), F.count("*").alias("attempted"))


@query("d12_date_coverage", "SELECT company_id, count(posted_at) AS with_posted, count(closing_at) AS with_deadline, count(*) AS total FROM postings GROUP BY 1")
def _(t):
    return t.postings.groupBy("company_id").agg(F.count("posted_at").alias("with_posted"), F.count("closing_at").alias("with_deadline"), F.count("*").alias("total"))


# --- E: sorts and limits --------------------------------------------------------------------------

_SORTS = {"NEWEST": "first_seen_on DESC, id", "OLDEST": "posted_at NULLS LAST, id", "DEADLINE": "closing_at NULLS LAST, id", "ELIGIBILITY": "CASE verdict WHEN 'ELIGIBLE' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 2 END, match_score DESC NULLS LAST, id"}


@query("e1_job_sorts", " UNION ALL ".join(f"(SELECT '{s}' AS sort, id FROM rows ORDER BY {k} LIMIT 40)" for s, k in _SORTS.items()), ROWS)
def _(t):
    parts = [op.page(rows(t), op.list_order(s), 40).select(F.lit(s).alias("sort"), "id") for s in _SORTS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


_COMPANY_SORTS = {"NEWEST": "coalesce(posted_at, DATE '1970-01-01') DESC, id", "OLDEST": "coalesce(posted_at, DATE '1970-01-01'), id", "DEADLINE": "closing_at NULLS LAST, id", "ELIGIBILITY": "CASE verdict WHEN 'ELIGIBLE' THEN 0 WHEN 'UNCERTAIN' THEN 1 WHEN 'INELIGIBLE' THEN 2 ELSE 3 END, coalesce(posted_at, DATE '1970-01-01') DESC, id"}


@query("e2_company_sorts", " UNION ALL ".join(f"(SELECT '{s}' AS sort, id FROM rows WHERE company_id = '10' ORDER BY {k} LIMIT 5)" for s, k in _COMPANY_SORTS.items()), ROWS)
def _(t):
    mine = rows(t).where("company_id = '10'")
    parts = [op.page(mine, op.company_order(s), 5).select(F.lit(s).alias("sort"), "id") for s in _COMPANY_SORTS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("e3_page_offset", "SELECT id FROM rows WHERE status = 'ACTIVE' ORDER BY first_seen_on DESC, id LIMIT 50 OFFSET 100", ROWS)
def _(t):
    return op.page(op.job_filter(rows(t), today()), op.list_order("NEWEST"), 50, 100).select("id")


@query("e3_deep_page", "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY first_seen_on DESC, id) AS place, count(*) OVER () AS total FROM rows) WHERE place > total // 2 AND place <= total // 2 + 50", ROWS)
def _(t):
    pages = op.SortedPages(rows(t).select("id", "first_seen_on"), op.list_order("NEWEST"))
    at = Window.orderBy(*op.list_order("NEWEST"))  # of 50 rows
    return pages.page(50, pages.total // 2).select("id", (F.row_number().over(at) + pages.total // 2).cast("long").alias("place"))


@query("e10_recent_runs", "SELECT user_id, run_id, rank FROM (SELECT user_id, run_id, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, run_id) AS rank FROM runs) WHERE rank <= 5")
def _(t):
    return op.top_k(t.runs, ["user_id"], 5, F.desc("started_at"), F.asc("run_id")).select("user_id", "run_id", "rank")


_NEXT = "next AS (SELECT company_id, last_researched_on + INTERVAL 1 HOUR * CASE refresh_mode WHEN 'EVERY_6H' THEN 6 WHEN 'EVERY_12H' THEN 12 WHEN 'DAILY' THEN 24 END AS next_research_at FROM companies)"


@query("e11_due_companies", f"SELECT company_id, next_research_at FROM next WHERE next_research_at <= TIMESTAMP '{AS_OF} 00:00:00' AND company_id NOT IN (SELECT company_id FROM runs WHERE status = 'FAILED') ORDER BY next_research_at, company_id LIMIT 5", _NEXT)
def _(t):
    failed = t.runs.where("status = 'FAILED'").select("company_id").distinct()
    due = op.due_companies(op.next_research(t.companies, lx.REFRESH_HOURS), F.lit(f"{AS_OF} 00:00:00").cast("timestamp"), failed)
    return due.select("company_id", F.col("next_research_at").cast("timestamp_ntz").alias("next_research_at"))


@query("i10_refresh_schedule", "SELECT * FROM next", _NEXT)
def _(t):
    return op.next_research(t.companies, lx.REFRESH_HOURS).select("company_id", F.col("next_research_at").cast("timestamp_ntz").alias("next_research_at"))


@query("e13_distinct_keep_first", "SELECT user_id, array_to_string(list_sort(list_distinct(string_split(skill_list || ';Python;' || skill_list, ';'))), ',') AS skills FROM profiles WHERE skill_list <> ''")
def _(t):
    doubled = F.split(F.concat("skill_list", F.lit(";Python;"), "skill_list"), ";")
    return t.profiles.where("skill_list <> ''").select("user_id", F.array_join(F.array_sort(F.array_distinct(F.filter(doubled, lambda x: x != ""))), ",").alias("skills"))


@query("e14_dashboard_bundle", f"""SELECT u.user_id, coalesce(a.n, 0) AS active_jobs, coalesce(e.ids, '') AS eligible, coalesce(c.n, 0) AS closing, coalesce(r.ids, '') AS runs FROM profiles u
 LEFT JOIN (SELECT user_id, count(*) AS n FROM postings WHERE status = 'ACTIVE' GROUP BY 1) a ON a.user_id = u.user_id
 LEFT JOIN (SELECT user_id, string_agg(id, ',' ORDER BY k) AS ids FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY first_seen_on DESC, id) AS k FROM rows WHERE verdict = 'ELIGIBLE') WHERE k <= 8 GROUP BY 1) e ON e.user_id = u.user_id
 LEFT JOIN (SELECT user_id, count(*) AS n FROM postings WHERE status = 'ACTIVE' AND closing_at BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 7 GROUP BY 1) c ON c.user_id = u.user_id
 LEFT JOIN (SELECT user_id, string_agg(run_id, ',' ORDER BY k) AS ids FROM (SELECT user_id, run_id, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, run_id) AS k FROM runs) WHERE k <= 5 GROUP BY 1) r ON r.user_id = u.user_id""", ROWS)
def _(t):
    listed = lambda df, c: df.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]), ",").alias(c))
    eligible = listed(op.top_k(rows(t).where("verdict = 'ELIGIBLE'"), ["user_id"], 8, F.desc("first_seen_on"), F.asc("id")), "id").withColumnRenamed("id", "eligible")
    runs = listed(op.top_k(t.runs, ["user_id"], 5, F.desc("started_at"), F.asc("run_id")), "run_id").withColumnRenamed("run_id", "runs")
    summary = op.dashboard(t.companies, t.postings, t.verdicts, today()).select("user_id", "active_jobs", F.col("closing_soon").alias("closing"))
    out = t.profiles.select("user_id").join(summary, "user_id", "left").join(eligible, "user_id", "left").join(runs, "user_id", "left")
    return out.select("user_id", F.coalesce("active_jobs", F.lit(0)).alias("active_jobs"), F.coalesce("eligible", F.lit("")).alias("eligible"), F.coalesce("closing", F.lit(0)).alias("closing"), F.coalesce("runs", F.lit("")).alias("runs"))


@query("a23_csv_export", f"""SELECT coalesce(nullif(trim(company_name), ''), '{op.NOT_STATED}') AS "Company", title AS "Role", coalesce(verdict, '{op.NOT_STATED}') AS "Verdict", coalesce(CAST(match_score AS STRING), '{op.NOT_STATED}') AS "Match score (%)", coalesce(nullif(trim(department), ''), '{op.NOT_STATED}') AS department, CASE WHEN is_official THEN 'Yes' ELSE 'No (third-party listing)' END AS "Source is official", coalesce(regexp_replace(CAST(experience_min AS STRING), '\\.0$', ''), '{op.NOT_STATED}') AS "Experience (min yrs)", coalesce(CAST(closing_at AS STRING), '{op.NOT_STATED}') AS "Closing date", id FROM rows""", ROWS)
def _(t):
    none = F.array().cast("array<string>")
    wide = rows(t).withColumns({"work_arrangement": tx.work_arrangement(F.col("location")), "required_skills": none, "preferred_skills": none, "also_seen_at": none, "last_verified_at": F.lit(None).cast("date")})
    keyed = wide.withColumn("external_job_id", F.col("id"))
    out = op.export_rows(keyed.withColumn("salary", F.col("department")))
    return out.select("Company", "Role", "Verdict", "Match score (%)", F.col("Salary").alias("department"), "Source is official", "Experience (min yrs)", "Closing date", F.col("Job ID").alias("id"))


@query("a24_digest", f"SELECT user_id, count(*) AS jobs, string_agg(title || ' - ' || company_name || ' - ' || coalesce(CAST(closing_at AS STRING), 'no deadline'), chr(10) ORDER BY k) AS body FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY closing_at NULLS LAST, id) AS k FROM rows WHERE verdict = 'ELIGIBLE') WHERE k <= 25 AND (closing_at IS NULL OR closing_at <= DATE '{AS_OF}' + 7) GROUP BY 1", ROWS)
def _(t):
    return op.digest(rows(t), today(), 7)
