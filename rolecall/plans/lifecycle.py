"""Queries of duplicates, reconciliation, upserts and histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..operators import lifecycle as lc
from ..operators import listing
from ..storage import written
from ..streaming import folds
from .fixtures import AS_OF, Tables
from .listing import PREFS, SEEN, prefs, today
from .registry import SELECTS, query
from .texts import _KEY, _LOC, _plain, _tokens

_SLUG = "left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120)"
_FP = f"CASE WHEN trim(coalesce(external_job_id, '')) <> '' THEN 'eid:' || company_id || ':' || {_plain('external_job_id')} ELSE 'tl:' || company_id || ':' || {_SLUG} || ':' || CASE WHEN {_LOC} = '' THEN 'noloc' ELSE {_LOC} END END"
_FULL = [f for f in lx.COMPLETENESS_FIELDS if f != "required_skills"]
_DONE = " + ".join(f"CASE WHEN trim(CAST({f} AS STRING)) <> '' THEN 1 ELSE 0 END" for f in _FULL)
_RANK = f"CASE WHEN is_official THEN 1000 ELSE 0 END + CASE verification WHEN 'VERIFIED_ACTIVE' THEN 400 WHEN 'UNVERIFIED' THEN 50 ELSE 100 END + ({_DONE}) * 10 - CASE WHEN status = 'ACTIVE' THEN 0 ELSE 20 END"
_PRINTS = f"prints AS (SELECT *, {_FP} AS fingerprint FROM postings), ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id, fingerprint ORDER BY {_RANK} DESC, source_url, id) AS k FROM prints)"


def _grouped(source: str, name: str) -> str:
    """A CTE of merged groups of ``source`` (with fingerprint and k)."""
    fills = ", ".join(f"arg_min({f}, k) FILTER (trim(CAST({f} AS STRING)) <> '') AS {f}" for f in _FULL)
    rest = ", ".join(f"arg_min({c}, k) FILTER ({c} IS NOT NULL) AS {c}" for c in ("id", "title", "location", "status", "verification", "is_official", "source_url"))
    return f"{name} AS (SELECT company_id, fingerprint, {rest}, {fills}, min(first_seen_on) AS first_seen_on, count(*) AS merged, string_agg(source_url, ' ' ORDER BY source_url) FILTER (k > 1) AS also FROM {source} GROUP BY ALL)"


def printed(t: Tables) -> DataFrame:
    return t.postings.withColumn("fingerprint", lc.fingerprint())


@query("d8_fingerprint", "SELECT id, fingerprint FROM prints", _PRINTS)
def _(t):
    return printed(t).select("id", "fingerprint")


@query("d7_fingerprint_groups", "SELECT company_id, fingerprint, count(*) AS n FROM prints GROUP BY ALL", _PRINTS)
def _(t):
    return printed(t).groupBy("company_id", "fingerprint").agg(F.count("*").alias("n"))


@query("d10_survivors", "SELECT fingerprint, id, title, description, posted_at, closing_at, employment_type, salary, department, first_seen_on, merged, coalesce(also, '') AS also FROM merged", _PRINTS, _grouped("ranked", "merged"))
def _(t):
    m = lc.merge_groups(printed(t))
    return m.select("fingerprint", "id", "title", "description", "posted_at", "closing_at", "employment_type", "salary", "department", "first_seen_on", "merged", F.array_join("also_seen_at", " ").alias("also"))


@query("d11_completeness", f"SELECT id, {_DONE} AS completeness FROM postings")
def _(t):
    return t.postings.select("id", lc.completeness(t.postings).alias("completeness"))


# --- a stored snapshot and a collected batch ------------------------------------------------------

_MOD = "CAST(id AS BIGINT)"
_BATCH = (
    f"old AS (SELECT *, row_number() OVER (PARTITION BY company_id, fingerprint ORDER BY {_RANK} DESC, source_url, id) AS k FROM prints WHERE {_MOD} % 5 <> 0)",
    f"fresh AS (SELECT * REPLACE (CASE WHEN {_MOD} % 7 = 0 THEN 'INR 99 LPA' ELSE salary END AS salary) FROM prints WHERE {_MOD} % 4 <> 1)",
    f"new AS (SELECT *, row_number() OVER (PARTITION BY company_id, fingerprint ORDER BY {_RANK} DESC, source_url, id) AS k FROM fresh)",
    _grouped("old", "existing"), _grouped("new", "collected"),
    "sources AS (SELECT company_id, CAST(company_id AS BIGINT) % 3 <> 0 AS source_verified FROM companies)",
)
_FORM = lambda a, f: f"trim(regexp_replace(lower(coalesce(regexp_replace(CAST({a}.{f} AS STRING), '\\.0$', ''), '')), '[^a-z0-9]+', ' ', 'g'))"
_CHANGED = " OR ".join(f"{_FORM('e', f)} <> {_FORM('c', f)}" for f in lx.WATCHED_FIELDS)
_RECONCILE = f"""acted AS (SELECT coalesce(e.company_id, c.company_id) AS company_id, coalesce(e.fingerprint, c.fingerprint) AS fingerprint, coalesce(e.id, c.id) AS id,
  CASE WHEN e.id IS NULL THEN 'NEW' WHEN c.id IS NOT NULL AND e.status IN ('EXPIRED', 'REMOVED') THEN 'KEPT_CLOSED' WHEN c.id IS NOT NULL THEN 'SEEN' WHEN s.source_verified AND e.status NOT IN ('EXPIRED', 'REMOVED') THEN 'REMOVED' ELSE 'UNTOUCHED' END AS action,
  e.status AS was, e.verification AS was_verified, c.closing_at < DATE '{AS_OF}' AS expired, {_CHANGED} AS differs, e.closing_at AS e_closing, c.closing_at AS c_closing, e.salary AS e_salary, c.salary AS c_salary
  FROM existing e FULL JOIN collected c ON e.company_id = c.company_id AND e.fingerprint = c.fingerprint LEFT JOIN sources s ON s.company_id = coalesce(e.company_id, c.company_id)),
done AS (SELECT company_id, fingerprint, id, action, CASE WHEN action IN ('NEW', 'SEEN') THEN CASE WHEN expired THEN 'EXPIRED' ELSE 'ACTIVE' END WHEN action = 'REMOVED' THEN 'REMOVED' ELSE was END AS status,
  CASE WHEN action IN ('NEW', 'SEEN') THEN 'VERIFIED_ACTIVE' WHEN action = 'REMOVED' THEN 'LAST_VERIFIED_UNAVAILABLE' ELSE was_verified END AS verification,
  CASE action WHEN 'NEW' THEN true WHEN 'SEEN' THEN differs ELSE false END AS changed, CASE WHEN action IN ('NEW', 'SEEN') THEN coalesce(c_closing, e_closing) ELSE e_closing END AS closing_at, CASE WHEN action IN ('NEW', 'SEEN') THEN c_salary ELSE e_salary END AS salary FROM acted)"""


def printed_once(t: Tables) -> DataFrame:
    """``printed``, written: a snapshot and a batch of one query share it, as a stored snapshot would."""
    if not hasattr(t, "prints"):
        t.prints = written(printed(t), "fingerprints")
    return t.prints


def stored(t: Tables) -> DataFrame:
    return lc.merge_groups(printed_once(t).where(F.col("id").cast("long") % 5 != 0))


def batch(t: Tables) -> DataFrame:
    n = F.col("id").cast("long")
    return lc.merge_groups(printed_once(t).where(n % 4 != 1).withColumn("salary", F.when(n % 7 == 0, "INR 99 LPA").otherwise(F.col("salary"))))


def sources(t: Tables) -> DataFrame:
    return t.companies.select("company_id", (F.col("company_id").cast("long") % 3 != 0).alias("source_verified"))


def reconciled(t: Tables) -> DataFrame:
    return lc.reconcile(stored(t), batch(t), sources(t), today())


@query("c6_reconcile", "SELECT fingerprint, id, action, status, verification, changed, closing_at, salary FROM done", _PRINTS, *_BATCH, _RECONCILE)
def _(t):
    return reconciled(t).select("fingerprint", "id", "action", "status", "verification", "changed", "closing_at", "salary")


@query("c7_removals", "SELECT fingerprint, id, status FROM done WHERE action = 'REMOVED'", _PRINTS, *_BATCH, _RECONCILE)
def _(t):
    return lc.removals(stored(t), batch(t), sources(t)).select("fingerprint", "id", "status")


@query("i5_lifecycle_rules", "SELECT action, status, count(*) AS n FROM done GROUP BY ALL", _PRINTS, *_BATCH, _RECONCILE)
def _(t):
    return reconciled(t).groupBy("action", "status").agg(F.count("*").alias("n"))


@query("i6_change_detection", "SELECT fingerprint, differs AS changed FROM acted WHERE action = 'SEEN'", _PRINTS, *_BATCH, _RECONCILE)
def _(t):
    e, c = stored(t).alias("e"), batch(t).alias("c")
    both = e.join(c, (F.col("e.company_id") == F.col("c.company_id")) & (F.col("e.fingerprint") == F.col("c.fingerprint")))
    return both.where(~F.col("e.status").isin("EXPIRED", "REMOVED")).select("e.fingerprint", lc.changed().alias("changed"))


@query("d13_run_summary", "SELECT company_id, count(*) FILTER (action IN ('NEW', 'SEEN', 'KEPT_CLOSED')) AS found, count(*) FILTER (action = 'NEW') AS new_jobs, count(*) FILTER (action = 'SEEN' AND changed) AS updated, count(*) FILTER (action = 'REMOVED') AS removed FROM done GROUP BY 1", _PRINTS, *_BATCH, _RECONCILE)
def _(t):
    a = F.col("action")
    return reconciled(t).groupBy("company_id").agg(F.count_if(a.isin("NEW", "SEEN", "KEPT_CLOSED")).alias("found"), F.count_if(a == "NEW").alias("new_jobs"), F.count_if((a == "SEEN") & F.col("changed")).alias("updated"), F.count_if(a == "REMOVED").alias("removed"))


@query("i1_job_upsert", "SELECT coalesce(e.id, c.id) AS id, coalesce(c.fingerprint, e.fingerprint) AS fingerprint, CASE WHEN c.id IS NULL THEN e.salary ELSE c.salary END AS salary, coalesce(e.first_seen_on, c.first_seen_on) AS first_seen_on FROM existing e FULL JOIN collected c ON e.company_id = c.company_id AND e.fingerprint = c.fingerprint", _PRINTS, *_BATCH)
def _(t):
    return lc.upsert_jobs(stored(t), batch(t)).select("id", "fingerprint", "salary", "first_seen_on")


@query("i4_apply_removals", "SELECT e.fingerprint, CASE WHEN d.action = 'REMOVED' THEN 'REMOVED' ELSE e.status END AS status, CASE WHEN d.action = 'REMOVED' THEN 'LAST_VERIFIED_UNAVAILABLE' ELSE e.verification END AS verification FROM existing e JOIN done d ON d.company_id = e.company_id AND d.fingerprint = e.fingerprint", _PRINTS, *_BATCH, _RECONCILE)
def _(t):
    old = stored(t)
    return lc.apply_rows(old, lc.removals(old, batch(t), sources(t)), ["company_id", "fingerprint"]).select("fingerprint", "status", "verification")


_KEYED = f"keyed AS (SELECT id, company_id, posted_at, is_official, nullif({_plain('external_job_id')}, '') AS ext, {_plain('title')} AS nm, {_LOC} AS place, list_distinct({_tokens('title')}) AS w FROM postings)"
_SIM = "len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))"
_ALIKE = "alike AS (SELECT min(id) AS id, company_id, nm, place, posted_at, is_official, any_value(w) AS w FROM keyed WHERE place <> '' GROUP BY company_id, nm, place, posted_at, is_official)"
_T3 = f"x.company_id = y.company_id AND x.place = y.place AND x.place <> '' AND x.nm <> y.nm AND (x.posted_at IS NULL OR y.posted_at IS NULL OR abs(datediff('day', x.posted_at, y.posted_at)) <= 21) AND (x.is_official OR y.is_official) AND {_SIM} >= 0.82"


@query("c8_duplicate_links", f"""SELECT a, id AS b, 1 AS tier, 1.0::DOUBLE AS confidence FROM (SELECT *, min(id) OVER (PARTITION BY company_id, ext) AS a FROM keyed WHERE ext IS NOT NULL) WHERE id <> a
 UNION ALL SELECT a, id, 2, 0.97 FROM (SELECT *, min(id) OVER (PARTITION BY company_id, nm, place) AS a FROM keyed WHERE place <> '') WHERE id <> a
 UNION ALL SELECT x.id, y.id, 3, {_SIM} FROM alike x JOIN alike y ON x.id < y.id AND {_T3}""", _KEYED, _ALIKE)
def _(t):
    return lc.duplicate_links(t.postings)


_TRACKED = f"SELECT x.id FROM keyed x WHERE NOT EXISTS (SELECT 1 FROM keyed y WHERE y.id <> x.id AND x.company_id = y.company_id AND (x.ext = y.ext OR (x.nm = y.nm AND x.place = y.place AND x.place <> '') OR ({_T3})))"


@query("c9_already_tracked", _TRACKED, _KEYED)
def _(t):
    return lc.already_tracked(t.postings, t.postings).select("id")


# --- upserts and histories ------------------------------------------------------------------------


@query("i2_source_sightings", "SELECT job_id, source_url, min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_min(is_official, (seen_at, is_official)) AS is_official FROM sightings GROUP BY ALL", SEEN)
def _(t):
    return lc.sources_seen(t.sightings)


@query("i3_verdict_upsert", "SELECT job_id, user_id, verdict FROM (SELECT job_id, user_id, source_name AS verdict, row_number() OVER (PARTITION BY job_id, user_id ORDER BY seen_at DESC, source_name) AS k FROM (SELECT *, CAST(CAST(job_id AS INT) % 3 AS STRING) AS user_id FROM sightings)) WHERE k = 1")
def _(t):
    stated = t.sightings.select("job_id", (F.col("job_id").cast("int") % 3).cast("string").alias("user_id"), F.col("source_name").alias("verdict"), "seen_at")
    return listing.latest(stated, ["job_id", "user_id"], F.desc("seen_at"), F.asc("verdict")).select("job_id", "user_id", "verdict")


@query("i7_step_fold", "SELECT run_id, step_key, arg_max(state, (ts, seq)) FILTER (state IS NOT NULL) AS state, arg_max(detail, (ts, seq)) FILTER (detail IS NOT NULL) AS detail, min(ts) AS first_at FROM steps GROUP BY ALL")
def _(t):
    return lc.overlay(t.steps, ["run_id", "step_key"], ["ts", "seq"], ["state", "detail"])


@query("i8_run_finish", "SELECT run_id, status, completed_at IS NOT NULL AS finished, epoch(completed_at - started_at) AS seconds FROM runs")
def _(t):
    opened = t.runs.select("run_id", "user_id", "company_id", "started_at", F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit("RUNNING").alias("status"), F.lit(0).alias("seq"))
    closed = t.runs.select("run_id", "user_id", "company_id", "started_at", "completed_at", "status", F.lit(1).alias("seq"))
    last = listing.latest(opened.unionAll(closed), ["run_id"], F.desc("seq"))
    seconds = F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return last.select("run_id", "status", F.col("completed_at").isNotNull().alias("finished"), seconds.cast("double").alias("seconds"))


@query("i9_overlapping_runs", "SELECT run_id FROM (SELECT *, max(coalesce(completed_at, TIMESTAMP '9999-12-31')) OVER (PARTITION BY user_id, company_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM runs) WHERE busy > started_at")
def _(t):
    return lc.overlapping_runs(t.runs).select("run_id")


@query("i11_failure_streaks", "SELECT company_id, count(*) AS failures, max(started_at) AS last_failure, max(started_at) + CASE WHEN count(*) >= 3 THEN INTERVAL 6 HOUR ELSE INTERVAL 10 MINUTE END AS retry_after FROM runs r WHERE status = 'FAILED' AND NOT EXISTS (SELECT 1 FROM runs g WHERE g.company_id = r.company_id AND g.status = 'COMPLETED' AND (g.started_at, g.run_id) >= (r.started_at, r.run_id)) GROUP BY 1")
def _(t):
    return lc.failure_streaks(t.runs)


_PATCH = "patches AS (SELECT user_id, CAST(user_id AS INT) % 2 = 0 AS has_degree, CASE WHEN CAST(user_id AS INT) % 4 = 0 THEN NULL ELSE 'M.Tech' END AS degree, CAST(user_id AS INT) % 3 = 0 AS has_branch, 'Physics' AS branch FROM profiles)"


@query("i12_profile_patch", "SELECT p.user_id, CASE WHEN has_degree THEN x.degree ELSE p.degree END AS degree, CASE WHEN has_branch THEN x.branch ELSE p.branch END AS branch, p.graduation_year FROM profiles p LEFT JOIN patches x ON x.user_id = p.user_id", _PATCH)
def _(t):
    n = F.col("user_id").cast("int")
    present = F.array_compact(F.array(F.when(n % 2 == 0, "degree"), F.when(n % 3 == 0, "branch")))
    patches = t.profiles.select("user_id", present.alias("present"), F.when(n % 4 != 0, "M.Tech").alias("degree"), F.lit("Physics").alias("branch"))
    return lc.patch(t.profiles.select("user_id", "degree", "branch", "graduation_year"), patches, "user_id", ["degree", "branch"])


_COMP = f"keyed AS (SELECT *, {_KEY} AS normalized_name FROM companies), held AS (SELECT user_id, normalized_name, min(company_id) AS company_id FROM keyed WHERE CAST(company_id AS INT) % 2 = 0 GROUP BY ALL), cand AS (SELECT user_id, normalized_name, min(company_id) AS company_id FROM keyed GROUP BY ALL)"


@query("i13_company_upsert", "SELECT c.user_id, c.normalized_name, coalesce(h.company_id, c.company_id) AS company_id, coalesce(nullif(hk.careers_url, ''), ck.careers_url) AS careers_url FROM cand c LEFT JOIN held h ON h.user_id = c.user_id AND h.normalized_name = c.normalized_name LEFT JOIN companies hk ON hk.company_id = h.company_id JOIN companies ck ON ck.company_id = c.company_id", _COMP)
def _(t):
    keyed = t.companies.select("user_id", tx.company_key(F.col("name")).alias("normalized_name"), "company_id", "name", "careers_url")
    held = keyed.where(F.col("company_id").cast("int") % 2 == 0)
    old = held.groupBy("user_id", "normalized_name").agg(F.min(F.struct("company_id", "name", "careers_url")).alias("o")).select("user_id", "normalized_name", "o.*")
    return lc.upsert_companies(old, keyed).select("user_id", "normalized_name", "company_id", "careers_url")


_LOST = "gone AS (SELECT company_id FROM companies WHERE refresh_mode = 'MANUAL'), lost AS (SELECT id FROM postings WHERE company_id IN (SELECT company_id FROM gone))"
#: Tables with the company they belong to, and those with a posting; notifications are about the posting with their number.
_CHILDREN = {"companies": ("companies", "company_id"), "jobs": ("postings", "company_id"), "runs": ("runs", "company_id"), "requirements": ("requirements", "job_id"), "verdicts": ("verdicts", "job_id"), "sources": ("sightings", "job_id"), "notifications": ("(SELECT *, id AS job_id FROM notifications)", "job_id")}


@query("i14_cascade_delete", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {table} WHERE {key} NOT IN (SELECT {'company_id FROM gone' if key == 'company_id' else 'id FROM lost'})" for name, (table, key) in _CHILDREN.items()), _LOST)
def _(t):
    tables = {"companies": t.companies, "jobs": t.postings, "runs": t.runs, "requirements": t.requirements, "verdicts": t.verdicts, "sources": t.sightings, "notifications": t.notifications.withColumn("job_id", F.col("id"))}
    left = lc.cascade({name: (df, _CHILDREN[name][1]) for name, df in tables.items()}, t.companies.where("refresh_mode = 'MANUAL'"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return reduce(DataFrame.unionAll, parts)


_HIST = "hist AS (SELECT CAST(user_id % 25 AS STRING) AS user_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(2020 + event_id % 3 AS INT) END AS graduation_year, ts AS updated_at, event_id AS seq FROM events)"


def history(e: DataFrame) -> DataFrame:
    """Profiles' histories out of events, which may be a stream."""
    return e.select((F.col("user_id") % 25).cast("string").alias("user_id"), F.when(F.col("event_id") % 13 != 0, (2020 + F.col("event_id") % 3).cast("int")).alias("graduation_year"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


@query("i15_year_changes", "SELECT user_id, updated_at, seq, 'ELIGIBLE_JOB_CHANGED' AS kind FROM (SELECT *, lag(graduation_year) OVER (PARTITION BY user_id ORDER BY updated_at, seq) AS was FROM hist) WHERE was <> graduation_year", _HIST)
def _(t):
    return lc.year_changes(history(t.raw("events")))


@query("i15_mark_read", f"SELECT id, CASE WHEN read_at IS NULL AND CAST(id AS BIGINT) % 4 = 0 THEN TIMESTAMP '{AS_OF} 00:00:00' ELSE read_at END AS read_at FROM notifications")
def _(t):
    marks = t.notifications.where(F.col("id").cast("long") % 4 == 0).select("id", F.lit(f"{AS_OF} 00:00:00").cast("timestamp_ntz").alias("marked_at"))
    return lc.mark_read(t.notifications, marks.unionAll(marks)).select("id", "read_at")


@query("i16_email_preferences", "SELECT u.user_id, coalesce(p.email IS NOT NULL, false) AS enabled, coalesce(p.frequency, 'DAILY') AS frequency FROM profiles u LEFT JOIN prefs p ON p.user_id = u.user_id", PREFS)
def _(t):
    joined = t.profiles.select("user_id").join(prefs(t), "user_id", "left")
    return joined.select("user_id", F.col("email").isNotNull().alias("enabled"), F.coalesce("frequency", F.lit("DAILY")).alias("frequency"))


_ANSWERS = """answers AS (SELECT id, 'SKILL' AS field, 'SAP' AS value, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN left(description, 12) ELSE 'not in this posting' END AS quote, 1 AS position FROM postings
 UNION ALL SELECT id, 'SKILL', 'PYTHON', upper(substr(description, 3, 10)), 2 FROM postings UNION ALL SELECT id, 'DEGREE_LEVEL', 'MASTER', right(description, 9), 1 FROM postings UNION ALL SELECT id, 'WORK_AUTH', 'Visa', 'short', 1 FROM postings),
 formed AS (SELECT a.*, trim(regexp_replace(lower(a.quote), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(p.description), '\\s+', ' ', 'g')) AS d FROM answers a JOIN postings p ON p.id = a.id), kept AS (SELECT * FROM formed WHERE length(q) >= 8 AND contains(d, q))"""


@query("c15_answer_merge", """SELECT r.job_id AS id, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(skills_required_list, ';'), lambda s: s <> ''), coalesce((SELECT list(value) FROM kept k WHERE k.id = r.job_id AND field = 'SKILL'), [])))), ',') AS skills,
 CASE WHEN degree_level = 'UNKNOWN' AND EXISTS (SELECT 1 FROM kept k WHERE k.id = r.job_id AND field = 'DEGREE_LEVEL') THEN 'MASTER' ELSE degree_level END AS degree_level FROM requirements r""", _ANSWERS)
def _(t):
    req = t.requirements.select(F.col("job_id").alias("id"), F.filter(F.split("skills_required_list", ";"), lambda s: s != "").alias("skills_required"), "degree_level", F.split("work_auth_list", ";").alias("work_authorization"))
    base = req.join(t.postings.select("id", "description"), "id")
    d, n = F.col("description"), F.col("id").cast("long")
    one = lambda field, value, quote, at: t.postings.select("id", F.lit(field).alias("field"), F.lit(value).alias("value"), quote.alias("quote"), F.lit(at).alias("position"))
    answers = one("SKILL", "SAP", F.when(n % 2 == 0, F.left(d, F.lit(12))).otherwise("not in this posting"), 1).unionAll(one("SKILL", "PYTHON", F.upper(F.substring(d, 3, 10)), 2)).unionAll(one("DEGREE_LEVEL", "MASTER", F.right(d, F.lit(9)), 1)).unionAll(one("WORK_AUTH", "Visa", F.lit("short"), 1))
    m = lc.merge_answers(base, answers)
    return m.select("id", F.array_join(F.array_sort("skills_required"), ",").alias("skills"), "degree_level")


def extracted_rows(t: Tables) -> DataFrame:
    """Each posting as three extractors might give it."""
    base = t.postings.select(F.col("company_id").alias("page_id"), F.col("source_url").alias("url"), "title", "location", "description", "external_job_id", F.col("posted_at").cast("string").alias("posted_at"), F.col("closing_at").cast("string").alias("closing_at"), F.lit("JSON_LD").alias("method"))
    micro = base.withColumns({"method": F.lit("MICRODATA"), "description": F.concat("description", F.lit(" More.")), "external_job_id": F.coalesce("external_job_id", F.lit("m")), "title": F.upper("title")})
    prose = base.withColumns({"method": F.lit("HEURISTIC"), "url": F.concat("url", F.lit("#x")), "posted_at": F.lit(None).cast("string")})
    return base.unionByName(micro).unionByName(prose)


@query("e12_union_of_extractors", "SELECT m.method, p.company_id AS page_id, count(*) AS n FROM postings p, (SELECT unnest(['JSON_LD', 'MICRODATA', 'HEURISTIC']) AS method) m GROUP BY ALL")
def _(t):
    return extracted_rows(t).groupBy("method", "page_id").agg(F.count("*").alias("n"))


_FORMS = """forms AS (SELECT company_id AS page_id, source_url AS url, title, location, description, external_job_id, CAST(posted_at AS VARCHAR) AS posted_at, CAST(closing_at AS VARCHAR) AS closing_at, 'JSON_LD' AS method FROM postings
 UNION ALL SELECT company_id, source_url, upper(title), location, description || ' More.', coalesce(external_job_id, 'm'), CAST(posted_at AS VARCHAR), CAST(closing_at AS VARCHAR), 'MICRODATA' FROM postings
 UNION ALL SELECT company_id, source_url || '#x', title, location, description, external_job_id, NULL, CAST(closing_at AS VARCHAR), 'HEURISTIC' FROM postings)"""
_CLASHES = f"""titled AS (SELECT DISTINCT page_id, url, coalesce(location, '') AS place, list_sort(list_distinct({_tokens("coalesce(title, '')")})) AS w FROM forms),
clashes AS (SELECT DISTINCT x.page_id, x.url AS a, y.url AS b FROM titled x JOIN titled y ON x.page_id = y.page_id AND x.place = y.place AND x.url <> y.url AND len(x.w) > 0 AND len(y.w) > 0 AND {_SIM} > 0.9),
reached AS (SELECT DISTINCT page_id, url, url AS root FROM forms UNION SELECT r.page_id, c.b, r.root FROM reached r JOIN clashes c ON c.page_id = r.page_id AND c.a = r.url),
roots AS (SELECT page_id, url, min(root) AS root FROM reached GROUP BY ALL),
ordered AS (SELECT f.*, root, row_number() OVER (PARTITION BY f.page_id, root ORDER BY method <> 'JSON_LD', -length(coalesce(description, '')), f.url, title) AS k FROM forms f JOIN roots r ON r.page_id = f.page_id AND r.url = f.url)"""


@query("d9_merge_extracted", f"SELECT page_id, root, {', '.join(f'arg_min({c}, k) AS {c}' for c in ('url', 'title', 'location', 'description', 'method'))}, {', '.join(f'arg_min({c}, k) FILTER ({c} IS NOT NULL) AS {c}' for c in ('external_job_id', 'posted_at', 'closing_at'))}, count(*) AS merged FROM ordered GROUP BY page_id, root", _FORMS, _CLASHES)
def _(t):
    return lc.merge_extracted(extracted_rows(t))


# --- streaming forms, checked against the batch SQL -----------------------------------------------


@query("s_i2_sightings_stream", "SELECT job_id, source_url, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM sightings GROUP BY ALL")
def _(t):
    return folds.run_sightings(t)


@query("s_i7_steps_stream", "SELECT run_id, step_key, arg_max(state, (ts, seq)) FILTER (state IS NOT NULL) AS state, arg_max(detail, (ts, seq)) FILTER (detail IS NOT NULL) AS detail FROM steps GROUP BY ALL")
def _(t):
    return folds.run_steps(t)


@query("s_i11_streaks_stream", SELECTS["i11_failure_streaks"])
def _(t):
    return folds.run_streaks(t)


@query("s_i9_overlapping_stream", SELECTS["i9_overlapping_runs"])
def _(t):
    return folds.run_overlaps(t)


@query("s_i15_year_changes_stream", SELECTS["i15_year_changes"], _HIST)
def _(t):
    return folds.run_year_changes(t, history)
