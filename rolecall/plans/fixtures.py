"""Posting tables derived from the driver's tables.

The text is SQL that both Spark and DuckDB read, so that a query and its oracle start from the
same rows.  Every table grows with orders, customer or events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The reference time of all queries.
AS_OF = "1998-06-01"

_TITLES = ("Graduate Process Engineer", "Senior Process Engineer - Refinery", "Chemical Engineer (Trainee)", "Data Analyst", "Production Engineer / Shift Lead", "Process Safety Engineer", "Junior R&D Chemist", "Mechanical Design Engineer", "Process Engineer, Graduate", "Lead Instrumentation Engineer")
_DESCRIPTIONS = (
    "We need a B.Tech in Chemical Engineering with 2-4 years of experience. Python and SQL are required. Experience with Aspen Plus is preferred.",
    "Bachelor of Technology in Mechanical or Production Engineering is required. 5+ years required; must be based in Pune. Six Sigma is a plus.",
    "Freshers are welcome. Degree in Chemistry or Chemical Technology or equivalent. Batch of 2026 only. MATLAB must be known. Drafting is desirable.",
    "Join our team.",
    "M.Tech in Polymer Engineering or related. At least 3 years of work in a plant. Power BI and Excel are mandatory. Willing to relocate is needed.",
    "You will support distillation and heat transfer duties. Minimum 1 year. Candidates must be authorized to work in India. GATE score required. Engineering degree expected.",
    "Graduated in 2024 or before 2025. Up to 2 years of exposure. Bachelor degree in Engineering. Knowledge of process control and plc programming is essential for this long listed role.",
    "Diploma or polytechnic in Civil Engineering. 7 years of relevant experience. Security clearance and communication skills are required in this position, which is at the main site.",
)
_EDUCATION = ("B.Tech Chemical Engineering", "Any graduate", "Diploma in Mechanical Engineering", "MSc Chemistry or Physics")
_LOCATIONS = ("Pune, India", "Remote", "Mumbai (Hybrid)", "  Chennai ", "Pune", "Navi Mumbai")
_DATES = ("2026-09-24T10:00:00Z", "24/09/2026", "09/24/2026", "31/02/2026", "Sep 24, 2026", "24 September 2026", "September 2026", "3 days ago", "2 weeks ago", "just now", "1790208000", "1790208000000", "soon", "04.05.2026", "1 month ago", "24 Foo 2026")


def _case(key: str, values: tuple) -> str:
    """CASE key % n WHEN 0 THEN ... over fixed texts; None is NULL."""
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr_sql(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


def repr_sql(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


#: Twenty customers are one user's companies, so users grow with customers.
_USER_KEY = "CAST(FLOOR(c_custkey / 20) AS BIGINT)"
_USER = f"CAST({_USER_KEY} AS STRING)"

COMPANIES = f"""SELECT CAST(c_custkey AS STRING) AS company_id, {_USER} AS user_id,
  {_case('c_custkey', ('Tata Chemicals Limited', 'Acme & Sons Pvt. Ltd.', "O''Neil Group Holdings".replace("''", "'"), 'The Company', 'Delta Corp', 'delta corporation', 'Blue-Sky Process'))} || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ' ' || CAST(c_custkey % 40 AS STRING) || ' ltd.' END AS name,
  {_case('c_custkey', ('DAILY', 'EVERY_12H', 'EVERY_6H', 'MANUAL'))} AS refresh_mode,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(DATE '1998-05-28' + MAKE_D(c_custkey % 6) AS DATE) END AS last_researched_on,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'https://careers.c' || CAST(c_custkey % 50 AS STRING) || '.example.com/jobs/' END AS careers_url
FROM {{customer}}"""

POSTINGS = f"""SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS company_id, {_USER} AS user_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'REQ-' || CAST(o_orderkey % 40 AS STRING) ELSE NULL END AS external_job_id,
  {_case('o_orderkey', _TITLES)} AS title,
  {_case('(o_orderkey + o_custkey)', _DESCRIPTIONS)} AS description,
  {_case('o_orderkey', _EDUCATION + (None, None, None, None, None))} AS education_requirement,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey % 7 AS DOUBLE) ELSE NULL END AS experience_min,
  CASE WHEN o_orderkey % 26 = 0 THEN CAST(o_orderkey % 7 + 2 AS DOUBLE) ELSE NULL END AS experience_max,
  {_case('o_custkey', _LOCATIONS)} AS location,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Operations' WHEN o_orderkey % 4 = 2 THEN ' ' ELSE 'R_D%' END AS department,
  {_case('o_orderkey', ('Full-time', 'Contract', None, 'Internship', 'full time'))} AS employment_type,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS posted_at,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + MAKE_D(o_orderkey % 90) AS DATE) END AS closing_at,
  {_case('o_orderkey', _DATES)} AS posted_text,
  CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END ELSE 'REMOVED' END AS status,
  {_case('o_orderkey', ('VERIFIED_ACTIVE', 'UNVERIFIED', 'LAST_VERIFIED_UNAVAILABLE', 'VERIFIED_ACTIVE'))} AS verification,
  o_orderkey % 2 = 0 AS is_official,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'INR ' || CAST(o_orderkey % 12 AS STRING) || ' LPA' END AS salary,
  'https://jobs.c' || CAST(o_custkey % 50 AS STRING) || '.example.com/p/' || CAST(o_orderkey AS STRING) AS source_url,
  CAST(CAST(o_orderdate AS DATE) + MAKE_D(1) AS DATE) AS first_seen_on
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"""

PROFILES = f"""SELECT CAST(u AS STRING) AS user_id, 'User' || CAST(u AS STRING) || '@Example.com' AS email,
  {_case('u', ('B.Tech', 'M.Sc', 'Diploma', 'BE', ' '))} AS degree,
  {_case('u', ('Chemical Engineering', 'Chemistry', 'Mechanical Engineering', 'Petroleum', 'Chemical Engineering', 'Process Engineering', ''))} AS branch,
  CAST(CASE WHEN u % 8 = 7 THEN NULL ELSE 2020 + u % 8 END AS INT) AS graduation_year,
  CAST(u % 7 AS DOUBLE) AS years_of_experience,
  {_case('u', ('Python;SQL;Power BI', 'Excel', '', 'MS Excel;Python;aspen plus;GATE'))} AS skill_list,
  {_case('u', ('Pune', 'Mumbai;Delhi', ''))} AS preferred_list,
  {_case('u', ('Indian citizenship;work authorization', '', 'US citizen'))} AS auth_list,
  u % 2 = 0 AS willing_to_relocate
FROM (SELECT DISTINCT {_USER_KEY} AS u FROM {{customer}})"""

VERDICTS = f"""SELECT CAST(o_orderkey AS STRING) AS job_id, {_USER} AS user_id,
  {_case('o_orderkey', ('ELIGIBLE', 'INELIGIBLE', 'UNCERTAIN', 'ELIGIBLE', 'UNCERTAIN'))} AS verdict,
  CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END AS match_score
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0"""

#: Requirements as flat columns, for verdict checks apart from extraction.
REQUIREMENTS = f"""SELECT CAST(o_orderkey AS STRING) AS job_id,
  {_case('o_orderkey', ('BACHELOR', 'UNKNOWN', 'MASTER', 'DIPLOMA', 'DOCTORATE', 'ANY'))} AS degree_level,
  {_case('o_orderkey', ('CHEMICAL_ENGINEERING', '', 'CHEMISTRY;GENERAL_ENGINEERING', 'POLYMER_ENGINEERING', 'CIVIL_ENGINEERING;CHEMISTRY', 'CHEMICAL_TECHNOLOGY', 'BIOLOGY'))} AS field_list,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 8 AS DOUBLE) END AS experience_min,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 + 2 AS DOUBLE) ELSE NULL END AS experience_max,
  o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0 AS experience_stated,
  CASE WHEN o_orderkey % 4 = 0 THEN 2024 ELSE NULL END AS grad_year_min,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 4 <> 2 THEN 2025 ELSE 2022 END AS grad_year_max,
  o_orderkey % 3 <> 1 AS grad_year_stated,
  {_case('o_orderkey', ('batch of 2024', 'before 2025'))} AS grad_year_raw,
  {_case('o_orderkey', ('PYTHON;SQL;EXCEL', 'PYTHON', '', 'POWER_BI;SQL', 'GIT;SAP;MATLAB;PYTHON'))} AS skills_required_list,
  {_case('o_orderkey', ('', 'EXCEL;TABLEAU', 'SQL'))} AS skills_preferred_list,
  {_case('o_orderkey', ('', 'GATE', 'GATE;Six Sigma', ''))} AS certification_list,
  o_orderkey % 6 = 1 AS location_restricted,
  {_case('o_orderkey', (None, 'Indian citizenship', None, 'Work authorization;Security clearance', None, ''))} AS work_auth_list
FROM {{orders}}"""

SIGHTINGS = f"""SELECT CAST(user_id % 200 AS STRING) AS job_id, 'https://s' || CAST(event_id % 5 AS STRING) || '.example.com/' || event_type AS source_url,
  event_type AS source_name, event_id % 3 = 0 AS is_official, ts AS seen_at FROM {{events}}"""

STEPS = f"""SELECT 'run' || CAST(user_id % 300 AS STRING) AS run_id, event_type AS step_key, event_id AS seq, ts,
  {_case('event_id', ('ACTIVE', None, 'DONE', 'FAILED', 'ACTIVE'))} AS state,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'detail ' || CAST(event_id % 9 AS STRING) END AS detail FROM {{events}}"""

RUNS = f"""SELECT CAST(event_id AS STRING) AS run_id, CAST(user_id % 25 AS STRING) AS user_id, CAST(user_id % 120 AS STRING) AS company_id, ts AS started_at,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + MAKE_M(event_id % 700) END AS completed_at,
  {_case('event_id', ('COMPLETED', 'FAILED', 'FAILED', 'COMPLETED', 'FAILED', 'FAILED', 'FAILED'))} AS status FROM {{events}}"""

NOTIFICATIONS = f"""SELECT CAST(event_id AS STRING) AS id, CAST(user_id % 25 AS STRING) AS user_id, {_case('event_id', ('NEW_ELIGIBLE_JOB', 'ELIGIBLE_JOB_CHANGED', 'PROFILE_COMPLETE'))} AS kind,
  CASE WHEN event_id % 3 = 0 THEN ts ELSE NULL END AS read_at, ts AS created_at FROM {{events}}"""

_ALL = {
    "companies": (COMPANIES, ("customer",)), "postings": (POSTINGS, ("orders", "customer")), "profiles": (PROFILES, ("customer",)),
    "verdicts": (VERDICTS, ("orders", "customer")), "requirements": (REQUIREMENTS, ("orders",)), "sightings": (SIGHTINGS, ("events",)),
    "steps": (STEPS, ("events",)), "runs": (RUNS, ("events",)), "notifications": (NOTIFICATIONS, ("events",)),
}


def _dialect(sql: str, engine: str) -> str:
    """MAKE_D(n) is an interval of n days, MAKE_M(n) one of n minutes."""
    if engine == "spark":
        return sql.replace("MAKE_D(", "MAKE_DT_INTERVAL(").replace("MAKE_M(", "MAKE_DT_INTERVAL(0, 0, ")
    return sql.replace("MAKE_D(", "DAYS_OF(").replace("MAKE_M(", "MINUTES_OF(").replace("DAYS_OF(", "INTERVAL 1 DAY * (").replace("MINUTES_OF(", "INTERVAL 1 MINUTE * (")


def duckdb_with(*extra: str) -> str:
    """The WITH clause that defines all derived tables for DuckDB."""
    parts = []
    for name, (sql, tables) in _ALL.items():
        text = _dialect(sql, "duckdb")
        for t in tables:
            text = text.replace(f"{{{t}}}", t)
        parts.append(f"{name} AS ({text})")
    # some tables follow links until none is new
    return "WITH RECURSIVE " + ",\n".join([*parts, *extra]) + "\n"


def tasks(spark: SparkSession) -> int:
    """In how many parts rows are dealt for dear work: several for each core, so that none waits long for the last."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Tables:
    """The driver's tables of one folder and the tables derived from them, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        return self.derived_from(name, {t: self.raw(t) for t in _ALL[name][1]})

    def derived_from(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        """The derived table over the given ones, which may be streams."""
        return self.spark.sql(_dialect(_ALL[name][0], "spark"), **tables)

    @cached_property
    def dealt_postings(self) -> DataFrame:
        """``postings`` dealt to all cores, for dear work on each row: a file of one row group is one task.

        Orders are dealt by their key before texts are made of them, so little is shuffled.
        """
        orders = self.raw("orders")
        return self.derived_from("postings", {"orders": orders.repartition(tasks(self.spark), "o_orderkey"), "customer": self.raw("customer")})

    @cached_property
    def dealt_companies(self) -> DataFrame:
        """``companies`` dealt to all cores, as ``dealt_postings`` are."""
        return self.derived_from("companies", {"customer": self.raw("customer").repartition(tasks(self.spark), "c_custkey")})

    companies = cached_property(lambda self: self.derived("companies"))
    postings = cached_property(lambda self: self.derived("postings"))
    profiles = cached_property(lambda self: self.derived("profiles"))
    verdicts = cached_property(lambda self: self.derived("verdicts"))
    requirements = cached_property(lambda self: self.derived("requirements"))
    sightings = cached_property(lambda self: self.derived("sightings"))
    steps = cached_property(lambda self: self.derived("steps"))
    runs = cached_property(lambda self: self.derived("runs"))
    notifications = cached_property(lambda self: self.derived("notifications"))
