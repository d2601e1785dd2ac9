"""The query surface: filters, joins, rollups, facets, sorts and limits over postings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

VERDICTS = ("ELIGIBLE", "UNCERTAIN", "INELIGIBLE")


def like(c: Column, part: str) -> Column:
    """Case-blind substring match; % and _ of ``part`` stay wildcards."""
    return F.coalesce(c.ilike(f"%{part}%"), F.lit(False))


def experience_bucket(c: Column) -> Column:
    return F.when(c.isNull() | (c <= 1), "ENTRY").when(c <= 4, "MID").otherwise("SENIOR")


def posted_within(c: Column, window: str, as_of: Column) -> Column:
    """TODAY, 3, 7, 14 or 30 days back (the boundary day excluded), or OLDER (unknown dates too)."""
    if window == "OLDER":
        return c.isNull() | (c <= F.date_sub(as_of, 30))
    days = {"TODAY": 1, "3D": 3, "7D": 7, "14D": 14, "30D": 30}[window]
    return F.coalesce(c > F.date_sub(as_of, days), F.lit(False))


def scoped(df: DataFrame, user: str) -> DataFrame:
    """Rows of one tenant."""
    return df.where(F.col("user_id") == user)


def reachable(children: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Children whose parent the caller owns."""
    return children.join(owned.select(key).distinct(), key, "left_semi")


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    return jobs.join(companies.select("company_id", F.col("name").alias("company_name"), "careers_url"), "company_id")


def with_verdict(jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
    return jobs.join(verdicts.withColumnRenamed("job_id", "id"), ["id", "user_id"], "left")


def job_rows(jobs: DataFrame, companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    return with_verdict(with_company(jobs, companies), verdicts)


def job_filter(rows: DataFrame, as_of: Column, user: str | None = None, verdict: str | None = None, location: str | None = None, department: str | None = None, employment_type: str | None = None, experience: str | None = None, posted: str | None = None, search: str | None = None) -> DataFrame:
    """Every filter that is given must hold; without a verdict only ACTIVE postings are listed."""
    tests = [F.col("verdict") == verdict if verdict and verdict != "ALL" else F.col("status") == "ACTIVE"]
    tests += [F.col("user_id") == user] if user else []
    tests += [like(F.col(c), v) for c, v in (("location", location), ("department", department), ("employment_type", employment_type)) if v]
    tests += [experience_bucket(F.col("experience_min")) == experience] if experience else []
    tests += [posted_within(F.col("posted_at"), posted, as_of)] if posted else []
    tests += [like(F.col("title"), search) | like(F.col("description"), search) | like(F.col("company_name"), search)] if search else []
    return rows.where(reduce(lambda a, b: a & b, tests))


def verdict_rank(c: Column) -> Column:
    return F.when(c == "ELIGIBLE", 0).when(c == "UNCERTAIN", 1).otherwise(2)


def list_order(sort: str) -> list[Column]:
    """Sort keys of the job list; the id ends every one, so that pages are stable."""
    return {
        "NEWEST": [F.desc("first_seen_on")],
        "OLDEST": [F.asc_nulls_last("posted_at")],
        "DEADLINE": [F.asc_nulls_last("closing_at")],
        "ELIGIBILITY": [verdict_rank(F.col("verdict")).asc(), F.desc_nulls_last("match_score")],
    }[sort] + [F.asc("id")]


def company_order(sort: str) -> list[Column]:
    """Sort keys of a company's page: unknown posting dates count as the epoch."""
    posted = F.coalesce(F.col("posted_at"), F.to_date(F.lit("1970-01-01")))
    rank = F.when(F.col("verdict") == "ELIGIBLE", 0).when(F.col("verdict") == "UNCERTAIN", 1).when(F.col("verdict") == "INELIGIBLE", 2).otherwise(3)
    return {"NEWEST": [posted.desc()], "OLDEST": [posted.asc()], "DEADLINE": [F.asc_nulls_last("closing_at")], "ELIGIBILITY": [rank.asc(), posted.desc()]}[sort] + [F.asc("id")]


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of at most 200 rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


class SortedPages:
    """Pages of a sorted table, however deep, without a task that sorts more than the page's ranges.

    The rows are dealt to ranges of the order by sampled cuts and written once, with the number of
    the range; one line for each range comes to the driver.  A page is then sorted out of the
    ranges that it lies in, and no other is read.  The order must be whole (end in a unique column).
    """

    def __init__(self, rows: DataFrame, order: Sequence[Column], ranges: int = 200) -> None:
        self.order, self.columns = order, rows.columns
        self.rows = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "pages")
        lines = self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()
        self.ranges = sorted((r["_range"], r["n"]) for r in lines)
        self.total = sum(n for _, n in self.ranges)

    def _of_ranges(self, wanted: list[int]) -> DataFrame:
        return self.rows.where(F.col("_range").isin(wanted)).select(*self.columns)

    def page(self, limit: int, offset: int) -> DataFrame:
        """The rows ``offset`` to ``offset + limit`` of the order."""
        wanted, ahead, at = [], 0, 0
        for number, n in self.ranges:
            if at + n <= offset:
                ahead = at + n
            elif at < offset + limit:
                wanted.append(number)
            at += n
        return page(self._of_ranges(wanted), self.order, limit, offset - ahead)


def page_after(rows: DataFrame, key: Sequence[tuple[str, bool]], last: Mapping[str, object], limit: int = 50) -> DataFrame:
    """The page after the row with the values ``last``: no row of earlier pages is sorted again.

    ``key`` has (column, ascending) in order, the last one unique; nulls come last either way.
    """
    after, same = F.lit(False), F.lit(True)
    for name, ascending in key:
        column, value = F.col(name), F.lit(last[name])
        beyond = F.lit(False) if last[name] is None else column.isNull() | (column > value if ascending else column < value)
        after = after | (same & beyond)
        same = same & column.eqNullSafe(value)
    order = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in key]
    return page(rows.where(F.coalesce(after, F.lit(False))), order, limit)


def with_total(rows: DataFrame) -> DataFrame:
    """One row: how many there are."""
    return rows.agg(F.count("*").alias("total"))


def closing_between(rows: DataFrame, as_of: Column, days: int, most: int = 100) -> DataFrame:
    """ACTIVE postings that close within ``days``, soonest first, with the days left."""
    near = rows.where((F.col("status") == "ACTIVE") & F.col("closing_at").between(as_of, F.date_add(as_of, days)))
    return near.withColumn("days_left", F.datediff("closing_at", as_of)).orderBy("closing_at", "id").limit(most)


#: Columns that a place is looked for in.
PLACES = ("location", "city", "country")


def company_page(rows: DataFrame, as_of: Column, location: str | None = None, employment_type: str | None = None, tab: str | None = None, experience: str | None = None, posted: str | None = None) -> DataFrame:
    """Postings of a company's page: place (a part of location, city or country, those that are
    columns), employment type, verdict tab, experience and posting date."""
    out = rows
    if location:
        places = F.concat_ws(" ", *[F.col(c) for c in PLACES if c in rows.columns])
        out = out.where(F.contains(F.lower(places), F.lit(location.lower())))
    if employment_type:
        out = out.where(F.col("employment_type") == employment_type)
    if tab:
        out = out.where(F.col("verdict") == tab)
    if experience:
        out = out.where(experience_bucket(F.col("experience_min")) == experience)
    return out.where(posted_within(F.col("posted_at"), posted, as_of)) if posted else out


def profile_gaps(profiles: DataFrame) -> DataFrame:
    """Adds ``gaps`` (missing answers) and ``complete`` (degree, branch, year and skills are there)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    no_skills, no_places = F.size("skills") == 0, F.size("preferred_locations") == 0
    gaps = [
        F.when(blank("degree"), "Degree not set"), F.when(blank("branch"), "Branch not set"),
        F.when(F.col("graduation_year").isNull(), "Graduation year not set"), F.when(no_skills, "Skills not set"), F.when(no_places, "Preferred locations not set"),
    ]
    complete = ~blank("degree") & ~blank("branch") & F.col("graduation_year").isNotNull() & ~no_skills
    return profiles.withColumns({"gaps": F.array_compact(F.array(*gaps)), "complete": complete})


def company_rollup(companies: DataFrame, jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts of a company's postings in one pass: ACTIVE ones by verdict, unverified of any status."""
    active = F.col("status") == "ACTIVE"
    counts = with_verdict(jobs, verdicts).groupBy("company_id").agg(
        F.count_if(active).alias("active"),
        *[F.count_if(active & (F.col("verdict") == v)).alias(v.lower()) for v in VERDICTS],
        F.count_if(F.col("verification") == "UNVERIFIED").alias("unverified"),
    )
    names = ["active", *[v.lower() for v in VERDICTS], "unverified"]
    return companies.join(counts, "company_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def dashboard(companies: DataFrame, jobs: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """One row per user with the summary counters, from one aggregate over each table."""
    active = F.col("status") == "ACTIVE"
    by_job = with_verdict(jobs, verdicts).groupBy("user_id").agg(
        F.count_if(active).alias("active_jobs"),
        *[F.count_if(active & (F.col("verdict") == v)).alias(f"{v.lower()}_jobs") for v in VERDICTS],
        F.count_if(active & (F.col("first_seen_on") >= as_of)).alias("new_today"),
        F.count_if(active & F.col("closing_at").between(as_of, F.date_add(as_of, 7))).alias("closing_soon"),
    )
    by_company = companies.groupBy("user_id").agg(F.count("*").alias("companies"), F.max("last_researched_on").alias("last_researched"))
    counters = ["active_jobs", *[f"{v.lower()}_jobs" for v in VERDICTS], "new_today", "closing_soon"]
    return by_company.join(by_job, "user_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})


def facets(jobs: DataFrame, columns: Sequence[str] = ("location", "department", "employment_type"), most: int = 100) -> DataFrame:
    """Distinct non-blank values of ACTIVE postings, the first ``most`` of each column by value."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    values = jobs.where("status = 'ACTIVE'").selectExpr(f"stack({len(columns)}, {pairs}) as (facet, value)").where("trim(value) <> ''").distinct()
    return values.withColumn("_n", F.row_number().over(Window.partitionBy("facet").orderBy("value"))).where(F.col("_n") <= most).drop("_n")


def job_sources(sightings: DataFrame) -> DataFrame:
    """Sources of each posting as one list, official first, then latest."""
    order = F.struct((~F.col("is_official")).alias("third_party"), (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("age"), "source_url")
    return sightings.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["source_url"]).alias("sources"))


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def digest_due(preferences: DataFrame, notifications: DataFrame, as_of: Column) -> DataFrame:
    """Whether a user's digest is due: never sent, or a day (week) ago by frequency."""
    last = notifications.where("kind = 'NEW_ELIGIBLE_JOB'").groupBy("user_id").agg(F.max("created_at").alias("last_sent"))
    days = F.when(F.col("frequency") == "WEEKLY", 7).otherwise(1)
    due = F.col("last_sent").isNull() | (F.unix_seconds(as_of) - F.unix_seconds(F.col("last_sent").cast("timestamp")) >= days * 86400)
    return preferences.join(last, "user_id", "left").withColumn("due", due)


def digest(rows: DataFrame, as_of: Column, days: int, most: int = 25) -> DataFrame:
    """Per user, the first ``most`` ELIGIBLE postings by deadline, as lines of text; past deadlines
    and postings without one pass."""
    best = top_k(rows.where("verdict = 'ELIGIBLE'"), ["user_id"], most, F.asc_nulls_last("closing_at"), F.asc("id"))
    kept = best.where(F.col("closing_at").isNull() | (F.col("closing_at") <= F.date_add(as_of, days)))
    line = F.concat(F.col("title"), F.lit(" - "), F.col("company_name"), F.lit(" - "), F.coalesce(F.col("closing_at").cast("string"), F.lit("no deadline")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return kept.groupBy("user_id").agg(F.count("*").alias("jobs"), F.array_join(lines, "\n").alias("body"))


def due_companies(companies: DataFrame, as_of: Column, backed_off: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Companies whose next research is due, oldest first, without those in back-off."""
    rows = companies if backed_off is None else companies.join(backed_off.select("company_id"), "company_id", "left_anti")
    return rows.where(F.col("next_research_at") <= as_of).orderBy("next_research_at", "company_id").limit(most)


def next_research(companies: DataFrame, hours: dict[str, int]) -> DataFrame:
    """Adds ``next_research_at``: the last time plus the mode's interval; null when manual."""
    step = F.coalesce(*[F.when(F.col("refresh_mode") == m, F.lit(h)) for m, h in hours.items()])
    return companies.withColumn("next_research_at", F.col("last_researched_on").cast("timestamp") + F.make_dt_interval(F.lit(0), step))


NOT_STATED = "Not specified in posting"


def export_rows(rows: DataFrame) -> DataFrame:
    """Columns of the CSV export as text; what is null or blank says so."""
    cell = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(NOT_STATED))
    number = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit(NOT_STATED))
    listed = lambda c, none: F.coalesce(F.nullif(F.array_join(c, "; "), F.lit("")), F.lit(none))
    return rows.select(
        cell("company_name").alias("Company"), cell("title").alias("Role"), cell("verdict").alias("Verdict"), number("match_score").alias("Match score (%)"),
        cell("location").alias("Location"), cell("work_arrangement").alias("Work arrangement"), cell("employment_type").alias("Employment type"),
        cell("posted_at").alias("Posted"), cell("closing_at").alias("Closing date"), number("experience_min").alias("Experience (min yrs)"), number("experience_max").alias("Experience (max yrs)"),
        cell("education_requirement").alias("Education requirement"), listed("required_skills", NOT_STATED).alias("Required skills"), listed("preferred_skills", NOT_STATED).alias("Preferred skills"),
        cell("salary").alias("Salary"), cell("status").alias("Status"), cell("verification").alias("Verification"), F.col("source_url").alias("Source"),
        F.when(F.col("is_official"), "Yes").otherwise("No (third-party listing)").alias("Source is official"), listed("also_seen_at", "Only one source found").alias("Also seen at"),
        cell("first_seen_on").alias("First seen"), cell("last_verified_at").alias("Last verified"), cell("external_job_id").alias("Job ID"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180 CSV: quotes doubled, lines ended by CR LF."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)
