"""Queries of sources: pages, robots files, feeds, careers sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..sources import feeds, pages, sites
from .fixtures import Tables, _case, tasks
from .registry import query
from .texts import _SPLIT, _re2

# --- pages and robots -----------------------------------------------------------------------------

_MARKER = "CASE " + " ".join(f"WHEN contains(head, '{m}') THEN '{m}'" for m in lx.BLOCK_MARKERS) + " END"


@query("a1_page_gate", f"SELECT page_id, reason AS blocked_reason, reason IS NULL AS ok FROM (SELECT page_id, {_MARKER} AS reason FROM (SELECT page_id, lower(left(CASE page_id % 5 WHEN 0 THEN '<title>Just a Moment</title>' WHEN 1 THEN 'Attention Required! Captcha' ELSE '' END || html, 4000)) AS head FROM pages))")
def _(t):
    front = F.when(F.col("page_id") % 5 == 0, "<title>Just a Moment</title>").when(F.col("page_id") % 5 == 1, "Attention Required! Captcha").otherwise("")
    return pages.gate_pages(t.raw("pages").withColumn("html", F.concat(front, "html"))).select("page_id", "blocked_reason", "ok")


_ROBOTS = ("User-agent: *\nDisallow: /de/ # no\nAllow: /de/1\n\nUser-agent: other\nDisallow: /", "User-Agent: RoleBot\nuser-agent: x\nDisallow: /en/*.html$\nDisallow:\nAllow: /en/9\n", "Sitemap: /s.xml\nDisallow: /\nUser-agent: *\nDisallow:", "User-agent: role\nDisallow: /\nUser-agent: rolebot\nDisallow: /fr\nAllow: /fr\n")
_RULES = {0: [(1, "*", False, "/de/"), (1, "*", True, "/de/1"), (2, "other", False, "/")], 1: [(1, "rolebot,x", False, "/en/*.html$"), (1, "rolebot,x", True, "/en/9")], 3: [(1, "role", False, "/"), (2, "rolebot", False, "/fr"), (2, "rolebot", True, "/fr")]}
_RULE_ROWS = "expected AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {g}, '{a}', {str(ok).lower()}, '{p}')" for k, rows in _RULES.items() for g, a, ok, p in rows) + ") v(k, grp, agents, allow, path))"
_URLS = "urls AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS origin, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages), sites AS (SELECT origin, min(page_id) % 4 AS k FROM urls GROUP BY 1)"


def page_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("origin"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"))


def robots(t: Tables) -> DataFrame:
    k = F.col("k")
    body = F.when(k == 0, _ROBOTS[0]).when(k == 1, _ROBOTS[1]).when(k == 2, _ROBOTS[2]).otherwise(_ROBOTS[3])
    return page_urls(t).groupBy("origin").agg((F.min("page_id") % 4).alias("k")).select("origin", body.alias("body"))


@query("a2_robots_rules", 'SELECT origin, grp AS "group", agents, allow, e.path FROM sites JOIN expected e USING (k)', _URLS, _RULE_ROWS)
def _(t):
    return pages.robots_rules(robots(t)).select("origin", F.col("group").cast("int").alias("group"), F.array_join("agents", ",").alias("agents"), "allow", "path")


@query("a3_robots_filter", "SELECT page_id, CASE k WHEN 0 THEN starts_with(path, '/de/1') OR NOT starts_with(path, '/de/') WHEN 1 THEN CASE WHEN regexp_matches(path, '^/en/.*\\.html$') THEN false ELSE true END ELSE true END AS allowed FROM urls JOIN sites USING (origin)", _URLS)
def _(t):
    return pages.filter_allowed(page_urls(t), pages.robots_rules(robots(t)), "RoleBot/1.0").select("page_id", "allowed")


# --- postings wrapped into pages and read back ----------------------------------------------------


def posting_pages(t: Tables) -> DataFrame:
    """A page for each posting: its JSON-LD as one object, in an array, inside @graph, or with a
    trailing comma, by turns."""
    n = F.col("id").cast("long")
    node = F.struct(
        F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), F.struct(F.lit("PropertyValue").alias("@type"), F.col("id").alias("value")).alias("identifier"), F.array("title").alias("title"),
        F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("description"), F.struct(F.struct(F.trim("location").alias("addressLocality"), F.lit("IN").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.struct(F.lit("100").alias("minValue"), F.lit("200").alias("maxValue"), F.lit("INR").alias("currency"), F.lit("Month").alias("unitText")).alias("baseSalary"),
        F.struct((n % 40).alias("monthsOfExperience")).alias("experienceRequirements"), F.struct(F.col("education_requirement").alias("credentialCategory")).alias("educationRequirements"),
        F.col("employment_type").alias("employmentType"), F.col("posted_at").cast("string").alias("datePosted"), F.concat(F.lit("/p/"), "id").alias("url"),
    )
    text = F.to_json(node)
    shaped = F.when(n % 4 == 0, text).when(n % 4 == 1, F.concat(F.lit("["), text, F.lit(",]"))).when(n % 4 == 2, F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, '), text, F.lit("]}"))).otherwise(F.concat(F.lit("[["), text, F.lit("], "), text, F.lit("]")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), shaped, F.lit('</script><script type="application/ld+json">{bad</script><p>Apply</p></html>'))
    return t.dealt_postings.select(n.alias("page_id"), F.col("source_url").alias("url"), html.alias("html"))


@query("a4_json_ld_nodes", "SELECT CAST(id AS BIGINT) AS page_id, CASE WHEN CAST(id AS BIGINT) % 4 = 3 THEN 2 ELSE 1 END AS nodes FROM postings")
def _(t):
    return pages.json_ld_nodes(posting_pages(t)).groupBy("page_id").agg(F.count("*").cast("int").alias("nodes"))


@query("a5_job_posting", "SELECT CAST(id AS BIGINT) AS page_id, id AS external_job_id, title, description, trim(location) || ', IN' AS location, employment_type, CAST(posted_at AS STRING) AS posted_at, '100-200 INR per month' AS salary, regexp_extract(source_url, '^https://[^/]+') || '/p/' || id AS url, education_requirement, CASE WHEN CAST(id AS BIGINT) % 40 > 0 THEN round((CAST(id AS BIGINT) % 40) / 12.0 + 1e-9, 1) END AS experience_min FROM postings")
def _(t):
    raw = pages.job_posting(pages.json_ld_nodes(posting_pages(t)))
    return raw.select("page_id", "external_job_id", "title", "description", "location", "employment_type", "posted_at", "salary", "url", "education_requirement", "experience_min")


def micro_pages(t: Tables) -> DataFrame:
    n = F.col("id").cast("long")
    html = F.concat(
        F.lit('<div itemscope itemtype="https://schema.org/JobPosting"><h1 itemprop="title">'), F.when(n % 6 == 5, "").otherwise(F.replace("title", F.lit("&"), F.lit("&amp;"))), F.lit('</h1><meta itemprop="identifier" content="'), "id",
        F.lit('"><div itemprop="description"><p>'), "description", F.lit('</p></div><a itemprop="url" href="'), "source_url", F.lit('">x</a><span itemprop="jobLocation">'), "location", F.lit('</span><span itemprop="validThrough">2030-01-01</span></div><p itemprop="title">outside</p>'),
    )
    return t.dealt_postings.select(n.alias("page_id"), F.lit("https://h.example.com/").alias("url"), html.alias("html"))


@query("a6_microdata", "SELECT CAST(id AS BIGINT) AS page_id, id AS external_job_id, title, description, trim(location) AS location, CAST(NULL AS STRING) AS posted_at, '2030-01-01' AS closing_at, source_url AS url FROM postings WHERE CAST(id AS BIGINT) % 6 <> 5")
def _(t):
    return pages.microdata(micro_pages(t)).select("page_id", "external_job_id", "title", "description", "location", "posted_at", "closing_at", "url")


def listing_pages(t: Tables) -> DataFrame:
    """One page per company with its postings as list items, and links in its navigation."""
    item = F.concat(F.lit('<li class="job"><a href="/p/'), "id", F.lit('">'), F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("</a> <p>"), F.coalesce("employment_type", F.lit("")), F.lit(" Posted 2024-01-02. Location: "), "location", F.lit(". B.Tech degree in any branch; INR 5 lakh</p></li>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))), lambda x: x["item"]), "")
    # a number of parts is kept, so that pages are read on all cores
    shown = t.dealt_postings.select("company_id", "id", "title", "employment_type", "location").repartition(tasks(t.spark), "company_id")
    rows = shown.groupBy("company_id").agg(items.alias("items"))
    html = F.concat(F.lit('<nav><a href="/careers/jobs">Open engineering roles Pune</a></nav><ul>'), "items", F.lit('</ul><a href="/about">Home</a><footer><a href="/x">Process Engineer Pune</a></footer>'))
    return rows.select(F.col("company_id").cast("long").alias("page_id"), F.concat(F.lit("https://c"), "company_id", F.lit(".example.com/careers/")).alias("url"), html.alias("html"))


@query("a7_listings", "SELECT CAST(company_id AS BIGINT) AS page_id, 'https://c' || company_id || '.example.com/p/' || id AS url, title FROM postings")
def _(t):
    return pages.listings(pages.anchors(listing_pages(t))).select("page_id", "url", "title")


@query("a8_listing_fields", f"SELECT id, nullif(regexp_extract(x, {_re2(lx.EMPLOYMENT_TYPE)}), '') AS employment_type, nullif(regexp_extract(x, {_re2(lx.SALARY)}), '') AS salary, list_filter({_SPLIT.format(c='x')}, lambda s: regexp_matches(s, {_re2(lx.DEGREE_LINE)}) AND length(s) < 300)[1] AS education_requirement, trim(regexp_extract(x, {_re2(lx.LISTING_LOCATION[0])}, 1)) AS location FROM (SELECT id, coalesce(employment_type, '') || '. Location: ' || trim(location) || ' | ' || description || ' INR 5-6 lakh.' AS x FROM postings)")
def _(t):
    x = F.concat(F.coalesce("employment_type", F.lit("")), F.lit(". Location: "), F.trim("location"), F.lit(" | "), "description", F.lit(" INR 5-6 lakh."))
    kept = t.postings.select("id", x.alias("x"))
    f = pages.listing_fields(F.col("x"))
    return kept.select("id", *[f[c].alias(c) for c in ("employment_type", "salary", "education_requirement", "location")])


def all_raw(t: Tables, source: DataFrame) -> DataFrame:
    return pages.extractor_chain(pages.job_posting(pages.json_ld_nodes(source)), pages.microdata(source), pages.listings(pages.anchors(source)))


@query("a9_extractor_chain", "SELECT method, authoritative, count(*) AS n FROM (SELECT 'JSON_LD' AS method, true AS authoritative FROM postings WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT 'MICRODATA', true FROM postings WHERE CAST(id AS BIGINT) % 2 = 1 AND CAST(id AS BIGINT) % 6 <> 5 UNION ALL SELECT 'HEURISTIC', false FROM postings) GROUP BY ALL")
def _(t):
    n = F.col("page_id")
    source = posting_pages(t).where(n % 2 == 0).unionByName(micro_pages(t).where(n % 2 == 1)).unionByName(listing_pages(t).withColumn("page_id", -n - 1))
    return all_raw(t, source).groupBy("method", "authoritative").agg(F.count("*").alias("n"))


_SITES = ("https://boards.greenhouse.io/acme", "https://jobs.lever.co/acme", "https://acme.wd1.myworkdayjobs.com/en/acme/jobs", "https://careers.smartrecruiters.com/acme", "https://jobs.ashbyhq.com/acme", "https://apply.workable.com/acme/", "https://acme.jobs.personio.de/", "https://acme.bamboohr.com/jobs/list/", "https://acme.example.com/careers", "no url")
_SITE_SQL = "sited AS (SELECT company_id, " + _case("CAST(company_id AS BIGINT)", _SITES) + " AS careers_url FROM companies)"
_SITE_RE = [(p, n) for n, p in lx.PROVIDERS]


def sited(t: Tables) -> DataFrame:
    return t.companies.select("company_id", F.element_at(F.array(*[F.lit(s) for s in _SITES]), (F.col("company_id").cast("long") % len(_SITES) + 1).cast("int")).alias("careers_url"))


_HOST = "lower(regexp_extract(careers_url, '^[a-z]+://([^/?#]+)', 1))"


@query("a10_provider_routing", f"SELECT company_id, CASE {' '.join(f'WHEN regexp_matches({_HOST}, {_re2(p)}) THEN {chr(39)}{n}{chr(39)}' for p, n in _SITE_RE)} END AS provider FROM sited", _SITE_SQL)
def _(t):
    return sited(t).select("company_id", sites.provider(F.col("careers_url")).alias("provider"))


@query("e9_ats_provider", "SELECT company_id, CASE " + " ".join(f"WHEN regexp_matches({_HOST}, {_re2(p)}) THEN '{n}'" for p, n, _ in lx.ATS_HOSTS) + " END AS provider, CASE " + " ".join(f"WHEN regexp_matches({_HOST}, {_re2(p)}) THEN " + (f"nullif(regexp_extract(regexp_extract(careers_url, '^[a-z]+://[^/]+([^?#]*)', 1), {_re2(b)}), '')" if b else "NULL") for p, _, b in lx.ATS_HOSTS) + " END AS board_path FROM sited", _SITE_SQL)
def _(t):
    return sited(t).select("company_id", sites.ats_provider(F.col("careers_url")).alias("a")).select("company_id", "a.provider", "a.board_path")


# --- feeds: postings wrapped into bodies and read back ----------------------------------------------


def _bodies(t: Tables, item, wrap: str | None) -> DataFrame:
    rows = t.postings.select("company_id", F.struct(item).alias("item") if not isinstance(item, list) else F.struct(*item).alias("item"))
    listed = rows.groupBy("company_id").agg(F.collect_list("item").alias("items"))
    body = F.to_json(F.struct(F.col("items").alias(wrap))) if wrap else F.to_json("items")
    bad = F.when(F.col("company_id").cast("long") % 10 == 9, "<html>not json</html>").otherwise(body)
    return listed.select("company_id", F.concat(F.lit("https://jobs.smartrecruiters.com/acme"), "company_id").alias("careers_url"), bad.alias("body"))


def _s(c: str, name: str):
    return F.col(c).cast("string").alias(name)


_READ = "CAST(company_id AS BIGINT) % 10 <> 9"


@query("a11_greenhouse", f"SELECT id AS external_job_id, title, description, trim(location) AS location, nullif(trim(department), '') AS department, source_url AS url, CAST(posted_at AS STRING) AS posted_at FROM postings WHERE {_READ}")
def _(t):
    item = [_s("id", "id"), _s("title", "title"), F.concat(F.lit("<p>"), "description", F.lit("</p><br/>")).alias("content"), F.struct(_s("location", "name")).alias("location"), _s("posted_at", "updated_at"), _s("source_url", "absolute_url"), F.array(F.struct(_s("department", "name"))).alias("departments")]
    r = feeds.greenhouse(_bodies(t, item, "jobs"))
    return r.select("external_job_id", "title", "description", "location", F.nullif(F.trim("department"), F.lit("")).alias("department"), "url", "posted_at")


@query("a12_lever", f"SELECT id AS external_job_id, title, description || ' Extra. Item' AS description, trim(location) || ', Team' AS location, employment_type, strftime(CAST(first_seen_on AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') AS posted_at, source_url AS url FROM postings WHERE {_READ}")
def _(t):
    item = [_s("id", "id"), _s("title", "text"), _s("description", "description"), F.lit("<b>Extra.</b>").alias("additional"), F.array(F.struct(F.lit("t").alias("text"), F.lit("<li>Item</li>").alias("content"))).alias("lists"), F.struct(F.trim("location").alias("location"), F.lit("Team").alias("team"), _s("employment_type", "commitment")).alias("categories"), (F.unix_date("first_seen_on").cast("long") * 86400000).alias("createdAt"), _s("source_url", "applyUrl")]
    return feeds.lever(_bodies(t, item, None)).select("external_job_id", "title", "description", "location", "employment_type", "posted_at", "url")


@query("a13_workday", f"SELECT id AS external_job_id, title, CAST(NULL AS STRING) AS description, trim(location) || ', India' AS location, 'https://jobs.smartrecruiters.com/job/' || id AS url FROM postings WHERE {_READ}")
def _(t):
    item = [_s("id", "jobReqId"), _s("title", "title"), F.trim("location").alias("locationsText"), F.lit("India").alias("countryName"), F.concat(F.lit("job/"), "id").alias("externalPath")]
    return feeds.workday(_bodies(t, item, "jobPostings")).select("external_job_id", "title", "description", "location", "url")


@query("a14_smartrecruiters", f"SELECT id AS external_job_id, title, trim(location) || ', IN' AS location, CAST(posted_at AS STRING) AS posted_at, 'https://jobs.smartrecruiters.com/acme' || company_id || '/' || id AS url FROM postings WHERE {_READ}")
def _(t):
    item = [_s("id", "id"), _s("title", "name"), F.struct(F.trim("location").alias("city"), F.lit("IN").alias("country")).alias("location"), _s("posted_at", "releasedDate")]
    return feeds.smartrecruiters(_bodies(t, item, "content")).select("external_job_id", "title", "location", "posted_at", "url")


@query("a15_ashby", f"SELECT id AS external_job_id, title, description, coalesce(CAST(posted_at AS STRING), 'later') AS posted_at, 'https://jobs.smartrecruiters.com/acme' || company_id || '#' || id AS url FROM postings WHERE {_READ}")
def _(t):
    n = F.col("id").cast("long")
    item = [_s("id", "id"), _s("title", "title"), F.when(n % 2 == 0, F.concat(F.lit("<div>"), "description", F.lit("</div>"))).otherwise("").alias("descriptionHtml"), _s("description", "descriptionPlain"), _s("posted_at", "publishedDate"), F.lit("later").alias("updatedAt")]
    return feeds.ashby(_bodies(t, item, "jobs")).select("external_job_id", "title", "description", "posted_at", "url")


@query("a16_workable", f"SELECT id AS external_job_id, title, description || ' Must know.' AS description, trim(location) || ', MH, IN' AS location, CAST(closing_at AS STRING) AS closing_at, source_url AS url FROM postings WHERE {_READ}")
def _(t):
    n = F.col("id").cast("long")
    item = [F.when(n % 2 == 0, F.col("id")).alias("id"), _s("id", "shortcode"), _s("title", "title"), _s("description", "description"), F.lit("<p>Must know.</p>").alias("requirements"), F.trim("location").alias("city"), F.lit("MH").alias("state"), F.lit("IN").alias("country"), _s("closing_at", "deadline"), _s("source_url", "application_url")]
    return feeds.workable(_bodies(t, item, "jobs")).select("external_job_id", "title", "description", "location", "closing_at", "url")


@query("a17_personio", "SELECT id AS external_job_id, title, description || ' Must know.' AS description, trim(location) AS location, employment_type, source_url AS url FROM postings WHERE CAST(id AS BIGINT) % 7 <> 0")
def _(t):
    esc = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    kind = F.coalesce(F.concat(F.lit('<type name="'), "employment_type", F.lit('"/>')), F.lit(""))
    name = F.when(F.col("id").cast("long") % 7 == 0, "").otherwise(esc("title"))
    one = F.concat(F.lit('<job id="'), "id", F.lit('"><title>'), name, F.lit("</title><description>"), esc("description"), F.lit("</description><requirements>Must know.</requirements><office>"), F.trim("location"), F.lit("</office>"), kind, F.lit("<apply_url>"), "source_url", F.lit("</apply_url></job>"))
    rows = t.postings.select("company_id", one.alias("job")).groupBy("company_id").agg(F.array_join(F.collect_list("job"), "").alias("jobs"))
    bodies = rows.select("company_id", F.lit("https://x.jobs.personio.de").alias("careers_url"), F.concat(F.lit("<workzag-jobs>"), "jobs", F.lit("</workzag-jobs>")).alias("body"))
    return feeds.personio(bodies).select("external_job_id", "title", "description", "location", "employment_type", "url")


@query("a18_bamboohr", f"SELECT id AS external_job_id, title, trim(location) AS location, employment_type, nullif(trim(department), '') AS department, source_url AS url FROM postings WHERE {_READ}")
def _(t):
    item = [_s("id", "id"), _s("title", "title"), _s("location", "location"), _s("employment_type", "employmentStatus"), _s("department", "department"), _s("source_url", "url")]
    return feeds.bamboohr(_bodies(t, item, "jobs")).select("external_job_id", "title", "location", "employment_type", F.nullif(F.trim("department"), F.lit("")).alias("department"), "url")


@query("a18_unread_bodies", "SELECT DISTINCT company_id FROM postings WHERE CAST(company_id AS BIGINT) % 10 = 9")
def _(t):
    bodies = _bodies(t, [_s("id", "id"), _s("title", "title")], "jobs")
    return feeds.unread(bodies, feeds.bamboohr(bodies)).select("company_id")


# --- enrichment, links, boards --------------------------------------------------------------------


@query("a19_detail_enrichment", "SELECT id, CASE WHEN k <= 3 AND length(coalesce(short, '')) < 250 THEN description ELSE short END AS description, title FROM (SELECT id, title, description, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN NULL ELSE left(description, 20) END AS short, row_number() OVER (PARTITION BY company_id ORDER BY source_url) AS k FROM postings)")
def _(t):
    short = F.when(F.col("id").cast("long") % 2 != 0, F.left("description", F.lit(20)))
    rows = t.postings.select("id", "company_id", F.col("source_url").alias("url"), "title", short.alias("description"), F.lit(None).cast("string").alias("location"), "education_requirement")
    source = posting_pages(t)
    found = pages.job_posting(pages.json_ld_nodes(source)).join(source.select("page_id", F.col("url").alias("page")), "page_id").withColumn("url", F.col("page")).drop("page")
    return pages.enrich(rows, source, found, per_company=3).select("id", "description", "title")


def linked_listings(t: Tables) -> DataFrame:
    """The listing pages with links that speak of jobs."""
    return listing_pages(t).withColumn("html", F.replace("html", F.lit('href="/p/'), F.lit('href="/job/')))


@query("a20_job_links", """SELECT CAST(company_id AS BIGINT) AS page_id, 'https://c' || company_id || '.example.com/careers/jobs' AS link, 1 AS nth FROM (SELECT DISTINCT company_id FROM postings)
 UNION ALL SELECT CAST(company_id AS BIGINT), 'https://c' || company_id || '.example.com/job/' || id, k + 1 FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY id) AS k FROM postings) WHERE k <= 5""")
def _(t):
    return pages.job_links(linked_listings(t))


@query("a20_follow_links", "SELECT company_id, id FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY id) AS k FROM postings) WHERE k <= 5")
def _(t):
    # the career link of the navigation is one of the six that a page may spend
    listing = linked_listings(t)
    detail = posting_pages(t).join(t.postings.select(F.col("id").cast("long").alias("page_id"), "company_id"), "page_id")
    detail = detail.select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("https://c"), "company_id", F.lit(".example.com/job/"), F.col("page_id").cast("string")).alias("url"), "html")
    raw = pages.job_posting(pages.json_ld_nodes(detail))
    got = pages.follow_links(listing.select("page_id", "url", "html").unionByName(detail), raw)
    return got.select(F.col("from_page").cast("string").alias("company_id"), (-F.col("target") - 1).cast("string").alias("id"))


@query("a21_board_postings", "SELECT company_id, id, false AS is_official FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY 'https://jobs.lever.co/' || id) AS k FROM postings WHERE CAST(id AS BIGINT) % 3 <> 0) WHERE k <= 4")
def _(t):
    n = F.col("id").cast("long")
    hits = t.postings.select("company_id", n.alias("page_id"), F.when(n % 3 == 0, F.concat(F.lit("https://news.example.com/a/"), "id")).otherwise(F.concat(F.lit("https://jobs.lever.co/"), "id")).alias("url"))
    got = pages.board_postings(hits, pages.job_posting(pages.json_ld_nodes(posting_pages(t))), most=4)
    return got.select("company_id", F.col("page_id").cast("string").alias("id"), "is_official")


@query("a22_json_columns", "SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN title || ',x' ELSE '' END AS items, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN location END AS place FROM postings")
def _(t):
    n = F.col("id").cast("long") % 3
    stored = F.when(n == 0, F.to_json(F.array("title", F.lit("x")))).when(n == 1, F.to_json(F.struct("location"))).otherwise("{bad")
    s = t.postings.select("id", stored.alias("s"))
    items = F.coalesce(F.from_json("s", "array<string>"), F.array().cast("array<string>"))
    return s.select("id", F.when(F.startswith("s", F.lit("[")), F.array_join(items, ",")).otherwise("").alias("items"), F.get_json_object("s", "$.location").alias("place"))


# --- careers sites --------------------------------------------------------------------------------

_RESULTS = ("https://careers.{w}.com/jobs", "https://www.{w}.co.in/about", "https://www.linkedin.com/company/{w}", "https://{w}.com/blog/careers", "https://boards.greenhouse.io/{w}")
_RESULT_TITLES = ("Careers at us", "About", "Profile", "Our blog: careers", "Open positions")
_URL_SQL = "CASE k " + " ".join(f"WHEN {i} THEN replace('{u}', '{{w}}', w)" for i, u in enumerate(_RESULTS)) + " END"
_HITS = f"hits AS (SELECT company_id, name, w, k AS position, {_URL_SQL} AS url, CASE k {' '.join(f'WHEN {i} THEN {chr(39)}{s}{chr(39)}' for i, s in enumerate(_RESULT_TITLES))} END AS title FROM (SELECT company_id, name, CASE WHEN CAST(company_id AS INT) % 3 = 0 THEN 'delta' ELSE 'tata' END AS w FROM companies), (SELECT unnest([0, 1, 2, 3, 4]) AS k))"


def results(t: Tables) -> DataFrame:
    w = F.when(F.col("company_id").cast("int") % 3 == 0, "delta").otherwise("tata")
    rows = t.dealt_companies.select("company_id", "name", F.posexplode(F.array(*[F.struct(F.replace(F.lit(u), F.lit("{w}"), w).alias("url"), F.lit(s).alias("title")) for u, s in zip(_RESULTS, _RESULT_TITLES, strict=True)])).alias("position", "r"))
    return rows.select("company_id", "name", "position", "r.url", "r.title")


_H = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
_ATS = " OR ".join(f"regexp_matches({_H}, {_re2(p)})" for p, _, _ in lx.ATS_HOSTS)
_SCORE = f"greatest(0, least(1, round(0.3 + CASE WHEN regexp_matches({_H}, {_re2(lx.CAREERS_HOST)}) THEN 0.25 ELSE 0 END + CASE WHEN {_ATS} THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(title, {_re2(lx.CAREERS_TEXT)}) THEN 0.15 ELSE 0 END + CASE WHEN {_H} = official THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(url, {_re2(lx.CAREERS_URL)}) THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(url, {_re2(lx.NOISE_URL)}) THEN 0.3 ELSE 0 END, 3)))"


@query("e5_careers_score", f"SELECT company_id, position, CAST({_SCORE} AS DOUBLE) AS confidence FROM (SELECT *, w || '.com' AS official FROM hits)", _HITS)
def _(t):
    w = F.when(F.col("company_id").cast("int") % 3 == 0, "delta.com").otherwise("tata.com")
    return results(t).select("company_id", "position", sites.careers_score(F.col("url"), F.col("title"), w).alias("confidence"))


_WORDS = "list_filter(string_split(regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(trim(name)), '[''`]', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '^(.+?)( (" + "|".join(x for x in lx.LEGAL_SUFFIXES if x.isalnum()) + "))+$', '\\1'), ' '), lambda x: length(x) > 2)"
_OFFICIAL = f"scored AS (SELECT company_id, position, host, 2 * len(list_filter({_WORDS}, lambda x: contains(host, x))) + CASE WHEN regexp_matches(host, '\\.(com|co\\.in|com\\.in|in|net|org)$') THEN 1 ELSE 0 END + CASE WHEN len(string_split(host, '.')) <= 3 THEN 1 ELSE 0 END AS score, len(list_filter({_WORDS}, lambda x: contains(host, x))) AS n FROM (SELECT *, regexp_replace({_H}, '^www\\.', '') AS host FROM hits)), best AS (SELECT company_id, host, score FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, position) AS r FROM scored WHERE n > 0 AND string_split(host, '.')[1] NOT IN ({', '.join(repr(x) for x in lx.NOT_OFFICIAL_HOSTS)})) WHERE r = 1)"


@query("e6_official_domain", "SELECT company_id, host, CAST(score AS INT) AS score FROM best", _HITS, _OFFICIAL)
def _(t):
    return sites.official_domain(results(t))


@query("e4_top_candidates", f"SELECT company_id, url AS careers_url, confidence, rank FROM (SELECT company_id, url, confidence, row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC, url) AS rank FROM (SELECT company_id, url, max(CAST({_SCORE} AS DOUBLE)) AS confidence FROM (SELECT *, NULL::STRING AS official FROM hits) GROUP BY ALL)) WHERE rank <= 3", _HITS)
def _(t):
    c = results(t).select("company_id", F.col("url").alias("careers_url"), sites.careers_score(F.col("url"), F.col("title"), F.lit(None).cast("string")).alias("confidence"))
    twice = c.withColumn("_nth", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_nth")  # each candidate comes twice; scored once
    return sites.top_candidates(twice, 3)


@query("a25_search_candidates", f"SELECT company_id, host, url, confidence, rank FROM (SELECT company_id, {_H} AS host, url, CAST({_SCORE} AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY company_id ORDER BY {_SCORE} DESC, {_H}) AS rank FROM (SELECT h.*, b.host AS official FROM hits h LEFT JOIN best b USING (company_id)))", _HITS, _OFFICIAL)
def _(t):
    return sites.search_candidates(results(t)).select("company_id", "host", "url", "confidence", "rank")


@query("e7_homepage_links", "SELECT CAST(company_id AS BIGINT) AS page_id, u AS careers_url, c AS confidence, CAST(r AS INT) AS rank FROM companies, (SELECT unnest(['https://h.example.com/jobs', 'https://careers.other.com/']) AS u, unnest([0.75, 0.7]::DOUBLE[]) AS c, unnest([1, 2]) AS r) WHERE CAST(company_id AS BIGINT) % 2 = 0 OR r < 2")
def _(t):
    extra = F.when(F.col("company_id").cast("long") % 2 == 0, '<li><a href="https://careers.other.com/">Elsewhere</a></li>').otherwise("")
    html = F.concat(F.lit('<p><a href="/jobs">Careers</a> <a href="/privacy">Privacy careers</a> <a href="/team">Team</a> <a href="https://boards.greenhouse.io/acme">Open positions</a> <a href="https://x.org">Vacancies</a></p>'), extra)
    home = t.dealt_companies.select(F.col("company_id").cast("long").alias("page_id"), F.lit("https://h.example.com/").alias("url"), html.alias("html"))
    return sites.homepage_links(pages.anchors(home)).select("page_id", "careers_url", "confidence", "rank")


@query("e8_careers_landing", f"SELECT url, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY {_H} ORDER BY confidence DESC, url) AS r FROM (SELECT DISTINCT url, CASE WHEN page_id % 3 = 1 THEN 'NO_OPENINGS' ELSE 'JOBS' END AS kind, CAST(0.8 AS DOUBLE) AS confidence FROM pages WHERE page_id % 3 <> 0)) WHERE r <= 8")
def _(t):
    n = F.col("page_id") % 3
    shown = t.raw("pages").select("url", F.when(n == 1, "Sorry, no open job. Apply later").when(n == 2, "Our openings. Apply now").otherwise("Hello").alias("html"))
    return sites.careers_landing(shown).select("url", "kind", "confidence")


@query("f15_statement_classes", f"SELECT id, array_to_string(list_filter(s, lambda x: x <> e AND regexp_matches(x, {_re2(lx.DUTY_LINE)})), '|') AS responsibilities, array_to_string(list_filter(s, lambda x: x = e OR (NOT regexp_matches(x, {_re2(lx.DUTY_LINE)}) AND regexp_matches(x, {_re2(lx.REQUIREMENT_LINE)}))), '|') AS requirements FROM (SELECT id, s, coalesce(list_filter(s, lambda x: regexp_matches(x, {_re2(lx.DEGREE_LINE)}) AND length(x) < 300)[1], '') AS e FROM (SELECT id, {_SPLIT.format(c='description').replace('length(s) > 2', 'length(s) > 12')} AS s FROM postings))")
def _(t):
    p = pages.partition_text(F.col("description"))
    return t.dealt_postings.select("id", p.alias("p")).select("id", *[F.array_join(f"p.{c}", "|").alias(c) for c in ("responsibilities", "requirements")])


_CLAUSES = ("<b>Responsibilities</b> include shutdown planning;", "Your role: run the pilot plant!", "Nice to have: SAP and Excel", "Knowledge of HAZOP is good to have", "Proficiency in MATLAB;", "A bachelor degree and strong skills", "Experience on site is a plus", "You should travel. Perks", "<ul><li>Minimum of two references</li><li>Short</li></ul>", "Main tasks are reporting and audits", "Exposure to GMP <br/>Familiarity with DCS tools")
_CLAUSED = "claused AS (SELECT id, description || ' ' || " + " || ' ' || ".join(_case(k, _CLAUSES) for k in ("CAST(id AS BIGINT)", "CAST(FLOOR(CAST(id AS BIGINT) / 11) AS BIGINT)")) + " AS d FROM postings)"
_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(d, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_HITS = lambda p: f"regexp_matches(x, {_re2(p)})"
_LIST = f"CASE WHEN {_HITS(lx.STATEMENT_PREFERRED)} AND ({_HITS(lx.STATEMENT_SKILL)} OR contains(x, ':')) THEN 'preferred' WHEN {_HITS(lx.STATEMENT_SKILL)} AND NOT {_HITS(lx.STATEMENT_DEGREE)} THEN 'skills' WHEN {_HITS(lx.STATEMENT_DUTY)} THEN 'responsibilities' WHEN {_HITS(lx.STATEMENT_REQUIREMENT)} OR {_HITS(lx.STATEMENT_DEGREE)} OR {_HITS(lx.STATEMENT_NEED)} THEN 'requirements' END"


@query("f15_four_lists", "SELECT id, " + ", ".join(f"coalesce(string_agg(x, '|' ORDER BY nth) FILTER (kind = '{name}'), '') AS {name}" for name in pages.STATEMENT_LISTS)
    + f" FROM (SELECT id, x, {_LIST} AS kind, nth FROM (SELECT id, unnest(s) AS x, generate_subscripts(s, 1) AS nth FROM (SELECT id, {_SPLIT.format(c='stripped').replace('length(s) > 2', 'length(s) >= 12')} AS s FROM (SELECT id, {_STRIPPED} AS stripped FROM claused)))) GROUP BY id", _CLAUSED)
def _(t):
    n = F.col("id").cast("long")
    clause = lambda k: F.get(F.array(*[F.lit(c) for c in _CLAUSES]), (k % len(_CLAUSES)).cast("int"))
    text = F.concat_ws(" ", "description", clause(n), clause(F.floor(n / 11)))
    lists = t.dealt_postings.select("id", pages.four_lists(text).alias("p"))
    return lists.select("id", *[F.array_join(f"p.{c}", "|").alias(c) for c in pages.STATEMENT_LISTS])
