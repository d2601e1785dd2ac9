"""Queries of column jobs: keys, tokens, dates, degrees, lexicons, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..operators import lifecycle as lc
from .fixtures import AS_OF, Tables, repr_sql
from .listing import today
from .registry import query


def _re2(pattern: str) -> str:
    """A pattern as a DuckDB literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


_LOC = f"coalesce(trim(regexp_replace(regexp_replace({_plain('location')}, '\\b({'|'.join(lx.LOCATION_WORDS)})\\b', '', 'g'), ' +', ' ', 'g')), '')"
_SUFFIX = "|".join(w for w in lx.LEGAL_SUFFIXES if w.isalnum())
_KEY = f"regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(trim(name)), '[''`]', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '^(.+?)( ({_SUFFIX}))+$', '\\1')"
_STOP = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)


def _tokens(c: str) -> str:
    return f"list_filter(string_split({_plain(c)}, ' '), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


@query("f1_company_key", f"SELECT company_id, {_KEY} AS normalized_name, count(*) OVER (PARTITION BY user_id, {_KEY}) AS same_key FROM companies")
def _(t):
    keyed = t.companies.withColumn("normalized_name", tx.company_key(F.col("name")))
    groups = keyed.groupBy("user_id", "normalized_name").agg(F.count("*").alias("same_key"))
    return keyed.join(groups, ["user_id", "normalized_name"]).select("company_id", "normalized_name", "same_key")


@query("f2_slug", "SELECT id, left(regexp_replace(regexp_replace(lower(title || ' ' || description), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS title_slug FROM postings")
def _(t):
    return t.postings.select("id", tx.slug(F.concat("title", F.lit(" "), "description")).alias("title_slug"))


@query("f3_comparable", f"SELECT doc_id, md5({_plain('text')}) AS key FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(tx.comparable(F.col("text"))).alias("key"))


@query("f4_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('title')}) AS token FROM postings) GROUP BY 1")
def _(t):
    return t.postings.select(F.explode(tx.tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("f5_title_similarity", f"""SELECT a.company_id, a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS similarity
 FROM sets a JOIN sets b ON a.company_id = b.company_id AND a.id < b.id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5""",
    f"sets AS (SELECT company_id, t, min(id) AS id FROM (SELECT id, company_id, list_sort(list_distinct({_tokens('title')})) AS t FROM postings) WHERE len(t) > 0 GROUP BY company_id, t)")
def _(t):
    return lc.title_pairs(t.postings)


@query("f5_title_sets", "SELECT p.id, p.company_id, CASE WHEN len(p.t) > 0 THEN s.title_set END AS title_set FROM titles p LEFT JOIN (SELECT company_id, t, min(id) AS title_set FROM titles GROUP BY ALL) s ON s.company_id = p.company_id AND s.t = p.t",
    f"titles AS (SELECT id, company_id, list_sort(list_distinct({_tokens('title')})) AS t FROM postings)")
def _(t):
    return lc.title_sets(t.postings)


@query("f6_location_key", f"SELECT {_LOC} AS location_key, count(*) AS n FROM postings GROUP BY 1")
def _(t):
    return t.postings.groupBy(tx.location_key(F.col("location")).alias("location_key")).agg(F.count("*").alias("n"))


@query("f7_evidence", "SELECT id, trim(regexp_replace(substr(description, greatest(1, instr(description, 'required') - 20), instr(description, 'required') + 28 - greatest(1, instr(description, 'required') - 20)), '\\s+', ' ', 'g')) AS evidence FROM postings WHERE contains(description, 'required')")
def _(t):
    return t.postings.select("id", tx.evidence(F.col("description"), "required", 20).alias("evidence")).where("evidence is not null")


_SPLIT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([.;!?])\\s+', '\\1' || chr(1), 'g'), '\\n+|•+|·+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) > 2)"


@query("f8_statements", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SPLIT.format(c='text')} AS s FROM documents)")
def _(t):
    s = t.raw("documents").select("doc_id", F.posexplode(tx.statements(F.col("text"))).alias("position", "statement"))
    back = F.transform(F.array_sort(F.collect_list(F.struct("position", "statement"))), lambda x: x["statement"])
    grouped = s.groupBy("doc_id").agg(F.count("*").cast("long").alias("n"), F.md5(F.array_join(back, "|")).alias("digest"))
    empty = F.md5(F.lit(""))
    return t.raw("documents").select("doc_id").join(grouped, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", empty).alias("digest"))


_PAGE = "html"
for _p, _r in ((r"(?is)<script.*?</script>", "' '"), (r"(?is)<style.*?</style>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|li|tr|h[1-6])>", "chr(10)"), ("<[^>]+>", "' '")):
    _PAGE = f"regexp_replace({_PAGE}, '{_p}', {_r}, 'g')"


@query("f9_page_text", f"SELECT page_id, md5({_PAGE}) AS digest, length({_PAGE}) AS n FROM pages")
def _(t):
    text = tx.page_text(F.col("html"))
    return t.raw("pages").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


def _sql_date() -> str:
    s, months = "posted_text", "MAP {" + ", ".join(f"'{k}': {v}" for k, v in lx.MONTHS.items()) + "}"
    made = lambda y, m, d: f"try_cast({y} || '-' || lpad(CAST({m} AS STRING), 2, '0') || '-' || lpad(CAST({d} AS STRING), 2, '0') AS DATE)"
    g = lambda p, n: f"nullif(regexp_extract({s}, '{p}', {n}), '')"
    month = lambda p, n: f"{months}[lower(regexp_extract({s}, '{p}', {n}))]"
    ago, num = r"(?i)^(\d+)\s*(minute|hour|day|week|month)s?\s+ago$", r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$"
    a, b = f"CAST({g(num, 1)} AS INT)", f"CAST({g(num, 2)} AS INT)"
    d1, d2, d3 = r"(?i)^(\d{1,2})\s+([a-z]+),?\s+(\d{4})", r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})", r"(?i)^([a-z]+)\s+(\d{4})$"
    return f"""coalesce(DATE '{AS_OF}' - CAST({g(ago, 1)} AS INT) * CASE lower({g(ago, 2)}) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 0 END,
      CASE WHEN regexp_matches({s}, '(?i)^(just now|today|posted today)$') THEN DATE '{AS_OF}' END, try_cast({g(r'^(\d{4}-\d{2}-\d{2})', 1)} AS DATE),
      CASE WHEN {b} > 12 AND {a} <= 12 THEN {made(g(num, 3), a, b)} ELSE {made(g(num, 3), b, a)} END,
      {made(g(d1, 3), month(d1, 2), g(d1, 1))}, {made(g(d2, 3), month(d2, 1), g(d2, 2))}, {made(g(d3, 2), month(d3, 1), "'1'")},
      CAST(make_timestamp(CAST({g(r'^(\d{10})(?:\d{3})?$', 1)} AS BIGINT) * 1000000) AS DATE))"""


@query("f10_job_date", f"SELECT id, posted_text, {_sql_date()} AS posted_on FROM postings")
def _(t):
    return t.postings.select("id", "posted_text", tx.job_date(F.col("posted_text"), today()).alias("posted_on"))


@query("f10_unparsed_dates", f"SELECT posted_text, count(*) AS n FROM (SELECT posted_text, {_sql_date()} AS d FROM postings) WHERE posted_text IS NOT NULL AND d IS NULL GROUP BY 1")
def _(t):
    unread = t.postings.where(F.col("posted_text").isNotNull() & tx.let(F.col("posted_text"), lambda c: tx.job_date(c, today())).isNull())
    return unread.groupBy("posted_text").agg(F.count("*").alias("n"))


@query("f11_day_gap", f"SELECT id, datediff('day', posted_at, closing_at) AS gap, abs(datediff('day', DATE '{AS_OF}', posted_at)) AS age FROM postings")
def _(t):
    return t.postings.select("id", F.datediff("closing_at", "posted_at").alias("gap"), F.abs(F.datediff("posted_at", today())).alias("age"))


def _sql_level(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {_re2(p)}) THEN '{level}'" for level, p in lx.DEGREE_PATTERNS) + " ELSE 'UNKNOWN' END"


_RANK = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.DEGREE_RANK.items()) + " ELSE 0 END"


@query("f12_degree_level", f"SELECT id, level, {_RANK} AS rank FROM (SELECT id, {_sql_level('coalesce(education_requirement, description)')} AS level FROM postings)")
def _(t):
    return t.postings.select("id", tx.degree_level(F.coalesce("education_requirement", "description")).alias("level")).withColumn("rank", tx.degree_rank(F.col("level")))


_FIELD_LABEL = "CASE f " + " ".join(f"WHEN '{f[0]}' THEN {repr_sql(f[1])}" for f in lx.FIELDS) + f" ELSE '{lx.UNKNOWN_FIELD_LABEL}' END"
_DEGREE_LABEL = "CASE degree_level " + " ".join(f"WHEN '{k}' THEN {repr_sql(v)}" for k, v in lx.DEGREE_LABELS.items()) + " ELSE 'Unspecified degree level' END"


@query("f13_labels", f"SELECT job_id, {_FIELD_LABEL} AS field_label, {_DEGREE_LABEL} AS degree_label FROM (SELECT *, string_split(field_list, ';')[1] AS f FROM requirements)")
def _(t):
    return t.requirements.select("job_id", tx.field_label(F.split("field_list", ";")[0]).alias("field_label"), tx.degree_label(F.col("degree_level")).alias("degree_label"))


def _sql_hit(text: str, alias: str) -> str:
    return f"contains(' ' || {text} || ' ', ' {alias} ')" if len(alias) <= 2 else f"contains({text}, '{alias}')"


_CANON = "CASE " + " ".join(f"WHEN {_sql_hit('k', a)} THEN '{i}'" for a, i in lx.skill_aliases()) + " END"


@query("f14_skill_normalisation", f"SELECT user_id, raw, coalesce({_CANON}, raw) AS skill FROM (SELECT user_id, raw, {_plain('raw')} AS k FROM (SELECT user_id, unnest(string_split(skill_list, ';')) AS raw FROM profiles WHERE skill_list <> ''))")
def _(t):
    raw = t.profiles.where("skill_list <> ''").select("user_id", F.explode(F.split("skill_list", ";")).alias("raw"))
    return raw.select("user_id", "raw", tx.canonical_skills(F.array("raw"))[0].alias("skill"))


@query("f14_unmatched_skills", f"SELECT k AS skill, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, {_plain('raw')} AS k FROM (SELECT user_id, unnest(string_split(skill_list || ';Welding;' || branch, ';')) AS raw FROM profiles)) WHERE k <> '' AND {_CANON} IS NULL GROUP BY 1")
def _(t):
    listed = F.concat("skill_list", F.lit(";Welding;"), "branch")
    raw = t.profiles.select("user_id", F.explode(F.split(listed, ";")).alias("raw"))
    unknown = raw.where(tx.canonical_skill(F.col("raw")).isNull()).select("user_id", tx.comparable(F.col("raw")).alias("skill"))
    return unknown.where("skill <> ''").groupBy("skill").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("f16_first_degree_line", f"SELECT id, list_filter({_SPLIT.format(c='description')}, lambda s: length(s) > 12 AND length(s) < 300 AND regexp_matches(s, '(?i)\\b(degree|b\\.?tech|bachelor|master|diploma)\\b'))[1] AS line FROM postings")
def _(t):
    hit = F.filter(tx.statements(F.col("description")), lambda s: (F.length(s) > 12) & (F.length(s) < 300) & s.rlike(r"(?i)\b(degree|b\.?tech|bachelor|master|diploma)\b"))
    return t.postings.select("id", F.get(hit, 0).alias("line"))


@query("f17_work_arrangement", "SELECT CASE WHEN regexp_matches(location, '(?i)remote') THEN 'Remote' WHEN regexp_matches(location, '(?i)hybrid') THEN 'Hybrid' END AS arrangement, count(*) AS n FROM postings GROUP BY 1")
def _(t):
    return t.postings.groupBy(tx.work_arrangement(F.col("location")).alias("arrangement")).agg(F.count("*").alias("n"))


@query("f18_url_normalisation", "SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', '') AS url, regexp_extract(url, '^[a-z]+://[^/]+') || '/about' AS about FROM pages")
def _(t):
    return t.raw("pages").select("page_id", tx.url_host(F.col("url")).alias("host"), tx.normal_url(F.col("url")).alias("url"), tx.absolute_url(F.lit("/about"), F.col("url")).alias("about"))


_N = "regexp_replace(CAST({} AS STRING), '\\.0$', '')"


@query("f19_export_labels", f"SELECT id, CASE WHEN experience_min IS NULL AND experience_max IS NULL THEN NULL WHEN experience_min IS NOT NULL AND experience_max IS NOT NULL THEN {_N.format('experience_min')} || '–' || {_N.format('experience_max')} || ' years' WHEN experience_min IS NOT NULL THEN {_N.format('experience_min')} || '+ years' ELSE 'Up to ' || {_N.format('experience_max')} || ' years' END AS experience, nullif(concat_ws(', ', location, department, employment_type), '') AS where_what FROM postings")
def _(t):
    return t.postings.select("id", tx.experience_label(F.col("experience_min"), F.col("experience_max")).alias("experience"), tx.joined_or_null(F.array("location", "department", "employment_type")).alias("where_what"))


# --- lexicon joins --------------------------------------------------------------------------------


def _aliases_sql(pairs, name: str) -> str:
    values = ", ".join(f"({i}, '{a}', '{d}')" for i, (a, d) in enumerate(pairs))
    return f"{name} AS (SELECT * FROM (VALUES {values}) v(rank, alias, id))"


@query("c13_skills_in_text", f"SELECT p.id, s.id AS skill FROM (SELECT id, {_plain('description')} AS k FROM postings) p JOIN skills s ON CASE WHEN length(s.alias) <= 2 THEN contains(' ' || k || ' ', ' ' || s.alias || ' ') ELSE contains(k, s.alias) END GROUP BY ALL", _aliases_sql(lx.skill_aliases(), "skills"))
def _(t):
    return t.postings.select("id", F.explode(tx.skills_in(F.col("description"))).alias("skill"))


@query("c14_field_first_match", f"SELECT p.id, coalesce(min_by(f.id, f.rank), '{lx.UNKNOWN_FIELD}') AS field FROM (SELECT id, {_plain('description')} AS k FROM postings) p LEFT JOIN fields f ON contains(k, f.alias) GROUP BY 1", _aliases_sql(lx.field_aliases(), "fields"))
def _(t):
    return t.postings.select("id", tx.field_of(F.col("description")).alias("field"))


def relation_table(t: Tables) -> DataFrame:
    """The relations as rows; a fixed table of 19 lines."""
    lines = [(u, j, s, lx.RELATION_SCORES[s], w) for u, j, s, w in lx.RELATIONS]
    return t.spark.createDataFrame(lines, "user_field string, job_field string, strength string, score int, why string")


_REL = "rel AS (SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{j}', '{s}', {lx.RELATION_SCORES[s]})" for u, j, s, _ in lx.RELATIONS) + ") v(user_field, job_field, strength, score))"
_USERS = f"users AS (SELECT user_id, coalesce((SELECT min_by(f.id, f.rank) FROM fields f WHERE contains({_plain('p.branch')}, f.alias)), '{lx.UNKNOWN_FIELD}') AS user_field FROM profiles p)"
_PAIRS = f"""pairs AS (SELECT r.job_id, u.user_id, r.f AS job_field, r.pos, CASE WHEN u.user_field = r.f THEN 'EQUIVALENT' ELSE coalesce(rel.strength, 'NONE') END AS strength,
 CASE WHEN u.user_field = r.f THEN 100 ELSE coalesce(rel.score, 0) END AS score FROM (SELECT job_id, unnest(string_split(field_list, ';')) AS f, generate_subscripts(string_split(field_list, ';'), 1) AS pos FROM requirements WHERE field_list <> '') r
 JOIN (SELECT p.id, u.* FROM postings p JOIN users u ON u.user_id = p.user_id) u ON u.id = r.job_id LEFT JOIN rel ON rel.user_field = u.user_field AND rel.job_field = r.f)"""


def _pairs(t: Tables) -> DataFrame:
    users = t.profiles.select("user_id", tx.field_of(F.col("branch")).alias("user_field"))
    asked = t.postings.select(F.col("id").alias("job_id"), "user_id").join(users, "user_id")
    fields = t.requirements.where("field_list <> ''").select("job_id", F.posexplode(F.split("field_list", ";")).alias("pos", "job_field"))
    pairs = fields.join(asked, "job_id").join(relation_table(t), ["user_field", "job_field"], "left")
    same = F.col("user_field") == F.col("job_field")
    return pairs.select("job_id", "user_id", "job_field", (F.col("pos") + 1).alias("pos"), F.when(same, "EQUIVALENT").otherwise(F.coalesce("strength", F.lit("NONE"))).alias("strength"), F.when(same, 100).otherwise(F.coalesce("score", F.lit(0))).alias("score"))


def _best(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("job_id", "user_id").agg(F.max_by(F.struct("job_field", "score"), F.struct("score", -F.col("pos"))).alias("best"))
    return best.select("job_id", "user_id", "best.job_field", "best.score")


_RELATIONS = "SELECT job_id, user_id, job_field, strength, score FROM pairs"
_BEST = "SELECT job_id, user_id, job_field, score FROM (SELECT *, row_number() OVER (PARTITION BY job_id, user_id ORDER BY score DESC, pos) AS k FROM pairs) WHERE k = 1"


_REL_CTES = (_aliases_sql(lx.field_aliases(), "fields"), _REL, _USERS, _PAIRS)


@query("c11_field_relation", _RELATIONS, *_REL_CTES)
def _(t):
    return _pairs(t).select("job_id", "user_id", "job_field", "strength", "score")


@query("c12_best_relation", _BEST, *_REL_CTES)
def _(t):
    return _best(_pairs(t))
