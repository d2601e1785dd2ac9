"""Queries of requirement extraction and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..operators import eligibility as el
from ..operators import requirements as rq
from .check_texts import TEXTS
from .fixtures import Tables
from .listing import profiles
from .registry import SELECTS, query
from .texts import _SPLIT, _aliases_sql, _plain, _re2, _sql_level

#: Requirements speak of years around 2025.
EXTRACT_AS_OF = "2026-06-01"


def extracted(t: Tables) -> DataFrame:
    return rq.extract(t.dealt_postings, F.lit(EXTRACT_AS_OF).cast("date"))


def _clean(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


_BASE = f"""base AS (SELECT *, concat_ws(chr(10), edu, descr, ttl) AS corpus FROM (SELECT *, {_clean('title')} AS ttl, {_clean('description')} AS descr, {_clean('education_requirement')} AS edu, {_clean('location')} AS loc FROM postings))"""


def _ex(p: str, n: int = 0) -> str:
    return f"nullif(regexp_extract(corpus, {_re2(p)}, {n}), '')"


def _hit(c: str, p: str) -> str:
    return f"regexp_matches({c}, {_re2(p)})"


@query("g2_degree_level", f"SELECT id, CASE WHEN {_sql_level('coalesce(edu, chr(32))')} <> 'UNKNOWN' THEN {_sql_level('edu')} ELSE {_sql_level('coalesce(s, chr(32))')} END AS level, CASE WHEN {_sql_level('coalesce(edu, chr(32))')} <> 'UNKNOWN' THEN 'EXPLICIT' WHEN {_sql_level('coalesce(s, chr(32))')} <> 'UNKNOWN' THEN 'INFERRED' ELSE 'MISSING' END AS origin FROM (SELECT *, nullif(regexp_extract(descr, {_re2(lx.DEGREE_SENTENCE)}), '') AS s FROM base)", _BASE)
def _(t):
    return extracted(t).select("id", "requirements.degree_level", F.try_element_at("requirements.origin", F.lit("DEGREE_LEVEL")).alias("origin")).withColumnRenamed("degree_level", "level")


_PARTS = f"""heard AS (SELECT id, 1 AS h, edu AS x FROM base UNION ALL SELECT id, 2, descr FROM base UNION ALL SELECT id, 3, ttl FROM base),
said AS (SELECT id, h, unnest({_SPLIT.format(c='x').replace('length(s) > 2', 'length(s) > 0')}) AS s FROM heard WHERE x IS NOT NULL),
bits AS (SELECT DISTINCT id, h, {_plain('p')} AS k FROM (SELECT id, h, unnest(regexp_split_to_array(s, {_re2(lx.FIELD_SPLIT)})) AS p FROM said WHERE regexp_matches({_plain('s')}, {_re2(lx.FIELD_WORDS)}))),
hits AS (SELECT b.id, b.h, b.k, min_by(f.id, f.rank) AS field FROM bits b JOIN fields f ON contains(b.k, f.alias) GROUP BY ALL)"""


@query("g3_fields", "SELECT b.id, coalesce(string_agg(DISTINCT field, ',' ORDER BY field), '') AS fields FROM base b LEFT JOIN (SELECT id, field FROM hits JOIN (SELECT id, min(h) AS h FROM hits GROUP BY 1) USING (id, h)) x ON x.id = b.id GROUP BY 1", _BASE, _aliases_sql(lx.field_aliases(), "fields"), _PARTS)
def _(t):
    return extracted(t).select("id", F.array_join(F.array_sort("requirements.fields"), ",").alias("fields"))


_E = lx.EXPERIENCE
_NUM = lambda p, n=1: f"CAST({_ex(p, n)} AS DOUBLE)"


@query("g4_experience", f"""SELECT id, CASE WHEN experience_min IS NOT NULL OR experience_max IS NOT NULL THEN coalesce(experience_min, 0) WHEN {_hit('corpus', lx.FRESHER)} THEN 0 WHEN {_hit('corpus', _E['range'])} THEN least({_NUM(_E['range'])}, {_NUM(_E['range'], 2)})
 WHEN {_hit('corpus', _E['plus'])} THEN {_NUM(_E['plus'])} WHEN {_hit('corpus', _E['at_least'])} THEN {_NUM(_E['at_least'])} WHEN {_hit('corpus', _E['up_to'])} THEN 0 WHEN {_hit('corpus', _E['bare'])} THEN {_NUM(_E['bare'])} END AS low,
 CASE WHEN experience_min IS NOT NULL OR experience_max IS NOT NULL THEN experience_max WHEN {_hit('corpus', lx.FRESHER)} THEN 0 WHEN {_hit('corpus', _E['range'])} THEN greatest({_NUM(_E['range'])}, {_NUM(_E['range'], 2)}) WHEN {_hit('corpus', _E['plus'])} OR {_hit('corpus', _E['at_least'])} THEN NULL WHEN {_hit('corpus', _E['up_to'])} THEN {_NUM(_E['up_to'])} END AS high,
 experience_min IS NOT NULL OR experience_max IS NOT NULL OR {' OR '.join(_hit('corpus', p) for p in (lx.FRESHER, *_E.values()))} AS stated FROM base""", _BASE)
def _(t):
    return extracted(t).select("id", F.col("requirements.experience_min").alias("low"), F.col("requirements.experience_max").alias("high"), F.col("requirements.experience_stated").alias("stated"))


def _near(name: str) -> str:
    m, at = f"regexp_extract(corpus, {_re2(_E[name])})", f"instr(corpus, regexp_extract(corpus, {_re2(_E[name])}))"
    return f"({_hit(f'substr(corpus, greatest(1, {at} - 130), {at} - greatest(1, {at} - 130))', lx.MANDATORY)} OR {_hit(f'substr(corpus, {at} + length({m}), 90)', lx.MANDATORY)})"


@query("g5_mandatory_nearby", f"SELECT id, {_near('bare')} AS mandatory FROM base WHERE {_hit('corpus', _E['bare'])}", _BASE)
def _(t):
    corpus = F.concat_ws("\n", *[F.nullif(tx.collapse(F.col(c)), F.lit("")) for c in ("education_requirement", "description", "title")])
    kept = t.postings.select("id", corpus.alias("corpus")).where(F.col("corpus").rlike(_E["bare"]))
    return kept.select("id", rq.mandatory_nearby(F.col("corpus"), _E["bare"]).alias("mandatory"))


_G = lx.GRADUATION
_INT = lambda p, n=1: f"CAST({_ex(p, n)} AS INT)"
_BATCH = f"coalesce({_INT(_G['batch'])}, {_INT(_G['batch'], 2)})"
_A, _B, _BEF = _INT(_G["range"]), _INT(_G["range"], 2), _INT(_G["before"])


@query("g6_graduation_year", f"SELECT id, CASE WHEN {_BATCH} BETWEEN 2000 AND 2036 THEN {_BATCH} WHEN {_A} >= 2000 AND {_B} <= 2036 THEN least({_A}, {_B}) END AS low, CASE WHEN {_BATCH} BETWEEN 2000 AND 2036 THEN {_BATCH} WHEN {_A} >= 2000 AND {_B} <= 2036 THEN greatest({_A}, {_B}) WHEN {_BEF} BETWEEN 2000 AND 2036 THEN {_BEF} ELSE {_INT(_G['earlier'])} END AS high FROM base", _BASE)
def _(t):
    return extracted(t).select("id", F.col("requirements.grad_year_min").alias("low"), F.col("requirements.grad_year_max").alias("high"))


_SKILL = f"""stated AS (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM (SELECT id, {_SPLIT.format(c='descr').replace('length(s) > 2', 'length(s) > 0')} AS s FROM base WHERE descr IS NOT NULL)),
named AS (SELECT DISTINCT st.id, st.pos, sk.id AS skill, CASE WHEN {_hit('st.s', lx.PREFERRED)} THEN 'preferred' WHEN {_hit('st.s', lx.MANDATORY)} THEN 'required' ELSE 'mentioned' END AS kind FROM stated st JOIN skills sk ON CASE WHEN length(sk.alias) <= 2 THEN contains(' ' || {_plain('st.s')} || ' ', ' ' || sk.alias || ' ') ELSE contains({_plain('st.s')}, sk.alias) END),
last AS (SELECT id, skill, max_by(kind, pos) FILTER (kind <> 'mentioned') AS kind, bool_or(kind = 'preferred') AS preferred FROM named GROUP BY ALL)"""


@query("g7_skills", "SELECT b.id, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (kind = 'required'), '') AS required, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (preferred), '') AS preferred FROM base b LEFT JOIN last l ON l.id = b.id GROUP BY 1", _BASE, _aliases_sql(lx.skill_aliases(), "skills"), _SKILL)
def _(t):
    return extracted(t).select("id", *[F.array_join(F.array_sort(f"requirements.skills_{k}"), ",").alias(k) for k in ("required", "preferred")])


def _labels(pairs) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_hit('corpus', p)} THEN '{n}' END" for n, p in pairs) + "], lambda x: x IS NOT NULL), ',')"


@query("g8_certifications", f"SELECT id, {_labels(lx.CERTIFICATIONS)} AS certifications FROM base", _BASE)
def _(t):
    return extracted(t).select("id", F.array_join("requirements.certifications", ",").alias("certifications"))


@query("g9_location", f"SELECT id, {_hit('corpus', lx.RELOCATION)} AS relocation, {_hit('corpus', lx.RELOCATION)} OR {_hit('corpus', lx.LOCATION_RESTRICTED)} AS restricted, concat_ws('|', loc, CASE WHEN trim({_ex(lx.BASED_IN, 1)}) <> loc THEN trim({_ex(lx.BASED_IN, 1)}) END) AS locations FROM base", _BASE)
def _(t):
    return extracted(t).select("id", F.col("requirements.requires_relocation").alias("relocation"), F.col("requirements.location_restricted").alias("restricted"), F.array_join("requirements.locations", "|").alias("locations"))


@query("g10_work_authorization", f"SELECT id, CASE WHEN {_hit('corpus', lx.WORK_AUTH_GATE)} THEN {_labels(lx.WORK_AUTH_LABELS)} END AS needed FROM base", _BASE)
def _(t):
    return extracted(t).select("id", F.array_join("requirements.work_authorization", ",").alias("needed"))


def _first_of(tiers: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in tiers) + f" ELSE {other} END"


_GIVEN = "experience_min IS NOT NULL OR experience_max IS NOT NULL"
_AS_INT = lambda c: f"CAST(CAST({c} AS INT) AS VARCHAR)"
_TIERS = [(_hit("corpus", p), _ex(p)) for p in (lx.FRESHER, *_E.values())]
_STATED = f"({_GIVEN} OR {' OR '.join(t for t, _ in _TIERS)})"
_SENIOR = f"(NOT {_STATED} AND {_hit('coalesce(ttl, chr(32))', lx.SENIORITY)})"
_BASED = f"nullif(trim({_ex(lx.BASED_IN, 1)}), '')"
_GRAD_RAW = _first_of([(f"{_BATCH} BETWEEN 2000 AND 2036", _ex(_G["batch"])), (f"{_A} >= 2000 AND {_B} <= 2036", _ex(_G["range"])), (f"{_BEF} BETWEEN 2000 AND 2036", _ex(_G["before"])), (f"{_INT(_G['earlier'])} IS NOT NULL", _ex(_G["earlier"]))], "NULL")
_LONE = f"""lone AS (SELECT id, {_first_of([(_GIVEN, f"{_AS_INT('coalesce(experience_min, 0)')} || coalesce('-' || {_AS_INT('experience_max')}, '+') || ' years'"), *_TIERS], 'NULL')} AS experience_raw,
  {_first_of([(_GIVEN, "'EXPLICIT'"), (f"{_STATED} OR {_SENIOR}", "'INFERRED'")], "'MISSING'")} AS experience_origin,
  {_first_of([(_GIVEN, "true"), (_hit("corpus", lx.FRESHER), "false"), (_hit("corpus", _E["range"]), _near("range")), (f"{_hit('corpus', _E['plus'])} OR {_hit('corpus', _E['at_least'])}", "true"), (_hit("corpus", _E["up_to"]), "false"), (_hit("corpus", _E["bare"]), _near("bare"))], "false")} AS experience_mandatory,
  {_SENIOR} AS senior, {_GRAD_RAW} AS grad_year_raw, CASE WHEN {_BASED} IS NOT NULL THEN 'INFERRED' WHEN loc IS NOT NULL THEN 'EXPLICIT' ELSE 'MISSING' END AS location_origin,
  {' OR '.join(f"coalesce({_hit(c, lx.EQUIVALENT)}, false)" for c in ('edu', 'descr', 'ttl'))} AS accepts_equivalent FROM base)"""
_FIELD_ORIGIN = "heard_in AS (SELECT id, CASE min(h) WHEN 1 THEN 'EXPLICIT' ELSE 'INFERRED' END AS field_origin FROM hits GROUP BY 1)"
_EXTRACTED = f"""extracted AS (SELECT b.id, g2.level AS degree_level, g2.origin AS degree_origin, g3.fields, coalesce(ho.field_origin, 'MISSING') AS field_origin, lone.accepts_equivalent, g4.low AS experience_min, g4.high AS experience_max, g4.stated AS experience_stated, lone.experience_mandatory, lone.experience_raw, lone.experience_origin,
  g6.low AS grad_year_min, g6.high AS grad_year_max, g6.low IS NOT NULL OR g6.high IS NOT NULL AS grad_year_stated, lone.grad_year_raw, g7.required AS skills_required, g7.preferred AS skills_preferred, g8.certifications, g9.locations, g9.restricted AS location_restricted, g9.relocation AS requires_relocation, lone.location_origin, g10.needed AS work_authorization, lone.senior,
  list_filter([CASE WHEN g2.level = 'UNKNOWN' THEN '{lx.GAPS["degree"]}' END, CASE WHEN g3.fields = '' THEN '{lx.GAPS["field"]}' END, CASE WHEN lone.senior THEN '{lx.GAPS["senior"]}' END, CASE WHEN g9.locations = '' THEN '{lx.GAPS["location"]}' END], lambda g: g IS NOT NULL) AS gaps
  FROM base b JOIN lone USING (id) LEFT JOIN heard_in ho USING (id) {' '.join(f"JOIN ({SELECTS[name]}) {name.split('_')[0]} USING (id)" for name in ('g2_degree_level', 'g3_fields', 'g4_experience', 'g6_graduation_year', 'g7_skills', 'g8_certifications', 'g9_location', 'g10_work_authorization'))})"""
_EX_CTES = (_BASE, _aliases_sql(lx.field_aliases(), "fields"), _aliases_sql(lx.skill_aliases(), "skills"), _PARTS, _SKILL, _LONE, _FIELD_ORIGIN, _EXTRACTED)
#: Columns of the extraction that are compared as they are, and lists compared as sorted text.
_SINGLE = ("degree_level", "accepts_equivalent", "experience_min", "experience_max", "experience_stated", "experience_mandatory", "experience_raw", "grad_year_min", "grad_year_max", "grad_year_stated", "grad_year_raw", "location_restricted", "requires_relocation")
_ORIGINS = {"degree_origin": "DEGREE_LEVEL", "field_origin": "FIELD", "experience_origin": "EXPERIENCE", "location_origin": "LOCATION"}


@query("g1_extract_requirements", f"SELECT id, {', '.join(_SINGLE)}, {', '.join(_ORIGINS)}, fields, skills_required, skills_preferred, certifications, locations, work_authorization, array_to_string(gaps, '|') AS gaps FROM extracted", *_EX_CTES)
def _(t):
    r = F.col("requirements")
    lists = [F.array_join(F.array_sort(r[c]), ",").alias(c) for c in ("fields", "skills_required", "skills_preferred")] + [F.array_join(r[c], ",").alias(c) for c in ("certifications", "work_authorization")]
    origins = [F.try_element_at(r["origin"], F.lit(key)).alias(c) for c, key in _ORIGINS.items()]
    return extracted(t).select("id", *[r[c].alias(c) for c in _SINGLE], *origins, *lists, *[F.array_join(r[c], "|").alias(c) for c in ("locations", "gaps")])


@query("g11_gaps", "SELECT id, unnest(gaps) AS gap, CAST(generate_subscripts(gaps, 1) - 1 AS INT) AS position FROM extracted WHERE len(gaps) > 0", *_EX_CTES)
def _(t):
    return extracted(t).select("id", F.posexplode("requirements.gaps").alias("position", "gap"))


_AUDIT = "audit AS (" + " UNION ALL ".join(
    f"SELECT job_id, '{kind}' AS type, vs[i] AS value, origin, {at} + i AS spot FROM (SELECT id AS job_id, {values} AS vs, {origin} AS origin, unnest(generate_series(1, len({values}))) AS i FROM extracted)"
    for at, kind, values, origin in (
        (0, "DEGREE", "list_filter([degree_level], lambda x: x <> 'UNKNOWN')", "degree_origin"), (100, "FIELD", "list_filter(string_split(fields, ','), lambda x: x <> '')", "field_origin"), (200, "EXPERIENCE", "list_filter([experience_raw], lambda x: x IS NOT NULL)", "experience_origin"),
        (300, "SKILL", "list_filter(string_split(skills_required, ',') || string_split(skills_preferred, ','), lambda x: x <> '')", "'INFERRED'"), (400, "CERTIFICATION", "list_filter(string_split(certifications, ','), lambda x: x <> '')", "'INFERRED'"),
        (500, "LOCATION", "list_filter(string_split(locations, '|'), lambda x: x <> '')", "location_origin"), (600, "WORK_AUTH", "list_filter(string_split(coalesce(work_authorization, ''), ','), lambda x: x <> '')", "'INFERRED'"), (700, "GAP", "gaps", "'INFERRED'"),
    )
) + ")"


@query("d16_requirement_audit", f"SELECT job_id, type, {_plain('value')} AS normalized_value, arg_max(value, spot) AS value, arg_max(origin, spot) AS origin FROM audit GROUP BY ALL", *_EX_CTES, _AUDIT)
def _(t):
    return rq.audit_rows(extracted(t))


# --- H: verdicts on the flat requirement table, so that SQL can follow every ladder -----------------


def pairs(t: Tables) -> DataFrame:
    parts = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    flat = t.requirements.select(
        F.col("job_id").alias("id"), "degree_level", parts("field_list").alias("fields"), F.lit(False).alias("accepts_equivalent"), "experience_min", "experience_max", "experience_stated", "grad_year_min", "grad_year_max", "grad_year_stated", "grad_year_raw",
        parts("skills_required_list").alias("skills_required"), parts("skills_preferred_list").alias("skills_preferred"), parts("certification_list").alias("certifications"), "location_restricted", parts("work_auth_list").alias("work_authorization"),
        F.array().cast("array<string>").alias("locations"), F.create_map().cast("map<string,string>").alias("origin"), F.array().cast("array<string>").alias("gaps"),
    )
    jobs = t.postings.select("id", "user_id", "status", "title", "description", "location")
    return el.pair(jobs.join(flat, "id"), profiles(t))


_REL = "CASE j " + " ".join(f"WHEN '{j}' THEN {lx.RELATION_SCORES[s]}" for _, j, s, _ in lx.RELATIONS) + " ELSE 0 END"
_CANON = "CASE " + " ".join(f"WHEN {'contains(chr(32) || k || chr(32), chr(32) || ' + repr(a) + ' || chr(32))' if len(a) <= 2 else 'contains(k, ' + repr(a) + ')'} THEN '{i}'" for a, i in lx.skill_aliases()) + " END"
_H = f"""prof AS (SELECT p.*, coalesce((SELECT min_by(f.id, f.rank) FROM fields f WHERE contains({_plain('p.branch')}, f.alias)), 'UNKNOWN_FIELD') AS field, {_sql_level("p.degree || ' ' || p.branch")} AS level,
  coalesce((SELECT list(coalesce({_CANON}, raw)) FROM (SELECT raw, {_plain('raw')} AS k FROM (SELECT unnest(string_split(p.skill_list, ';')) AS raw) WHERE raw <> '')), []) AS own FROM profiles p),
pairs AS (SELECT q.id, q.title, q.description, trim(regexp_replace(q.location, '\\s+', ' ', 'g')) AS place, q.user_id, r.*, f.field, f.level, f.own, f.years_of_experience AS years, f.graduation_year AS y, f.preferred_list, f.auth_list, f.willing_to_relocate AS willing,
  list_filter(string_split(r.skills_required_list, ';'), lambda s: s <> '') AS need, list_filter(string_split(r.field_list, ';'), lambda s: s <> '') AS asked, list_filter(string_split(r.work_auth_list, ';'), lambda s: s <> '') AS auth, list_filter(string_split(f.auth_list, ';'), lambda s: s <> '') AS mine
  FROM postings q JOIN requirements r ON r.job_id = q.id JOIN prof f ON f.user_id = q.user_id WHERE q.status = 'ACTIVE'),
ranked AS (SELECT *, CASE degree_level {' '.join(f"WHEN '{k}' THEN {v}" for k, v in lx.DEGREE_RANK.items())} ELSE 0 END AS need_rank, CASE level {' '.join(f"WHEN '{k}' THEN {v}" for k, v in lx.DEGREE_RANK.items())} ELSE 0 END AS own_rank,
  CASE WHEN field = 'CHEMICAL_ENGINEERING' THEN coalesce(list_max(list_transform(asked, lambda j: {_REL})), 0) ELSE 0 END AS best, len(list_filter(need, lambda s: list_contains(own, s))) AS hit, skills_required_list = '' AND skills_preferred_list = '' AS unlisted,
  (grad_year_min IS NULL OR y >= grad_year_min) AND (grad_year_max IS NULL OR y <= grad_year_max) AS in_years,
  {_hit("title || chr(10) || description", lx.FRESHER_FRIENDLY)} OR {_hit("title", lx.FRESHER_TITLE)} AS welcome FROM pairs),
checks AS (SELECT id, user_id, length(description) > 120 OR experience_stated AS readable,
  CASE WHEN degree_level IN ('UNKNOWN', 'ANY') THEN 'UNKNOWN' WHEN need_rank > own_rank THEN 'MISMATCH' ELSE 'MATCH' END AS degree, degree_level NOT IN ('UNKNOWN', 'ANY') AS degree_m,
  CASE WHEN len(asked) = 0 THEN 'UNKNOWN' WHEN list_contains(asked, field) OR best >= 88 THEN 'MATCH' WHEN best > 0 THEN 'UNKNOWN' ELSE 'MISMATCH' END AS field, len(asked) > 0 AS field_m,
  CASE WHEN experience_stated AND experience_min IS NOT NULL THEN CASE WHEN years >= experience_min AND years > experience_max + 1 THEN 'PARTIAL' WHEN years >= experience_min THEN 'MATCH' WHEN experience_min - years <= 1 AND welcome THEN 'UNKNOWN' ELSE 'MISMATCH' END ELSE 'MATCH' END AS experience,
  experience_stated AND experience_min IS NOT NULL AND NOT coalesce(years > experience_max + 1 AND years >= experience_min, false) AS experience_m,
  CASE WHEN NOT grad_year_stated OR coalesce(in_years, false) THEN 'MATCH' WHEN {_hit('grad_year_raw', lx.BATCH_GATE)} THEN 'MISMATCH' ELSE 'UNKNOWN' END AS graduation, grad_year_stated AS graduation_m,
  CASE WHEN unlisted OR (len(need) >= 3 AND hit < 0.5 * len(need)) THEN 'UNKNOWN' WHEN hit < len(need) THEN 'PARTIAL' ELSE 'MATCH' END AS skills, NOT unlisted AND len(need) >= 3 AND hit < 0.5 * len(need) AS skills_m,
  CASE WHEN {_hit('place', lx.REMOTE_WORDS)} OR (preferred_list <> '' AND len(list_filter(string_split(preferred_list, ';'), lambda p: contains(lower(place), lower(p)) OR contains(lower(p), lower(place)))) > 0) THEN 'MATCH' WHEN location_restricted AND NOT willing THEN 'MISMATCH' WHEN willing THEN 'MATCH' ELSE 'PARTIAL' END AS location,
  location_restricted AND NOT willing AND NOT ({_hit('place', lx.REMOTE_WORDS)} OR (preferred_list <> '' AND len(list_filter(string_split(preferred_list, ';'), lambda p: contains(lower(place), lower(p)) OR contains(lower(p), lower(place)))) > 0)) AS location_m,
  CASE WHEN auth IS NULL OR len(list_filter(auth, lambda n: len(list_filter(mine, lambda m: contains(lower(n), lower(m)) OR contains(lower(m), lower(n)))) > 0)) = len(auth) THEN 'MATCH' WHEN len(mine) = 0 THEN 'UNKNOWN' ELSE 'MISMATCH' END AS work, auth IS NOT NULL AS work_m,
  CASE WHEN certification_list = '' OR len(list_filter(string_split(certification_list, ';'), lambda c: len(list_filter(own, lambda m: contains(lower(m), lower(c)))) = 0)) = 0 THEN 'MATCH' ELSE 'UNKNOWN' END AS certification, certification_list <> '' AS certification_m FROM ranked),
judged AS (SELECT *, CASE WHEN {' OR '.join(f"({k}_m AND {k} = 'MISMATCH')" for k in ('degree', 'field', 'experience', 'graduation', 'skills', 'location', 'work', 'certification'))} THEN 'INELIGIBLE' WHEN NOT readable OR {' OR '.join(f"({k}_m AND {k} = 'UNKNOWN')" for k in ('degree', 'field', 'experience', 'graduation', 'skills', 'location', 'work', 'certification'))} THEN 'UNCERTAIN' ELSE 'ELIGIBLE' END AS verdict FROM checks)"""
_CTES = (_aliases_sql(lx.field_aliases(), "fields"), _H)
_POINTS = lambda c: f"CASE {c} WHEN 'MATCH' THEN 100 WHEN 'PARTIAL' THEN 55 WHEN 'UNKNOWN' THEN 40 ELSE 0 END"
_SCORES = f"scored AS (SELECT *, CAST(floor(({_POINTS('degree')} + {_POINTS('field')}) / 2.0 + 0.5) AS INT) AS s_edu, {_POINTS('experience')} AS s_exp, {_POINTS('skills')} AS s_skill, {_POINTS('location')} AS s_loc, CAST(floor(({_POINTS('work')} + {_POINTS('certification')} + CASE WHEN readable THEN 0 ELSE 40 END) / CASE WHEN readable THEN 2.0 ELSE 3.0 END + 0.5) AS INT) AS s_other FROM judged)"


def _one(name: str, make) -> None:
    @query(name, f"SELECT id, {name.split('_')[1]} AS outcome, {name.split('_')[1]}_m AS mandatory FROM checks", *_CTES)
    def _(t):
        checked = pairs(t).withColumn("c", make())
        return checked.select("id", "c.outcome", "c.mandatory")


for _name, _make in (("h3_degree_check", el.degree_check), ("h4_field_check", el.field_check), ("h5_experience_check", el.experience_check), ("h6_graduation_check", el.graduation_check), ("h7_skills_check", el.skill_check), ("h8_location_check", el.location_check), ("h9_work_check", el.work_check), ("h10_certification_check", el.certification_check)):
    _one(_name, _make)


@query("h2_readability_check", "SELECT id, NOT readable AS unreadable FROM checks", *_CTES)
def _(t):
    return pairs(t).select("id", el.readable().isNotNull().alias("unreadable"))


@query("h11_verdict", "SELECT id, verdict FROM judged", *_CTES)
def _(t):
    return el.with_checks(pairs(t)).select("id", el.decide(F.col("checks")).alias("verdict"))


@query("d14_factor_scores", "SELECT id, s_edu AS education, s_exp AS experience, s_skill AS skills, s_loc AS location, s_other AS other FROM scored", *_CTES, _SCORES)
def _(t):
    return el.with_checks(pairs(t)).select("id", el.scores(F.col("checks")).alias("s")).select("id", "s.*")


@query("d15_match_score", "SELECT id, CAST(floor(s_edu * 0.35 + s_exp * 0.25 + s_skill * 0.2 + s_loc * 0.1 + s_other * 0.1 + 0.5) AS INT) AS match_score FROM scored", *_CTES, _SCORES)
def _(t):
    return el.with_checks(pairs(t)).select("id", el.match_score(el.scores(F.col("checks"))).alias("match_score"))


@query("c10_job_profile_pairs", "SELECT id, user_id FROM checks", *_CTES)
def _(t):
    return pairs(t).select("id", "user_id")


_OUT = "unnest([" + ", ".join(("degree", "field", "experience", "graduation", "skills", "location", "work", "certification")) + "])"


@query("d17_checks_by_outcome", f"SELECT id, count(*) FILTER (o = 'MATCH') AS met, count(*) FILTER (o = 'MISMATCH') AS not_met, count(*) FILTER (o = 'UNKNOWN') + any_value(CASE WHEN readable THEN 0 ELSE 1 END) AS unknown, count(*) FILTER (o = 'PARTIAL') AS partial FROM (SELECT id, readable, {_OUT} AS o FROM checks) GROUP BY 1", *_CTES)
def _(t):
    one = el.with_checks(pairs(t)).select("id", F.explode("checks").alias("c"))
    counts = one.groupBy("id").pivot("c.outcome", ["MATCH", "MISMATCH", "UNKNOWN", "PARTIAL"]).count().na.fill(0)
    return counts.toDF("id", "met", "not_met", "unknown", "partial")


_LISTED = ("matched", "missing", "concerns")
_TOLD = (*_CTES, _SCORES, *TEXTS)


def _sorted_text(c: str) -> Column:
    return F.array_join(F.array_sort(c), "|")


@query("h1_analyse", """SELECT t.id, t.user_id, t.verdict, CAST(floor(s_edu * 0.35 + s_exp * 0.25 + s_skill * 0.2 + s_loc * 0.1 + s_other * 0.1 + 0.5) AS INT) AS match_score, s_edu AS education, s_exp AS experience, s_skill AS skills, s_loc AS location, s_other AS other,
 explanation, matched, missing, concerns, unknown AS missing_information FROM texts t JOIN scored s ON s.id = t.id AND s.user_id = t.user_id""", *_TOLD)
def _(t):
    lists = [_sorted_text(c).alias(c) for c in (*_LISTED, "missing_information")]
    return el.analyse(pairs(t)).select("id", "user_id", "verdict", "match_score", "scores.*", "explanation", *lists)


@query("h12_explanation", "SELECT id, verdict, explanation FROM texts", *_TOLD)
def _(t):
    return el.analyse(pairs(t)).select("id", "verdict", "explanation")


@query("h13_lists", "SELECT id, matched, missing, concerns, unknown FROM texts", *_TOLD)
def _(t):
    a = el.with_checks(pairs(t))
    lists = a.select("id", *[el.collected(F.col("checks"), n).alias(n) for n in (*_LISTED, "unknown")])
    return lists.select("id", *[_sorted_text(n).alias(n) for n in (*_LISTED, "unknown")])


# The extraction in the form of the flat requirement table, for the same ladders.
_AGAIN = """flat AS (SELECT id AS job_id, degree_level, replace(fields, ',', ';') AS field_list, experience_min, experience_max, experience_stated, grad_year_min, grad_year_max, grad_year_stated, coalesce(grad_year_raw, '') AS grad_year_raw, replace(skills_required, ',', ';') AS skills_required_list, replace(skills_preferred, ',', ';') AS skills_preferred_list,
 replace(certifications, ',', ';') AS certification_list, location_restricted, replace(work_authorization, ',', ';') AS work_auth_list, senior, degree_origin = 'EXPLICIT' OR field_origin = 'EXPLICIT' AS explicit FROM extracted)"""
_H_AGAIN = (
    _H.replace("JOIN requirements r ON", "JOIN flat r ON")
    .replace("length(description) > 120 OR experience_stated AS readable", "length(description) > 120 OR explicit OR experience_stated AS readable")
    .replace("ELSE 'MISMATCH' END ELSE 'MATCH' END AS experience,", "ELSE 'MISMATCH' END WHEN senior AND experience_min IS NULL THEN 'UNKNOWN' ELSE 'MATCH' END AS experience,")
    .replace("years >= experience_min, false) AS experience_m", "years >= experience_min, false) OR (senior AND experience_min IS NULL) AS experience_m")
)


@query("i17_reanalyse", "SELECT user_id, verdict, count(*) AS postings, round(avg(CAST(floor(s_edu * 0.35 + s_exp * 0.25 + s_skill * 0.2 + s_loc * 0.1 + s_other * 0.1 + 0.5) AS INT)), 4) AS mean_score FROM scored GROUP BY ALL", *_EX_CTES, _AGAIN, _H_AGAIN, _SCORES)
def _(t):
    """Requirements and verdicts of all ACTIVE postings afresh, from their texts."""
    jobs = extracted(t).drop("experience_min", "experience_max").select("*", "requirements.*").drop("requirements")
    done = el.analyse(el.pair(jobs, profiles(t)))
    return done.groupBy("user_id", "verdict").agg(F.count("*").alias("postings"), F.round(F.avg("match_score"), 4).alias("mean_score"))
