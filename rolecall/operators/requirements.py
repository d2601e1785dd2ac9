"""Requirement extraction: postings to one struct of requirements, origins, evidence and gaps.

All expressions are native.  What is not found stays null or empty and becomes a gap; structured
fields beat prose.  One key set names origins and evidence: DEGREE_LEVEL, FIELD, EXPERIENCE,
GRADUATION_YEAR, LOCATION.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def degree(edu: Column, description: Column) -> Column:
    """struct<level, evidence, origin>: the structured field if it names a level, else the first
    sentence about a degree."""
    from_edu, sentence = tx.degree_level(edu), F.regexp_substr(description, F.lit(lx.DEGREE_SENTENCE))
    from_text = tx.degree_level(sentence)
    made = lambda level, ev, origin: F.struct(level.alias("level"), ev.alias("evidence"), F.lit(origin).alias("origin"))
    return (
        F.when(from_edu != "UNKNOWN", made(from_edu, edu, "EXPLICIT"))
        .when(from_text != "UNKNOWN", made(from_text, tx.collapse(sentence), "INFERRED"))
        .otherwise(made(F.lit("UNKNOWN"), _none("string"), "MISSING"))
    )


def _fields_of(text: Column) -> Column:
    """array<struct<field, sentence>> of a text's sentences that speak of a degree, first of each field."""
    said = F.filter(tx.statements(text, 0), lambda s: tx.comparable(s).rlike(lx.FIELD_WORDS))
    each = F.flatten(F.transform(said, lambda s: F.transform(F.split(s, lx.FIELD_SPLIT), lambda p: F.struct(tx.field_of(p).alias("field"), s.alias("sentence")))))

    def first_of_field(known: Column) -> Column:
        return tx.let(F.transform(known, lambda e: e["field"]), lambda names: F.filter(known, lambda e, i: F.array_position(names, e["field"]) == i + 1))

    return tx.let(F.filter(each, lambda e: e["field"] != lx.UNKNOWN_FIELD), first_of_field)


def fields(edu: Column, description: Column, title: Column) -> Column:
    """struct<found, origin, accepts_equivalent>; found is array<struct<field, sentence>>."""
    equivalent = F.lit(False)
    for x in (edu, description, title):
        equivalent = equivalent | F.coalesce(x.rlike(lx.EQUIVALENT), F.lit(False))
    of = lambda x: _fields_of(F.coalesce(x, F.lit("")))
    made = lambda found, origin: F.struct(found.alias("found"), origin.alias("origin"), equivalent.alias("accepts_equivalent"))
    prose = lambda found: made(found, F.when(F.size(found) > 0, "INFERRED").otherwise("MISSING"))
    later = tx.let(of(description), lambda b: F.when(F.size(b) > 0, prose(b)).otherwise(tx.let(of(title), prose)))
    return tx.let(of(edu), lambda a: F.when(F.size(a) > 0, made(a, F.lit("EXPLICIT"))).otherwise(later))


def mandatory_nearby(corpus: Column, pattern: str) -> Column:
    """Whether a mandatory word stands within 130 characters before or 90 after the first match."""
    at, size = F.regexp_instr(corpus, F.lit(pattern)), F.length(F.regexp_substr(corpus, F.lit(pattern)))
    begin = F.greatest(F.lit(1), at - 130)
    return F.substring(corpus, begin, at - begin).rlike(lx.MANDATORY) | F.substring(corpus, at + size, F.lit(90)).rlike(lx.MANDATORY)


def experience(edu: Column, description: Column, title: Column, low: Column, high: Column, said: Column | None = None) -> Column:
    """struct<min, max, stated, mandatory, raw, evidence, origin, implied_senior>: the first of eight
    tiers that applies.  ``said`` is what this gave for the texts alone, if that is known."""
    corpus = F.concat_ws("\n", edu, description, title)
    n = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")

    def tier(least: Column, most: Column, mandatory: Column, raw: Column, ev: Column, origin: str = "INFERRED", stated: bool = True) -> Column:
        return F.struct(
            least.cast("double").alias("min"), most.cast("double").alias("max"), F.lit(stated).alias("stated"), mandatory.alias("mandatory"),
            raw.alias("raw"), ev.alias("evidence"), F.lit(origin).alias("origin"), F.lit(not stated and origin == "INFERRED").alias("implied_senior"),
        )

    given = F.concat(n(F.coalesce(low, F.lit(0.0))), F.coalesce(F.concat(F.lit("-"), n(high)), F.lit("+")), F.lit(" years"))
    out = F.when(low.isNotNull() | high.isNotNull(), tier(F.coalesce(low, F.lit(0.0)), high, F.lit(True), given, F.concat(F.lit("ATS structured experience: "), given), "EXPLICIT"))
    if said is not None:
        return out.otherwise(said)
    no, none = F.lit(False), _none("double")

    def prose(pattern: str, least: Column, most: Column, mandatory: Column) -> tuple[Column, Column]:
        return corpus.rlike(pattern), tier(least, most, mandatory, F.regexp_substr(corpus, F.lit(pattern)), tx.evidence(corpus, pattern))

    g = lambda name, k=1: F.regexp_extract(corpus, lx.EXPERIENCE[name], k).try_cast("double")
    e = lx.EXPERIENCE
    for test, made in (
        prose(lx.FRESHER, F.lit(0.0), F.lit(0.0), no),
        prose(e["range"], F.least(g("range"), g("range", 2)), F.greatest(g("range"), g("range", 2)), mandatory_nearby(corpus, e["range"])),
        prose(e["plus"], g("plus"), none, F.lit(True)),
        prose(e["at_least"], g("at_least"), none, F.lit(True)),
        prose(e["up_to"], F.lit(0.0), g("up_to"), no),
        prose(e["bare"], g("bare"), none, mandatory_nearby(corpus, e["bare"])),
    ):
        out = out.when(test, made)
    senior = F.concat(F.lit('Title contains a seniority marker ("'), F.regexp_substr(title, F.lit(lx.SENIORITY)), F.lit('") but no experience requirement is stated.'))
    out = out.when(title.rlike(lx.SENIORITY), tier(none, none, no, _none("string"), senior, stated=False))
    return out.otherwise(tier(none, none, no, _none("string"), _none("string"), "MISSING", False))


def graduation(corpus: Column, as_of: Column) -> Column:
    """struct<min, max, stated, raw, evidence>: batch year, range, before, or earlier; years from
    2000 to ten after ``as_of``."""
    last = F.year(as_of) + 10
    g = lambda name, k: F.regexp_extract(corpus, lx.GRADUATION[name], k).try_cast("int")
    none = _none("int")

    def tier(name: str, least: Column, most: Column) -> Column:
        p = lx.GRADUATION[name]
        return F.struct(least.alias("min"), most.alias("max"), F.lit(True).alias("stated"), F.regexp_substr(corpus, F.lit(p)).alias("raw"), tx.evidence(corpus, p).alias("evidence"))

    batch = F.coalesce(g("batch", 1), g("batch", 2))
    a, b, before = g("range", 1), g("range", 2), g("before", 1)
    return (
        F.when(batch.between(2000, last), tier("batch", batch, batch))
        .when((a >= 2000) & (b <= last), tier("range", F.least(a, b), F.greatest(a, b)))
        .when(before.between(2000, last), tier("before", none, before))
        .when(g("earlier", 1).isNotNull(), tier("earlier", none, g("earlier", 1)))
        .otherwise(F.struct(none.alias("min"), none.alias("max"), F.lit(False).alias("stated"), _none("string").alias("raw"), _none("string").alias("evidence")))
    )


def skills(requirements_text: Column, description: Column) -> Column:
    """struct<required, preferred, required_raw>: a fold over statements in order.  A preferred
    mention takes a skill off the required list; a later mandatory one puts it back."""
    texts = "array<string>"

    def events(text: Column, mandatory: bool) -> Column:
        def of(s: Column) -> Column:
            kind = F.when(s.rlike(lx.PREFERRED), "preferred").when(F.lit(mandatory) | s.rlike(lx.MANDATORY), "required").otherwise("mentioned")
            return F.transform(tx.skills_in(s), lambda k: F.struct(k.alias("skill"), kind.alias("kind"), s.alias("sentence")))

        return F.flatten(F.transform(tx.statements(F.coalesce(text, F.lit("")), 0), of))

    start = F.struct(F.array().cast(texts).alias("required"), F.array().cast(texts).alias("preferred"), F.array().cast(texts).alias("required_raw"))

    def step(acc: Column, e: Column) -> Column:
        one, said = F.array(e["skill"]), F.array(e["sentence"])
        preferred, required = e["kind"] == "preferred", e["kind"] == "required"
        return F.struct(
            F.when(preferred, F.array_except(acc["required"], one)).when(required, F.array_union(acc["required"], one)).otherwise(acc["required"]).alias("required"),
            F.when(preferred, F.array_union(acc["preferred"], one)).otherwise(acc["preferred"]).alias("preferred"),
            F.when(required, F.array_union(acc["required_raw"], said)).otherwise(acc["required_raw"]).alias("required_raw"),
        )

    folded = F.aggregate(F.concat(events(requirements_text, True), events(description, False)), start, step)
    return F.struct(folded["required"].alias("required"), folded["preferred"].alias("preferred"), F.slice(folded["required_raw"], 1, 12).alias("required_raw"))


def certifications(corpus: Column) -> Column:
    return F.array_compact(F.array(*[F.when(corpus.rlike(p), label) for label, p in lx.CERTIFICATIONS]))


def work_authorization(corpus: Column) -> Column:
    """Null if nothing is said; else the labels that apply, perhaps none."""
    return F.when(corpus.rlike(lx.WORK_AUTH_GATE), F.array_compact(F.array(*[F.when(corpus.rlike(p), label) for label, p in lx.WORK_AUTH_LABELS])))


def location(corpus: Column, stated: Column) -> Column:
    """struct<locations, restricted, relocation, raw, evidence, origin>."""
    relocation = corpus.rlike(lx.RELOCATION)
    based = F.nullif(tx.collapse(F.regexp_extract(corpus, lx.BASED_IN, 1)), F.lit(""))
    places = F.array_distinct(F.array_compact(F.array(stated, based)))
    ev = F.when(relocation, tx.evidence(corpus, lx.RELOCATION)).when(based.isNotNull(), tx.evidence(corpus, lx.BASED_IN)).otherwise(stated)
    origin = F.when(based.isNotNull(), "INFERRED").when(stated.isNotNull(), "EXPLICIT").otherwise("MISSING")
    return F.struct(places.alias("locations"), (relocation | corpus.rlike(lx.LOCATION_RESTRICTED)).alias("restricted"), relocation.alias("relocation"), F.coalesce(stated, F.get(places, 0)).alias("raw"), ev.alias("evidence"), origin.alias("origin"))


def _placed(said: Column, stated: Column) -> Column:
    """``location`` of a posting, given what it gave for the texts alone."""
    based = F.get(said["locations"], 0)
    origin = F.when(based.isNotNull(), "INFERRED").when(stated.isNotNull(), "EXPLICIT").otherwise("MISSING")
    places = F.array_distinct(F.array_compact(F.array(stated, based)))
    return F.struct(places.alias("locations"), said["restricted"].alias("restricted"), said["relocation"].alias("relocation"), F.coalesce(stated, based).alias("raw"), F.coalesce(said["evidence"], stated).alias("evidence"), origin.alias("origin"))


def extract(postings: DataFrame, as_of: Column) -> DataFrame:
    """``postings`` with ``requirements`` appended.

    Reads title, description, education_requirement, experience_min, experience_max, location and
    requirements_text; a column that isn't there counts as null.  Texts are read once for all
    postings that share them (title, description, education and requirements); what a posting
    states in columns is added to each row.
    """
    text = lambda c: F.nullif(tx.collapse(F.col(c)), F.lit("")) if c in postings.columns else _none("string")
    number = lambda c: F.col(c).cast("double") if c in postings.columns else _none("double")
    texts = ["_title", "_desc", "_edu", "_req"]
    rows = postings.withColumns({"_title": text("title"), "_desc": text("description"), "_edu": text("education_requirement"), "_req": text("requirements_text"), "_loc": text("location")})
    title, desc, edu, corpus = (F.col(c) for c in ("_title", "_desc", "_edu", "_corpus"))
    # parts stand in columns of their own, so that each expression is evaluated once
    read = rows.select(*texts).distinct().withColumn("_corpus", F.concat_ws("\n", "_edu", "_req", "_desc", "_title"))
    read = read.select(
        *[F.col(c).alias(f"_of{c}") for c in texts], degree(edu, desc).alias("_degree"), fields(edu, desc, title).alias("_fields"), experience(edu, desc, F.coalesce(title, F.lit("")), _none("double"), _none("double")).alias("_exp_said"),
        graduation(corpus, as_of).alias("_grad"), skills(F.col("_req"), desc).alias("_skills"), location(corpus, _none("string")).alias("_place_said"), certifications(corpus).alias("_certs"), work_authorization(corpus).alias("_auth"),
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in texts])
    parts = rows.join(read, same).withColumns({
        "_exp": experience(edu, desc, title, number("experience_min"), number("experience_max"), F.col("_exp_said")), "_place": _placed(F.col("_place_said"), F.col("_loc")),
    })
    names = F.transform("_fields.found", lambda e: e["field"])
    raw = F.array_join(F.transform("_fields.found", lambda e: e["sentence"]), "; ")
    gaps = F.array_compact(F.array(
        F.when(F.col("_degree.level") == "UNKNOWN", lx.GAPS["degree"]), F.when(F.size("_fields.found") == 0, lx.GAPS["field"]),
        F.when(F.col("_exp.implied_senior"), lx.GAPS["senior"]), F.when(F.size("_place.locations") == 0, lx.GAPS["location"]),
    ))
    said = F.when(F.col("_grad.stated"), "INFERRED").otherwise("MISSING")
    keys = {
        "DEGREE_LEVEL": (F.col("_degree.origin"), F.col("_degree.evidence")), "FIELD": (F.col("_fields.origin"), F.nullif(raw, F.lit(""))), "EXPERIENCE": (F.col("_exp.origin"), F.col("_exp.evidence")),
        "GRADUATION_YEAR": (said, F.col("_grad.evidence")), "LOCATION": (F.col("_place.origin"), F.col("_place.evidence")),
    }
    names_of = F.array(*[F.lit(k) for k in keys])
    origins = F.map_from_arrays(names_of, F.array(*[o for o, _ in keys.values()]))
    quotes = F.map_filter(F.map_from_arrays(names_of, F.array(*[e for _, e in keys.values()])), lambda k, v: v.isNotNull())
    made = F.struct(
        F.col("_degree.level").alias("degree_level"), edu.alias("degree_level_raw"), names.alias("fields"), raw.alias("fields_raw"), F.col("_fields.accepts_equivalent"),
        F.col("_exp.min").alias("experience_min"), F.col("_exp.max").alias("experience_max"), F.col("_exp.stated").alias("experience_stated"), F.col("_exp.mandatory").alias("experience_mandatory"), F.col("_exp.raw").alias("experience_raw"),
        F.col("_grad.min").alias("grad_year_min"), F.col("_grad.max").alias("grad_year_max"), F.col("_grad.stated").alias("grad_year_stated"), F.col("_grad.raw").alias("grad_year_raw"),
        F.col("_skills.required").alias("skills_required"), F.col("_skills.preferred").alias("skills_preferred"), F.col("_skills.required_raw").alias("skills_required_raw"), F.col("_certs").alias("certifications"),
        F.col("_place.locations").alias("locations"), F.col("_place.restricted").alias("location_restricted"), F.col("_place.raw").alias("location_raw"), F.col("_place.relocation").alias("requires_relocation"),
        F.col("_auth").alias("work_authorization"), origins.alias("origin"), quotes.alias("evidence"), gaps.alias("gaps"),
    )
    return parts.withColumn("requirements", made).select(*[c for c in postings.columns if c != "requirements"], "requirements")


def audit_rows(jobs: DataFrame) -> DataFrame:
    """One row per posting, type and normalised value: job_id, type, value, normalized_value, origin."""
    r = F.col("requirements")

    def rows(kind: str, values: Column, key: str | None) -> Column:
        origin = F.try_element_at(r["origin"], F.lit(key)) if key else F.lit("INFERRED")
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), tx.comparable(v).alias("normalized_value"), origin.alias("origin")))

    known = F.filter(F.array(r["degree_level"]), lambda x: x != "UNKNOWN")
    stated = F.array_compact(F.array(r["experience_raw"]))
    every = F.concat(
        rows("DEGREE", known, "DEGREE_LEVEL"), rows("FIELD", r["fields"], "FIELD"), rows("EXPERIENCE", stated, "EXPERIENCE"),
        rows("SKILL", F.concat(r["skills_required"], r["skills_preferred"]), None), rows("CERTIFICATION", r["certifications"], None),
        rows("LOCATION", r["locations"], "LOCATION"), rows("WORK_AUTH", F.coalesce(r["work_authorization"], F.array().cast("array<string>")), None), rows("GAP", r["gaps"], None),
    )
    exploded = jobs.select(F.col("id").alias("job_id"), F.posexplode(every).alias("_at", "_row")).select("job_id", "_at", "_row.*")
    return exploded.groupBy("job_id", "type", "normalized_value").agg(F.max_by("value", "_at").alias("value"), F.max_by("origin", "_at").alias("origin"))
