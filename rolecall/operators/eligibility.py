"""Eligibility: requirements and a profile in one row give checks, verdict, scores and reasons.

Input columns: the requirement fields (as ``extract`` names them), the posting's title,
description and location, and the profile's degree, branch, graduation_year,
years_of_experience, skills (canonical), preferred_locations, work_authorization,
``own_certifications``, willing_to_relocate, own_field and own_level (as ``pair`` finds them).  Verdicts come from mandatory checks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..storage import written


def _texts(*items: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items]).cast("array<string>")


def _check(factor: str, label: str, outcome: Column | str, mandatory: Column | bool, detail: Column | str, matched: Column | None = None, missing: Column | None = None, concerns: Column | None = None, unknown: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    empty = F.array().cast("array<string>")
    lists = {"matched": matched, "missing": missing, "concerns": concerns, "unknown": unknown}
    return F.struct(F.lit(factor).alias("factor"), F.lit(label).alias("label"), lit(outcome).alias("outcome"), lit(mandatory).alias("mandatory"), lit(detail).alias("detail"), *[(v if v is not None else empty).alias(k) for k, v in lists.items()])


def _n(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _f(template: str, *args: Column) -> Column:
    return F.format_string(template, *args)


def readable() -> Column:
    """Mandatory UNKNOWN if the posting can't be read; null if it can."""
    explicit = F.lit(False)
    for key in ("DEGREE_LEVEL", "FIELD"):
        explicit = explicit | F.coalesce(F.try_element_at(F.col("origin"), F.lit(key)) == "EXPLICIT", F.lit(False))
    ok = (F.length(F.coalesce("description", F.lit(""))) > 120) | explicit | F.col("experience_stated")
    return F.when(~ok, _check("OTHER", "Posting content", "UNKNOWN", True, "The posting content could not be read in full, so requirements could not be verified. Open the original posting to confirm.", unknown=_texts("Posting text was not retrievable or was too short to extract requirements from.")))


def degree_check() -> Column:
    check = lambda *a, **k: _check("DEGREE_LEVEL", "Degree level", *a, **k)
    mine, asked = F.col("own_level"), F.col("degree_level")
    label, own = tx.degree_label(asked), tx.degree_label(mine)
    return (
        F.when(asked.isin("UNKNOWN", "ANY"), check("UNKNOWN", False, "The posting does not state a required degree level.", unknown=_texts("Required degree level is not specified in the posting.")))
        .when(tx.degree_rank(asked) > tx.degree_rank(mine), check("MISMATCH", True, _f("Requires %s; your profile is %s.", label, own), missing=_texts(_f("%s required", label))))
        .otherwise(check("MATCH", True, _f("Requires %s; you have %s.", label, own), matched=_texts(_f("%s requirement satisfied", label))))
    )


def _relation(mine: Column, asked: Column) -> Column:
    """struct<strength, score, why> of the profile's field and one of the posting's."""
    table = tx.constant({f"{u}>{j}": {"strength": s, "score": lx.RELATION_SCORES[s], "why": w} for u, j, s, w in lx.RELATIONS}, "map<string,struct<strength: string, score: int, why: string>>")
    made = lambda s, w: F.struct(F.lit(s).alias("strength"), F.lit(lx.RELATION_SCORES[s]).alias("score"), w.alias("why"))
    return (
        F.when(mine == lx.UNKNOWN_FIELD, made("NONE", F.lit("Your branch could not be mapped to a known field.")))
        .when(mine == asked, made("EQUIVALENT", _f("Exact match: the posting asks for %s and your degree is %s.", tx.field_label(asked), tx.field_label(mine))))
        .otherwise(F.coalesce(F.try_element_at(table, F.concat(mine, F.lit(">"), asked)), made("NONE", _f("%s is not recognised as equivalent to %s.", tx.field_label(mine), tx.field_label(asked)))))
    )


def field_check() -> Column:
    check = lambda *a, **k: _check("EDUCATION", "Field of study", *a, **k)
    mine, own = F.col("own_field"), tx.field_label(F.col("own_field"))
    asked = F.array_join(F.transform("fields", tx.field_label), " or ")
    related = F.transform("fields", lambda f, i: F.struct(_relation(mine, f)["score"].alias("score"), (-i).alias("order"), f.alias("field"), _relation(mine, f).alias("rel")))
    best = F.array_max(F.transform(related, lambda r: F.struct(r["score"].alias("score"), r["order"].alias("order"), r["field"].alias("field"), r["rel"]["strength"].alias("strength"), r["rel"]["why"].alias("why"))))
    strength, why = best["strength"], best["why"]
    generic = (F.size("fields") == 1) & mine.isin("GENERAL_ENGINEERING", "TECHNOLOGY_GENERIC")
    review = F.when(F.col("accepts_equivalent"), "The posting does accept equivalent disciplines, so this is likely fine but worth confirming with the recruiter.").otherwise("The posting does not state that equivalent disciplines are accepted, so this needs human review.")
    return (
        F.when(F.size("fields") == 0, check("UNKNOWN", False, "The posting does not name a required field or major.", unknown=_texts("Required field of study is not specified in the posting.")))
        .when(F.array_contains("fields", mine), check("MATCH", True, F.when(generic, _f("The posting asks for a general engineering degree; your %s qualifies.", own)).otherwise(_f("%s matches the required field.", own)), matched=_texts(_f("%s degree matches", own))))
        .when(strength.isin("EQUIVALENT", "STRONG"), check("MATCH", True, _f("The posting asks for %s. %s", asked, why), matched=_texts(_f("%s satisfies the required field", own))))
        .when(strength == "ADJACENT", check("UNKNOWN", True, _f("The posting requires %s. %s %s", asked, why, review), concerns=_texts(_f("Adjacent field: %s vs required %s", own, best["field"])), unknown=_texts("Field of study is related but not identical to the stated requirement.")))
        .when(strength == "WEAK", check("UNKNOWN", True, _f("The posting requires %s. %s This is a borderline case that needs human review.", asked, why), concerns=_texts(_f("Weakly related field: %s vs required %s", own, best["field"]))))
        .otherwise(check("MISMATCH", True, _f("The posting requires %s; your degree is %s. %s", asked, own, why), missing=_texts(_f("Requires %s", asked))))
    )


def experience_check() -> Column:
    check = lambda *a, **k: _check("EXPERIENCE", "Experience", *a, **k)
    years = F.coalesce("years_of_experience", F.lit(0.0))
    low, high, stated = F.col("experience_min"), F.col("experience_max"), F.col("experience_stated")
    band = F.concat(_n(low), F.coalesce(F.concat(F.lit("–"), _n(high)), F.lit("+")))
    corpus = F.concat_ws("\n", "title", F.coalesce("description", F.lit("")))
    welcome = corpus.rlike(lx.FRESHER_FRIENDLY) | F.col("title").rlike(lx.FRESHER_TITLE)
    floor, gap = stated & low.isNotNull(), low - years
    satisfied = _texts(_f("Experience requirement (%s yrs) satisfied", band))
    no_minimum = _texts("No minimum experience requirement stated")
    return (
        F.when(floor & (years >= low) & high.isNotNull() & (years > high + 1), check("PARTIAL", False, _f("Posting targets %s years and you have %s. You are more experienced than the band; some employers treat over-qualification as a fit risk, but it is not a disqualification.", band, _n(years)), matched=satisfied, concerns=_texts("You appear more senior than the advertised band.")))
        .when(floor & (years >= low), check("MATCH", True, _f("Posting requires %s years and you have %s.", band, _n(years)), matched=satisfied))
        .when(floor & (gap <= 1) & welcome, check("UNKNOWN", True, _f("Posting states a minimum of %s year(s) but also explicitly welcomes freshers, recent graduates or final-year students. You have %s. Whether the hard minimum is waived is not stated, so this needs a human decision.", _n(low), _n(years)), concerns=_texts(_f("Short by %s year(s), but the posting welcomes graduates.", _n(gap))), unknown=_texts("The posting sets a minimum experience yet also targets freshers; the waiver policy is not stated.")))
        .when(floor, check("MISMATCH", True, _f("Requires a minimum of %s year(s) of experience; you have %s.", _n(low), _n(years)), missing=_texts(_f("Minimum %s year(s) of experience", _n(low)))))
        .when(stated & high.isNotNull(), check("MATCH", False, _f("Posting caps experience at %s year(s) and sets no minimum; you have %s.", _n(high), _n(years)), matched=no_minimum))
        .when(~stated & low.isNull() & F.exists("gaps", lambda g: F.contains(g, F.lit("senior"))), check("UNKNOWN", True, "The job title implies a senior level but the posting does not state how many years of experience are required.", concerns=_texts("Seniority implied by the title with no stated experience requirement."), unknown=_texts("Experience requirement is not specified for a role whose title implies seniority.")))
        .when(~stated & low.isNull(), check("MATCH", False, "The posting does not gate this role on years of experience.", matched=no_minimum))
        .otherwise(check("UNKNOWN", False, "The experience requirement could not be interpreted reliably.", unknown=_texts("Experience requirement could not be parsed.")))
    )


def graduation_check() -> Column:
    check = lambda *a, **k: _check("GRADUATION_YEAR", "Graduation year", *a, **k)
    y, low, high, raw = F.col("graduation_year"), F.col("grad_year_min"), F.col("grad_year_max"), F.coalesce("grad_year_raw", F.lit(""))
    inside = F.coalesce((low.isNull() | (y >= low)) & (high.isNull() | (y <= high)), F.lit(False))
    detail = F.when(low.isNotNull() & (y < low), _f("Posting targets candidates graduating in %s; you graduated in %s.", low.cast("string"), y.cast("string"))).otherwise(_f("Posting requires graduation by %s; you graduated in %s.", high.cast("string"), y.cast("string")))
    return (
        F.when(~F.col("grad_year_stated"), check("MATCH", False, "The posting does not restrict candidates to a specific graduation batch."))
        .when(inside, check("MATCH", True, _f("Posting targets the %s batch and you are a %s graduate.", raw, y.cast("string")), matched=_texts(_f("Graduation year %s matches the posting", y.cast("string")))))
        .when(raw.rlike(lx.BATCH_GATE), check("MISMATCH", True, detail, missing=_texts(_f("Graduation batch %s", raw))))
        .otherwise(check("UNKNOWN", True, F.concat(detail, F.lit(" The posting does not say whether earlier graduates are accepted.")), unknown=_texts("Graduation year requirement is ambiguous for candidates outside the stated batch.")))
    )


def skill_check() -> Column:
    check = lambda *a, **k: _check("SKILLS", "Skills", *a, **k)
    have = F.transform("skills", F.upper)
    owns = lambda s: F.array_contains(have, F.upper(s))
    need, like = F.col("skills_required"), F.col("skills_preferred")
    hit, miss = F.filter(need, owns), F.filter(need, lambda s: ~owns(s))
    hit_p, miss_p = F.filter(like, owns), F.filter(like, lambda s: ~owns(s))
    labels = lambda xs: F.array_join(F.transform(xs, tx.skill_label), ", ")
    some = lambda xs: F.size(xs) > 0
    text = F.concat_ws(
        " | ",
        F.when(some(need), F.concat(_f("Required skills matched: %d/%d", F.size(hit), F.size(need)), F.when(some(hit), _f(" (%s)", labels(hit))).otherwise(""))),
        F.when(some(miss), _f("Required skills missing: %s", labels(miss))),
        F.when(some(like), _f("Preferred skills matched: %d/%d", F.size(hit_p), F.size(like))),
        F.when(some(miss_p), _f("Preferred skills missing: %s", labels(miss_p))),
    )
    lists = {
        "matched": F.transform(hit, lambda s: F.concat(F.lit("Skill matched: "), tx.skill_label(s))),
        "missing": F.transform(miss, lambda s: F.concat(F.lit("Skill not in profile: "), tx.skill_label(s))),
        "concerns": F.transform(miss_p, lambda s: F.concat(F.lit("Preferred skill not in profile: "), tx.skill_label(s))),
    }
    wide = (F.size(need) >= 3) & (F.size(hit) < 0.5 * F.size(need))
    return (
        F.when(~some(need) & ~some(like), check("UNKNOWN", False, "The posting does not list specific skills.", unknown=_texts("No explicit skill list in the posting.")))
        .when(wide, check("UNKNOWN", True, F.concat(text, F.lit(". Most of the required skills are not in your profile, so this needs a manual read before you spend time on it.")), unknown=_texts("A majority of the required skills are absent from your profile."), **lists))
        .otherwise(check(F.when(some(miss), "PARTIAL").otherwise("MATCH"), False, text, **lists))
    )


def location_check() -> Column:
    check = lambda *a, **k: _check("LOCATION", "Location", *a, **k)
    place = tx.collapse(F.coalesce("location", F.get("locations", 0), F.lit("")))
    low, relocate = F.lower(place), F.coalesce("willing_to_relocate", F.lit(False))
    preferred = F.exists("preferred_locations", lambda p: F.contains(low, F.lower(p)) | F.contains(F.lower(p), low))
    ending = F.when(relocate, " You have indicated you are willing to relocate, so this does not disqualify the application.").otherwise(" Location alone never makes a job ineligible.")
    return (
        F.when((place == "") & (F.size("locations") == 0), check("UNKNOWN", False, "The posting does not specify a location.", unknown=_texts("Job location is not specified in the posting.")))
        .when(place.rlike(lx.REMOTE_WORDS), check("MATCH", False, _f('Listed as "%s" -- remote or location-flexible.', place), matched=_texts("Remote / location-flexible")))
        .when(preferred, check("MATCH", False, _f("LOCATION MATCH -- %s is in your preferred locations.", place), matched=_texts("Location matches your preferences")))
        .when(F.col("location_restricted") & ~relocate, check("MISMATCH", True, _f("The posting requires the candidate to be based in a specific location (%s) and your profile says you are not willing to relocate.", place), missing=_texts(_f("Must be based in %s", place))))
        .otherwise(check(F.when(relocate, "MATCH").otherwise("PARTIAL"), False, F.concat(_f("LOCATION DIFFERENT -- the role is in %s, which is not in your preferred locations.", place), ending), concerns=_texts(_f("Location differs from your preferences: %s", place))))
    )


def work_check() -> Column:
    check = lambda *a, **k: _check("WORK_AUTHORIZATION", "Work authorization", *a, **k)
    need, mine = F.col("work_authorization"), F.transform("own_authorization", F.lower)
    listed, own = F.array_join(need, ", "), F.array_join("own_authorization", ", ")
    all_met = F.forall(need, lambda n: F.exists(mine, lambda m: F.contains(F.lower(n), m) | F.contains(m, F.lower(n))))
    return (
        F.when(need.isNull(), check("MATCH", False, "The posting does not state a work-authorization or citizenship requirement."))
        .when(all_met, check("MATCH", True, _f("Requires %s; your profile states %s.", listed, own), matched=_texts("Work authorization requirement satisfied")))
        .when(F.size(mine) == 0, check("UNKNOWN", True, _f("The posting requires %s but your profile does not state your work authorization, so this cannot be decided.", listed), unknown=_texts("Your work authorization is not filled in on your profile, and this posting requires it.")))
        .otherwise(check("MISMATCH", True, _f("Requires %s; your profile states %s.", listed, own), missing=_texts(_f("Requires %s", listed))))
    )


def certification_check() -> Column:
    check = lambda *a, **k: _check("OTHER", "Certifications", *a, **k)
    need, mine = F.col("certifications"), F.transform(F.concat("own_certifications", "skills"), F.lower)
    missing = F.filter(need, lambda c: ~F.exists(mine, lambda m: F.contains(m, F.lower(c))))
    listed = F.array_join(need, ", ")
    return (
        F.when(F.size(need) == 0, check("MATCH", False, "The posting does not name a required certification."))
        .when(F.size(missing) == 0, check("MATCH", True, _f("Required certifications (%s) appear in your profile.", listed), matched=_texts("Certification requirements satisfied")))
        .otherwise(check("UNKNOWN", True, _f("The posting mentions %s, which is not listed in your profile. Confirm whether it is mandatory.", listed), concerns=_texts(_f("Certification not in profile: %s", F.array_join(missing, ", "))), unknown=_texts("Posting mentions certifications that are not in your profile.")))
    )


CHECKS = {"readable": readable, "degree": degree_check, "field": field_check, "experience": experience_check, "graduation": graduation_check, "skills": skill_check, "location": location_check, "work": work_check, "certification": certification_check}


def with_checks(pairs: DataFrame) -> DataFrame:
    """Adds ``checks``: eight or nine of them, in a fixed order."""
    return pairs.withColumn("checks", F.array_compact(F.array(*[make() for make in CHECKS.values()])))


def decide(checks: Column) -> Column:
    """A mandatory MISMATCH, else a mandatory UNKNOWN, else ELIGIBLE."""
    has = lambda outcome: F.exists(checks, lambda c: c["mandatory"] & (c["outcome"] == outcome))
    return F.when(has("MISMATCH"), "INELIGIBLE").when(has("UNKNOWN"), "UNCERTAIN").otherwise("ELIGIBLE")


def scores(checks: Column) -> Column:
    """Mean outcome score of each factor group, rounded."""

    def mean(factors: tuple[str, ...], none: int) -> Column:
        points = F.transform(F.filter(checks, lambda c: c["factor"].isin(*factors)), lambda c: tx.lookup(c["outcome"], lx.OUTCOME_SCORES, F.lit(0)))
        total = F.aggregate(points, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(points) == 0, none).otherwise(F.round(total / F.size(points)).cast("int"))

    groups = {"education": (("EDUCATION", "DEGREE_LEVEL"), 0), "experience": (("EXPERIENCE",), 0), "skills": (("SKILLS",), 0), "location": (("LOCATION",), 100), "other": (("WORK_AUTHORIZATION", "OTHER"), 100)}
    return F.struct(*[mean(*g).alias(k) for k, g in groups.items()])


def match_score(s: Column) -> Column:
    """Weighted sum of the group scores; informational only."""
    total = sum((s[k] * F.lit(w) for k, w in lx.SCORE_WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(total).cast("int")))


def explanation(status: Column, checks: Column) -> Column:
    """A heading and one line for each check: mismatches, unknowns, partial, matches."""
    with_outcome = lambda o: F.filter(checks, lambda c: c["outcome"] == o)
    ordered = F.concat(*[with_outcome(o) for o in lx.OUTCOME_ORDER])
    lines = F.transform(ordered, lambda c: F.concat_ws(" ", tx.lookup(c["outcome"], lx.OUTCOME_ICONS, F.lit("")), c["detail"]))
    return F.concat_ws("\n", tx.lookup(status, lx.VERDICT_HEADS, F.lit("")), F.array_join(lines, "\n"))


def collected(checks: Column, name: str, first: Column | None = None) -> Column:
    """Distinct non-empty entries of one list of all checks, in order."""
    every = F.flatten(F.transform(checks, lambda c: c[name]))
    every = F.concat(first, every) if first is not None else every
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def analyse(pairs: DataFrame) -> DataFrame:
    """Adds checks, verdict, scores, match_score, the four lists and the explanation."""
    checked = with_checks(pairs)
    judged = checked.withColumns({"verdict": decide(F.col("checks")), "scores": scores(F.col("checks"))})
    return judged.withColumns({
        "match_score": match_score(F.col("scores")), "explanation": explanation(F.col("verdict"), F.col("checks")),
        "matched": collected(F.col("checks"), "matched"), "missing": collected(F.col("checks"), "missing"), "concerns": collected(F.col("checks"), "concerns"),
        "missing_information": collected(F.col("checks"), "unknown", F.col("gaps")),
    })


def pair(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each ACTIVE posting with its user's profile; the profile's skills are brought to ids.

    ``jobs`` has the requirement fields as columns.  What hangs on the profile alone (skills' ids,
    field of study, degree level) is found once for each profile and written, before the join by
    user; the planner broadcasts the profiles where they are small.
    """
    mine = profiles.select("user_id", "degree", "branch", "graduation_year", "years_of_experience", tx.canonical_skills(F.col("skills")).alias("skills"), "preferred_locations", F.col("work_authorization").alias("own_authorization"), F.col("certifications").alias("own_certifications"), "willing_to_relocate", tx.field_of(F.col("branch")).alias("own_field"), tx.degree_level(F.concat_ws(" ", "degree", "branch")).alias("own_level"))
    mine = written(mine, "profiles-read")
    return jobs.where("status = 'ACTIVE'").join(mine, "user_id")
