"""DuckDB text of the checks' outcomes, details and lists, for the queries that return them.

Each check is a ladder of (condition, outcome, detail, lists) over the columns of ``ranked`` in
``verdicts``; the conditions are those of its ``checks``, written out in order.
"""

from __future__ import annotations

from .. import lexicons as lx
from .fixtures import repr_sql
from .texts import _re2

LISTS = ("matched", "missing", "concerns", "unknown")


def _case(key: str, table: dict[str, str], default: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {repr_sql(k)} THEN {repr_sql(v)}" for k, v in table.items()) + f" ELSE {default} END)"


def _degree(key: str) -> str:
    return _case(key, lx.DEGREE_LABELS, "'Unspecified degree level'")


def _field(key: str) -> str:
    return _case(key, {f[0]: f[1] for f in lx.FIELDS}, repr_sql(lx.UNKNOWN_FIELD_LABEL))


def _skills(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda s: {_skill('s')}), ', ')"


def _skill(key: str) -> str:
    return _case(key, {s[0]: s[1] for s in lx.SKILLS}, key)


def _said(template: str, *args: str) -> str:
    """The template's text with its %s filled, as a concatenation."""
    parts = template.split("%s")
    out = [repr_sql(parts[0])]
    for arg, rest in zip(args, parts[1:], strict=True):
        out += [f"coalesce(CAST({arg} AS VARCHAR), 'null')", repr_sql(rest)]
    return "(" + " || ".join(x for x in out if x != "''") + ")"


def _whole(c: str) -> str:
    return f"CAST(CAST({c} AS INT) AS VARCHAR)"


def _texts(*items: str) -> str:
    return f"[{', '.join(items)}]"


def _ladder(*rungs: tuple) -> str:
    """CASE over (condition, outcome, detail, lists); the last condition may be None."""
    out = []
    for test, outcome, detail, lists in rungs:
        parts = ", ".join(f"'{name}': CAST({lists.get(name, '[]')} AS VARCHAR[])" for name in LISTS)
        made = f"{{'outcome': {outcome if outcome.startswith('CASE') else repr_sql(outcome)}, 'detail': {detail}, {parts}}}"
        out.append(f"WHEN {test} THEN {made}" if test else f"ELSE {made}")
    return "CASE " + " ".join(out) + " END"


def _readable() -> str:
    return _ladder(("NOT (length(description) > 120 OR experience_stated)", "UNKNOWN", repr_sql("The posting content could not be read in full, so requirements could not be verified. Open the original posting to confirm."), {"unknown": _texts(repr_sql("Posting text was not retrievable or was too short to extract requirements from."))}))


def _degree_check() -> str:
    label, own = _degree("degree_level"), _degree("level")
    return _ladder(
        ("degree_level IN ('UNKNOWN', 'ANY')", "UNKNOWN", repr_sql("The posting does not state a required degree level."), {"unknown": _texts(repr_sql("Required degree level is not specified in the posting."))}),
        ("need_rank > own_rank", "MISMATCH", _said("Requires %s; your profile is %s.", label, own), {"missing": _texts(_said("%s required", label))}),
        (None, "MATCH", _said("Requires %s; you have %s.", label, own), {"matched": _texts(_said("%s requirement satisfied", label))}),
    )


#: The best of a posting's fields for the profile's: the highest score, of equals the first.
_STRENGTH = "(CASE WHEN field = 'UNKNOWN_FIELD' THEN 'NONE' ELSE " + _case("field || '>' || j", {f"{u}>{j}": s for u, j, s, _ in lx.RELATIONS}, "'NONE'") + " END)"
_WHY = "(CASE WHEN field = 'UNKNOWN_FIELD' THEN 'Your branch could not be mapped to a known field.' ELSE " + _case("field || '>' || j", {f"{u}>{j}": w for u, j, _, w in lx.RELATIONS}, _said("%s is not recognised as equivalent to %s.", _field("field"), _field("j"))) + " END)"
_SCORE = "(CASE " + _STRENGTH + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.RELATION_SCORES.items()) + " END)"
RELATED = f"related AS (SELECT *, list_reverse_sort(list_transform(asked, lambda j, i: {{'score': {_SCORE}, 'at': -i, 'field': j, 'strength': {_STRENGTH}, 'why': {_WHY}}}))[1] AS rel FROM ranked)"


def _field_check() -> str:
    own, asked = _field("field"), f"array_to_string(list_transform(asked, lambda j: {_field('j')}), ' or ')"
    review = "The posting does not state that equivalent disciplines are accepted, so this needs human review."
    return _ladder(
        ("len(asked) = 0", "UNKNOWN", repr_sql("The posting does not name a required field or major."), {"unknown": _texts(repr_sql("Required field of study is not specified in the posting."))}),
        ("list_contains(asked, field) AND len(asked) = 1 AND field IN ('GENERAL_ENGINEERING', 'TECHNOLOGY_GENERIC')", "MATCH", _said("The posting asks for a general engineering degree; your %s qualifies.", own), {"matched": _texts(_said("%s degree matches", own))}),
        ("list_contains(asked, field)", "MATCH", _said("%s matches the required field.", own), {"matched": _texts(_said("%s degree matches", own))}),
        ("rel.strength IN ('EQUIVALENT', 'STRONG')", "MATCH", _said("The posting asks for %s. %s", asked, "rel.why"), {"matched": _texts(_said("%s satisfies the required field", own))}),
        ("rel.strength = 'ADJACENT'", "UNKNOWN", _said(f"The posting requires %s. %s {review}", asked, "rel.why"), {"concerns": _texts(_said("Adjacent field: %s vs required %s", own, "rel.field")), "unknown": _texts(repr_sql("Field of study is related but not identical to the stated requirement."))}),
        ("rel.strength = 'WEAK'", "UNKNOWN", _said("The posting requires %s. %s This is a borderline case that needs human review.", asked, "rel.why"), {"concerns": _texts(_said("Weakly related field: %s vs required %s", own, "rel.field"))}),
        (None, "MISMATCH", _said("The posting requires %s; your degree is %s. %s", asked, own, "rel.why"), {"missing": _texts(_said("Requires %s", asked))}),
    )


def _experience_check() -> str:
    low, high, years = _whole("experience_min"), _whole("experience_max"), _whole("years")
    band = f"({low} || coalesce('–' || {high}, '+'))"
    floor = "experience_stated AND experience_min IS NOT NULL"
    satisfied, no_minimum = _texts(_said("Experience requirement (%s yrs) satisfied", band)), _texts(repr_sql("No minimum experience requirement stated"))
    return _ladder(
        (f"{floor} AND years >= experience_min AND years > experience_max + 1", "PARTIAL", _said("Posting targets %s years and you have %s. You are more experienced than the band; some employers treat over-qualification as a fit risk, but it is not a disqualification.", band, years), {"matched": satisfied, "concerns": _texts(repr_sql("You appear more senior than the advertised band."))}),
        (f"{floor} AND years >= experience_min", "MATCH", _said("Posting requires %s years and you have %s.", band, years), {"matched": satisfied}),
        (f"{floor} AND experience_min - years <= 1 AND welcome", "UNKNOWN", _said("Posting states a minimum of %s year(s) but also explicitly welcomes freshers, recent graduates or final-year students. You have %s. Whether the hard minimum is waived is not stated, so this needs a human decision.", low, years),
         {"concerns": _texts(_said("Short by %s year(s), but the posting welcomes graduates.", _whole("experience_min - years"))), "unknown": _texts(repr_sql("The posting sets a minimum experience yet also targets freshers; the waiver policy is not stated."))}),
        (floor, "MISMATCH", _said("Requires a minimum of %s year(s) of experience; you have %s.", low, years), {"missing": _texts(_said("Minimum %s year(s) of experience", low))}),
        ("experience_stated AND experience_max IS NOT NULL", "MATCH", _said("Posting caps experience at %s year(s) and sets no minimum; you have %s.", high, years), {"matched": no_minimum}),
        ("NOT experience_stated AND experience_min IS NULL", "MATCH", repr_sql("The posting does not gate this role on years of experience."), {"matched": no_minimum}),
        (None, "UNKNOWN", repr_sql("The experience requirement could not be interpreted reliably."), {"unknown": _texts(repr_sql("Experience requirement could not be parsed."))}),
    )


def _graduation_check() -> str:
    early, late = _said("Posting targets candidates graduating in %s; you graduated in %s.", "grad_year_min", "y"), _said("Posting requires graduation by %s; you graduated in %s.", "grad_year_max", "y")
    detail = f"(CASE WHEN y < grad_year_min THEN {early} ELSE {late} END)"
    return _ladder(
        ("NOT grad_year_stated", "MATCH", repr_sql("The posting does not restrict candidates to a specific graduation batch."), {}),
        ("coalesce(in_years, false)", "MATCH", _said("Posting targets the %s batch and you are a %s graduate.", "grad_year_raw", "y"), {"matched": _texts(_said("Graduation year %s matches the posting", "y"))}),
        (f"regexp_matches(grad_year_raw, {_re2(lx.BATCH_GATE)})", "MISMATCH", detail, {"missing": _texts(_said("Graduation batch %s", "grad_year_raw"))}),
        (None, "UNKNOWN", f"{detail} || ' The posting does not say whether earlier graduates are accepted.'", {"unknown": _texts(repr_sql("Graduation year requirement is ambiguous for candidates outside the stated batch."))}),
    )


def _skill_check() -> str:
    like = "list_filter(string_split(skills_preferred_list, ';'), lambda s: s <> '')"
    have = lambda xs, has: f"list_filter({xs}, lambda s: {'' if has else 'NOT '}list_contains(own, s))"
    got, miss, got_p, miss_p = have("need", True), have("need", False), have(like, True), have(like, False)
    text = (
        f"concat_ws(' | ', CASE WHEN len(need) > 0 THEN 'Required skills matched: ' || hit || '/' || len(need) || CASE WHEN hit > 0 THEN ' (' || {_skills(got)} || ')' ELSE '' END END, CASE WHEN hit < len(need) THEN 'Required skills missing: ' || {_skills(miss)} END,"
        f" CASE WHEN len({like}) > 0 THEN 'Preferred skills matched: ' || len({got_p}) || '/' || len({like}) END, CASE WHEN len({miss_p}) > 0 THEN 'Preferred skills missing: ' || {_skills(miss_p)} END)"
    )
    each = lambda head, xs: f"list_transform({xs}, lambda s: {repr_sql(head)} || {_skill('s')})"
    lists = {"matched": each("Skill matched: ", got), "missing": each("Skill not in profile: ", miss), "concerns": each("Preferred skill not in profile: ", miss_p)}
    return _ladder(
        ("unlisted", "UNKNOWN", repr_sql("The posting does not list specific skills."), {"unknown": _texts(repr_sql("No explicit skill list in the posting."))}),
        ("len(need) >= 3 AND hit < 0.5 * len(need)", "UNKNOWN", f"{text} || {repr_sql('. Most of the required skills are not in your profile, so this needs a manual read before you spend time on it.')}", {**lists, "unknown": _texts(repr_sql("A majority of the required skills are absent from your profile."))}),
        (None, "CASE WHEN hit < len(need) THEN 'PARTIAL' ELSE 'MATCH' END", text, lists),
    )


def _location_check() -> str:
    near = "preferred_list <> '' AND len(list_filter(string_split(preferred_list, ';'), lambda p: contains(lower(place), lower(p)) OR contains(lower(p), lower(place)))) > 0"
    away = "LOCATION DIFFERENT -- the role is in %s, which is not in your preferred locations."
    ending = f"CASE WHEN willing THEN {repr_sql(' You have indicated you are willing to relocate, so this does not disqualify the application.')} ELSE {repr_sql(' Location alone never makes a job ineligible.')} END"
    return _ladder(
        (f"regexp_matches(place, {_re2(lx.REMOTE_WORDS)})", "MATCH", _said('Listed as "%s" -- remote or location-flexible.', "place"), {"matched": _texts(repr_sql("Remote / location-flexible"))}),
        (near, "MATCH", _said("LOCATION MATCH -- %s is in your preferred locations.", "place"), {"matched": _texts(repr_sql("Location matches your preferences"))}),
        ("location_restricted AND NOT willing", "MISMATCH", _said("The posting requires the candidate to be based in a specific location (%s) and your profile says you are not willing to relocate.", "place"), {"missing": _texts(_said("Must be based in %s", "place"))}),
        (None, "CASE WHEN willing THEN 'MATCH' ELSE 'PARTIAL' END", f"{_said(away, 'place')} || {ending}", {"concerns": _texts(_said("Location differs from your preferences: %s", "place"))}),
    )


def _work_check() -> str:
    listed, own = "array_to_string(auth, ', ')", "array_to_string(mine, ', ')"
    met = "len(list_filter(auth, lambda n: len(list_filter(mine, lambda m: contains(lower(n), lower(m)) OR contains(lower(m), lower(n)))) > 0)) = len(auth)"
    stated = _said("Requires %s; your profile states %s.", listed, own)
    return _ladder(
        ("auth IS NULL", "MATCH", repr_sql("The posting does not state a work-authorization or citizenship requirement."), {}),
        (met, "MATCH", stated, {"matched": _texts(repr_sql("Work authorization requirement satisfied"))}),
        ("len(mine) = 0", "UNKNOWN", _said("The posting requires %s but your profile does not state your work authorization, so this cannot be decided.", listed), {"unknown": _texts(repr_sql("Your work authorization is not filled in on your profile, and this posting requires it."))}),
        (None, "MISMATCH", stated, {"missing": _texts(_said("Requires %s", listed))}),
    )


def _certification_check() -> str:
    need = "string_split(certification_list, ';')"
    missing = f"list_filter({need}, lambda c: len(list_filter(own, lambda m: contains(lower(m), lower(c)))) = 0)"
    listed = f"array_to_string({need}, ', ')"
    return _ladder(
        ("certification_list = ''", "MATCH", repr_sql("The posting does not name a required certification."), {}),
        (f"len({missing}) = 0", "MATCH", _said("Required certifications (%s) appear in your profile.", listed), {"matched": _texts(repr_sql("Certification requirements satisfied"))}),
        (None, "UNKNOWN", _said("The posting mentions %s, which is not listed in your profile. Confirm whether it is mandatory.", listed), {"concerns": _texts(_said("Certification not in profile: %s", f"array_to_string({missing}, ', ')")), "unknown": _texts(repr_sql("Posting mentions certifications that are not in your profile."))}),
    )


_ALL = ", ".join(f"({made})" for made in (_readable(), _degree_check(), _field_check(), _experience_check(), _graduation_check(), _skill_check(), _location_check(), _work_check(), _certification_check()))
_LINES = " || ".join(f"list_transform(list_filter(told, lambda c: c.outcome = '{o}'), lambda c: '{lx.OUTCOME_ICONS[o]} ' || c.detail)" for o in lx.OUTCOME_ORDER)
_JOINED = ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list_transform(told, lambda c: c.{name})))), '|') AS {name}" for name in LISTS)

#: CTEs after ``ranked`` and ``judged``: told has a line for each pair with its checks, texts its explanation and lists.
TEXTS = (
    RELATED,
    f"told AS (SELECT id, user_id, list_filter([{_ALL}], lambda c: c IS NOT NULL) AS told FROM related)",
    f"texts AS (SELECT t.id, t.user_id, j.verdict, {_case('j.verdict', lx.VERDICT_HEADS, repr_sql(''))} || chr(10) || array_to_string({_LINES}, chr(10)) AS explanation, {_JOINED} FROM told t JOIN judged j ON j.id = t.id AND j.user_id = t.user_id)",
)
