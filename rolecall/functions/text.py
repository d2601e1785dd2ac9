"""Text, date and lexicon expressions; each takes and gives Columns, native throughout."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is evaluated once, however often it is used; lambdas of array
    functions would evaluate an outer expression again for every element."""
    return F.get(F.transform(F.array(value), make), 0)


def _pattern(words: Sequence[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def collapse(c: Column) -> Column:
    """White space (any script's) collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparable(c: Column) -> Column:
    """Match key: lower case, everything but a-z and 0-9 as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def company_key(c: Column) -> Column:
    """Company name key; legal suffix words go from the end while a word is left."""
    s = F.regexp_replace(F.lower(F.trim(c)), "['`]", "")
    s = F.trim(F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    plain = [w for w in lx.LEGAL_SUFFIXES if w.isalnum()]
    return F.regexp_replace(s, f"^(.+?)( ({_pattern(plain)}))+$", "$1")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(120))


def tokens(c: Column) -> Column:
    """Words of two letters or more that are no stop words, in order."""
    stop = constant(list(lx.STOP_WORDS), "array<string>")
    return F.filter(F.split(comparable(c), " "), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def location_key(c: Column) -> Column:
    """Blocking key of a location; empty for null."""
    s = F.regexp_replace(comparable(c), rf"\b({_pattern(lx.LOCATION_WORDS)})\b", "")
    return F.coalesce(F.trim(F.regexp_replace(s, " +", " ")), F.lit(""))


def evidence(text: Column, pattern: str, pad: int = 90) -> Column:
    """The first match with ``pad`` characters on both sides, collapsed; null without a match."""
    found = F.regexp_substr(text, F.lit(pattern))
    at = F.regexp_instr(text, F.lit(pattern))
    begin = F.greatest(F.lit(1), at - pad)
    return collapse(F.substring(text, begin, at + F.length(found) + pad - begin))


def statements(c: Column, longer_than: int = 2) -> Column:
    """Sentences, lines and bullets of a text, collapsed."""
    parts = F.transform(F.split(c, lx.STATEMENT_SPLIT), collapse)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def page_text(html: Column) -> Column:
    """Text of a page: no scripts or styles, line ends for breaks and blocks, other tags as spaces."""
    s = F.regexp_replace(html, lx.PAGE_SCRIPT, " ")
    s = F.regexp_replace(s, lx.PAGE_STYLE, " ")
    s = F.regexp_replace(s, lx.PAGE_BREAK, "\n")
    s = F.regexp_replace(s, lx.PAGE_BLOCK_END, "\n")
    return F.regexp_replace(s, lx.PAGE_TAG, " ")


def group(c: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def job_date(c: Column, as_of: Column) -> Column:
    """Date of a job board's text, or null.  ``as_of`` stands for today; impossible dates are null."""
    s = collapse(c)
    months = constant(lx.MONTHS, "map<string,int>")

    def made(y: Column, m: Column, d: Column) -> Column:
        text = F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))

    number = lambda p, n: group(s, p, n).cast("int")
    ago = lx.DATE_FORMS["ago"]
    unit = F.lower(F.regexp_extract(s, ago, 2))
    days = number(ago, 1) * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(0)
    iso, numeric = lx.DATE_FORMS["iso"], lx.DATE_FORMS["numeric"]
    a, b = number(numeric, 1), number(numeric, 2)
    us = (b > 12) & (a <= 12)
    day_first, month_first, month_year = (lx.DATE_FORMS[k] for k in ("day_first", "month_first", "month_year"))
    month = lambda p, n: F.try_element_at(months, F.lower(F.regexp_extract(s, p, n)))
    epoch = group(s, lx.DATE_FORMS["epoch"], 1).cast("long")
    return F.coalesce(
        F.when(s.rlike(ago), F.date_sub(as_of, days)),
        F.when(s.rlike(lx.DATE_FORMS["now"]), as_of),
        made(group(s, iso, 1), number(iso, 2), number(iso, 3)),
        made(group(s, numeric, 3), F.when(us, a).otherwise(b), F.when(us, b).otherwise(a)),
        made(group(s, day_first, 3), month(day_first, 2), number(day_first, 1)),
        made(group(s, month_first, 3), month(month_first, 1), number(month_first, 2)),
        made(group(s, month_year, 2), month(month_year, 1), F.lit(1)),
        F.timestamp_seconds(epoch).cast("date"),
    )


def degree_level(c: Column) -> Column:
    """The first degree level whose pattern occurs; UNKNOWN otherwise, and for null."""
    s, out = collapse(c), None
    for level, pattern in lx.DEGREE_PATTERNS:
        out = F.when(s.rlike(pattern), level) if out is None else out.when(s.rlike(pattern), level)
    return out.otherwise("UNKNOWN")


def constant(value: object, kind: str) -> Column:
    """A fixed table as one literal: parsed from text once, by constant folding.  Built up from
    single literals it would be a tree of hundreds of nodes in every plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def lookup(c: Column, table: dict, default: Column) -> Column:
    """The value of a small fixed table of texts or whole numbers."""
    kind = "int" if all(isinstance(v, int) for v in table.values()) else "string"
    return F.coalesce(F.try_element_at(constant(table, f"map<string,{kind}>"), c), default)


def degree_rank(level: Column) -> Column:
    return lookup(level, lx.DEGREE_RANK, F.lit(0))


def degree_label(level: Column) -> Column:
    return lookup(level, lx.DEGREE_LABELS, F.lit("Unspecified degree level"))


def field_label(field: Column) -> Column:
    return lookup(field, {f[0]: f[1] for f in lx.FIELDS}, F.lit(lx.UNKNOWN_FIELD_LABEL))


def skill_label(skill: Column) -> Column:
    return lookup(skill, {s[0]: s[1] for s in lx.SKILLS}, skill)


def _longest(words: Sequence[str]) -> str:
    """A pattern, by shared beginnings, of the longest of ``words`` that begins at a place."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def body(node: dict) -> str:
        rest = [re.escape(c) + body(child) for c, child in sorted(node.items()) if c]
        if not rest:
            return ""
        joined = rest[0] if len(rest) == 1 and "" not in node else f"(?:{'|'.join(rest)})"
        return joined + "?" * ("" in node)

    return body(root)


def _ranks(text: Column, aliases: Sequence[str], whole_word: bool = False) -> Column:
    """Ranks (places in ``aliases``) of the aliases that occur in comparable text, ascending.

    One pattern finds the longest alias at every place; others that occur there begin it, so
    a fixed table adds them.  ``whole_word``: aliases must be whole words.
    """
    more = lambda a: [a, *(b for b in aliases if b != a and a.startswith(b + " " * whole_word))]
    table = {a: sorted(aliases.index(b) for b in more(a)) for a in aliases}
    pattern = f"(?<![a-z0-9])(?=({_longest(aliases)})(?![a-z0-9]))" if whole_word else f"(?=({_longest(aliases)}))"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    ranks = F.flatten(F.transform(found, lambda a: F.try_element_at(constant(table, "map<string,array<int>>"), a)))
    return F.array_sort(F.array_distinct(ranks))


def _skill_ranks(text: Column, whole_word: bool) -> Column:
    """Ranks of skill aliases; those of one or two letters must be whole words in any case."""
    aliases = [a for a, _ in lx.skill_aliases()]
    if whole_word:
        return _ranks(text, aliases, True)
    # aliases go by length, so the short ones are the last
    long = [a for a in aliases if len(a) > 2]
    short = constant([{"alias": a, "rank": len(long) + i} for i, a in enumerate(aliases[len(long) :])], "array<struct<alias: string, rank: int>>")
    words = F.filter(short, lambda e: F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), e["alias"], F.lit(" "))))
    return F.concat(_ranks(text, long), F.transform(words, lambda e: e["rank"]))


def skills_in(c: Column, whole_word: bool = False) -> Column:
    """Skills whose alias occurs, in order of alias length; an empty array for null."""
    ids = constant([i for _, i in lx.skill_aliases()], "array<string>")
    found = lambda text: F.array_distinct(F.transform(_skill_ranks(text, whole_word), lambda r: F.get(ids, r)))
    return let(F.coalesce(comparable(c), F.lit("")), found)


def canonical_skill(c: Column, whole_word: bool = False) -> Column:
    """The first skill whose alias occurs; null if none does."""
    ids = constant([i for _, i in lx.skill_aliases()], "array<string>")
    return let(comparable(c), lambda text: F.get(ids, F.get(_skill_ranks(text, whole_word), 0)))


def canonical_skills(xs: Column) -> Column:
    """Canonical ids of a list, unknown ones verbatim, the first of those that compare equal."""
    kept = F.filter(F.transform(xs, F.trim), lambda t: t != "")
    ids = F.transform(kept, lambda t: F.coalesce(canonical_skill(t), t))


    def first_of_key(ids: Column) -> Column:
        def kept(keys: Column) -> Column:
            return F.filter(ids, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)

        return let(F.transform(ids, comparable), kept)

    return let(ids, first_of_key)


def field_of(c: Column) -> Column:
    """The field of study: longest alias that occurs, branches before generic families."""
    pairs = lx.field_aliases()
    ids = constant([i for _, i in pairs], "array<string>")
    hit = lambda text: F.get(ids, F.get(_ranks(text, [a for a, _ in pairs]), 0))
    return F.coalesce(let(F.coalesce(comparable(c), F.lit("")), hit), F.lit(lx.UNKNOWN_FIELD))


def work_arrangement(location: Column) -> Column:
    return F.when(location.rlike("(?i)remote"), "Remote").when(location.rlike("(?i)hybrid"), "Hybrid")


def experience_label(low: Column, high: Column) -> Column:
    n = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return (
        F.when(low.isNull() & high.isNull(), F.lit(None).cast("string"))
        .when(low.isNotNull() & high.isNotNull(), F.concat(n(low), F.lit("–"), n(high), F.lit(" years")))
        .when(low.isNotNull(), F.concat(n(low), F.lit("+ years")))
        .otherwise(F.concat(F.lit("Up to "), n(high), F.lit(" years")))
    )


def joined_or_null(xs: Column, sep: str = ", ") -> Column:
    return F.nullif(F.array_join(F.filter(xs, lambda x: x.isNotNull()), sep), F.lit(""))


def url_host(url: Column) -> Column:
    """Host with its port, lower case; null if there is none."""
    authority = F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.nullif(F.lower(authority), F.lit(""))


def normal_url(url: Column) -> Column:
    """Scheme, host and path without trailing slashes; https where no scheme is given."""
    s = F.trim(url)
    s = F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    path = F.regexp_extract(s, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    scheme = F.lower(F.regexp_extract(s, r"^(?i)(https?)://", 1))
    return F.when(url_host(s).isNotNull() & (F.trim(url) != ""), F.concat(scheme, F.lit("://"), url_host(s), F.regexp_replace(path, "/+$", "")))


def absolute_url(href: Column, base: Column) -> Column:
    """``href`` resolved against the page's address (absolute, host-relative or path-relative)."""
    origin = F.regexp_extract(base, r"^(?i)[a-z]+://[^/?#]+", 0)
    folder = F.regexp_replace(F.regexp_extract(base, r"^(?i)[a-z]+://[^/?#]+([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^(?i)[a-z]+:", 0), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, folder, href))
    )
