"""Postings and links out of fetched pages and robots files."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx

RAW = "external_job_id string, title string, description string, location string, employment_type string, posted_at string, closing_at string, salary string, department string, category string, url string, education_requirement string, experience_min double, method string"


def gate_pages(pages: DataFrame, html: str = "html", ok: Column | None = None) -> DataFrame:
    """Adds blocked_reason (the first block marker in the first 4,000 characters), blocked and ok."""
    head = F.lower(F.left(F.col(html), F.lit(4000)))
    marker = F.get(F.filter(F.array(*[F.lit(m) for m in lx.BLOCK_MARKERS]), lambda m: F.contains(head, m)), 0)
    fetched = ok if ok is not None else F.col(html).isNotNull()
    return pages.withColumn("blocked_reason", marker).withColumns({"blocked": F.col("blocked_reason").isNotNull(), "ok": fetched & F.col("blocked_reason").isNull()})


def robots_rules(robots: DataFrame) -> DataFrame:
    """origin, group, agents, allow, path of robots files (origin, body).

    User-agent lines in a row share a group; an empty Disallow and groups without rules go.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", "\n")).alias("at", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    said = lines.select("origin", "at", F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"), F.contains(line, F.lit(":")).alias("ok")).where("ok and key <> ''")
    by = Window.partitionBy("origin").orderBy("at")
    agent = F.col("key") == "user-agent"
    starts = agent & (F.coalesce(F.lag("key").over(by), F.lit("")) != "user-agent")
    grouped = said.withColumn("group", F.sum(starts.cast("int")).over(by)).where("group > 0")
    agents = grouped.where(agent).groupBy("origin", "group").agg(F.array_sort(F.collect_set(F.lower("value"))).alias("agents"))
    rules = grouped.where(F.col("key").isin("allow", "disallow") & ~((F.col("key") == "disallow") & (F.col("value") == "")))
    return rules.join(agents, ["origin", "group"]).select("origin", "group", "agents", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))


def _path_fits(path: Column, rule: Column) -> Column:
    """Prefix match; * is any run of characters and a final $ ends a rule that has one."""
    body = F.regexp_replace(rule, r"\$$", "")
    quoted = F.concat_ws(".*", F.transform(F.split(body, r"\*"), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))))
    pattern = F.concat(F.lit("^"), quoted, F.when(F.endswith(rule, F.lit("$")), "$").otherwise(""))
    return (rule != "") & F.when(F.contains(body, F.lit("*")), F.regexp_like(path, pattern)).otherwise(F.startswith(path, body))


def _own_rules(rules: DataFrame, agent: str) -> DataFrame:
    """origin, allow and rule of the group that holds for ``agent``: that of the longest agent name inside it, else the first * group."""
    mine = F.filter("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a))
    length = F.coalesce(F.array_max(F.transform(mine, F.length)), F.when(F.array_contains("agents", "*"), F.lit(0)))
    rank = Window.partitionBy("origin").orderBy(F.desc("_length"), "group")
    chosen = rules.withColumn("_length", length).where("_length is not null").withColumn("_rank", F.dense_rank().over(rank))
    return chosen.where("_rank = 1").select("origin", "allow", F.col("path").alias("rule"))


def rule_candidates(paths: DataFrame, rules: DataFrame, salts: int = 16) -> DataFrame:
    """origin, path, allow and rule wherever a path begins with a rule's head, the part before its first *.

    A path meets heads as equal prefixes, so it has a row for each length that a head of its
    origin has, and no more than it has characters.  An origin's heads are repeated for ``salts``
    parts of its paths, so an origin or head that all paths share is no single key.
    """
    head = F.substring_index(F.regexp_replace("rule", r"\$$", ""), "*", 1)
    heads = rules.where("rule <> ''").select("origin", "allow", "rule", head.alias("_head"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    lengths = heads.groupBy("origin", "_salt").agg(F.collect_set(F.length("_head")).alias("_lengths"))
    salted = paths.select("origin", "path", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("_salt"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("path"))
    prefixes = salted.join(lengths, ["origin", "_salt"]).select("origin", "path", "_salt", F.explode(fitting).alias("_n"))
    return prefixes.withColumn("_head", F.expr("left(path, _n)")).join(heads, ["origin", "_salt", "_head"]).select("origin", "path", "allow", "rule")


def filter_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed`` to urls (origin, path): the longest rule that fits wins, Allow at ties, and
    what no rule fits is allowed.  Only rules with a * are tested as patterns, on paths that begin
    as they do."""
    met = rule_candidates(urls.select("origin", "path").distinct(), _own_rules(rules, agent))
    best = met.where(_path_fits(F.col("path"), F.col("rule"))).groupBy("origin", "path").agg(F.max(F.struct(F.length("rule"), "allow"))["allow"].alias("_allow"))
    return urls.join(best, ["origin", "path"], "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


# --- JSON-LD --------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _open(v: Column) -> Column:
    """The first of an array; the @value, @id or value of an object; else the value as it is."""
    first = lambda x: F.coalesce(_at(x, "$[0]"), x)
    return tx.let(tx.let(v, first), lambda x: F.coalesce(_at(x, "$['@value']"), _at(x, "$['@id']"), _at(x, "$.value"), x))


def _scalar(v: Column) -> Column:
    """Text of a value, unwrapped twice; null for none, blank or a nested object.

    What doesn't read like an array or object is a plain value and taken as it is; the others alone
    are unwrapped and asked for their kind, which is dear.
    """
    bracketed = lambda s: s.rlike(r"^[\[{]")

    def text(x: Column) -> Column:
        nested = lambda s: bracketed(s) & _kind(x).rlike("^(ARRAY|OBJECT)")
        return tx.let(_at(x, "$", "string"), lambda s: F.when(~F.coalesce(nested(s), F.lit(False)), s))

    plain = lambda s: F.when(s.isNull() | ~bracketed(s), s).otherwise(tx.let(_open(_open(v)), text))
    # inside a lambda ``nullif`` would evaluate its value twice
    return F.when(v.isNotNull(), tx.let(tx.collapse(tx.let(_at(v, "$", "string"), plain)), lambda s: F.when(s != "", s)))


def json_ld_nodes(pages: DataFrame, depth: int = 8) -> DataFrame:
    """page_id, url, node: every JobPosting object of a page's ld+json scripts, arrays and @graph
    flattened to ``depth``; trailing commas are repaired, other bad JSON is left out.

    ``explode_outer`` and a filter after it: for ``explode`` the optimizer adds a filter on the array's
    size, and pushes it below the steps that make the array, where it would make it again and again.
    """
    script = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    bodies = pages.select("page_id", "url", F.explode_outer(F.regexp_extract_all("html", F.lit(script), 1)).alias("_body"))
    # JSON that says JobPosting has it in plain letters or in escapes
    bodies = bodies.where(F.contains("_body", F.lit("JobPosting")) | F.contains("_body", F.lit("\\u")))
    trailing = r",\s*([}\]])"
    repaired = F.when(F.col("_body").rlike(trailing), F.try_parse_json(F.regexp_replace("_body", trailing, "$1")))
    parsed = F.coalesce(F.try_parse_json("_body"), repaired)
    rows = bodies.withColumn("_level", F.filter(F.array(parsed), lambda v: v.isNotNull())).withColumn("_all", F.col("_level"))
    none = F.array().cast("array<variant>")
    for _ in range(depth):
        graph = lambda v: _at(v, "$['@graph']")
        children = lambda v: F.concat(
            F.coalesce(_at(v, "$", "array<variant>"), none),
            F.when(graph(v).isNotNull(), F.array(graph(v))).otherwise(none),
        )
        rows = rows.withColumn("_level", F.when(F.size("_level") > 0, F.flatten(F.transform("_level", children))).otherwise(none))
        rows = rows.withColumn("_all", F.concat("_all", "_level"))
    nodes = rows.select("page_id", "url", F.explode_outer("_all").alias("node"))
    kinds = F.coalesce(_at(F.col("node"), "$['@type']", "array<string>"), F.array(_at(F.col("node"), "$['@type']", "string")))
    return nodes.where(F.array_contains(kinds, "JobPosting"))  # only objects have a @type


#: Where a posting's values stand: in the node, its salary, its education, its place and the place's address.
_VALUES = {
    "node": ("identifier", "jobId", "title", "description", "employmentType", "datePosted", "validThrough", "department", "occupationalCategory", "url", "educationRequirements", "jobLocation"),
    "pay": ("value", "minValue", "maxValue", "currency"),
    "study": ("credentialCategory", "educationalCredentialAwarded", "aboutLocation", "alternativeOf"),
    "place": ("addressLocality", "name"),
    "address": ("addressLocality", "addressRegion", "addressCountry"),
}


def job_posting(nodes: DataFrame) -> DataFrame:
    """Nodes as raw postings: unwrapped values, months as years, joined address and salary, absolute
    url; one row per page, url and title."""
    n = F.col("node")
    first = lambda v: F.when(F.startswith(_kind(v), F.lit("ARRAY")), _at(v, "$[0]")).otherwise(v)
    held = nodes.withColumns({"_pay": _at(n, "$.baseSalary"), "_study": _at(n, "$.educationRequirements"), "_place": first(_at(n, "$.jobLocation"))})
    held = held.withColumn("_address", first(_at(F.col("_place"), "$.address")))
    # all values go through one lambda: written out for each, the code would outgrow the compiler's limits
    keys = [(part, k) for part, names in _VALUES.items() for k in names]
    held = held.withColumn("_values", F.transform(F.array(*[_at(F.col("node" if part == "node" else f"_{part}"), f"$.{k}") for part, k in keys]), _scalar))
    of = lambda part, k: F.col("_values")[keys.index((part, k))]
    get = lambda k: of("node", k)
    low, high = F.coalesce(of("pay", "value"), of("pay", "minValue")), of("pay", "maxValue")
    unit = F.upper(_at(F.col("_pay"), "$.unitText", "string"))
    per = F.when(unit.isin("HOUR", "DAY", "WEEK", "MONTH", "YEAR"), F.concat(F.lit("per "), F.lower(unit)))
    months = _at(n, "$.experienceRequirements.monthsOfExperience", "double")
    cred = F.coalesce(of("study", "credentialCategory"), of("study", "educationalCredentialAwarded"))
    about = F.coalesce(of("study", "aboutLocation"), of("study", "alternativeOf"))
    education = F.when(F.startswith(_kind(F.col("_study")), F.lit("OBJECT")), F.nullif(F.concat_ws(" ", cred, about), F.lit(""))).otherwise(get("educationRequirements"))
    full = F.nullif(F.concat_ws(", ", *[of("address", k) for k in _VALUES["address"]]), F.lit(""))
    location = F.coalesce(full, F.when(F.col("_address").isNull(), F.coalesce(of("place", "addressLocality"), of("place", "name"))), get("jobLocation"))
    raw = held.select(
        "page_id", F.coalesce(get("identifier"), get("jobId")).alias("external_job_id"), F.coalesce(get("title"), F.lit("Untitled role")).alias("title"),
        F.nullif(F.regexp_replace(tx.page_text(get("description")), r"^\s+|\s+$", ""), F.lit("")).alias("description"), location.alias("location"), get("employmentType").alias("employment_type"),
        get("datePosted").alias("posted_at"), get("validThrough").alias("closing_at"), F.nullif(F.concat_ws(" ", F.coalesce(F.concat(low, F.lit("-"), high), low, high), of("pay", "currency"), per), F.lit("")).alias("salary"),
        get("department").alias("department"), get("occupationalCategory").alias("category"), F.coalesce(tx.absolute_url(get("url"), F.col("url")), F.col("url")).alias("url"),
        education.alias("education_requirement"), F.when(months > 0, F.round(months / 12, 1)).alias("experience_min"), F.lit("JSON_LD").alias("method"),
    )
    return raw.dropDuplicates(["page_id", "url", "title"])


# --- microdata and listings: need element scope, so an HTML parser inside Arrow batches -------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Scopes(HTMLParser):
    """Texts of open elements, kept by a stack; ``begin`` and ``end`` are told of each element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict[str, str], list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        item = (tag, {k: v or "" for k, v in attrs}, [])
        if tag in _VOID:
            self.end(item)
        else:
            self.stack.append(item)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                item = self.stack.pop()
                if self.stack and item[0] not in ("script", "style"):
                    self.stack[-1][2].extend([" ", *item[2], " "])
                self.end(item)
                if item[0] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.stack:
            self.stack[-1][2].append(data)

    def finish(self) -> None:
        self.close()
        while self.stack:
            self.handle_endtag(self.stack[-1][0])

    def end(self, item: tuple[str, dict[str, str], list[str]]) -> None:
        raise NotImplementedError


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Microdata(_Scopes):
    def __init__(self) -> None:
        super().__init__()
        self.props: list[tuple[int, str, str]] = []
        self.found: list[dict[str, str]] = []

    def end(self, item: tuple[str, dict[str, str], list[str]]) -> None:
        tag, attrs, text = item
        depth = len(self.stack)
        if name := attrs.get("itemprop"):
            value = attrs.get("content") or attrs.get("href") or _clean(text)
            self.props.append((depth, name, " ".join(value.split())))
        if "schema.org/JobPosting" in attrs.get("itemtype", ""):
            mine = [p for p in self.props if p[0] > depth]
            self.props = [p for p in self.props if p[0] <= depth]
            first: dict[str, str] = {}
            for _, name, value in mine:
                first.setdefault(name, value)
            self.found.append(first)


def microdata(pages: DataFrame) -> DataFrame:
    """Postings marked up with itemprop inside a JobPosting scope; those without a title go.  A
    missing posting date stays null.  Only pages that name an itemtype are parsed: others have no scope."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                parser = _Microdata()
                parser.feed(html or "")
                parser.finish()
                for p in parser.found:
                    if p.get("title"):
                        get = lambda *ks, p=p: next((p[k] for k in ks if p.get(k)), None)
                        out.append((page, get("identifier"), p["title"], get("description"), get("jobLocation", "addressLocality"), get("employmentType", "industry"), get("datePosted"), get("validThrough"), get("baseSalary"), get("department"), get("occupationalCategory"), get("url") or url, get("educationRequirements"), None, "MICRODATA"))
            yield pd.DataFrame(out, columns=["page_id", *[c.strip().split(" ")[0] for c in RAW.split(",")]])

    return pages.where(F.col("html").rlike("(?i)itemtype")).select("page_id", "url", "html").mapInPandas(read, f"page_id long, {RAW}")


class _Anchors(_Scopes):
    """(href, text, text of the nearest listing block) of anchors outside nav, header and footer."""

    BLOCKS = {"li", "article", "tr"}
    WORDS = ("job", "card", "result", "position", "opening")

    def __init__(self) -> None:
        super().__init__()
        self.found: list[list[str]] = []
        self.waiting: list[tuple[int, list[str]]] = []

    def _block(self, depth: int) -> int:
        for at in range(depth - 1, -1, -1):
            tag, attrs, _ = self.stack[at]
            if tag in self.BLOCKS or any(w in attrs.get("class", "") for w in self.WORDS):
                return at
        return max(depth - 1, 0)

    def end(self, item: tuple[str, dict[str, str], list[str]]) -> None:
        tag, attrs, text = item
        depth = len(self.stack)
        if tag == "a" and attrs.get("href") and not any(t in ("nav", "header", "footer") for t, _, _ in self.stack):
            row = [attrs["href"], _clean(text), ""]
            self.found.append(row)
            self.waiting.append((self._block(depth), row))
        still = []
        for at, row in self.waiting:
            if at >= depth:
                row[2] = _clean(text)[:4000]
            else:
                still.append((at, row))
        self.waiting = still


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, position, href, text, scope of every anchor outside navigation.  Pages without an
    a-tag that could have an attribute aren't parsed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                parser = _Anchors()
                parser.feed(html or "")
                parser.finish()
                out += [(page, url, i, *row) for i, row in enumerate(parser.found)]
            yield pd.DataFrame(out, columns=["page_id", "page_url", "position", "href", "text", "scope"])

    return pages.where(F.col("html").rlike(r"<[aA][\t\n\r\f /]")).select("page_id", "url", "html").mapInPandas(read, "page_id long, page_url string, position int, href string, text string, scope string")


def listing_location(c: Column) -> Column:
    named = [F.nullif(tx.collapse(F.regexp_extract(c, p, 1)), F.lit("")) for p in lx.LISTING_LOCATION]
    return F.coalesce(*named, F.regexp_substr(c, F.lit(lx.LOCATION_HINT)), F.regexp_substr(c, F.lit(lx.LISTING_REMOTE)))


def listing_fields(c: Column) -> dict[str, Column]:
    """Location, employment type, salary text and education line of a listing's text."""
    line = F.get(F.filter(tx.statements(c), lambda s: s.rlike(lx.DEGREE_LINE) & (F.length(s) < 300)), 0)
    return {"location": listing_location(c), "employment_type": F.regexp_substr(c, F.lit(lx.EMPLOYMENT_TYPE)), "salary": tx.collapse(F.regexp_substr(c, F.lit(lx.SALARY))), "education_requirement": line}


def listings(found: DataFrame) -> DataFrame:
    """Anchors that read like postings: a title's form, no noise, and a sign of place, degree, type,
    years or date in their block; the first of each address."""
    scope, title = F.col("scope"), F.col("text")
    signal = scope.rlike(lx.LOCATION_HINT) | scope.rlike(lx.DEGREE_LINE) | scope.rlike(lx.EMPLOYMENT_TYPE) | scope.rlike(lx.LISTING_YEARS) | scope.rlike(lx.LISTING_DATE)
    fits = F.length(title).between(5, 120) & title.rlike(lx.LISTING_TITLE) & ~title.rlike(lx.NOISE_TITLE)
    rows = found.withColumn("url", tx.absolute_url(F.col("href"), F.col("page_url"))).where(fits & F.col("url").rlike("(?i)^https?:"))
    first = rows.groupBy("page_id", "url").agg(F.min(F.struct("position", "text", "scope")).alias("f")).select("page_id", "url", F.col("f.text").alias("text"), F.col("f.scope").alias("scope"))
    kept = first.where(signal)
    f = listing_fields(F.col("scope"))
    null = lambda kind: F.lit(None).cast(kind)
    return kept.select(
        "page_id", null("string").alias("external_job_id"), F.regexp_extract("text", lx.LISTING_TITLE, 1).alias("title"), F.nullif("scope", F.lit("")).alias("description"), f["location"].alias("location"), f["employment_type"].alias("employment_type"),
        null("string").alias("posted_at"), null("string").alias("closing_at"), f["salary"].alias("salary"), null("string").alias("department"), null("string").alias("category"), "url", f["education_requirement"].alias("education_requirement"), null("double").alias("experience_min"), F.lit("HEURISTIC").alias("method"),
    )


def extractor_chain(structured: DataFrame, marked: DataFrame, listed: DataFrame) -> DataFrame:
    """JSON-LD and microdata rows; a page without either gives its listings.  Structured rows are
    ``authoritative``.  Each of the three is read once."""
    strong = structured.unionByName(marked).withColumn("authoritative", F.lit(True))
    rows = strong.unionByName(listed.withColumn("authoritative", F.lit(False)))
    found = F.max("authoritative").over(Window.partitionBy("page_id"))
    return rows.withColumn("_found", found & F.col("page_id").isNotNull()).where(F.col("authoritative") | ~F.col("_found")).drop("_found")


def partition_text(c: Column) -> Column:
    """struct<responsibilities, requirements, education> of a text's statements over 12 characters."""
    degree = lambda x: x.rlike(lx.DEGREE_LINE) & (F.length(x) < 300)

    def lists(s: Column, education: Column) -> Column:
        first = lambda x: F.coalesce(x == education, F.lit(False))
        return F.struct(
            F.filter(s, lambda x: ~first(x) & x.rlike(lx.DUTY_LINE)).alias("responsibilities"),
            F.filter(s, lambda x: first(x) | (~x.rlike(lx.DUTY_LINE) & x.rlike(lx.REQUIREMENT_LINE))).alias("requirements"),
            education.alias("education"),
        )

    return tx.let(tx.statements(c, 12), lambda s: tx.let(F.get(F.filter(s, degree), 0), lambda education: lists(s, education)))


STATEMENT_LISTS = ("responsibilities", "requirements", "skills", "preferred")


def _statement_list(x: Column) -> Column:
    """The list that a statement belongs to; null for none."""
    skill, degree = x.rlike(lx.STATEMENT_SKILL), x.rlike(lx.STATEMENT_DEGREE)
    return (
        F.when(x.rlike(lx.STATEMENT_PREFERRED) & (skill | F.contains(x, F.lit(":"))), "preferred")
        .when(skill & ~degree, "skills")
        .when(x.rlike(lx.STATEMENT_DUTY), "responsibilities")
        .when(degree | x.rlike(lx.STATEMENT_REQUIREMENT) | x.rlike(lx.STATEMENT_NEED), "requirements")
    )


def four_lists(description: Column) -> Column:
    """struct<responsibilities, requirements, skills, preferred> of a description's statements, in
    order; each statement is classed once.  Empty lists for null."""
    parts = tx.statements(tx.page_text(F.coalesce(description, F.lit(""))), lx.STATEMENT_LEAST - 1)
    classed = F.transform(parts, lambda x: F.struct(x.alias("text"), _statement_list(x).alias("list")))
    of = lambda all_, name: F.transform(F.filter(all_, lambda e: e["list"] == name), lambda e: e["text"]).alias(name)
    return tx.let(classed, lambda all_: F.struct(*[of(all_, name) for name in STATEMENT_LISTS]))


def enrich(rows: DataFrame, pages: DataFrame, structured: DataFrame, per_company: int = 10, short: int = 250) -> DataFrame:
    """Listings whose description is missing or under ``short`` characters, the first
    ``per_company`` by url of each company, overlaid with their own page: its structured posting, else
    its text.  Url and external id stay."""
    thin = F.col("description").isNull() | (F.length("description") < short)
    nth = F.row_number().over(Window.partitionBy("company_id", thin).orderBy("url"))
    marked = rows.withColumn("_take", thin & (nth <= per_company))
    best = structured.groupBy("page_id").agg(F.min(F.struct("url", "title", "description", "location", "education_requirement")).alias("s"))
    detail = pages.select("page_id", F.col("url"), tx.collapse(tx.page_text(F.col("html"))).alias("_text")).join(best, "page_id", "left").drop("page_id")
    joined = marked.join(detail, "url", "left")
    over = lambda c: F.when(F.col("_take") & F.col(f"s.{c}").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c))
    text = F.when(F.col("_take") & F.col("s").isNull(), F.nullif("_text", F.lit("")))
    out = joined.withColumns({"title": over("title"), "location": over("location"), "education_requirement": F.coalesce(F.when(text.isNotNull(), partition_text(text)["education"]), over("education_requirement")), "description": F.coalesce(text, over("description"))})
    return out.select(*rows.columns)


def job_links(pages: DataFrame, per_page: int = 6) -> DataFrame:
    """The first ``per_page`` distinct absolute links of each page that speak of jobs."""
    hrefs = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), 1)).alias("position", "href"))
    links = hrefs.withColumn("link", tx.absolute_url(F.col("href"), F.col("url"))).where(F.col("link").rlike(lx.JOB_LINK))
    first = links.groupBy("page_id", "link").agg(F.min("position").alias("position"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("position"))).where(F.col("nth") <= per_page).select("page_id", "link", "nth")


def detail_like(html: Column) -> Column:
    """Whether a page looks like one posting's own."""
    text = tx.collapse(tx.page_text(html))
    words = text.rlike(lx.DEGREE_LINE) & text.rlike(r"(?i)\b(experience|responsibilit|requirement|qualification|apply)\b") & (F.length(text) > 400)
    marked = html.rlike(r"(?is)<script[^>]*ld\+json[^>]*>[^<]*JobPosting") | html.rlike(r"(?i)itemtype=[\"'][^\"']*JobPosting")
    return F.coalesce(marked | words, F.lit(False))


def follow_links(pages: DataFrame, raw: DataFrame, per_page: int = 6) -> DataFrame:
    """The first posting of each detail page that a page's job links lead to."""
    targets = pages.where(detail_like(F.col("html"))).select(F.col("url").alias("link"), F.col("page_id").alias("target"))
    reached = job_links(pages, per_page).join(targets, "link")
    first = raw.groupBy(F.col("page_id").alias("target")).agg(F.min(F.struct(F.when(F.col("method") == "JSON_LD", 0).otherwise(1).alias("o"), "url", "title")).alias("f"))
    return reached.join(first, "target").select(F.col("page_id").alias("from_page"), "target", "f.url", "f.title")


def board_postings(hits: DataFrame, raw: DataFrame, most: int = 40) -> DataFrame:
    """Postings behind search hits (company_id, url, page_id) on board hosts or job paths, never
    official, the first ``most`` of each company."""
    board = F.coalesce(tx.url_host(F.col("url")).rlike(lx.BOARD_HOSTS), F.lit(False)) | F.col("url").rlike(lx.BOARD_PATH)
    rows = hits.where(board).select("company_id", "page_id", F.col("url").alias("hit")).join(raw, "page_id").withColumn("is_official", F.lit(False))
    nth = F.row_number().over(Window.partitionBy("company_id").orderBy("hit", "url", "title"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")
