"""URL filters: rules, and host reputation by empirical Bayes.

Labelled outcomes of pages are summed by host and shrunk through beta-binomial priors: a suffix
towards the rate of all pages, a registered domain towards its suffix, a host towards its domain.
The strength of each level's prior is estimated from all groups of that level by moments.  A host
passes if the lower bound of its posterior good rate is high enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Second labels under which countries register names (co.uk, com.au, ...).
SECOND_LABELS = ("ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "id", "ind", "info", "int", "ltd", "me", "mil", "ne", "net", "nic", "nom", "or", "org", "plc", "res", "sch", "school", "web")


@dataclass(frozen=True)
class Suffixes:
    """Public suffixes by rule: the last label, or the last two where the last is a country's (two
    letters) and the one before is one of ``second``; ``listed`` names further ones of any number
    of labels, from a full list if there is one, of which the longest that fits counts."""

    second: tuple[str, ...] = SECOND_LABELS
    listed: tuple[str, ...] = ()

    def labels(self, host: Column) -> Column:
        """How many labels of a host are its suffix."""
        last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
        by_rule = F.when(last.rlike("^[a-z]{2}$") & F.substring_index(two, ".", 1).isin(*self.second) & F.contains(host, F.lit(".")), 2).otherwise(1)
        if not self.listed:
            return by_rule
        known = F.array(*[F.lit(x) for x in sorted(set(self.listed))])
        depth = max(x.count(".") + 1 for x in self.listed)
        found = [F.when(F.array_contains(known, F.substring_index(host, ".", -k)), k) for k in range(depth, 0, -1)]
        return F.greatest(by_rule, F.coalesce(*found, F.lit(0)))


#: The rules of the query, as (string, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@dataclass(frozen=True)
class Reputation:
    """A host passes if mean - ``z`` standard deviations of its posterior reaches ``least``.

    That is the normal form of the beta posterior's lower quantile (10 % with this ``z``).  It is
    within 0.01 of the exact one where both outcomes weigh 5 pages or more, prior included (tested
    against the exact quantile), and is rougher below.  ``strength`` bounds the estimated prior
    strengths, in pages.
    """

    least: float = 0.5
    z: float = 1.2815515655446004
    strength: tuple[float, float] = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def name_of(host: Column) -> Column:
    """The host's name: without user, port and dots at the end."""
    bare = F.regexp_replace(host, r"^.*@", "")
    return F.when(F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[[^\]]*\]?", 0)).otherwise(F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.+$", ""))


def is_address(name: Column) -> Column:
    """Whether a name is a numeric address, which has no levels above it."""
    return name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")


def _last(name: Column, count: Column) -> Column:
    """The last ``count`` labels of a name, or all where it has fewer."""
    labels = F.split(name, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - count + 1), count), ".")


def suffix_of(name: Column, suffixes: Suffixes = Suffixes()) -> Column:
    """The public suffix of a host's name; an address is its own."""
    return F.when(is_address(name), name).otherwise(_last(name, suffixes.labels(name)))


def domain_of(name: Column, suffixes: Suffixes = Suffixes()) -> Column:
    """The registered domain: the suffix and one label more, where there is one; an address is its own."""
    return F.when(is_address(name), name).otherwise(_last(name, suffixes.labels(name) + 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits host (or a parent of it) and the path's beginning; else null."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found.append(F.when(fits, rule))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _strength(groups: DataFrame, bounds: tuple[float, float]) -> float:
    """Prior strength of groups with n outcomes, of which good, around the rate m, by moments."""
    v = F.col("m") * (1 - F.col("m"))
    s = groups.where("n > 0").agg(
        F.sum((F.col("good") - F.col("n") * F.col("m")) ** 2 / F.col("n")).alias("spread"),
        F.sum(v).alias("v"),
        F.sum(v * (F.col("n") - 1)).alias("w"),
    ).first()
    low, high = bounds
    rho = (s["spread"] - s["v"]) / s["w"] if s["w"] else 0.0
    return min(high, max(low, 1 / rho - 1)) if rho > 0 else high


def host_reputation(pages: DataFrame, outcomes: DataFrame, model: Reputation = Reputation(), suffixes: Suffixes = Suffixes()) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): n, good, mean, bound, passes.

    ``outcomes`` has page_id (one row each) and good (boolean).  Pages without an outcome only
    name their host.  Levels are formed of the host's name without user, port and last dot; a
    numeric address is its own domain and suffix.  The driver sees one line of sums for each of
    the three levels.  An empty host is a host like others, a null one has no row; null outcomes count as none;
    empty tables give no rows, or hosts with the prior alone.
    """
    hosts = written(
        pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good"))
        .withColumn("_name", name_of(F.col("host"))).withColumn("domain", domain_of(F.col("_name"), suffixes)).withColumn("suffix", suffix_of(F.col("_name"), suffixes)).drop("_name"),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    total = hosts.agg(*sums).first()
    rate = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    parents = hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(rate))
    for level, up in (("domain", "suffix"), ("host", "domain")):
        k = _strength(parents, model.strength)
        parents = parents.select(up, ((F.col("good") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
        below = hosts.groupBy("domain", "suffix").agg(*sums) if level == "domain" else hosts.select("host", "domain", "n", "good")
        parents = written(below.join(parents, up), f"reputation-{level}")
    k = _strength(parents, model.strength)
    mean = (F.col("good") + k * F.col("m")) / (F.col("n") + k)
    bound = F.col("mean") - model.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return parents.withColumn("mean", mean).withColumn("bound", bound).select("host", "n", "good", "mean", "bound", (F.col("bound") >= model.least).alias("passes"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: Reputation = Reputation(), page_id: str = "page_id", url: str = "url", suffixes: Suffixes = Suffixes()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, reputation.

    ``verdict`` is the fitting rule's, else allow or block by the host's reputation (its bound,
    rounded to 6 places, is in ``reputation``).  A null url, or one without ``://``, has empty
    host and path, and empty hosts share one reputation.  Repeated pages stay; a null page_id has
    no outcome; an empty table gives no rows; other columns are neither read nor returned.
    Page rows meet their host's line in a join whose hot hosts are split by adaptive execution.
    """
    slim = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = written(host_reputation(slim.select("page_id", "host"), outcomes, model, suffixes).select("host", F.round("bound", 6).alias("reputation"), "passes"), "host-verdicts")
    judged = slim.join(hosts, "host").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for pair in rules for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("passes"), "allow").otherwise("block")).alias("verdict"), "reputation")


def label_outcomes(labels: DataFrame) -> DataFrame:
    """page_id and good from labels: good if of quality and not toxic.

    Of repeated labels the worst of each kind counts; null toxic counts as not toxic, null quality of
    a page that isn't toxic gives a null outcome, which counts as none; labels without an id go;
    no labels give no outcomes.
    """
    worst = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
    return worst.select("page_id", ((F.col("_q") == 1) & (F.coalesce(F.col("_t"), F.lit(0)) == 0)).alias("good")).where("page_id is not null")


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, model: Reputation = Reputation()) -> str:
    """The query as DuckDB SQL."""
    second = ", ".join(f"'{s}'" for s in SECOND_LABELS)
    cases = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN ('{rule}', '{verdict}')")
    low, high = model.strength

    def strength(groups: str) -> str:
        return f"""SELECT CASE WHEN rho > 0 THEN least({high}, greatest({low}, 1 / rho - 1)) ELSE {high} END AS k FROM (
            SELECT CASE WHEN w > 0 THEN (spread - v) / w ELSE 0 END AS rho FROM (
            SELECT sum((good - n * m) * (good - n * m) / n) AS spread, sum(m * (1 - m)) AS v, sum(m * (1 - m) * (n - 1)) AS w FROM {groups} WHERE n > 0))"""

    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    slim AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    outcomes AS (SELECT doc_id AS page_id, CASE WHEN min(quality) = 1 AND coalesce(max(toxic), 0) = 0 THEN 1 WHEN min(quality) IS NULL AND coalesce(max(toxic), 0) = 0 THEN NULL ELSE 0 END AS good FROM labels GROUP BY doc_id),
    hosts AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good, regexp_replace(host, '^.*@', '') AS bare FROM slim LEFT JOIN outcomes USING (page_id) GROUP BY host),
    bared AS (SELECT host, n, good, CASE WHEN starts_with(bare, '[') THEN regexp_extract(bare, '^\\[[^\\]]*\\]?') ELSE regexp_replace(regexp_replace(bare, ':[0-9]*$', ''), '\\.+$', '') END AS name FROM hosts),
    labelled AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*)$') AS numeric FROM bared),
    counted AS (SELECT *, CASE WHEN len(parts) > 1 AND regexp_matches(parts[-1], '^[a-z]{{2}}$') AND parts[-2] IN ({second}) THEN 2 ELSE 1 END AS k FROM labelled),
    named AS (SELECT host, n, good, CASE WHEN numeric THEN name ELSE array_to_string(parts[-(k + 1):], '.') END AS domain, CASE WHEN numeric THEN name ELSE array_to_string(parts[-k:], '.') END AS suffix FROM counted),
    l1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM named) AS m FROM named GROUP BY suffix),
    k1 AS ({strength("l1")}),
    l2 AS (SELECT d.domain, d.n, d.good, (l1.good + k * m) / (l1.n + k) AS m FROM (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM named GROUP BY domain, suffix) d JOIN l1 USING (suffix), k1),
    k2 AS ({strength("l2")}),
    l3 AS (SELECT h.host, h.n, h.good, (l2.good + k * m) / (l2.n + k) AS m FROM named h JOIN l2 USING (domain), k2),
    k3 AS ({strength("l3")}),
    post AS (SELECT host, n + k + 1 AS weight, (good + k * m) / (n + k) AS mean FROM l3, k3),
    bounds AS (SELECT host, mean - {model.z!r} * sqrt(mean * (1 - mean) / weight) AS bound FROM post),
    ruled AS (SELECT *, CASE {" ".join(cases)} END AS hit FROM slim JOIN bounds USING (host))
    SELECT page_id, host, path, hit[1] AS rule, coalesce(hit[2], CASE WHEN bound >= {model.least} THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 6) AS reputation FROM ruled
    """
