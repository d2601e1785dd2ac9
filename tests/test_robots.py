"""Robots rules met by prefixes, against a plain version that tests every rule on every path."""

import random
import re

from rolecall.sources import pages

CHARS = ["a", "b", "/", "/", "%", ".", "[", "\\", "é"]


def fits(path, rule):
    body = re.sub(r"\$$", "", rule)
    if rule == "":
        return False
    if "*" not in body:
        return path.startswith(body)
    return re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + ("$" if rule.endswith("$") else ""), path, re.DOTALL) is not None


def judged(rules, path):
    found = [(len(r), allow) for allow, r in rules if fits(path, r)]
    return max(found)[1] if found else True


def made(rng, n, extra):
    return "".join(rng.choice([*CHARS, *extra]) for _ in range(rng.randrange(n)))


def test_equals_all_rules_on_all_paths(spark):
    rng = random.Random(3)
    rules = {f"o{k}": [(rng.random() < 0.5, "/" * (k % 2) + made(rng, 6, ["*", "*"]) + rng.choice(["", "", "$"])) for _ in range(25)] for k in range(6)}
    rules["o9"] = []
    urls = [(i, o, "/" * rng.randrange(2) + made(rng, 9, [])) for i, o in enumerate([*rules, "unknown"] * 60)] + [(9000, "o1", ""), (9001, "o1", "/"), (9002, "o1", None), (9003, None, "/a")]
    urls += urls[:20]
    table = spark.createDataFrame([(o, 1, ["bot"], a, r) for o, rs in rules.items() for a, r in rs], "origin string, group int, agents array<string>, allow boolean, path string")
    got = pages.filter_allowed(spark.createDataFrame(urls, "id int, origin string, path string"), table, "Bot/2").collect()
    assert len(got) == len(urls)
    wrong = [r for r in got if r.path is not None and r.allowed != judged(rules.get(r.origin, []), r.path)]
    assert not wrong and all(r.allowed for r in got if r.path is None)
    assert len({r.allowed for r in got}) == 2


def test_rows_follow_the_lengths_of_paths(spark):
    """One origin with all rules and paths: rows are bounded by the paths' characters, not by rules x paths."""
    paths = spark.range(4000).selectExpr("'o' as origin", "concat('/p', id, '/x') as path")
    rules = spark.range(3000).selectExpr("'o' as origin", "id % 2 = 0 as allow", "concat('/p', id, if(id % 50 = 0, '*x$', '')) as rule")
    met = pages.rule_candidates(paths, rules)
    # every rule that is a prefix of the path: one for each number that the path's number begins with
    want = sum(1 for i in range(4000) for k in range(1, len(str(i)) + 1) if int(str(i)[:k]) < 3000)
    assert met.count() == want < 4000 * 5
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()
