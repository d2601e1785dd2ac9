"""Lexicon containment against a plain version that looks for every alias."""

import random
import re

import pytest

from rolecall import lexicons as lx
from rolecall.functions import text as tx
from pyspark.sql import functions as F


def plain_text(s):
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")


def holds(text, alias, whole):
    return f" {alias} " in f" {text} " if whole or len(alias) <= 2 else alias in text


def made(rng, aliases):
    parts = []
    for _ in range(rng.randrange(1, 8)):
        a = rng.choice(aliases)
        parts.append(rng.choice([a, a.upper(), "x" + a, a + "s", a[:-1], a[: len(a) // 2], a.replace(" ", "-"), a + " " + rng.choice(aliases), "and"]))
    return rng.choice([" ", ", ", ""]).join(parts)


@pytest.mark.parametrize("whole", [False, True])
def test_skills_equal_a_test_of_every_alias(spark, whole):
    rng, pairs = random.Random(4), lx.skill_aliases()
    names = [a for a, _ in pairs]
    # every alias alone, and mixtures in which aliases overlap, begin in words, or are cut off
    texts = [*names, *(f"we use {a}, daily" for a in names), *(made(rng, names) for _ in range(1500)), "", None, "py pyx ml/ai", "xai engineering", "QC"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.found, r.first) for r in df.select("i", tx.skills_in(F.col("t"), whole).alias("found"), tx.canonical_skill(F.col("t"), whole).alias("first")).collect()}
    for i, t in enumerate(texts):
        text = plain_text(t or "")
        want = list(dict.fromkeys(s for a, s in pairs if holds(text, a, whole)))
        assert got[i] == (want, want[0] if want and t is not None else None), t
    assert {s for found, _ in got.values() for s in found} == {s for _, s in pairs}


def test_fields_equal_a_test_of_every_alias(spark):
    rng, pairs = random.Random(5), lx.field_aliases()
    names = [a for a, _ in pairs]
    texts = [*names, *(made(rng, names) for _ in range(1500)), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.field for r in df.select("i", tx.field_of(F.col("t")).alias("field")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == next((f for a, f in pairs if a in plain_text(t or "")), lx.UNKNOWN_FIELD), t
    assert set(got.values()) == {f for _, f in pairs} | {lx.UNKNOWN_FIELD}
