"""Stored counters plus deltas against a full recount, over batches that insert, change, move and delete."""

import random

from pyspark.sql import functions as F

from rolecall.operators import rollup_deltas as rd

ROW = "id int, company_id string, status string, verification string, verdict string, day int"


def test_counters_and_maxima_follow_batches(spark):
    rnd = random.Random(12)
    made = lambda i: (i, rnd.choice(["a", "b", "c", None]), rnd.choice(["ACTIVE", "REMOVED"]), rnd.choice(["UNVERIFIED", "VERIFIED_ACTIVE", None]), rnd.choice(["ELIGIBLE", "UNCERTAIN", "INELIGIBLE", None]), rnd.choice([None, *range(9)]))
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    held = {i: made(i) for i in range(80)}
    keys, what = ["company_id"], rd.company_counters()
    counts = rd.deltas(frame([]), frame(list(held.values())), keys, what)
    days = rd.value_deltas(frame([]), frame(list(held.values())), keys, "day")
    for step in range(3):
        touched = rnd.sample(sorted(held), 15)
        if step == 2:  # all rows with the greatest day of a company go
            touched = [i for i, r in held.items() if r[1] == "a" and (r[5] or 0) >= 5]
        before = [held[i] for i in touched]
        for i in touched:
            if step == 2 or rnd.random() < 0.3:
                del held[i]
            else:
                held[i] = made(i)
        new = range(1000 + 10 * step, 1000 + 10 * step + (step < 2) * 5)
        held |= {i: made(i) for i in new}
        after = [held[i] for i in [*touched, *new] if i in held]
        counts = rd.applied(counts, rd.deltas(frame(before), frame(after), keys, what), keys)
        days = rd.applied(days, rd.value_deltas(frame(before), frame(after), keys, "day"), [*keys, "day"])
        now = frame(list(held.values()))
        want = now.groupBy("company_id").agg(*[F.count_if(c).alias(n) for n, c in what.items()])
        full = lambda df: {r.company_id: tuple(r)[1:] for r in df.collect() if any(tuple(r)[1:])}
        assert full(counts) == full(want.select(*counts.columns))
        top = {r.company_id: r.day for r in now.where("day is not null").groupBy("company_id").agg(F.max("day").alias("day")).collect()}
        assert {r.company_id: r.day for r in rd.largest(days, keys, "day").collect()} == top


def test_a_batch_without_change_is_empty(spark):
    rows = spark.createDataFrame([(1, "a", "ACTIVE", "UNVERIFIED", None, 3)], ROW)
    assert rd.deltas(rows, rows, ["company_id"], rd.company_counters()).count() == 0
