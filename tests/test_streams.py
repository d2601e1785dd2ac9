"""Streams over several batches, whose files come in any order, against plain versions."""

import random

import pytest

from rolecall.operators import lifecycle as lc
from rolecall.streaming import folds, ordered

RUNS = "company_id string, user_id string, run_id string, n long, ends long, status string"


def stream_of(spark, folder, rows, schema, files, made):
    """A stream that reads ``rows`` as they come, a file a batch."""
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[size * k : size * (k + 1)], schema).selectExpr(*made).coalesce(1).write.parquet(f"{folder}/in/k={k:02d}")
    table = spark.read.parquet(f"{folder}/in/k=00")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def runs(rnd, n, hours):
    out = [(f"c{i % 3}", f"u{i % 2}", f"r{i:03d}", i * 3600 + rnd.randrange(hours * 3600), None, rnd.choice(["FAILED"] * 12 + ["COMPLETED"]) if i % 3 < 2 else "FAILED") for i in range(n)]
    # times tie here and there; some runs never end
    return [(*r[:3], r[3] // 7200 * 7200, None if rnd.random() < 0.01 else r[3] + rnd.randrange(30_000), r[5]) for r in out]


MADE = ["company_id", "user_id", "run_id", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, n) as started_at", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, ends) as completed_at", "status"]


@pytest.mark.parametrize("order", ["near", "any"])
def test_overlapping_runs(spark, tmp_path, order):
    rnd = random.Random(8)
    rows = runs(rnd, 240, 20)
    if order == "any":
        rnd.shuffle(rows)
    stream = stream_of(spark, tmp_path, rows, RUNS, 4, MADE)
    got = folds.to_settled(stream, "started_at", lambda s: ordered.overlapping_runs(s, "24 hours" if order == "near" else "400 days")).collect()
    want = lc.overlapping_runs(spark.createDataFrame(rows, RUNS).selectExpr(*MADE)).collect()
    assert sorted(r.run_id for r in got) == sorted(r.run_id for r in want) and 20 < len(want) < 240


def test_year_changes(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(f"u{rnd.randrange(4)}", rnd.choice([2020, 2020, 2021, None]), rnd.randrange(300) * 3600, i) for i in range(240)]
    rnd.shuffle(rows)
    schema, made = "user_id string, graduation_year int, n long, seq long", ["user_id", "graduation_year", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, n) as updated_at", "seq"]
    stream = stream_of(spark, tmp_path, rows, schema, 4, made)
    got = folds.to_settled(stream, "updated_at", lambda s: ordered.year_changes(s, "30 days"))
    want = lc.year_changes(spark.createDataFrame(rows, schema).selectExpr(*made))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_streaks_with_rows_of_any_age(spark, tmp_path):
    rnd = random.Random(10)
    rows = runs(rnd, 240, 20)
    rnd.shuffle(rows)
    day = 86_400
    # the newest success comes 200 days after its neighbours, and a row is repeated
    rows += [("c9", "u0", "a", 0, None, "FAILED"), ("c9", "u0", "b", 40 * day, None, "FAILED"), ("c9", "u0", "c", 230 * day, None, "FAILED"), ("c9", "u0", "c", 230 * day, None, "FAILED"), ("c8", "u0", "d", 5, None, "FAILED")]
    rows += [(f"c{i}", "u1", f"z{i}", 300 * day, None, "FAILED") for i in (0, 1)] + [("c9", "u0", "late", 30 * day, None, "COMPLETED"), ("c8", "u0", "e", 6, None, "COMPLETED")]
    stream = stream_of(spark, tmp_path, rows, RUNS, 5, MADE)
    got = folds.to_latest(ordered.failure_streaks(stream), ["company_id"]).where("failures > 0")
    want = lc.failure_streaks(spark.createDataFrame(rows, RUNS).selectExpr(*MADE))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.company_id: r.failures for r in want.collect()}["c9"] == 3
