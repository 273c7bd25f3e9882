"""Skew-safe building blocks against brute force, with limits small enough to take every path."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderwatch.operators.scale import exact_quantiles, first_wins, previous_in_key


def groups():
    rng = random.Random(7)
    data = {
        "hot": [round(rng.lognormvariate(10, 3), 2) for _ in range(3000)],
        "one": [5.0],
        "two": [1.0, 2.0],
        "flat": [7.25] * 500,
        "near": [1_000_000 + rng.randrange(100) / 100 for _ in range(800)],
        "signs": [round(rng.uniform(-1e6, 1e6), 2) for _ in range(700)],
        "tiny": [rng.randrange(3) / 100 for _ in range(50)],
        "huge": [float(rng.randrange(10**17)) for _ in range(300)],
    }
    data["copies"] = [10.0] * 900 + [round(rng.uniform(0, 100), 2) for _ in range(100)]
    return data


@pytest.mark.parametrize("task_rows", [1_000_000, 50, 1])
def test_exact_quantiles(spark, task_rows):
    data = groups()
    rows = [(g, v) for g, vs in data.items() for v in vs] + [(None, 1.0), ("hot", None)]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(8)
    found = exact_quantiles(df, "grp", "v", [0.25, 0.5, 0.75, 1.0], task_rows)
    result = {r["grp"]: r for r in found.collect()}
    assert set(result) == set(data)
    for g, values in data.items():
        assert result[g]["n_rows"] == len(values)
        for i, p in enumerate([0.25, 0.5, 0.75, 1.0]):
            assert result[g][f"q{i}"] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-12), (g, p)


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "grp string, v double")
    assert exact_quantiles(df, "grp", "v", [0.25]).count() == 0


def test_first_wins_keeps_null_keys_and_first_copy(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 30 + [None] * 10 + list("abcdef")), rng.randrange(20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, at int, seq int").repartition(7)
    expected = sorted((r for r in rows if r[0] is None), key=lambda r: r[2])
    by_key = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by_key[r[0]].append((r[1], r[2]))
    expected += [(k, *min(v)) for k, v in by_key.items()]
    found = [tuple(r) for r in first_wins(df, "key", ["at"]).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def history_rows(n, hot_share, days, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [
        ("hot" if rng.random() < hot_share else rng.choice("abcdefgh"), rng.choice(["x", None]), rng.randrange(days), i)
        for i in ids
    ]


@pytest.mark.parametrize("days", [1, 3, 400])
@pytest.mark.parametrize("task_rows", [1_000_000, 100, 5])
def test_previous_in_key_equals_plain_lag(spark, days, task_rows):
    rows = history_rows(1500, 0.6, days, days)
    df = spark.createDataFrame(rows, "supplier string, kind string, d int, id long").select(
        "supplier", "kind", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("day"), "id"
    ).repartition(6)
    by_key = defaultdict(list)
    for supplier, kind, d, i in rows:
        by_key[supplier, kind].append((d, i))
    expected = {}
    for seq in by_key.values():
        seq.sort()
        for before, (d, i) in zip([None, *seq], seq):
            expected[i] = before
    found = previous_in_key(df, ["supplier", "kind"], "day", "id", task_rows)
    assert found.columns == ["supplier", "kind", "day", "id", "prev_id", "prev_on"]
    got = found.select("id", "prev_id", F.date_diff("prev_on", F.lit("2020-01-01")).alias("d")).collect()
    assert len(got) == len(rows)
    assert {r["id"]: None if r["prev_id"] is None else (r["d"], r["prev_id"]) for r in got} == expected


@pytest.mark.parametrize("tasks", [1, 2, 64])
def test_sliced_predecessors_leave_no_large_group(spark, tasks):
    """With one key holding most rows and ids with large gaps, no window group exceeds the limit."""
    from tenderwatch.operators import scale

    seen = []
    original = scale._lag

    def spy(df, keys, on, row_id):
        seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return original(df, keys, on, row_id)

    df = spark.range(0, 4000, 1, tasks).select(
        F.lit("hot").alias("k"), F.lit("2020-01-01").cast("date").alias("day"), F.monotonically_increasing_id().alias("id")
    )
    scale._lag = spy
    try:
        assert previous_in_key(df, ["k"], "day", "id", 250).where("prev_id IS NULL").count() == 1
    finally:
        scale._lag = original
    assert max(seen) <= 251
