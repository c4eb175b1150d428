"""Profiles from merged sketches against the exact ones, within the stated errors."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import sketches as K
from harrow.sources.versions import current, merge_batch

AT = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
MEASURES, KEYS = ("size", "side"), ("label", "digest")


def parts(rows):
    return K.parts(rows, ["day"], {c: F.col(c) for c in MEASURES}, {c: F.col(c) for c in KEYS})


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = [(f"day{i % 7}", int(rng.lognormvariate(6, 1.5)), None if i % 11 == 0 else rng.choice([64.0, 224.0, 512.0, float("nan")]), f"c{i % 37}", str(rng.randrange(9000))) for i in range(30_000)]
    return spark.createDataFrame(data, "day string, size long, side double, label string, digest string").cache()


def rank(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def check(profile, data):
    got = {r["name"]: r for r in K.quantiles_of(profile, list(MEASURES), AT).collect()}
    for name in MEASURES:
        values = [r[name] for r in data if r[name] is not None and r[name] == r[name]]
        assert got[name].n == len(values) and got[name].least == min(values) and got[name].most == max(values) and got[name]["mean"] == pytest.approx(sum(values) / len(values))
        for a, q in AT.items():
            low, high = rank(values, got[name][a])
            assert low - K.RANK_ERROR[200] <= q <= high + K.RANK_ERROR[200]
    for r in K.distinct_of(profile, list(KEYS)).collect():
        assert r.different == pytest.approx(len({x[r["name"]] for x in data}), rel=K.DISTINCT_ERROR[12])


def test_halves_merged_are_the_whole(rows):
    data = rows.collect()
    found = parts(rows)
    assert found.count() == 7
    check(K.merged(found, list(MEASURES), list(KEYS)), data)
    half = F.col("day").isin("day0", "day3", "day5").alias("half")
    halves = K.merged(found.withColumn("half", half), list(MEASURES), list(KEYS), ("half",))
    check(K.merged(halves, list(MEASURES), list(KEYS)), data)
    check(halves.where("half"), [r for r in data if r.day in ("day0", "day3", "day5")])


def test_a_part_is_replaced_in_a_kept_profile(spark, rows, tmp_path):
    path = str(tmp_path / "profile")
    merge_batch(parts(rows), 0, path, ["day"])
    again = rows.where("day = 'day2'").limit(100).cache()
    merge_batch(parts(again), 1, path, ["day"])
    check(K.merged(current(spark, path), list(MEASURES), list(KEYS)), [r for r in rows.collect() if r.day != "day2"] + again.collect())


def test_nothing_to_profile(spark, rows):
    none = K.merged(parts(rows.limit(0)), list(MEASURES), list(KEYS))
    nulls = K.merged(parts(rows.limit(3).withColumns({"size": F.lit(None).cast("long"), "side": F.lit(float("nan"))})), list(MEASURES), list(KEYS))
    assert {(r.n, r.p50, r.least) for r in K.quantiles_of(nulls, list(MEASURES), AT).collect()} == {(0, None, None)}
    assert all(r.n in (0, None) and r.p50 is None for r in K.quantiles_of(none, list(MEASURES), AT).collect())
