"""Running sums, quantiles and what is built on them, against plain Python; reusable pieces of the decisions and reports."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.functions.ranking import quantiles, running
from harrow.operators import decision as D
from harrow.operators import ingest as I
from harrow.operators import metrics as M
from harrow.operators import novelty as N
from harrow.operators import profile as P
from harrow.sources.manifests import read_policy, write_policy


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(50), i, rng.randrange(5)) for i in range(500)] + [(None, 1, 1000, 2), ("a", None, 1001, 3)]
    df = spark.createDataFrame(rows, "g string, k long, i long, n long")
    got = {r.i: (r.before, r.at) for r in running(df, [F.col("g").asc_nulls_last(), F.desc("k"), "i"], before=F.col("n"), at=F.lit(1)).collect()}
    total = 0
    for at, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -(r[1] if r[1] is not None else -1), r[2]))):
        assert got[r[2]] == (total, at)
        total += r[3]
    assert running(df.limit(0), ["i"], at=F.lit(1)).collect() == []


@pytest.mark.parametrize("copies", [1, 7])
def test_quantiles(spark, copies):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=311).tolist() * copies, "b": [3.0] * 40, "c": [1.5]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("a", None), ("d", None)]
    at = {"low": 0.05, "mid": 0.5, "high": 0.975, "all": 1.0}
    got = {r.name: r for r in quantiles(spark.createDataFrame(rows, "name string, x double"), at).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k].n == len(xs) and [got[k][q] for q in at] == pytest.approx(np.quantile(xs, list(at.values())).tolist())


def test_gini_and_top_bottom(spark):
    counts = [("c%02d" % i, n) for i, n in enumerate([5, 5, 5, 1, 9, 30, 2, 2, 7, 100, 1, 4])]
    df = spark.createDataFrame(counts, "class_id string, n long")
    x = np.sort([n for _, n in counts])
    assert P.gini(df).first().gini == pytest.approx(2 * (np.arange(1, 13) @ x) / (12 * x.sum()) - 13 / 12)
    got = {r.class_id: (r.top, r.bottom) for r in P.top_bottom(df, 3).collect()}
    top, bottom = (sorted(counts, key=lambda c: (s * c[1], c[0])) for s in (-1, 1))
    assert got == {c[0]: (top.index(c) + 1, bottom.index(c) + 1) for c in counts if top.index(c) < 3 or bottom.index(c) < 3}


def test_split_layer_goes_only_where_all_folders_are_splits(spark):
    paths = spark.createDataFrame([("r", "train/x/1.jpg"), ("r", "Val/x/2.jpg"), ("s", "train/x/1.jpg"), ("s", "other/x/2.jpg"), (None, "test/y.jpg")], "root string, path string")
    assert sorted(r.path for r in I.without_split_layer(paths).collect()) == ["other/x/2.jpg", "train/x/1.jpg", "x/1.jpg", "x/2.jpg", "y.jpg"]


def test_refit_by_version(spark):
    rng = np.random.default_rng(3)
    rows = [("v1", i, i % 3, (rng.normal(size=6) * 0.05 + (i % 3)).tolist()) for i in range(300)] + [("v2", i, i % 4, rng.normal(size=4).tolist()) for i in range(7)]
    got = {r.version: r for r in N.refit(spark.createDataFrame(rows, "version string, id long, label int, embedding array<double>"), "id").collect()}
    assert (got["v1"].classes, got["v1"].n, got["v1"].enough, got["v1"].verdict) == (3, 300, True, "separates") and not got["v2"].enough
    x = np.array([r[3] for r in rows if r[0] == "v1"])
    y = np.array([r[2] for r in rows if r[0] == "v1"])
    mu = np.array([x[y == k].mean(0) for k in range(3)])
    c = x - mu[y]
    cov = c.T @ c / (300 - 3)
    m = np.trace(cov) / 6
    delta = (np.sum(cov**2) - 6 * m * m) / 6
    beta = max(0, min(delta, (np.mean(np.sum(c**2, 1) ** 2) - np.sum(cov**2)) / (300 * 6)))
    inverse = np.linalg.inv((1 - beta / delta) * cov + beta / delta * m * np.eye(6))
    d = np.min([np.einsum("ij,jk,ik->i", x - k, inverse, x - k) for k in mu], 0)
    assert got["v1"].shrinkage == pytest.approx(beta / delta) and got["v1"].threshold == pytest.approx(np.quantile(d, 0.975)) and got["v1"].in_reject == pytest.approx(np.mean(d > np.quantile(d, 0.975)))


def test_refit_in_one_pass_equals_each_version_on_its_own(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(v, i, i % 4, (rng.standard_normal(d) + 3 * (i % 4 == np.arange(d) % 4) + 5).tolist()) for v, d in (("a", 6), ("b", 9), ("c", 6)) for i in range(120)] + [("lone", 1, 0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "version string, id long, label int, embedding array<double>").repartition(7)
    fitted = N.fit_versions(df, fan_in=2)
    assert set(fitted) == {"a", "b", "c", "lone"} and fitted["lone"][3:] == (1.0, 1)
    for v in "abc":
        means, inverse, intensity = N.fit(df.where(F.col("version") == v).drop("version"))
        labels, mu, mine, shrink, n = fitted[v]
        assert labels == [0, 1, 2, 3] and n == 120 and shrink == pytest.approx(intensity, rel=1e-9) and np.allclose(mine, inverse, rtol=1e-8)
        assert np.allclose(mu, np.array([list(r["mean"]) for r in means.orderBy("label").collect()]))
    one = N.grouped_moments(df, most_bytes=1).orderBy("version", "label").collect()
    whole = N.grouped_moments(df.coalesce(1)).orderBy("version", "label").collect()
    assert len(one) == 13 and all(np.allclose(np.frombuffer(a.m), np.frombuffer(b.m)) for a, b in zip(one, whole))
    x = N.noise(np.arange(5000), 8, 3)
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02 and (N.noise(np.arange(10), 8, 3) == x[:10]).all()


def test_retuned_policy_is_written(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        y = int(rng.integers(5))
        s = rng.normal(size=5)
        s[y] += 1.0
        rows.append((i, y, (s * 6).tolist()))
    scored = spark.createDataFrame(rows, "id long, y int, scores array<double>")
    back = write_policy(M.retune(scored), str(tmp_path / "policy")).first()
    s, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])

    def loss(t):
        z = (s - s.max(1, keepdims=True)) / t
        return np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(400), y])

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4000))
    best = grid[np.argmin([loss(t) for t in grid])]
    assert back.temperature == pytest.approx(best, rel=0.02)
    fine = best * np.exp(np.linspace(-2e-3, 2e-3, 4001))
    assert back.temperature == pytest.approx(fine[np.argmin([loss(t) for t in fine])], rel=2e-6)
    assert back.temperature == pytest.approx(M.fit_temperature(scored, most_passes=20, tolerance=1e-14), rel=1e-9)
    write_policy(M.retune(scored), str(tmp_path / "policy"))
    assert read_policy(spark, str(tmp_path / "policy")).count() == 1
    classes = spark.createDataFrame([(i, i % 2, f"c{i}") for i in range(5)], "class_idx int, category int, class_id string")
    report = M.evaluation(M.predict(scored, float(best)), classes, 5).first()
    right = s.argmax(1)
    assert report.accuracy == pytest.approx(np.mean(right == y)) and report.category_accuracy == pytest.approx(np.mean(right % 2 == y % 2)) and report.rate == pytest.approx(np.mean(right % 2 != y % 2))


def test_notes_and_heads(spark):
    rows = spark.createDataFrame([("below threshold", "pest", 0.5, "a", 0.25, None, None), ("novel", "pest", 0.9, "b", 0.1, "c", 0.05), ("small margin", "healthy", 0.9, "d", 0.2, "e", 0.1)], "reason string, category string, p double, n1 string, p1 double, n2 string, p2 double")
    heads = D.gated_heads(F.col("category"), F.lit(2), F.lit(1))
    got = rows.select(D.category_note(F.col("reason"), F.col("category"), F.col("p")), heads[0], heads[1], D.closest_note([F.col("n1"), F.col("n2")], [F.col("p1"), F.col("p2")])).collect()
    assert [tuple(r) for r in got] == [("treat as a pest problem", 2, 1, "Closest matches: a (25%)."), ("", 2, 1, "Closest matches: b (10%), c (5%)."), ("", None, None, "Closest matches: d (20%), e (10%).")]


def test_constraints_expire_on_a_stream(spark, tmp_path):
    from harrow.streaming import warning as S
    from harrow.streaming.run import finish

    day = dt.datetime(2024, 1, 1)
    rows = [("f1", day, 6), ("f1", day, 72), ("f2", day, 6), ("f3", day + dt.timedelta(days=3), 6)]
    spark.createDataFrame(rows, "field_id string, ts timestamp, ttl_hours int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("field_id string, ts timestamp, ttl_hours int").parquet(str(tmp_path / "in"))
    got = {r.field_id: (r.live, r.next_end) for r in finish(S.expiring(stream), "expiring", "update", ["field_id"]).collect()}
    assert got == {"f1": (1, day + dt.timedelta(hours=72)), "f2": (0, None), "f3": (1, day + dt.timedelta(days=3, hours=6))}


def test_temperature_at_the_ends_and_of_nothing(spark):
    sure = spark.createDataFrame([(i, i % 3, [4.0 * (k == i % 3) for k in range(3)]) for i in range(30)], "id long, y int, scores array<double>")
    wrong = spark.createDataFrame([(i, (i + 1) % 3, [4.0 * (k == i % 3) for k in range(3)]) for i in range(30)], "id long, y int, scores array<double>")
    assert M.fit_temperature(sure) == 0.05 and M.fit_temperature(wrong) == 20.0 and M.fit_temperature(sure.withColumn("y", F.lit(None).cast("int"))) == 1.0
    passes = []
    before = M.loss_slopes
    try:
        M.loss_slopes = lambda df, b: passes.append(len(b)) or before(df, b)
        M.fit_temperature(sure.union(wrong.limit(7)))
    finally:
        M.loss_slopes = before
    assert passes[0] == 12 and len(passes) <= 6


def test_ends_and_latencies_of_nothing(spark):
    assert P.top_bottom(spark.createDataFrame([], "class_id string, n long")).collect() == []
    assert M.latency_summary(spark.createDataFrame([], "run string, latency_ms double")).collect() == []
    one = M.latency_summary(spark.createDataFrame([("a", 5.0), ("b", 2.0), ("b", 2.0), ("b", 9.0)], "run string, latency_ms double")).orderBy("run").collect()
    assert [(r.p50, r.p99, r.n) for r in one] == [(5.0, 5.0, 1), (2.0, 9.0, 3)]
