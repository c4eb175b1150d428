"""Planted cases of the operators' semantics."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from harrow.operators import clean as C
from harrow.operators import decision as D
from harrow.operators import ingest as I
from harrow.operators import metrics as M
from harrow.operators import novelty as N
from harrow.operators import split as S
from harrow.operators import warning as W

NOW = dt.datetime(2026, 7, 15, 12)
CLASSES = "class_idx int, class_id string, crop string, name string, category string, agent string, spread_rank int, vector string, etl_threshold double, etl_unit string, urgency string, action string, recheck_hours int, headline string, farmer_message string, flags string, water_status string"


def classes(spark):
    return spark.createDataFrame([
        (0, "fly", "any", "White fly", "pest", None, 3, None, 10.0, "per_leaf", "watch", "count", 24, "h", None, "", None), (1, "blight", "rice", "Blight", "disease", None, 4, "fly", None, None, "warning", "protect", 200, "h", None, "no_overhead", None),
        (2, "ok", "rice", "Healthy", "healthy", None, 0, None, None, None, "none", "go on", 72, "h", None, "", None),
    ], CLASSES)


def detections(spark, plan, class_id="fly", count=None, severity=None, zone="z"):
    rows = [(class_id, "f", zone, 0.9, NOW - dt.timedelta(days=d), severity, count) for d, n in plan for _ in range(n)]
    return spark.createDataFrame(rows, "class_id string, field_id string, zone string, confidence double, ts timestamp_ntz, severity string, count double")


RISING, FALLING = [(9, 1), (7, 1), (3, 4), (1, 6)], [(9, 6), (7, 4), (3, 1), (1, 1)]


def alert(spark, rows, **how):
    got = W.alerts(rows, classes(spark), NOW.isoformat(sep=" "), **how).collect()
    return got[0] if got else None


def test_trend_and_window(spark):
    assert alert(spark, detections(spark, RISING)).trend == "rising" and alert(spark, detections(spark, FALLING)).trend == "falling"
    one = alert(spark, detections(spark, [(1, 1)]))
    assert one.trend == "new" and one.level == "watch"  # watch +1 for confidence and spread, -1 for a single detection
    assert alert(spark, detections(spark, [(20, 5)])) is None and alert(spark, detections(spark, [(-3, 2)])).detections == 2
    assert alert(spark, detections(spark, RISING, "ok")) is None and alert(spark, detections(spark, RISING, "unknown")) is None


def test_threshold_caps_before_a_severe_frame(spark):
    assert alert(spark, detections(spark, RISING, count=20.0)).level == "critical"
    assert alert(spark, detections(spark, RISING, count=5.0)).level == "warning"
    low = detections(spark, RISING, count=5.0, severity="severe")
    assert alert(spark, low).level == "critical" and alert(spark, low, cap_last=True).level == "warning"


def test_retention_counts_two_windows(spark):
    assert W.retained(detections(spark, [(1, 2), (27, 1), (29, 3)]), NOW.isoformat(sep=" ")).count() == 3


def test_infection_runs_are_of_consecutive_readings(spark):
    wet = [(i, "f", NOW + dt.timedelta(hours=i), 16.0, 92.0, 1.0) for i in range(14)]
    dry = [(i, "g", NOW + dt.timedelta(hours=i), 35.0, 30.0, 0.0) for i in range(14)]
    broken = [(i, "h", NOW + dt.timedelta(hours=i), 16.0, 92.0 if i % 4 else 10.0, 1.0) for i in range(14)]
    rules = spark.createDataFrame([("r", "Rule", 10.0, 24.0, 88.0, 10.0, 4)], W.RULES[0])
    rows = spark.createDataFrame(wet + dry + broken, "event_id int, field_id string, ts timestamp_ntz, temp_c double, humidity_pct double, leaf_wetness_hours double")
    runs = W.infection_runs(rows, rules)
    assert {r.field_id: r.best_run for r in runs.collect()} == {"f": 14, "g": 0, "h": 3}
    found = W.infection_alerts(runs, spark.createDataFrame([("r", "blight", 4)], "rule_class string, class_id string, spread_rank int")).collect()
    assert [(r.field_id, r.level) for r in found] == [("f", "critical")]
    camera = W.alerts(detections(spark, RISING, "blight"), classes(spark), NOW.isoformat(sep=" "))
    both = {(r.field_id, r.class_id): r for r in W.combined_risk(camera, spark.createDataFrame(found)).collect()}
    assert both["f", "blight"].signals == "camera+weather" and both["f", "blight"].level == "critical"


def test_constraints_merge(spark):
    rows = spark.createDataFrame([
        ("f", ["no_overhead", "morning_only"], "Blight", None, 24, 3), ("f", ["avoid_stress"], "Mites", "dry", 48, 2), ("f", ["suspend", "drain"], "Water", "waterlogged", 6, 4), ("g", ["avoid_stress"], "Mites", "dry", 48, 1), ("h", [], "None", None, None, 0),
    ], "field_id string, flags array<string>, reason string, water_status string, ttl_hours int, priority int")
    got = {r.field_id: r for r in W.constraint_view(W.merge_constraints(rows)).collect()}
    f = got["f"]
    assert f.flags == ["suspend", "drain", "no_overhead", "morning_only"] and f.overridden == ["avoid_stress"] and f.ttl_hours == 6 and f.priority == 4 and f.water_status is None and f.blocks and f.needs_drainage
    assert f.phrases[0] == "Do not water until this is sorted out." and got["g"].flags == ["avoid_stress"] and got["g"].water_status == "dry" and not got["g"].blocks and got["h"].is_empty and got["h"].ttl_hours == 48


def test_urgency_clamps_each_step(spark):
    rows = spark.createDataFrame([("blight", 0.9, "severe", 0.5, None), ("blight", 0.3, None, 0.01, None), ("fly", 0.7, None, None, "adult"), ("fly", 0.7, None, None, "larva"), ("what", 0.7, None, None, None)], "class_id string, confidence double, severity string, affected_fraction double, life_stage string")
    got = D.advise(rows, classes(spark)).collect()
    assert sorted(r.level for r in got if r.class_id == "blight") == ["critical", "info"]
    by = {(r.class_id, r.life_stage, r.confidence): r for r in got}
    assert by["fly", "adult", 0.7].level == "info" and by["fly", "larva", 0.7].final_action == "treat_affected_plants" and by["what", None, 0.7].final_action == "retake_or_escalate"
    assert by["blight", None, 0.9].ttl_hours == 72 and any("spread by white fly" == n for n in by["blight", None, 0.9].notes) and by["blight", None, 0.3].needs_confirmation


def test_resolution_prefers_qualified_names(spark):
    dim = spark.createDataFrame([(0, "maize__common_rust", "maize", "Common rust", "disease", ""), (1, "soybean__rust", "soybean", "Rust", "disease", "rust"), (2, "maize__healthy", "maize", "Healthy", "healthy", ""), (3, "any__aphid", "any", "Aphid", "pest", "aphids")], "class_idx int, class_id string, crop string, name string, category string, aliases string")
    rows = spark.createDataFrame([("Corn", "Corn___Common_rust_"), ("Corn", "Rust"), ("Soya", "Rust"), ("corn", "fresh"), ("Corn", "Aphids"), ("Corn", "other")], "crop string, label string")
    got = {(r.crop, r.label): r.class_id for r in I.resolve_qualified(rows, dim).collect()}
    assert got == {("Corn", "Corn___Common_rust_"): "maize__common_rust", ("Corn", "Rust"): None, ("Soya", "Rust"): "soybean__rust", ("corn", "fresh"): "maize__healthy", ("Corn", "Aphids"): "any__aphid", ("Corn", "other"): None}
    with pytest.raises(KeyError):
        I.subset(dim, spark.createDataFrame([(0, "nope")], "place int, class_id string"))
    split = spark.createDataFrame([("r", "train/a/x.jpg"), ("r", "Test/a/y.jpg"), ("q", "train/x.jpg"), ("q", "a/x.jpg")], "root string, path string")
    assert sorted(r.path for r in I.without_split_layer(split).collect()) == ["a/x.jpg", "a/x.jpg", "a/y.jpg", "train/x.jpg"]


def test_clean_planted_defects(spark):
    good = [(f"ok{i:02d}", "c", i, True, 100, 100, 20.0, float(i), f"h{i}", 1000 * i % 65536, 777 * i % 65536, 31 * i, 5000 + 64 * i) for i in range(12)]
    bad = [("copy", "c", 20, True, 100, 100, 20.0, 1.0, "h3", 3000, 2331, 93, 5192), ("cross", "d", 21, True, 100, 100, 20.0, 1.0, "h4", 1, 2, 3, 4), ("tiny", "c", 22, True, 5, 100, 20.0, 1.0, "t", 0, 0, 0, 1), ("wide", "c", 23, True, 1000, 100, 20.0, 1.0, "w", 0, 0, 0, 2), ("flat", "c", 24, True, 100, 100, 0.5, 1.0, "b", 0, 0, 0, 3), ("gone", "c", 25, False, 0, 0, 0.0, 0.0, "g", 0, 0, 0, 4),
           ("near1", "c", 30, True, 100, 100, 20.0, 9.0, "n1", 40000, 40001, 40002, 40003), ("near2", "c", 31, True, 100, 100, 20.0, 5.0, "n2", 40000, 40001, 40002, 40007), ("mix1", "c", 32, True, 100, 100, 20.0, 9.0, "m1", 50000, 50001, 50002, 50003), ("mix2", "d", 33, True, 100, 100, 20.0, 5.0, "m2", 50000, 50001, 50002, 50007)]
    rows = spark.createDataFrame(good + bad, "path string, class_id string, source_rank int, ok boolean, width int, height int, std double, sharpness double, content_hash string, h0 int, h1 int, h2 int, h3 int")
    cleaned, _ = C.clean(rows.select("path", "class_id", "source_rank"), rows.drop("class_id", "source_rank"))
    got = {r.path: r.reason for r in cleaned.collect()}
    assert {p: v for p, v in got.items() if v} == {"copy": "exact_duplicate", "cross": "cross_label_duplicate", "tiny": "too_small", "wide": "extreme_aspect", "flat": "blank", "gone": "unreadable", "near2": "near_duplicate", "mix1": "cross_label_duplicate", "mix2": "cross_label_duplicate"}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"p{a:03d}", f"p{b:03d}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150)) if a < b] + [(f"q{i:03d}", f"q{i + 1:03d}") for i in range(40)]
    root = {}
    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.path: r.component for r in C.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {v: find(v) for p in pairs for v in p}
    assert C.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_grouped_split_has_no_leak_and_covers_classes(spark):
    rng = random.Random(1)
    rows = [(f"{c}/{g}/{i}", c, f"{c}-{g}") for c in "abcde" for g in range(rng.choice([1, 2, 3, 20])) for i in range(rng.randrange(1, 5))]
    got = S.group_split(spark.createDataFrame(rows, "path string, class_id string, group_key string")).collect()
    assert len(got) == len(rows)
    groups, splits = defaultdict(set), defaultdict(set)
    for r in got:
        groups[r.group_key].add(r.split)
        splits[r.class_id].add(r.split)
    n = {c: len({g for _, k, g in rows if k == c}) for c in splits}
    assert all(len(s) == 1 for s in groups.values()) and all(splits[c] == {"train", "val", "test"} for c in splits if n[c] >= 3) and all("train" in s for s in splits.values())
    with pytest.raises(ValueError):
        S.group_split(spark.createDataFrame(rows, "path string, class_id string, group_key string"), 0.6, 0.5)


def test_balanced_resample_is_exact(spark):
    rows = [(f"a{i}", "a") for i in range(900)] + [(f"b{i}", "b") for i in range(100)] + [("c", "c")]
    df = spark.createDataFrame(rows, "path string, class_id string")
    got = S.balanced_resample(df).collect()
    counts = {k: sum(r.class_id == k for r in got) for k in "abc"}
    assert len(got) == 1001 and sorted(counts.values()) == [333, 334, 334] and counts["c"] == max(r.copy for r in got)
    assert len({(r.path, r.copy) for r in got}) == 1001 and 240 < len({r.path for r in got if r.class_id == "a"}) < 334
    assert sorted(map(tuple, S.balanced_resample(df.repartition(9)).collect())) == sorted(map(tuple, got)) != sorted(map(tuple, S.balanced_resample(df, seed=1).collect()))
    assert S.balanced_resample(df.limit(0)).collect() == []


def test_metrics_on_small_tables(spark):
    cm = spark.createDataFrame([(0, 0, 9), (0, 1, 1), (1, 0, 1), (2, 2, 0)], "y int, pred int, n int").where("n > 0")
    report = M.class_report(cm, spark.range(3).select(F.col("id").cast("int").alias("class_idx")))
    s = M.report_summary(report).first()
    assert s.accuracy == pytest.approx(9 / 11) and s.seen == 2 and s.balanced_accuracy == pytest.approx(0.45)
    scores = spark.createDataFrame([(0, [1000.0, 0.0]), (1, [0.0, 1000.0]), (None, [1.0, 1.0])], "y int, scores array<double>")
    p = M.predict(scores)
    assert [list(r.p) for r in p.collect()][0] == [1.0, 0.0] and M.topk_accuracy(p, 5, 2).first().accuracy == 1.0
    noisy = spark.createDataFrame([(i % 2 if i % 5 else 1 - i % 2, [8.0, 0.0] if i % 2 == 0 else [0.0, 8.0]) for i in range(400)], "y int, scores array<double>")
    assert 4 < M.fit_temperature(noisy) < 8  # 8 / ln 4
    risk = M.selective_risk(M.predict(noisy))
    pick = M.select_threshold(risk).first()
    assert pick.threshold >= 0.3 and pick.tier == 1
    assert M.select_threshold(risk, most_error=0.5).first().threshold == 0.3


def test_novelty_separates_and_survives_empty_classes(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 12)) * 4
    rows = [(i, i % 3, [float(x) for x in centres[i % 3] + rng.normal(size=12)]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    means, inverse, intensity = N.fit(e)
    cal = N.calibrate(N.mahalanobis(e, means, inverse, "vec_id")).first()
    far = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=12) * 30]) for i in range(50)], "vec_id long, embedding array<double>")
    judged = N.judge(N.mahalanobis(far, means, inverse, "vec_id"), cal.threshold)
    assert judged.where("is_novel").count() > 45 and 0 <= intensity <= 1 and cal.reject_rate < 0.05
    dim = spark.createDataFrame([(i,) for i in range(5)], "label int")
    c = {r.label: list(r["mean"]) for r in N.centroids(e, dim).collect()}
    assert c[3] == c[4] and len(c) == 5
    assert N.judge(judged.select("vec_id", "score"), None).where("is_novel").count() == 0 and N.spread(e.withColumn("embedding", F.array(*[F.lit(1.0)] * 12))).first().degenerate


def test_streams_drop_what_is_later_than_two_windows(spark, tmp_path):
    from harrow.streaming import warning as SW
    from harrow.streaming.run import finish

    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    schema = "class_id string, field_id string, zone string, confidence double, ts timestamp"
    for days in ([60], [60], [1, 40, 61]):  # day 1 comes when the watermark has been at day 32 for a batch
        spark.createDataFrame([("c", "f", "z", 0.9, day(n)) for n in days] + [("c", "f", "z", 0.1, day(61))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finish(SW.daily_counts(SW.intake(rows)), "late", "update", [*SW.KEY, "day"]).collect()
    assert {(r.day - dt.date(2026, 1, 1)).days: r.n for r in got} == {60: 2, 40: 1, 61: 1}


def test_near_pairs_of_large_buckets_equal_brute_force(spark):
    rng = random.Random(5)
    prints = [(f"p{i}", 7, *(rng.randrange(1 << 16) for _ in range(3))) for i in range(2100)]  # one bucket of h0
    prints += [(f"q{i}", h[1], h[2] ^ 1 << rng.randrange(16), h[3] ^ 5, h[4] ^ 2) for i, h in enumerate(prints[:60])]
    prints += [(f"r{i}", 8, 1, 2, i % 3) for i in range(40)] + [("s0", 0, 0, 0, 0), ("s1", 1, 1, 1, 1)]
    df = spark.createDataFrame(prints, "path string, h0 int, h1 int, h2 int, h3 int")
    ints = [(p[0], p[1] << 48 | p[2] << 32 | p[3] << 16 | p[4]) for p in prints]
    want = {(min(p, q), max(p, q)) for i, (p, x) in enumerate(ints) for q, y in ints[:i] if (x ^ y).bit_count() <= 4}
    got = lambda **how: {(r.a, r.b) for r in C.near_pairs(df, **how).collect()}
    assert ("s0", "s1") in want and got(bands=5) == got(bands=5, block_rows=7) == want
    by = {p[0]: p[1:] for p in prints}
    assert got() == got(block_rows=7) == {(p, q) for p, q in want if any(x == y for x, y in zip(by[p], by[q]))} != want
    assert ("p0", "q0") in got() and ("p0", "q0") not in got(largest_bucket=2000)


def test_cleaning_measures_each_asset_once_and_counts_rows_without_a_class(spark):
    """Facts are computed once, whatever is asked of the cleaned rows; before, a filter, a first copy, a print and each count of class_loss() computed them again, and a null class had two rows."""
    rows = spark.createDataFrame([(f"p{i:02d}", None if i % 5 == 0 else "ab"[i % 2], i, i % 8) for i in range(40)], "path string, class_id string, source_rank int, k int").repartition(4)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def measure(k):
        calls.add(1)
        return k

    facts = rows.select("path", F.lit(True).alias("ok"), *[(measure("k") + n).alias(c) for c, n in (("width", 30), ("height", 30))], F.lit(20.0).alias("std"), F.lit(1.0).alias("sharpness"), F.format_string("%d", "source_rank").alias("content_hash"), *[(F.col("k") * 4099 * (j + 1) % 65536).cast("int").alias(f"h{j}") for j in range(4)])
    loss = {r.class_id: (r.dropped, r.kept) for r in C.class_loss(C.clean(rows.drop("k"), facts)[0]).collect()}
    assert sum(map(sum, loss.values())) == 40 and len(loss) == 3 and sum(loss[None]) == 8
    assert calls.value <= 80  # once for each of the two columns
