"""State of the streaming operators: what is dropped with the watermark, and results that do not depend on how readings are dealt to batches."""

import datetime as dt
import random
import re
from functools import reduce

import numpy as np
import pytest

from harrow.functions.runs import EMPTY, merged, summary, summary_of
from harrow.operators import warning as W
from harrow.streaming import warning as S
from harrow.streaming.run import rocks

NOW = dt.datetime(2026, 3, 1)
WEATHER = "event_id long, field_id string, ts timestamp, temp_c double, humidity_pct double, leaf_wetness_hours double"
SEEN = "class_id string, field_id string, zone string, confidence double, ts timestamp"
RULES = [("r", "Rule", 10.0, 24.0, 88.0, 10.0, 4), ("cold", "Cold", -5.0, 9.0, 0.0, 1.0, 2)]


def run(spark, folder, batches, schema, operator):
    """(rows that the operator gave, rows in its state at the end), with one file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = []
    stream = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    with rocks(spark):
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: got.append((i, df.collect()))).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for _, rows in sorted(got) for r in rows], q.lastProgress["stateOperators"][0]["numRowsTotal"]


def seen(field, *days):
    return [("c", field, "z", 0.9, NOW + dt.timedelta(days=d)) for d in days]


def test_a_key_without_news_leaves_the_trend_state(spark, tmp_path):
    trends = lambda rows: S.trends(S.intake(rows, late="7 days"), keep_days=14)
    later = [seen("b", 40), seen("b", 41, 41), seen("b", 42)]
    rows, state = run(spark, tmp_path / "both", [seen("a", 0, 1, 1, 2), *later], SEEN, trends)
    _, alone = run(spark, tmp_path / "one", later, SEEN, trends)
    assert state == alone > 0
    last = {r.field_id: r for r in rows}
    assert (last["a"].active_days, last["b"].active_days) == (3, 3) and last["b"].ewma == pytest.approx(0.4 * 1 + 0.6 * (0.4 * 2 + 0.6 * 1)) and last["a"].trend == "rising"


def reading(i, field, hours, good):
    return (i, field, NOW + dt.timedelta(hours=hours), 16.0, 92.0 if good else 20.0, 0.5)


def test_runs_of_a_field_without_readings_leave_the_state(spark, tmp_path):
    infection = lambda rows: S.infection(rows, RULES, late="6 hours", idle="5 days")
    old = [reading(i, "f", i, True) for i in range(30)]
    later = [[reading(100 + i, "g", 24 * 20 + i, True)] for i in range(3)]
    rows, state = run(spark, tmp_path / "both", [old, *later], WEATHER, infection)
    _, alone = run(spark, tmp_path / "one", later, WEATHER, infection)
    assert state == alone > 0
    assert {(r.field_id, r.rule_class): (r.best_run, r.wet_hours) for r in rows} == {("f", "r"): (30, 15.0), ("f", "cold"): (0, 15.0), ("g", "r"): (3, 1.5), ("g", "cold"): (0, 1.5)}


def test_state_does_not_grow_with_what_the_watermark_has_passed(spark, tmp_path):
    infection = lambda rows: S.infection(rows, RULES, late="3 hours", idle="90 days")
    batches = [[reading(10 * b + i, "f", 10 * b + i, True) for i in range(10)] for b in range(6)]
    rows, state = run(spark, tmp_path, batches, WEATHER, infection)
    assert max(r.best_run for r in rows) == 60 and state < 20


def test_stream_runs_equal_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"f{i % 3}", NOW + dt.timedelta(minutes=20 * (i // 2)), rng.choice([16.0, 16.0, 3.0, None]), rng.choice([92.0, 92.0, 92.0, 10.0, None]), rng.choice([0.5, 1.0])) for i in range(150)]
    near = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(300)))  # out of order, within the watermark's lag
    got, _ = run(spark, tmp_path, [near[i:i + 30] for i in range(0, 150, 30)], WEATHER, lambda r: S.infection(r, RULES, late="6 hours"))
    last = {(r.field_id, r.rule_class): (r.best_run, r.wet_hours) for r in got}
    for span in ("1 hour", "1 day", "7 minutes"):
        want = W.infection_runs(spark.createDataFrame(rows, WEATHER), spark.createDataFrame(RULES, W.RULES[0]), span).collect()
        assert last == {(r.field_id, r.rule_class): (r.best_run, r.wet_hours) for r in want} and len(want) == 6


def test_state_has_a_row_for_an_hour_not_for_a_reading(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "f", NOW + dt.timedelta(seconds=9 * i), rng.choice([16.0, 3.0, None]), rng.choice([92.0, None]), rng.choice([0.5, None])) for i in range(1200)]
    got, state = run(spark, tmp_path, [rows[::2], rows[1::2] + rows[:2]], WEATHER, lambda r: S.infection(r, RULES, late="6 hours"))  # two readings come twice
    want = W.infection_runs(spark.createDataFrame(rows, WEATHER), spark.createDataFrame(RULES, W.RULES[0])).collect()
    assert {r.rule_class: (r.best_run, r.wet_hours) for r in got} == {r.rule_class: (r.best_run, r.wet_hours) for r in want} and state < 20


def test_runs_of_no_readings_or_rules(spark):
    weather = spark.createDataFrame([(1, "f", NOW, 16.0, 92.0, 1.0)], WEATHER)
    rules = spark.createDataFrame(RULES, W.RULES[0])
    assert W.infection_runs(weather.limit(0), rules).count() == 0 and W.infection_runs(weather, rules.limit(0)).count() == 0


def test_summaries_of_arrays_are_those_of_flags():
    rng = random.Random(3)
    for n in range(60):
        flags = [rng.random() < 0.6 for _ in range(n % 9)]
        assert summary_of(np.array(flags, bool)) == summary(flags)


def test_merging_summaries_is_associative():
    rng = random.Random(2)
    for _ in range(200):
        flags = [rng.random() < 0.7 for _ in range(rng.randrange(30))]
        cuts = sorted(rng.randrange(len(flags) + 1) for _ in range(3))
        parts = [summary(flags[a:b]) for a, b in zip([0, *cuts], [*cuts, len(flags)])]
        best = max((len(x) for x in "".join("x" if f else " " for f in flags).split()), default=0)
        left, right = reduce(merged, parts, EMPTY), reduce(lambda b, a: merged(a, b), reversed(parts), EMPTY)
        assert left == right == summary(flags) and left[3] == best


def test_pairs_of_a_busy_field_cost_packs(spark, tmp_path):
    """Detections and readings of one field and span are packed in the state, over several batches, and give the pairs of brute force."""
    rng = random.Random(5)
    rows = [(i, rng.choice("cd"), rng.choice(["f", "g", None]), NOW + dt.timedelta(minutes=rng.choice([0, 360, 720, rng.randrange(1500)])), rng.random() < 0.5) for i in range(900)] + [(900, "c", "f", None, True), (901, None, "f", NOW, True), (901, None, "f", NOW, False)]
    schema, got = "event_id long, class_id string, field_id string, ts timestamp, camera boolean", []
    for part in (rows[:700], rows[700:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pairs = S.agree(read.where("camera").select("event_id", "class_id", "field_id", "ts"), read.where("not camera").select("event_id", "field_id", "ts"))
    with rocks(spark):
        q = pairs.writeStream.outputMode("append").foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    state = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    want = [(a, b, c, f) for a, c, f, ts, camera in rows for b, _, g, read, other in rows if camera and not other and f and f == g and ts and read and read <= ts <= read + dt.timedelta(hours=6)]
    order = lambda pairs: sorted(pairs, key=str)
    assert order(tuple(r) for r in got) == order(want) and len(want) > 15_000
    assert state < 100 < len(rows)  # before: a row for each detection and two for each reading


def test_pairs_of_two_packs_do_not_wait_for_each_other(spark):
    """The two packs are unfolded in different pieces of generated code, else all their pairs are held until the last is made."""
    from pyspark.sql import functions as F

    pack = lambda i: F.transform(F.sequence(F.lit(0), F.lit(299)), i)
    met = spark.range(0, 8, 1, 4).select(F.lit("f").alias("field_id"), pack(lambda i: F.struct((i * 1000).alias("us"), (F.col("id") * 300 + i).alias("event_id"), F.lit("c").alias("class_id"))).alias("detections"), pack(lambda i: F.struct((i * 1000).alias("us"), i.cast("long").alias("reading_id"))).alias("readings"))
    pairs = S.unpacked(met)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = re.findall(r"(\*\(\d+\)|[ -]) Generate inline", S.unpacked(met)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(steps) == 2 and steps[0] != steps[1]  # before: one piece
    assert pairs.rdd.getNumPartitions() == 4 and pairs.count() == 8 * 300 * 301 // 2
    assert sorted(r[0] for r in pairs.where("reading_id = 298").select("event_id").collect()) == sorted(i * 300 + j for i in range(8) for j in (298, 299))


def test_packs_are_full_however_many_files_their_rows_come_from(spark, tmp_path):
    schema, met = "event_id long, class_id string, field_id string, ts timestamp", []
    for i in range(6):
        spark.createDataFrame([(10 * i + j, "c", "f", NOW + dt.timedelta(minutes=10 * i + j)) for j in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    with rocks(spark):
        q = S.agree_packed(read(), read().drop("class_id"), most=40).writeStream.foreachBatch(lambda df, i: met.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted({len(m.detections) for m in met}) == [20, 40] and len(met) <= 4  # before: packs of a file each
    pairs = S.unpacked(spark.createDataFrame(met, "field_id string, detections array<struct<us: bigint, event_id: bigint, class_id: string>>, readings array<struct<us: bigint, reading_id: bigint>>"), at_once=7).collect()
    assert sorted((p.event_id, p.reading_id) for p in pairs) == [(d, r) for d in range(60) for r in range(d + 1)]
