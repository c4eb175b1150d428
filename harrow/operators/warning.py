"""Early warning from detections and weather, and the field constraints that follow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.runs import empty, merged_array, summary_column
from harrow.operators.decision import ACTIONABLE, FLAGS, advise, bump, display_name, level_name, rank

KEY = ("field_id", "zone", "class_id")
RULES = (
    ("rule_class", "rule", "t_lo", "t_hi", "least_humidity", "least_wet", "least_run"),
    #: Temperature range, relative humidity, wet hours and consecutive readings of each infection window.
    [
        ("tomato__late_blight", "Late blight", 10.0, 24.0, 88.0, 10.0, 4), ("potato__late_blight", "Late blight", 10.0, 24.0, 88.0, 10.0, 4), ("grape__downy_mildew", "Downy mildew", 11.0, 25.0, 85.0, 4.0, 3),
        ("rice__blast", "Rice blast", 20.0, 28.0, 90.0, 8.0, 4), ("wheat__stripe_rust", "Stripe rust", 8.0, 15.0, 85.0, 3.0, 3), ("wheat__leaf_rust", "Leaf rust", 15.0, 22.0, 85.0, 3.0, 3),
        ("maize__northern_leaf_blight", "Northern leaf blight", 18.0, 27.0, 90.0, 6.0, 4), ("chilli__anthracnose", "Anthracnose", 20.0, 30.0, 90.0, 8.0, 4), ("tomato__early_blight", "Early blight", 24.0, 29.0, 85.0, 5.0, 3),
    ],
)


def intake(detections: DataFrame, least=0.5) -> DataFrame:
    """Detections that are sure enough to make a trend."""
    return detections.where(F.col("confidence") >= least)


def since(rows: DataFrame, now: str, days: float, ts="ts") -> DataFrame:
    """Rows of the last days; there is no upper bound, so rows dated later than now count."""
    kind = rows.schema[ts].dataType
    return rows.where(F.col(ts) >= F.lit(now).cast(kind) - F.expr(f"INTERVAL {int(days * 86400)} SECOND"))


def daily_counts(detections: DataFrame, now: str, days=14.0) -> DataFrame:
    """(field_id, zone, class_id, day, n) over the window."""
    return since(detections, now, days).groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def series(daily: DataFrame) -> DataFrame:
    """Each key's counts of its active days, in order. A key has at most one entry a day."""
    return daily.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"].cast("double")).alias("s"))


def ewma(s: Column, alpha=0.4) -> Column:
    """Exponential mean over active days; the first day counts whole."""
    return F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)), lambda a, x: x * alpha + a * (1 - alpha))


def trend(s: Column) -> Column:
    """struct(trend, change): the later half of the active days against the earlier one, in percent."""
    n = F.size(s)
    mid = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    a, b = mean(F.slice(s, F.lit(1), mid)), mean(F.slice(s, mid + 1, F.greatest(n - mid, F.lit(0))))
    change = F.when(n >= 2, F.when((a == 0) & (b == 0), 0.0).when(a == 0, 100.0).otherwise((b - a) / a * 100))
    return F.struct(F.when(n < 2, "new").when(change > 25, "rising").when(change < -25, "falling").otherwise("steady").alias("trend"), change.alias("change"))


def aggregates(detections: DataFrame, now: str, days=14.0) -> DataFrame:
    """One row for each key in the window: detections, active days, mean confidence, first and last seen, mean count, any severe."""
    return since(detections, now, days).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("detections"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.avg("confidence").alias("mean_confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.avg("count").alias("mean_count"), F.bool_or(F.col("severity") == "severe").alias("any_severe"),
    )


def alerts(detections: DataFrame, classes: DataFrame, now: str, days=14.0, least=0.5, alpha=0.4, cap_last=False) -> DataFrame:
    """One alert for each key with an actionable class.

    The level begins with the class's urgency at the mean confidence; then, each clamped: a rising trend adds one; at or over the economic threshold adds one,
    under it caps at warning; a severe frame adds one; a single detection takes one. cap_last moves the cap to the end.
    """
    kept = intake(detections, least)
    daily = series(daily_counts(kept, now, days)).select(*KEY, ewma(F.col("s"), alpha).alias("ewma"), trend(F.col("s")).alias("t"))
    rows = aggregates(kept, now, days).join(daily, list(KEY)).join(classes.where(F.col("category").isin(*ACTIONABLE)).select("class_id"), "class_id", "left_semi")
    rows = rows.withColumns({"confidence": F.col("mean_confidence"), "severity": F.lit(None).cast("string"), "affected_fraction": F.lit(None).cast("double"), "life_stage": F.lit(None).cast("string")})
    rows = advise(rows, classes).withColumn("etl_ratio", F.try_divide("mean_count", F.nullif("etl_threshold", F.lit(0.0))))
    under, warning = F.col("etl_ratio") < 1, F.lit(3)
    r = bump(F.col("urgency_rank"), F.when(F.col("t.trend") == "rising", 1).otherwise(0))
    r = bump(r, F.when(F.col("etl_ratio") >= 1, 1).otherwise(0))
    r = r if cap_last else F.when(under, F.least(r, warning)).otherwise(r)
    r = bump(r, F.when(F.col("any_severe"), 1).otherwise(0))
    r = bump(r, F.when((F.col("detections") == 1) & (F.col("t.trend") == "new"), -1).otherwise(0))
    r = F.when(under, F.least(r, warning)).otherwise(r) if cap_last else r
    percent = lambda c: F.concat(F.round(c).cast("int").cast("string"), F.lit("%"))
    evidence = F.array_compact(F.array(
        F.format_string("%d detection(s) over %d day(s)", "detections", "active_days"), F.when(F.col("t.trend") == "rising", F.concat(F.lit("rising "), percent(F.col("t.change")))).when(F.col("t.trend") == "falling", F.concat(F.lit("falling "), percent(F.abs("t.change")))),
        F.when(F.col("etl_ratio") >= 1, "at or above the economic threshold").when(under, "below the economic threshold"), F.when(F.col("any_severe"), "a frame graded severe"), F.when((F.col("detections") == 1) & (F.col("t.trend") == "new"), "single detection"),
    ))
    message = F.concat(F.col("display"), F.when((F.col("category") == "pest") & (F.col("etl_ratio") >= 1), " has crossed the economic threshold").when(F.col("t.trend") == "rising", " is increasing").otherwise(" detected"), F.format_string(" (%d)", "detections"))
    return rows.withColumn("rank", r).select(
        *KEY, "display", level_name(F.col("rank")).alias("level"), "rank", "detections", "active_days", F.col("t.trend").alias("trend"), F.col("t.change").alias("change"), "ewma", "mean_count", "etl_ratio", "any_severe", "first_seen", "last_seen",
        F.col("final_action").alias("action"), evidence.alias("evidence"), message.alias("message"), F.when(F.col("flags") != "", F.split("flags", ",")).otherwise(F.array().cast("array<string>")).alias("flags"), "water_status", "ttl_hours",
    )


def infection_runs(weather: DataFrame, rules: DataFrame, span="1 hour") -> DataFrame:
    """The longest run of favourable readings of each field and rule, the wet hours over all readings, and the span of the readings; a reading without a value is not favourable.

    Readings are shuffled once, by field and span of time, and each span is reduced to a summary for each rule (functions.runs); the summaries, a row for each span and rule, are then merged in order of
    the spans. So neither a field's history nor a global order is one task's: a task holds the readings of one span of one field, and a field's summaries. Rules are a table that people write; their
    few rows are part of the plan.
    """
    width = int(pd.Timedelta(span).total_seconds())
    reading = F.struct("ts", "event_id", "temp_c", "humidity_pct")
    spans = weather.groupBy("field_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width).alias("_span")).agg(
        F.array_sort(F.collect_list(reading)).alias("_readings"), F.sum("leaf_wetness_hours").alias("_wet"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    known = rules.select("rule_class", "t_lo", "t_hi", "least_humidity").collect()
    good = lambda r: lambda x: (x["temp_c"] >= r["t_lo"]) & (x["temp_c"] <= r["t_hi"]) & (x["humidity_pct"] >= r["least_humidity"])
    each = [F.struct(F.lit(r["rule_class"]).alias("rule_class"), summary_column(F.col("_readings"), good(r)).alias("_s")) for r in known]
    if not each:
        each = [F.struct(F.lit(None).cast("string").alias("rule_class"), empty().alias("_s"))]  # joins no rule
    rows = spans.select("field_id", "_span", "_wet", "_first", "_last", F.explode(F.array(*each)).alias("_e")).select("*", "_e.*")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_span", "_s"))), lambda x: x["_s"])
    runs = rows.groupBy("field_id", "rule_class").agg(F.sum("_wet").alias("wet_hours"), F.min("_first").alias("first_ts"), F.max("_last").alias("last_ts"), merged_array(ordered)["best"].alias("best_run"))
    return runs.join(rules, "rule_class")


def infection_alerts(runs: DataFrame, spread: DataFrame) -> DataFrame:
    """Alerts where the run is long enough; spread (rule_class, class_id, spread_rank) names the rules' classes."""
    met = F.col("wet_hours") >= F.col("least_wet")
    days = (F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / 86400.0
    return runs.where("best_run >= least_run").join(F.broadcast(spread), "rule_class").select("field_id", "class_id", "rule", "best_run", "wet_hours", F.when(met & (F.col("spread_rank") >= 4), "critical").when(met, "warning").otherwise("watch").alias("level"), days.alias("window_days"))


def combined_risk(camera: DataFrame, weather: DataFrame) -> DataFrame:
    """Camera and weather alerts by field and class: where both exist, the higher level and one more.

    Zones of one field are merged first (highest level, detections summed), as two cameras are not two kinds of signal. A pair of different rules for one class is the higher one.
    """
    on = ["field_id", "class_id"]
    c = camera.groupBy(*on).agg(F.max(rank(F.col("level"))).alias("c"), F.sum("detections").alias("detections"))
    w = weather.groupBy(*on).agg(F.max(rank(F.col("level"))).alias("w"))
    both = c.join(w, on, "full_outer")
    r = F.when(F.col("c").isNotNull() & F.col("w").isNotNull(), bump(F.greatest("c", "w"), 1)).otherwise(F.coalesce("c", "w"))
    signals = F.concat_ws("+", F.when(F.col("c").isNotNull(), "camera"), F.when(F.col("w").isNotNull(), "weather"))
    return both.select(*on, level_name(r).alias("level"), F.coalesce("detections", F.lit(0).cast("long")).alias("detections"), signals.alias("signals"))


ORDER = tuple(FLAGS)
VETO, DRAINAGE, HINT = ([f for f, (k, _) in FLAGS.items() if k == kind] for kind in ("veto", "drainage", "hint"))


def _strings(names) -> Column:
    return F.array(*[F.lit(n) for n in names])


def in_order(flags: Column) -> Column:
    """The flags present, each once, in the vocabulary's order."""
    return F.filter(_strings(ORDER), lambda f: F.array_contains(flags, f))


def unknown_flags(rows: DataFrame, flags="flags") -> DataFrame:
    """(flag, n) of flags outside the vocabulary."""
    return rows.select(F.explode(flags).alias("flag")).where(~F.col("flag").isin(*ORDER)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def settle(rows: DataFrame) -> DataFrame:
    """Hints beside a veto or drainage move to overridden; flags lose their repeats and keep their order."""
    flags, wet = F.array_distinct("flags"), F.arrays_overlap("flags", _strings(VETO + DRAINAGE))
    hints = F.array_intersect(flags, _strings(HINT))
    return rows.withColumns({"overridden": F.when(wet, hints).otherwise(F.array().cast("array<string>")), "flags": F.when(wet, F.array_except(flags, _strings(HINT))).otherwise(flags)})


def merge_constraints(rows: DataFrame, by=("field_id",)) -> DataFrame:
    """One constraint for each field: union of flags and reasons, least ttl (48 without any), highest priority, water status if unanimous; settled.

    rows (by..., flags, reason, water_status, ttl_hours, priority). Flags are few by vocabulary; reasons are at most one for each class.
    """
    each = rows.groupBy(*by).agg(
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("flags"), F.sort_array(F.collect_set("reason")).alias("reasons"), F.min("ttl_hours").alias("ttl_hours"), F.max("priority").alias("priority"),
        F.coalesce(F.bool_or(F.col("water_status") == "dry"), F.lit(False)).alias("_dry"), F.coalesce(F.bool_or(F.col("water_status") == "waterlogged"), F.lit(False)).alias("_wet"),
    )
    each = each.withColumns({"flags": in_order(F.col("flags")), "water_status": F.when(F.col("_wet") & ~F.col("_dry"), "waterlogged").when(F.col("_dry") & ~F.col("_wet"), "dry"), "ttl_hours": F.coalesce("ttl_hours", F.lit(48))})
    return settle(each.drop("_dry", "_wet"))


def constraint_view(rows: DataFrame) -> DataFrame:
    """What an irrigation engine asks of settled constraints."""
    kind = lambda *ks: _strings([f for f, (k, _) in FLAGS.items() if k in ks])
    phrases = F.transform(in_order(F.col("flags")), lambda f: F.try_element_at(F.create_map(*[F.lit(x) for f_, (_, p) in FLAGS.items() for x in (f_, p)]), f))
    return rows.withColumns({
        "blocks": F.arrays_overlap("flags", kind("veto")), "needs_drainage": F.arrays_overlap("flags", kind("drainage")), "method_flags": F.array_intersect("flags", kind("method")), "timing_flags": F.array_intersect("flags", kind("timing")),
        "hints": F.array_intersect("flags", kind("hint")), "phrases": phrases, "is_empty": (F.size("flags") == 0) & F.col("water_status").isNull(),
    })


def retained(detections: DataFrame, now: str, days=14.0) -> DataFrame:
    """Detections of the last two windows."""
    return since(detections, now, 2 * days)
