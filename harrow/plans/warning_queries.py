"""Queries of early warning, constraints and advisories over the event stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import decision as D
from harrow.operators import warning as W
from harrow.plans.registry import query
from harrow.plans.views import EVENT_CLASSES, NOW, dim, sql, table, view

WINDOW = f"ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY"
#: Which stand-in class has which infection rule, with its spread.
RULE_CLASSES = (("rule_class", "class_id", "spread_rank"), [("tomato__late_blight", "view", 4), ("rice__blast", "error", 1), ("wheat__stripe_rust", "purchase", 3), ("chilli__anthracnose", "click", 2)])


def detections(spark, sf_dir):
    return view(spark, sf_dir, "detections")


def classes(spark):
    return dim(spark, EVENT_CLASSES)


def live(spark, sf_dir):
    return W.alerts(detections(spark, sf_dir), classes(spark), NOW)


KEPT = "SELECT * FROM detections WHERE confidence >= 5e-1"
DAILY = f"SELECT field_id, zone, class_id, CAST(ts AS DATE) AS day, count(*) AS n FROM kept WHERE {WINDOW} GROUP BY ALL"
NUMBERED = "SELECT *, row_number() OVER k AS i, count(*) OVER (PARTITION BY field_id, zone, class_id) AS m FROM daily WINDOW k AS (PARTITION BY field_id, zone, class_id ORDER BY day)"
EWMA = "SELECT field_id, zone, class_id, sum(n * CASE WHEN i = 1 THEN pow(6e-1, m - 1) ELSE 4e-1 * pow(6e-1, m - i) END) AS ewma FROM numbered GROUP BY ALL"
HALVES = "SELECT field_id, zone, class_id, m, avg(n) FILTER (WHERE i <= greatest(1, m // 2)) AS a, avg(n) FILTER (WHERE i > greatest(1, m // 2)) AS b FROM numbered GROUP BY ALL"
TREND = "SELECT *, CASE WHEN m >= 2 THEN CASE WHEN a = 0 AND b = 0 THEN 0e0 WHEN a = 0 THEN 1e2 ELSE (b - a) / a * 100 END END AS change FROM halves"
TRENDS = "SELECT field_id, zone, class_id, CASE WHEN m < 2 THEN 'new' WHEN change > 25 THEN 'rising' WHEN change < -25 THEN 'falling' ELSE 'steady' END AS trend, change FROM trend0"
AGGS = f"SELECT field_id, zone, class_id, count(*)::BIGINT AS detections, count(DISTINCT CAST(ts AS DATE))::BIGINT AS active_days, avg(confidence) AS mean_confidence, min(ts) AS first_seen, max(ts) AS last_seen, avg(count) AS mean_count, bool_or(severity = 'severe') AS any_severe FROM kept WHERE {WINDOW} GROUP BY ALL"
BASE = sql("detections", kept=KEPT, daily=DAILY, numbered=NUMBERED)
RANK = "list_position(['none', 'info', 'watch', 'warning', 'critical'], {}) - 1"
NAME = "(['none', 'info', 'watch', 'warning', 'critical'])[{} + 1]"
STEP = "least(4, greatest(0, {} + {}))"
ALERT_SQL = sql(
    "detections", "event_classes", kept=KEPT, daily=DAILY, numbered=NUMBERED, ewma=EWMA, halves=HALVES, trend0=TREND, trends=TRENDS, aggs=AGGS,
    a0=f"""SELECT a.*, t.trend, t.change, e.ewma, c.crop, c.name, c.category, c.spread_rank, c.action, c.flags, c.water_status, c.recheck_hours, a.mean_count / nullif(c.etl_threshold, 0) AS etl_ratio, {RANK.format('c.urgency')} AS r
      FROM aggs a JOIN trends t USING (field_id, zone, class_id) JOIN ewma e USING (field_id, zone, class_id) JOIN event_classes c USING (class_id) WHERE c.category IN ('disease', 'pest', 'deficiency', 'abiotic')""",
    a1="SELECT * EXCLUDE r, least(4, greatest(0, r + CASE WHEN mean_confidence < 55e-2 THEN -1 WHEN mean_confidence >= 85e-2 AND spread_rank >= 3 THEN 1 ELSE 0 END)) AS r FROM a0",
    a2="SELECT * EXCLUDE r, least(4, r + CASE WHEN trend = 'rising' THEN 1 ELSE 0 END) AS r FROM a1",
    a3="SELECT * EXCLUDE r, CASE WHEN etl_ratio >= 1 THEN least(4, r + 1) WHEN etl_ratio < 1 THEN least(r, 3) ELSE r END AS r FROM a2",
    a4="SELECT * EXCLUDE r, least(4, r + CASE WHEN any_severe THEN 1 ELSE 0 END) AS r FROM a3",
    alert="SELECT * EXCLUDE r, CAST(greatest(0, r - CASE WHEN detections = 1 AND trend = 'new' THEN 1 ELSE 0 END) AS INT) AS rank FROM a4",
)


@query(BASE + "SELECT field_id, zone, class_id, day, n::BIGINT AS n FROM daily")
def daily_counts(spark, sf_dir):
    return W.daily_counts(W.intake(detections(spark, sf_dir)), NOW)


def _series(spark, sf_dir):
    return W.series(daily_counts(spark, sf_dir))


@query(sql("detections", kept=KEPT, daily=DAILY, numbered=NUMBERED, e=EWMA) + "SELECT field_id, zone, class_id, round(ewma, 6) AS ewma FROM e")
def ewma(spark, sf_dir):
    return _series(spark, sf_dir).select(*W.KEY, F.round(W.ewma(F.col("s")), 6).alias("ewma"))


@query(sql("detections", kept=KEPT, daily=DAILY, numbered=NUMBERED, halves=HALVES, trend0=TREND, t=TRENDS) + "SELECT field_id, zone, class_id, trend, round(change, 4) AS change FROM t")
def trend(spark, sf_dir):
    return _series(spark, sf_dir).select(*W.KEY, W.trend(F.col("s")).alias("t")).select(*W.KEY, "t.trend", F.round("t.change", 4).alias("change"))


@query(sql("detections", kept=KEPT, a=AGGS) + "SELECT field_id, zone, class_id, detections, active_days, round(mean_confidence, 9) AS mean_confidence, first_seen, last_seen, round(mean_count, 6) AS mean_count, any_severe FROM a")
def alert_aggs(spark, sf_dir):
    return W.aggregates(W.intake(detections(spark, sf_dir)), NOW).withColumns({"mean_confidence": F.round("mean_confidence", 9), "mean_count": F.round("mean_count", 6)})


@query(ALERT_SQL + "SELECT field_id, zone, class_id, round(etl_ratio, 6) AS etl_ratio FROM alert WHERE etl_ratio IS NOT NULL")
def etl_ratio(spark, sf_dir):
    return live(spark, sf_dir).where("etl_ratio IS NOT NULL").select(*W.KEY, F.round("etl_ratio", 6).alias("etl_ratio"))


@query(ALERT_SQL + f"SELECT field_id, zone, class_id, {NAME.format('rank')} AS level, rank FROM alert")
def alert_level(spark, sf_dir):
    return live(spark, sf_dir).select(*W.KEY, "level", "rank")


DISPLAY = "CASE WHEN crop = 'any' THEN name ELSE upper(crop[1]) || crop[2:] || ' - ' || name END"


@query(ALERT_SQL + f"""SELECT field_id, zone, class_id, concat_ws('; ', detections || ' detection(s) over ' || active_days || ' day(s)',
  CASE trend WHEN 'rising' THEN 'rising ' || round(change)::INT || '%' WHEN 'falling' THEN 'falling ' || round(abs(change))::INT || '%' END, CASE WHEN etl_ratio >= 1 THEN 'at or above the economic threshold' WHEN etl_ratio < 1 THEN 'below the economic threshold' END,
  CASE WHEN any_severe THEN 'a frame graded severe' END, CASE WHEN detections = 1 AND trend = 'new' THEN 'single detection' END) AS evidence,
  {DISPLAY} || CASE WHEN category = 'pest' AND etl_ratio >= 1 THEN ' has crossed the economic threshold' WHEN trend = 'rising' THEN ' is increasing' ELSE ' detected' END || ' (' || detections || ')' AS message FROM alert""")
def alert_text(spark, sf_dir):
    return live(spark, sf_dir).select(*W.KEY, F.array_join("evidence", "; ").alias("evidence"), "message")


@query(ALERT_SQL + f"SELECT field_id, zone, class_id, {NAME.format('rank')} AS level, detections, trend, round(ewma, 6) AS ewma, round(etl_ratio, 6) AS etl_ratio, dense_rank() OVER (PARTITION BY field_id ORDER BY rank DESC, detections DESC)::INT AS place FROM alert")
def alerts(spark, sf_dir):
    from pyspark.sql import Window

    place = F.dense_rank().over(Window.partitionBy("field_id").orderBy(F.col("rank").desc(), F.col("detections").desc()))
    return live(spark, sf_dir).select(*W.KEY, "level", "detections", "trend", F.round("ewma", 6).alias("ewma"), F.round("etl_ratio", 6).alias("etl_ratio"), place.alias("place"))


def _rules(spark):
    return dim_of(spark, W.RULES)


def dim_of(spark, rows):
    names, data = rows
    return spark.createDataFrame(data, list(names))


def _rule_values():
    names, rows = W.RULES
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


RULE_DIM = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in RULE_CLASSES[1]) + ") AS t(rule_class, class_id, spread_rank)"
RUNS = sql(
    "weather", rules=_rule_values(), num="SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY ts, event_id) AS i FROM weather", spans="SELECT field_id, sum(leaf_wetness_hours) AS wet_hours, min(ts) AS first_ts, max(ts) AS last_ts FROM weather GROUP BY 1",
    good="SELECT field_id, rule_class, i - row_number() OVER (PARTITION BY field_id, rule_class ORDER BY i) AS g FROM num JOIN rules ON temp_c BETWEEN t_lo AND t_hi AND humidity_pct >= least_humidity",
    best="SELECT field_id, rule_class, max(n) AS best_run FROM (SELECT field_id, rule_class, g, count(*) AS n FROM good GROUP BY ALL) GROUP BY ALL",
    runs="SELECT s.*, r.*, coalesce(b.best_run, 0)::BIGINT AS best_run FROM spans s CROSS JOIN rules r LEFT JOIN best b ON b.field_id = s.field_id AND b.rule_class = r.rule_class", rc=RULE_DIM,
    infection="SELECT field_id, class_id, rule, best_run, wet_hours, CASE WHEN wet_hours >= least_wet AND spread_rank >= 4 THEN 'critical' WHEN wet_hours >= least_wet THEN 'warning' ELSE 'watch' END AS level, (epoch(last_ts)::BIGINT - epoch(first_ts)::BIGINT) / 86400.0 AS window_days FROM runs JOIN rc USING (rule_class) WHERE best_run >= least_run",
)


def _runs(spark, sf_dir):
    return W.infection_runs(view(spark, sf_dir, "weather"), _rules(spark))


def _infection(spark, sf_dir):
    return W.infection_alerts(_runs(spark, sf_dir), dim_of(spark, RULE_CLASSES))


@query(RUNS + "SELECT field_id, rule_class, best_run, wet_hours FROM runs")
def infection_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("field_id", "rule_class", "best_run", "wet_hours")


@query(RUNS.replace("epoch(last_ts)::BIGINT", "floor(epoch(last_ts))").replace("epoch(first_ts)::BIGINT", "floor(epoch(first_ts))") + "SELECT field_id, class_id, rule, best_run, wet_hours, level, round(window_days, 4) AS window_days FROM infection")
def infection_alerts(spark, sf_dir):
    return _infection(spark, sf_dir).withColumn("window_days", F.round("window_days", 4))


@query(ALERT_SQL + ", " + RUNS[5:] + f""", cam AS (SELECT field_id, class_id, max(rank) AS c, sum(detections)::BIGINT AS detections FROM alert GROUP BY ALL),
wea AS (SELECT field_id, class_id, max({RANK.format('level')}) AS w FROM infection GROUP BY ALL)
SELECT field_id, class_id, {NAME.format('CASE WHEN c IS NOT NULL AND w IS NOT NULL THEN least(4, greatest(c, w) + 1) ELSE coalesce(c, w) END')} AS level, coalesce(detections, 0) AS detections,
concat_ws('+', CASE WHEN c IS NOT NULL THEN 'camera' END, CASE WHEN w IS NOT NULL THEN 'weather' END) AS signals FROM cam FULL JOIN wea USING (field_id, class_id)""")
def combined_risk(spark, sf_dir):
    return W.combined_risk(live(spark, sf_dir), _infection(spark, sf_dir))


@query(sql("detections") + f"SELECT field_id, count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 28 DAY)::BIGINT AS kept, count(*) FILTER (WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 28 DAY)::BIGINT AS removed FROM detections GROUP BY 1")
def retention(spark, sf_dir):
    rows = detections(spark, sf_dir)
    return rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).join(W.retained(rows, NOW).groupBy("field_id").agg(F.count(F.lit(1)).alias("kept")), "field_id", "left").select("field_id", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0).cast("long"))).alias("removed"))


#: A constraint for each detection: the class's flags, plus a wrong one for a few, for the checks.
CONSTRAINTS = sql("detections", "event_classes", raw="SELECT event_id, field_id, name AS reason, CASE WHEN flags = '' THEN [] ELSE string_split(flags, ',') END AS flags, water_status, least(recheck_hours, 72) AS ttl_hours, event_id % 5 AS priority, ts FROM detections JOIN event_classes USING (class_id)")


def constraints(spark, sf_dir):
    flags = F.when(F.col("flags") != "", F.split("flags", ",")).otherwise(F.array().cast("array<string>"))
    return detections(spark, sf_dir).join(F.broadcast(classes(spark)), "class_id").select("event_id", "field_id", F.col("name").alias("reason"), flags.alias("flags"), "water_status", F.least("recheck_hours", F.lit(72)).alias("ttl_hours"), (F.col("event_id") % 5).alias("priority"), "ts")


@query(CONSTRAINTS + "SELECT f AS flag, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN event_id % 50 = 0 THEN list_append(flags, 'no_overhed') ELSE flags END) AS f FROM raw) WHERE f = 'no_overhed' GROUP BY 1")
def flag_check(spark, sf_dir):
    rows = constraints(spark, sf_dir).withColumn("flags", F.when(F.col("event_id") % 50 == 0, F.array_append("flags", F.lit("no_overhed"))).otherwise(F.col("flags")))
    return W.unknown_flags(rows)


@query(CONSTRAINTS + """, pairs AS (SELECT a.field_id, a.event_id, list_distinct(list_concat(a.flags, CASE WHEN a.event_id % 3 = 0 THEN ['avoid_stress'] ELSE [] END)) AS f FROM raw a)
SELECT event_id, array_to_string(list_sort(CASE WHEN list_has_any(f, ['suspend', 'drain']) THEN list_filter(f, lambda x: x <> 'avoid_stress') ELSE f END), ',') AS flags, CASE WHEN list_has_any(f, ['suspend', 'drain']) AND list_contains(f, 'avoid_stress') THEN 'avoid_stress' ELSE '' END AS overridden FROM pairs""")
def flag_settle(spark, sf_dir):
    rows = constraints(spark, sf_dir).withColumn("flags", F.when(F.col("event_id") % 3 == 0, F.array_append("flags", F.lit("avoid_stress"))).otherwise(F.col("flags")))
    return W.settle(rows).select("event_id", F.array_join(F.sort_array("flags"), ",").alias("flags"), F.array_join("overridden", ",").alias("overridden"))


VOCABULARY = ", ".join(f"'{f}'" for f in D.FLAGS)
MERGED = CONSTRAINTS + f""", exploded AS (SELECT field_id, unnest(flags) AS f FROM raw),
fl AS (SELECT field_id, list(DISTINCT f) AS f FROM exploded GROUP BY 1),
m AS (SELECT r.field_id, any_value(coalesce(fl.f, [])) AS f, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, min(ttl_hours) AS ttl_hours, max(priority) AS priority, bool_or(coalesce(water_status, '') = 'dry') AS dry, bool_or(coalesce(water_status, '') = 'waterlogged') AS wet FROM raw r LEFT JOIN fl USING (field_id) GROUP BY 1),
merged AS (SELECT field_id, list_filter([{VOCABULARY}], lambda x: list_contains(f, x) AND NOT (x = 'avoid_stress' AND list_has_any(f, ['suspend', 'drain']))) AS flags, CASE WHEN list_contains(f, 'avoid_stress') AND list_has_any(f, ['suspend', 'drain']) THEN 'avoid_stress' ELSE '' END AS overridden,
  reasons, ttl_hours, priority, CASE WHEN wet AND NOT dry THEN 'waterlogged' WHEN dry AND NOT wet THEN 'dry' END AS water_status FROM m)
"""


@query(MERGED + "SELECT field_id, array_to_string(flags, ',') AS flags, overridden, reasons, ttl_hours, priority, water_status FROM merged")
def constraint_merge(spark, sf_dir):
    return W.merge_constraints(constraints(spark, sf_dir)).select("field_id", F.array_join("flags", ",").alias("flags"), F.array_join("overridden", ",").alias("overridden"), F.array_join("reasons", ",").alias("reasons"), "ttl_hours", "priority", "water_status")


@query(MERGED + """SELECT field_id, list_contains(flags, 'suspend') AS blocks, list_contains(flags, 'drain') AS needs_drainage, array_to_string(list_filter(flags, lambda x: x IN ('no_overhead', 'prefer_furrow')), ',') AS method_flags,
array_to_string(list_filter(flags, lambda x: x IN ('morning_only', 'no_evening', 'short_frequent', 'alternate_wet_dry', 'no_late_season')), ',') AS timing_flags, len(flags)::INT AS n_phrases, len(flags) = 0 AND water_status IS NULL AS is_empty FROM merged""")
def constraint_view(spark, sf_dir):
    rows = W.constraint_view(W.merge_constraints(constraints(spark, sf_dir)))
    return rows.select("field_id", "blocks", "needs_drainage", F.array_join("method_flags", ",").alias("method_flags"), F.array_join("timing_flags", ",").alias("timing_flags"), F.size("phrases").alias("n_phrases"), "is_empty")


@query(CONSTRAINTS + f"SELECT field_id, count(*)::BIGINT AS live FROM raw WHERE ts + ttl_hours * INTERVAL 1 HOUR > TIMESTAMP '{NOW}' - INTERVAL 1 DAY GROUP BY 1")
def live_constraints(spark, sf_dir):
    ends = F.col("ts") + F.make_dt_interval(hours=F.col("ttl_hours"))
    return constraints(spark, sf_dir).where(ends > F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")).groupBy("field_id").agg(F.count(F.lit(1)).alias("live"))


#: Inputs of an advisory that vary with the event.
SINGLE_SQL = sql("detections", "event_classes", x="SELECT event_id, class_id, confidence, severity, CASE WHEN event_id % 3 = 0 THEN (event_id % 20) / 100 END AS affected_fraction, CASE event_id % 5 WHEN 0 THEN 'egg' WHEN 1 THEN 'larva' WHEN 2 THEN 'adult' WHEN 3 THEN 'pupa' END AS life_stage FROM detections",
  k="SELECT x.*, c.* EXCLUDE class_id, v.name AS vector_name, c.category IN ('disease', 'pest', 'deficiency', 'abiotic') AS acts FROM x LEFT JOIN event_classes c USING (class_id) LEFT JOIN event_classes v ON v.class_id = c.vector",
  u1=f"SELECT *, least(4, greatest(0, {RANK.format('urgency')} + CASE WHEN confidence < 55e-2 THEN -1 WHEN confidence >= 85e-2 AND spread_rank >= 3 THEN 1 ELSE 0 END)) AS r1 FROM k",
  u2="SELECT *, least(4, r1 + CASE WHEN severity = 'severe' AND acts THEN 1 ELSE 0 END) AS r2 FROM u1", u3="SELECT *, least(4, greatest(0, r2 + CASE WHEN acts AND affected_fraction >= 1e-1 THEN 1 WHEN acts AND affected_fraction <= 2e-2 THEN -1 ELSE 0 END)) AS r3 FROM u2",
  u="SELECT *, CAST(least(4, greatest(0, r3 + CASE WHEN category = 'pest' THEN CASE life_stage WHEN 'larva' THEN 1 WHEN 'adult' THEN -1 ELSE 0 END ELSE 0 END)) AS INT) AS urgency_rank FROM u3")


def single(spark, sf_dir):
    e = F.col("event_id")
    rows = detections(spark, sf_dir).select("event_id", "class_id", "confidence", "severity", F.when(e % 3 == 0, (e % 20) / 100).alias("affected_fraction"), F.when(e % 5 == 0, "egg").when(e % 5 == 1, "larva").when(e % 5 == 2, "adult").when(e % 5 == 3, "pupa").alias("life_stage"))
    return D.advise(rows, F.broadcast(classes(spark)))


@query(SINGLE_SQL + f"SELECT event_id, {NAME.format('urgency_rank')} AS level, confidence < 55e-2 OR spread_rank >= 4 AS needs_confirmation, CASE WHEN category = 'pest' THEN CASE life_stage WHEN 'egg' THEN 'scout_and_time_treatment' WHEN 'larva' THEN 'treat_affected_plants' WHEN 'adult' THEN 'monitor_and_count' ELSE action END ELSE action END AS final_action FROM u")
def urgency(spark, sf_dir):
    return single(spark, sf_dir).select("event_id", "level", "needs_confirmation", "final_action")


@query(SINGLE_SQL + """SELECT event_id, concat_ws('; ', CASE WHEN confidence < 55e-2 THEN 'low confidence: take a second photo' END, CASE WHEN severity = 'severe' AND acts THEN 'severe: treat as a field-level problem' END,
CASE WHEN acts AND affected_fraction >= 1e-1 THEN round(affected_fraction * 100)::INT || '% affected: field-wide' WHEN acts AND affected_fraction <= 2e-2 THEN round(affected_fraction * 100)::INT || '% affected: spot-treat' END,
CASE WHEN category = 'pest' AND life_stage IN ('egg', 'larva', 'nymph', 'adult') THEN 'stage: ' || life_stage END, 'spread by ' || lower(vector_name), 'threshold ' || etl_threshold::INT || ' ' || replace(etl_unit, '_', ' ')) AS notes FROM u""")
def advisory_notes(spark, sf_dir):
    return single(spark, sf_dir).select("event_id", F.array_join("notes", "; ").alias("notes"))


@query(SINGLE_SQL + f"SELECT class_id, {DISPLAY} AS display, headline, action, recheck_hours, count(*)::BIGINT AS n FROM u GROUP BY ALL")
def advisory_lookup(spark, sf_dir):
    return single(spark, sf_dir).groupBy("class_id", "display", "headline", "action", "recheck_hours").agg(F.count(F.lit(1)).alias("n"))


@query(SINGLE_SQL + "SELECT event_id, flags, name AS reason, water_status, CAST(least(coalesce(nullif(recheck_hours, 0), 48), 72) AS INT) AS ttl_hours, urgency_rank AS priority FROM u WHERE flags <> '' OR water_status IS NOT NULL")
def advisory_constraint(spark, sf_dir):
    return single(spark, sf_dir).where("flags <> '' OR water_status IS NOT NULL").select("event_id", "flags", F.col("name").alias("reason"), "water_status", "ttl_hours", F.col("urgency_rank").alias("priority"))


@query(sql("event_classes") + "SELECT a.class_id, lower(b.name) AS vector_name, count(e.event_id)::BIGINT AS n FROM event_classes a LEFT JOIN event_classes b ON a.vector = b.class_id LEFT JOIN events e ON e.event_type = a.class_id GROUP BY ALL")
def vector_lookup(spark, sf_dir):
    c = classes(spark)
    named = c.join(c.select(F.col("class_id").alias("vector"), F.lower("name").alias("vector_name")), "vector", "left").select("class_id", "vector_name")
    return named.join(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class_id")).agg(F.count(F.lit(1)).alias("n")), "class_id", "left").select("class_id", "vector_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN upper(p_brand[1]) || lower(p_brand[2:]) || ' looks healthy. Continue normal monitoring.' ELSE upper(p_brand[1]) || lower(p_brand[2:]) || ' - ' || p_name || ' detected' || CASE WHEN p_type IN ('SMALL', 'PROMO') THEN ' (' || p_type || ')' ELSE '' END || '. Signs to confirm: ' || p_name || '.' END AS message FROM part")
def compose_message(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    category = F.when(F.col("p_type") == "ECONOMY", "healthy").when(F.col("p_type").isin("SMALL", "PROMO"), "pest").otherwise("deficiency")
    return p.select("p_partkey", D.composed_message(category, F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.concat("p_name", F.lit(".; size "), "p_size")).alias("message"))


@query(r"""WITH t AS (SELECT doc_id, 'ALERT: ' || text AS b FROM documents), c AS (SELECT doc_id, b, substring(b, 1, 157) AS h FROM t)
SELECT doc_id, CASE WHEN length(b) <= 160 THEN b ELSE regexp_replace(CASE WHEN contains(h, ' ') THEN regexp_replace(h, ' [^ ]*$', '') ELSE h END, '[ ,.;:]+$', '') || '...' END AS sms FROM c""")
def sms_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.shorten(F.concat(F.lit("ALERT: "), "text")).alias("sms"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'Drain the standing water first.' END AS b, trim(split_part(text, '.', 1)) || '.' AS c FROM documents)
SELECT doc_id, concat_ws('|', nullif(a, ''), CASE WHEN b IS DISTINCT FROM nullif(a, '') THEN b END, CASE WHEN c IS DISTINCT FROM nullif(a, '') AND c IS DISTINCT FROM b THEN c END) AS lines FROM l""")
def voice_lines(spark, sf_dir):
    headline, phrase = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.when(F.col("doc_id") % 3 == 0, D.FLAGS["drain"][1])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(D.spoken(headline, phrase, F.col("text")), "|").alias("lines"))


MESSAGES = [("healthy", "en", "Crop looks healthy"), ("healthy", "fr", "Culture saine"), ("call_expert", "en", "Contact your officer"), ("irrigate_now", "en", "Irrigate now"), ("irrigate_now", "de", "Jetzt bewässern")]
KEYS = "(['healthy', 'call_expert', 'irrigate_now', 'flood_risk'])[1 + doc_id % 4]"


@query(f"WITH m AS (SELECT * FROM (VALUES {', '.join(str(m) for m in MESSAGES)}) AS t(key, lang, text)), k AS (SELECT doc_id, {KEYS} AS key, lang FROM documents) SELECT doc_id, key, lang, coalesce(m.text, e.text, replace(key, '_', ' ')) AS text FROM k LEFT JOIN m USING (key, lang) LEFT JOIN (SELECT key, text FROM m WHERE lang = 'en') e USING (key)")
def i18n_lookup(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in ("healthy", "call_expert", "irrigate_now", "flood_risk")])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(keys, (F.col("doc_id") % 4).cast("int")).alias("key"), "lang")
    return D.localised(rows, F.broadcast(spark.createDataFrame(MESSAGES, "key string, lang string, text string"))).select("doc_id", "key", "lang", "text")
