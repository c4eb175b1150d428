"""Queries of metrics, novelty and decisions over the embedding stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.storage import checkpointed, shared_path
from harrow.operators import decision as D
from harrow.operators import metrics as M
from harrow.operators import novelty as N
from harrow.plans.registry import query
from harrow.plans.views import table, view
from harrow.sources.manifests import write_policy

T = 0.05
K = 10


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def scored(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return N.scores(e, N.centroids(e)).select("vec_id", F.col("label").alias("y"), "scores")


def predictions(spark, sf_dir):
    return M.predict(scored(spark, sf_dir), T)


def categories(spark):
    return spark.range(K).select(F.col("id").cast("int").alias("class_idx"), (F.col("id") % 3).cast("int").alias("category"), F.concat(F.lit("c"), "id").alias("class_id"))


CELLS = "cells AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), cm AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY ALL), cen AS (SELECT label, list(m ORDER BY i) AS mean FROM cm GROUP BY 1), one AS (SELECT list(mean ORDER BY label) AS means FROM cen)"
SCORES = CELLS + ", sc AS (SELECT vec_id, label AS y, list_transform(means, lambda m: -list_sum(list_transform(range(1, len(m) + 1), lambda i: (embedding[i]::DOUBLE - m[i]) * (embedding[i]::DOUBLE - m[i])))) AS scores FROM embeddings, one)"
PRED = SCORES + f", ex AS (SELECT vec_id, y, scores, list_transform(scores, lambda s: exp((s - list_max(scores)) / {T})) AS e FROM sc), pr AS (SELECT vec_id, y, scores, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex), " \
    "fl AS (SELECT vec_id, y, unnest(range(len(p)))::INT AS i, unnest(p) AS q FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS r FROM fl), " \
    "pd AS (SELECT vec_id, any_value(y) AS y, max(i) FILTER (WHERE r = 1) AS pred, max(q) FILTER (WHERE r = 1) AS p1, max(i) FILTER (WHERE r = 2) AS pred2, max(q) FILTER (WHERE r = 2) AS p2, list(i ORDER BY r) AS ord FROM rk GROUP BY 1)"  # fmt: skip
W = "WITH " + PRED + "\n"
CM = PRED + ", conf AS (SELECT y, pred, count(*) AS n FROM pd GROUP BY ALL)"
REPORT = CM + ", t AS (SELECT y AS c, sum(n) AS support, coalesce(sum(n) FILTER (WHERE y = pred), 0) AS hit FROM conf GROUP BY 1), s AS (SELECT pred AS c, sum(n) AS said FROM conf GROUP BY 1), rep0 AS (SELECT d.c::INT AS class_idx, coalesce(support, 0)::BIGINT AS support, coalesce(hit, 0)::BIGINT AS hit, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM (SELECT unnest(range(10)) AS c) d LEFT JOIN t USING (c) LEFT JOIN s USING (c)), rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rep0)"
RISK = PRED + ", th AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in M.THRESHOLDS) + "]) AS threshold), risk AS (SELECT threshold, avg((p1 >= threshold)::INT) AS coverage, coalesce(count(*) FILTER (WHERE p1 >= threshold AND pred <> y) / nullif(count(*) FILTER (WHERE p1 >= threshold), 0), 0) AS selective_error, count(*) FILTER (WHERE p1 >= threshold)::BIGINT AS answered, count(*) FILTER (WHERE p1 >= threshold AND pred <> y)::BIGINT AS wrong, count(*) FILTER (WHERE p1 < threshold AND pred = y)::BIGINT AS missed_correct FROM pd, th GROUP BY 1)"


def _bins_sql(n):
    return PRED + f", bn AS (SELECT i::INT AS bin, i / {n}::DOUBLE AS lo, (i + 1) / {n}::DOUBLE AS hi FROM range({n}) r(i)), rel AS (SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, count(vec_id)::BIGINT AS n, coalesce(avg(p1), 0) AS confidence, coalesce(avg((pred = y)::INT), 0) AS accuracy FROM bn LEFT JOIN pd ON p1 > lo AND p1 <= hi GROUP BY 1)"


def rounded(df, *cols, to=6):
    return df.withColumns({c: F.round(c, to) for c in cols})


@query(W + "SELECT vec_id, i, round(q, 6) AS p FROM fl")
def softmax(spark, sf_dir):
    return predictions(spark, sf_dir).select("vec_id", F.posexplode("p").alias("i", "p")).withColumn("p", F.round("p", 6))


@query(W + "SELECT vec_id, pred, round(p1, 6) AS p1, pred2, round(p2, 6) AS p2, array_to_string(ord[1:5], ',') AS top FROM pd")
def topk_rows(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("vec_id", "pred", "p1", "pred2", "p2", F.array_join(F.col("top").cast("array<string>"), ",").alias("top")), "p1", "p2")


def _cm(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir), K)


@query("WITH " + CM + " SELECT y, pred, n::BIGINT AS n FROM conf")
def confusion(spark, sf_dir):
    return _cm(spark, sf_dir)


@query("WITH " + CM + " SELECT y, " + ", ".join(f'coalesce(sum(n) FILTER (WHERE pred = {i}), 0)::BIGINT AS "{i}"' for i in range(K)) + " FROM conf GROUP BY 1")
def confusion_wide(spark, sf_dir):
    return M.confusion_wide(_cm(spark, sf_dir), K)


@query("WITH " + REPORT + " SELECT class_idx, support, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep")
def class_report(spark, sf_dir):
    return rounded(M.class_report(_cm(spark, sf_dir), categories(spark)), "precision", "recall", "f1")


@query("WITH " + REPORT + " SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(precision) FILTER (WHERE support > 0), 6) AS macro_precision, round(avg(recall) FILTER (WHERE support > 0), 6) AS macro_recall, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) FILTER (WHERE support > 0)::BIGINT AS seen, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM rep")
def report_summary(spark, sf_dir):
    out = M.report_summary(M.class_report(_cm(spark, sf_dir), categories(spark)))
    return rounded(out, *[c for c in out.columns if c != "seen"])


@query(W + " UNION ALL ".join(f"SELECT {k}::INT AS k, round(avg(list_contains(ord[1:{k}], y)::INT), 6) AS accuracy FROM pd" for k in (1, 3, 5)))
def topk_accuracy(spark, sf_dir):
    p = checkpointed(predictions(spark, sf_dir).select("y", "top"))
    return rounded(M.topk_accuracy(p, 1, K).union(M.topk_accuracy(p, 3, K)).union(M.topk_accuracy(p, 5, K)), "accuracy")


@query("WITH " + REPORT + " SELECT class_idx, support, round(f1, 6) AS f1, round(recall, 6) AS recall FROM rep WHERE support >= 5 ORDER BY rep.f1, rep.recall, class_idx LIMIT 5")
def worst_classes(spark, sf_dir):
    return rounded(M.worst_classes(M.class_report(_cm(spark, sf_dir), categories(spark)), 5, 5), "f1", "recall").select("class_idx", "support", "f1", "recall")


@query("WITH " + _bins_sql(15) + " SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM rel")
def ece(spark, sf_dir):
    return rounded(M.calibration_error(predictions(spark, sf_dir)), "ece")


@query("WITH " + _bins_sql(10) + " SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM rel")
def reliability(spark, sf_dir):
    return rounded(M.reliability(predictions(spark, sf_dir)), "lo", "hi", "confidence", "accuracy")


@query("WITH " + RISK + " SELECT threshold, round(coverage, 6) AS coverage, round(selective_error, 6) AS selective_error, answered, wrong, missed_correct FROM risk")
def selective_risk(spark, sf_dir):
    return rounded(M.selective_risk(predictions(spark, sf_dir)), "coverage", "selective_error")


@query("WITH " + RISK + ", k AS (SELECT *, threshold >= 3e-1 AS fl, coverage >= 5e-1 AS cv FROM risk), tr AS (SELECT *, CASE WHEN fl AND cv AND selective_error <= 1e-1 THEN 0 WHEN fl AND cv THEN 1 WHEN fl THEN 2 ELSE 3 END AS tier FROM k) SELECT threshold, round(coverage, 6) AS coverage, round(selective_error, 6) AS selective_error, tier::INT AS tier FROM tr ORDER BY tr.tier, CASE WHEN tr.tier = 0 THEN threshold ELSE tr.selective_error END, CASE WHEN tr.tier = 0 THEN 0 ELSE -tr.coverage END, threshold LIMIT 1")
def select_threshold(spark, sf_dir):
    return rounded(M.select_threshold(M.selective_risk(predictions(spark, sf_dir))), "coverage", "selective_error")


@query("WITH " + CM + ", sh AS (SELECT *, n / sum(n) OVER (PARTITION BY y) AS share FROM conf) SELECT y, pred, n::BIGINT AS n, round(share, 6) AS share_of_true, y % 3 <> pred % 3 AS cross_category FROM sh WHERE y <> pred ORDER BY (y % 3 <> pred % 3) DESC, sh.n DESC, y, pred LIMIT 10")
def confusion_pairs(spark, sf_dir):
    return rounded(M.confusion_pairs(_cm(spark, sf_dir), categories(spark)), "share_of_true")


@query("WITH " + CM + " SELECT round(coalesce(sum(n) FILTER (WHERE y % 3 <> pred % 3), 0) / sum(n), 6) AS rate FROM conf")
def cross_category(spark, sf_dir):
    return rounded(M.cross_category_rate(_cm(spark, sf_dir), categories(spark)), "rate")


GRID = (0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)


@query("WITH " + SCORES + ", g AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in GRID) + "]) AS temperature) SELECT temperature, round(avg(ln(list_sum(list_transform(scores, lambda s: exp((s - list_max(scores)) / temperature)))) - (scores[y + 1] - list_max(scores)) / temperature), 6) AS nll FROM sc, g GROUP BY 1")
def temperature_grid(spark, sf_dir):
    return rounded(M.mean_nll(scored(spark, sf_dir), GRID), "nll")


@query()
def fit_temperature(spark, sf_dir):
    s = checkpointed(scored(spark, sf_dir))
    return M.mean_nll(s, [M.fit_temperature(s)])


@query("SELECT round(avg(((n_chars > 1000)::INT = quality)::INT) FILTER (WHERE quality IS NOT NULL), 6) AS accuracy, count(quality)::BIGINT AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def masked_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    return rounded(M.masked_accuracy(rows, "guess", "quality"), "accuracy")


@query(W + "SELECT vec_id, y, pred, round(p1, 4) AS confidence, pred = y AS correct, pred2, round(p2, 4) AS confidence2 FROM pd")
def prediction_audit(spark, sf_dir):
    return M.audit(predictions(spark, sf_dir), "vec_id")


def _even(e):
    return e.withColumn("embedding", F.filter("embedding", lambda x, i: i % 2 == 0))


PRED_B = "cells_b AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM evens), cm_b AS (SELECT label, i, avg(x) AS m FROM cells_b GROUP BY ALL), cen_b AS (SELECT label, list(m ORDER BY i) AS mean FROM cm_b GROUP BY 1), one_b AS (SELECT list(mean ORDER BY label) AS means FROM cen_b), " \
    "sc_b AS (SELECT vec_id, label AS y, list_transform(means, lambda m: -list_sum(list_transform(range(1, len(m) + 1), lambda i: (embedding[i]::DOUBLE - m[i]) * (embedding[i]::DOUBLE - m[i])))) AS scores FROM evens, one_b), " \
    f"ex_b AS (SELECT vec_id, list_transform(scores, lambda s: exp((s - list_max(scores)) / {T})) AS e FROM sc_b), pr_b AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex_b)"


@query(W + ", evens AS (SELECT vec_id, label, list_transform(range(1, len(embedding) + 1, 2), lambda i: embedding[i]) AS embedding FROM embeddings), " + PRED_B + """, ab AS (SELECT a.p AS a, b.p AS b, list_transform(range(1, 11), lambda i: abs(a.p[i] - b.p[i])) AS d FROM pr a JOIN pr_b b USING (vec_id))
SELECT round(coalesce(avg((list_position(a, list_max(a)) = list_position(b, list_max(b)))::INT) FILTER (WHERE list_max(a) >= 5e-1), 1), 6) AS agreement, count(*) FILTER (WHERE list_max(a) >= 5e-1)::BIGINT AS confident, round(avg(list_avg(d)), 6) AS mean_drift, round(max(list_max(d)), 6) AS max_drift,
coalesce(avg((list_position(a, list_max(a)) = list_position(b, list_max(b)))::INT) FILTER (WHERE list_max(a) >= 5e-1), 1) >= 95e-2 AND avg(list_avg(d)) < 5e-2 AS ok FROM ab""")
def score_agreement(spark, sf_dir):
    e = _even(embeddings(spark, sf_dir))
    b = M.predict(N.scores(e, N.centroids(e)).select("vec_id", F.col("label").alias("y"), "scores"), T)
    return rounded(M.agreement(predictions(spark, sf_dir), b, "vec_id"), "agreement", "mean_drift", "max_drift")


@query()
def policy_row(spark, sf_dir):
    return write_policy(M.retune(checkpointed(scored(spark, sf_dir))), shared_path(spark, "policy"))


@query("WITH " + SCORES + f", d AS (SELECT 'c' || i AS class_id FROM range({K}) r(i)), p AS (SELECT {T} AS temperature, 0.3 AS least) " + "SELECT unnest(['has classes', 'ids differ', 'width fits', 'temperature plausible', 'threshold plausible']) AS \"check\", unnest([(SELECT count(*) > 0 FROM d), (SELECT count(*) = count(DISTINCT class_id) FROM d), (SELECT min(len(scores)) = (SELECT count(*) FROM d) AND max(len(scores)) = (SELECT count(*) FROM d) FROM sc), (SELECT temperature > 0 AND temperature <= 20 FROM p), (SELECT least >= 0 AND least < 1 FROM p)]) AS ok")
def contract_check(spark, sf_dir):
    return M.contract_checks(scored(spark, sf_dir), categories(spark), T, 0.3)


@query("WITH r AS (SELECT event_type AS run, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), a AS (SELECT run, any_value(n)::BIGINT AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(stddev_pop(v), 6) AS stdev, " + ", ".join(f"max(v) FILTER (WHERE i = round_even({q / 100} * (n - 1), 0)) AS p{q}" for q in (50, 90, 95, 99)) + " FROM r GROUP BY 1) SELECT *, CASE WHEN p95 < 500 THEN 'good' WHEN p95 < 1500 THEN 'usable' ELSE 'too slow' END AS verdict FROM a")
def latency_summary(spark, sf_dir):
    return rounded(M.latency_summary(view(spark, sf_dir, "latency")), "mean", "stdev")


TIERS = "k AS (SELECT *, threshold >= 3e-1 AS fl, coverage >= 5e-1 AS cv FROM risk), tr AS (SELECT *, CASE WHEN fl AND cv AND selective_error <= 1e-1 THEN 0 WHEN fl AND cv THEN 1 WHEN fl THEN 2 ELSE 3 END AS tier FROM k), best AS (SELECT threshold, round(coverage, 6) AS coverage, round(selective_error, 6) AS selective_error, tier::INT AS tier FROM tr ORDER BY tr.tier, CASE WHEN tr.tier = 0 THEN threshold ELSE tr.selective_error END, CASE WHEN tr.tier = 0 THEN 0 ELSE -tr.coverage END, threshold LIMIT 1)"


@query("WITH " + REPORT + _bins_sql(15)[len(PRED):] + RISK[len(PRED):] + ", " + TIERS + """,
su AS (SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(precision) FILTER (WHERE support > 0), 6) AS macro_precision, round(avg(recall) FILTER (WHERE support > 0), 6) AS macro_recall, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) FILTER (WHERE support > 0)::BIGINT AS seen, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM rep),
ca AS (SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM rel), cr AS (SELECT round(coalesce(sum(n) FILTER (WHERE y % 3 <> pred % 3), 0) / sum(n), 6) AS rate, round(sum(n) FILTER (WHERE y % 3 = pred % 3) / sum(n), 6) AS category_accuracy FROM conf)
SELECT * FROM su, ca, cr, best""")
def evaluation_report(spark, sf_dir):
    """Label, category, calibration and operating point of one persisted prediction table."""
    out = M.evaluation(checkpointed(predictions(spark, sf_dir)), categories(spark), K)
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double" and f.name != "threshold"])


# ---- novelty
@query("WITH " + CELLS + " SELECT label, (i - 1)::INT AS i, round(m, 6) AS mean FROM cm")
def centroids(spark, sf_dir):
    return N.centroids(embeddings(spark, sf_dir)).select("label", F.posexplode("mean").alias("i", "mean")).withColumn("mean", F.round("mean", 6))


COV = CELLS + ", ce AS (SELECT vec_id, i, x - m AS x FROM cells JOIN cm USING (label, i)), cov AS (SELECT a.i - 1 AS i, b.i - 1 AS j, sum(a.x * b.x) / greatest(1, (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM cen)) AS v FROM ce a JOIN ce b USING (vec_id) GROUP BY ALL)"


@query("WITH " + COV + " SELECT i::INT AS i, j::INT AS j, round(v, 9) AS v FROM cov")
def pooled_cov(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(N.pooled_covariance(e, N.centroids(e)), "v", to=9)


@query("WITH " + COV + ", nr AS (SELECT vec_id, sum(x * x) AS q FROM ce GROUP BY 1), s AS (SELECT count(*)::BIGINT AS n, sum(q * q) AS fourth FROM nr), c AS (SELECT max(i + 1)::INT AS d, sum(v) FILTER (WHERE i = j) AS trace, sum(v * v) AS squares FROM cov), a AS (SELECT *, trace / d AS mu, (squares - d * (trace / d) * (trace / d)) / d AS delta FROM s, c), b AS (SELECT *, greatest(0, least(delta, (fourth / n - squares) / (n * d))) AS beta FROM a) SELECT n, d, round(mu, 9) AS mu, round(delta, 9) AS delta, round(beta, 9) AS beta, round(beta / delta, 6) AS intensity FROM b")
def shrinkage(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    means = checkpointed(N.centroids(e))
    return rounded(rounded(N.shrinkage(e, means, N.pooled_covariance(e, means)), "mu", "delta", "beta", to=9), "intensity")


@query("WITH " + CELLS + ", e AS (SELECT i, stddev_pop(x) AS s, sum(abs(x)) AS a, count(*) AS n FROM cells GROUP BY 1) SELECT round(avg(s) / greatest(sum(a) / sum(n), 1e-6), 6) AS spread, avg(s) / greatest(sum(a) / sum(n), 1e-6) < 1e-5 AS degenerate FROM e")
def embedding_spread(spark, sf_dir):
    return rounded(N.spread(embeddings(spark, sf_dir)), "spread")


@query("WITH " + SCORES + " SELECT vec_id, round(-list_max(scores), 6) AS score FROM sc")
def nearest_centroid_sq(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(N.nearest_sq(e, N.centroids(e)).select("vec_id", "score"), "score")


def _mahalanobis(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    means, inverse, _ = N.fit(e)
    return checkpointed(N.mahalanobis(e, means, inverse, "vec_id"))


@query()
def novelty_calibration(spark, sf_dir):
    return N.calibrate(_mahalanobis(spark, sf_dir))


@query()
def novelty_score(spark, sf_dir):
    s = _mahalanobis(spark, sf_dir)
    return N.judge(s, N.calibrate(s).first().threshold)


@query()
def novelty_by_version(spark, sf_dir):
    """The detector fitted again for a second classifier, which sees every other dimension."""
    e = embeddings(spark, sf_dir)
    return N.refit(e.withColumn("version", F.lit("full")).unionByName(_even(e).withColumn("version", F.lit("even"))), "vec_id")


# ---- decisions
OWN_THRESHOLDS = [(0, 0.9), (3, 0.2), (7, 0.6)]
OWN = "own AS (SELECT * FROM (VALUES (0, 9e-1), (3, 2e-1), (7, 6e-1)) AS t(pred, threshold))"


def _decided(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("is_novel", F.col("vec_id") % 17 == 0)
    return D.decide(p, spark.createDataFrame(OWN_THRESHOLDS, "pred int, threshold double"), 0.3, 0.05)


DECIDED = PRED + ", " + OWN + ", de0 AS (SELECT pd.*, vec_id % 17 = 0 AS nov, coalesce(threshold, 3e-1) AS threshold FROM pd LEFT JOIN own USING (pred)), de AS (SELECT *, CASE WHEN nov THEN 'novel' WHEN p1 < threshold THEN 'below threshold' WHEN p1 - p2 < 5e-2 THEN 'small margin' ELSE '' END AS reason FROM de0)"


@query("WITH " + DECIDED + " SELECT vec_id, reason = '' AS accepted, reason, CASE WHEN reason = '' THEN pred::VARCHAR ELSE 'unknown' END AS decided FROM de")
def decide(spark, sf_dir):
    return _decided(spark, sf_dir).select("vec_id", "accepted", "reason", "decided")


CAT = ", cp AS (SELECT vec_id, i % 3 AS g, sum(q) AS s FROM fl GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, g) AS r FROM cp)"


def _category(p):
    """The category head of the stand-in: the classes' probabilities summed by class modulo 3."""
    parts = F.array(*[F.aggregate(F.filter(p, lambda x, i: i % 3 == g), F.lit(0.0), lambda a, b: a + b) for g in range(3)])
    return F.get(M.ranked(parts), F.lit(0))


@query("WITH " + DECIDED + CAT + " SELECT vec_id, reason, (['healthy', 'disease', 'pest'])[g + 1] AS category, round(s, 6) AS category_confidence, (['', 'treat as a disease problem', 'treat as a pest problem'])[CASE WHEN reason NOT IN ('', 'novel') AND g > 0 AND s >= 3e-1 THEN g + 1 ELSE 1 END] AS note FROM de JOIN cr USING (vec_id) WHERE r = 1")
def category_fallback(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("healthy", "disease", "pest")])
    rows = _decided(spark, sf_dir).withColumn("c", _category(F.col("p"))).withColumn("category", F.get(names, F.col("c.i")))
    return rows.select("vec_id", "reason", "category", F.round("c.p", 6).alias("category_confidence"), D.category_note(F.col("reason"), F.col("category"), F.col("c.p")).alias("note"))


@query(W + "SELECT pd.vec_id, pred, CASE WHEN pred % 3 > 0 THEN (list_position(p[1:4], list_max(p[1:4])) - 1)::INT END AS severity, CASE WHEN pred % 3 = 2 THEN list_position(p[6:9], list_max(p[6:9]))::INT END AS life_stage FROM pd JOIN pr USING (vec_id)")
def head_gating(spark, sf_dir):
    """Severity (the first four scores) only for what can be acted on, life stage (the next five, the first ignored) only for pests."""
    best = lambda a: F.get(M.ranked(a), F.lit(0))["i"]
    category = F.get(F.array(*[F.lit(x) for x in ("healthy", "disease", "pest")]), (F.col("pred") % 3).cast("int"))
    severity, life_stage = D.gated_heads(category, best(F.slice("p", 1, 4)), best(F.slice("p", 6, 4)) + 1)
    return predictions(spark, sf_dir).select("vec_id", "pred", severity.alias("severity"), life_stage.alias("life_stage"))


@query("""WITH f AS (SELECT doc_id AS frame, (n_chars % 900 + 100)::INT AS w, (n_chars // 10 % 500 + 50)::INT AS h FROM documents),
x AS (SELECT frame, w, h, unnest(list_distinct(list_transform(range(0, greatest(h - 224 + 179, 0)::BIGINT + CASE WHEN h - 224 + 178 < 0 THEN 1 ELSE 0 END, 179), lambda y: least(y, greatest(h - 224, 0))))) AS t FROM f),
y AS (SELECT frame, w, h, t, unnest(list_distinct(list_transform(range(0, greatest(w - 224 + 179, 0)::BIGINT + CASE WHEN w - 224 + 178 < 0 THEN 1 ELSE 0 END, 179), lambda z: least(z, greatest(w - 224, 0))))) AS l FROM x),
n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY t, l) - 1 AS i, count(*) OVER (PARTITION BY frame) AS n FROM y),
k AS (SELECT frame, n, unnest(range(least(n, 12))) AS j FROM (SELECT DISTINCT frame, n FROM n))
SELECT frame, k.j::INT AS i, l::INT AS l, t::INT AS t, least(l + 224, w)::INT AS r, least(t + 224, h)::INT AS b FROM k JOIN n USING (frame) WHERE n.i = CASE WHEN k.n <= 12 THEN k.j ELSE floor(k.j * (k.n / 12.0::DOUBLE)) END""")
def tile_grid(spark, sf_dir):
    frames = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame"), (F.col("n_chars") % 900 + 100).alias("w"), (F.floor(F.col("n_chars") / 10) % 500 + 50).alias("h"))
    return D.tile_grid(frames)


@query("""WITH t AS (SELECT l_orderkey AS frame, 'c' || (l_partkey % 7) AS class_id, l_quantity / 100 AS confidence, l_quantity >= 10 AND l_partkey % 7 > 0 AS acts FROM lineitem), tot AS (SELECT frame, count(*)::BIGINT AS tiles, count(*) FILTER (WHERE acts)::BIGINT AS tiles_actionable FROM t GROUP BY 1),
e AS (SELECT frame, class_id, count(*) AS n, max(confidence) AS top, avg(confidence) AS mean FROM t WHERE acts GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, top DESC, class_id DESC) AS r FROM e)
SELECT frame, tiles, tiles_actionable, class_id AS dominant_class, round(coalesce(n / tiles, 0), 6) AS affected_fraction, round(mean, 6) AS mean_confidence FROM tot LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (frame)""")
def frame_rollup(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.concat(F.lit("c"), F.col("l_partkey") % 7).alias("class_id"), (F.col("l_quantity") / 100).alias("confidence"), ((F.col("l_quantity") >= 10) & (F.col("l_partkey") % 7 > 0)).alias("acts"))
    return rounded(D.roll_up_frames(tiles), "affected_fraction", "mean_confidence")


@query(W + "SELECT vec_id, 'Closest matches: ' || 'c' || ord[1] || ' (' || round(p1 * 100)::INT || '%), c' || ord[2] || ' (' || round(p2 * 100)::INT || '%).' AS note FROM pd WHERE p1 < 3e-1")
def uncertain_advisory(spark, sf_dir):
    two = D.closest_note([F.concat(F.lit("c"), "pred"), F.concat(F.lit("c"), "pred2")], [F.col("p1"), F.col("p2")])
    return predictions(spark, sf_dir).where("p1 < 0.3").select("vec_id", two.alias("note"))
