"""Metrics, calibration and operating points of scored predictions.

A scored table has y (null: not labelled) and an array of class scores; predict() adds what the rest reads. Tables of classes, bins and thresholds are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.ranking import running

THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def softmax(scores: Column, temperature=1.0) -> Column:
    """Stable softmax of an array of scores."""
    shifted = F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) / F.lit(float(temperature))))
    return F.get(F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), F.lit(0))


def ranked(p: Column) -> Column:
    """The classes by falling probability, ties by class: an array of (i, p)."""
    return F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))), lambda s: F.struct(s["i"].alias("i"), (-s["n"]).alias("p")))


def predict(scored: DataFrame, temperature=1.0, k=5) -> DataFrame:
    """scored with p (probabilities), pred, p1, pred2, p2, top (the k best classes)."""
    rows = scored.withColumn("p", softmax(F.col("scores"), temperature)).withColumn("_r", ranked(F.col("p")))
    at = lambda i, f: F.get("_r", F.lit(i))[f]
    return rows.withColumns({"pred": at(0, "i"), "p1": at(0, "p"), "pred2": at(1, "i"), "p2": F.coalesce(at(1, "p"), F.lit(0.0)), "top": F.transform(F.slice("_r", 1, k), lambda s: s["i"])}).drop("_r")


def confusion(rows: DataFrame, classes: int) -> DataFrame:
    """(y, pred, n); labels outside the classes are left out."""
    return rows.where(F.col("y").between(0, classes - 1)).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(cm: DataFrame, classes: int) -> DataFrame:
    return cm.groupBy("y").pivot("pred", list(range(classes))).agg(F.sum("n")).na.fill(0)


def class_report(cm: DataFrame, dim: DataFrame) -> DataFrame:
    """(class_idx, support, precision, recall, f1) of each class of dim; undefined values are 0."""
    true = cm.groupBy(F.col("y").alias("class_idx")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    said = cm.groupBy(F.col("pred").alias("class_idx")).agg(F.sum("n").alias("said"))
    rows = dim.select("class_idx").join(true, "class_idx", "left").join(said, "class_idx", "left").na.fill(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(F.col("hit"), F.col("said"))), zero(F.try_divide(F.col("hit"), F.col("support")))
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("class_idx", "support", "hit", "precision", "recall", "f1")


def report_summary(report: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro averages over classes with support, weighted F1."""
    seen = F.col("support") > 0
    macro = {f"macro_{c}": F.avg(F.when(seen, F.col(c))) for c in ("precision", "recall", "f1")}
    out = report.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), *[v.alias(k) for k, v in macro.items()], (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.count_if(seen).alias("seen"))
    return out.withColumn("balanced_accuracy", F.col("macro_recall"))


def topk_accuracy(rows: DataFrame, k: int, classes: int) -> DataFrame:
    k = min(k, classes)
    return rows.where("y IS NOT NULL").agg(F.avg(F.array_contains(F.slice("top", 1, k), F.col("y")).cast("double")).alias("accuracy")).withColumn("k", F.lit(k))


def worst_classes(report: DataFrame, n=5, least=1) -> DataFrame:
    return report.where(F.col("support") >= least).orderBy("f1", "recall", "class_idx").limit(n)


def bins(spark, n: int) -> DataFrame:
    """(bin, lo, hi) of n equal bins of (0, 1]."""
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), (F.col("id") / n).alias("lo"), ((F.col("id") + 1) / n).alias("hi"))


def reliability(rows: DataFrame, n=10) -> DataFrame:
    """(bin, lo, hi, n, confidence, accuracy) of all bins; a bin is (lo, hi], so a confidence of 0 is in none. The n bins are joined by range after rows are summed by bin edges."""
    each = rows.select("p1", (F.col("pred") == F.col("y")).cast("double").alias("right"))
    b = F.broadcast(bins(rows.sparkSession, n))  # n rows
    summed = each.join(b, (F.col("p1") > F.col("lo")) & (F.col("p1") <= F.col("hi"))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p1").alias("confidence"), F.avg("right").alias("accuracy"))
    return bins(rows.sparkSession, n).join(summed, "bin", "left").na.fill(0)


def calibration_error(rows: DataFrame, n=15) -> DataFrame:
    return reliability(rows, n).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def selective_risk(rows: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, coverage, selective_error, answered, wrong, missed_correct): one pass over the rows with a sum for each threshold."""
    right = F.col("pred") == F.col("y")
    parts = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("p1") >= t).alias("answered"), F.count_if((F.col("p1") >= t) & ~right).alias("wrong"), F.count_if((F.col("p1") < t) & right).alias("missed_correct"), F.count(F.lit(1)).alias("total")) for t in thresholds]
    out = rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("threshold", zero(F.try_divide("answered", "total")).alias("coverage"), zero(F.try_divide("wrong", "answered")).alias("selective_error"), "answered", "wrong", "missed_correct")


def select_threshold(risk: DataFrame, most_error=0.10, least_coverage=0.50, least=0.30) -> DataFrame:
    """The lowest feasible threshold; else coverage is relaxed, never the floor: the least error, then most coverage, among rows that are covered and over the floor, or over it, or any."""
    floor, covered = F.col("threshold") >= least, F.col("coverage") >= least_coverage
    feasible = floor & covered & (F.col("selective_error") <= most_error)
    tier = F.when(feasible, 0).when(floor & covered, 1).when(floor, 2).otherwise(3)
    key = F.struct(tier.alias("tier"), F.when(feasible, F.col("threshold")).otherwise(F.col("selective_error")).alias("a"), F.when(feasible, F.lit(0.0)).otherwise(-F.col("coverage")).alias("b"), F.col("threshold").alias("c"))
    return risk.agg(F.min_by(F.struct("threshold", "coverage", "selective_error"), key).alias("x"), F.min(tier).alias("tier")).select("x.*", "tier")


def confusion_pairs(cm: DataFrame, categories: DataFrame, n=10) -> DataFrame:
    """The most frequent confusions, those across categories first. categories: (class_idx, category)."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("y"))
    rows = cm.withColumn("share_of_true", share).where("y <> pred")
    rows = rows.join(categories.select(F.col("class_idx").alias("y"), F.col("category").alias("_a")), "y").join(categories.select(F.col("class_idx").alias("pred"), F.col("category").alias("_b")), "pred")
    return rows.withColumn("cross_category", F.col("_a") != F.col("_b")).orderBy(F.desc("cross_category"), F.desc("n"), "y", "pred").select("y", "pred", "n", "share_of_true", "cross_category").limit(n)


def cross_category_rate(cm: DataFrame, categories: DataFrame) -> DataFrame:
    rows = cm.join(categories.select(F.col("class_idx").alias("y"), F.col("category").alias("_a")), "y").join(categories.select(F.col("class_idx").alias("pred"), F.col("category").alias("_b")), "pred")
    return rows.agg((F.sum(F.when(F.col("_a") != F.col("_b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))


def mean_nll(scored: DataFrame, temperatures) -> DataFrame:
    """(temperature, nll) over labelled rows, all temperatures in one pass."""
    top = F.array_max("scores")
    def nll(t):
        total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - top) / F.lit(float(t))))
        return F.avg(F.ln(total) - (F.get("scores", F.col("y")) - top) / F.lit(float(t)))
    rows = scored.where("y IS NOT NULL").agg(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), nll(t).alias("nll")) for t in temperatures]).alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*")


def loss_slopes(scored: DataFrame, inverses: list[float]) -> list[tuple[float, float]] | None:
    """First and second derivative of the mean loss at each inverse temperature, by one pass over labelled rows; None without any. They are E[s] - s_y and Var[s] under the softmax, averaged."""
    top = F.array_max("scores")

    def of(b: float) -> Column:
        zero = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("a"), F.lit(0.0).alias("q"))
        add = lambda m, s: F.struct((m["z"] + F.exp((s - top) * b)).alias("z"), (m["a"] + F.exp((s - top) * b) * (s - top)).alias("a"), (m["q"] + F.exp((s - top) * b) * (s - top) * (s - top)).alias("q"))
        mean = lambda m: F.struct((m["a"] / m["z"] - (F.get("scores", F.col("y")) - top)).alias("slope"), (m["q"] / m["z"] - m["a"] * m["a"] / (m["z"] * m["z"])).alias("curve"))
        return F.aggregate("scores", zero, add, mean)

    rows = scored.where("y IS NOT NULL").select(*[of(b).alias(f"x{i}") for i, b in enumerate(inverses)])
    got = rows.agg(*[F.avg(f"x{i}.{k}") for i in range(len(inverses)) for k in ("slope", "curve")]).first()
    return None if got[0] is None else list(zip(got[0::2], got[1::2]))


def fit_temperature(scored: DataFrame, low=0.05, high=20.0, tolerance=1e-9, most_passes=6, points=12) -> float:
    """The temperature of least mean NLL in [low, high]; 1 where nothing is labelled.

    The loss is convex in the inverse temperature. A first pass takes its slope at `points` inverses over the range and so finds two between which it changes its sign (or an end of the range); Newton steps from the better of them follow, one pass each,
    kept between the nearest points of either sign, until a step is below tolerance or most_passes are made.
    """
    grid = [1 / high * (high / low) ** (i / (points - 1)) for i in range(points)]
    first = loss_slopes(scored, grid)
    if first is None or any(s != s for s, _ in first):
        return 1.0
    if first[0][0] >= 0 or first[-1][0] <= 0:
        return high if first[0][0] >= 0 else low
    i = next(i for i, (s, _) in enumerate(first) if s > 0)
    a, b = grid[i - 1], grid[i]
    at, (slope, curve) = min(((a, first[i - 1]), (b, first[i])), key=lambda x: abs(x[1][0]))
    for _ in range(most_passes - 1):
        step = at - slope / curve if curve > 0 else b
        if abs(step - at) <= tolerance * at:
            return 1 / step
        at = step if a < step < b else (a * b) ** 0.5
        slope, curve = loss_slopes(scored, [at])[0]
        a, b = (a, at) if slope > 0 else (at, b)
    step = at - slope / curve if curve > 0 else at
    return 1 / min(max(step, a), b)


def masked_accuracy(rows: DataFrame, pred: str, y: str) -> DataFrame:
    """Accuracy over rows with a label, null if none has one, and their number."""
    return rows.agg(F.avg(F.when(F.col(y).isNotNull(), (F.col(pred) == F.col(y)).cast("double"))).alias("accuracy"), F.count(y).alias("labelled"))


def agreement(a: DataFrame, b: DataFrame, key: str, sure=0.5, least=0.95, drift=0.05) -> DataFrame:
    """Two classifiers' probabilities (key, p): agreement of the best class where A is sure (1 if it never is), mean and largest difference, and whether that is close enough."""
    both = a.select(key, F.col("p").alias("a")).join(b.select(key, F.col("p").alias("b")), key)
    d = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    best = lambda p: F.get(ranked(p), F.lit(0))["i"]
    confident = F.array_max("a") >= sure
    rows = both.agg(F.avg(F.when(confident, (best(F.col("a")) == best(F.col("b"))).cast("double"))).alias("g"), F.count_if(confident).alias("confident"), F.avg(F.aggregate(d, F.lit(0.0), lambda x, y: x + y) / F.size(d)).alias("mean_drift"), F.max(F.array_max(d)).alias("max_drift"))
    return rows.select(F.coalesce("g", F.lit(1.0)).alias("agreement"), "confident", "mean_drift", "max_drift").withColumn("ok", (F.col("agreement") >= least) & (F.col("mean_drift") < drift))


def audit(predicted: DataFrame, *keys: str) -> DataFrame:
    """Of predictions (keys, y, pred, p1, pred2, p2): confidences to four places, and whether the prediction is right; least sure first."""
    return predicted.orderBy("p1", *keys).select(*keys, "y", "pred", F.round("p1", 4).alias("confidence"), (F.col("pred") == F.col("y")).alias("correct"), "pred2", F.round("p2", 4).alias("confidence2"))


def evaluation(predicted: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """One row: label and category report, calibration, cross-category rate and operating point of predictions over n classes (class_idx, category from 0)."""
    category = classes.select(F.col("class_idx").alias("_c"), F.col("category").alias("_k"))
    in_category = predicted
    for c in ("y", "pred"):  # the dimension has one row a class
        in_category = in_category.join(category, F.col(c) == F.col("_c")).withColumn(c, F.col("_k")).drop("_c", "_k")
    kinds = category.select(F.col("_k").alias("class_idx"), F.col("_k").alias("category"), F.concat(F.lit("k"), "_k").alias("class_id")).distinct()
    cm = confusion(predicted, n)
    parts = [report_summary(class_report(cm, classes)), calibration_error(predicted), cross_category_rate(cm, classes), select_threshold(selective_risk(predicted)), report_summary(class_report(confusion(in_category, n), kinds)).select(F.col("accuracy").alias("category_accuracy"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(F.broadcast(x))  # one row each
    return out


def retune(scored: DataFrame) -> DataFrame:
    """One row: the temperature of least loss and the operating point at it."""
    t = fit_temperature(scored)
    return select_threshold(selective_risk(predict(scored, t))).withColumn("temperature", F.lit(t))


def contract_checks(scored: DataFrame, dim: DataFrame, temperature: float, least: float) -> DataFrame:
    """(check, ok) of what would mislabel predictions without an error."""
    d = dim.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_id").alias("ids"))
    widths = scored.agg(F.min(F.size("scores")).alias("lo"), F.max(F.size("scores")).alias("hi"))
    row = d.crossJoin(F.broadcast(widths))  # one row each
    checks = {"has classes": F.col("n") > 0, "ids differ": F.col("n") == F.col("ids"), "width fits": (F.col("lo") == F.col("n")) & (F.col("hi") == F.col("n")), "temperature plausible": F.lit(0 < temperature <= 20), "threshold plausible": F.lit(0 <= least < 1)}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])).alias("x")).select("x.*")


def latency_summary(rows: DataFrame, by="run", value="latency_ms") -> DataFrame:
    """mean, min, nearest-rank percentiles, max, population deviation and a verdict for each run.

    A percentile is the value of one rank: round half even of p * (n - 1). Equal values are first counted, and counts are placed by running sums over ranges of (run, value), so that no run is one task's.
    """
    counts = running(rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c")), [by, value], before=F.col("c"))
    stats = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("stdev"))
    begins = counts.groupBy(by).agg(F.min("before").alias("begin"))
    upto = F.col("before") - F.col("begin") + F.col("c")
    at = lambda q: F.min(F.when(upto > F.bround(F.lit(q) * (F.col("n") - 1)), F.col(value)))
    pct = counts.join(stats.select(by, "n").join(begins, by), by).groupBy(by).agg(*[at(q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)])
    verdict = F.when(F.col("p95") < 500, "good").when(F.col("p95") < 1500, "usable").otherwise("too slow")
    return stats.join(pct, by).withColumn("verdict", verdict)
