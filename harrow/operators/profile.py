"""Profiles of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.ranking import quantiles, running
from harrow.functions.storage import checkpointed


def class_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def totals(records: DataFrame) -> DataFrame:
    """Rows and classes in all, by source and by split."""
    return records.groupingSets([["source"], ["split"], []], "source", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_id").alias("classes"))


def balance(records: DataFrame) -> DataFrame:
    c = checkpointed(class_counts(records))
    median = quantiles(c.select(F.lit("all").alias("name"), F.col("n").alias("x")), {"median": 0.5}).select("median")
    large, small = F.struct(F.col("n"), F.col("class_id")), F.struct(-F.col("n"), F.col("class_id"))
    return c.agg(F.max_by("class_id", large).alias("largest"), F.max("n").alias("most"), F.max_by("class_id", small).alias("smallest"), F.min("n").alias("least"), (F.max("n") / F.min("n")).alias("ratio")).join(median, F.lit(True), "left")  # one row each


def gini(counts: DataFrame, n="n") -> DataFrame:
    """Gini coefficient of counts. Equal counts are grouped first; their ranks follow from how many counts are smaller."""
    groups = running(counts.groupBy(F.col(n).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c")), ["x"], before=F.col("c"))
    ranks = F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2
    m, total = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    return groups.agg((2 * F.sum(ranks * F.col("x")) / (m * total) - (m + 1) / m).alias("gini"))


def below(records: DataFrame, train=60, evaluation=30) -> DataFrame:
    """Classes below the training minimum, or below three times the evaluation minimum."""
    return class_counts(records).where((F.col("n") < train) | (F.col("n") < 3 * evaluation)).withColumns({"under_train": F.col("n") < train, "under_eval": F.col("n") < 3 * evaluation})


def top_bottom(counts: DataFrame, k=10) -> DataFrame:
    """The k largest and k smallest classes with their places from above and from below, ties by id. Each end is a limited order; the places of the 2 k classes at most are counted in one pass over all."""
    counts = checkpointed(counts)
    ends = counts.orderBy(F.desc("n"), "class_id").limit(k).union(counts.orderBy("n", "class_id").limit(k)).distinct().collect()
    if not ends:
        return counts.withColumns({c: F.lit(0) for c in ("top", "bottom")})
    n, name = F.col("n"), F.col("class_id")
    before = lambda r: (F.count_if((n > r["n"]) | ((n == r["n"]) & (name < r["class_id"]))), F.count_if((n < r["n"]) | ((n == r["n"]) & (name < r["class_id"]))))
    rows = counts.agg(F.array(*[F.struct(*[F.lit(r[c]).cast(counts.schema[c].dataType).alias(c) for c in counts.columns], *[(x + 1).cast("int").alias(c) for c, x in zip(("top", "bottom"), before(r))]) for r in ends]).alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*")


def coverage(records: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows and classes by crop, rows by category."""
    rows = records.select("class_id").join(classes.select("class_id", "crop", "category"), "class_id")
    return rows.groupingSets([["crop"], ["category"]], "crop", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_id").alias("classes"))


def without_healthy(records: DataFrame, classes: DataFrame) -> DataFrame:
    rows = records.select("class_id").distinct().join(classes.select("class_id", "crop", "category"), "class_id").where("crop <> 'any'")
    return rows.groupBy("crop").agg(F.bool_or(F.col("category") == "healthy").alias("h"), F.count(F.lit(1)).alias("classes")).where("NOT h").drop("h")


def label_fractions(records: DataFrame) -> DataFrame:
    """Shares of rows with a severity, and of pest rows with a life stage."""
    pest = F.col("category") == "pest"
    return records.agg(F.avg((~F.col("severity").isin("unknown", "")).cast("double")).alias("severity_labelled"), F.count_if(pest).alias("pest_rows"), F.coalesce(F.avg(F.when(pest, (F.col("life_stage") != "unknown").cast("double"))), F.lit(0.0)).alias("stage_labelled"))


def percentiles(facts: DataFrame, columns: dict, at=(0.05, 0.5, 0.95), approximate=False) -> DataFrame:
    """(name, p05, p50, p95) of each expression over readable rows; exact with linear interpolation, or approximate on request."""
    if not approximate:
        named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), e.cast("double").alias("x")) for k, e in columns.items()]))
        return quantiles(facts.where("ok").select(named.alias("v")).select("v.*"), {f"p{round(q * 100):02d}": q for q in at}).drop("n")
    good = facts.where("ok").agg(*[F.percentile_approx(e, F.array(*[F.lit(q) for q in at])).alias(k) for k, e in columns.items()])
    return good.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), *[F.get(k, F.lit(i)).cast("double").alias(f"p{round(q * 100):02d}") for i, q in enumerate(at)]) for k in columns])).alias("x")).select("x.*")


def shares(facts: DataFrame, side=224) -> DataFrame:
    ok = F.col("ok")
    sizes = F.count_distinct(F.when(ok, F.struct("width", "height")))
    return facts.agg(F.count_if(ok).alias("decoded"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, (F.least("width", "height") < side).cast("double"))).alias("below_side"), F.avg(F.when(ok, F.col("mode").isin("L", "1").cast("double"))).alias("greyscale"), sizes.alias("resolutions"), (sizes <= 3).alias("uniform"))


def group_sizes(records: DataFrame) -> DataFrame:
    sizes = records.groupBy("group_key").agg(F.count(F.lit(1)).alias("x")).select(F.lit("all").alias("name"), "x")
    return quantiles(sizes, {"p95": 0.95}).select(F.col("n").alias("groups"), "p95")


def recommend(profile: DataFrame) -> DataFrame:
    """(place, advice) of one profile row: what its numbers imply, in a fixed order."""
    c = F.col
    rules = [
        (c("ratio") > 20, "strong imbalance: sample by class and cap classes"), ((c("ratio") > 5) & (c("ratio") <= 20), "imbalance: sample by class"), (c("under_train") > 0, "classes too small to train"), (c("uniform"), "few resolutions: a studio corpus"),
        (c("below_side") > 0.3, "many small images"), (c("greyscale") > 0.02, "greyscale images"), (c("leaked") > 0, "groups in several splits: split again"), (c("missing_val") > 0, "classes without validation rows"),
        ((c("pest_rows") > 0) & (c("stage_labelled") < 0.5), "few life stages"), (c("severity_labelled") < 0.05, "no severities"), (c("no_healthy") > 0, "crops without a healthy class"), (c("unknown_classes") > 0, "classes not in the dimension"),
    ]
    return profile.select(F.posexplode(F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))).alias("place", "advice"))
