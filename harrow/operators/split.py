"""Splits without leakage, weights and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.ranking import hash_rank, running
from harrow.functions.storage import checkpointed


def group_split(records: DataFrame, val=0.15, test=0.15, seed=1337, least=1) -> DataFrame:
    """records with split: per class, whole groups go to test, val or train in hash order; sizes are half-even rounded, at least `least` where a class has three groups, and one group stays in train."""
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise ValueError("val + test must be in [0, 1)")
    groups = records.select("class_id", "group_key").distinct().withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), "class_id", "group_key")))
    ranked = hash_rank(groups, "class_id", "_key")
    n = F.col("n")
    size = lambda share: F.when(n >= 3, F.greatest(F.bround(n * F.lit(share)), F.lit(float(least)))).otherwise(F.bround(n * F.lit(share)))
    t = F.least(size(test), n - 1)
    v = F.least(size(val), F.greatest(n - t - 1, F.lit(0.0)))
    split = F.when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "val").otherwise("train")
    return records.join(ranked.select("class_id", "group_key", split.alias("split")), ["class_id", "group_key"])


def leaked_groups(split: DataFrame) -> DataFrame:
    """Groups in more than one split; a group of two classes can be."""
    return split.groupBy("group_key").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n")).where("splits > 1")


def degenerate_grouping(split: DataFrame) -> DataFrame:
    return split.groupBy("class_id").agg(F.count_distinct("group_key").alias("groups"), F.count(F.lit(1)).alias("n")).where("groups < 3 AND n >= 3")


def missing_split(split: DataFrame) -> DataFrame:
    each = split.groupBy("class_id").agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "test").alias("test"))
    return each.where("val = 0 OR test = 0").select("class_id", (F.col("val") == 0).alias("no_val"), (F.col("test") == 0).alias("no_test"))


def class_weights(records: DataFrame, classes: DataFrame, beta=0.999) -> DataFrame:
    """(class_id, n, weight): by effective number of samples, mean 1 over classes present, 0 for absent ones."""
    counts = records.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    rows = classes.select("class_id").join(counts, "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    raw = F.when(F.col("n") > 0, (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))).otherwise(0.0)
    mean = rows.where("n > 0").agg(F.avg(raw).alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).select("class_id", "n", (raw / F.col("_mean")).alias("weight"))


def balanced_resample(records: DataFrame, seed=1337) -> DataFrame:
    """A sample with replacement of exactly as many rows as the input, in which the classes' shares are equal up to one row: records with copy (from 1, of each row's draws).

    Draw k, from 0, is of class k modulo the number of classes, in order of class id, and of the row there at the place that a hash of seed and k gives. Rows are placed by running sums over the order of class
    and path, draws are counted by place, and both are joined on it; so no class is one task's, and reruns agree. No rows give no rows.
    """
    placed = checkpointed(running(records, ["class_id", "path"], _place=F.lit(1)))
    classes = checkpointed(running(placed.groupBy("class_id").agg(F.min("_place").alias("_begin"), F.count(F.lit(1)).alias("_n")), ["class_id"], _c=F.lit(1)))
    total, different = classes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    draws = records.sparkSession.range(total or 0).select((F.col("id") % max(different, 1)).alias("_c"), F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long").alias("_h"))
    times = draws.join(classes, "_c").groupBy((F.col("_begin") + F.col("_h") % F.col("_n")).alias("_place")).agg(F.count(F.lit(1)).cast("int").alias("_k"))
    return placed.join(times, "_place").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_place", "_k")


def systematic_sample(records: DataFrame, limit: int, by=("class_id", "path")) -> DataFrame:
    """Every floor(n / limit)-th row of each split in order, the first `limit` of them.

    The order is range-partitioned; a row's place is its partition's offset and its place there, so no task sorts a whole split.
    """
    n = records.groupBy("split").agg(F.count(F.lit(1)).alias("_n"))
    ordered = records.repartitionByRange(F.col("split"), *[F.col(c) for c in by]).withColumn("_p", F.spark_partition_id())
    ordered = checkpointed(ordered)
    counts = ordered.groupBy("split", "_p").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("split").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    i = F.row_number().over(Window.partitionBy("split", "_p").orderBy(*by)) - 1
    rows = ordered.withColumn("_i", i).join(counts, ["split", "_p"]).join(n, "split").withColumn("_i", F.col("_i") + F.col("_before"))
    stride = F.greatest(F.floor(F.col("_n") / limit), F.lit(1))
    return rows.where((F.col("_i") % stride == 0) & (F.col("_i") / stride < limit)).drop("_p", "_i", "_before", "_n")


def fingerprint(records: DataFrame, path="path") -> DataFrame:
    """One value for a set of paths that no order changes: the bitwise exclusive or of 60 bits of each path's md5, and the count."""
    bits = F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("long")
    return records.agg(F.bit_xor(bits).alias("fingerprint"), F.count(F.lit(1)).alias("n"))
