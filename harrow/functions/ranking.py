"""Ranks within large groups by a uniform hash, and running sums over a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.storage import checkpointed


def hash_rank(rows: DataFrame, group: str, key: str, rows_per_range=100_000, salts=32) -> DataFrame:
    """rows with rank (from 1, by the hex digest `key` within `group`) and n, the group's rows.

    A group is cut into ranges of the digest, as many as its size asks for; a range's rows are ranked in a window, and the rows of earlier ranges are
    added. So a group that holds a third of all rows is ranked by many tasks; sizes are joined on the group and a salt of the key for the same reason. Keys must
    differ within a group.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = rows.withColumn("_salt", F.pmod(F.hash(key), F.lit(salts))).join(sizes, [group, "_salt"]).drop("_salt").withColumn("_range", F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("n") / rows_per_range)).cast("long"))
    counts = placed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key))
    return placed.withColumn("_within", within).join(counts, [group, "_range"]).withColumn("rank", F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def running(rows: DataFrame, order: list, **values: Column) -> DataFrame:
    """rows with, under each name, the sum of its expression over all rows before in the order (0 at the first).

    Rows are range-partitioned by the whole order and kept in the shared folder; a row's sum is that of the partitions before, of which there are few, and of the rows
    before in its own. So no key and no group is one task's, as long as the order tells rows apart; rows that are alike in it may take each other's place.
    """
    part = "__part"
    placed = checkpointed(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = placed.groupBy(part).agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in values])
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in values.items()}).join(F.broadcast(sums), part)
    return placed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in values}).drop(part, *[f"__{n}" for n in values])


def quantiles(values: DataFrame, at: dict[str, float], by="name", value="x") -> DataFrame:
    """(by, n, and a column for each entry of `at`): exact quantiles of each group with linear interpolation between ranks; nulls take no part.

    Equal values are counted first; counts are placed by running sums over ranges of (group, value), so that neither a group nor a column of different values is one task's. Groups are few.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, [by, "_x"], _at=F.col("_c"))
    groups = placed.groupBy(by).agg(F.min("_at").alias("_begin"), F.sum("_c").alias("n"))
    placed = placed.join(groups, by).withColumn("_at", F.col("_at") - F.col("_begin"))

    def of(rank: Column) -> Column:
        return F.max(F.when((F.col("_at") <= rank) & (rank < F.col("_at") + F.col("_c")), F.col("_x")))

    place = {k: F.lit(float(q)) * (F.col("n") - 1) for k, q in at.items()}
    found = placed.groupBy(by, "n").agg(*[x for k, p in place.items() for x in (of(F.floor(p)).alias(f"_{k}_low"), of(F.ceil(p)).alias(f"_{k}_high"))])
    return found.select(by, "n", *[(F.col(f"_{k}_low") + (F.col(f"_{k}_high") - F.col(f"_{k}_low")) * (p - F.floor(p))).alias(k) for k, p in place.items()])
