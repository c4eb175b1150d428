"""Curation of licensed observations: search names, photos, budgets, credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Licences that allow reuse; photo sizes in an address; what is no part of a scientific name; ranks below a species.
LICENCES = ("cc0", "cc-by", "cc-by-sa")
SIZES = r"/(small|medium|large|original|square)\."
NOISE = r"(?i)\b(spp?|sp|larvae|larva|adults?|nymphs?|complex|and allied shield bugs|and allied|vectored|whitefly-vectored|aphid-vectored|leafhopper-vectored|psyllid-vectored|shortage|mobile nutrient|immobile nutrient)\b\.?"
BELOW_SPECIES = r"(?i)\s+(pv|f\. ?sp|subsp|ssp|var|forma)\.?\s+.*$"
SEPARATOR = r"\s*[/,;]\s*|\s+-\s+"
NO_QUERY = ("deficiency", "abiotic", "background")

OBSERVATION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("taxon", T.StructType([T.StructField("name", T.StringType())])), T.StructField("user", T.StructType([T.StructField("login", T.StringType()), T.StructField("name", T.StringType())])),
    T.StructField("place_guess", T.StringType()), T.StructField("observed_on", T.StringType()),
    T.StructField("photos", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("license_code", T.StringType()), T.StructField("attribution", T.StringType()), T.StructField("url", T.StringType())]))),
])


def read_observations(spark, path: str) -> DataFrame:
    """Observations of landed JSON pages, one object with `results` a line."""
    return spark.read.schema(T.StructType([T.StructField("results", T.ArrayType(OBSERVATION))])).json(path).select(F.explode("results").alias("o")).select("o.*")


def taxon_queries(agent: Column, category: Column) -> Column:
    """Names to search for in an agent's text: what stands in parentheses first, then the rest, cut at separators and cleaned; those that look scientific, each once, more words first."""
    inner = F.flatten(F.transform(F.regexp_extract_all(agent, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda s: F.split(s, SEPARATOR)))
    outer = F.split(F.regexp_replace(agent, r"\([^)]*\)", " "), SEPARATOR)
    def tidy(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.trim(s), BELOW_SPECIES, ""), NOISE, " ")
        return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z ]", " "), r"\s+", " "))
    def scientific(s: Column) -> Column:
        words = F.split(s, " ")
        return (F.length(s) >= 4) & F.size(words).between(1, 3) & s.rlike("^[A-Z]") & ~F.arrays_overlap(F.transform(words, lambda w: F.lower(w)), F.array(F.lit("virus"), F.lit("viroid"))) & ~F.lower(F.get(words, F.lit(0))).isin("the", "and", "spp", "sp", "pv")
    names = F.array_distinct(F.filter(F.transform(F.concat(inner, outer), tidy), scientific))
    placed = F.array_sort(F.transform(names, lambda s, i: F.struct((-F.size(F.split(s, " "))).alias("n"), i.alias("i"), s.alias("s"))))
    return F.when(agent.isNull() | F.coalesce(category.isin(*NO_QUERY), F.lit(False)), F.array().cast("array<string>")).otherwise(F.transform(placed, lambda x: x["s"]))


def collectable(classes: DataFrame, categories=("pest",), crops=None) -> DataFrame:
    """Classes of the categories and crops ('any' always) that have a name to search for, with `queries`."""
    rows = classes.where(F.col("category").isin(*categories))
    if crops:
        rows = rows.where((F.col("crop") == "any") | F.lower("crop").isin(*[c.lower() for c in crops]))
    return rows.withColumn("queries", taxon_queries(F.col("agent"), F.col("category"))).where(F.size("queries") > 0)


def resized(url: Column, size="large") -> Column:
    return F.regexp_replace(url, SIZES, f"/{size}.")


def photos(observations: DataFrame, licences=LICENCES, size="large", carry=("class_id", "taxon_query")) -> DataFrame:
    """A row for each photo with an allowed licence (no licence: reserved) and an address."""
    keep = [c for c in carry if c in observations.columns]
    rows = observations.select(*keep, F.col("id").alias("observation_id"), F.coalesce(F.col("taxon.name"), F.lit("")).alias("taxon_name"), F.coalesce("user.login", "user.name", F.lit("unknown")).alias("observer"), F.coalesce("place_guess", F.lit("")).alias("place_guess"), F.coalesce("observed_on", F.lit("")).alias("observed_on"), F.explode("photos").alias("p"))
    rows = rows.withColumn("licence", F.lower(F.coalesce("p.license_code", F.lit("")))).where(F.col("licence").isin(*licences) & F.col("p.url").isNotNull() & (F.col("p.url") != ""))
    return rows.select(*keep, "observation_id", F.col("p.id").alias("photo_id"), "licence", F.coalesce("p.attribution", F.lit("")).alias("attribution"), "observer", "taxon_name", "place_guess", "observed_on", resized(F.col("p.url"), size).alias("url"))


def first_of_photo(rows: DataFrame, order=("class_rank", "query_rank", "observation_id")) -> DataFrame:
    """One row for each photo: the first by class, query and observation. A pre-aggregated minimum, so a photo that recurs often is one row for each task."""
    rest = [c for c in rows.columns if c not in order and c != "photo_id"]
    return rows.groupBy("photo_id").agg(F.min(F.struct(*order, *rest)).alias("x")).select("photo_id", "x.*")


def within_budget(rows: DataFrame, most: int, order=("query_rank", "photo_id")) -> DataFrame:
    """The first `most` photos of each class; Spark keeps no more than that of a class in each task before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(*order))).where(F.col("place") <= most)


def availability(rows: DataFrame, classes: DataFrame, thin=50) -> DataFrame:
    n = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("photos"))
    return classes.select("class_id").join(n, "class_id", "left").select("class_id", F.coalesce("photos", F.lit(0).cast("long")).alias("photos")).withColumn("thin", F.col("photos") < thin)


def credits(rows: DataFrame) -> DataFrame:
    return rows.groupingSets([["licence"], ["observer"], []], "licence", "observer").agg(F.count(F.lit(1)).alias("n"))


def collection_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("photos"), F.count_distinct("class_id").alias("classes"), F.count_distinct("observer").alias("observers"), F.count_distinct("licence").alias("licences"))


def top_up(counts: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Collectable classes under the minimum, and how many they lack. counts: (class_id, n)."""
    short = classes.select("class_id").join(counts, "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where(F.col("n") < least)
    return short.join(collectable(classes, ("pest", "disease")).select("class_id"), "class_id", "left_semi").withColumn("lacking", F.lit(least) - F.col("n"))
