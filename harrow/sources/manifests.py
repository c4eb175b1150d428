"""Readers and writers of manifests, class tables, maps and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.sources.versions import read_tables, write_tables
from pyspark.sql import types as T

from harrow.functions import text as X

FIELDS = ("path", "class_id", "category", "severity", "life_stage", "group", "split", "source")
DEFAULTS = {"severity": "unknown", "life_stage": "unknown", "split": "train", "group": "", "source": ""}
PROVENANCE = ("class_id", "taxon_query", "observation_id", "photo_id", "licence", "attribution", "observer", "taxon_name", "place_guess", "observed_on", "url", "path")
_strings = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_manifest(spark: SparkSession, path: str, split: str | None = None, fmt="parquet") -> DataFrame:
    """A manifest with defaults for what is missing; a split is a predicate on the partition column."""
    df = spark.read.csv(path, header=True, schema=_strings(FIELDS)) if fmt == "csv" else spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in FIELDS])


def write_manifest(records: DataFrame, path: str, fmt="parquet") -> None:
    rows = records.select(*FIELDS)
    if fmt == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").partitionBy("split").parquet(path)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of image files under root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").where(X.is_image(F.col("path")))


_etl = T.StructType([T.StructField("threshold", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("note", T.StringType())])
CLASS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "crop", "name", "category", "agent", "agent_type", "spread_risk", "symptoms")] + [T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("vector", T.StringType()), T.StructField("etl", _etl), T.StructField("generic", T.BooleanType()), T.StructField("etl_note", T.StringType())])


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """The class table of a JSON file, an object with `classes` or a bare list, with class_idx in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.startswith("v", F.lit("[")), F.col("v")).otherwise(F.get_json_object("v", "$.classes"))
    rows = whole.select(F.posexplode(F.from_json(listed, T.ArrayType(CLASS_SCHEMA))).alias("class_idx", "c")).select("class_idx", "c.*")
    return rows.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "generic": F.coalesce("generic", F.lit(False)), "etl_note": F.coalesce("etl_note", F.lit("")), "spread_risk": F.coalesce("spread_risk", F.lit("none"))})


def write_classes(classes: DataFrame, path: str) -> None:
    """One JSON object with the classes in their order; the table is a small dimension."""
    body = classes.agg(F.array_sort(F.collect_list(F.struct("class_idx", *[f.name for f in CLASS_SCHEMA]))).alias("x"))
    body.select(F.to_json(F.struct(F.transform("x", lambda c: F.struct(*[c[f.name].alias(f.name) for f in CLASS_SCHEMA])).alias("classes"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_dataset_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, class_id, stage) and (index, reason) of a JSON map."""
    whole = spark.read.text(path, wholetext=True)
    m = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.map"), "map<string,array<string>>")).alias("k", "v")).select(F.col("k").cast("int").alias("index"), F.get("v", F.lit(0)).alias("class_id"), F.get("v", F.lit(1)).alias("stage"))
    e = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.excluded"), "map<string,string>")).alias("k", "reason")).select(F.col("k").cast("int").alias("index"), "reason")
    return m, e


def read_index_names(spark: SparkSession, path: str) -> DataFrame:
    """(index, name) of lines `number name`; other lines are skipped."""
    line = r"^(\d+)[\t ]+(.+)$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).cast("int").alias("index"), F.trim(F.regexp_extract("value", line, 2)).alias("name"))


def read_knowledge(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category defaults and class overrides as (key, entry map), and messages (key, lang, text), of one JSON file."""
    whole = spark.read.text(path, wholetext=True)
    entries = lambda part: whole.select(F.explode(F.from_json(F.get_json_object("value", f"$.{part}"), "map<string,map<string,string>>")).alias("key", "entry"))
    return entries("defaults"), entries("classes"), entries("generic_messages").select("key", F.explode("entry").alias("lang", "text"))


def write_provenance(photos: DataFrame, path: str) -> None:
    photos.select(*PROVENANCE).write.mode("overwrite").csv(path, header=True)


def write_dropped(cleaned: DataFrame, path: str) -> None:
    """The audit of dropped rows, by reason."""
    cleaned.where("reason IS NOT NULL").select("reason", "path", "class_id").orderBy("reason", "path").write.mode("overwrite").csv(path, header=True)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as one JSON line."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def union_sources(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora as one, with corpus and its place; columns that one lacks are null."""
    parts = [df.withColumns({"corpus": F.lit(name), "place": F.lit(i)}) for i, (name, df) in enumerate(corpora.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of what was fitted, as one new version: a reader has all of the one before or all of this one."""
    write_tables(tables, path)


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return read_tables(spark, path, *names)


def write_policy(row: DataFrame, path: str) -> DataFrame:
    """Writes a re-tuned policy of one row as the version that replaces the one before, and returns it as read back."""
    write_tables({"policy": row.coalesce(1)}, path)
    return read_policy(row.sparkSession, path)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return read_tables(spark, path, "policy")["policy"]
