"""The corpus pipeline: documents of good quality, without repeated lines, near copies and benchmark passages, mixed by source.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of its input; the last adds `epoch` and `taken`. Between
stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.storage import remove
from harrow.llm import quality
from harrow.llm.common import cut, hashable, shared_path, table, without
from harrow.llm.decontamination import contamination
from harrow.llm.line_dedup import drop_repeated_runs
from harrow.llm.minhash_dedup import near_duplicates
from harrow.llm.mixing import take_mix

#: A document is kept if its quality score is at least this.
LEAST_QUALITY = 0.7


def _name(doc_id: Column, text_md5: Column) -> Column:
    """What a row is known by: its id and the 128-bit digest of its text. Rows of one name have the same id and text."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit(":"), F.coalesce(text_md5, F.lit("")))


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of the rows' names, and what that column is called: nothing that docs has."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return docs.withColumn(row, _name(F.col("doc_id"), F.md5(F.col("text").cast("binary")))), row


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labelled documents among its input.

    Null and empty texts have a score as all others. Rows that repeat an id are judged each by its own text. No rows give no rows; all columns stay.
    """
    learned = quality.fit(docs, table(spark, sf_dir, "labels"))
    named, row = _named(docs)
    rejected = quality.score(named, learned, id_col=row).where(F.col("score") < LEAST_QUALITY)
    return without(named, rejected.select(F.col("doc_id").alias(row)), row).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of two or more lines that stand earlier in the corpus; a document of which nothing but white space is left goes.

    Null, empty and blank texts from which nothing is cut stay. Rows that repeat an id are cut each by its own text, alike ones alike. n_chars, where there is one,
    follows a text that is cut. No rows give no rows; all columns stay.
    """
    kept = drop_repeated_runs(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    kept = kept.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    made = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; of those, the one with the smallest digest, and of rows alike in id and text the one with the least hash of its columns.

    Null and wordless texts stay. A null id comes after all others. No rows give no rows; all columns stay.
    """
    named, row = _named(docs)
    classes = near_duplicates(docs)
    copy = ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_md5").eqNullSafe(F.col("class_md5")))
    classes = cut(classes.select(_name(F.col("doc_id"), F.col("text_md5")).alias(row), copy.alias("copy"), "shingles"))
    left = without(named, classes.where("copy"), row)
    again = cut(classes.where("not copy and shingles > 0").groupBy(row).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row))
    if again.isEmpty():
        return left.select(*docs.columns)
    first = left.join(again, row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashable(docs))).alias("first")).select("first.*")
    return without(left, again, row).select(*docs.columns).unionByName(first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and wordless texts stay. Rows that repeat an id are judged each by its own text. No rows give no rows, no items drop none; all columns stay.
    """
    named, row = _named(docs)
    found = contamination(named, table(spark, sf_dir, "benchmark"), id_col=row).where("contaminated")
    return without(named, found.select(F.col("doc_id").alias(row)), row).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; a row for each document and epoch, with `epoch` and `taken`.

    Null and wordless texts are not taken. A null source is a source of its own. Rows that repeat an id, or have none, are each taken on their own. No rows give no rows.
    """
    return take_mix(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix)]

#: The quality classifier and the near-duplicate classes are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is removed when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
