"""What the training-text operators share: reading, checkpoints, folders, scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.storage import checkpointed as cut
from harrow.functions.storage import shared_path

__all__ = ["WORD", "bytes_of", "cut", "hashable", "held_out", "is_small", "join_few", "let", "shared_path", "small_batches", "table", "text_bytes", "without"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows=1000) -> None:
    """Lowers the session's rows for each Arrow batch to `rows`, where it is higher, so that a batch of whole texts stays small in a worker's memory. The setting stays: it is read when a result is computed, after the operator has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def held_out(id_col: str) -> Column:
    """True for rows whose label must not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is bound, where a named column would be inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts; sizes the buckets of what is shuffled."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def bytes_of(rows: DataFrame) -> Column:
    """About how many bytes a row holds: texts and binaries by their length, nested columns by that of their JSON."""
    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)
    return sum((of(f) for f in rows.schema.fields), F.lit(0)).cast("long")


def is_small(rows: DataFrame, most_rows=300_000, most_bytes=32 << 20) -> bool:
    """Whether rows, computed already, may be broadcast: by their number and by their bytes."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(bytes_of(rows))).first()
    return n <= most_rows and (size or 0) <= most_bytes


def join_few(many: DataFrame, few: DataFrame, on, how="inner", broadcast_rows=300_000, ready=False, broadcast_bytes=32 << 20) -> DataFrame:
    """many joined with few, which has one row for each key and is computed once (or has been: ready): broadcast up to broadcast_rows rows and broadcast_bytes bytes, beyond that shuffled. As nothing but the join is done
    with the shuffled rows, adaptive execution can split a key that many rows have."""
    few = few if ready else cut(few)
    return many.join(F.broadcast(few) if broadcast_rows and is_small(few, broadcast_rows, broadcast_bytes) else few, on, how)


def without(rows: DataFrame, gone: DataFrame, key: str, broadcast_rows=300_000) -> DataFrame:
    """rows whose key is not in gone. gone is computed once, and broadcast while it is small (join_few); beyond that both sides are shuffled."""
    return join_few(rows, gone.select(key).distinct(), key, "left_anti", broadcast_rows)


def hashable(rows: DataFrame) -> list[Column]:
    """Columns that say what a row holds and can be hashed and compared: a column that holds a map, at any depth, as its JSON; each with whether it is null."""
    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else c
    return [x for f in rows.schema.fields for x in (of(f), F.col(f"`{f.name}`").isNull())]
