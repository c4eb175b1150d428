"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.ranking import running
from harrow.llm.common import WORD, cut, hashable

#: A broadcast side has at most so many sources; more are shuffled.
BROADCAST_ROWS = 100_000


def source_targets(per_source: DataFrame, weights=(5, 2, 1), share=1.5, most_epochs=2.0) -> DataFrame:
    """A target for each row (source, source_size): share * all sizes, dealt by weight, at most most_epochs * source_size.

    Sources in code-point order, null last, take the weights in turn. What a capped source cannot take goes to the others by
    weight. The level at which uncapped sources end (target = level * weight) follows from the sources in order of cap / weight:
    it is the first level that does not exceed its own source's cap. Places and sums in both orders are running sums over ranges, so that any
    number of sources will do. The input has one row for each source; other columns stay. Sources of size 0 have target 0.
    """
    name = F.col("source").asc_nulls_last()
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = running(per_source, [name], _at=F.lit(1)).withColumn("_weight", F.get(w, (F.col("_at") % len(weights)).cast("int"))).drop("_at")
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs))).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    rows = cut(rows)
    size, weight = rows.agg(F.sum("source_size"), F.sum("_weight")).first()
    rows = running(rows, ["_ratio", name], _caps=F.col("_cap"), _before=F.col("_weight"))
    level = (F.lit(float(size or 0) * share) - F.col("_caps")) / (F.lit(weight or 0.0) - F.col("_before"))
    rows = rows.withColumn("_level", level)
    final = rows.where("_level <= _ratio").agg(F.min(F.struct("_ratio", "_level"))["_level"]).first()[0]
    target = F.col("_cap") if final is None else F.least(F.col("_cap"), F.lit(final) * F.col("_weight"))
    return rows.withColumn("target", target).select(*per_source.columns, "target")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, most_epochs=2.0, seed="mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken).

    Each source is put in a hash-random order (md5 of seed and id) and read from its start until its target, in whole words, is
    reached; a source whose target exceeds its size is read again. The document at the cut is taken in part, so each source ends
    within one word of its target. All sources are range-sorted by source and hash at once, so that neither a source nor an id that many rows repeat
    sits in one task; a document's place is the sum of the ranges before its own and of the rows before it there, less where its source begins.
    Only ids, sizes and hashes are shuffled, never texts.

    Null texts and texts without a word have size 0 and are taken 0 times. A null source is a source of its own, the last. Rows
    that repeat an id each count and are taken on their own. A source of size 0 has target 0. No rows give no rows. Columns named in
    carry are kept and break ties.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))  # null-safe, hash-joinable
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [f"__carry_{c}" for c in carry]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("_key"), name.alias("_source"), *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    sized = cut(sized)  # its ranges are sampled first: words are counted once
    rows = running(sized, ["_source", "_key", "doc_id", "size", *kept], _before=F.col("size"))
    plan = cut(rows.groupBy("_source", "source").agg(F.sum("size").alias("source_size"), F.min("_before").alias("_begin")))
    plan = source_targets(plan, weights, share, most_epochs)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select("_source", "source_size", "target", "_begin", epochs.alias("_epochs"), (budget - epochs * F.col("source_size")).alias("_rest"))
    plan = cut(plan)
    rows = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, "_source")
    cut_at = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") + F.col("_begin") - F.col("_before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + cut_at).cast("long").alias("taken"), *[F.col(k).alias(c) for c, k in zip(carry, kept)])


def row_digest(docs: DataFrame) -> Column:
    """A name of 128 bits for what a row holds, nulls told apart."""
    cells = hashable(docs)
    return F.concat(F.hex(F.xxhash64(*cells)), F.lit("-"), F.hex(F.xxhash64(F.lit("other"), *cells)))


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: a row for each document and epoch, with docs' columns and `epoch` and `taken` (docs' own columns of these names are replaced); a document cut by the budget
    keeps its first words and what stands before and between them.

    Rows that repeat an id, or have none, are each taken on their own. n_chars, where there is such a column, follows the text. No rows give no rows.

    A row is named by two hashes of all its columns and of which are null, so that rows of one name are alike: one of them is joined with how many of them are
    taken how far, and written so many times.
    """
    m = "__mix_"
    while any(c.startswith(m) for c in docs.columns):
        m += "_"
    named = docs.withColumn(f"{m}row", row_digest(docs))
    taken = mix_sources(named, carry=(f"{m}row",), **how).where("taken > 0").groupBy(f"{m}row", F.col("size").alias(f"{m}size"), F.col("taken").alias(f"{m}taken")).agg(F.count(F.lit(1)).alias(f"{m}n"))
    rows = named.dropDuplicates([f"{m}row"]).join(taken, f"{m}row")
    rows = rows.withColumn(f"{m}i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{m}n"))))
    rows = rows.withColumn(f"{m}epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"{m}taken") / F.col(f"{m}size")) - 1)))
    words = F.least(F.col(f"{m}size"), F.col(f"{m}taken") - F.col(f"{m}epoch") * F.col(f"{m}size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col(f"{m}size"), head).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.length(text)}
    out = [made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(c) for c in docs.columns if c not in ("epoch", "taken")]
    return rows.select(*out, F.col(f"{m}epoch").alias("epoch"), words.alias("taken"))
