"""Line deduplication over content-defined chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import cut, join_few, let


def chunks(text: Column, divisor: int, with_text: bool) -> Column:
    """The multi-line chunks of a text as structs (j: first line from 0, n: lines, key: md5, and body if asked for).

    A line's hash is the first 32 bits of its md5. The rolling hash at a line is 31 times the hash of the line before plus its own; a chunk
    begins at the first line and wherever that is 0 modulo divisor. Boundaries depend on two lines only, so a passage is cut alike wherever it stands.
    """
    def with_hashes(lines: Column, h: Column) -> Column:
        n = F.size(lines)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ((F.get(h, i - 1) * 31 + F.get(h, i)) % divisor == 0))
        return let(F.concat(starts, F.array(n)), lambda s: pieces(lines, s))

    def pieces(lines: Column, s: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.struct(F.get(s, i).alias("j"), (F.get(s, i + 1) - F.get(s, i)).alias("n")))
        many = F.filter(whole, lambda c: c["n"] >= 2)
        def made(c: Column) -> Column:
            return let(F.array_join(F.slice(lines, c["j"] + 1, c["n"]), "\n"), lambda b: F.struct(c["j"].alias("j"), c["n"].alias("n"), F.md5(b).alias("key"), *([b.alias("body")] if with_text else [])))
        return F.transform(many, made)

    def of(lines: Column) -> Column:
        return let(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")), lambda h: with_hashes(lines, h))

    return let(F.split(text, "\n"), of)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))


def _later(found: DataFrame, lines: int | Column = 1) -> DataFrame:
    """The rows (doc_id, rid, j, key, body, ...) whose body equals, byte for byte, that of the earliest row of their key, and which share none of their `lines` lines with it."""
    first = found.groupBy("key").agg(F.min(F.struct("doc_id", "rid", "j", "body")).alias("first"))
    there = F.struct("doc_id", "rid").eqNullSafe(F.struct("first.doc_id", "first.rid")) & (F.col("j") < F.col("first.j") + lines)
    return join_few(found, first, "key", broadcast_rows=0).where((F.col("body") == F.col("first.body")) & ~there)


def _kept(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """docs without the lines of gone: (doc_id, rid, gone: disjoint structs of first line j and number n)."""
    rid = F.xxhash64(id_col, text_col)
    everything = docs.select(F.col(id_col).alias("doc_id"), rid.alias("rid"), F.col(text_col).alias("text"), *[F.col(x).alias(f"__carry_{x}") for x in carry]).alias("a")
    mine = everything.join(gone.alias("b"), (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    def keep(lines: Column, gone: Column) -> Column:
        dropped = F.flatten(F.transform(gone, lambda c: F.sequence(c["j"], c["j"] + c["n"] - 1)))
        flags = let(F.map_from_entries(F.transform(dropped, lambda j: F.struct(j, F.lit(True)))), lambda m: F.filter(lines, lambda x, i: ~F.coalesce(F.try_element_at(m, i), F.lit(False))))
        return F.array_join(flags, "\n")
    text, n = F.col("a.text"), F.coalesce(F.aggregate("b.gone", F.lit(0), lambda a, c: a + c["n"]), F.lit(0)).cast("long")
    kept = F.when(F.col("b.gone").isNull(), text).otherwise(let(F.split(text, "\n"), lambda lines: keep(lines, F.col("b.gone"))))
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return mine.select("a.doc_id", lines.alias("n_lines"), n.alias("n_removed"), kept.alias("kept_text"), *[F.col(f"a.__carry_{x}").alias(x) for x in carry])


def drop_repeated_chunks(docs: DataFrame, id_col="doc_id", text_col="text", divisor=3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each multi-line chunk that equals, byte for byte, one that stands earlier (by id, then place): (doc_id, n_lines, n_removed, kept_text).

    Chunk keys are counted globally; only chunks whose key occurs twice are compared: the earliest chunk of a key is found with a pre-aggregated minimum, and
    the others go if their bytes equal its bytes. What a third of all documents repeat is one row for each task before the shuffle; the comparison's
    join has one row for each key on one side, so that a hot key's other side can be split.

    Lines end at line feeds; text that is left keeps its lines unchanged. Null texts have 0 lines and a null kept_text; an empty text is one empty line. Null ids come first.
    Rows that repeat id and text are the same document and keep the same lines. No rows give no rows. Columns named in carry are kept, others are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    keys = rows.select("rid", F.explode(chunks(F.col("text"), divisor, False)).alias("c")).groupBy("c.key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    found = rows.select("doc_id", "rid", F.explode(chunks(F.col("text"), divisor, True)).alias("c")).select("doc_id", "rid", "c.*")
    found = cut(join_few(found, keys, "key", "left_semi"))
    gone = _later(found).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("j", "n")).alias("gone"))
    return _kept(docs, gone, id_col, text_col, carry)


def _repeated_chunks(rows: DataFrame, divisor: int) -> DataFrame:
    """(doc_id, rid, j, n, body) of the content-defined chunks that equal, byte for byte, an earlier one which they don't overlap. Chunk keys are counted globally; only bodies of keys that occur twice are fetched."""
    keys = rows.select("rid", F.explode(chunks(F.col("text"), divisor, False)).alias("c")).groupBy("c.key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    found = rows.select("doc_id", "rid", F.explode(chunks(F.col("text"), divisor, True)).alias("c")).select("doc_id", "rid", "c.*")
    return _later(cut(join_few(found, keys, "key", "left_semi")), F.col("n"))


def drop_repeated_runs(docs: DataFrame, id_col="doc_id", text_col="text", carry: tuple[str, ...] = (), divisor=3) -> DataFrame:
    """Removes each run of two or more lines that stands, byte for byte, earlier (by id, then place): columns and edge cases as drop_repeated_chunks().

    First come the content-defined chunks of drop_repeated_chunks(), cut by the rolling hash: one that repeats whole goes. Of a passage whose boundaries lie outside it chunks see nothing, or only its middle; an exact pass over the
    pairs of neighbouring lines that no such chunk has taken follows. A pair that repeats is compared with the earliest one byte for byte; a run that repeats is one whose pairs all do, so every repeated run is removed up to its last line, whatever
    stands around it. A single line that repeats stays. So does a chunk or pair that overlaps the earliest one (of three equal lines in a row none goes, of four the last two), and two
    blank lines next to each other are no pair, in a chunk neither. Places are judged on the input: what an earlier document loses still counts as standing there.

    The earliest place of a pair is in no chunk that goes, so the second pass may leave those out. Pairs are counted by hash as narrow rows; only the bodies of pairs whose hash occurs twice are fetched and compared.
    """
    def solid(c: Column) -> Column:
        """The places of a chunk's pairs that are not blank."""
        return let(F.split(c["body"], "\n"), lambda lines: F.filter(F.sequence(F.lit(0), c["n"] - 2), lambda i: F.concat(F.get(lines, i), F.get(lines, i + 1)).rlike(r"[^\x20\x09-\x0D]")))

    def pairs(lines: Column, made) -> Column:
        n = F.greatest(F.size(lines) - 1, F.lit(0))
        return F.zip_with(F.slice(lines, F.lit(1), n), F.slice(lines, F.lit(2), n), made)

    rolling = lambda a, b: F.when(F.concat(a, b).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(a, b))
    rows = _rows(docs, id_col, text_col)
    taken = _repeated_chunks(rows, divisor).select("doc_id", "rid", "j", F.explode(solid(F.struct("n", "body"))).alias("i"))
    taken = cut(taken.select("doc_id", "rid", (F.col("j") + F.col("i")).alias("j")).distinct())
    hashed = rows.select("doc_id", "rid", F.posexplode(let(F.split("text", "\n"), lambda lines: pairs(lines, rolling))).alias("j", "h")).where("h IS NOT NULL")
    hashed = join_few(hashed, taken.select("rid", "j").distinct(), ["rid", "j"], "left_anti")
    twice = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    places = join_few(hashed, twice, "h", "left_semi").groupBy("doc_id", "rid").agg(F.collect_set("j").alias("places"))
    both = rows.alias("a").join(places.alias("b"), (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")))
    bodies = let(F.split("a.text", "\n"), lambda lines: F.transform("b.places", lambda j: F.struct(j.alias("j"), F.concat(F.get(lines, j), F.lit("\n"), F.get(lines, j + 1)).alias("body"))))
    found = cut(both.select("a.doc_id", "a.rid", F.explode(bodies).alias("c")).select("doc_id", "rid", "c.*").withColumn("key", F.md5("body")))
    lines = _later(found, 2).select("doc_id", "rid", "j").unionByName(taken).groupBy("doc_id", "rid").agg(F.array_distinct(F.flatten(F.collect_set(F.array("j", F.col("j") + 1)))).alias("lines"))
    gone = lines.select("doc_id", "rid", F.transform("lines", lambda j: F.struct(j.alias("j"), F.lit(1).alias("n"))).alias("gone"))
    return _kept(docs, gone, id_col, text_col, carry)
