"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import cut, join_few, let

#: What separates words once A-Z are lower case, the same before that, and the letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; other letters stay. Null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(folded, SEPARATORS), ""), F.array().cast("array<string>"))


def _shifted(a: Column, shift: int, join) -> Column:
    """join(a[i], a[i + shift]) for each i."""
    n = F.greatest(F.size(a) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), lambda x, y: join(x, y))


def spans(a: Column, width: int, join, then) -> Column:
    """then(what join makes of each `width` neighbours), by doubling: each step joins two, perhaps overlapping, halves."""
    def step(a: Column, have: int) -> Column:
        if have == width:
            return then(a)
        more = min(have, width - have)
        return let(_shifted(a, more, join), lambda b: step(b, have + more))
    return step(a, 1)


def _levels(w: Column, top: int, then) -> Column:
    """then({1, 2, 4, ... up to top: the hashes of as many neighbours}) of a word array."""
    def step(have: dict[int, Column], n: int) -> Column:
        return let(_shifted(have[n], n, F.xxhash64), lambda h: step(have | {2 * n: h}, 2 * n)) if 2 * n <= top else then(have)
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: step({1: h}, 1))


def _level(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def fingerprints(w: Column, lengths: list[int], window: int, k: int) -> Column:
    """Different fingerprints of a word array: the least hash of each full window's k-grams, and for shorter items, whose lengths are given, the hashes of as many words as make up a power of two."""
    def of(h: dict[int, Column]) -> Column:
        short = [h[n] for n in sorted({_level(n) for n in lengths if n < window})]
        return F.array_distinct(F.concat(*short, *([spans(h[k], window - k + 1, F.least, lambda m: m)] if window in lengths else [])))
    return _levels(w, max(k, _level(max(lengths))), of)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", window=10, k=8) -> DataFrame:
    """What each document shares with the benchmark: (doc_id, n_words, n_hit, n_items, items, contaminated).

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. A document's word is hit if any
    occurrence of a window covers it. Winnowing keeps, of each window's k-gram hashes, the least; equal windows have equal least hashes, so
    every shared window shares a fingerprint. Fingerprints of documents and items are joined; in the documents that share one, places whose hash is that of a window are
    compared with the windows word by word, and hits are extended over all windows that match. Items shorter than a window are fingerprinted by their
    first words, as many as make up a power of two; k is a power of two. The benchmark's side is broadcast while it is small and shuffled beyond. A window has one row however many items have it: it carries the name of
    its set of items, and the items of each combination of sets are listed once.

    items holds the ids of the items with occurring windows, sorted as strings. Null and wordless texts have no words; items without
    words take no part. Rows that repeat an id are judged each by its own text. Other columns are ignored. No rows give no rows.
    """
    if k & (k - 1) or not 0 < k <= window:
        raise ValueError("k must be a power of two and at most the window")
    rid = F.xxhash64(id_col, text_col)
    items = cut(benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(window))).distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rid.alias("rid"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    if not lengths:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    # each window, by length and words, with the name of its set of items; each set once
    gram = lambda w, at, n: F.array_join(F.slice(w, at, n), " ")
    named = items.select("item_id", F.least(F.size("w"), F.lit(window)).alias("n"), "w").select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda at: gram(F.col("w"), at, F.col("n")))).alias("g"))
    windows = named.groupBy("n", "g").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    windows = cut(windows.withColumn("set", F.sha2(F.to_json("items"), 256)))
    sets = windows.groupBy("set").agg(F.first("items").alias("items"))
    short = [n for n in lengths if n < window]
    whole = [F.when(F.col("n") == window, F.get(fingerprints(F.split("g", " "), [window], window, k), F.lit(0)))] if window in lengths else []
    head = lambda n: F.when(F.col("n") == n, _levels(F.slice(F.split("g", " "), 1, _level(n)), _level(n), lambda h: F.get(h[_level(n)], F.lit(0))))
    prints = windows.select(F.coalesce(*[head(n) for n in short], *whole).alias("f")).distinct()
    heads = windows.select(F.coalesce(*[head(n) for n in lengths]).alias("f"), "n").groupBy("f").agg(F.collect_set("n").alias("ns"))

    shared = docs.select(rid.alias("rid"), F.explode(fingerprints(words(F.col(text_col)), lengths, window, k)).alias("f"))
    shared = join_few(shared, prints, "f", "left_semi").groupBy("rid").agg(F.count(F.lit(1)).alias("_n")).select("rid")
    suspects = join_few(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rid.alias("rid")), shared, "rid", "left_semi")
    # places whose first words have the hash of a window's, then all words
    at_levels = sorted({_level(n) for n in lengths})
    spots = lambda h: F.flatten(F.array(*[F.transform(h[n], lambda f, i: F.struct((i + 1).alias("at"), f.alias("f"))) for n in at_levels]))
    places = suspects.select("doc_id", "rid", F.explode(_levels(words(F.col("text")), at_levels[-1], spots)).alias("x")).select("doc_id", "rid", F.col("x.at").alias("at"), F.col("x.f").alias("f"))
    places = join_few(places, heads, "f").groupBy("rid", "doc_id").agg(F.collect_set(F.struct("at", "ns")).alias("places"))
    both = suspects.alias("a").join(places.alias("b"), (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")))
    texts = let(words(F.col("a.text")), lambda w: F.flatten(F.transform("b.places", lambda p: F.transform(p["ns"], lambda n: F.struct(p["at"].alias("at"), n.alias("n"), gram(w, p["at"], n).alias("g"))))))
    places = both.select("a.rid", "a.doc_id", F.explode(texts).alias("x")).select("rid", "doc_id", "x.*").distinct()
    hits = cut(join_few(places, windows.select("n", "g", "set"), ["n", "g"], ready=True))
    # words that are hit, and the items of each combination of sets that some document has
    reached = F.max("stop").over(Window.partitionBy("rid", "doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.groupBy("rid", "doc_id", "at").agg(F.max(F.col("at") + F.col("n")).alias("stop"))
    covered = covered.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("at"), F.coalesce(reached, F.lit(0)))))
    covered = covered.groupBy("rid", "doc_id").agg(F.sum("new").cast("long").alias("n_hit"))
    of = cut(hits.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_set("set")).alias("sets")).withColumn("several", F.sha2(F.array_join("sets", ","), 256)))
    lists = join_few(of.groupBy("several").agg(F.first("sets").alias("sets")).select("several", F.explode("sets").alias("set")), sets, "set", broadcast_rows=10_000)
    lists = lists.select("several", F.explode("items").alias("item")).groupBy("several").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = join_few(of.select("rid", "doc_id", "several"), lists, "several", broadcast_rows=10_000).select("rid", "doc_id", "items")
    found = found.alias("a").join(covered.alias("b"), (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select("a.rid", "a.doc_id", "a.items", "b.n_hit")
    mine = rows.drop("text").alias("a").join(found.alias("b"), (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    n_hit, ids = F.coalesce("b.n_hit", F.lit(0).cast("long")), F.coalesce("b.items", F.array().cast("array<string>"))
    return mine.select("a.doc_id", "a.n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"))
