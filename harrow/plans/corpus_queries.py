"""Queries of cleaning, splitting, sampling and profiling over the document stand-ins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from harrow.functions.storage import checkpointed
from harrow.operators import clean as C
from harrow.operators import profile as P
from harrow.operators import sketches as K
from harrow.operators import split as S
from harrow.plans.registry import query
from harrow.plans.views import SOURCE_CLASSES, dim, sql, table, view

FIELDS = ("path", "class_id", "category", "severity", "life_stage", "group_key", "split", "source")
LIMITS = {"min_side": 20, "max_aspect": 7.2, "min_std": 12.0}


def records(spark, sf_dir):
    return view(spark, sf_dir, "records")


def by_lang(spark, sf_dir):
    return records(spark, sf_dir).withColumn("class_id", F.col("source"))


LANG = "by_lang AS (SELECT * REPLACE (source AS class_id) FROM records)"


def facts(spark, sf_dir):
    f = view(spark, sf_dir, "facts")
    prints = C.simhash(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "path", "text")
    return f.drop("mode").join(prints, "path", "left")


def cleaned(spark, sf_dir):
    return C.clean(records(spark, sf_dir), facts(spark, sf_dir), **LIMITS)


# ---- SQL pieces
_vote = lambda j, b: f"sum(CASE WHEN t{j} & {1 << b} <> 0 THEN 1 ELSE -1 END)"
SIM = "tok AS (SELECT CAST(doc_id AS STRING) AS path, md5(unnest(string_split(text, ' '))) AS m FROM documents), tk AS (SELECT path, " + ", ".join(f"('0x' || substr(m, {4 * j + 1}, 4))::INT AS t{j}" for j in range(4)) + " FROM tok), sim AS (SELECT path, " + ", ".join("(" + " + ".join(f"CASE WHEN {_vote(j, b)} > 0 THEN {1 << b} ELSE 0 END" for b in range(16)) + f")::INT AS h{j}" for j in range(4)) + " FROM tk GROUP BY 1)"
BASE = "base AS (SELECT r.*, f.* EXCLUDE (path, class_id), CASE WHEN NOT f.ok THEN 'unreadable' WHEN least(width, height) < 20 THEN 'too_small' WHEN greatest(width, height) / greatest(least(width, height), 1) > 72e-1 THEN 'extreme_aspect' WHEN f.std < 12 THEN 'blank' END AS defect FROM records r LEFT JOIN facts f USING (path))"
EXACT = "fine AS (SELECT *, first_value(path) OVER w AS first_path, first_value(class_id) OVER w AS first_class FROM base WHERE defect IS NULL WINDOW w AS (PARTITION BY content_hash ORDER BY source_rank, path)), dup AS (SELECT *, CASE WHEN path = first_path THEN NULL WHEN class_id = first_class THEN 'exact_duplicate' ELSE 'cross_label_duplicate' END AS duplicate FROM fine)"
PAIRS = "lf AS (SELECT d.path, d.class_id, sharpness, width * height AS area, h0, h1, h2, h3 FROM dup d JOIN sim USING (path) WHERE duplicate IS NULL), bands AS (SELECT path, h0, h1, h2, h3, unnest([0, 1, 2, 3]) AS band, unnest([h0, h1, h2, h3]) AS v FROM lf), ok AS (SELECT band, v FROM bands GROUP BY ALL HAVING count(*) >= 2), bb AS (SELECT bands.* FROM bands JOIN ok USING (band, v)), pairs AS (SELECT DISTINCT a.path AS a, b.path AS b, (bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2)) + bit_count(xor(a.h3, b.h3)))::INT AS distance FROM bb a JOIN bb b USING (band, v) WHERE a.path < b.path AND bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2)) + bit_count(xor(a.h3, b.h3)) <= 4)"
REACH = "edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(s, t) AS (SELECT a, a FROM edges UNION SELECT r.s, e.b FROM reach r JOIN edges e ON r.t = e.a), comp AS (SELECT s AS path, min(t) AS component FROM reach GROUP BY 1)"
NEAR = "cj AS (SELECT lf.*, component FROM lf JOIN comp USING (path)), win AS (SELECT component, count(DISTINCT class_id) AS classes FROM cj GROUP BY 1), rk AS (SELECT cj.*, classes, row_number() OVER (PARTITION BY component ORDER BY sharpness DESC, area DESC, path) AS r FROM cj JOIN win USING (component)), near AS (SELECT path, component, CASE WHEN classes > 1 THEN 'cross_label_duplicate' WHEN r > 1 THEN 'near_duplicate' END AS near_reason FROM rk)"
CLEANED = "cleaned AS (SELECT b.path, b.class_id, coalesce(b.defect, d.duplicate, n.near_reason) AS reason FROM base b LEFT JOIN dup d USING (path) LEFT JOIN near n USING (path))"


def rec_sql(*more):
    text = sql("records", "facts").replace("WITH ", "WITH RECURSIVE ", 1)
    return text + "".join(", " + m for m in more) + "\n"


ALL = rec_sql(SIM, BASE, EXACT, PAIRS, REACH, NEAR, CLEANED)


# ---- cleaning
@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS digest, strlen(text) > 0 AS ok FROM documents")
def asset_facts(spark, sf_dir):
    return C.asset_facts(table(spark, sf_dir, "documents"))


@query(rec_sql(BASE) + "SELECT path, coalesce(defect, 'fine') AS defect FROM base")
def defect_filter(spark, sf_dir):
    rows = records(spark, sf_dir).join(view(spark, sf_dir, "facts").drop("class_id"), "path", "left")
    return rows.select("path", F.coalesce(C.defect(**LIMITS), F.lit("fine")).alias("defect"))


def _exact(spark, sf_dir):
    rows = C.measured(records(spark, sf_dir), view(spark, sf_dir, "facts").drop("mode")).withColumn("defect", C.defect(**LIMITS))
    return C.exact_duplicates(rows.where("defect IS NULL"))


@query(rec_sql(BASE, EXACT) + "SELECT path, first_path, coalesce(duplicate, 'first') AS duplicate FROM dup")
def exact_dups(spark, sf_dir):
    return _exact(spark, sf_dir).select("path", "first_path", F.coalesce("duplicate", F.lit("first")).alias("duplicate"))


@query(rec_sql(BASE, EXACT) + "SELECT first_path, first_class, path, class_id FROM dup WHERE class_id <> first_class")
def cross_label_pairs(spark, sf_dir):
    return _exact(spark, sf_dir).where("class_id <> first_class").select("first_path", "first_class", "path", "class_id")


@query("SELECT vec_id, " + ", ".join(f"list_reduce(list_prepend(0, list_transform(range({16 * j + 1}, {16 * j + 17}), lambda i: CASE WHEN coalesce(embedding[i + 1] > embedding[i], false) THEN 1 ELSE 0 END)), lambda a, b: a * 2 + b)::INT AS h{j}" for j in range(4)) + " FROM embeddings")
def array_dhash(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *C.difference_bits(F.col("embedding")))


@query("WITH " + SIM + " SELECT path, h0, h1, h2, h3 FROM sim")
def text_simhash(spark, sf_dir):
    return C.simhash(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "path", "text")


@query(rec_sql(SIM, BASE, EXACT, PAIRS) + "SELECT a, b, distance FROM pairs")
def near_pairs(spark, sf_dir):
    left = _exact(spark, sf_dir).where("duplicate IS NULL").select("path")
    return C.near_pairs(text_simhash(spark, sf_dir).join(left, "path", "left_semi"))


@query(rec_sql(SIM, BASE, EXACT, PAIRS, REACH) + "SELECT path, component FROM comp")
def dup_components(spark, sf_dir):
    left = _exact(spark, sf_dir).where("duplicate IS NULL").select("path")
    return C.near_components(text_simhash(spark, sf_dir).join(left, "path", "left_semi"))


@query(ALL + "SELECT path, component, coalesce(near_reason, 'kept') AS outcome FROM near")
def near_dup_survivors(spark, sf_dir):
    f = checkpointed(_exact(spark, sf_dir).where("duplicate IS NULL").select("path", "class_id", "sharpness", "width", "height"))
    prints = text_simhash(spark, sf_dir).join(f.select("path"), "path", "left_semi")
    found = C.resolve_components(f, checkpointed(C.near_components(prints)))
    return found.select("path", "component", F.coalesce("near_reason", F.lit("kept")).alias("outcome"))


@query(ALL + "SELECT path, class_id FROM cleaned WHERE reason IS NULL")
def clean_kept(spark, sf_dir):
    return cleaned(spark, sf_dir)[0].where("reason IS NULL").select("path", "class_id")


@query(ALL + "SELECT reason, path, class_id FROM cleaned WHERE reason IS NOT NULL")
def clean_dropped(spark, sf_dir):
    return cleaned(spark, sf_dir)[0].where("reason IS NOT NULL").select("reason", "path", "class_id")


@query(ALL + "SELECT coalesce(reason, 'kept') AS reason, NULL AS class_id, count(*)::BIGINT AS n FROM cleaned GROUP BY coalesce(reason, 'kept') UNION ALL SELECT NULL, class_id, count(*)::BIGINT FROM cleaned GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*)::BIGINT FROM cleaned")
def clean_summary(spark, sf_dir):
    return C.summary(cleaned(spark, sf_dir)[0])


@query(ALL + "SELECT class_id, count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS dropped, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS kept, round(count(*) FILTER (WHERE reason IS NOT NULL) / count(*), 6) AS share, count(*) FILTER (WHERE reason IS NOT NULL) / count(*) > 4e-1 AS flagged FROM cleaned GROUP BY 1 ORDER BY count(*) FILTER (WHERE reason IS NOT NULL) / count(*) DESC, class_id LIMIT 12")
def class_loss(spark, sf_dir):
    return C.class_loss(cleaned(spark, sf_dir)[0])


@query(sql("records") + ", " + LANG + " SELECT class_id, count(*)::BIGINT AS n FROM by_lang GROUP BY 1 HAVING count(*) >= 130")
def drop_rare(spark, sf_dir):
    return C.drop_rare(by_lang(spark, sf_dir), 130)[0].groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("records") + ", " + LANG + ", k AS (SELECT path, class_id, row_number() OVER (PARTITION BY class_id ORDER BY md5('1337:' || path)) AS r, count(*) OVER (PARTITION BY class_id) AS n FROM by_lang) SELECT path, class_id, n::BIGINT AS n FROM k WHERE r <= 110")
def cap_class(spark, sf_dir):
    return C.cap_classes(by_lang(spark, sf_dir), 110).select("path", "class_id", "n")


# ---- splits and samples
SPLIT = ", g AS (SELECT DISTINCT class_id, group_key FROM records), gr AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY md5('1337:' || class_id || ':' || group_key)) AS r, count(*) OVER (PARTITION BY class_id) AS n FROM g), " \
    "sz AS (SELECT *, least(CASE WHEN n >= 3 THEN greatest(round_even(n * 15e-2, 0), 1) ELSE round_even(n * 15e-2, 0) END, n - 1) AS t, CASE WHEN n >= 3 THEN greatest(round_even(n * 15e-2, 0), 1) ELSE round_even(n * 15e-2, 0) END AS v0 FROM gr), " \
    "sp AS (SELECT class_id, group_key, CASE WHEN r <= t THEN 'test' WHEN r <= t + least(v0, greatest(n - t - 1, 0)) THEN 'val' ELSE 'train' END AS split FROM sz), split_rows AS (SELECT records.*, split FROM records JOIN sp USING (class_id, group_key))\n"  # fmt: skip
WITH_SPLIT = sql("records") + SPLIT


def split_rows(spark, sf_dir):
    return S.group_split(records(spark, sf_dir))


@query(WITH_SPLIT + "SELECT path, class_id, split FROM split_rows")
def group_split(spark, sf_dir):
    return split_rows(spark, sf_dir).select("path", "class_id", "split")


@query(WITH_SPLIT + "SELECT path, class_id, category, severity, life_stage, group_key, split, source FROM split_rows WHERE split = 'val'")
def manifest_read(spark, sf_dir):
    return split_rows(spark, sf_dir).where("split = 'val'").select(*FIELDS)


@query(WITH_SPLIT + "SELECT class_id, split, count(*)::BIGINT AS n FROM split_rows GROUP BY ROLLUP (class_id, split)")
def split_counts(spark, sf_dir):
    return split_rows(spark, sf_dir).rollup("class_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query(WITH_SPLIT + "SELECT group_key, count(DISTINCT split)::BIGINT AS splits, count(*)::BIGINT AS n FROM split_rows GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leaked_groups(spark, sf_dir):
    return S.leaked_groups(split_rows(spark, sf_dir))


COARSE = ", coarse AS (SELECT * REPLACE (CASE WHEN class_id IN ('src1', 'src2') THEN nullif(severity, 'unknown') ELSE group_key END AS group_key) FROM split_rows)"


@query(WITH_SPLIT + COARSE + " SELECT class_id, count(DISTINCT group_key)::BIGINT AS groups, count(*)::BIGINT AS n FROM coarse GROUP BY 1 HAVING count(DISTINCT group_key) < 3 AND count(*) >= 3")
def degenerate_grouping(spark, sf_dir):
    rows = split_rows(spark, sf_dir).withColumn("group_key", F.when(F.col("class_id").isin("src1", "src2"), F.nullif("severity", F.lit("unknown"))).otherwise(F.col("group_key")))
    return S.degenerate_grouping(rows)


@query(WITH_SPLIT + "SELECT class_id, count(*) FILTER (WHERE split = 'val') = 0 AS no_val, count(*) FILTER (WHERE split = 'test') = 0 AS no_test FROM split_rows WHERE NOT (class_id = 'src3' AND split = 'test') AND NOT (class_id = 'src2' AND split = 'val') GROUP BY 1 HAVING count(*) FILTER (WHERE split = 'val') = 0 OR count(*) FILTER (WHERE split = 'test') = 0")
def missing_split(spark, sf_dir):
    return S.missing_split(split_rows(spark, sf_dir).where("NOT (class_id = 'src3' AND split = 'test') AND NOT (class_id = 'src2' AND split = 'val')"))


@query(WITH_SPLIT + "SELECT severity, life_stage, source, split, count(*)::BIGINT AS n FROM split_rows GROUP BY GROUPING SETS ((severity), (life_stage), (source), (split))")
def label_dists(spark, sf_dir):
    c = ["severity", "life_stage", "source", "split"]
    return split_rows(spark, sf_dir).groupingSets([[x] for x in c], *c).agg(F.count(F.lit(1)).alias("n"))


@query(sql("records", "source_classes") + ", " + LANG + ", ids AS (SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) AS t(class_id)), n AS (SELECT ids.class_id, count(b.path) AS n FROM ids LEFT JOIN by_lang b USING (class_id) GROUP BY 1), w AS (SELECT *, CASE WHEN n > 0 THEN (1 - 999e-3) / (1 - pow(999e-3, n)) ELSE 0 END AS w FROM n) SELECT class_id, n::BIGINT AS n, round(w / (SELECT avg(w) FROM w WHERE n > 0), 6) AS weight FROM w")
def class_weights(spark, sf_dir):
    ids = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "xx")], "class_id string")
    return S.class_weights(by_lang(spark, sf_dir), ids).select("class_id", F.col("n").cast("long").alias("n"), F.round("weight", 6).alias("weight"))


@query(sql("records") + ", " + LANG + """, r AS (SELECT path, class_id, row_number() OVER (PARTITION BY class_id ORDER BY path) - 1 AS i FROM by_lang),
c AS (SELECT class_id, count(*) AS n, row_number() OVER (ORDER BY class_id) - 1 AS c, count(*) OVER () AS m, (sum(count(*)) OVER ())::BIGINT AS total FROM by_lang GROUP BY 1),
d AS (SELECT class_id, ('0x' || substr(md5('1337:' || k), 1, 15))::BIGINT % n AS i FROM c, range((SELECT any_value(total) FROM c)) t(k) WHERE k % m = c.c),
t AS (SELECT class_id, i, count(*) AS k FROM d GROUP BY ALL) SELECT path, class_id, unnest(range(1, k + 1))::INT AS copy FROM r JOIN t USING (class_id, i)""")
def balanced_resample(spark, sf_dir):
    return S.balanced_resample(by_lang(spark, sf_dir)).select("path", "class_id", "copy")


@query(WITH_SPLIT + ", i AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY class_id, path) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM split_rows) SELECT path, class_id, split FROM i WHERE i % greatest(n // 40, 1) = 0 AND i // greatest(n // 40, 1) < 40")
def systematic_sample(spark, sf_dir):
    return S.systematic_sample(split_rows(spark, sf_dir), 40).select("path", "class_id", "split")


@query("SELECT bit_xor(('0x' || substr(md5(CAST(doc_id AS STRING)), 1, 15))::BIGINT) AS fingerprint, count(*)::BIGINT AS n FROM documents")
def dataset_fingerprint(spark, sf_dir):
    return S.fingerprint(records(spark, sf_dir))


@query("SELECT 'a' AS corpus, 0 AS place, CAST(doc_id AS STRING) AS path, source AS class_id FROM documents UNION ALL SELECT 'b', 1, url, CAST(NULL AS STRING) FROM pages UNION ALL SELECT 'c', 2, CAST(item_id AS STRING), CAST(NULL AS STRING) FROM benchmark")
def multi_source_union(spark, sf_dir):
    from harrow.sources.manifests import union_sources

    return union_sources({
        "a": table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("class_id")),
        "b": table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "c": table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path")),
    }).select("corpus", "place", "path", "class_id")


# ---- profile
def classes(spark):
    return dim(spark, SOURCE_CLASSES)


@query(WITH_SPLIT + "SELECT source, split, count(*)::BIGINT AS n, count(DISTINCT class_id)::BIGINT AS classes FROM split_rows GROUP BY GROUPING SETS ((source), (split), ())")
def eda_totals(spark, sf_dir):
    return P.totals(split_rows(spark, sf_dir))


@query(sql("records") + ", " + LANG + ", c AS (SELECT class_id, count(*)::BIGINT AS n FROM by_lang GROUP BY 1) SELECT arg_max(class_id, n) AS largest, max(n) AS most, arg_min(class_id, n) AS smallest, min(n) AS least, round(max(n) / min(n), 6) AS ratio, quantile_cont(n, 0.5) AS median FROM c")
def eda_balance(spark, sf_dir):
    return P.balance(by_lang(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def _gini_sql(src):
    return f"SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT n::DOUBLE AS x, row_number() OVER (ORDER BY n) AS i FROM ({src}))"


@query(f"SELECT 'lang' AS counts, * FROM ({_gini_sql('SELECT count(*) AS n FROM documents GROUP BY lang')}) UNION ALL SELECT 'supplier', * FROM ({_gini_sql('SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey')})")
def eda_gini(spark, sf_dir):
    a = P.gini(P.class_counts(by_lang(spark, sf_dir))).select(F.lit("lang").alias("counts"), "gini")
    b = P.gini(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))).select(F.lit("supplier").alias("counts"), "gini")
    return a.union(b).withColumn("gini", F.round("gini", 6))


@query(sql("records") + "SELECT class_id, count(*)::BIGINT AS n, count(*) < 50 AS under_train, count(*) < 90 AS under_eval FROM records GROUP BY 1 HAVING count(*) < 90")
def eda_below_min(spark, sf_dir):
    return P.below(records(spark, sf_dir), 50, 30)


@query("WITH c AS (SELECT p_brand AS class_id, count(*)::BIGINT AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, class_id)::INT AS top, row_number() OVER (ORDER BY n, class_id)::INT AS bottom FROM c) SELECT class_id, n, top, bottom FROM r WHERE top <= 10 OR bottom <= 10")
def eda_top_bottom(spark, sf_dir):
    return P.top_bottom(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("class_id")).agg(F.count(F.lit(1)).alias("n")))


@query(sql("records", "source_classes") + "SELECT crop, c.category, count(*)::BIGINT AS n, count(DISTINCT class_id)::BIGINT AS classes FROM records r JOIN source_classes c USING (class_id) GROUP BY GROUPING SETS ((crop), (c.category))")
def eda_coverage(spark, sf_dir):
    return P.coverage(records(spark, sf_dir), classes(spark))


@query(sql("source_classes") + "SELECT DISTINCT source AS class_id FROM documents WHERE source NOT IN (SELECT class_id FROM source_classes)")
def eda_unknown(spark, sf_dir):
    return records(spark, sf_dir).select("class_id").join(classes(spark), "class_id", "left_anti").distinct()


@query(sql("source_classes") + "SELECT crop, count(*)::BIGINT AS classes FROM source_classes WHERE crop <> 'any' AND class_id IN (SELECT source FROM documents) GROUP BY 1 HAVING NOT bool_or(category = 'healthy')")
def eda_no_healthy(spark, sf_dir):
    return P.without_healthy(records(spark, sf_dir), classes(spark))


@query(sql("records") + "SELECT round(avg((severity NOT IN ('unknown', ''))::INT), 6) AS severity_labelled, count(*) FILTER (WHERE category = 'pest')::BIGINT AS pest_rows, round(coalesce(avg((life_stage <> 'unknown')::INT) FILTER (WHERE category = 'pest'), 0), 6) AS stage_labelled FROM records")
def eda_label_fraction(spark, sf_dir):
    return P.label_fractions(records(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("severity_labelled", "stage_labelled")})


QUANTITIES = {"width": "width", "height": "height", "min_side": "least(width, height)", "aspect": "greatest(width, height) / least(width, height)", "sharpness": "sharpness"}


@query(sql("facts") + " UNION ALL ".join(f"SELECT '{k}' AS name, round(quantile_cont(({e})::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(({e})::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(({e})::DOUBLE, 0.95), 6) AS p95 FROM facts WHERE ok" for k, e in QUANTITIES.items()))
def eda_percentiles(spark, sf_dir):
    return P.percentiles(view(spark, sf_dir, "facts"), {k: F.expr(e).cast("double") for k, e in QUANTITIES.items()}).select("name", *[F.round(p, 6).alias(p) for p in ("p05", "p50", "p95")])


@query(sql("facts") + "SELECT count(*) FILTER (WHERE ok)::BIGINT AS decoded, count(*) FILTER (WHERE NOT ok)::BIGINT AS failed, round(avg((least(width, height) < 224)::INT) FILTER (WHERE ok), 6) AS below_side, round(avg((mode IN ('L', '1'))::INT) FILTER (WHERE ok), 6) AS greyscale, count(DISTINCT (width, height)) FILTER (WHERE ok)::BIGINT AS resolutions, count(DISTINCT (width, height)) FILTER (WHERE ok) <= 3 AS uniform FROM facts")
def eda_shares(spark, sf_dir):
    return P.shares(view(spark, sf_dir, "facts")).withColumns({c: F.round(c, 6) for c in ("below_side", "greyscale")})


@query(sql("records") + "SELECT count(*)::BIGINT AS groups, quantile_cont(n, 0.95) AS p95 FROM (SELECT count(*) AS n FROM records GROUP BY group_key)")
def eda_group_p95(spark, sf_dir):
    return P.group_sizes(records(spark, sf_dir))


def profile(spark, sf_dir):
    """One row with what the recommendations ask for."""
    r, f = records(spark, sf_dir), view(spark, sf_dir, "facts")
    s = checkpointed(split_rows(spark, sf_dir).select("class_id", "group_key", "split"))
    parts = [
        P.balance(r).select("ratio"), P.below(r, 51, 30).agg(F.count_if("under_train").alias("under_train")), P.shares(f).select("uniform", "below_side", "greyscale"), S.leaked_groups(s).agg(F.count(F.lit(1)).alias("leaked")),
        S.missing_split(s).agg(F.count_if("no_val").alias("missing_val")), P.label_fractions(r), P.without_healthy(r, classes(spark)).agg(F.count(F.lit(1)).alias("no_healthy")), r.select("class_id").distinct().join(classes(spark), "class_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_classes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query(sql("records", "facts", "source_classes") + SPLIT + """, n AS (SELECT class_id, count(*) AS n FROM records GROUP BY 1), rules AS (
SELECT 1 AS i, (SELECT max(n) / min(n) FROM n) > 20 AS t, 'strong imbalance: sample by class and cap classes' AS advice UNION ALL SELECT 2, (SELECT max(n) / min(n) FROM n) BETWEEN 5.0000001 AND 20, 'imbalance: sample by class'
UNION ALL SELECT 3, (SELECT count(*) FROM n WHERE n < 51) > 0, 'classes too small to train' UNION ALL SELECT 4, (SELECT count(DISTINCT (width, height)) FROM facts WHERE ok) <= 3, 'few resolutions: a studio corpus'
UNION ALL SELECT 5, (SELECT avg((least(width, height) < 224)::INT) FROM facts WHERE ok) > 3e-1, 'many small images' UNION ALL SELECT 6, (SELECT avg((mode IN ('L', '1'))::INT) FROM facts WHERE ok) > 2e-2, 'greyscale images'
UNION ALL SELECT 7, (SELECT count(*) FROM (SELECT group_key FROM split_rows GROUP BY 1 HAVING count(DISTINCT split) > 1)) > 0, 'groups in several splits: split again' UNION ALL SELECT 8, (SELECT count(*) FROM (SELECT class_id FROM split_rows GROUP BY 1 HAVING count(*) FILTER (WHERE split = 'val') = 0)) > 0, 'classes without validation rows'
UNION ALL SELECT 9, (SELECT count(*) FILTER (WHERE category = 'pest') > 0 AND avg((life_stage <> 'unknown')::INT) FILTER (WHERE category = 'pest') < 5e-1 FROM records), 'few life stages' UNION ALL SELECT 10, (SELECT avg((severity NOT IN ('unknown', ''))::INT) < 5e-2 FROM records), 'no severities'
UNION ALL SELECT 11, (SELECT count(*) FROM (SELECT crop FROM source_classes WHERE crop <> 'any' AND class_id IN (SELECT source FROM documents) GROUP BY 1 HAVING NOT bool_or(category = 'healthy'))) > 0, 'crops without a healthy class'
UNION ALL SELECT 12, (SELECT count(*) FROM n WHERE class_id NOT IN (SELECT class_id FROM source_classes)) > 0, 'classes not in the dimension')
SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS place, advice FROM rules WHERE t""")
def eda_recommend(spark, sf_dir):
    return P.recommend(profile(spark, sf_dir))


@query("SELECT name, n, least, most, true AS quantiles_within, true AS different_within FROM (SELECT 'n_chars' AS name, count(n_chars)::BIGINT AS n, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS most FROM documents UNION ALL SELECT 'bytes', count(text)::BIGINT, min(strlen(text))::DOUBLE, max(strlen(text))::DOUBLE FROM documents)")
def eda_sketches(spark, sf_dir):
    """A profile merged from one row for each source; whether its quantiles and numbers of different texts and languages are within their stated errors of the exact ones."""
    measures, keys, at = {"n_chars": F.col("n_chars"), "bytes": F.octet_length("text")}, {"lang": F.col("lang"), "digest": F.md5("text")}, {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    docs = table(spark, sf_dir, "documents")
    profile = checkpointed(K.merged(K.parts(docs, ["source"], measures, keys, k=800), list(measures), list(keys)))
    found = K.quantiles_of(profile, list(measures), at)
    values = docs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), e.cast("double").alias("x")) for c, e in measures.items()])).alias("v")).select("v.*").where("x IS NOT NULL")
    below, upto = (lambda a: F.avg((F.col("x") < F.col(a)).cast("double"))), (lambda a: F.avg((F.col("x") <= F.col(a)).cast("double")))
    error = K.RANK_ERROR[800]
    within = [(below(a) - error <= q) & (F.lit(q) <= upto(a) + error) for a, q in at.items()]
    exact = docs.agg(*[F.count_distinct(e).alias(c) for c, e in keys.items()])
    close = K.distinct_of(profile, list(keys)).crossJoin(exact).groupBy().agg(F.bool_and(F.abs(F.col("different") - F.when(F.col("name") == "lang", F.col("lang")).otherwise(F.col("digest"))) <= K.DISTINCT_ERROR[12] * F.when(F.col("name") == "lang", F.col("lang")).otherwise(F.col("digest"))).alias("different_within"))
    rows = values.join(found, "name").groupBy("name", "n", "least", "most").agg(reduce(and_, within).alias("quantiles_within"))
    return rows.crossJoin(F.broadcast(close))  # one row each
