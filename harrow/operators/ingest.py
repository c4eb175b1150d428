"""Label resolution and routing of labelled corpora. Dimensions are small tables; Spark broadcasts them by their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import text as X

#: Which categories a source of a kind may give.
ALLOWED = {"pest": ("pest", "healthy", "background"), "disease": ("disease", "deficiency", "abiotic", "healthy", "background"), "mixed": ("pest", "disease", "deficiency", "abiotic", "healthy", "background")}


def names(classes: DataFrame) -> DataFrame:
    """(key, class_id): normalised ids and aliases of classes (class_id, name, aliases: comma list)."""
    all_names = F.concat(F.array("class_id"), F.split(F.coalesce("aliases", F.lit("")), ","))
    return classes.select("class_id", F.explode(all_names).alias("n")).select(X.normalise(F.col("n")).alias("key"), "class_id").where("key <> ''").distinct()


def alias_collisions(classes: DataFrame) -> DataFrame:
    return names(classes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("class_id")), ",").alias("class_ids")).where("n > 1")


def alias_index(classes: DataFrame) -> DataFrame:
    """One class for each key; of colliding ones the first by place."""
    return names(classes).join(classes.select("class_id", "class_idx"), "class_id").groupBy("key").agg(F.min_by("class_id", "class_idx").alias("class_id"))


def bare_names(classes: DataFrame, unique=True) -> DataFrame:
    """Class names that are no alias: those of one class (key, class_id), or else those of several (key, n, class_ids)."""
    bare = classes.select(X.normalise(F.col("name")).alias("key"), "class_id").join(names(classes).select("key").distinct(), "key", "left_anti")
    each = bare.groupBy("key").agg(F.countDistinct("class_id").alias("n"), F.sort_array(F.collect_set("class_id")).alias("ids"))
    return each.where("n = 1").select("key", F.get("ids", F.lit(0)).alias("class_id")) if unique else each.where("n > 1").select("key", "n", F.array_join("ids", ",").alias("class_ids"))


def index(classes: DataFrame) -> DataFrame:
    """(key, class_id): aliases, then unique bare names."""
    return alias_index(classes).unionByName(bare_names(classes))


def resolve(rows: DataFrame, classes: DataFrame, label="label") -> DataFrame:
    """rows with class_id: of the alias that equals the label, else of the unique bare name, else null."""
    return rows.withColumn("_key", X.normalise(F.col(label))).join(index(classes).withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def resolve_qualified(rows: DataFrame, classes: DataFrame, crop="crop", label="label") -> DataFrame:
    """rows with class_id from crop and label: qualified spellings first, then the label alone where the class is of that crop or of any, then the crop's healthy class.

    Distinct (crop, label) pairs are resolved, then joined back; spellings are rows, and the first that is found wins.
    """
    pairs = rows.select(crop, label).distinct().withColumn("_crop", X.fold_synonyms(F.col(crop))).withColumn("_bare", X.strip_prefix(F.col(label), F.col(crop), F.col("_crop")))
    c, bare, own = F.col("_crop"), F.col("_bare"), F.col(label)
    healthy = F.when(bare.isin(*X.HEALTHY_WORDS), F.concat(c, F.lit(" healthy")))
    spellings = F.array(F.concat_ws(" ", c, bare), F.concat_ws(" ", c, own), F.concat_ws(" ", F.col(crop), own), F.concat_ws("___", F.col(crop), own), own, bare, healthy)
    tried = pairs.select(crop, label, "_crop", F.posexplode(spellings).alias("_try", "_name")).withColumn("key", X.normalise(F.col("_name")))
    found = tried.join(index(classes), "key").join(classes.select("class_id", F.col("crop").alias("_of")), "class_id").where((~F.col("_try").isin(4, 5)) | (F.col("_of") == "any") | (F.col("_of") == F.col("_crop")))
    best = found.groupBy(crop, label).agg(F.min_by("class_id", "_try").alias("class_id"))
    return rows.join(best, [crop, label], "left")


def gate(kind: str):
    """A reason to reject a class's category for a source of this kind, else null."""
    return F.when(~F.col("category").isin(*ALLOWED[kind]), F.concat("category", F.lit(f" class in a {kind} source")))


def route(rows: DataFrame, classes: DataFrame, kind="mixed", crops=None, nested=False, label="label", crop="crop") -> DataFrame:
    """rows with class_id, category, life_stage, status (kept, unmapped, wrong_kind, excluded) and reason.

    Flat: unresolved labels that name a condition are wrong_kind in a pest source, else unmapped; then the gate; the crop exclusion is last. Nested: the
    crop folder is excluded first, and labels are resolved with their crop.
    """
    out = (resolve_qualified(rows, classes, crop, label) if nested else resolve(rows, classes, label)).join(classes.select("class_id", "category", F.col("crop").alias("class_crop")), "class_id", "left")
    wanted = F.array(*[F.lit(c.lower()) for c in crops]) if crops else None
    out_of_scope = F.lit(False) if crops is None else ~F.array_contains(wanted, X.fold_synonyms(F.col(crop))) if nested else F.coalesce((F.col("class_crop") != "any") & ~F.array_contains(wanted, F.lower("class_crop")), F.lit(False))
    none, wrong = F.col("class_id").isNull(), gate(kind)
    guess = X.looks_like_condition(F.col(label)) if kind == "pest" else F.lit(False)
    status = F.when(none & guess, "wrong_kind").when(none, "unmapped").when(wrong.isNotNull(), "wrong_kind")
    reason = F.when(none & guess, "name describes a condition").when(~none, wrong)
    status = F.when(out_of_scope, "excluded").otherwise(F.coalesce(status, F.lit("kept"))) if nested else F.coalesce(status, F.when(out_of_scope, "excluded").otherwise("kept"))
    reason = F.when(~out_of_scope, reason) if nested else reason
    return out.withColumn("status", status).withColumn("reason", reason).withColumn("life_stage", X.life_stage(F.col(label)))


def summary(routed: DataFrame, by="source", label="label") -> DataFrame:
    """Images, classes, and folders and images of each status, for each source."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_images") for s in ("kept", "unmapped", "wrong_kind", "excluded")]
    folders = [F.countDistinct(F.when(F.col("status") == s, F.col(label))).alias(f"{s}_folders") for s in ("unmapped", "wrong_kind", "excluded")]
    return routed.groupBy(by).agg(F.count(F.lit(1)).alias("images"), F.countDistinct(F.when(F.col("status") == "kept", F.col("class_id"))).alias("classes"), *counts, *folders)


def top_rejected(routed: DataFrame, n=25, label="label") -> DataFrame:
    """The n folders with most rejected images; ties by name."""
    return routed.where("status <> 'kept'").groupBy("status", label).agg(F.count(F.lit(1)).alias("images")).orderBy(F.desc("images"), "status", label).limit(n)


def layouts(paths: DataFrame, most=40) -> DataFrame:
    """(root, layout) for files (root, path): split if all first folders are split names, nested if over half of the first `most` hold folders and no files, else flat."""
    parts = F.split("path", "/")
    files = paths.select("root", F.get(parts, F.lit(0)).alias("top"), F.size(parts).alias("depth")).where("depth > 1")
    tops = files.groupBy("root", "top").agg(F.max("depth").alias("depth"), F.bool_or(F.col("depth") == 2).alias("direct"))
    tops = tops.withColumn("i", F.row_number().over(Window.partitionBy("root").orderBy("top")))
    probed = F.col("i") <= most
    each = tops.groupBy("root").agg(F.bool_and(F.lower("top").isin(*X.SPLIT_DIRS)).alias("splits"), F.count_if(probed & (F.col("depth") > 2) & ~F.col("direct")).alias("nested"), F.count_if(probed).alias("n"))
    return each.select("root", F.when(F.col("splits"), "split").when(F.col("nested") * 2 > F.col("n"), "nested").otherwise("flat").alias("layout"))


def dataset_root(paths: DataFrame, most=4) -> DataFrame:
    """(root, depth): how many wrapping folders, up to `most`, hold nothing but one folder."""
    parts = F.split("path", "/")
    files = paths.select("root", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dirs"))
    wraps = [F.min(F.size("dirs")).alias("least"), *[F.count_distinct(F.array_join(F.slice("dirs", 1, d), "/")).alias(f"n{d}") for d in range(1, most + 1)]]
    each = files.groupBy("root").agg(*wraps)
    depth = F.lit(0)
    for d in range(1, most + 1):
        alone = F.forall(F.array(*[F.col(f"n{i}") for i in range(1, d + 1)]), lambda n: n == 1) & (F.col("least") >= d)
        depth = F.when(alone, d).otherwise(depth)
    return each.select("root", depth.cast("int").alias("depth"))


def without_split_layer(paths: DataFrame) -> DataFrame:
    """Paths without their first folder where all first folders of a root are split names."""
    first = F.split_part("path", F.lit("/"), F.lit(1))
    roots = paths.groupBy("root").agg(F.bool_and(F.lower(first).isin(*X.SPLIT_DIRS)).alias("_every"))
    out = paths.join(roots.withColumnRenamed("root", "_root"), F.col("root").eqNullSafe(F.col("_root")))
    return out.withColumn("path", F.when(F.col("_every"), F.regexp_replace("path", r"^[^/]*/", "")).otherwise(F.col("path"))).select(*paths.columns)


def by_map(rows: DataFrame, mapped: DataFrame, excluded: DataFrame, names_of: DataFrame, label="label") -> DataFrame:
    """rows with index, class_id, life_stage, status: folders by number (digits, or digits before a separator) or by name; mapped (index, class_id, stage), excluded (index), names_of (key, index)."""
    digits = F.nullif(F.regexp_extract(F.col(label), r"^(\d+)(?:$|[_\-. ])", 1), F.lit("")).cast("int")
    out = rows.withColumn("key", X.normalise(F.col(label))).join(names_of.withColumnRenamed("index", "_named"), "key", "left").withColumn("index", F.coalesce(digits, "_named")).drop("_named", "key")
    out = out.join(mapped, "index", "left").join(excluded.select("index", F.lit(True).alias("_out")), "index", "left")
    status = F.when(F.col("_out"), "excluded").when(F.col("class_id").isNull(), "unmapped").otherwise("kept")
    return out.withColumn("status", status).withColumn("life_stage", F.when(F.col("stage") == "any", "unknown").otherwise(F.col("stage"))).drop("_out", "stage")


def subset(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """classes in the order of ids (place, class_id); an id without a class is an error."""
    missing = ids.join(classes, "class_id", "left_anti")
    if not missing.isEmpty():
        raise KeyError("unknown class ids")
    return ids.join(classes.drop("class_idx"), "class_id")


def encode(records: DataFrame, classes: DataFrame, severities=("none", "low", "moderate", "severe"), stages=("unknown", "egg", "larva", "nymph", "adult"), categories=("healthy", "disease", "pest", "deficiency", "abiotic", "background")) -> DataFrame:
    """records with label, category_label, severity_label and stage_label; null where there is none."""
    at = lambda values, c: F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)), F.lit(0)) - 1
    dim = classes.select("class_id", F.col("class_idx").alias("label"))
    stage = at(stages, "life_stage")
    return records.join(dim, "class_id", "left").withColumns({"category_label": at(categories, "category").cast("int"), "severity_label": at(severities, "severity").cast("int"), "stage_label": F.when(stage > 0, stage).cast("int")})
