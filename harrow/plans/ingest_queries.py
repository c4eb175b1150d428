"""Queries of label resolution and routing over parts, documents and page paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.operators import ingest as I
from harrow.plans.registry import query
from harrow.plans.views import CATEGORIES, SOURCE_CLASSES, dim, sql, table, values, view

PART_CLASSES = (
    ("class_idx", "class_id", "crop", "name", "category", "aliases"),
    [
        (0, "red__widget", "red", "Widget", "pest", "red widget,RW"), (1, "hot__bolt", "hot", "Bolt blight", "disease", "hot bolt"), (2, "small__gear", "small", "Gear", "healthy", "small gear,gear-healthy"), (3, "any__ring", "any", "Ring", "pest", "old ring"),
        (4, "red__rod", "red", "Rod", "deficiency", "red rod"), (5, "hot__rod", "hot", "Rod", "disease", "hot  ROD"), (6, "small__healthy", "small", "Healthy", "healthy", "small-healthy"), (7, "cold__anvil", "cold", "Anvil", "abiotic", "cold anvil,small gear"),
        (8, "promo__plate", "promo", "Plate", "disease", ""), (9, "large__bolt", "large", "Bolt", "pest", ""),
    ],
)
NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def norm(x):
    return NORM.format(x)


def parts(spark, sf_dir):
    return view(spark, sf_dir, "names")


def part_classes(spark):
    return dim(spark, PART_CLASSES)


PC = f"part_classes AS ({values(PART_CLASSES)}), "
INDEX = f"""an AS (SELECT class_id, class_idx, unnest(list_concat([class_id], string_split(coalesce(aliases, ''), ','))) AS n FROM {{c}}),
keys AS (SELECT DISTINCT {norm('n')} AS key, class_id, class_idx FROM an WHERE {norm('n')} <> ''),
alias_index AS (SELECT key, arg_min(class_id, class_idx) AS class_id FROM keys GROUP BY 1),
bare AS (SELECT {norm('name')} AS key, class_id FROM {{c}} WHERE {norm('name')} NOT IN (SELECT key FROM keys)),
idx AS (SELECT * FROM alias_index UNION ALL SELECT key, any_value(class_id) FROM bare GROUP BY 1 HAVING count(DISTINCT class_id) = 1)"""
PART_INDEX = "WITH " + PC + INDEX.replace("{c}", "part_classes")


@query(f"SELECT p_partkey, {norm('p_name')} AS name, {norm('p_brand')} AS brand FROM part")
def normalise_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalise(F.col("p_name")).alias("name"), X.normalise(F.col("p_brand")).alias("brand"))


FOLD = {"economy": "budget", "promo": "budget", "medium": "standard"}


@query(f"SELECT p_type, CASE {norm('p_type')} WHEN 'economy' THEN 'budget' WHEN 'promo' THEN 'budget' WHEN 'medium' THEN 'standard' ELSE {norm('p_type')} END AS folded, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def synonym_fold(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type", X.fold_synonyms(F.col("p_type"), FOLD).alias("folded")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, lower(p_type) || ' ') THEN substr(p_name, length(p_type) + 2) ELSE p_name END AS bare FROM part")
def prefix_strip(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.strip_prefix(F.col("label"), F.col("crop")).alias("bare"))


@query(PART_INDEX + " SELECT k.key, count(*)::BIGINT AS n, string_agg(DISTINCT k.class_id, ',' ORDER BY k.class_id) AS class_ids, (SELECT count(*) FROM part WHERE p_name = k.key)::BIGINT AS parts FROM keys k GROUP BY k.key HAVING count(*) > 1")
def alias_collisions(spark, sf_dir):
    seen = parts(spark, sf_dir).groupBy(F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("parts"))
    return I.alias_collisions(part_classes(spark)).join(seen, "key", "left").select("key", "n", "class_ids", F.coalesce("parts", F.lit(0).cast("long")).alias("parts"))


@query(PART_INDEX + " SELECT i.key, i.class_id, count(p.p_partkey)::BIGINT AS parts FROM (SELECT key, any_value(class_id) AS class_id FROM bare GROUP BY 1 HAVING count(DISTINCT class_id) = 1) i LEFT JOIN part p ON contains(' ' || p.p_name || ' ', ' ' || i.key || ' ') GROUP BY ALL")
def bare_names(spark, sf_dir):
    words = parts(spark, sf_dir).select(F.explode(F.array_distinct(F.split("label", " "))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"))
    return I.bare_names(part_classes(spark)).join(words, "key", "left").select("key", "class_id", F.coalesce("parts", F.lit(0).cast("long")).alias("parts"))


@query(PART_INDEX + " SELECT b.key, count(DISTINCT b.class_id)::BIGINT AS n, string_agg(DISTINCT b.class_id, ',' ORDER BY b.class_id) AS class_ids, (SELECT count(*) FROM part WHERE list_contains(string_split(p_name, ' '), b.key))::BIGINT AS parts FROM bare b GROUP BY b.key HAVING count(DISTINCT b.class_id) > 1")
def ambiguous_names(spark, sf_dir):
    words = parts(spark, sf_dir).select(F.explode(F.array_distinct(F.split("label", " "))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"))
    return I.bare_names(part_classes(spark), unique=False).join(words, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(0).cast("long")))


@query(PART_INDEX + f" SELECT p_partkey, class_id FROM part LEFT JOIN idx ON idx.key = {norm('p_name')}")
def resolve_name(spark, sf_dir):
    return I.resolve(parts(spark, sf_dir), part_classes(spark)).select("p_partkey", "class_id")


def _crop_rows(spark, sf_dir):
    """Every other part names its crop by type and its label by the last word of its name."""
    p = parts(spark, sf_dir)
    crop = F.when(F.col("p_partkey") % 2 == 0, F.col("crop")).otherwise(F.initcap(F.split_part("label", F.lit(" "), F.lit(1))))
    return p.select("p_partkey", crop.alias("crop"), F.when(F.col("p_partkey") % 5 == 0, F.concat(crop, F.lit(" Fresh"))).otherwise(F.split_part("label", F.lit(" "), F.lit(2))).alias("label"))


QUALIFIED = PART_INDEX + f""", q0 AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] END AS crop, p_name FROM part),
q AS (SELECT p_partkey, crop, CASE WHEN p_partkey % 5 = 0 THEN crop || ' Fresh' ELSE split_part(p_name, ' ', 2) END AS label FROM q0),
d AS (SELECT DISTINCT crop, label, lower(crop) AS ck, CASE WHEN starts_with(lower(label), lower(crop) || ' ') THEN substr(lower(label), length(crop) + 2) ELSE lower(label) END AS b FROM q),
t AS (SELECT crop, label, ck, unnest([ck || ' ' || b, ck || ' ' || label, crop || ' ' || label, crop || '___' || label, label, b, CASE WHEN b IN ('healthy', 'health', 'normal', 'fresh') THEN ck || ' healthy' END]) AS name, unnest(range(7)) AS i FROM d),
f AS (SELECT t.crop, t.label, arg_min(idx.class_id, i) AS class_id FROM t JOIN idx ON idx.key = {norm('t.name')} JOIN part_classes c ON c.class_id = idx.class_id WHERE i NOT IN (4, 5) OR c.crop IN ('any', ck) GROUP BY ALL)
"""


@query(QUALIFIED + " SELECT p_partkey, f.class_id FROM q LEFT JOIN f USING (crop, label)")
def resolve_qualified(spark, sf_dir):
    return I.resolve_qualified(_crop_rows(spark, sf_dir), part_classes(spark)).select("p_partkey", "class_id")


#: Documents as files of a labelled corpus.
CROP_OF = {"en": "Corn", "fr": "paddy", "de": "wheat"}
CORPUS = "SELECT doc_id, CASE source WHEN 'src18' THEN 'leaf_blight 18' WHEN 'src19' THEN 'odd moth' ELSE 'Source_' || substr(source, 4) END AS label, CASE lang WHEN 'en' THEN 'Corn' WHEN 'fr' THEN 'paddy' WHEN 'de' THEN 'wheat' ELSE 'Bell Pepper' END AS crop, lang AS source, source AS folder FROM documents"


def corpus(spark, sf_dir):
    label = F.when(F.col("source") == "src18", "leaf_blight 18").when(F.col("source") == "src19", "odd moth").otherwise(F.concat(F.lit("Source_"), F.substring("source", 4, 10)))
    crop = F.when(F.col("lang") == "en", "Corn").when(F.col("lang") == "fr", "paddy").when(F.col("lang") == "de", "wheat").otherwise("Bell Pepper")
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), crop.alias("crop"), F.col("lang").alias("source"), F.col("source").alias("folder"))


def source_classes(spark):
    return dim(spark, SOURCE_CLASSES)


DOC_BASE = sql("source_classes", corpus=CORPUS) + ", " + INDEX.replace("{c}", "source_classes") + f", res AS (SELECT x.*, i.class_id, s.category, s.crop AS class_crop, CASE WHEN label = 'leaf_blight 18' THEN true ELSE false END AS guess FROM corpus x LEFT JOIN idx i ON i.key = {norm('x.label')} LEFT JOIN source_classes s ON s.class_id = i.class_id)"
PEST_OK = "category IN ('pest', 'healthy', 'background')"
FLAT = DOC_BASE + f""", routed AS (SELECT *, CASE WHEN class_id IS NULL AND guess THEN 'wrong_kind' WHEN class_id IS NULL THEN 'unmapped' WHEN NOT {PEST_OK} THEN 'wrong_kind' WHEN class_crop NOT IN ('any', 'wheat', 'maize') THEN 'excluded' ELSE 'kept' END AS status,
CASE WHEN class_id IS NULL AND guess THEN 'name describes a condition' WHEN class_id IS NOT NULL AND NOT {PEST_OK} THEN category || ' class in a pest source' END AS reason FROM res)"""


def flat(spark, sf_dir):
    return I.route(corpus(spark, sf_dir), source_classes(spark), "pest", crops=("wheat", "maize"))


@query(FLAT + " SELECT doc_id, class_id, status, reason, 'unknown' AS life_stage FROM routed")
def scan_flat(spark, sf_dir):
    return flat(spark, sf_dir).select("doc_id", "class_id", "status", "reason", "life_stage")


@query(DOC_BASE + f""", n AS (SELECT *, CASE crop WHEN 'Corn' THEN 'maize' WHEN 'paddy' THEN 'rice' WHEN 'wheat' THEN 'wheat' ELSE 'chilli' END AS ck FROM res), m AS (SELECT * REPLACE (CASE WHEN class_crop IN ('any', ck) THEN class_id END AS class_id) FROM n)
SELECT doc_id, class_id, CASE WHEN ck = 'chilli' THEN 'excluded' WHEN class_id IS NULL AND guess THEN 'wrong_kind' WHEN class_id IS NULL THEN 'unmapped' WHEN NOT {PEST_OK} THEN 'wrong_kind' ELSE 'kept' END AS status,
CASE WHEN ck = 'chilli' THEN NULL WHEN class_id IS NULL AND guess THEN 'name describes a condition' WHEN class_id IS NOT NULL AND NOT {PEST_OK} THEN category || ' class in a pest source' END AS reason FROM m""")
def scan_nested(spark, sf_dir):
    return I.route(corpus(spark, sf_dir), source_classes(spark), "pest", crops=("wheat", "maize", "rice"), nested=True).select("doc_id", "class_id", "status", "reason")


@query(DOC_BASE + " SELECT folder, label, coalesce(class_id, '-') AS class_id, count(*)::BIGINT AS images FROM res GROUP BY ALL")
def scan_simple(spark, sf_dir):
    return I.resolve(corpus(spark, sf_dir), source_classes(spark)).groupBy("folder", "label", F.coalesce("class_id", F.lit("-")).alias("class_id")).agg(F.count(F.lit(1)).alias("images"))


@query(DOC_BASE + " SELECT doc_id, category || ' class in a disease source' AS reason FROM res WHERE category = 'pest'")
def kind_gate(spark, sf_dir):
    rows = I.resolve(corpus(spark, sf_dir), source_classes(spark)).join(source_classes(spark).select("class_id", "category"), "class_id")
    return rows.select("doc_id", I.gate("disease").alias("reason")).where("reason IS NOT NULL")


@query(FLAT + """ SELECT source, count(*)::BIGINT AS images, count(DISTINCT CASE WHEN status = 'kept' THEN class_id END)::BIGINT AS classes, count(*) FILTER (WHERE status = 'kept')::BIGINT AS kept_images, count(*) FILTER (WHERE status = 'unmapped')::BIGINT AS unmapped_images,
count(*) FILTER (WHERE status = 'wrong_kind')::BIGINT AS wrong_kind_images, count(*) FILTER (WHERE status = 'excluded')::BIGINT AS excluded_images, count(DISTINCT CASE WHEN status = 'unmapped' THEN label END)::BIGINT AS unmapped_folders,
count(DISTINCT CASE WHEN status = 'wrong_kind' THEN label END)::BIGINT AS wrong_kind_folders, count(DISTINCT CASE WHEN status = 'excluded' THEN label END)::BIGINT AS excluded_folders FROM routed GROUP BY 1""")
def ingest_summary(spark, sf_dir):
    return I.summary(flat(spark, sf_dir))


@query(FLAT + " SELECT status, label, count(*)::BIGINT AS images FROM routed WHERE status <> 'kept' GROUP BY ALL ORDER BY images DESC, status, label LIMIT 25")
def top_unmapped(spark, sf_dir):
    return I.top_rejected(flat(spark, sf_dir))


@query("SELECT p_partkey, (p_type IN ('SMALL', 'PROMO')) AND split_part(p_name, ' ', 2) <> 'widget' AS condition FROM part")
def name_heuristic(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_type") == "SMALL", "LeafSpots").when(F.col("p_type") == "PROMO", "anthracnose").otherwise("ant")
    name = F.concat_ws("_", mark, F.when(F.split_part("p_name", F.lit(" "), F.lit(2)) == "widget", "aphids").otherwise(F.col("p_name")))
    return p.select("p_partkey", X.looks_like_condition(name).alias("condition"))


@query("WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text || (['', ' larvae', '_Adult x', ' eggs', ' Nymph', ' grubby'])[1 + doc_id % 6]), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS n FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN contains(n, ' {token} ') THEN '{stage}'" for token, stage in X.STAGES.items()) + " ELSE 'unknown' END AS stage FROM d")
def stage_parse(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("", " larvae", "_Adult x", " eggs", " Nymph", " grubby")])
    return table(spark, sf_dir, "documents").select("doc_id", X.life_stage(F.concat("text", F.get(ends, (F.col("doc_id") % 6).cast("int")))).alias("stage"))


GROUP_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || (['_aug1.jpg', '_rot90.jpg', '.jpg', '__sev-low_copy2.png'])[1 + page_id % 4]"


@query(rf"WITH p AS (SELECT page_id, {GROUP_PATH} AS path FROM pages), s AS (SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM p) "
       r"SELECT page_id, dir || '/' || coalesce(nullif(regexp_replace(regexp_replace(stem, '(__sev-[a-z]+)|(_aug\d*)|(_copy\d*)|(_rot\d+)|(_flip[a-z]*)|(_mirror)', '', 'gi'), '[\s_-]+$', ''), ''), stem) AS group_key FROM s")
def group_key(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("_aug1.jpg", "_rot90.jpg", ".jpg", "__sev-low_copy2.png")])
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.get(ends, (F.col("page_id") % 4).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", X.group_key(path).alias("group_key"))


def page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]*)/", 1).alias("root"), F.concat(F.rtrim(F.regexp_replace("url", "^https?://[^/]*/|[?#].*$", ""), F.lit("/")), F.lit("/f.jpg")).alias("path"))


FILES = "files AS (SELECT regexp_extract(url, '^https?://([^/]*)/', 1) AS root, string_split(rtrim(regexp_replace(url, '^https?://[^/]*/|[?#].*$', '', 'g'), '/') || '/f.jpg', '/') AS p FROM pages)"


@query(f"WITH {FILES}, t AS (SELECT root, p[1] AS top, max(len(p)) AS depth, bool_or(len(p) = 2) AS direct FROM files WHERE len(p) > 1 GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY top) AS i FROM t) "
       f"SELECT root, CASE WHEN bool_and(lower(top) IN ({', '.join(repr(s) for s in X.SPLIT_DIRS)})) THEN 'split' WHEN count(*) FILTER (WHERE i <= 40 AND depth > 2 AND NOT direct) * 2 > count(*) FILTER (WHERE i <= 40) THEN 'nested' ELSE 'flat' END AS layout FROM i GROUP BY 1")
def layout_detect(spark, sf_dir):
    return I.layouts(page_files(spark, sf_dir))


@query(f"WITH {FILES}, d AS (SELECT root, list_slice(p, 1, len(p) - 1) AS d FROM files), a AS (SELECT root, min(len(d)) AS least, count(DISTINCT d[1]) AS n1, count(DISTINCT list_slice(d, 1, 2)) AS n2, count(DISTINCT list_slice(d, 1, 3)) AS n3, count(DISTINCT list_slice(d, 1, 4)) AS n4 FROM d GROUP BY 1) "
       "SELECT root, CASE WHEN n1 = 1 AND n2 = 1 AND n3 = 1 AND n4 = 1 AND least >= 4 THEN 4 WHEN n1 = 1 AND n2 = 1 AND n3 = 1 AND least >= 3 THEN 3 WHEN n1 = 1 AND n2 = 1 AND least >= 2 THEN 2 WHEN n1 = 1 AND least >= 1 THEN 1 ELSE 0 END AS depth FROM a")
def dataset_root(spark, sf_dir):
    return I.dataset_root(page_files(spark, sf_dir))


MAPPED, EXCLUDED, NAMED = [(i, f"class{i % 7}", ("any", "larva", "adult")[i % 3]) for i in range(0, 16)], [16, 17, 18], [("promo", 3), ("economy", 17), ("large", 40)]


@query("WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN substr(p_brand, 7) ELSE substr(p_brand, 7) || '_' || p_type END AS label FROM part), i AS (SELECT *, CASE WHEN regexp_matches(label, '^\\d') THEN regexp_extract(label, '^(\\d+)', 1)::INT WHEN label = 'PROMO' THEN 3 WHEN label = 'ECONOMY' THEN 17 WHEN label = 'LARGE' THEN 40 END AS index FROM l) "
       "SELECT p_partkey, index, CASE WHEN index < 16 THEN 'class' || index % 7 END AS class_id, CASE WHEN index < 16 THEN (['unknown', 'larva', 'adult'])[1 + index % 3] END AS life_stage, CASE WHEN index BETWEEN 16 AND 18 THEN 'excluded' WHEN index < 16 THEN 'kept' ELSE 'unmapped' END AS status FROM i".replace("\\\\", "\\"))
def map_ingest(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    number = F.substring("p_brand", 7, 10)
    rows = p.select("p_partkey", F.when(k == 0, F.col("p_type")).when(k == 1, number).otherwise(F.concat_ws("_", number, "p_type")).alias("label"))
    mapped, out, named = spark.createDataFrame(MAPPED, "index int, class_id string, stage string"), spark.createDataFrame([(i,) for i in EXCLUDED], "index int"), spark.createDataFrame(NAMED, "key string, index int")
    return I.by_map(rows, mapped, out, named).select("p_partkey", "index", "class_id", "life_stage", "status")


@query("WITH " + PC[:-2] + " SELECT c.class_idx, c.class_id, count(p.p_partkey)::BIGINT AS parts FROM part_classes c LEFT JOIN part p ON p.p_name = c.crop || ' ' || lower(c.name) WHERE category IN ('pest', 'disease') AND crop IN ('any', 'hot', 'red') GROUP BY ALL")
def dim_filter(spark, sf_dir):
    kept = part_classes(spark).where(F.col("category").isin("pest", "disease") & ((F.col("crop") == "any") | F.col("crop").isin("hot", "red"))).withColumn("label", F.concat_ws(" ", "crop", F.lower("name")))
    return kept.join(parts(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("parts")), "label", "left").select("class_idx", "class_id", F.coalesce("parts", F.lit(0).cast("long")).alias("parts"))


@query("WITH " + PC[:-2] + ", o AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), ids AS (SELECT * FROM (VALUES (0, 'hot__rod'), (1, 'red__widget'), (2, 'any__ring')) AS t(place, class_id)) SELECT place, class_id, name, category, (SELECT count(*) FROM part WHERE p_name = crop || ' ' || lower(name))::BIGINT AS parts FROM ids JOIN part_classes USING (class_id)")
def dim_subset(spark, sf_dir):
    ids = spark.createDataFrame([(0, "hot__rod"), (1, "red__widget"), (2, "any__ring")], "place int, class_id string")
    chosen = I.subset(part_classes(spark), ids).withColumn("label", F.concat_ws(" ", "crop", F.lower("name")))
    return chosen.join(parts(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("parts")), "label", "left").select("place", "class_id", "name", "category", F.coalesce("parts", F.lit(0).cast("long")).alias("parts"))


@query(sql("source_classes") + "SELECT class_idx, class_id, name, category FROM source_classes WHERE class_id IN (SELECT source FROM documents)")
def classes_present(spark, sf_dir):
    return source_classes(spark).join(table(spark, sf_dir, "documents").select(F.col("source").alias("class_id")), "class_id", "left_semi").select("class_idx", "class_id", "name", "category")


@query(sql("source_classes") + "SELECT source AS class_id, count(*)::BIGINT AS n FROM documents WHERE source NOT IN (SELECT class_id FROM source_classes) GROUP BY 1")
def unknown_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("class_id")).join(source_classes(spark), "class_id", "left_anti").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("records", "source_classes") + f"SELECT path, class_idx AS label, (list_position([{', '.join(repr(c) for c in CATEGORIES)}], r.category) - 1)::INT AS category_label, CASE severity WHEN 'none' THEN 0 WHEN 'severe' THEN 3 END AS severity_label, CASE life_stage WHEN 'larva' THEN 2 WHEN 'adult' THEN 4 END AS stage_label FROM records r LEFT JOIN source_classes USING (class_id)")
def label_encode(spark, sf_dir):
    return I.encode(view(spark, sf_dir, "records"), source_classes(spark)).select("path", "label", "category_label", "severity_label", "stage_label")
