"""Stand-in views over the driver's tables, each as Spark columns and as the same expressions for DuckDB.

A view is a list of SQL expressions that both engines read alike; {K} is the integer k of events.props, which they do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_K, DUCK_K = "CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract_string(props, '$.k') AS INT)"
#: The literal "now" of the early-warning views.
NOW = "2024-01-31 00:00:00"

BASES = {"records": "documents LEFT JOIN labels USING (doc_id)", "detections": "events", "weather": "events", "facts": "documents", "observations": "events", "latency": "events", "names": "part", "paths": "pages"}

EXPRS = {
    "records": [
        "CAST(doc_id AS STRING) AS path", "source AS class_id", "CASE lang WHEN 'en' THEN 'healthy' WHEN 'fr' THEN 'disease' WHEN 'de' THEN 'pest' ELSE 'deficiency' END AS category",
        "CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 0 THEN 'severe' ELSE 'none' END AS severity", "CASE WHEN toxic = 1 THEN 'larva' WHEN toxic = 0 THEN 'adult' ELSE 'unknown' END AS life_stage",
        "md5(lower(text)) AS group_key", "lang AS source", "doc_id AS source_rank", "n_chars",
    ],
    "facts": [
        "CAST(doc_id AS STRING) AS path", "source AS class_id", "n_chars > 8 AS ok", "n_chars AS width", "CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS height",
        "CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS std", "CAST(length(text) - length(replace(text, 'th', '')) AS DOUBLE) AS sharpness", "CASE WHEN n_chars % 7 = 0 THEN 'L' ELSE 'RGB' END AS mode", "md5(text) AS content_hash",
    ],
    "detections": [
        "event_id", "event_type AS class_id", "'f' || CAST(user_id % 10 AS STRING) AS field_id", "'z' || CAST(user_id % 3 AS STRING) AS zone", "3e-1 + 7e-1 * ((event_id * 37) % 100) / 100 AS confidence", "ts",
        "CASE WHEN {K} = 97 THEN 'severe' ELSE 'low' END AS severity", "CASE WHEN {K} >= 20 THEN value END AS count", "user_id", "EXTRACT(DAY FROM ts) AS day_no",
    ],
    "weather": ["event_id", "'f' || CAST(user_id % 10 AS STRING) AS field_id", "ts", "8 + (value * 7) % 22 AS temp_c", "80 + {K} / 5 AS humidity_pct", "CASE WHEN event_type IN ('view', 'click') THEN 1e0 ELSE 0e0 END AS leaf_wetness_hours"],
    "observations": ["event_id AS observation_id", "CAST(floor(event_id / 2) AS BIGINT) AS photo_a", "event_id AS photo_b", "CASE event_id % 5 WHEN 0 THEN 'cc0' WHEN 1 THEN 'cc-by' WHEN 2 THEN 'CC-BY-SA' WHEN 3 THEN 'cc-by-nc' END AS licence", "'u' || CAST(user_id AS STRING) AS observer", "event_type AS class_id", "CAST(ts AS DATE) AS observed_on"],
    "latency": ["event_type AS run", "value AS latency_ms"],
    "names": ["p_partkey", "p_name AS label", "p_type AS crop", "p_brand AS owner"],
    "paths": ["page_id", "regexp_replace(url, '^https?://[^/]*/|[?#].*$', '', 'g') AS path"],
}
WHERE = {"detections": "(event_id * 7 + user_id * 13) % 11 < CASE class_id WHEN 'click' THEN day_no / 3 WHEN 'view' THEN 11 - day_no / 3 WHEN 'error' THEN 2 ELSE 4 END"}

#: Classes of the event stand-ins. An empty string in flags is none.
EVENT_CLASSES = (
    ("class_idx", "class_id", "crop", "name", "category", "agent", "spread_rank", "vector", "etl_threshold", "etl_unit", "urgency", "action", "recheck_hours", "headline", "farmer_message", "flags", "water_status"),
    [
        (0, "click", "tomato", "Trap counts", "pest", "Aphis gossypii", 2, None, 50.0, "insects_per_trap", "watch", "scout_and_count", 24, "Pest activity detected", None, "", None),
        (1, "view", "potato", "Leaf blight", "disease", "Alternaria solani", 4, "click", None, None, "warning", "scout_and_protect", 48, "Possible disease detected", "Leaf blight seen. Remove the leaves", "no_overhead,prefer_furrow,morning_only", None),
        (2, "purchase", "any", "Mites", "pest", "Tetranychus spp.", 3, None, 120.0, "mites_per_leaf", "watch", "scout_and_count", 24, "Pest activity detected", None, "avoid_stress", "dry"),
        (3, "signup", "rice", "Healthy", "healthy", None, 0, None, None, None, "none", "continue_monitoring", 72, "Crop looks healthy", None, "", None),
        (4, "error", "rice", "Waterlogging", "abiotic", None, 1, None, None, None, "warning", "adjust_irrigation", 12, "Crop stress detected", "Field is waterlogged. Drain it", "suspend,drain", "waterlogged"),
    ],
)
_types = {"class_idx": "INT", "spread_rank": "INT", "etl_threshold": "DOUBLE", "recheck_hours": "INT"}

CATEGORIES = ("healthy", "disease", "pest", "deficiency", "abiotic", "background")
CROPS = ("any", "wheat", "rice", "maize", "tomato")
#: Classes of the document stand-ins: every source but the last two of src0 to src19.
SOURCE_CLASSES = (("class_idx", "class_id", "crop", "name", "category", "aliases"), [(i, f"src{i}", CROPS[i % 5], f"name {i % 12}", CATEGORIES[(i * 7) % 6], f"source {i},S-{i}") for i in range(18)])


def values(dim) -> str:
    """A SELECT of a dimension's rows that both engines read."""
    names, rows = dim
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    cols = ", ".join(f"CAST({n} AS {_types.get(n, 'STRING')}) AS {n}" for n in names)
    return f"SELECT {cols} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def dim(spark: SparkSession, rows) -> DataFrame:
    return spark.sql(values(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, *joined = BASES[name].split(" LEFT JOIN ")
    df = table(spark, sf_dir, base)
    if joined:
        df = df.join(table(spark, sf_dir, joined[0].split(" ")[0]), "doc_id", "left")
    exprs = [e.replace("{K}", SPARK_K).replace(", 'g')", ")") for e in EXPRS[name]]
    df = df.selectExpr(*exprs)
    return df.where(WHERE[name]) if name in WHERE else df


def sql(*names: str, **more: str) -> str:
    """The WITH clause that gives DuckDB the named views, and further named queries."""
    parts = []
    for n in names:
        if n in ("event_classes", "source_classes"):
            parts.append(f"{n} AS ({values(EVENT_CLASSES if n == 'event_classes' else SOURCE_CLASSES)})")
            continue
        text = f"SELECT {', '.join(EXPRS[n])} FROM {BASES[n]}".replace("{K}", DUCK_K)
        if n in WHERE:
            text = f"SELECT * FROM ({text}) WHERE {WHERE[n]}"
        parts.append(f"{n} AS ({text})")
    parts += [f"{k} AS ({v})" for k, v in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"

