"""Queries of observation curation over the event stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import curation as U
from harrow.plans.registry import query
from harrow.plans.views import EVENT_CLASSES, dim, sql, table, view

#: Agents of part brands, by the brand's number modulo their count, and the names they hold.
AGENTS = [
    ("Aphis gossypii / Lipaphis erysimi", "Aphis gossypii|Lipaphis erysimi"), ("Scarabaeidae (Holotrichia spp.)", "Holotrichia|Scarabaeidae"), ("Cicadellidae - Amrasca biguttula biguttula (cotton jassid), Empoasca spp.", "Amrasca biguttula biguttula|Cicadellidae|Empoasca"),
    ("Xanthomonas oryzae pv. oryzae", "Xanthomonas oryzae"), ("Tomato yellow leaf curl virus (whitefly-vectored)", ""), ("Nitrogen shortage", "Nitrogen"), ("the fungus", ""), ("Puccinia striiformis f. sp. tritici; Puccinia triticina", "Puccinia striiformis|Puccinia triticina"),
]


@query("WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, (_, q) in enumerate(AGENTS)) + f") AS t(i, q)) SELECT p_partkey, q AS queries FROM part JOIN a ON i = p_partkey % {len(AGENTS)}")
def taxon_queries(spark, sf_dir):
    agent = F.get(F.array(*[F.lit(a) for a, _ in AGENTS]), (F.col("p_partkey") % len(AGENTS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(U.taxon_queries(agent, F.lit("pest")), "|").alias("queries"))


@query(sql("event_classes") + "SELECT c.class_id, CASE c.class_id WHEN 'click' THEN 'Aphis gossypii' WHEN 'view' THEN 'Alternaria solani' ELSE 'Tetranychus' END AS queries, count(e.event_id)::BIGINT AS seen FROM event_classes c LEFT JOIN events e ON e.event_type = c.class_id WHERE category IN ('pest', 'disease') AND crop IN ('any', 'tomato', 'potato') GROUP BY ALL")
def classes_to_collect(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class_id")).agg(F.count(F.lit(1)).alias("seen"))
    return U.collectable(dim(spark, EVENT_CLASSES), ("pest", "disease"), ("Tomato", "Potato")).join(seen, "class_id", "left").select("class_id", F.array_join("queries", "|").alias("queries"), F.coalesce("seen", F.lit(0).cast("long")).alias("seen"))


def observations(spark, sf_dir):
    """Events as nested observations of two photos each."""
    o = view(spark, sf_dir, "observations")
    photo = lambda c: F.struct(F.col(c).alias("id"), F.col("licence").alias("license_code"), F.lit(None).cast("string").alias("attribution"), F.concat(F.lit("https://x/"), F.col(c), F.when(F.col(c) % 2 == 0, "/square.jpg").otherwise("/medium.jpg")).alias("url"))
    return o.select(F.col("observation_id").alias("id"), F.struct(F.col("class_id").alias("name")).alias("taxon"), F.struct(F.col("observer").alias("login"), F.lit(None).cast("string").alias("name")).alias("user"), F.lit(None).cast("string").alias("place_guess"), F.col("observed_on").cast("string").alias("observed_on"), F.array(photo("photo_a"), photo("photo_b")).alias("photos"), "class_id", F.lit("q").alias("taxon_query"))


def photos(spark, sf_dir):
    return U.photos(observations(spark, sf_dir))


PHOTOS = sql("observations", ph="SELECT class_id, observation_id, unnest([photo_a, photo_b]) AS photo_id, lower(licence) AS licence, observer, class_id AS taxon_name, observed_on FROM observations WHERE licence IS NOT NULL AND lower(licence) IN ('cc0', 'cc-by', 'cc-by-sa')")
RANKED = PHOTOS + ", rk AS (SELECT *, CASE class_id WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS class_rank, photo_id % 3 AS query_rank FROM ph), dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY class_rank, query_rank, observation_id) AS r FROM rk) WHERE r = 1)"


@query(PHOTOS + "SELECT class_id, observation_id, photo_id, licence, observer, taxon_name, observed_on::VARCHAR AS observed_on, 'https://x/' || photo_id || '/large.jpg' AS url FROM ph")
def observations_flatten(spark, sf_dir):
    return photos(spark, sf_dir).select("class_id", "observation_id", "photo_id", "licence", "observer", "taxon_name", "observed_on", "url")


@query(r"SELECT page_id, regexp_replace(rtrim(regexp_replace(url, '[?#].*$', ''), '/') || (['/square.jpg', '/medium.png', '/other.jpg'])[1 + page_id % 3], '/(small|medium|large|original|square)\.', '/large.') AS url FROM pages")
def url_rewrite(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("/square.jpg", "/medium.png", "/other.jpg")])
    url = F.concat(F.rtrim(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")), F.get(ends, (F.col("page_id") % 3).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", U.resized(url).alias("url"))


def deduped(spark, sf_dir):
    order = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("class_id"))
    return U.first_of_photo(photos(spark, sf_dir).withColumns({"class_rank": rank, "query_rank": F.col("photo_id") % 3}))


@query(RANKED + " SELECT photo_id, class_id, observation_id FROM dd")
def photo_dedupe(spark, sf_dir):
    return deduped(spark, sf_dir).select("photo_id", "class_id", "observation_id")


@query(RANKED + " SELECT class_id, photo_id, r2::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY query_rank, photo_id) AS r2 FROM dd) WHERE r2 <= 100")
def per_class_budget(spark, sf_dir):
    return U.within_budget(deduped(spark, sf_dir), 100).select("class_id", "photo_id", "place")


@query(RANKED.replace("WITH ", sql("event_classes").strip() + ", ", 1) + " SELECT c.class_id, count(dd.photo_id)::BIGINT AS photos, count(dd.photo_id) < 1000 AS thin FROM event_classes c LEFT JOIN dd USING (class_id) GROUP BY 1")
def availability(spark, sf_dir):
    return U.availability(deduped(spark, sf_dir), dim(spark, EVENT_CLASSES), 1000)


@query(RANKED + " SELECT licence, observer, count(*)::BIGINT AS n FROM dd GROUP BY GROUPING SETS ((licence), (observer), ())")
def credits(spark, sf_dir):
    return U.credits(deduped(spark, sf_dir))


@query(RANKED + " SELECT count(*)::BIGINT AS photos, count(DISTINCT class_id)::BIGINT AS classes, count(DISTINCT observer)::BIGINT AS observers, count(DISTINCT licence)::BIGINT AS licences FROM dd")
def collection_summary(spark, sf_dir):
    return U.collection_summary(deduped(spark, sf_dir))


@query(sql("event_classes") + "SELECT class_id, n, 2000 - n AS lacking FROM (SELECT c.class_id, count(e.event_id)::BIGINT AS n FROM event_classes c LEFT JOIN events e ON e.event_type = c.class_id WHERE category IN ('pest', 'disease') GROUP BY 1) WHERE n < 2000")
def top_up(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return U.top_up(counts, dim(spark, EVENT_CLASSES), 2000)
