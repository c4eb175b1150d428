"""The registered queries of the training-text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.llm import language_id, quality
from harrow.llm.alignment import align
from harrow.llm.backoff import score as score_by_automaton
from harrow.llm.chat_repair import repair_roles
from harrow.llm.common import held_out, shared_path, table
from harrow.llm.decontamination import contamination
from harrow.llm.line_dedup import drop_repeated_chunks
from harrow.llm.minhash_dedup import near_duplicates
from harrow.llm.mixing import mix_sources
from harrow.llm.substring_dedup import drop_repeated_spans
from harrow.llm.topk import as_integers, top_k
from harrow.llm.warc import base32_of_sha1, read_archive, write_archive
from harrow.llm.whitening import whiten

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLES["op2_mix_sources"] = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM src),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, coalesce(least(cap, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
d AS (SELECT s.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM d
"""


@query
def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "top_passage")


@query
def op4_chat_repair(spark, sf_dir):
    return repair_roles(table(spark, sf_dir, "conversations"))


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_exact_topk(spark, sf_dir):
    vectors = as_integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLES["op6_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_warc_archive(spark, sf_dir):
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    # a response's record ends with its payload and two line ends; the payload is taken from the rebuilt record, a revisit's from the store
    found = read_archive(spark, path)
    body = F.when(F.col("record_type") == "response", F.substring("record", F.octet_length("header") + 1, F.length("record") - F.octet_length("header") - 4)).otherwise(F.col("payload"))
    return found.select("page_id", F.length(body).cast("long").alias("payload_bytes"), base32_of_sha1(F.sha1(body)).alias("payload_digest"), "record_type", "refers_to")


ORACLES["op8_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d
"""


@query
def op9_substring_dedup(spark, sf_dir):
    return drop_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
g AS (SELECT doc_id, i, x, x || ' ' || lead(x, 1) OVER w || ' ' || lead(x, 2) OVER w || ' ' || lead(x, 3) OVER w || ' ' || lead(x, 4) OVER w || ' ' || lead(x, 5) OVER w || ' ' || lead(x, 6) OVER w || ' ' || lead(x, 7) OVER w || ' ' || lead(x, 8) OVER w || ' ' || lead(x, 9) OVER w || ' ' || lead(x, 10) OVER w || ' ' || lead(x, 11) OVER w || ' ' || lead(x, 12) OVER w AS g FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, x, CASE WHEN g IS NOT NULL THEN min(doc_id) OVER (PARTITION BY g) END AS owner FROM g),
k AS (SELECT doc_id, i, x, coalesce(bool_or(owner < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM m)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY 1) r USING (doc_id)
"""


@query
def op7_line_dedup(spark, sf_dir):
    return drop_repeated_chunks(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("kept_text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h FROM l),
b AS (SELECT *, CASE WHEN i = 0 OR (lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 3 = 0 THEN 1 ELSE 0 END AS s FROM h),
c AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM b),
k AS (SELECT doc_id, c, min(i) AS j, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, c HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, j) AS r FROM k),
m AS (SELECT c.doc_id, c.i, c.x, coalesce(r.r > 1, false) AS gone FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND c.c = r.c)
SELECT d.doc_id, count(m.i)::BIGINT AS n_lines, count(*) FILTER (WHERE m.gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(m.x, chr(10) ORDER BY m.i) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


@query
def op10_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLES["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM n),
q AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, q.n, w, unnest(range(1, len(w) - q.n + 2)) AS i FROM d, q WHERE len(w) >= q.n),
e AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM p),
h AS (SELECT e.doc_id, e.i, e.n, g.item_id FROM e JOIN g USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op11_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), exact=True)


@query
def op12_tokenizer_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))


@query
def op13_lm_scores(spark, sf_dir):
    return score_by_automaton(table(spark, sf_dir, "documents"))
