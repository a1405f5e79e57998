"""Tables on storage and the exchange with outside services."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.functions.text import slug
from lexigraph.plans.registry import query
from lexigraph.plans.scale import work_dir
from lexigraph.plans.search_queries import _ACTIVE, as_queries, sim
from lexigraph.operators import search
from lexigraph.sources import exchange, tables


def _tables(d) -> tables.Tables:
    return {"skills": d.skills(), "aliases": d.aliases(), "edges": d.edges(), "co_occurrences": d.cooccurrence(),
            "locales": d.locales(), "changelog": d.changelog().drop("value"), "queue": d.queue(),
            "extraction_logs": d.logs().drop("log_id")}


_COUNTS = """
SELECT 'skills' AS "table", count(*) AS rows FROM fx_skills UNION ALL SELECT 'aliases', count(*) FROM fx_aliases
UNION ALL SELECT 'edges', count(*) FROM fx_edges UNION ALL SELECT 'co_occurrences', count(*) FROM fx_cooccurrence
UNION ALL SELECT 'locales', count(*) FROM fx_locales UNION ALL SELECT 'changelog', count(*) FROM fx_changelog
UNION ALL SELECT 'queue', count(*) FROM fx_queue
UNION ALL SELECT 'extraction_logs', count(DISTINCT log_id) FROM fx_logs"""


def _saved(d):
    folder = tables.snapshot(_tables(d), work_dir(d.spark, "snapshot"), 1, "2024-01-31")
    return tables.restore(d.spark, folder)


@query("s1_load_taxonomy", _COUNTS)
def _(d):
    return tables.counts(_saved(d))


@query("s6_snapshot_manifest", _COUNTS.replace('AS "table"', 'AS "table"'))
def _(d):
    folder = tables.snapshot(_tables(d), work_dir(d.spark, "snapshot"), 1, "2024-01-31")
    return d.spark.read.json(f"{folder}/manifest").select("table", "rows")


@query("s7_restore_round_trip", """
SELECT t AS "table", s AS side, 0::BIGINT AS rows FROM (SELECT unnest(['skills', 'aliases', 'edges', 'co_occurrences',
  'locales', 'changelog', 'queue', 'extraction_logs']) AS t), (SELECT unnest(['left', 'right']) AS s)""")
def _(d):
    return tables.round_trip(_tables(d), _saved(d))


@query("s2_seed", """
SELECT locale, is_active FROM fx_locales UNION ALL SELECT l, true FROM (
  SELECT unnest(['en', 'vi', 'fr', 'ja', 'zh']) AS l) WHERE l NOT IN (SELECT locale FROM fx_locales)""")
def _(d):
    new = tables.seed_locales(d.spark)
    roots = d.raw("part").select(F.col("p_type").alias("canonical_name")).distinct().withColumn(
        "slug", slug(F.col("canonical_name")))
    locales, skills = tables.seed(d.locales(), d.skills(), new, roots)
    again, _ = tables.seed(locales, skills, new, roots)
    return again.select("locale", "is_active")


@query("s2_seed_roots", """
SELECT slug, canonical_name FROM fx_skills UNION ALL SELECT lower(p_type), p_type FROM (SELECT DISTINCT p_type FROM part)
WHERE lower(p_type) NOT IN (SELECT slug FROM fx_skills)""")
def _(d):
    roots = d.raw("part").select(F.col("p_type").alias("canonical_name")).distinct().withColumn(
        "slug", slug(F.col("canonical_name")))
    new = tables.seed_locales(d.spark)
    locales, skills = tables.seed(d.locales(), d.skills(), new, roots)
    _, again = tables.seed(locales, skills, new, roots)
    return again.select("slug", "canonical_name")


@query("s2_seed_root_concepts", """
SELECT slug, canonical_name, category FROM fx_skills UNION ALL SELECT slug, name, 'domain' FROM (VALUES ('technology', 'Technology'),
  ('business', 'Business'), ('design', 'Design'), ('science', 'Science'), ('languages', 'Languages'), ('soft-skills', 'Soft Skills'))
  AS r(slug, name) WHERE slug NOT IN (SELECT slug FROM fx_skills)""")
def _(d):
    roots = tables.seed_roots(d.spark)
    _, once = tables.seed(d.locales(), d.skills(), tables.seed_locales(d.spark), roots)
    _, twice = tables.seed(d.locales(), once, tables.seed_locales(d.spark), roots)
    return twice.select("slug", "canonical_name", "category")


@query("s4_read_documents", "SELECT doc_id::VARCHAR AS id, text, source AS source_type, lang FROM documents")
def _(d):
    path = work_dir(d.spark, "documents")
    d.raw("documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata"),
        F.col("source").alias("source_type")).write.json(path)
    return tables.read_documents(d.spark, path).select("id", "text", "source_type",
                                                       F.col("metadata")["lang"].alias("lang"))


@query("s8_search_documents", """
SELECT s.id, external_id, canonical_name, slug, description, category, status, 0 AS page,
  string_agg(DISTINCT surface_form, ',' ORDER BY surface_form) AS aliases
FROM fx_skills s LEFT JOIN fx_aliases a ON a.skill_id = s.id WHERE status = 'active' GROUP BY ALL""")
def _(d):
    return exchange.search_documents(d.skills(), d.aliases()).withColumn("aliases", F.array_join("aliases", ","))


@query("s9_build_requests", f"""
WITH s AS (SELECT v.id AS chunk_id, k.id, external_id, canonical_name, {sim('v', 'k')} AS similarity
  FROM fx_vectors v JOIN fx_skills k ON {_ACTIVE}),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT chunk_id, concat(string_agg(concat('[', external_id, '] ', canonical_name), E'\\n' ORDER BY rank), E'\\n\\n',
  'text of ', chunk_id) AS prompt FROM r WHERE rank <= 100 GROUP BY 1""")
def _(d):
    chunks = d.vectors().select(F.col("id").alias("chunk_id"), F.concat(F.lit("text of "), "id").alias("text"))
    cands = search.candidates(as_queries(d.vectors()), d.skills()).withColumnRenamed("query_id", "chunk_id")
    return exchange.build_requests(chunks, cands).select("chunk_id", "prompt")


# Prompts with the documents' own chunks: each chunk takes the vector of its document's number.
@query("s9_document_requests", f"""
WITH v AS (SELECT doc_id::VARCHAR AS chunk_id, text, v.embedding FROM fx_docs JOIN fx_vectors v ON v.id = concat('v', doc_id)),
s AS (SELECT chunk_id, k.id, external_id, canonical_name, {sim('v', 'k')} AS similarity FROM v JOIN fx_skills k ON {_ACTIVE}),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, id) AS rank FROM s),
l AS (SELECT chunk_id, string_agg(concat('[', external_id, '] ', canonical_name), E'\\n' ORDER BY rank) AS lines FROM r WHERE rank <= 100 GROUP BY 1)
SELECT d.doc_id::VARCHAR AS chunk_id, concat_ws(E'\\n\\n', lines, text) AS prompt FROM fx_docs d LEFT JOIN l ON l.chunk_id = d.doc_id::VARCHAR""")
def _(d):
    docs = d.docs().select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    vectors = d.vectors().select(F.col("id").alias("vec"), "embedding")
    asks = docs.select(F.col("chunk_id").alias("query_id"), F.concat(F.lit("v"), "chunk_id").alias("vec")).join(vectors, "vec").select("query_id", "embedding")
    cands = search.candidates(asks, d.skills()).withColumnRenamed("query_id", "chunk_id")
    return exchange.build_requests(docs, cands).select("chunk_id", "prompt")


def _responses(d):
    m = d.mentions().withColumn("ev", F.col("evidence")[0])
    body = F.expr("""concat('{"extracted_skills":[{', CASE WHEN chunk_index = 5 THEN '' ELSE
        concat('"skill_id":"', skill_id, '",') END, '"skill_name":"', skill_name, '","confidence":', confidence,
        ',"evidence":["', ev, '"],"proficiency_hint":"', proficiency_hint, '","context_type":"explicit"}]',
        CASE WHEN section = 'company' AND chunk_index = 1 THEN '' ELSE ',"discovered_candidates":[]}' END)""")
    return exchange.ingest_responses(m.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "skill_id")
        .alias("chunk_id"), body.alias("body")))


@query("s10_ingest_responses", """
SELECT concat_ws('-', doc_id::VARCHAR, chunk_index::VARCHAR, skill_id) AS chunk_id, skill_id, confidence,
  evidence FROM fx_mentions WHERE chunk_index <> 5 AND NOT (section = 'company' AND chunk_index = 1)""")
def _(d):
    return _responses(d)[0].select("chunk_id", "skill_id", "confidence", F.col("evidence")[0].alias("evidence"))


@query("s10_quarantine", """
SELECT concat_ws('-', doc_id::VARCHAR, chunk_index::VARCHAR, skill_id) AS chunk_id,
  CASE WHEN chunk_index = 5 THEN 'missing or bad field' ELSE 'malformed' END AS reason FROM fx_mentions
WHERE chunk_index = 5 OR (section = 'company' AND chunk_index = 1)""")
def _(d):
    return _responses(d)[1]


@query("s11_read_golden", """
SELECT doc_id::VARCHAR AS id, skill_id, 'orders' AS source FROM (SELECT DISTINCT doc_id, skill_id FROM fx_mentions)""")
def _(d):
    path = work_dir(d.spark, "golden")
    d.mentions().groupBy("doc_id").agg(F.collect_set("skill_id").alias("expected_skills")).join(
        d.job_docs(), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", "expected_skills",
                                       F.lit("orders").alias("source")).write.json(path)
    return tables.read_golden(d.spark, path).select("id", "skill_id", "source")


def _embed(texts: list[str]) -> list[list[float]]:
    """A stand-in for the outside embedding call: text length and number of vowels."""
    return [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts]


@query("s12_backfill_embeddings", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 1)
  THEN 2.0 ELSE length(text) END::DOUBLE AS first_value FROM documents""")
def _(d):
    docs = d.docs().select(F.col("doc_id").alias("id"), "text", F.when(
        F.col("doc_id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).cast("array<float>").alias("embedding"))
    cache = docs.filter("id % 3 = 1").groupBy(exchange.text_key(F.col("text")).alias("key")).agg(
        F.array(F.lit(2.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    filled, _ = exchange.backfill_embeddings(docs, cache, _embed)
    return filled.select(F.col("id").alias("doc_id"), F.col("embedding")[0].cast("double").alias("first_value"))


def _cached(d):
    base = d.docs().withColumns({"candidate_ids": F.array("locale", F.lit("all"))})
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 20000 as int))")
    cache = base.filter("doc_id % 2 = 0").select(
        exchange.result_key(F.col("text"), F.col("candidate_ids")).alias("key"), at.alias("created_at"))
    cache = cache.groupBy("key").agg(F.max("created_at").alias("created_at"))
    return exchange.split_cached(base.filter("doc_id % 2 = 1"), cache, F.expr("timestamp_ntz'2024-01-07 05:00:00'"))


_CACHE = """
WITH b AS (SELECT doc_id, sha256(concat(text, array_to_string(list_sort([locale, 'all']), ','))) AS key FROM fx_docs),
c AS (SELECT key FROM b WHERE doc_id % 2 = 0 GROUP BY 1 HAVING max(TIMESTAMP '2024-01-01'
  + INTERVAL 1 MINUTE * (doc_id % 20000)) > TIMESTAMP '2023-12-31 05:00:00')
"""


@query("s13_cache_hits", _CACHE + "SELECT doc_id, key FROM b WHERE doc_id % 2 = 1 AND key IN (SELECT key FROM c)")
def _(d):
    return _cached(d)[0].select("doc_id", "key")


@query("s13_cache_misses", _CACHE + "SELECT doc_id, key FROM b WHERE doc_id % 2 = 1 AND key NOT IN (SELECT key FROM c)")
def _(d):
    return _cached(d)[1].select("doc_id", "key")


@query("s14_extraction_log", """
SELECT sha256(text) AS document_hash, source_type, substr(text, 1, 500) AS input_text_preview, n AS candidates
FROM fx_job_docs JOIN (SELECT doc_id, count(DISTINCT evidence) AS n FROM fx_mentions
  WHERE confidence < 0.95 GROUP BY 1) USING (doc_id)""")
def _(d):
    unknown = d.mentions().filter("confidence < 0.95").groupBy("doc_id").agg(
        F.collect_set(F.col("evidence")[0]).alias("discovered_candidates"))
    rows = d.job_docs().join(unknown, "doc_id", "left").withColumns({
        "discovered_candidates": F.coalesce("discovered_candidates", F.expr("cast(array() as array<string>)")),
        "extracted_skill_ids": F.expr("cast(array() as array<string>)"),
        "created_at": F.expr("timestamp_ntz'2024-01-01 00:00:00'")})
    return exchange.extraction_log(rows).select(
        "document_hash", "source_type", "input_text_preview",
        F.size("discovered_candidates").cast("bigint").alias("candidates"))
