"""Selections and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.functions import text, vectors
from lexigraph.operators import filters, joins, quality
from lexigraph.plans.registry import query

_SKILL = ["id", "external_id", "canonical_name", "status", "category"]
_SKILL_SQL = "id, external_id, canonical_name, status, category"


@query("f1_active", "SELECT id, category FROM fx_skills WHERE status = 'active' AND embedding IS NOT NULL")
def _(d):
    return filters.active(d.skills(), with_vector=True).select("id", "category")


@query("f2_list_skills", f"""
SELECT {_SKILL_SQL}, (SELECT count(*) FROM fx_skills WHERE status = 'active' AND category = 'tool') AS total
FROM fx_skills WHERE status = 'active' AND category = 'tool' ORDER BY canonical_name, id LIMIT 20 OFFSET 40""")
def _(d):
    return filters.list_skills(d.skills(), "active", "tool", offset=40).select(*_SKILL, "total")


@query("f3_lookup", """
WITH keys AS (
  SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN concat('P:', l_partkey) WHEN l_linenumber % 3 = 1
    THEN concat('p-', l_partkey) ELSE concat('SK-', substr(sha256(concat('P:', l_partkey)), 1, 16)) END AS key
  FROM lineitem)
SELECT DISTINCT key, id, canonical_name FROM keys JOIN fx_skills
ON key = id OR key = external_id OR key = slug""")
def _(d):
    keys = d.raw("lineitem").select(F.expr(
        "CASE WHEN l_linenumber % 3 = 0 THEN concat('P:', l_partkey) WHEN l_linenumber % 3 = 1 THEN "
        "concat('p-', l_partkey) ELSE concat('SK-', substr(sha2(concat('P:', l_partkey), 256), 1, 16)) END AS key"))
    return filters.lookup(d.skills(), keys.distinct()).select("key", "id", "canonical_name")


@query("f4_list_aliases", "SELECT skill_id, surface_form, is_primary, locale FROM fx_aliases WHERE locale = 'en'")
def _(d):
    return filters.list_aliases(d.aliases(), locale="en").select("skill_id", "surface_form", "is_primary", "locale")


@query("f5_min_confidence", """
WITH r AS (SELECT doc_id, skill_id, max(confidence * section_weight) AS confidence FROM fx_mentions GROUP BY 1, 2)
SELECT doc_id, skill_id, round(confidence, 6) AS confidence, total_before
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total_before FROM r) WHERE round(confidence, 6) >= 0.7""")
def _(d):
    r = d.mentions().groupBy("doc_id", "skill_id").agg(
        F.round(F.max(F.col("confidence") * F.col("section_weight")), 6).alias("confidence"))
    return filters.min_confidence(r, 0.7)


@query("f6_changelog_since", """
SELECT graph_version, actor, mutation_type, entity_id, diff_payload FROM fx_changelog
WHERE graph_version > 100 ORDER BY graph_version LIMIT 50""")
def _(d):
    return filters.changelog_since(d.changelog(), 100).select(
        "graph_version", "actor", "mutation_type", "entity_id", "diff_payload")


@query("f6b_top_skills", """
WITH r AS (SELECT doc_id, skill_id, max(confidence) AS confidence FROM fx_mentions GROUP BY 1, 2)
SELECT doc_id, skill_id, confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, skill_id) AS rank FROM r)
WHERE rank <= 3""")
def _(d):
    r = d.mentions().groupBy("doc_id", "skill_id").agg(F.max("confidence").alias("confidence"))
    return filters.top_skills(r, 3)


@query("f7_contains_candidate", """
SELECT log_id, normalized_form FROM fx_logs
WHERE normalized_form IN (SELECT lower(canonical_name) FROM fx_skills WHERE status = 'candidate')""")
def _(d):
    forms = (d.skills().filter("status = 'candidate'")
             .select(F.lower("canonical_name").alias("normalized_form")).distinct())
    return joins.contains_candidate(d.logs(), forms).select("log_id", "normalized_form")


@query("f8_path_descendants", """
SELECT id, path, len(string_split(path, '.')) - 1 AS depth_below FROM fx_skills
WHERE path = 'ECONOMY' OR path LIKE 'ECONOMY.%'""")
def _(d):
    return filters.path_descendants(d.skills(), "ECONOMY").select(
        "id", "path", F.col("depth_below").cast("bigint").alias("depth_below"))


@query("f8_path_counts", """
WITH p AS (SELECT id, path, unnest(list_transform(generate_series(1, len(string_split(path, '.'))),
  lambda i: array_to_string(list_slice(string_split(path, '.'), 1, i), '.'))) AS ancestor_path FROM fx_skills)
SELECT ancestor_path, count(*) AS descendants FROM p WHERE path <> ancestor_path GROUP BY 1""")
def _(d):
    return (filters.path_prefixes(d.skills()).filter("path <> ancestor_path")
            .groupBy("ancestor_path").agg(F.count(F.lit(1)).alias("descendants")))


@query("f9_check_limits", """
SELECT doc_id, CASE WHEN length(text) < 1 THEN 'text is empty' WHEN length(text) > 5000 THEN 'text is too long'
  WHEN count(*) OVER (PARTITION BY source) > 49 THEN 'batch is too large' END AS reason FROM fx_docs""")
def _(d):
    return filters.check_limits(d.docs(), max_chars=5000, max_batch=49).select("doc_id", "reason")


_F10 = """
WITH c AS (SELECT DISTINCT doc_id, chunk_index, skill_id FROM fx_mentions WHERE proficiency_hint = 'expert'),
m AS (SELECT r.*, c.skill_id IS NOT NULL AS ok FROM fx_mentions r LEFT JOIN c USING (doc_id, chunk_index, skill_id))
"""


def _validated(d):
    m = d.mentions()
    return filters.validate_results(m, m.filter("proficiency_hint = 'expert'"))


@query("f10_validate_results", _F10 + "SELECT doc_id, chunk_index, skill_id, confidence FROM m WHERE ok")
def _(d):
    return _validated(d)[0].select("doc_id", "chunk_index", "skill_id", "confidence")


@query("f10_stripped_report", _F10 + """
SELECT doc_id, count(*) AS total, count(*) FILTER (NOT ok) AS stripped,
  count(*) FILTER (NOT ok) / count(*) > 0.5 AS mostly_invalid FROM m GROUP BY 1""")
def _(d):
    return _validated(d)[1]


@query("f11_embedding_shortcut", """
WITH s AS (
  SELECT v.id AS chunk_id, k.id AS skill_id,
    round(list_cosine_similarity(v.embedding, k.embedding), 6) AS similarity
  FROM fx_vectors v JOIN fx_skills k ON k.status = 'active' AND k.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, skill_id) AS rank FROM s)
SELECT chunk_id, skill_id, similarity AS confidence FROM r WHERE rank = 1 AND similarity > 0.92""")
def _(d):
    chunks = d.vectors().select(F.col("id").alias("query_id"), "embedding")
    best = vectors.nearest(chunks, filters.active(d.skills(), True), 1)
    return filters.embedding_shortcut(best).select(
        F.col("query_id").alias("chunk_id"), F.col("id").alias("skill_id"), "confidence")


@query("f12_route", """
WITH t AS (SELECT doc_id, locale, source, ceil(len(list_filter(regexp_split_to_array(text, '\\s+'),
  lambda w: w <> '')) * 1.3)::BIGINT AS tokens FROM fx_docs)
SELECT doc_id, CASE WHEN locale <> 'en' THEN 'large' WHEN tokens < 200 THEN 'small'
  WHEN source = 'src1' THEN 'large' ELSE 'small' END AS tier FROM t""")
def _(d):
    kind = F.when(F.col("source") == "src1", "research_paper").otherwise("post")
    return d.docs().select("doc_id", filters.route(
        F.lit("extraction"), F.col("locale"), text.estimate_tokens(F.col("text")), kind).alias("tier"))


@query("f13_assign_variant", """
WITH v AS (SELECT d.doc_id, (concat('0x', substr(sha256(d.doc_id::VARCHAR), 1, 8))::BIGINT % 3)::INT AS variant,
  quality, toxic FROM fx_docs d JOIN labels USING (doc_id))
SELECT variant, count(*) AS documents, round(avg(quality), 6) AS quality FROM v GROUP BY 1""")
def _(d):
    v = d.docs().join(d.raw("labels"), "doc_id").withColumn("variant", filters.assign_variant(F.col("doc_id"), 3))
    return v.groupBy("variant").agg(F.count(F.lit(1)).alias("documents"),
                                    F.round(F.avg("quality"), 6).alias("quality"))


_AUDIT_EDGES = """
SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR) AS id,
  concat('P:', l_partkey) AS source_skill_id, concat('P:', l_suppkey * 21) AS target_skill_id,
  CASE l_returnflag WHEN 'A' THEN 'related_to' WHEN 'N' THEN 'requires' ELSE 'linked_to' END AS relationship_type,
  1 - l_discount + l_tax AS confidence, 1 - l_discount AS weight, 'human_curated' AS provenance,
  CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'open' END AS status FROM lineitem"""


def _audit_edges(d):
    return d.raw("lineitem").select(F.expr("""struct(
        concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string)) as id,
        concat('P:', l_partkey) as source_skill_id, concat('P:', l_suppkey * 21) as target_skill_id,
        CASE l_returnflag WHEN 'A' THEN 'related_to' WHEN 'N' THEN 'requires' ELSE 'linked_to' END
          as relationship_type,
        1 - l_discount + l_tax as confidence, 1 - l_discount as weight, 'human_curated' as provenance,
        CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'open' END as status) as e""")).select("e.*")


@query("q1_audit_constraints", f"""
WITH ae AS ({_AUDIT_EDGES}), v AS (
  SELECT 'edges' AS tbl, 'relationship_type' AS rule, id AS entity_id FROM ae WHERE relationship_type = 'linked_to'
  UNION ALL SELECT 'edges', 'status', id FROM ae WHERE status = 'open'
  UNION ALL SELECT 'edges', 'confidence range', id FROM ae WHERE confidence NOT BETWEEN 0 AND 1
  UNION ALL SELECT 'edges', 'self edge', id FROM ae WHERE source_skill_id = target_skill_id
  UNION ALL SELECT 'edges', 'target_skill_id unknown', id FROM ae
    WHERE target_skill_id NOT IN (SELECT id FROM fx_skills)
  UNION ALL SELECT 'edges', 'edge repeated', concat_ws('|', source_skill_id, target_skill_id, relationship_type)
    FROM ae GROUP BY source_skill_id, target_skill_id, relationship_type HAVING count(*) > 1
  UNION ALL SELECT 'skills', 'slug repeated', slug FROM fx_skills GROUP BY slug HAVING count(*) > 1)
SELECT tbl AS "table", rule, entity_id FROM v""")
def _(d):
    return quality.audit_constraints(d.skills(), d.aliases(), _audit_edges(d), d.cooccurrence(), d.changelog(), d.queue())


@query("q2_sanitize", """
SELECT page_id, trim(regexp_replace(nfc_normalize(regexp_replace(html, '<[^>]*>', '', 'g')), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))
  AS name FROM pages""")
def _(d):
    return d.raw("pages").select("page_id", text.sanitize(F.col("html")).alias("name"))


@query("q3_duplicate_edges", """
WITH p AS (SELECT DISTINCT concat('P:', l_partkey) AS s, concat('P:', l_partkey + l_linenumber) AS t
  FROM lineitem),
new AS (SELECT concat_ws('|', s, t, 'related_to', k) AS id, s, t
  FROM p, (SELECT unnest(['a', 'b']) AS k))
SELECT id, CASE WHEN e.id IS NOT NULL THEN 'existing' WHEN rn > 1 THEN 'batch' END AS duplicate
FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY id) AS rn FROM new) n
LEFT JOIN (SELECT source_skill_id, target_skill_id, min(id) FROM fx_edges WHERE relationship_type = 'related_to'
  GROUP BY 1, 2) e(s, t, id) ON e.s = n.s AND e.t = n.t""".replace("SELECT id, CASE", "SELECT n.id, CASE"))
def _(d):
    new = d.raw("lineitem").selectExpr(
        "concat('P:', l_partkey) as source_skill_id", "concat('P:', l_partkey + l_linenumber) as target_skill_id",
        "'related_to' as relationship_type").distinct().withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b"))))
    new = new.withColumn("id", F.concat_ws("|", *quality.EDGE_KEY, "k"))
    return quality.check_duplicate_edges(new, d.edges()).select("id", "duplicate")


@query("q4_orphans", """
SELECT id FROM fx_skills WHERE status = 'active' AND id NOT LIKE 'T:%' AND id NOT LIKE 'B:%'
  AND id NOT IN (SELECT child_id FROM fx_hierarchy)""")
def _(d):
    top = d.skills().filter("id like 'T:%' or id like 'B:%'")
    return quality.orphans(d.skills(), d.edges(), top).select("id")


@query("q5_alias_conflicts", """
SELECT lower(surface_form) AS form, locale, count(DISTINCT skill_id) AS skills FROM fx_aliases
WHERE skill_id IN (SELECT id FROM fx_skills WHERE status = 'active') GROUP BY 1, 2 HAVING count(DISTINCT skill_id) > 1""")
def _(d):
    return quality.alias_conflicts(d.skills(), d.aliases())


@query("q6_ambiguous_names", """
WITH n AS (SELECT id AS skill_id, lower(trim(canonical_name)) AS name FROM fx_skills
  UNION ALL SELECT skill_id, lower(trim(surface_form)) FROM fx_aliases)
SELECT name, count(DISTINCT skill_id) AS skills FROM n GROUP BY 1 HAVING count(DISTINCT skill_id) > 1""")
def _(d):
    return quality.ambiguous_names(d.skills(), d.aliases())


@query("q7_coverage_audit", """
SELECT s.id, concat('no alias in ', l.locale) AS problem FROM fx_skills s, fx_locales l
WHERE s.status = 'active' AND l.is_active
  AND NOT EXISTS (SELECT 1 FROM fx_aliases a WHERE a.skill_id = s.id AND a.locale = l.locale)
UNION ALL SELECT id, 'no description' FROM fx_skills WHERE status = 'active' AND description IS NULL""")
def _(d):
    return quality.coverage_audit(d.skills(), d.aliases(), d.locales())


@query("q9_check_evidence", """
SELECT m.doc_id, m.skill_id, m.evidence, contains(t.text, m.evidence) AS evidence_ok
FROM (SELECT doc_id, skill_id, CASE WHEN chunk_index % 3 = 0 THEN skill_name ELSE evidence END AS evidence
  FROM fx_mentions) m JOIN fx_job_docs t USING (doc_id)""")
def _(d):
    m = d.mentions().withColumn("evidence", F.when(F.col("chunk_index") % 3 == 0, F.array("skill_name"))
                                .otherwise(F.col("evidence")))
    return quality.check_evidence(m, d.job_docs()).select(
        "doc_id", "skill_id", F.col("evidence")[0].alias("evidence"), "evidence_ok")
