"""Co-occurrence: pairs per document, counts, merged counts and the edges they support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.operators import cooccur, joins
from lexigraph.plans.registry import query
from lexigraph.sources.derived import micros


def flat(cooc: DataFrame) -> DataFrame:
    """Count table with the map spelled out, comparable across engines."""
    n = F.col("source_type_counts")
    return cooc.select(
        "skill_a_id", "skill_b_id", "co_occurrence_count",
        *[F.coalesce(n[s], F.lit(0)).alias(f"n_{s}") for s in ("cv", "jd", "course")],
        micros("last_seen_at").alias("last_seen_us"), micros("created_at").alias("created_us"))


_FLAT = """co_occurrence_count, n_cv, n_jd, n_course, epoch_us(last_seen_at) AS last_seen_us,
 epoch_us(created_at) AS created_us"""


@query("j7_document_pairs", "SELECT doc_id, a AS skill_a_id, b AS skill_b_id, source_type FROM fx_pairs")
def _(d):
    return cooccur.document_pairs(d.mentions()).drop("ts")


@query("a1_cooccurrence", f"SELECT skill_a_id, skill_b_id, {_FLAT} FROM fx_cooccurrence")
def _(d):
    return flat(d.fresh_cooccurrence())


@query("a2_merge_cooccurrence", f"""
WITH half AS (
  SELECT a, b, source_type, ts, source_type = 'cv' AS old FROM fx_pairs),
agg AS (
  SELECT a AS skill_a_id, b AS skill_b_id, count(*) AS co_occurrence_count,
    count(*) FILTER (source_type = 'cv') AS n_cv, count(*) FILTER (source_type = 'jd') AS n_jd,
    count(*) FILTER (source_type = 'course') AS n_course, max(ts) AS last_seen_at, min(ts) AS created_at
  FROM half GROUP BY 1, 2)
SELECT skill_a_id, skill_b_id, {_FLAT} FROM agg""")
def _(d):
    pairs = cooccur.document_pairs(d.mentions())
    old = cooccur.cooccurrence(pairs.filter("source_type = 'cv'"))
    delta = cooccur.cooccurrence(pairs.filter("source_type <> 'cv'"))
    return flat(cooccur.merge_cooccurrence(old, delta))


@query("j4_match_pairs", """
SELECT c.skill_a_id, c.skill_b_id, e.id, e.weight, c.co_occurrence_count FROM fx_cooccurrence c
JOIN fx_group_edges e ON least(e.source_skill_id, e.target_skill_id) = c.skill_a_id
 AND greatest(e.source_skill_id, e.target_skill_id) = c.skill_b_id""")
def _(d):
    return cooccur.match_pairs(d.cooccurrence(), d.group_edges()).select(
        "skill_a_id", "skill_b_id", "id", "weight", "co_occurrence_count")


@query("j6_named_pairs", """
SELECT c.skill_a_id, c.skill_b_id, a.canonical_name AS skill_a_name, b.canonical_name AS skill_b_name,
  c.co_occurrence_count
FROM fx_cooccurrence c JOIN fx_skills a ON a.id = c.skill_a_id JOIN fx_skills b ON b.id = c.skill_b_id""")
def _(d):
    return joins.named_pairs(d.cooccurrence(), d.skills()).select(
        "skill_a_id", "skill_b_id", "skill_a_name", "skill_b_name", "co_occurrence_count")


def _strengthen_sql(base: str) -> str:
    return f"""
WITH hit AS (
  SELECT *, row_number() OVER (PARTITION BY skill_a_id, skill_b_id ORDER BY confidence DESC, id) AS rn FROM (
    SELECT c.skill_a_id, c.skill_b_id, e.* FROM fx_cooccurrence c JOIN fx_group_edges e
    ON least(e.source_skill_id, e.target_skill_id) = c.skill_a_id
     AND greatest(e.source_skill_id, e.target_skill_id) = c.skill_b_id WHERE c.co_occurrence_count >= 20))
SELECT coalesce(h.id, concat_ws('|', 'related_to', c.skill_a_id, c.skill_b_id)) AS id,
  coalesce(h.source_skill_id, c.skill_a_id) AS source_skill_id,
  coalesce(h.target_skill_id, c.skill_b_id) AS target_skill_id, 'related_to' AS relationship_type,
  round(coalesce(h.confidence, least(1.0, c.co_occurrence_count / 100.0)), 6)::DOUBLE AS confidence,
  round(least(1.0, coalesce(h.{base}, 0) + c.co_occurrence_count / 100.0), 6)::DOUBLE AS weight,
  coalesce(h.provenance, 'empirical') AS provenance,
  CASE WHEN h.id IS NULL THEN 'edge_created' ELSE 'edge_updated' END AS mutation_type, c.co_occurrence_count
FROM fx_cooccurrence c LEFT JOIN hit h ON h.rn = 1 AND h.skill_a_id = c.skill_a_id AND h.skill_b_id = c.skill_b_id
WHERE c.co_occurrence_count >= 20"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("confidence", "weight")})


@query("m8_strengthen", _strengthen_sql("weight"))
def _(d):
    return _rounded(cooccur.strengthen(d.fresh_cooccurrence(), d.group_edges()))


@query("m8_strengthen_initial", _strengthen_sql("confidence"))
def _(d):
    return _rounded(cooccur.strengthen(d.fresh_cooccurrence(), d.group_edges(), base="confidence"))


def _leaf_cooccurrence(d) -> DataFrame:
    lines = d.raw("lineitem").select("l_orderkey", "l_partkey")
    orders = d.raw("orders").selectExpr("o_orderkey as l_orderkey", "o_orderdate as ts")
    mentions = lines.join(orders, "l_orderkey").selectExpr(
        "l_orderkey as doc_id", "concat('P:', l_partkey) as skill_id", "'jd' as source_type", "ts")
    return cooccur.cooccurrence(cooccur.document_pairs(mentions))


@query("m8_merge_review", """
WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, concat('P:', l_partkey) AS skill_id FROM lineitem),
c AS (SELECT x.skill_id AS skill_a_id, y.skill_id AS skill_b_id, count(*) AS co_occurrence_count
  FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.skill_id < y.skill_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT skill_a_id, skill_b_id, co_occurrence_count,
  round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity,
  round(list_cosine_similarity(a.embedding, b.embedding), 6) >= 0.3 AS near_duplicate
FROM c JOIN fx_skills a ON a.id = skill_a_id JOIN fx_skills b ON b.id = skill_b_id""")
def _(d):
    keep, near = cooccur.split_near_duplicates(_leaf_cooccurrence(d), d.skills(), 2, 0.3)
    cols = ["skill_a_id", "skill_b_id", "co_occurrence_count", "similarity"]
    return (keep.select(*cols, F.lit(False).alias("near_duplicate"))
            .unionByName(near.select(*cols, F.lit(True).alias("near_duplicate"))))
