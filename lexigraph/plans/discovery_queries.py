"""Discovery: routing, queue, decisions and suggested edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.operators import discovery, metrics, search
from lexigraph.plans.registry import query
from lexigraph.plans.search_queries import _ACTIVE, V4_SQL, as_queries, pairs_sql, sim, waiting


def _routed(d, **kw):
    return discovery.route_candidates(
        search.check_duplicates(as_queries(d.vectors()), d.skills(), d.alias_vectors()), **kw)


_ROUTE = "CASE verdict WHEN 'duplicate' THEN 'alias' WHEN 'review' THEN 'review' ELSE 'new' END"


@query("m10_route_candidates", f"WITH {V4_SQL} SELECT query_id, skill_id, similarity, {_ROUTE} AS route FROM verdicts")
def _(d):
    return _routed(d).drop("verdict")


@query("a16_discovery_summary", f"""WITH {V4_SQL} SELECT count(*) AS candidates_found,
  count(*) FILTER (verdict <> 'duplicate') AS added_to_queue, count(*) FILTER (verdict = 'duplicate') AS auto_aliased
FROM verdicts""")
def _(d):
    return metrics.discovery_summary(_routed(d))


@query("m11_queue_add", """
WITH b AS (SELECT lower(p_name) AS normalized_name, count(*) AS n FROM part GROUP BY 1)
SELECT coalesce(queue_id, concat('RQ:', b.normalized_name)) AS queue_id, b.normalized_name,
  coalesce(signals_count, 0) + n AS signals_count, 'pending' AS status
FROM b LEFT JOIN (SELECT * FROM fx_queue WHERE status = 'pending') q USING (normalized_name)
UNION ALL SELECT queue_id, normalized_name, signals_count, status FROM fx_queue WHERE status <> 'pending'""")
def _(d):
    none = F.expr("cast(array() as array<string>)")
    cands = d.raw("part").select(
        F.concat(F.lit("  "), F.upper("p_name")).alias("candidate_name"), F.lit("tool").alias("category_guess"),
        F.lit(0.5).alias("llm_score"), none.alias("similar_existing"), none.alias("suggested_parents"))
    return discovery.queue_add(d.queue(), cands).select("queue_id", "normalized_name", "signals_count", "status")


def _decide(d):
    decisions = d.queue().select(
        "queue_id", F.expr("CASE WHEN llm_score >= 0.6 THEN 'approve' WHEN llm_score >= 0.5 THEN 'merge' "
                           "WHEN llm_score >= 0.4 THEN 'defer' ELSE 'reject' END").alias("decision"),
        F.col("similar_existing")[0].alias("merge_target_id"), F.lit("by score").alias("notes"))
    return discovery.decide(d.queue().drop("decision"), d.skills(), d.aliases(), d.edges(), decisions)


_DEC = """
WITH q AS (SELECT *, CASE WHEN llm_score >= 0.6 THEN 'approve' WHEN llm_score >= 0.5 THEN 'merge'
  WHEN llm_score >= 0.4 THEN 'defer' ELSE 'reject' END AS decision, status IN ('pending', 'deferred') AS open,
  concat('N:', substr(sha256(concat_ws('|', queue_id, candidate_name)), 1, 16)) AS nid,
  split_part(similar_existing, ',', 1) AS target FROM fx_queue)
"""


@query("m12_decide", _DEC + """
SELECT queue_id, CASE WHEN NOT open THEN status WHEN decision = 'approve' THEN 'approved' WHEN decision = 'merge'
  THEN 'merged' WHEN decision = 'defer' THEN 'deferred' ELSE 'rejected' END AS status FROM q""")
def _(d):
    return _decide(d).tables["queue"].select("queue_id", "status")


@query("m12_rejected", _DEC + "SELECT queue_id, 'already decided' AS reason FROM q WHERE NOT open")
def _(d):
    return _decide(d).rejected


@query("m12_skills", _DEC + "SELECT nid AS id, candidate_name AS canonical_name, category_guess AS category FROM q "
       "WHERE open AND decision = 'approve'")
def _(d):
    return _decide(d).extra["skills"].select("id", "canonical_name", "category")


@query("m12_edges", _DEC + """
SELECT parent AS source_skill_id, nid AS target_skill_id, 0.5::DOUBLE AS weight, 'llm_predicted' AS provenance FROM (
  SELECT *, unnest(string_split(suggested_parents, ',')) AS parent FROM q WHERE open AND decision = 'approve')""")
def _(d):
    return _decide(d).extra["edges"].select("source_skill_id", "target_skill_id", "weight", "provenance")


@query("m12_aliases", _DEC + """
SELECT target AS skill_id, candidate_name AS surface_form FROM q WHERE open AND decision = 'merge'""")
def _(d):
    return _decide(d).extra["aliases"].select("skill_id", "surface_form")


@query("m12_activations", _DEC + """
SELECT nid AS skill_id, normalized_name FROM q WHERE open AND decision = 'approve'""")
def _(d):
    return _decide(d).extra["activations"]


_NEAR = f"""
s AS (SELECT c.id AS query_id, k.id, {sim('c', 'k')} AS similarity FROM fx_skills c JOIN fx_skills k
  ON {_ACTIVE} AND c.status = 'candidate'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
  WHERE rank <= 5)"""


@query("m13_suggest_relationships", f"""WITH {_NEAR}
SELECT *, CASE WHEN similarity >= 0.85 THEN 'high' WHEN similarity >= 0.35 THEN 'medium' END AS strength,
  CASE WHEN similarity >= 0.35 THEN 'related_to' ELSE 'none' END AS relationship_type FROM n""")
def _(d):
    return discovery.suggest_relationships(waiting(d), d.skills(), low=0.35)


@query("m13_labelled_relationships", f"""WITH {_NEAR},
l AS (SELECT *, CASE rank WHEN 1 THEN 'PARENT_CHILD' WHEN 2 THEN 'CHILD_PARENT' WHEN 3 THEN 'RELATED'
  WHEN 4 THEN 'PREREQUISITE' ELSE 'NONE' END AS c FROM n)
SELECT CASE c WHEN 'CHILD_PARENT' THEN id ELSE query_id END AS source_skill_id,
  CASE c WHEN 'CHILD_PARENT' THEN query_id ELSE id END AS target_skill_id,
  CASE c WHEN 'RELATED' THEN 'related_to' WHEN 'PREREQUISITE' THEN 'requires' ELSE 'parent_of' END AS relationship_type,
  0.9::DOUBLE AS confidence, similarity FROM l WHERE c <> 'NONE'""")
def _(d):
    near = search.knn(waiting(d), d.skills(), 5)
    label = F.element_at(F.array(*[F.lit(x) for x in ("PARENT_CHILD", "CHILD_PARENT", "RELATED", "PREREQUISITE",
                                                      "NONE")]), F.col("rank"))
    labels = near.select("query_id", "id", label.alias("classification"), F.lit(0.9).alias("confidence"))
    return discovery.suggest_relationships(waiting(d), d.skills(), labels)


@query("m14_batch_pairs", """
WITH n AS (SELECT skill_a_id, skill_b_id, row_number() OVER (ORDER BY skill_a_id, skill_b_id) AS rn FROM fx_cooccurrence)
SELECT (rn - 1) // 15 AS batch, count(*) AS pairs, min(concat(skill_a_id, '+', skill_b_id)) AS first_pair,
  string_agg(skill_b_id, ',' ORDER BY rn) AS targets FROM n GROUP BY 1""")
def _(d):
    b = discovery.batch_pairs(d.cooccurrence())
    return b.select("batch", F.size("pairs").cast("bigint").alias("pairs"),
                    F.array_min(F.transform("pairs", lambda p: F.concat_ws("+", p["skill_a_id"], p["skill_b_id"])))
                    .alias("first_pair"),
                    F.array_join(F.transform("pairs", lambda p: p["skill_b_id"]), ",").alias("targets"))


@query("m16_similarity_edges", f"""WITH {pairs_sql('fx_skills', 0.35)}
SELECT concat_ws('|', 'related_to', skill_a_id, skill_b_id) AS id, similarity AS weight, 'pending_review' AS status,
  'embedding_similarity' AS provenance FROM related_pairs r WHERE relation = 'related_medium' AND NOT EXISTS (
  SELECT 1 FROM fx_edges e WHERE relationship_type = 'related_to' AND e.status = 'active'
    AND least(e.source_skill_id, e.target_skill_id) = r.skill_a_id
    AND greatest(e.source_skill_id, e.target_skill_id) = r.skill_b_id)""")
def _(d):
    return discovery.similarity_edges(d.skills(), d.edges(), low=0.35).select("id", "weight", "status", "provenance")
