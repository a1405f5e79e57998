"""Walks and checks over the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.operators import density, graph, joins, quality
from lexigraph.plans.registry import query
from lexigraph.plans.search_queries import sim

NEAR = 0.7000005  # between two values of six digits


@query("g0_hierarchy", "SELECT * FROM fx_hierarchy")
def _(d):
    return graph.hierarchy(d.edges())


_UP = """
WITH up(seed_id, skill_id, depth) AS (
  SELECT child_id, parent_id, 1 FROM fx_hierarchy
  UNION SELECT u.seed_id, h.parent_id, u.depth + 1 FROM up u JOIN fx_hierarchy h ON h.child_id = u.skill_id
  WHERE u.depth < 5)
"""


@query("g1_ancestors", _UP + """
SELECT seed_id, skill_id, depth FROM up WHERE skill_id IN (SELECT id FROM fx_skills WHERE status = 'active')""")
def _(d):
    return graph.ancestors(d.edges(), d.skills(), d.skills())


@query("g1_ancestors_shortest", _UP + """
SELECT seed_id, skill_id, min(depth) AS depth FROM up
WHERE skill_id IN (SELECT id FROM fx_skills WHERE status = 'active') GROUP BY 1, 2""")
def _(d):
    return graph.ancestors(d.edges(), d.skills(), d.skills(), shortest=True)


@query("g2_descendants", """
WITH down(seed_id, skill_id, depth) AS (
  SELECT source_skill_id, target_skill_id, 1 FROM fx_tree
  UNION SELECT x.seed_id, t.target_skill_id, x.depth + 1 FROM down x JOIN fx_tree t
  ON t.source_skill_id = x.skill_id WHERE x.depth < 5)
SELECT seed_id, skill_id, depth FROM down""")
def _(d):
    seeds = d.tree().select(F.col("source_skill_id").alias("id")).distinct()
    return graph.descendants(d.tree(), seeds)


_CRUMBS = """
WITH walk(id, top, path, n) AS (
  SELECT id, id, canonical_name, 1 FROM fx_skills
  UNION ALL SELECT w.id, h.parent_id, concat(s.canonical_name, ' > ', w.path), w.n + 1 FROM walk w
  JOIN fx_hierarchy h ON h.child_id = w.top JOIN fx_skills s ON s.id = h.parent_id),
ends AS (SELECT DISTINCT id, path AS breadcrumb, n AS length FROM walk
  WHERE top NOT IN (SELECT child_id FROM fx_hierarchy))
"""


@query("g3_breadcrumbs", _CRUMBS + "SELECT id, breadcrumb, length, false AS truncated FROM ends")
def _(d):
    return graph.breadcrumbs(d.edges(), d.skills())


@query("g3_breadcrumb_shortest", _CRUMBS + """
SELECT id, breadcrumb, length, false AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length, breadcrumb) AS rn
  FROM ends) WHERE rn = 1""")
def _(d):
    return graph.breadcrumbs(d.edges(), d.skills(), shortest=True)


# Chains of fifteen parts, fourteen edges deep.
_CHAIN = "SELECT p_partkey AS k, p_name FROM part"


def _chain(d):
    """Edges k -> k + 1 within blocks of fifteen parts, and the parts as concepts."""
    k = d.raw("part").select(F.col("p_partkey").alias("k"), "p_name").distinct()
    after = k.select((F.col("k") - 1).alias("k"))
    e = k.join(after, "k").filter("k % 15 <> 0").selectExpr(
        "concat('C|', k) AS id", "concat('P:', k) AS source_skill_id", "concat('P:', k + 1) AS target_skill_id",
        "'parent_of' AS relationship_type", "1.0D AS confidence", "'active' AS status", "'human_curated' AS provenance", "1.0D AS weight")
    skills = k.selectExpr("concat('P:', k) AS id", "p_name AS canonical_name", "'active' AS status")
    return e, skills


@query("g3_breadcrumbs_deep", f"""WITH walk(k, top, path, n) AS (
  SELECT k, k, p_name, 1 FROM ({_CHAIN})
  UNION ALL SELECT w.k, p.k, concat(p.p_name, ' > ', w.path), w.n + 1 FROM walk w JOIN ({_CHAIN}) p ON p.k = w.top - 1 AND p.k % 15 <> 0)
SELECT concat('P:', k) AS id, arg_max(path, n) AS breadcrumb, max(n)::INT AS length, false AS truncated FROM walk GROUP BY k""")
def _(d):
    return graph.breadcrumbs(*_chain(d))


@query("g3_breadcrumbs_limited", f"""WITH walk(k, top, path, n) AS (
  SELECT k, k, p_name, 1 FROM ({_CHAIN})
  UNION ALL SELECT w.k, p.k, concat(p.p_name, ' > ', w.path), w.n + 1 FROM walk w JOIN ({_CHAIN}) p ON p.k = w.top - 1 AND p.k % 15 <> 0
  WHERE w.n <= 8)
SELECT concat('P:', w.k) AS id, arg_max(path, n) AS breadcrumb, max(n)::INT AS length, (w.k - 1) % 15 > 8 AS truncated FROM walk w GROUP BY w.k""")
def _(d):
    return graph.breadcrumbs(*_chain(d), depth=8)


# Proposed edges: every part above its brand, its type, the group it is in and the next part.
_NEW_SQL = """
new AS (
  SELECT concat_ws('|', s, t) AS id, s AS source_skill_id, t AS target_skill_id FROM (
    SELECT concat('P:', p_partkey) AS s, concat('B:', p_brand) AS t FROM part
    UNION ALL SELECT concat('P:', p_partkey), concat('BT:', p_brand, '/', p_type) FROM part
    UNION ALL SELECT concat('T:', p_type), concat('P:', p_partkey) FROM part
    UNION ALL SELECT concat('P:', p_partkey), concat('P:', p_partkey) FROM part WHERE p_size > 45
    UNION ALL SELECT concat('BT:', p_brand, '/', p_type), concat('P:', p_partkey) FROM part))"""


def _new_edges(d):
    rows = d.raw("part").select(F.explode(F.expr("""filter(array(
        struct(concat('P:', p_partkey) as s, concat('B:', p_brand) as t),
        struct(concat('P:', p_partkey) as s, concat('BT:', p_brand, '/', p_type) as t),
        struct(concat('T:', p_type) as s, concat('P:', p_partkey) as t),
        struct(concat('P:', p_partkey) as s, if(p_size > 45, concat('P:', p_partkey), null) as t),
        struct(concat('BT:', p_brand, '/', p_type) as s, concat('P:', p_partkey) as t)),
        x -> x.t is not null)""")).alias("e")).select("e.*")
    return rows.select(F.concat_ws("|", "s", "t").alias("id"), F.col("s").alias("source_skill_id"),
                       F.col("t").alias("target_skill_id"), F.lit("parent_of").alias("relationship_type"),
                       F.lit("active").alias("status"))


_REACH = """
WITH up(lo, hi) AS (SELECT child_id, parent_id FROM fx_hierarchy
  UNION SELECT u.lo, h.parent_id FROM up u JOIN fx_hierarchy h ON h.child_id = u.hi),
""" + _NEW_SQL


@query("g4_check_cycles", _REACH + """
SELECT id, source_skill_id = target_skill_id OR EXISTS (SELECT 1 FROM up WHERE lo = source_skill_id AND hi = target_skill_id)
  AS closes_cycle FROM new""")
def _(d):
    return graph.check_cycles(_new_edges(d), d.edges()).select(
        "id", F.col("cycle_path").isNotNull().alias("closes_cycle"))


@query("g4_cycle_paths", "WITH " + _NEW_SQL.strip() + """,
walk(id, node, goal, path) AS (SELECT id, source_skill_id, target_skill_id, [source_skill_id] FROM new
  UNION ALL SELECT w.id, h.parent_id, w.goal, list_append(w.path, h.parent_id) FROM walk w
  JOIN fx_hierarchy h ON h.child_id = w.node WHERE w.node <> w.goal)
SELECT n.id, array_to_string(p.path, ' > ') AS cycle_path FROM new n LEFT JOIN (
  SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS rn FROM walk WHERE node = goal) p
ON p.id = n.id AND p.rn = 1""")
def _(d):
    return graph.check_cycles(_new_edges(d), d.edges()).select("id", F.array_join("cycle_path", " > ").alias("cycle_path"))


VALIDATED = _REACH + """,
early AS (SELECT *, CASE WHEN source_skill_id = target_skill_id THEN 'self edge'
    WHEN EXISTS (SELECT 1 FROM fx_edges e WHERE e.source_skill_id = new.source_skill_id
      AND e.target_skill_id = new.target_skill_id AND relationship_type = 'parent_of') THEN 'duplicate edge'
    WHEN EXISTS (SELECT 1 FROM up WHERE lo = source_skill_id AND hi = target_skill_id) THEN 'cycle' END AS reason
  FROM new),
links AS (SELECT parent_id AS s, child_id AS t FROM fx_hierarchy
  UNION SELECT source_skill_id, target_skill_id FROM early WHERE reason IS NULL),
reach(a, b) AS (SELECT s, t FROM links UNION SELECT r.a, l.t FROM reach r JOIN links l ON l.s = r.b),
judged AS (SELECT id, source_skill_id, coalesce(reason, CASE WHEN EXISTS (SELECT 1 FROM reach WHERE a = target_skill_id
  AND b = source_skill_id) THEN 'cycle within batch' END) AS reason FROM early)
"""


@query("q8_validate_edges", VALIDATED + "SELECT id, reason FROM judged")
def _(d):
    return quality.validate_edges(_new_edges(d), d.edges()).select("id", "reason")


@query("g5_cycles", """
WITH reach(a, b) AS (SELECT source_skill_id, target_skill_id FROM fx_loops
  UNION SELECT r.a, l.target_skill_id FROM reach r JOIN fx_loops l ON l.source_skill_id = r.b)
SELECT x.a AS node, max(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def _(d):
    return graph.cycles(d.loops())


_USER_SKILLS = """
us AS (SELECT user_id AS doc_id, concat('P:', props::JSON ->> '$.k') AS skill_id,
  max(round(1 / (1 + abs(value)), 4)) AS confidence FROM events GROUP BY 1, 2)"""


def _user_skills(d):
    return d.raw("events").select(
        F.col("user_id").alias("doc_id"), F.concat(F.lit("P:"), F.get_json_object("props", "$.k")).alias("skill_id"),
        F.round(1 / (1 + F.abs("value")), 4).alias("confidence"))


@query("g6_expand", f"""
WITH {_USER_SKILLS},
par AS (SELECT doc_id, parent_id AS skill_id, max(confidence) AS confidence FROM us JOIN fx_hierarchy
  ON child_id = us.skill_id GROUP BY 1, 2),
raw AS (
  SELECT doc_id, skill_id, confidence, 0 AS r FROM par
  UNION ALL SELECT doc_id, child_id, confidence, 1 FROM us JOIN fx_hierarchy ON parent_id = us.skill_id
  UNION ALL SELECT doc_id, child_id, confidence, 2 FROM par JOIN fx_hierarchy ON parent_id = par.skill_id),
best AS (SELECT doc_id, skill_id, confidence,
  row_number() OVER (PARTITION BY doc_id, skill_id ORDER BY confidence DESC, r) AS rn, r FROM raw)
SELECT doc_id, skill_id, round(confidence * 0.6, 6) AS confidence,
  CASE r WHEN 0 THEN 'parent' WHEN 1 THEN 'child' ELSE 'sibling' END AS expansion_type, true AS is_expanded
FROM best WHERE rn = 1 AND skill_id IN (SELECT id FROM fx_skills WHERE status = 'active')
  AND NOT EXISTS (SELECT 1 FROM us WHERE us.doc_id = best.doc_id AND us.skill_id = best.skill_id)""")
def _(d):
    return graph.expand(_user_skills(d), d.edges(), d.skills(), digits=6)


@query("j11_drop_already_extracted", f"""
WITH {_USER_SKILLS},
par AS (SELECT DISTINCT doc_id, parent_id AS skill_id FROM us JOIN fx_hierarchy ON child_id = us.skill_id),
sib AS (SELECT DISTINCT doc_id, child_id AS skill_id FROM par JOIN fx_hierarchy ON parent_id = par.skill_id)
SELECT doc_id, skill_id FROM sib EXCEPT SELECT doc_id, skill_id FROM us""")
def _(d):
    return joins.new_siblings(_user_skills(d), graph.hierarchy(d.edges()))


@query("g7_depth_histogram", """
WITH down(skill_id, depth) AS (
  SELECT DISTINCT child_id, 1 FROM fx_hierarchy WHERE parent_id NOT IN (SELECT child_id FROM fx_hierarchy)
    AND parent_id IN (SELECT id FROM fx_skills WHERE status = 'active')
  UNION SELECT h.child_id, x.depth + 1 FROM down x JOIN fx_hierarchy h ON h.parent_id = x.skill_id),
m AS (SELECT skill_id, max(depth) AS depth FROM down GROUP BY 1)
SELECT depth, count(*) AS nodes, depth > 8 AS over_limit FROM m GROUP BY 1""")
def _(d):
    return graph.depth_histogram(d.edges(), joins.roots(d.skills(), d.edges()))


@query("g7_depth_histogram_deep", f"""
SELECT ((k - 1) % 15)::INT AS depth, count(*) AS nodes, (k - 1) % 15 > 8 AS over_limit FROM ({_CHAIN}) WHERE (k - 1) % 15 > 0 GROUP BY ALL""")
def _(d):
    e, skills = _chain(d)
    return graph.depth_histogram(e, joins.roots(skills, e))


@query("g8_multi_parent", """
SELECT child_id AS skill_id, count(*) AS parents FROM fx_hierarchy GROUP BY 1 HAVING count(*) > 1""")
def _(d):
    return graph.multi_parent(d.edges())


_COUNTS = """
WITH ends AS (SELECT source_skill_id AS id FROM fx_edges WHERE status = 'active'
  UNION ALL SELECT target_skill_id FROM fx_edges WHERE status = 'active'),
c AS (SELECT s.id, count(e.id) AS edges FROM fx_skills s LEFT JOIN ends e ON e.id = s.id
  WHERE s.status = 'active' GROUP BY 1)
"""


@query("g9_edge_counts", _COUNTS + "SELECT * FROM c")
def _(d):
    return graph.edge_counts(d.skills(), d.edges())


@query("g9_edge_density", _COUNTS + """
SELECT count(*) AS nodes, round(avg(edges), 6) AS mean_edges, count(*) FILTER (edges < 1) AS below,
  count(*) FILTER (edges > 20) AS above, avg(edges) < 1 OR avg(edges) > 20 AS alert,
  avg(edges) BETWEEN 2 AND 6 AS on_target FROM c""")
def _(d):
    return graph.edge_density(d.skills(), d.edges())


@query("g10_clusters")
def _(d):
    return graph.clusters(d.skills())


@query("g10_cluster_invariants", """
SELECT count(*) AS vectors, count(DISTINCT id) AS ids, count(*) AS size_sum, 0::BIGINT AS wrong_gaps FROM fx_skills
WHERE embedding IS NOT NULL""")
def _(d):
    rows = graph.clusters(d.skills())
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.count_if(
        F.col("gap") != (F.col("size") < 5)).alias("wrong"), F.count_distinct("id").alias("ids"))
    return per.agg(F.sum("n").alias("vectors"), F.sum("ids").alias("ids"), F.sum("size").alias("size_sum"), F.sum("wrong").alias("wrong_gaps"))


# Clusters of one level of the density tree: neighbours within reach of each other, from all pairs.
_REACH = f"""
s AS (SELECT a.id AS x, b.id AS y, {sim('a', 'b')} AS similarity FROM fx_vectors a JOIN fx_vectors b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY similarity DESC, y) AS rank FROM s QUALIFY rank <= 5),
core AS (SELECT x AS id, round(1 - min(similarity), 6) AS core FROM near GROUP BY 1),
reach_pairs AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b,
  greatest(round(1 - similarity, 6), p.core, q.core, 0.000001) AS w
  FROM near JOIN core p ON p.id = x JOIN core q ON q.id = y)"""


@query("g10_reach_graph", f"WITH {_REACH} SELECT a, b, w FROM reach_pairs")
def _(d):
    return density.reach_graph(d.vectors())


@query("g10_density_cut", f"""WITH {_REACH},
e AS (SELECT a, b FROM reach_pairs WHERE w <= {NEAR} UNION SELECT b, a FROM reach_pairs WHERE w <= {NEAR}),
reached(v, t) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM reached r JOIN e ON e.a = r.t),
named AS (SELECT v, min(t) AS cluster, count(*) AS size FROM reached GROUP BY 1)
SELECT id, cluster, coalesce(size, 0) AS size FROM fx_vectors LEFT JOIN (SELECT * FROM named WHERE size >= 5) ON v = id""")
def _(d):
    return density.density_cut(d.vectors(), NEAR)


# The most stable clusters over all levels; tests compare them with a brute-force tree.
@query("g10_density_clusters")
def _(d):
    return density.density_clusters(d.vectors())


@query("g10_density_invariants", "SELECT count(DISTINCT id) AS ids, 0::BIGINT AS wrong FROM fx_vectors")
def _(d):
    rows = density.density_clusters(d.vectors())
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("id").alias("first"))
    wrong = F.col("cluster").isNotNull() & ((F.col("n") != F.col("size")) | (F.col("first") != F.col("cluster")) | (F.col("n") < 5))
    return per.agg(F.sum("n").alias("ids"), F.count_if(wrong).alias("wrong"))
