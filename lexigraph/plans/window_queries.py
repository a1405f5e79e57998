"""Ordered work."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.operators import windows
from lexigraph.plans.registry import query
from lexigraph.plans.scale import top_k


@query("w1_top_k", """
SELECT * FROM (SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def _(d):
    rows = top_k(d.raw("lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey"),
                                                    F.col("l_linenumber")], 5)
    return rows.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", "rank")


# Every order line proposes its part's name as the primary alias of the supplier's part.
@query("w2_enforce_primary", """
WITH a AS (SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR)
    AS id, concat('P:', l_suppkey) AS skill_id, CASE WHEN l_returnflag = 'A' THEN 'en' ELSE 'fr' END AS locale,
    l_linestatus = 'F' AS is_primary, l_shipdate AS created_at FROM lineitem),
f AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY skill_id, locale ORDER BY created_at DESC, id) AS rn
  FROM a WHERE is_primary) WHERE rn = 1)
SELECT id, skill_id, locale, is_primary AND id IN (SELECT id FROM f) AS is_primary FROM a""")
def _(d):
    a = d.raw("lineitem").select(
        F.expr("concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
               "cast(l_suppkey as string))").alias("id"),
        F.expr("concat('P:', l_suppkey)").alias("skill_id"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN 'en' ELSE 'fr' END").alias("locale"),
        (F.col("l_linestatus") == "F").alias("is_primary"), F.col("l_shipdate").alias("created_at"))
    return windows.enforce_primary(a).select("id", "skill_id", "locale", "is_primary")


# Numbering inside a slug group is by hashed part, so the check compares the set of slugs, not who got which.
@query("w3_unique_slugs", """
WITH n AS (SELECT lower(replace(p_name, ' ', '-')) AS base, count(*) AS n FROM part GROUP BY 1),
u AS (SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS base FROM part WHERE p_size > 45)
SELECT CASE WHEN i = 1 THEN base ELSE concat(base, '-', i) END AS slug FROM (
  SELECT base, unnest(generate_series(1 + (base IN (SELECT base FROM u))::INT, n + (base IN (SELECT base FROM u))::INT))
    AS i FROM n)""")
def _(d):
    new = d.raw("part").select(F.expr("concat('P:', p_partkey)").alias("id"), F.col("p_name").alias("name"))
    old = d.raw("part").filter("p_size > 45").select(
        F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug")).distinct()
    return windows.unique_slugs(new, old).select("slug")


@query("w4_queue_list", """
SELECT queue_id, candidate_name, round(signals_count * llm_score, 6) AS priority,
  (SELECT count(*) FROM fx_queue WHERE status = 'pending') AS total
FROM fx_queue WHERE status = 'pending' ORDER BY priority DESC, queue_id LIMIT 20""")
def _(d):
    return windows.queue_list(d.queue()).select("queue_id", "candidate_name", "priority", "total")


@query("w5_dedupe_edges", """
WITH e AS (SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR) AS id,
  concat('P:', l_partkey) AS source_skill_id, concat('P:', l_suppkey) AS target_skill_id,
  CASE l_returnflag WHEN 'A' THEN 'requires' ELSE 'related_to' END AS relationship_type, 1 - l_discount AS confidence
  FROM lineitem)
SELECT source_skill_id, target_skill_id, relationship_type, id, round(confidence, 4) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY source_skill_id, target_skill_id, relationship_type
    ORDER BY confidence DESC, id) AS rn FROM e) WHERE rn = 1""")
def _(d):
    e = d.raw("lineitem").select(
        F.expr("concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string))")
        .alias("id"), F.expr("concat('P:', l_partkey)").alias("source_skill_id"),
        F.expr("concat('P:', l_suppkey)").alias("target_skill_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'requires' ELSE 'related_to' END").alias("relationship_type"),
        (1 - F.col("l_discount")).alias("confidence"))
    return windows.dedupe_edges(e).withColumn("confidence", F.round("confidence", 4))


@query("w6_assign_versions", """
SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS graph_version FROM orders""")
def _(d):
    return windows.assign_versions(d.raw("orders").select("o_orderkey", "o_orderdate"), 1000,
                                   ("o_orderdate", "o_orderkey"), 8).select("o_orderkey", "graph_version")


@query("w7_diff", """
WITH o AS (SELECT id, description, status, category FROM fx_skills),
n AS (SELECT id, canonical_name AS description, CASE status WHEN 'candidate' THEN 'active' ELSE status END AS status,
  category FROM fx_skills WHERE status <> 'merged')
SELECT o.id, CASE WHEN n.id IS NULL THEN 'removed' ELSE 'updated' END AS change, concat_ws(';',
  CASE WHEN o.description IS DISTINCT FROM n.description THEN concat('description:', coalesce(o.description, ''), '>',
    coalesce(n.description, '')) END,
  CASE WHEN o.status IS DISTINCT FROM n.status THEN concat('status:', o.status, '>', coalesce(n.status, '')) END,
  CASE WHEN o.category IS DISTINCT FROM n.category THEN concat('category:', o.category, '>', coalesce(n.category, ''))
    END) AS changes
FROM o LEFT JOIN n USING (id) WHERE o.description IS DISTINCT FROM n.description
  OR o.status IS DISTINCT FROM n.status OR o.category IS DISTINCT FROM n.category""")
def _(d):
    old = d.skills()
    new = old.filter("status <> 'merged'").withColumns({
        "description": F.col("canonical_name"),
        "status": F.when(F.col("status") == "candidate", "active").otherwise(F.col("status"))})
    out = windows.diff(old, new, ("description", "status", "category"))
    return out.withColumn("changes", F.array_join(F.transform("changes", lambda c: F.concat(
        c["field"], F.lit(":"), F.coalesce(c["old"], F.lit("")), F.lit(">"), F.coalesce(c["new"], F.lit("")))), ";"))


@query("w8_debounce", """
SELECT event_id, normalized_form FROM (SELECT *, lead(ts_us) OVER (PARTITION BY normalized_form ORDER BY ts_us, event_id)
  AS nxt FROM fx_signals) WHERE nxt IS NULL OR nxt - ts_us > 3600000000""")
def _(d):
    return windows.debounce(d.signals(), 3_600_000_000, "normalized_form").select("event_id", "normalized_form")


@query("w9_as_of", """
SELECT entity_type, entity_id, max(graph_version) AS graph_version, arg_max(mutation_type, graph_version)
  AS mutation_type, arg_max(diff_payload, graph_version) AS diff_payload
FROM fx_changelog WHERE graph_version <= 700 GROUP BY 1, 2""")
def _(d):
    return windows.as_of(d.changelog(), 700)


@query("w10_signal_sessions", """
WITH m AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY normalized_form ORDER BY ts_us, event_id)
  > 43200000000 THEN 1 ELSE 0 END AS brk FROM fx_signals),
s AS (SELECT *, sum(brk) OVER (PARTITION BY normalized_form ORDER BY ts_us, event_id) AS session FROM m)
SELECT normalized_form, session::BIGINT AS session, count(*) AS mentions, min(ts_us) AS first_us, max(ts_us) AS last_us,
  count(*) // 5 AS triggers FROM s GROUP BY 1, 2""")
def _(d):
    return windows.signal_sessions(d.signals(), 43_200_000_000)
