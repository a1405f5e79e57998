"""Metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.operators import metrics, quality
from lexigraph.plans.registry import query


@query("a3_signals", """
SELECT normalized_form, count(*) AS frequency, count(DISTINCT source) AS sources,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS earlier,
  CASE WHEN count(*) FILTER (ts < TIMESTAMP '2024-01-16') > 0 THEN round(count(*) FILTER (ts >= TIMESTAMP '2024-01-16')
    / count(*) FILTER (ts < TIMESTAMP '2024-01-16'), 6) END AS velocity FROM fx_signals GROUP BY 1""")
def _(d):
    return metrics.signals(d.signals(), "2024-01-16 00:00:00")


@query("a4_version_info", """
SELECT max(graph_version) AS graph_version, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_mutation_at,
  (SELECT count(*) FROM fx_skills WHERE status = 'active') AS total_skills,
  (SELECT count(*) FROM fx_edges WHERE status = 'active') AS total_edges,
  (SELECT count(*) FROM fx_aliases) AS total_aliases,
  (SELECT count(DISTINCT locale) FROM fx_aliases) AS supported_locales FROM fx_changelog""")
def _(d):
    return metrics.version_info(d.changelog(), d.skills(), d.edges(), d.aliases())


@query("a5_locale_coverage", """
WITH c AS (SELECT l.locale, l.is_active, round((SELECT count(DISTINCT skill_id) FROM fx_aliases a
    WHERE a.locale = l.locale AND is_primary AND skill_id IN (SELECT id FROM fx_skills WHERE status = 'active'))
  / (SELECT count(*) FROM fx_skills WHERE status = 'active'), 6) AS coverage FROM fx_locales l)
SELECT *, is_active AND coverage < 0.8 AS alert FROM c""")
def _(d):
    return metrics.locale_coverage(d.skills(), d.aliases(), d.locales())


@query("a6_growth", """
WITH w AS (SELECT date_trunc('week', created_at) AS week, count(*) AS added FROM fx_skills GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT min(week) FROM w)::TIMESTAMP, (SELECT max(week) FROM w)::TIMESTAMP,
  INTERVAL 7 DAY)) AS week),
f AS (SELECT c.week, coalesce(added, 0) AS added FROM c LEFT JOIN w USING (week)),
m AS (SELECT *, round(avg(added) OVER (ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM f)
SELECT strftime(week, '%Y-%m-%d') AS week, added, mean_before, coalesce(added > mean_before * 2, false) AS alert FROM m""")
def _(d):
    return metrics.growth(d.skills()).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("a7_source_share", """
SELECT round(avg((source = 'curator')::INT), 6) AS curator_share,
  round(avg((source = 'llm_discovered')::INT), 6) AS llm_share, avg((source = 'curator')::INT) < 0.1 AS alert
FROM fx_skills""")
def _(d):
    return metrics.source_share(d.skills())


@query("a8_orphan_count", """
SELECT count(*) AS orphans FROM fx_skills WHERE status = 'active' AND id NOT LIKE 'T:%' AND id NOT LIKE 'B:%'
  AND id NOT IN (SELECT child_id FROM fx_hierarchy)""")
def _(d):
    top = d.skills().filter("id like 'T:%' or id like 'B:%'")
    return quality.orphans(d.skills(), d.edges(), top).agg(F.count(F.lit(1)).alias("orphans"))


@query("a9_match_coverage", """
WITH x AS (SELECT (SELECT count(*) FROM fx_mentions) AS matched,
  (SELECT round(avg(confidence), 4) FROM fx_mentions) AS mean_confidence,
  (SELECT count(*) FROM fx_logs) AS unmatched),
y AS (SELECT *, round(matched / (matched + unmatched), 6) AS coverage FROM x)
SELECT *, coverage > 0.95 AS on_target, coverage < 0.8 AS coverage_alert, mean_confidence < 0.6 AS confidence_alert
FROM y""")
def _(d):
    unknown = d.logs().select(F.explode("discovered_candidates").alias("c"))
    return metrics.match_coverage(d.mentions(), unknown)


_SCORE = """
WITH p AS (SELECT DISTINCT doc_id, skill_id FROM fx_mentions WHERE proficiency_hint = 'expert'),
g AS (SELECT DISTINCT doc_id, skill_id FROM fx_mentions WHERE confidence >= 0.95),
b AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, p.skill_id IS NOT NULL AS p, g.skill_id IS NOT NULL AS g
  FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.skill_id = g.skill_id),
s AS (SELECT {k} count(*) FILTER (p AND g) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn
  FROM b {grp}),
r AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s)
SELECT *, f1 >= 0.8 AND precision >= 0.75 AND recall >= 0.75 AS passed FROM r"""


def _pred_gold(d):
    return d.mentions().filter("proficiency_hint = 'expert'"), d.mentions().filter("confidence >= 0.95")


@query("a10_evaluate", _SCORE.format(k="", grp=""))
def _(d):
    return metrics.evaluate(*_pred_gold(d))


@query("a10_evaluate_documents", _SCORE.format(k="doc_id,", grp="GROUP BY doc_id"))
def _(d):
    return metrics.evaluate(*_pred_gold(d), per=["doc_id"])


@query("a10_evaluate_labels", """
WITH b AS (SELECT quality = 1 AS g, n_chars >= 500 AS p FROM labels JOIN documents USING (doc_id)),
s AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn
  FROM b),
r AS (SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s)
SELECT *, f1 >= 0.8 AND precision >= 0.75 AND recall >= 0.75 AS passed FROM r""")
def _(d):
    rows = d.raw("labels").join(d.raw("documents"), "doc_id").withColumn("skill_id", F.lit("quality"))
    return metrics.evaluate(rows.filter("n_chars >= 500"), rows.filter("quality = 1"))


@query("a11_regression", """
WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS release, round(1 - avg((event_type = 'error')::INT), 6) AS f1
  FROM events GROUP BY 1),
x AS (SELECT *, round(lag(f1) OVER (ORDER BY release) - f1, 6) AS "drop" FROM h)
SELECT *, coalesce("drop" <= 0.01, true) AS passed FROM x""")
def _(d):
    h = d.log().groupBy(F.expr(metrics.DAY).alias("release")).agg(
        F.round(1 - F.avg(F.col("failed").cast("int")), 6).alias("f1"))
    return metrics.regression(h)


@query("a12_log_metrics", """
WITH l AS (SELECT *, CASE WHEN key % 2 = 0 THEN 'small' ELSE 'large' END AS tier FROM fx_log)
SELECT task, tier, count(*) AS requests, round(quantile_cont(latency, 0.5), 4) AS p50,
  round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99,
  round(avg(failed::INT), 6) AS error_rate FROM l GROUP BY CUBE (task, tier)""")
def _(d):
    log = d.log().withColumn("tier", F.when(F.col("key") % 2 == 0, "small").otherwise("large"))
    return metrics.log_metrics(log, ["task", "tier"])


@query("a12_load_metrics", """
WITH l AS (SELECT *, CASE WHEN key % 2 = 0 THEN 'small' ELSE 'large' END AS tier, event_id % 3 <> 0 AS hit,
  event_id % 500 AS tin, event_id % 90 AS tout FROM fx_log)
SELECT task, tier, count(*) AS requests, round(quantile_cont(latency, 0.5), 4) AS p50,
  round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99,
  round(avg(failed::INT), 6) AS error_rate, round(count(*) / ((max(ts_us) - min(ts_us)) / 60e6), 6) AS per_minute,
  round(avg(hit::INT), 6) AS cache_hit_ratio, sum(tin)::BIGINT AS input_tokens, sum(tout)::BIGINT AS output_tokens
FROM l GROUP BY CUBE (task, tier)""")
def _(d):
    log = d.log().withColumns({"tier": F.when(F.col("key") % 2 == 0, "small").otherwise("large"), "cache_hit": F.col("event_id") % 3 != 0,
                               "input_tokens": F.col("event_id") % 500, "output_tokens": F.col("event_id") % 90})
    return metrics.log_metrics(log, ["task", "tier"], load=True)


@query("a13_cost_alerts", """
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(cost), 4) AS cost FROM fx_log GROUP BY 1),
n AS (SELECT *, datediff('day', DATE '1970-01-01', day::DATE) AS n FROM c),
m AS (SELECT day, cost, round(CASE WHEN n > min(n) OVER () THEN coalesce(sum(cost) OVER (ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)
  / least(n - min(n) OVER (), 7) END, 4) AS mean_before FROM n)
SELECT *, coalesce(cost > mean_before * 1.2, false) AS alert FROM m""")
def _(d):
    return metrics.cost_alerts(d.log())


@query("a13_cost_alerts_gaps", """
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(cost), 4) AS cost FROM fx_log WHERE day(ts) % 4 <> 0 GROUP BY 1),
n AS (SELECT *, datediff('day', DATE '1970-01-01', day::DATE) AS n FROM c),
m AS (SELECT day, cost, round(CASE WHEN n > min(n) OVER () THEN coalesce(sum(cost) OVER (ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)
  / least(n - min(n) OVER (), 7) END, 4) AS mean_before FROM n)
SELECT *, coalesce(cost > mean_before * 1.2, false) AS alert FROM m""")
def _(d):
    log = d.log()
    return metrics.cost_alerts(log.withColumn("__d", F.expr(metrics.DAY)).filter("day(to_date(__d)) % 4 <> 0").drop("__d"))


@query("a14_job_status", """
WITH s AS (SELECT o_custkey AS job_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed,
  count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1)
SELECT *, round((completed + failed) * 100 / total, 4) AS progress_pct,
  CASE WHEN completed + failed = 0 THEN 'queued' WHEN completed + failed < total THEN 'processing'
    WHEN failed > 0 THEN 'partial_failure' ELSE 'completed' END AS status FROM s""")
def _(d):
    docs = d.raw("orders").select(F.col("o_custkey").alias("job_id"), F.expr(
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'queued' END").alias("status"))
    return metrics.job_status(docs)


RATE_SQL = """
SELECT event_id, key, calls FROM (SELECT event_id, key, count(*) OVER (PARTITION BY key ORDER BY ts_us
  RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS calls FROM fx_log) WHERE calls > 3"""


@query("a15_rate_violations", RATE_SQL)
def _(d):
    return metrics.rate_violations(d.log(), 3, 6 * 3_600_000_000).select("event_id", "key", "calls")


# Small limits per request class, so that the sparse log has violations of each.
RATES = {"read": 3, "extract": 1, "mutate": 2}


def classed(log: DataFrame) -> DataFrame:
    return log.withColumn("request_class", F.expr(
        "CASE WHEN task IN ('view', 'click') THEN 'read' WHEN task = 'purchase' THEN 'mutate' ELSE 'extract' END"))


@query("a15_rate_classes", """
WITH c AS (SELECT *, CASE WHEN task IN ('view', 'click') THEN 'read' WHEN task = 'purchase' THEN 'mutate' ELSE 'extract' END AS request_class
  FROM fx_log)
SELECT event_id, key, request_class, calls FROM (SELECT event_id, key, request_class, count(*) OVER (PARTITION BY key, request_class ORDER BY ts_us
  RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS calls FROM c)
WHERE calls > CASE request_class WHEN 'read' THEN 3 WHEN 'mutate' THEN 2 ELSE 1 END""")
def _(d):
    return metrics.rate_violations(classed(d.log()), RATES, 6 * 3_600_000_000).select("event_id", "key", "request_class", "calls")

