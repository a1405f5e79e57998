"""Streaming jobs run over the present tables and compared with their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigraph.plans.cooccur_queries import _FLAT, flat
from lexigraph.plans.metric_queries import RATES, classed
from lexigraph.plans.registry import query
from lexigraph.plans.scale import work_dir
from lexigraph.plans.text_queries import _TAGS
from lexigraph.sources import exchange
from lexigraph.sources.derived import Derived, micros
from lexigraph.streaming import jobs


def _events(d: Derived, files: int | None = None) -> DataFrame:
    """The event table as a stream: its own file, or spread over several for more than one batch."""
    raw = d.raw("events")
    if files is None:
        return jobs.file_stream(d.spark, d.dir, raw.schema, "events.parquet")
    return _spread(d, raw, files)


def _spread(d: Derived, rows: DataFrame, batches: int) -> DataFrame:
    """Rows as a stream of so many batches. Files are as many as the tasks that make the rows, so none holds a share of the whole."""
    folder = work_dir(d.spark, "arrivals")
    rows.write.parquet(folder)
    files = len(d.spark.read.parquet(folder).inputFiles())
    if files < batches:  # a small table
        few, folder, files = d.spark.read.parquet(folder), work_dir(d.spark, "arrivals"), batches
        few.repartition(batches).write.parquet(folder)
    return jobs.file_stream(d.spark, folder, rows.schema, files_per_batch=-(-files // batches))


#: Rows of a file of arriving events.
ARRIVING_ROWS = 250_000


def _in_turn(d: Derived, run: Callable[[Derived], StreamingQuery], slices: int = 3) -> None:
    """Run a job over slices of the event table that arrive one after another in event time, each as files of bounded size.

    ``run`` starts the job on the views whose event table is the stream; it goes on where it stopped after the slice before.
    """
    raw = d.raw("events")
    first, last, n = raw.select(F.min(micros("ts")), F.max(micros("ts")), F.count(F.lit(1))).first()
    width = (last - first) // slices + 1 if first is not None else 1
    folder, files = work_dir(d.spark, "arrivals"), -(-n // (slices * ARRIVING_ROWS)) or 1
    for i in range(slices):
        part = F.floor((micros("ts") - F.lit(first or 0)) / F.lit(width)) == i
        raw.filter(part).repartition(files).write.mode("append").parquet(folder)
        jobs.finish(run(_over(d, jobs.file_stream(d.spark, folder, raw.schema))))


def _over(d: Derived, events: DataFrame) -> Derived:
    """Derived views whose event table is a stream."""
    s = Derived(d.spark, d.dir)
    s.raw = lambda name: events if name == "events" else d.raw(name)
    return s


@query("t1_stream_extract", f"""WITH {_TAGS}
SELECT doc_id, skill_id, 1.0::DOUBLE AS confidence, string_agg(DISTINCT form, ',') AS evidence FROM tags GROUP BY 1, 2""")
def _(d):
    path = work_dir(d.spark, "t1")
    forms = d.dictionary().withColumnRenamed("surface_form", "form")
    jobs.finish(jobs.stream_extract(_spread(d, d.docs(), 2), forms, path))
    return jobs.output(d.spark, path).select("doc_id", "skill_id", "confidence",
                                             F.array_join("evidence", ",").alias("evidence"))


@query("t2_stream_signals", """
WITH m AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY normalized_form ORDER BY ts_us, event_id)
  > 43200000000 THEN 1 ELSE 0 END AS brk FROM fx_signals),
s AS (SELECT *, sum(brk) OVER (PARTITION BY normalized_form ORDER BY ts_us, event_id) AS session FROM m),
c AS (SELECT normalized_form, session, count(*) // 5 AS n FROM s GROUP BY 1, 2)
SELECT normalized_form, sum(n)::BIGINT AS triggers FROM c GROUP BY 1 HAVING sum(n) > 0""")
def _(d):
    path = work_dir(d.spark, "t2")
    _in_turn(d, lambda s: jobs.stream_signals(s.signals(), path, gap_us=43_200_000_000))
    return jobs.output(d.spark, path).groupBy("normalized_form").agg(F.sum("triggers").alias("triggers"))


@query("t3_stream_cooccurrence", f"SELECT skill_a_id, skill_b_id, {_FLAT} FROM fx_cooccurrence")
def _(d):
    path = work_dir(d.spark, "t3")
    docs = d.mentions().groupBy("doc_id").agg(F.collect_set("skill_id").alias("skill_ids"),
                                              F.min("source_type").alias("source_type"), F.max("ts").alias("ts"))
    jobs.finish(jobs.stream_cooccurrence(_spread(d, docs, 3), path))
    return flat(jobs.read_cooccurrence(d.spark, path))


@query("t4_stream_search_sync", """
SELECT entity_id, max(graph_version) AS graph_version,
  CASE WHEN arg_max(mutation_type, graph_version) IN ('skill_deprecated', 'skill_merged') THEN 'delete' ELSE 'upsert'
  END AS op FROM fx_changelog GROUP BY 1""")
def _(d):
    path = work_dir(d.spark, "t4")
    jobs.finish(jobs.stream_search_sync(_over(d, _events(d, 3)).changelog(), path))
    return jobs.read_sync(d.spark, path).drop("mutation_type")


@query("t4_search_documents", """
WITH last AS (SELECT entity_id, arg_max(mutation_type, graph_version) AS change FROM fx_changelog GROUP BY 1)
SELECT s.id, external_id, canonical_name, slug, description, category, status, 0 AS page,
  string_agg(DISTINCT surface_form, ',' ORDER BY surface_form) AS aliases
FROM fx_skills s JOIN last ON entity_id = s.id LEFT JOIN fx_aliases a ON a.skill_id = s.id
WHERE status = 'active' AND change NOT IN ('skill_deprecated', 'skill_merged') GROUP BY ALL""")
def _(d):
    path = work_dir(d.spark, "t4")
    documents = exchange.search_documents(d.skills(), d.aliases())
    jobs.load_search_documents(documents.limit(0), path)
    jobs.finish(jobs.stream_search_documents(_over(d, _events(d, 3)).changelog(), lambda: documents, path))
    return jobs.read_search_documents(d.spark, path).withColumn("aliases", F.array_join("aliases", ","))


@query("t5_stream_reanalysis", """
WITH act AS (SELECT id AS skill_id, lower(canonical_name) AS form FROM fx_skills WHERE status = 'candidate'),
r AS (SELECT skill_id, log_id, row_number() OVER (PARTITION BY skill_id ORDER BY created_at DESC, log_id) AS rank
  FROM act JOIN fx_logs ON normalized_form = form)
SELECT skill_id, log_id, rank FROM r WHERE rank <= 100""")
def _(d):
    path = work_dir(d.spark, "t5")
    act = d.skills().filter("status = 'candidate'").select(
        F.col("id").alias("skill_id"), F.lower("canonical_name").alias("normalized_name"))
    jobs.finish(jobs.stream_reanalysis(_spread(d, act, 2), d.logs(), path, 100))
    return jobs.output(d.spark, path).select("skill_id", "log_id", "rank")


@query("t6_stream_changelog", "SELECT graph_version, mutation_type, entity_id FROM fx_changelog WHERE graph_version > 100")
def _(d):
    path = work_dir(d.spark, "t6")
    _in_turn(d, lambda s: jobs.to_batches(jobs.stream_changelog(s.changelog(), 100), path, lambda b: b))
    return jobs.output(d.spark, path).select("graph_version", "mutation_type", "entity_id")


@query("t7_dead_letter", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'ok' END AS outcome,
  CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS attempts FROM events""")
def _(d):
    path = work_dir(d.spark, "t7")
    handler = lambda rows: rows.withColumn("ok", F.col("event_type") != "error")
    query = jobs.with_dead_letter(_events(d, 3), path, handler)
    jobs.finish(query)
    jobs.drain(d.spark, path, handler, query.lastProgress["batchId"])
    ok, dead = (jobs.output(d.spark, path, n).select("event_id", F.lit(n).alias("outcome"), "attempts")
                for n in ("ok", "dead"))
    return ok.unionByName(dead)


@query("t8_dedupe_stream", "SELECT event_id, event_type FROM events")
def _(d):
    path = work_dir(d.spark, "t8")
    ev = d.raw("events")
    folder = work_dir(d.spark, "arrivals")
    ev.unionByName(ev).write.parquet(folder)
    arriving = jobs.file_stream(d.spark, folder, ev.schema).withColumn("ts_us", micros("ts"))
    once = jobs.dedupe_stream(jobs.event_time(arriving), "event_id", within="60 days")
    jobs.finish(jobs.to_batches(once, path, lambda b: b))
    return jobs.output(d.spark, path).select("event_id", "event_type")


@query("t9_stale_ids", """
SELECT DISTINCT entity_id AS id FROM fx_changelog UNION SELECT source_id FROM fx_merge_map
UNION SELECT target_id FROM fx_merge_map""")
def _(d):
    merges = d.merge_map().select(
        F.lit("skill").alias("entity_type"), F.col("source_id").alias("entity_id"),
        F.to_json(F.struct(F.col("target_id").alias("survivor"))).alias("diff_payload"))
    return jobs.stale_ids(d.changelog().select(*merges.columns).unionByName(merges))


@query("t10_stream_rates", """
WITH w AS (SELECT key, (ts_us // 3600000000 - i) * 3600000000 AS start_us FROM fx_log,
  (SELECT unnest(generate_series(0, 5)) AS i))
SELECT key, start_us::BIGINT AS start_us, count(*) AS calls FROM w GROUP BY 1, 2 HAVING count(*) > 3""")
def _(d):
    path = work_dir(d.spark, "t10")
    _in_turn(d, lambda s: jobs.stream_rates(s.log(), path, 3, "6 hours", "1 hour", "6 hours"))
    return jobs.read_latest(d.spark, path, ["key", "start_us"], "calls")


@query("t10_stream_rate_classes", """
WITH c AS (SELECT *, CASE WHEN task IN ('view', 'click') THEN 'read' WHEN task = 'purchase' THEN 'mutate' ELSE 'extract' END AS request_class
  FROM fx_log),
w AS (SELECT key, request_class, (ts_us // 3600000000 - i) * 3600000000 AS start_us FROM c, (SELECT unnest(generate_series(0, 5)) AS i))
SELECT key, request_class, start_us::BIGINT AS start_us, count(*) AS calls FROM w GROUP BY ALL
HAVING count(*) > CASE request_class WHEN 'read' THEN 3 WHEN 'mutate' THEN 2 ELSE 1 END""")
def _(d):
    path = work_dir(d.spark, "t10c")
    _in_turn(d, lambda s: jobs.stream_rates(classed(s.log()), path, RATES, "6 hours", "1 hour", "6 hours"))
    return jobs.read_latest(d.spark, path, ["key", "request_class", "start_us"], "calls")


@query("t11_stream_velocity", """
SELECT normalized_form, strftime(ts, '%Y-%m-%d') AS day, count(*) AS mentions FROM fx_signals GROUP BY 1, 2""")
def _(d):
    path = work_dir(d.spark, "t11")
    _in_turn(d, lambda s: jobs.stream_velocity(s.signals(), path))
    return jobs.read_latest(d.spark, path, ["normalized_form", "day"], "mentions")
