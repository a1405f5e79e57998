"""Streaming jobs. Each shares its transform with a batch operator.

Every micro-batch writes to a folder of its own number and overwrites it, so a batch that is run again after a
failure leaves no double rows. Watermarks and late-data rules are ours: rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigraph import config
from lexigraph.operators import cooccur, extract, joins, metrics

Batch = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Rows of parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start(stream: DataFrame, path: str, work: Callable[[DataFrame, int], None], once: bool = True,
          every: str = "1 second", mode: str = "append") -> StreamingQuery:
    """Run ``work(batch, number)`` on every micro-batch: all that is there now, or on and on."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_progress").foreachBatch(work)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def finish(query: StreamingQuery, seconds: int = 300) -> None:
    """Wait for a run over the present data to end."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not end in time")


def save(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def to_batches(stream: DataFrame, path: str, transform: Batch, once: bool = True, mode: str = "append") -> StreamingQuery:
    return start(stream, path, lambda batch, n: save(transform(batch), f"{path}/out", n), once, mode=mode)


def output(spark: SparkSession, path: str, name: str = "out") -> DataFrame:
    """All rows written so far, with the number of their batch."""
    return spark.read.parquet(f"{path}/{name}")


def stream_extract(docs: DataFrame, forms: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """Concepts of arriving documents; a document arrives whole, so a batch can merge its results."""
    def work(batch: DataFrame) -> DataFrame:
        sections = extract.whole_sections(extract.detect_sections(extract.clean_documents(batch)))
        tags = extract.tag_exact(sections, forms, carry=("section_weight",), parts=extract.text_parts(batch))
        return extract.merge_results(extract.apply_weighting(extract.extract(tags)))

    return to_batches(docs, path, work, once)


CELL = "normalized_form string, b bigint, n bigint, first bigint, last bigint, event_time timestamp"


def _cells(frame: pd.DataFrame) -> pd.DataFrame:
    g = frame.groupby(["normalized_form", "b"], sort=False)
    return g.agg(n=("n", "sum"), first=("first", "min"), last=("last", "max")).reset_index()


def stream_signals(signals: DataFrame, path: str, threshold: int = config.SIGNAL_THRESHOLD,
                   gap_us: int = config.SIGNAL_GAP_DAYS * 86_400_000_000, late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Counter per form that triggers at the threshold, starts again, and is forgotten after a gap.

    Signals are summed per time bucket before the shuffle, so the state function of a frequent form receives a
    few sums, not its signals. A form's state goes once the watermark is a gap past its last signal: what still may come
    would start it again anyway, so a replay of old files gives the same triggers as the run of the time.
    """
    rows = signals.select("normalized_form", F.floor(F.col("ts_us") / F.lit(gap_us)).cast("bigint").alias("b"),
                          F.lit(1).cast("bigint").alias("n"), F.col("ts_us").alias("first"), F.col("ts_us").alias("last"))

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = _cells(frame)
            cells["event_time"] = pd.to_datetime(cells["last"], unit="us", utc=True)
            yield cells

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, None)
        fired = 0
        cells = _cells(pd.concat(list(frames))).sort_values("b")
        for cell in cells.itertuples():
            if last is not None and cell.first - last > gap_us:
                n = 0
            fired += (n + int(cell.n)) // threshold
            n = (n + int(cell.n)) % threshold
            last = int(cell.last) if last is None else max(last, int(cell.last))
        state.update((n, last))
        state.setTimeoutTimestamp(max((last + gap_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        if fired:
            yield pd.DataFrame({"normalized_form": [key[0]], "triggers": [fired], "last_us": [last]})

    fired = (rows.mapInPandas(combine, CELL).withWatermark("event_time", late).groupBy("normalized_form").applyInPandasWithState(
        count, "normalized_form string, triggers bigint, last_us bigint", "n bigint, last bigint", "append",
        GroupStateTimeout.EventTimeTimeout))
    return to_batches(fired, path, lambda b: b, once)


def stream_cooccurrence(docs: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """Counts of arriving documents (doc_id, skill_ids, source_type, ts), summed per batch.

    A batch stores only its own counts; ``read_cooccurrence`` adds them up, so no batch rewrites the table.
    """
    def work(batch: DataFrame) -> DataFrame:
        rows = batch.select("doc_id", "source_type", "ts", F.explode("skill_ids").alias("skill_id"))
        return cooccur.cooccurrence(cooccur.document_pairs(rows))

    return to_batches(docs, path, work, once)


def read_cooccurrence(spark: SparkSession, path: str) -> DataFrame:
    parts = output(spark, path).select("skill_a_id", "skill_b_id", "last_seen_at", "created_at",
                                       F.explode("source_type_counts").alias("source_type", "n"))
    by_source = parts.groupBy("skill_a_id", "skill_b_id", "source_type").agg(
        F.sum("n").alias("n"), F.max("last_seen_at").alias("last"), F.min("created_at").alias("first"))
    return by_source.groupBy("skill_a_id", "skill_b_id").agg(
        F.sum("n").alias("co_occurrence_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_type_counts"),
        F.max("last").alias("last_seen_at"), F.min("first").alias("created_at"))


def sync_ops(cdc: DataFrame) -> DataFrame:
    """The last change per concept as an operation on the search documents."""
    last = cdc.groupBy("entity_id").agg(F.max("graph_version").alias("graph_version"),
                                        F.max_by("mutation_type", "graph_version").alias("mutation_type"))
    gone = F.col("mutation_type").isin("skill_deprecated", "skill_merged")
    return last.withColumn("op", F.when(gone, "delete").otherwise("upsert"))


def stream_search_sync(cdc: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """T4: one operation per concept and batch."""
    return to_batches(cdc, path, sync_ops, once)


def read_sync(spark: SparkSession, path: str) -> DataFrame:
    return sync_ops(output(spark, path))


def _published(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(bucket, version, rows): which batch wrote each bucket last, as of batch ``number``."""
    return spark.read.schema("bucket int, version int, rows bigint").parquet(f"{path}/index/batch={number}")


def _stored_documents(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Rows of the bucket versions in ``index`` (at most one row a bucket comes to the driver, to name the folders)."""
    schema = spark.read.parquet(f"{path}/layout").schema
    found = [f"{path}/docs/batch={r.version}/bucket={r.bucket}" for r in index.filter("rows > 0").collect()]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/docs").parquet(*found).select(*schema.names)


def _publish(rows: DataFrame, touched: DataFrame, before: DataFrame | None, path: str, number: int) -> None:
    """Write the touched buckets whole; the index comes last and makes the batch valid."""
    spark, folder = rows.sparkSession, f"{path}/docs/batch={number}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    sizes = spark.read.schema(rows.schema).parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    index = touched.select("bucket", F.lit(number).alias("version")).join(sizes, "bucket", "left").fillna(0, ["rows"])
    if before is not None:
        index = index.unionByName(before.join(touched, "bucket", "left_anti"))
    save(index.coalesce(1), f"{path}/index", number)


def load_search_documents(documents: DataFrame, path: str, version: int = 0, buckets: int = config.SEARCH_BUCKETS) -> None:
    """First load of the search documents (S8) as of a graph version, dealt to buckets by a hash of the id.

    Choose ``buckets`` so that one holds about a file's worth of documents; it stays fixed for the life of the sink.
    """
    rows = documents.withColumns({"graph_version": F.lit(version).cast("bigint"), "deleted": F.lit(False), "bucket": _bucket(buckets)})
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/layout")
    _publish(rows, documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")), None, path, -1)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def apply_search_changes(batch: DataFrame, number: int, documents: Callable[[], DataFrame], path: str) -> None:
    """Bring the buckets that a batch of changes touches up to date; all others keep their files.

    An operation counts if it is newer than what the sink holds of its concept, so late ones change nothing. Concepts
    that were deleted, or have no document any more, stay as tombstones with their version. A batch reads only what the
    one before it published, so it may run again after a failure.
    """
    spark = batch.sparkSession
    save(sync_ops(batch), f"{path}/ops", number)
    ops = spark.read.schema("entity_id string, graph_version bigint, mutation_type string, op string").parquet(
        f"{path}/ops/batch={number}").select(F.col("entity_id").alias("id"), "graph_version", "op")
    before = _published(spark, path, number - 1)
    buckets = before.count()
    touched = ops.select(_bucket(buckets).alias("bucket")).distinct()
    held = _stored_documents(spark, path, before.join(touched, "bucket", "left_semi"))
    known = held.groupBy("id").agg(F.max("graph_version").alias("__held"))
    applied = ops.join(known, "id", "left").filter("__held is null or graph_version > __held").drop("__held")
    now = documents().withColumns({"op": F.lit("upsert"), "__live": F.lit(True)})
    fresh = applied.join(now, ["id", "op"], "left").withColumns(
        {"deleted": F.col("__live").isNull(), "bucket": _bucket(buckets)}).select(*held.columns)
    _publish(held.join(applied.select("id"), "id", "left_anti").unionByName(fresh), touched, before, path, number)


def stream_search_documents(cdc: DataFrame, documents: Callable[[], DataFrame], path: str, once: bool = True) -> StreamingQuery:
    """T4: keeps the search documents of ``load_search_documents`` in step with the changelog.

    ``documents`` gives the search documents of the tables as they are now; it is asked once per batch and joined with
    the batch's concepts.
    """
    return start(cdc, path, lambda batch, n: apply_search_changes(batch, n, documents, path), once)


def read_search_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents after the last batch: one version of each bucket, whatever the number of batches."""
    last = spark.read.parquet(f"{path}/index").agg(F.max("batch")).first()[0]
    return _stored_documents(spark, path, _published(spark, path, last)).filter("not deleted").drop("graph_version", "deleted", "bucket")


def stream_reanalysis(activations: DataFrame, logs: DataFrame, path: str, newest: int = config.REANALYSIS_MAX_DOCUMENTS,
                      once: bool = True) -> StreamingQuery:
    """T5: documents to extract again for every activated concept."""
    return to_batches(activations, path, lambda b: joins.reanalysis_docs(b, logs, newest), once)


def stream_changelog(log: DataFrame, version: int) -> DataFrame:
    """Changes after a version."""
    return log.filter(F.col("graph_version") > version)


def with_dead_letter(stream: DataFrame, path: str, handler: Batch, attempts: int = config.MAX_ATTEMPTS,
                     once: bool = True) -> StreamingQuery:
    """Rows the handler marks ``ok = false`` come again with the next batch; after ``attempts`` they are dead.

    Outputs: ok, retry (still open, by batch) and dead. ``drain`` works off what is still open.
    """
    def work(batch: DataFrame, number: int) -> None:
        attempt(batch.withColumn("attempts", F.lit(0)), path, number, handler, attempts)

    return start(stream, path, work, once)


def attempt(new: DataFrame, path: str, number: int, handler: Batch, attempts: int) -> None:
    rows = new
    if number > 0:
        again = new.sparkSession.read.schema(new.schema).parquet(f"{path}/retry/batch={number - 1}")
        rows = new.unionByName(again)
    # Handled once: the three outputs must agree even if the handler is not repeatable.
    save(handler(rows).withColumn("attempts", F.col("attempts") + 1), f"{path}/tried", number)
    tried = new.sparkSession.read.parquet(f"{path}/tried/batch={number}")
    bad = tried.filter("not ok").drop("ok")
    save(tried.filter("ok").drop("ok"), f"{path}/ok", number)
    save(bad.filter(F.col("attempts") < attempts), f"{path}/retry", number)
    save(bad.filter(F.col("attempts") >= attempts), f"{path}/dead", number)


def drain(spark: SparkSession, path: str, handler: Batch, last: int, attempts: int = config.MAX_ATTEMPTS) -> None:
    """Try the open rows after batch ``last`` until all are done or dead."""
    for number in range(last + 1, last + 1 + attempts):
        empty = spark.read.parquet(f"{path}/retry/batch={number - 1}").limit(0)
        attempt(empty, path, number, handler, attempts)


def event_time(stream: DataFrame) -> DataFrame:
    """Event time of rows that carry microseconds since 1970 (watermarks need a zoned timestamp)."""
    return stream.withColumn("event_time", F.timestamp_micros("ts_us"))


def dedupe_stream(stream: DataFrame, key: str, ts: str = "event_time", within: str = "1 day") -> DataFrame:
    """The first delivery of each key; repeats within the watermark are dropped."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def stale_ids(cdc: DataFrame) -> DataFrame:
    """Concepts whose cached view is out of date; a merge names source and survivor."""
    other = F.get_json_object("diff_payload", "$.survivor")
    ids = F.filter(F.array(F.col("entity_id"), other), lambda x: x.isNotNull())
    return cdc.filter("entity_type = 'skill'").select(F.explode(ids).alias("id")).distinct()


def stream_rates(log: DataFrame, path: str, limit: int | dict[str, int] | None = None, window: str = "1 minute",
                 slide: str = "10 seconds", late: str = "1 minute", once: bool = True) -> StreamingQuery:
    """Sliding windows in which a key is over the limit, by request class if limits go by class (counted before the shuffle)."""
    keys = ["key"] if isinstance(limit, int) else ["key", "request_class"]
    counted = event_time(log).withWatermark("event_time", late).groupBy(
        *keys, F.window("event_time", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("calls"))
    return to_batches(counted.select(*keys, F.unix_micros("w.start").alias("start_us"), "calls"), path,
                      lambda b: b.filter(metrics.over_limit(limit)), once, mode="update")


def read_latest(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The value each key had in the last batch that updated it."""
    return output(spark, path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def stream_velocity(signals: DataFrame, path: str, late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Mentions per form and day."""
    counted = event_time(signals).withWatermark("event_time", late).groupBy(
        "normalized_form", F.window("event_time", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("mentions"))
    day = F.expr("cast(date_add(date'1970-01-01', cast(unix_micros(w.start) div 86400000000 as int)) as string)")
    return to_batches(counted.select("normalized_form", day.alias("day"), "mentions"), path, lambda b: b, once, mode="update")
