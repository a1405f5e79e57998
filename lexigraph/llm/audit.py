"""Which filter takes which documents, in every order of the filters: an audit by incremental retraction streaming.

All files of a table go through a stream as available-now micro-batches. Four filters look at a text alone; the fifth asks
whether the same text stands under a smaller id anywhere, which a later file may still answer. Each text (its digest) is a
key of the stream's state, which holds the smallest id seen so far and the parts of its rows (texts are kept by buckets of
about ``TEXTS``, one state value each, so that a call of the state function serves many). A document is counted under its
mask (the filters it fails) as it arrives; when a smaller id of its text comes, the mask it was counted under is retracted and
the one that fails the fifth filter too counted instead. The sums of all changes are the counters; the orders are worked out
on counters alone (a part's 32 masks), never on documents.

Copies are summed per task before they travel to their key, so a text that very many rows share sends a few sums. State takes
about 80 bytes a text and lies in the session's state store (RocksDB where ``spark.sql.streaming.stateStore.providerClass``
names it: to be set where the state of all texts outgrows the executors' memory), its changes under the checkpoint folder; batches write their changes to folders of their number, so one that is
repeated after a loss counts once. The files are dealt to at most ``BATCHES`` micro-batches whatever their number, so labels,
which each batch joins by id, are read that often.

Defined results: a null text is empty, a null part the empty string. A row with a null id is smaller and larger than none: it
never fails E and makes no other row fail it. Rows that repeat an id and a text are none smaller than the other. Rows of
``labels`` that repeat an id count as one with the larger values. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_uppercase

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigraph.functions.text import let
from lexigraph.plans.scale import work_dir

FILTERS = "ABCDE"
BATCHES = 4
TEXTS = 1024  # rows of the table per bucket of texts
MASK_E = 16
WHO = ["part", "mask", "quality", "toxic", "n"]
HELD = ["digest", "best", *WHO]
CHANGES = "part string, mask int, quality int, toxic int, n long"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = let(words, lambda w: (F.size(w) < 50).cast("int") + F.when(100 * F.size(F.array_distinct(w)).cast("long") < 65 * F.size(w).cast("long"), 2).otherwise(0))
    upper = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    tests = [100 * upper.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((F.when(t, 4 << k).otherwise(0) for k, t in enumerate(tests)), few).cast("int")


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text, part and labels as one: how many, the smallest id, and how many have it."""
    keys = ["digest", "mask", "part", "quality", "toxic"]
    for f in frames:
        if len(f):
            f["many"] = f["doc_id"] == f.groupby(keys)["doc_id"].transform("min")
            yield f.groupby(keys, sort=False).agg(first=("doc_id", "min"), n=("n", "sum"), firsts=("many", "sum")).reset_index()


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by new rows of the texts of one bucket. State: the rows with each text's smallest id."""
    new = pd.concat(list(frames), ignore_index=True)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0].assign(best=new["first"].iloc[:0])[HELD]
    least = new.groupby("digest")["first"].min()
    before = held["digest"].map(least)  # the smallest new id of the same text, if there is one
    gone = (before < held["best"]).fillna(False).astype(bool)  # counted as first so far
    best = least.combine(held.groupby("digest")["best"].min().reindex(least.index), lambda x, y: x if y != y or x < y else y).astype(new["first"].dtype)
    now = new.assign(best=new["digest"].map(best))
    now["firsts"] = now["firsts"].where(now["first"] == now["best"], 0)
    old = held[gone]
    # Each row: its mask, and the same with E failed.
    yield pd.concat([old.assign(n=-old["n"])[WHO], old.assign(mask=old["mask"] | MASK_E)[WHO], now.assign(n=now["firsts"])[WHO],
                     now.assign(mask=now["mask"] | MASK_E, n=now["n"] - now["firsts"])[WHO]]).groupby(WHO[:-1], sort=False, as_index=False)["n"].sum()
    first = now[now["firsts"] > 0]
    kept = pd.concat([held[~gone], first.assign(n=first["firsts"])[HELD]]).groupby(HELD[:-1], sort=False, as_index=False)["n"].sum()
    table = pa.Table.from_pandas(kept, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("int").alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(flag("quality"), flag("toxic"))
    return (rows.join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")}))


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, part: str = "source") -> DataFrame:
    """``part, mask, quality, toxic, n``: documents of the Parquet files at ``path`` under each mask (bit k: filter k fails)."""
    whole = spark.read.parquet(path)
    light = lambda df: df.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"),
                                 F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    files = spark.read.format("binaryFile").load(path).inputFiles()  # a listing; that of a cached table would be empty
    # Spark streams folders and patterns: a table that is a single file is named by a pattern that only it matches.
    place = f"{path[:-1]}[{path[-1]}]" if len(files) == 1 and files[0].endswith(path.rsplit("/", 1)[-1]) else path
    stream = (spark.readStream.schema(whole.select("doc_id", "text", part).schema)
              .option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(place))
    rows = _labelled(light(stream.filter("doc_id is not null")), labels).select("digest", "mask", "part", "quality", "toxic", "doc_id", F.lit(1).cast("long").alias("n"))
    summed = rows.mapInPandas(_combine, "digest binary, mask int, part string, quality int, toxic int, first long, n long, firsts long")
    buckets = max(64, -(-whole.count() // TEXTS))
    changes = (summed.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))).groupBy("bucket")
               .applyInPandasWithState(_retract, CHANGES, "held binary", "update", GroupStateTimeout.NoTimeout))
    folder = work_dir(spark, "audit")
    total = lambda df: df.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        total(batch).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    conf = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = (changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(save)
                 .trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    unknown = _labelled(light(whole.filter("doc_id is null")), labels).select("part", "mask", "quality", "toxic", F.lit(1).cast("long").alias("n"))
    seen = spark.read.schema(CHANGES).parquet(f"{folder}/changes").select(*unknown.columns) if query.lastProgress else spark.createDataFrame([], CHANGES)
    return total(seen.unionByName(unknown)).filter("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """The report on counters: a row per part, order of the filters (``filter_order``) and step."""
    cells = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))  # 32 at most
    steps = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])).alias("filter_order")
    rows = parts.select("part", "cells", steps).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda k: F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {k}, 1)) - 1)")
    rows = rows.withColumns({"own": bit("step"), "earlier": sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))})

    def over(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))

    earlier, own = F.col("earlier"), F.col("own")
    here = lambda m: (m.bitwiseAND(earlier) == 0) & (m.bitwiseAND(own) != 0)
    # Of the 120 orders a document that fails f filters meets each of them first in 120 / f.
    share = lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        over(lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"), over(here).alias("removed"),
        over(lambda m: (m.bitwiseAND(earlier) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        over(lambda m: m == own).alias("unique_fails"), over(here, lambda c: c["good"]).alias("good_lost"),
        over(here, lambda c: c["bad"]).alias("toxic_lost"), over(lambda m: m.bitwiseAND(own) != 0, share).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    return interactions(counters(spark, path, labels, batches))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), m AS (
  SELECT doc_id, part,
         {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), d AS (
  SELECT part, fails.A::INT AS a, fails.B::INT AS b, fails.C::INT AS c, fails.D::INT AS d, fails.E::INT AS e,
         count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), rows AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, part, n, good, bad,
         (CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END || CASE WHEN c = 1 THEN 'C' ELSE '' END
          || CASE WHEN d = 1 THEN 'D' ELSE '' END || CASE WHEN e = 1 THEN 'E' ELSE '' END) AS failed,
         least(CASE WHEN a = 1 THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN b = 1 THEN strpos(filter_order, 'B') ELSE 9 END,
               CASE WHEN c = 1 THEN strpos(filter_order, 'C') ELSE 9 END, CASE WHEN d = 1 THEN strpos(filter_order, 'D') ELSE 9 END,
               CASE WHEN e = 1 THEN strpos(filter_order, 'E') ELSE 9 END) AS gone
  FROM steps, d
), report AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone < step AND contains(failed, own)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM rows GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM report
"""
