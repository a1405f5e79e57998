"""Helpers that keep plans safe on large or skewed inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph import config


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder the session names.

    Only a local master may fall back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(spark, "checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for loops.

    A checkpoint ends the lineage but keeps the optimizer's estimate of the rows' size. A join's estimate is the product of both sides', so in a
    loop of joins its digits double with every round, until planning takes minutes. A table's size is that of its files.
    """
    path = work_dir(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int = config.BROADCAST_MAX_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows (reads no further than one row beyond)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast behind a size check; otherwise leave the join to shuffle (AQE splits skew)."""
    return F.broadcast(df) if fits(df, max_rows) else df


def join_uneven(df: DataFrame, other: DataFrame, key: str, hot_rows: int = 100_000) -> DataFrame:
    """Inner join with a table of few rows per key; rows of ``df`` whose key is frequent stay where they are.

    ``df`` is read three times, so it should be stored. There are at most rows / ``hot_rows`` frequent keys; their rows of
    ``other`` go to all executors behind a size check. The rest is joined by sort and merge, since ``other`` may be large.
    """
    hot = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select(key))
    if hot.isEmpty():
        return df.join(other.hint("merge"), key)
    few = broadcast_if_small(other.join(F.broadcast(hot), key, "left_semi"))
    return df.join(few, key).unionByName(df.join(F.broadcast(hot), key, "left_anti").join(other.hint("merge"), key))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps ``k`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (a group of any size is cut down before the shuffle)."""
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def nest_pages(df: DataFrame, keys: list[str], item: Column, name: str,
               page_rows: int = config.NEST_PAGE_ROWS) -> DataFrame:
    """Nest items per key as sorted arrays on numbered pages, so that no array grows without bound.

    A key with at most ``page_rows`` items has the single page 0. Larger ones are spread by hash over
    as many pages as their count asks for.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(page_rows))).alias("__pages"))
    paged = (df.join(counts, keys)
             .withColumn("page", F.pmod(F.xxhash64(item), F.col("__pages")).cast("int")))
    return paged.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias(name))


def self_pairs(df: DataFrame, keys: list[str], item: str, hot_items: int = 2_000, cells: int = 16) -> DataFrame:
    """Unordered pairs ``a < b`` of items sharing ``keys``; ``df`` holds each (keys, item) once and nothing else.

    Ordinary groups meet in a self-join; all its inputs are the same columns, so Spark shuffles by key once and
    reuses the exchange. Groups with more than ``hot_items`` items are spread over a grid of cells (both sides
    hashed), so ``cells * cells`` tasks share the work of one large group and each pair meets in exactly one cell.
    """
    sized = (df.select(*keys, item)
             .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    cold, hot = sized.filter(F.col("__n") <= hot_items), sized.filter(F.col("__n") > hot_items)
    pairs = (cold.select(*keys, F.col(item).alias("a"))
             .join(cold.select(*keys, F.col(item).alias("b")), keys).filter("a < b"))
    cell = F.pmod(F.xxhash64(F.col(item)), F.lit(cells)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    left = hot.select(*keys, F.col(item).alias("a"), cell.alias("__l"), spread.alias("__r"))
    right = hot.select(*keys, F.col(item).alias("b"), cell.alias("__r"), spread.alias("__l"))
    gridded = left.join(right, [*keys, "__l", "__r"]).filter("a < b").drop("__l", "__r")
    return pairs.unionByName(gridded)
