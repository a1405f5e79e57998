"""Co-occurrence of concepts in documents and the edges it supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.plans.scale import pick_first, self_pairs


def document_pairs(results: DataFrame) -> DataFrame:
    """Unique unordered concept pairs per document (doc_id, skill_a_id, skill_b_id, source_type, ts).

    ``source_type`` and ``ts`` describe the document, so they are the same in all its rows.
    """
    once = results.select("doc_id", "source_type", "ts", "skill_id").distinct()
    pairs = self_pairs(once, ["doc_id", "source_type", "ts"], "skill_id")
    return pairs.withColumnsRenamed({"a": "skill_a_id", "b": "skill_b_id"})


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """A1: count, count per source type and first and last sighting of each pair."""
    by_source = pairs.groupBy("skill_a_id", "skill_b_id", "source_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    return by_source.groupBy("skill_a_id", "skill_b_id").agg(
        F.sum("n").alias("co_occurrence_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_type_counts"),
        F.max("last").alias("last_seen_at"), F.min("first").alias("created_at"))


def add_counts(a: Column, b: Column) -> Column:
    """Key-wise sum of two count maps; either may be NULL."""
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<bigint>))")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty),
                          lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge_cooccurrence(old: DataFrame, delta: DataFrame) -> DataFrame:
    """A2: add a batch of counts to the stored ones. Pair keys are unique on both sides."""
    keys = ["skill_a_id", "skill_b_id"]
    d = delta.withColumnsRenamed({c: f"d_{c}" for c in delta.columns if c not in keys})
    both = old.join(d, keys, "full_outer")
    return both.select(
        *keys,
        (F.coalesce("co_occurrence_count", F.lit(0)) + F.coalesce("d_co_occurrence_count", F.lit(0)))
        .alias("co_occurrence_count"),
        add_counts(F.col("source_type_counts"), F.col("d_source_type_counts")).alias("source_type_counts"),
        F.greatest("last_seen_at", "d_last_seen_at").alias("last_seen_at"),
        F.least("created_at", "d_created_at").alias("created_at"))


def match_pairs(pairs: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("related_to",)) -> DataFrame:
    """Active edges between the two concepts of a pair, in either direction."""
    keyed = (edges.filter(F.col("relationship_type").isin(*types) & (F.col("status") == "active"))
             .withColumn("skill_a_id", F.least("source_skill_id", "target_skill_id"))
             .withColumn("skill_b_id", F.greatest("source_skill_id", "target_skill_id")))
    return pairs.join(keyed, ["skill_a_id", "skill_b_id"])


def strengthen(cooc: DataFrame, edges: DataFrame, threshold: int = config.COOCCURRENCE_EDGE_THRESHOLD,
               norm: int = config.COOCCURRENCE_NORMALIZATION, base: str = "weight",
               types: tuple[str, ...] = ("related_to",)) -> DataFrame:
    """M8: one edge row per pair at or above the threshold.

    An existing active edge gains count / norm on top of ``base`` ("weight", or "confidence" for runs
    that may be repeated); a pair without one becomes a new empirical edge. Weights stay within 1.
    """
    pairs = cooc.filter(F.col("co_occurrence_count") >= threshold).select(
        "skill_a_id", "skill_b_id", "co_occurrence_count")
    found = pick_first(match_pairs(pairs, edges, types), ["skill_a_id", "skill_b_id"],
                       [F.col("confidence").desc(), F.col("id")])
    gain = F.col("co_occurrence_count") / F.lit(float(norm))
    raised = found.select("skill_a_id", "skill_b_id", "id", "source_skill_id", "target_skill_id",
                          "relationship_type", "confidence", "provenance", F.col(base).alias("__base"))
    both = pairs.join(raised, ["skill_a_id", "skill_b_id"], "left")
    weight = F.least(F.lit(1.0), F.coalesce("__base", F.lit(0.0)) + gain)
    return both.select(
        F.coalesce("id", F.concat_ws("|", F.lit("related_to"), "skill_a_id", "skill_b_id")).alias("id"),
        F.coalesce("source_skill_id", "skill_a_id").alias("source_skill_id"),
        F.coalesce("target_skill_id", "skill_b_id").alias("target_skill_id"),
        F.coalesce("relationship_type", F.lit("related_to")).alias("relationship_type"),
        F.coalesce("confidence", weight).alias("confidence"), weight.alias("weight"),
        F.coalesce("provenance", F.lit("empirical")).alias("provenance"),
        F.when(F.col("id").isNull(), "edge_created").otherwise("edge_updated").alias("mutation_type"),
        "co_occurrence_count")


def split_near_duplicates(cooc: DataFrame, skills: DataFrame, threshold: int, similar: float
                          = config.DUPLICATE_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """M8: pairs above the threshold whose vectors are near-duplicates go to a merge review instead."""
    from lexigraph.functions.vectors import cosine

    vec = skills.filter("embedding is not null").select("id", "embedding")
    pairs = (cooc.filter(F.col("co_occurrence_count") >= threshold)
             .join(vec.selectExpr("id as skill_a_id", "embedding as __va"), "skill_a_id", "left")
             .join(vec.selectExpr("id as skill_b_id", "embedding as __vb"), "skill_b_id", "left")
             .withColumn("similarity", F.round(cosine(F.col("__va"), F.col("__vb")), 6)).drop("__va", "__vb"))
    near = F.coalesce(F.col("similarity") >= similar, F.lit(False))
    return pairs.filter(~near), pairs.filter(near)
