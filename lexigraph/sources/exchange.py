"""Exchange with outside services through tables: search documents, requests, responses, caches, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import let, preview
from lexigraph.plans.scale import broadcast_if_small, nest_pages
from lexigraph.schemas import RESPONSE


def search_documents(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Active concepts with their aliases, for a search service (large alias lists come on pages)."""
    forms = nest_pages(aliases.select("skill_id", "surface_form").distinct(), ["skill_id"], F.col("surface_form"),
                       "aliases").withColumnRenamed("skill_id", "id")
    return (skills.filter("status = 'active'")
            .select("id", "external_id", "canonical_name", "slug", "description", "category", "status")
            .join(forms, "id", "left").withColumn("page", F.coalesce("page", F.lit(0))))


def build_requests(chunks: DataFrame, candidates: DataFrame, limit: int = config.CANDIDATE_LIMIT) -> DataFrame:
    """One prompt row per chunk: its numbered candidates (at most ``limit``, best first), then the text."""
    listed = candidates.filter(F.col("rank") <= limit).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.concat(F.lit("["), "external_id", F.lit("] "), "canonical_name").alias("line")))).alias("c"))
    lines = F.array_join(F.transform("c", lambda x: x["line"]), "\n")
    return chunks.join(listed, "chunk_id", "left").select(
        "chunk_id", F.concat_ws("\n\n", lines, "text").alias("prompt")).withColumn(
        "request", F.to_json(F.struct("chunk_id", "prompt")))


def ingest_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model answers (chunk_id, body) as rows per concept; answers that break the schema are set aside."""
    body = F.from_json("body", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    needed = ("skill_id", "skill_name", "confidence", "evidence", "proficiency_hint", "context_type")

    def whole(x: Column) -> Column:
        ok = x[needed[0]].isNotNull()
        for name in needed[1:]:
            ok = ok & x[name].isNotNull()
        return ok & x["confidence"].between(0.0, 1.0)

    def judge(r: Column) -> Column:
        reason = (F.when(r["_corrupt"].isNotNull() | r.isNull(), "malformed")
                  .when(r["extracted_skills"].isNull(), "no result list")
                  .when(~F.forall(r["extracted_skills"], whole), "missing or bad field"))
        return F.struct(reason.alias("reason"), r["extracted_skills"].alias("skills"))

    # Each answer is parsed once: the list travels with its verdict and empty lists are dropped after the explode.
    judged = raw.select("chunk_id", let(body, judge).alias("j"))
    ok = judged.select("chunk_id", F.explode_outer(F.when(F.col("j.reason").isNull(), F.col("j.skills"))).alias("s"))
    bad = judged.select("chunk_id", F.col("j.reason").alias("reason")).filter("reason is not null")
    return ok.filter("s is not null").select("chunk_id", "s.*"), bad


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def result_key(text: Column, candidate_ids: Column) -> Column:
    """Cache key of a chunk and its candidate list, whatever the order of the list."""
    return F.sha2(F.concat(text, F.array_join(F.array_sort(candidate_ids), ",")), 256)


def split_cached(chunks: DataFrame, cache: DataFrame, now: Column,
                 days: int = config.RESULT_CACHE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Chunks with a valid cached result and those without; ``cache(key, created_at, ...)``, keys unique."""
    valid = cache.filter(F.col("created_at") > now - F.expr(f"interval {days} days"))
    keyed = chunks.withColumn("key", result_key(F.col("text"), F.col("candidate_ids")))
    # A cache of checked size goes to the chunks, so that their texts stay where they are.
    return (keyed.join(broadcast_if_small(valid.drop("created_at")), "key"),
            keyed.join(broadcast_if_small(valid.select("key")), "key", "left_anti"))


def extraction_log(results: DataFrame) -> DataFrame:
    """Log rows of documents with unknown candidates: hash, preview and candidates."""
    return results.filter(F.size("discovered_candidates") > 0).select(
        F.sha2("text", 256).alias("document_hash"), "source_type", preview(F.col("text")).alias("input_text_preview"),
        "discovered_candidates", "extracted_skill_ids", "created_at")


def backfill_embeddings(df: DataFrame, cache: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]],
                        batch: int = config.EMBEDDING_BATCH_SIZE, now: Column | None = None,
                        days: int = config.EMBEDDING_CACHE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Fill missing vectors of ``df(id, text, embedding)`` from the cache or the outside function.

    Each distinct text is embedded once, in batches; returns the filled table and the new cache rows (key,
    embedding). Store the new rows before reusing both outputs, else the function runs for each of them. A NULL text
    keeps its NULL vector. Cached vectors older than ``days`` count as absent, if the cache has ``created_at``. Only the ids of
    rows without a vector meet the cache; their texts travel once, to be embedded.
    """
    if "created_at" in cache.columns and now is not None:
        cache = cache.filter(F.col("created_at") > now - F.expr(f"interval {days} days"))
    keyed = df.withColumn("key", text_key(F.col("text")))
    missing = keyed.filter("embedding is null and text is not null").groupBy("key").agg(F.min("text").alias("text"))
    todo = missing.join(cache.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": embed_fn(part["text"].tolist())})

    fresh = todo.mapInPandas(run, "key string, embedding array<float>")
    known = cache.select("key", "embedding").unionByName(fresh)
    asking = keyed.filter("embedding is null and text is not null").select("id", "key").distinct()
    given = asking.join(known, "key").select("id", "key", F.col("embedding").alias("__e"))
    filled = keyed.join(broadcast_if_small(given), ["id", "key"], "left").withColumn("embedding", F.coalesce("embedding", "__e")).select(*df.columns)
    return filled, fresh
