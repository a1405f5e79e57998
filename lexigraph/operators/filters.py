"""Selections, lookups, limits and routing labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.plans.scale import broadcast_if_small, top_k


def active(df: DataFrame, with_vector: bool = False) -> DataFrame:
    """F1"""
    kept = df.filter("status = 'active'")
    return kept.filter("embedding is not null") if with_vector else kept


def list_skills(skills: DataFrame, status: str | None = None, category: str | None = None,
                source: str | None = None, limit: int = config.PAGE_LIMIT, offset: int = 0,
                order: tuple[str, ...] = ("canonical_name", "id")) -> DataFrame:
    """one page with the total number of matches."""
    kept = skills
    for name, value in (("status", status), ("category", category), ("source", source)):
        if value is not None:
            kept = kept.filter(F.col(name) == value)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    page = kept.orderBy(*order).offset(offset).limit(min(limit, config.PAGE_LIMIT_MAX))
    return page.withColumn("total", total.scalar())


def lookup(skills: DataFrame, keys: DataFrame) -> DataFrame:
    """concepts by id, external id or slug; three equi-joins instead of an OR."""
    hits = None
    for name in ("id", "external_id", "slug"):
        one = keys.select(F.col("key").alias(name), "key").join(skills.select("id", "external_id", "slug"), name)
        one = one.select("key", "id")
        hits = one if hits is None else hits.unionByName(one)
    return hits.distinct().join(skills, "id")


def list_aliases(aliases: DataFrame, skill_ids: DataFrame | None = None, locale: str | None = None) -> DataFrame:
    """aliases with their position: primary first, then by form."""
    kept = aliases if locale is None else aliases.filter(F.col("locale") == locale)
    if skill_ids is not None:
        kept = kept.join(skill_ids.select(F.col("id").alias("skill_id")), "skill_id", "left_semi")
    return kept.orderBy("skill_id", F.col("is_primary").desc(), "surface_form", "id")


def min_confidence(results: DataFrame, least: float = config.MIN_CONFIDENCE) -> DataFrame:
    """filter that reports how many results the document had before."""
    w = Window.partitionBy("doc_id")
    return results.withColumn("total_before", F.count(F.lit(1)).over(w)).filter(F.col("confidence") >= least)


def top_skills(results: DataFrame, n: int) -> DataFrame:
    """The ``n`` most certain concepts per document."""
    return top_k(results, ["doc_id"], [F.col("confidence").desc(), F.col("skill_id")], n)


def changelog_since(log: DataFrame, version: int, limit: int = config.CHANGELOG_LIMIT) -> DataFrame:
    """F6"""
    return log.filter(F.col("graph_version") > version).orderBy("graph_version").limit(limit)


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def path_descendants(skills: DataFrame, path: str) -> DataFrame:
    """F8: concepts at or below a tree path, with the depth below it."""
    below = (F.col("path") == path) | F.col("path").startswith(path + ".")
    return skills.filter(below).withColumn("depth_below", path_depth(F.col("path")) - F.lit(path.count(".") + 1))


def path_prefixes(skills: DataFrame) -> DataFrame:
    """F8 as a join input: one row per concept and path above or at it."""
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return skills.select("id", "path", F.explode(prefixes).alias("ancestor_path"))


def check_limits(docs: DataFrame, max_chars: int | None = config.MAX_TEXT_LENGTH,
                 max_batch: int | None = config.BATCH_MAX_DOCUMENTS, batch: str = "source") -> DataFrame:
    """documents with the first limit they break (NULL if none); no limit on texts or batches where it is None.

    Only the over-full batches join the documents, so texts are not shuffled for the others' sake.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    reason = F.when(n < 1, "text is empty")
    if max_chars is not None:
        reason = reason.when(n > max_chars, "text is too long")
    if max_batch is None:
        return docs.withColumn("reason", reason)
    full = (docs.groupBy(batch).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_batch)
            .select(batch, F.lit(True).alias("__full")))
    return docs.join(broadcast_if_small(full), batch, "left").withColumn("reason", reason.when(
        F.col("__full"), "batch is too large")).drop("__full")


def name_limits(skills: DataFrame) -> DataFrame:
    """F9 for concepts: over-long names and descriptions."""
    reason = (F.when(F.length("canonical_name") > config.NAME_MAX_LENGTH, "name is too long")
              .when(F.length("description") > config.DESCRIPTION_MAX_LENGTH, "description is too long"))
    return skills.withColumn("reason", reason)


def validate_results(results: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keep results named in their chunk's candidate list; report what was stripped per document."""
    keys = ["doc_id", "chunk_index", "skill_id"]
    listed = candidates.select(*keys).distinct().withColumn("__ok", F.lit(True))
    marked = results.join(listed, keys, "left")
    report = marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("__ok").isNull()).alias("stripped"))
    report = report.withColumn("mostly_invalid", F.col("stripped") / F.col("total") > 0.5)
    return marked.filter("__ok").drop("__ok"), report


def embedding_shortcut(matches: DataFrame, least: float = config.ACCEPT_SIMILARITY) -> DataFrame:
    """near-certain vector matches become results without a model call."""
    return matches.filter(F.col("similarity") > least).withColumn("confidence", F.col("similarity"))


def route(task: Column, language: Column, tokens: Column, doc_type: Column, short: int = 200) -> Column:
    """processing tier of a request."""
    return (F.when(task.isin("duplicate_detection", "semantic_search"), "embedding")
            .when((task == "extraction") & (language != "en"), "large")
            .when((task == "extraction") & (tokens < short), "small")
            .when((task == "extraction") & (doc_type == "research_paper"), "large")
            .when(task == "extraction", "small")
            .when(task == "relationship_classification", "large")
            .when(task == "taxonomy_audit", "audit").otherwise("small"))


def assign_variant(doc_id: Column, variants: int) -> Column:
    """stable variant number of a document."""
    return (F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 1, 8), 16, 10).cast("bigint")
            % F.lit(variants)).cast("int")
