"""Joined views of the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.plans.scale import cut, fits, nest_pages, top_k


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge seen from its source ("out") and from its target ("in")."""
    rest = [c for c in edges.columns if c not in ("source_skill_id", "target_skill_id")]
    out = edges.select(F.col("source_skill_id").alias("skill_id"), F.col("target_skill_id").alias("other_id"),
                       F.lit("out").alias("direction"), *rest)
    back = edges.select(F.col("target_skill_id").alias("skill_id"), F.col("source_skill_id").alias("other_id"),
                        F.lit("in").alias("direction"), *rest)
    return out.unionByName(back)


def edges_by_skill(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edges per concept, in either role, nested by type on bounded pages."""
    seen = both_directions(edges)
    if ids is not None:
        seen = seen.join(ids.select(F.col("id").alias("skill_id")), "skill_id", "left_semi")
    item = F.struct("other_id", "direction", "confidence")
    return nest_pages(seen, ["skill_id", "relationship_type"], item, "edges")


def skill_detail(skills: DataFrame, aliases: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A concept with its nested aliases and edges. Each side is nested before it is joined.

    Concepts with more items than a page have one row per page; a page holds aliases, edges or both.
    """
    wanted = skills if ids is None else skills.join(ids.select("id"), "id", "left_semi")
    alias_pages = nest_pages(aliases, ["skill_id"], F.struct("locale", "surface_form", "is_primary"), "aliases")
    edge_pages = nest_pages(both_directions(edges), ["skill_id"],
                            F.struct("relationship_type", "other_id", "direction"), "edges")
    pages = alias_pages.join(edge_pages, ["skill_id", "page"], "full_outer").withColumnRenamed("skill_id", "id")
    return wanted.join(pages, "id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def related(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Neighbours over active related_to and requires edges, with the edge's own data."""
    seen = both_directions(edges.filter("relationship_type in ('related_to', 'requires') and status = 'active'"))
    if ids is not None:
        seen = seen.join(ids.select(F.col("id").alias("skill_id")), "skill_id", "left_semi")
    return seen


def roots(skills: DataFrame, edges: DataFrame) -> DataFrame:
    """Active concepts without an active incoming hierarchy edge."""
    from lexigraph.operators.graph import hierarchy

    children = hierarchy(edges).select(F.col("child_id").alias("id"))
    return skills.filter("status = 'active'").join(children, "id", "left_anti")


def named_pairs(cooc: DataFrame, skills: DataFrame) -> DataFrame:
    """Pairs with both names."""
    names = skills.select("id", "canonical_name")
    return (cooc.join(names.selectExpr("id as skill_a_id", "canonical_name as skill_a_name"), "skill_a_id")
            .join(names.selectExpr("id as skill_b_id", "canonical_name as skill_b_name"), "skill_b_id"))


def assign_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """The section whose offsets hold the start of the chunk."""
    s = sections.select("doc_id", F.col("section_type"), F.col("weight").alias("section_weight"),
                        F.col("start_offset").alias("__s"), F.col("end_offset").alias("__e"))
    hit = (F.col("start_offset") >= F.col("__s")) & (F.col("start_offset") < F.col("__e"))
    c, r = chunks.alias("c"), s.alias("r")
    return (c.join(r, (F.col("c.doc_id") == F.col("r.doc_id")) & hit, "left")
            .select("c.*", "section_type", F.coalesce("section_weight", F.lit(1.0)).alias("section_weight")))


def drop_already_extracted(expanded: DataFrame, results: DataFrame) -> DataFrame:
    """A concept extracted directly wins over its expanded copy."""
    return expanded.join(results.select("doc_id", "skill_id"), ["doc_id", "skill_id"], "left_anti")


def only_children(pairs: DataFrame) -> DataFrame:
    """Pairs of ``pairs(parent_id, child_id)`` whose child has no other parent."""
    return (pairs.groupBy("child_id").agg(F.count(F.lit(1)).alias("n"), F.min("parent_id").alias("parent_id"))
            .filter("n = 1").select("parent_id", "child_id"))


def list_children(tops: DataFrame, lone: DataFrame, keep: list[str], spread: int = 16) -> DataFrame:
    """Rows of ``tops(doc_id, parent_id, own, ...)`` once for every child in ``lone(parent_id, child_id)`` that is not among ``own``.

    Children wait on bounded pages. The rows to come are counted ahead: ``tops`` (far fewer, read twice) are dealt to so many tasks that each
    lists about as many, which the bytes shuffled do not tell. Pages of few children go to all executors; of many, rows and pages meet by
    parent and part of the documents, so that tasks share a large parent.
    """
    few = fits(lone, config.LISTED_BROADCAST_ROWS)
    sizes = lone.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    total = tops.groupBy("parent_id").agg(F.count(F.lit(1)).alias("m")).join(sizes, "parent_id").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(tops.sparkSession.sparkContext.defaultParallelism, min(-(-total // config.LISTED_TASK_ROWS), config.LISTED_MAX_TASKS))
    pages = nest_pages(lone, ["parent_id"], F.col("child_id"), "children").drop("page")
    if few:
        met = tops.repartition(tasks, "doc_id", "parent_id").join(F.broadcast(pages), "parent_id")
    else:
        dealt = tops.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")).repartition(tasks, "parent_id", "__part")
        spreaded = pages.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(tasks, "parent_id", "__part")
        met = dealt.join(spreaded.hint("merge"), ["parent_id", "__part"])
    mine = F.coalesce(F.array_contains("own", F.col("skill_id")), F.lit(False))
    return met.select("doc_id", F.explode("children").alias("skill_id"), *keep, "own").filter(~mine).drop("own")


def new_siblings(results: DataFrame, pairs: DataFrame, spread: int = 16) -> DataFrame:
    """J11 over siblings: other children of a document's parents (``pairs(parent_id, child_id)``), without what it has itself.

    A child with one parent comes once per document from there, and what the document has under a parent travels with that
    parent, so these rows, by far the most, are neither shuffled nor made distinct. Children with several parents are.
    """
    us, pairs = cut(results.select("doc_id", "skill_id").distinct()), cut(pairs)
    tops = cut(us.join(pairs.withColumnRenamed("child_id", "skill_id"), "skill_id").groupBy("doc_id", "parent_id")
               .agg(F.collect_set("skill_id").alias("own")))
    lone = cut(only_children(pairs))
    near = list_children(tops, lone, [], spread)
    many = pairs.join(lone.select("child_id"), "child_id", "left_anti")
    far = tops.select("doc_id", "parent_id").join(many, "parent_id").select("doc_id", F.col("child_id").alias("skill_id")).distinct()
    return near.unionByName(drop_already_extracted(far, us))


def not_pending(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """Candidates without a pending queue entry of the same normalized name."""
    pending = queue.filter("status = 'pending'").select("normalized_name")
    return candidates.join(pending, "normalized_name", "left_anti")


def queue_detail(queue: DataFrame, skills: DataFrame, lists: tuple[str, ...] = ("similar_existing",
                 "suggested_parents")) -> DataFrame:
    """One row per queue entry, list and position, ids resolved to concepts (arrays are short: top-k lists)."""
    parts = None
    for name in lists:
        rows = queue.select("queue_id", "candidate_name", F.lit(name).alias("list"),
                            F.posexplode_outer(name).alias("position", "skill_id"))
        parts = rows if parts is None else parts.unionByName(rows)
    info = skills.select(F.col("id").alias("skill_id"), "canonical_name", "category", "status")
    return parts.join(info, "skill_id", "left")


def candidate_forms(logs: DataFrame) -> DataFrame:
    """One row per log row and distinct normalized form."""
    forms = F.array_distinct(F.col("discovered_candidates.normalized_form"))
    return logs.select("log_id", "document_hash", "created_at", F.explode(forms).alias("normalized_form"))


def contains_candidate(logs: DataFrame, forms: DataFrame) -> DataFrame:
    """log rows whose candidates hold a normalized form (containment as an equi-join)."""
    return candidate_forms(logs).join(forms, "normalized_form")


def reanalysis_docs(activations: DataFrame, logs: DataFrame,
                    newest: int = config.REANALYSIS_MAX_DOCUMENTS) -> DataFrame:
    """Per activated concept the newest documents that had it as an unknown candidate.

    The newest rows are picked per form before the concepts join, so a frequent form stays small.
    """
    rows = candidate_forms(logs)
    forms = activations.select("skill_id", F.col("normalized_name").alias("normalized_form"))
    wanted = rows.join(forms.select("normalized_form").distinct(), "normalized_form", "left_semi")
    newest_rows = top_k(wanted, ["normalized_form"], [F.col("created_at").desc(), F.col("log_id")], newest)
    return newest_rows.join(forms, "normalized_form")
