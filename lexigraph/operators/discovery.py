"""From unknown terms to reviewed concepts: routing, queue, decisions, suggested edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import normalized_name
from lexigraph.operators import cooccur, mutate, search
from lexigraph.operators.mutate import Change, entries
from lexigraph.operators.windows import assign_versions
from lexigraph.plans.scale import cut


def route_candidates(verdicts: DataFrame, auto_alias: bool = True) -> DataFrame:
    """Duplicates become aliases (or go to review), near ones to review, the rest are new."""
    dup = F.lit("alias" if auto_alias else "review")
    v = F.col("verdict")
    return verdicts.withColumn("route", F.when(v == "duplicate", dup).when(v == "review", "review").otherwise("new"))


def queue_add(queue: DataFrame, cands: DataFrame) -> DataFrame:
    """Count new signals of pending candidates up, add the others.

    ``cands(candidate_name, category_guess, llm_score, similar_existing, suggested_parents)``, one row per signal;
    signals are counted per normalized name before they meet the queue.
    """
    named = cands.withColumn("normalized_name", normalized_name(F.col("candidate_name")))
    batch = named.groupBy("normalized_name").agg(
        F.count(F.lit(1)).alias("__n"), F.min("candidate_name").alias("__name"),
        F.min("category_guess").alias("__category"), F.max("llm_score").alias("__score"),
        F.min("similar_existing").alias("__similar"), F.min("suggested_parents").alias("__parents"))
    pending, closed = queue.filter("status = 'pending'"), queue.filter("status <> 'pending'")
    both = pending.join(batch, "normalized_name", "full_outer")
    merged = both.select(
        F.coalesce("queue_id", F.concat(F.lit("RQ:"), "normalized_name")).alias("queue_id"), "normalized_name",
        F.coalesce("candidate_name", "__name").alias("candidate_name"),
        (F.coalesce("signals_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("signals_count"),
        F.coalesce("llm_score", "__score").alias("llm_score"),
        F.coalesce("category_guess", "__category").alias("category_guess"),
        F.coalesce("similar_existing", "__similar").alias("similar_existing"),
        F.coalesce("suggested_parents", "__parents").alias("suggested_parents"),
        F.coalesce("status", F.lit("pending")).alias("status"))
    return merged.unionByName(closed.select(*merged.columns))


def decide(queue: DataFrame, skills: DataFrame, aliases: DataFrame, edges: DataFrame, decisions: DataFrame) -> Change:
    """Curator decisions (queue_id, decision, merge_target_id, notes).

    Approve creates an active concept, edges from the suggested parents (predicted, weight 0.5) and an activation
    event; merge adds the name as an alias of the target; reject and defer only close or postpone the entry.
    Decided entries, unknown ones and merges without a known target are rejected; of several decisions on one entry the
    first (by decision, target and notes) counts. Suggested parents that are not active concepts come back in
    ``extra["rejected_edges"]``.
    """
    info = queue.select("queue_id", F.col("status").alias("__st"), "candidate_name", "normalized_name",
                        "category_guess", "suggested_parents")
    targets = skills.filter("status = 'active'").select(F.col("id").alias("merge_target_id"), F.lit(True).alias("__ok"))
    nth = F.row_number().over(Window.partitionBy("queue_id").orderBy("decision", "merge_target_id", "notes"))
    judged = decisions.withColumn("__nth", nth).join(info, "queue_id", "left").join(targets, "merge_target_id", "left")
    judged = judged.withColumn("reason", (
        F.when(F.col("__st").isNull(), "unknown entry").when(~F.col("__st").isin("pending", "deferred"), "already decided")
        .when(F.col("__nth") > 1, "decided twice")
        .when((F.col("decision") == "merge") & F.col("__ok").isNull(), "unknown merge target")
        .when(~F.coalesce(F.col("decision").isin("approve", "reject", "merge", "defer"), F.lit(False)), "unknown decision")))
    judged = cut(judged)
    good = judged.filter("reason is null")
    state = F.create_map(*[F.lit(x) for x in ("approve", "approved", "reject", "rejected", "merge", "merged",
                                              "defer", "deferred")])
    approved = good.filter("decision = 'approve'")
    made = mutate.create_skills(skills, aliases, approved.select(
        F.col("queue_id").alias("req_id"), F.col("candidate_name").alias("name"),
        F.lit(None).cast("string").alias("description"), F.col("category_guess").alias("category"),
        F.lit("llm_discovered").alias("source")), status="active")
    born = made.extra["requested"].withColumnRenamed("req_id", "queue_id")
    parents = approved.select("queue_id", "normalized_name", "suggested_parents").join(born, "queue_id")
    asked = parents.select("queue_id", "skill_id", F.explode("suggested_parents").alias("parent_id")).distinct()
    alive = skills.filter("status = 'active'").select(F.col("id").alias("parent_id"))
    lost = asked.join(alive, "parent_id", "left_anti").select("queue_id", "parent_id", F.lit("unknown or retired parent").alias("reason"))
    unmade = made.rejected.withColumnRenamed("req_id", "queue_id")
    new_edges = asked.join(alive, "parent_id", "left_semi").select(
        F.col("parent_id").alias("source_skill_id"), F.col("skill_id").alias("target_skill_id")).select(
        F.concat_ws("|", F.lit("parent_of"), "source_skill_id", "target_skill_id").alias("id"), "source_skill_id",
        "target_skill_id", F.lit("parent_of").alias("relationship_type"), F.lit(0.5).alias("confidence"),
        F.lit("active").alias("status"), F.lit("llm_predicted").alias("provenance"), F.lit(0.5).alias("weight"))
    done = good.join(unmade.select("queue_id"), "queue_id", "left_anti").select("queue_id", F.element_at(state, F.col("decision")).alias("__new"), "decision", "notes")
    new_queue = queue.join(done, "queue_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")
    merged = good.filter("decision = 'merge'").select(
        F.concat_ws("|", "merge_target_id", F.lit("en"), "candidate_name").alias("id"),
        F.col("merge_target_id").alias("skill_id"), F.col("candidate_name").alias("surface_form"),
        F.lit("en").alias("locale"), F.lit("llm_discovered").alias("source"), F.lit(False).alias("is_primary"))
    log = (made.changelog.unionByName(entries(new_edges, "edge_created", "edge", "id", "weight"))
           .unionByName(entries(merged, "alias_added", "alias", "id", "surface_form")))
    return Change({"queue": new_queue, "skills": made.tables["skills"],
                   "aliases": made.tables["aliases"].unionByName(merged, allowMissingColumns=True),
                   "edges": edges.unionByName(new_edges, allowMissingColumns=True)}, log,
                  judged.filter("reason is not null").select("queue_id", "reason").unionByName(unmade.select("queue_id", "reason")),
                  {"rejected_edges": lost, "edges": new_edges, "aliases": merged, "skills": made.extra["skills"],
                   "activations": parents.select("skill_id", "normalized_name")})


# Relation named by a model -> edge type and whether the pair is turned round.
LABELS = (("PARENT_CHILD", "parent_of", False), ("CHILD_PARENT", "parent_of", True),
          ("RELATED", "related_to", False), ("PREREQUISITE", "requires", False))


def suggest_relationships(cands: DataFrame, skills: DataFrame, labels: DataFrame | None = None, neighbours: int = 5,
                          high: float = config.RELATED_HIGH_SIMILARITY,
                          low: float = config.RELATED_LOW_SIMILARITY) -> DataFrame:
    """Edges a new concept may need: its nearest concepts, classified by similarity band or given labels."""
    near = search.knn(cands, skills, neighbours).select("query_id", "id", "similarity", "rank")
    if labels is None:
        s = F.col("similarity")
        band = F.when(s >= high, "high").when(s >= low, "medium")
        return near.withColumn("strength", band).withColumn(
            "relationship_type", F.when(band.isNotNull(), "related_to").otherwise("none"))
    kinds = F.broadcast(cands.sparkSession.createDataFrame(
        list(LABELS), "classification string, relationship_type string, turned boolean"))
    named = near.join(labels.select("query_id", "id", "classification", "confidence"), ["query_id", "id"]).join(
        kinds, "classification")
    return named.select(
        F.when(F.col("turned"), F.col("id")).otherwise(F.col("query_id")).alias("source_skill_id"),
        F.when(F.col("turned"), F.col("query_id")).otherwise(F.col("id")).alias("target_skill_id"),
        "relationship_type", "confidence", "similarity")


def batch_pairs(pairs: DataFrame, size: int = config.PAIR_BATCH_SIZE) -> DataFrame:
    """Request rows of ``size`` pairs each, in pair order."""
    numbered = assign_versions(pairs.select("skill_a_id", "skill_b_id"), 0, ("skill_a_id", "skill_b_id"), 16)
    batch = F.floor((F.col("graph_version") - 1) / size).alias("batch")
    return numbered.groupBy(batch).agg(
        F.array_sort(F.collect_list(F.struct("skill_a_id", "skill_b_id"))).alias("pairs"))


def similarity_edges(skills: DataFrame, edges: DataFrame, high: float = config.RELATED_HIGH_SIMILARITY,
                     low: float = config.RELATED_LOW_SIMILARITY) -> DataFrame:
    """Pending related_to edges for similar concepts that have none yet."""
    pairs = search.similar_pairs(skills.select("id", "embedding"), high, low).filter("relation = 'related_medium'")
    known = cooccur.match_pairs(pairs.select("skill_a_id", "skill_b_id"), edges).select("skill_a_id", "skill_b_id")
    new = pairs.join(known, ["skill_a_id", "skill_b_id"], "left_anti")
    return new.select(
        F.concat_ws("|", F.lit("related_to"), "skill_a_id", "skill_b_id").alias("id"),
        F.col("skill_a_id").alias("source_skill_id"), F.col("skill_b_id").alias("target_skill_id"),
        F.lit("related_to").alias("relationship_type"), F.col("similarity").alias("confidence"),
        F.col("similarity").alias("weight"), F.lit("embedding_similarity").alias("provenance"),
        F.lit("pending_review").alias("status"))
