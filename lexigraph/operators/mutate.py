"""Taxonomy changes as table-to-table jobs.

Every job takes the current tables and a table of requests, and returns the new tables, the changelog rows and
the rejected requests with their reason. Nothing is written; see ``sources.tables.publish``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import external_id, sanitize
from lexigraph.operators import graph, quality, windows
from lexigraph.plans.scale import cut


@dataclass
class Change:
    """Result of a mutation job."""

    tables: dict[str, DataFrame]
    changelog: DataFrame
    rejected: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


LOG = ["mutation_type", "entity_type", "entity_id", "diff_payload"]


def entries(rows: DataFrame, mutation: str | Column, entity: str, key: str, *payload: Column | str) -> DataFrame:
    """Changelog rows without version."""
    kind = F.lit(mutation) if isinstance(mutation, str) else mutation
    body = F.to_json(F.struct(*payload)) if payload else F.lit("{}")
    return rows.select(kind.alias("mutation_type"), F.lit(entity).alias("entity_type"),
                       F.col(key).alias("entity_id"), body.alias("diff_payload"))


def record(changes: list[DataFrame], start: Column | int, actor: str = "system") -> DataFrame:
    """Changelog rows of a batch with consecutive versions after ``start``."""
    rows = changes[0]
    for more in changes[1:]:
        rows = rows.unionByName(more)
    return windows.assign_versions(rows.withColumn("actor", F.lit(actor)), start,
                                   ("entity_id", "mutation_type", "diff_payload"), 8)


def create_skills(skills: DataFrame, aliases: DataFrame, reqs: DataFrame, status: str = "candidate") -> Change:
    """M1: concepts from requests (req_id, name, description, category, source), each with a primary English alias."""
    # Stored: names and slugs take a Python step each, and a task holds a worker for every such step of its stage.
    named = cut(reqs.withColumn("name", sanitize(F.col("name"))))
    reason = (F.when(F.coalesce(F.length("name"), F.lit(0)) < 1, "name is empty")
              .when(F.length("name") > config.NAME_MAX_LENGTH, "name is too long")
              .when(F.length("description") > config.DESCRIPTION_MAX_LENGTH, "description is too long")
              .when(F.col("category").isNotNull() & ~F.col("category").isin(*config.CATEGORIES), "unknown category"))
    judged = named.withColumn("reason", reason)
    good = judged.filter("reason is null").withColumn("id", F.concat(F.lit("N:"), F.substring(
        F.sha2(F.concat_ws("|", F.col("req_id").cast("string"), "name"), 256), 1, 16)))
    slugged = windows.unique_slugs(good, skills.select("slug"))
    rows = slugged.select(
        "id", external_id(F.col("id")).alias("external_id"), F.col("name").alias("canonical_name"), "slug",
        "description", F.lit(status).alias("status"), "category", F.col("slug").alias("path"),
        F.lit(1).alias("version"), "source")
    forms = rows.select(
        F.concat_ws("|", "id", F.lit("en"), "canonical_name").alias("id"), F.col("id").alias("skill_id"),
        F.col("canonical_name").alias("surface_form"), F.lit("en").alias("locale"), F.lit("curated").alias("source"),
        F.lit(True).alias("is_primary"))
    log = entries(rows, "skill_created", "skill", "id", "canonical_name", "category").unionByName(
        entries(forms, "alias_added", "alias", "id", "surface_form", "locale"))
    return Change({"skills": skills.unionByName(rows, allowMissingColumns=True),
                   "aliases": aliases.unionByName(forms, allowMissingColumns=True)}, log,
                  judged.filter("reason is not null").select("req_id", "reason"),
                  {"skills": rows, "aliases": forms, "requested": slugged.select("req_id", F.col("id").alias("skill_id"))})


def create_unique_skills(skills: DataFrame, aliases: DataFrame, reqs: DataFrame, alias_vectors: DataFrame, status: str = "candidate") -> Change:
    """M1 with V4: requests carry a vector; those nearly equal to a concept are rejected as its duplicates, doubtful ones go to
    ``extra["review"]`` (req_id, name, skill_id, similarity), the rest is created. A request without a vector is not compared."""
    from lexigraph.operators import search

    asked = reqs.select(F.col("req_id").cast("string").alias("query_id"), "embedding").filter("embedding is not null")
    near = cut(search.check_duplicates(asked, skills, alias_vectors)).select(F.col("query_id").alias("__req"), "skill_id", "similarity", "verdict")
    judged = cut(reqs.drop("embedding").join(near, F.col("req_id").cast("string") == F.col("__req"), "left").drop("__req"))
    made = create_skills(skills, aliases, judged.filter("coalesce(verdict, 'unique') = 'unique'").drop("skill_id", "similarity", "verdict"), status)
    again = judged.filter("verdict = 'duplicate'").select("req_id", F.concat(F.lit("duplicate of "), "skill_id").alias("reason"))
    return Change(made.tables, made.changelog, made.rejected.unionByName(again),
                  made.extra | {"review": judged.filter("verdict = 'review'").select("req_id", "name", "skill_id", "similarity")})


FIELDS = ("canonical_name", "description", "category", "status")


def update_skills(skills: DataFrame, aliases: DataFrame, reqs: DataFrame) -> Change:
    """M2: partial updates (one request per id); the version rises only if something changes."""
    asked = reqs.select("id", *[F.col(f).alias(f"__{f}") for f in FIELDS if f in reqs.columns])
    given = [f for f in FIELDS if f in reqs.columns]
    joined = skills.join(asked, "id", "left")
    changes = [F.col(f"__{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__{f}")) for f in given]
    changed = changes[0]
    for c in changes[1:]:
        changed = changed | c
    marked = joined.withColumn("__changed", F.coalesce(changed, F.lit(False)))
    new = marked.withColumns({
        **{f: F.coalesce(f"__{f}", f) for f in given},
        "version": F.col("version") + F.col("__changed").cast("int")}).select(*skills.columns, "__changed")
    touched = new.filter("__changed").select("id")
    cells = windows.diff(skills.join(touched, "id", "left_semi"), new.join(touched, "id", "left_semi"), tuple(given))
    renamed = new.filter("__changed").select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("__name"))
    main = F.col("is_primary") & (F.col("locale") == "en") & F.col("__name").isNotNull()
    forms = aliases.join(renamed, "skill_id", "left").withColumn(
        "surface_form", F.when(main, F.col("__name")).otherwise(F.col("surface_form"))).select(*aliases.columns)
    missing = reqs.join(skills.select("id"), "id", "left_anti").select("id", F.lit("unknown concept").alias("reason"))
    return Change({"skills": new.drop("__changed"), "aliases": forms},
                  entries(cells, "skill_updated", "skill", "id", "changes"), missing)


def apply_alias_ops(aliases: DataFrame, ops: DataFrame) -> Change:
    """M3: delete, update and add aliases, in that order.

    ``ops(op_id, op, alias_id, skill_id, surface_form, locale, is_primary)``. Deletes and updates that would leave a concept
    without a primary alias in a locale that has one are rejected, as are unknown aliases, forms that are missing or too
    long, and adds of an alias that is there already (of several equal adds the first is made). A new primary alias demotes
    the old one.
    """
    keys = ["skill_id", "locale"]
    change = ops.filter("op in ('delete', 'update')").select(
        "op_id", "op", F.col("alias_id").alias("id"), F.col("surface_form").alias("__surface_form"), F.col("locale").alias("__locale"),
        F.col("is_primary").alias("__is_primary"))
    hit = aliases.join(change, "id")
    moves = F.col("__locale").isNotNull() & (F.col("__locale") != F.col("locale"))
    loses = F.col("is_primary") & ((F.col("op") == "delete") | moves | ~F.coalesce("__is_primary", F.lit(True)))
    long = F.length("__surface_form") > config.ALIAS_MAX_LENGTH
    # Adds first, for what they may bring: a primary alias of the same concept and locale.
    wanted = ops.filter("op = 'add'").withColumn("id", F.concat_ws("|", "skill_id", "locale", "surface_form"))
    wanted = (wanted.withColumn("__nth", F.row_number().over(Window.partitionBy("id").orderBy("op_id")))
              .join(aliases.select("id", F.lit(True).alias("__there")), "id", "left"))
    added_reason = (F.when(F.coalesce(F.length("surface_form"), F.lit(0)) < 1, "form is missing")
                    .when(F.length("surface_form") > config.ALIAS_MAX_LENGTH, "form is too long")
                    .when(F.col("__there") | (F.col("__nth") > 1), "alias exists"))
    wanted = wanted.withColumn("reason", added_reason)
    added = wanted.filter("reason is null").select(
        "id", "skill_id", "surface_form", "locale", F.lit("curated").alias("source"), "is_primary", F.lit(2).alias("__order"))
    counted = hit.withColumn("__loses", loses).groupBy(*keys).agg(F.count_if("__loses").alias("__gone"))
    have = (aliases.join(hit.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
            .agg(F.count_if(F.col("is_primary")).alias("__have")))
    gain = (added.select(*keys, "is_primary").unionByName(hit.filter("op = 'update' and __is_primary").select(
        "skill_id", F.coalesce("__locale", "locale").alias("locale"), F.col("__is_primary").alias("is_primary")))
        .filter("is_primary").groupBy(*keys).agg(F.count(F.lit(1)).alias("__gain")))
    judged = (hit.join(counted, keys).join(have, keys).join(gain, keys, "left").withColumn(
        "reason", F.when(long, "form is too long").when(
            loses & (F.col("__have") <= F.col("__gone")) & ((F.col("op") == "delete") | F.col("__gain").isNull()), "last primary alias")))
    good = judged.filter("reason is null")
    removed = good.filter("op = 'delete'").select("id")
    rejected = (judged.filter("reason is not null").select("op_id", "reason")
                .unionByName(change.join(aliases.select("id"), "id", "left_anti").select("op_id", F.lit("unknown alias").alias("reason")))
                .unionByName(wanted.filter("reason is not null").select("op_id", "reason")))
    left = aliases.join(removed, "id", "left_anti")
    edits = good.filter("op = 'update'").select("id", *[f"__{c}" for c in ("surface_form", "locale", "is_primary")])
    edited = left.join(edits, "id", "left").withColumns({
        **{c: F.coalesce(f"__{c}", c) for c in ("surface_form", "locale", "is_primary")},
        "__order": F.col("__is_primary").isNotNull().cast("int")}).select(*aliases.columns, "__order")
    new = windows.enforce_primary(edited.unionByName(added, allowMissingColumns=True), F.col("__order").desc())
    log = entries(added, "alias_added", "alias", "id", "surface_form", "locale").unionByName(
        entries(removed, "alias_removed", "alias", "id"))
    return Change({"aliases": new.drop("__order")}, log, rejected)


def initial_weight(provenance: Column, confidence: Column) -> Column:
    """First weight of an edge: curated 1, predicted 0.5, measured ones their own confidence."""
    return F.when(provenance == "human_curated", 1.0).when(provenance == "llm_predicted", 0.5).otherwise(confidence)


def create_edges(edges: DataFrame, skills: DataFrame, reqs: DataFrame) -> Change:
    """M4: edges that pass all checks, with the initial weight of their provenance."""
    ids = skills.select(F.col("id").alias("source_skill_id"))
    known = reqs.join(ids, "source_skill_id", "left_semi").join(
        ids.withColumnRenamed("source_skill_id", "target_skill_id"), "target_skill_id", "left_semi")
    judged = cut(quality.validate_edges(known, edges))
    unknown = reqs.join(known.select("id"), "id", "left_anti").select("id", F.lit("unknown concept").alias("reason"))
    new = judged.filter("reason is null").drop("reason").withColumns({
        "weight": initial_weight(F.col("provenance"), F.col("confidence")), "status": F.lit("active")})
    return Change({"edges": edges.unionByName(new, allowMissingColumns=True)},
                  entries(new, "edge_created", "edge", "id", "provenance", "weight"),
                  judged.filter("reason is not null").select("id", "reason").unionByName(unknown), {"edges": new})


def retire_edges(edges: DataFrame, reqs: DataFrame) -> Change:
    """M5: deprecate edges, or delete those still pending review or rejected (``reqs(id, action)``)."""
    joined = edges.join(reqs.select("id", F.col("action").alias("__a")), "id", "left")
    may = F.col("status").isin("pending_review", "rejected")
    drop = F.coalesce((F.col("__a") == "delete") & may, F.lit(False))
    retire = F.coalesce((F.col("__a") == "deprecate") & (F.col("status") != "deprecated"), F.lit(False))
    new = joined.filter(~drop).withColumn(
        "status", F.when(retire, "deprecated").otherwise(F.col("status"))).select(*edges.columns)
    refused = joined.filter((F.col("__a") == "delete") & ~may).select("id", F.concat(
        F.lit("cannot delete an edge that is "), "status").alias("reason"))
    unknown = reqs.join(edges.select("id"), "id", "left_anti").select("id", F.lit("unknown edge").alias("reason"))
    log = entries(joined.filter(drop | retire), "edge_deprecated", "edge", "id", "status", F.col("__a").alias("action"))
    return Change({"edges": new}, log, refused.unionByName(unknown))


def _supersedes(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.concat_ws("|", F.lit("superseded_by"), "s", "t").alias("id"), F.col("s").alias("source_skill_id"),
        F.col("t").alias("target_skill_id"), F.lit("superseded_by").alias("relationship_type"),
        F.lit(1.0).alias("confidence"), F.lit("active").alias("status"), F.lit("human_curated").alias("provenance"),
        F.lit(1.0).alias("weight"))


def _remap_aliases(aliases: DataFrame, to: DataFrame) -> DataFrame:
    """Move aliases to other concepts; the receiving concept's own primary alias wins in each locale."""
    moved = aliases.join(to.select(F.col("s").alias("skill_id"), F.col("t").alias("__to")), "skill_id", "left")
    moved = moved.withColumn("__own", F.col("__to").isNull().cast("int")).withColumn(
        "skill_id", F.coalesce("__to", "skill_id")).select(*aliases.columns, "__own")
    return windows.enforce_primary(moved, F.col("__own").desc()).drop("__own")


def deprecate(skills: DataFrame, aliases: DataFrame, edges: DataFrame, reqs: DataFrame) -> Change:
    """M6: retire active concepts in favour of active successors (``reqs(skill_id, successor_ids)``).

    A successor that is retired by the same batch is refused too. Co-occurrence is left as it is.
    """
    state = skills.select("id", "status")
    base = reqs.join(state.withColumnsRenamed({"id": "skill_id", "status": "__own"}), "skill_id", "left")
    each = base.select("skill_id", F.explode("successor_ids").alias("successor")).join(
        state.withColumnsRenamed({"id": "successor", "status": "__st"}), "successor", "left").join(
        reqs.select(F.col("skill_id").alias("successor"), F.lit(True).alias("__too")), "successor", "left")
    worst = each.groupBy("skill_id").agg(
        F.bool_or(F.col("__st").isNull()).alias("__none"), F.bool_or(F.coalesce(
            F.col("__st").isin("deprecated", "merged"), F.lit(False))).alias("__retired"),
        F.bool_or(F.coalesce("__too", F.lit(False))).alias("__batch"))
    judged = base.join(worst, "skill_id", "left").withColumn("reason", (
        F.when(F.col("__own").isNull(), "unknown concept").when(F.col("__own") != "active", "not active")
        .when(F.size("successor_ids") < 1, "no successor").when(F.col("__none"), "unknown successor")
        .when(F.col("__retired"), "successor is retired").when(F.col("__batch"), "successor is being retired")))
    good = judged.filter("reason is null").select("skill_id", "successor_ids")
    links = _supersedes(good.select(F.col("skill_id").alias("s"), F.explode("successor_ids").alias("t")).distinct())
    to = good.select(F.col("skill_id").alias("s"), F.col("successor_ids")[0].alias("t"))
    new = skills.join(good.select(F.col("skill_id").alias("id"), F.lit(True).alias("__r")), "id", "left").withColumn(
        "status", F.when(F.col("__r"), "deprecated").otherwise(F.col("status"))).select(*skills.columns)
    moved = aliases.join(good.select("skill_id"), "skill_id", "left_semi")
    log = (entries(good, "skill_deprecated", "skill", "skill_id", "successor_ids")
           .unionByName(entries(links, "edge_created", "edge", "id", "target_skill_id"))
           .unionByName(entries(moved, "alias_removed", "alias", "id", "skill_id"))
           .unionByName(entries(moved, "alias_added", "alias", "id", "surface_form")))
    fresh = links.join(edges.select("id"), "id", "left_anti")
    return Change({"skills": new, "aliases": _remap_aliases(aliases, to),
                   "edges": edges.unionByName(fresh, allowMissingColumns=True)}, log,
                  judged.filter("reason is not null").select("skill_id", "reason"), {"edges": links})


def _fold_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that became one with their counts added, by type of source; a pair of one concept goes."""
    pairs = pairs.filter("skill_a_id <> skill_b_id").select(
        F.least("skill_a_id", "skill_b_id").alias("skill_a_id"),
        F.greatest("skill_a_id", "skill_b_id").alias("skill_b_id"),
        "source_type_counts", "last_seen_at", "created_at")
    by_source = pairs.select("skill_a_id", "skill_b_id", "last_seen_at", "created_at",
                             F.explode("source_type_counts").alias("source_type", "n"))
    sums = by_source.groupBy("skill_a_id", "skill_b_id", "source_type").agg(
        F.sum("n").alias("n"), F.max("last_seen_at").alias("last"), F.min("created_at").alias("first"))
    return sums.groupBy("skill_a_id", "skill_b_id").agg(
        F.sum("n").alias("co_occurrence_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_type_counts"),
        F.max("last").alias("last_seen_at"), F.min("first").alias("created_at"))


def merge_skills(skills: DataFrame, aliases: DataFrame, edges: DataFrame, cooc: DataFrame | None,
                 merges: DataFrame) -> Change:
    """M7: fold sources into survivors (``merges(source_id, target_id)``, one level).

    Ids are mapped in every table, then regrouped: self-loops go, the more certain of equivalent edges stays,
    counts of pairs that become one are added, survivors keep their own primary aliases. A merge that would close a
    cycle in the hierarchy is rejected. Without ``cooc`` no table of pairs comes back; the others do not depend on it.
    """
    def mapped(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(to.select(F.col("s").alias(c), F.col("t").alias("__to")), c, "left").withColumn(
                c, F.coalesce("__to", c)).drop("__to")
        return df

    state = skills.select("id", "status")
    judged = (merges.join(state.withColumnsRenamed({"id": "source_id", "status": "__s"}), "source_id", "left")
              .join(state.withColumnsRenamed({"id": "target_id", "status": "__t"}), "target_id", "left")
              .join(merges.select(F.col("source_id").alias("target_id"), F.lit(True).alias("__chain")).distinct(),
                    "target_id", "left")
              .join(merges.groupBy("source_id").agg(F.count(F.lit(1)).alias("__n")), "source_id"))
    judged = judged.withColumn("reason", (
        F.when(F.col("source_id") == F.col("target_id"), "self merge")
        .when(F.col("__s").isNull() | F.col("__t").isNull(), "unknown concept")
        .when((F.col("__s") != "active") | (F.col("__t") != "active"), "not active")
        .when(F.col("__chain"), "survivor is merged too").when(F.col("__n") > 1, "merged twice")))
    judged = cut(judged)
    to = cut(judged.filter("reason is null").select(F.col("source_id").alias("s"), F.col("target_id").alias("t")))
    old = None  # concepts on cycles before the merges; asked for only where a survivor lies on one afterwards
    while True:  # without the merges that close a cycle the rest may still close another
        looped = graph.cycles(mapped(edges, "source_skill_id", "target_skill_id").filter("source_skill_id <> target_skill_id"))
        met = cut(to.join(looped.select(F.col("node").alias("t")), "t", "left_semi"))
        if met.isEmpty():
            break
        if old is None:
            old = cut(graph.cycles(edges).select(F.col("node").alias("t")))
        bad = cut(met.join(old, "t", "left_anti").select("s"))
        if bad.isEmpty():
            break
        to = cut(to.join(bad, "s", "left_anti"))
        judged = judged.join(bad.select(F.col("s").alias("source_id"), F.lit(True).alias("__cycle")), "source_id", "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("__cycle"), "closes a cycle"))).drop("__cycle")

    new_skills = skills.join(to.select(F.col("s").alias("id"), F.lit(True).alias("__m")), "id", "left").withColumn(
        "status", F.when(F.col("__m"), "merged").otherwise(F.col("status"))).select(*skills.columns)
    ends = ("source_skill_id", "target_skill_id")
    moved = windows.dedupe_edges(mapped(edges, *ends).filter("source_skill_id <> target_skill_id"))
    links = _supersedes(to)
    log = entries(to, "skill_merged", "skill", "s", F.col("t").alias("survivor")).unionByName(
        entries(links, "edge_created", "edge", "id", "target_skill_id")).unionByName(
        entries(edges.join(to.select(F.col("s").alias("source_skill_id")), "source_skill_id", "left_semi").unionByName(
            edges.join(to.select(F.col("s").alias("target_skill_id")), "target_skill_id", "left_semi")).distinct(),
            "edge_updated", "edge", "id", "source_skill_id", "target_skill_id"))
    taken = aliases.join(to.select(F.col("s").alias("skill_id"), F.col("t").alias("survivor")), "skill_id")
    log = (log.unionByName(entries(taken, "alias_removed", "alias", "id", "skill_id"))
           .unionByName(entries(taken, "alias_added", "alias", "id", F.col("survivor").alias("skill_id"))))
    tables = {"skills": new_skills, "aliases": _remap_aliases(aliases, to), "edges": moved.unionByName(links, allowMissingColumns=True)}
    if cooc is not None:
        tables["co_occurrences"] = _fold_pairs(mapped(cooc, "skill_a_id", "skill_b_id"))
    return Change(tables, log,
                  judged.filter("reason is not null").select("source_id", "target_id", "reason"))


def check_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """M9: status changes the lifecycle does not allow."""
    spark = old.sparkSession
    allowed = F.broadcast(spark.createDataFrame(list(config.TRANSITIONS), "old_status string, new_status string"))
    moved = (old.select("id", F.col("status").alias("old_status"))
             .join(new.select("id", F.col("status").alias("new_status")), "id").filter("old_status <> new_status"))
    return moved.join(allowed, ["old_status", "new_status"], "left_anti")


def upsert(target: DataFrame, delta: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """S3: rows of ``delta`` replace or join those of ``target``; keys are unique on both sides.

    ``merge`` gives per column an expression over ``t_<col>`` and ``d_<col>``; by default the new value wins.
    """
    merge = merge or {}
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in rest])
    d = delta.select(*keys, *[F.col(c).alias(f"d_{c}") for c in rest])
    both = t.join(d, keys, "full_outer")
    return both.select(*keys, *[merge.get(c, F.coalesce(f"d_{c}", f"t_{c}")).alias(c) for c in rest])
