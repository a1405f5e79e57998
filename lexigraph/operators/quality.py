"""Data-quality rules over the taxonomy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import normalized_name
from lexigraph.plans.scale import cut


def _hits(df: DataFrame, table: str, rule: str, where: Column | None = None, key: str = "id") -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col(key).alias("entity_id"))


def _repeated(df: DataFrame, table: str, rule: str, cols: list[str]) -> DataFrame:
    dup = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dup.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"),
                      F.concat_ws("|", *cols).alias("entity_id"))


def audit_constraints(skills: DataFrame, aliases: DataFrame, edges: DataFrame,
                      cooc: DataFrame | None = None, changelog: DataFrame | None = None,
                      queue: DataFrame | None = None) -> DataFrame:
    """Q1: one row per broken CHECK, NOT NULL, UNIQUE, foreign-key or self-edge rule.

    Changelog entries must have a known mutation type, queue entries a known status and one pending entry per name.
    """
    def outside(col: str, allowed: tuple[str, ...]) -> Column:
        return F.col(col).isNotNull() & ~F.col(col).isin(*allowed)

    ids = skills.select(F.col("id").alias("__id"))

    def missing(df: DataFrame, table: str, col: str) -> DataFrame:
        gone = df.join(ids, df[col] == ids["__id"], "left_anti")
        return _hits(gone, table, f"{col} unknown")

    unit = [F.col(c).isNotNull() & ~F.col(c).between(0.0, 1.0) for c in ("confidence", "weight")]
    found = [
        _hits(skills, "skills", "status", outside("status", config.SKILL_STATUSES)),
        _hits(skills, "skills", "category", outside("category", config.CATEGORIES)),
        _hits(skills, "skills", "canonical_name missing", F.col("canonical_name").isNull()),
        _hits(skills, "skills", "path missing", F.col("path").isNull()),
        _repeated(skills, "skills", "id repeated", ["id"]),
        _hits(skills, "skills", "external_id missing", F.col("external_id").isNull()),
        _hits(skills, "skills", "slug missing", F.col("slug").isNull()),
        _repeated(skills.filter("external_id is not null"), "skills", "external_id repeated", ["external_id"]),
        _repeated(skills.filter("slug is not null"), "skills", "slug repeated", ["slug"]),
        _hits(aliases, "aliases", "source", outside("source", config.ALIAS_SOURCES)),
        _hits(aliases, "aliases", "surface_form missing", F.col("surface_form").isNull()),
        missing(aliases, "aliases", "skill_id"),
        _hits(edges, "edges", "relationship_type", outside("relationship_type", config.EDGE_TYPES)),
        _hits(edges, "edges", "provenance", outside("provenance", config.PROVENANCES)),
        _hits(edges, "edges", "status", outside("status", config.EDGE_STATUSES)),
        _hits(edges, "edges", "confidence range", unit[0]),
        _hits(edges, "edges", "weight range", unit[1]),
        _hits(edges, "edges", "self edge", F.col("source_skill_id") == F.col("target_skill_id")),
        _repeated(edges, "edges", "edge repeated", ["source_skill_id", "target_skill_id", "relationship_type"]),
        missing(edges, "edges", "source_skill_id"),
        missing(edges, "edges", "target_skill_id"),
    ]
    if cooc is not None:
        keyed = cooc.withColumn("id", F.concat_ws("|", "skill_a_id", "skill_b_id"))
        found += [
            _hits(keyed, "co_occurrences", "pair order", F.col("skill_a_id") >= F.col("skill_b_id")),
            _repeated(keyed, "co_occurrences", "pair repeated", ["skill_a_id", "skill_b_id"]),
            missing(keyed, "co_occurrences", "skill_a_id"), missing(keyed, "co_occurrences", "skill_b_id"),
        ]
    if changelog is not None:
        log = changelog.withColumn("id", F.col("graph_version").cast("string"))
        found.append(_hits(log, "changelog", "mutation_type", outside("mutation_type", config.MUTATION_TYPES)))
    if queue is not None:
        asked = queue.withColumn("id", F.col("queue_id"))
        found += [_hits(asked, "queue", "status", outside("status", config.QUEUE_STATUSES)),
                  _repeated(queue.filter("status = 'pending'"), "queue", "pending name repeated", ["normalized_name"])]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


EDGE_KEY = ["source_skill_id", "target_skill_id", "relationship_type"]


def check_duplicate_edges(new: DataFrame, edges: DataFrame) -> DataFrame:
    """Q3: proposed edges with the kind of duplicate: "existing", "batch" (a repeat within it) or NULL."""
    known = edges.select(*EDGE_KEY).distinct().withColumn("__known", F.lit(True)).hint("merge")
    new = new.repartition(*EDGE_KEY)  # one shuffle for both joins; proposals may come from a single file
    first = new.groupBy(*EDGE_KEY).agg(F.min("id").alias("__first"))
    return (new.join(known, EDGE_KEY, "left").join(first.hint("merge"), EDGE_KEY)
            .withColumn("duplicate", F.when(F.col("__known"), "existing")
                        .when(F.col("id") > F.col("__first"), "batch"))
            .drop("__known", "__first"))


def orphans(skills: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Q4: active concepts that are no root and have no active parent."""
    from lexigraph.operators.graph import hierarchy

    children = hierarchy(edges).select(F.col("child_id").alias("id"))
    return (skills.filter("status = 'active'").join(roots.select("id"), "id", "left_anti")
            .join(children, "id", "left_anti"))


def alias_conflicts(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Q5: the same form and locale on more than one active concept."""
    act = skills.filter("status = 'active'").select(F.col("id").alias("skill_id"))
    return (aliases.join(act, "skill_id", "left_semi").groupBy(F.lower("surface_form").alias("form"), "locale")
            .agg(F.count_distinct("skill_id").alias("skills")).filter("skills > 1"))


def ambiguous_names(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Q6: names and aliases that lead to more than one concept and so need a qualifier."""
    names = skills.select(F.col("id").alias("skill_id"), normalized_name(F.col("canonical_name")).alias("name"))
    forms = aliases.select("skill_id", normalized_name(F.col("surface_form")).alias("name"))
    return (names.unionByName(forms).groupBy("name").agg(F.count_distinct("skill_id").alias("skills"))
            .filter("skills > 1"))


def coverage_audit(skills: DataFrame, aliases: DataFrame, locales: DataFrame) -> DataFrame:
    """Q7: active concepts without an alias in an active locale, or without a description."""
    act = skills.filter("status = 'active'")
    wanted = locales.filter("is_active").agg(F.array_sort(F.collect_set("locale")).alias("l"))
    need = act.withColumn("__l", wanted.scalar()).select("id", F.explode("__l").alias("locale"))
    have = aliases.select(F.col("skill_id").alias("id"), "locale")
    gaps = need.join(have, ["id", "locale"], "left_anti").select(
        "id", F.concat(F.lit("no alias in "), "locale").alias("problem"))
    bare = act.filter("description is null").select("id", F.lit("no description").alias("problem"))
    return gaps.unionByName(bare)


def check_evidence(results: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Q9: whether each evidence string is part of the chunk's text."""
    joined = results.join(chunks.select(*keys, "text"), list(keys), "left")
    ok = F.forall("evidence", lambda e: F.coalesce(F.contains(F.col("text"), e), F.lit(False)))
    return joined.withColumn("evidence_ok", ok).drop("text")


def validate_edges(new: DataFrame, edges: DataFrame) -> DataFrame:
    """Q8: proposed edges with the first rule each breaks (NULL if none): self, duplicate, cycle.

    Edges that are sound one by one but close a cycle together are all marked "cycle within batch".
    """
    from lexigraph.operators.graph import check_cycles, cycles

    self_edge = F.when(F.col("source_skill_id") == F.col("target_skill_id"), "self edge")
    marked = cut(check_duplicate_edges(new, edges).withColumn("__early", F.coalesce(
        self_edge, F.when(F.col("duplicate").isNotNull(), "duplicate edge"))).drop("duplicate"))
    walked = cut(check_cycles(marked.filter("__early is null"), edges).withColumn(
        "reason", F.when(F.col("cycle_path").isNotNull(), "cycle")).drop("cycle_path"))
    cols = ["source_skill_id", "target_skill_id", "relationship_type", "status"]
    sound = walked.filter("reason is null").withColumn("status", F.lit("active"))
    knots = cycles(edges.select(*cols).unionByName(sound.select(*cols)))
    ends = [knots.select(F.col("node").alias(c), F.col("component").alias(f"__{c}")) for c in cols[:2]]
    together = ((F.col("__source_skill_id") == F.col("__target_skill_id"))
                & F.col("relationship_type").isin("parent_of", "child_of"))
    late = (walked.join(ends[0], cols[0], "left").join(ends[1], cols[1], "left")
            .withColumn("reason", F.coalesce("reason", F.when(together, "cycle within batch"))))
    early = marked.filter("__early is not null").withColumn("reason", F.col("__early"))
    keep = [*new.columns, "reason"]
    return early.select(*keep).unionByName(late.select(*keep))
