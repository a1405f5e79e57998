"""Ordered work: primaries, slugs, versions, diffs, bursts and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import slug
from lexigraph.plans.scale import cut, pick_first


def enforce_primary(aliases: DataFrame, newest: Column | None = None) -> DataFrame:
    """The newest primary alias per concept and locale stays primary, the others lose the mark."""
    order = [F.col("created_at").desc() if newest is None else newest, F.col("id")]
    first = pick_first(aliases.filter("is_primary"), ["skill_id", "locale"], order).select(
        "id", F.lit(True).alias("__first"))
    return aliases.join(first, "id", "left").withColumn(
        "is_primary", F.col("is_primary") & F.coalesce("__first", F.lit(False))).drop("__first")


def unique_slugs(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Slugs for new names (id, name); the second use of a slug gets -2, the third -3, counting those in use.

    A numbered slug may be another name's own, or equal another after cutting to length; such rows go another round, against
    all slugs given out so far. A name without a Latin letter or digit gets a slug from its id.
    """
    own = F.concat(F.lit("skill-"), F.left(F.sha2("id", 256), F.lit(12)))
    left = new.withColumn("base", F.coalesce(F.nullif(slug(F.col("name")), F.lit("")), own))
    taken, done = existing.select("slug"), None
    while True:
        given = cut(_numbered(left, taken))
        first = Window.partitionBy("slug").orderBy("id")
        clash = (given.withColumn("__nth", F.row_number().over(first))
                 .join(taken.filter("slug is not null").distinct().withColumn("__there", F.lit(True)), "slug", "left"))
        again = F.coalesce("__there", F.lit(False)) | (F.col("__nth") > 1)
        fine = clash.filter(~again).drop("__nth", "__there", "base")
        done = fine if done is None else done.unionByName(fine)
        left = cut(clash.filter(again).drop("__nth", "__there", "slug"))
        if left.isEmpty():
            return done.select(*new.columns, "slug") if "slug" not in new.columns else done
        taken = taken.unionByName(fine.select("slug"))


def _numbered(based: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``slug`` to rows (id, base): the base, with a number from the second use on.

    Names are first numbered within hashed parts of their slug group, then the parts are offset by the sizes of
    those before them, so a slug that a third of all names share is not numbered in one task.
    """
    parts = 64
    based = based.withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(parts)))
    nth = F.row_number().over(Window.partitionBy("base", "__p").orderBy("id"))
    sizes = based.groupBy("base", "__p").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("base").orderBy("__p").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__start", start).drop("n")
    taken = existing.select(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias("base"),
                            F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 2).alias("no"), "slug")
    used = (taken.select("base", F.coalesce(F.expr("try_cast(no as int)"), F.lit(1)).alias("no"))
            .unionByName(existing.select(F.col("slug").alias("base"), F.lit(1).alias("no")))
            .groupBy("base").agg(F.max("no").alias("__used")))
    numbered = (based.withColumn("__n", nth).join(offsets, ["base", "__p"]).join(used, "base", "left"))
    no = F.col("__n") + F.col("__start") + F.coalesce("__used", F.lit(0))
    end = F.when(no > 1, F.concat(F.lit("-"), no.cast("string"))).otherwise("")
    room = F.lit(config.SLUG_MAX_LENGTH) - F.length(end)
    return numbered.withColumn("slug", F.concat(F.left("base", room), end)).drop("__p", "__n", "__start", "__used")


def queue_list(queue: DataFrame, status: str = "pending", category: str | None = None,
               limit: int = config.PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """Review queue, highest signals times score first, with the total number of entries."""
    kept = queue.filter(F.col("status") == status)
    if category is not None:
        kept = kept.filter(F.col("category_guess") == category)
    total = kept.agg(F.count(F.lit(1)))
    page = kept.withColumn("priority", F.round(F.col("signals_count") * F.col("llm_score"), 6)).orderBy(
        F.desc("priority"), "queue_id").offset(offset).limit(min(limit, config.PAGE_LIMIT_MAX))
    return page.withColumn("total", total.scalar())


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Of equivalent edges an active one stays before any other, then the one with the higher confidence."""
    live = [(F.col("status") == "active").desc()] if "status" in edges.columns else []
    return pick_first(edges, ["source_skill_id", "target_skill_id", "relationship_type"],
                      [*live, F.col("confidence").desc(), F.col("id")])


def assign_versions(batch: DataFrame, start: Column | int, order: tuple[str, ...] = ("ts", "entity_id", "mutation_type"),
                    parts: int = 64) -> DataFrame:
    """Consecutive versions in order, after ``start``.

    The batch is range-partitioned by the order, numbered within each partition, and every partition is offset
    by the sizes of those before it: no single task sees the whole batch.
    """
    ranged = cut(batch.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    first = F.lit(start) if isinstance(start, int) else start
    return (ranged.withColumn("__n", nth).join(F.broadcast(offsets), "__p")
            .withColumn("graph_version", first + F.col("__before") + F.col("__n")).drop("__p", "__n", "__before"))


def diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """One row per changed entity with old and new value of each changed field (NULL-safe)."""
    a = old.select(key, *[F.col(f).cast("string").alias(f"__o_{f}") for f in fields], F.lit(True).alias("__old"))
    b = new.select(key, *[F.col(f).cast("string").alias(f"__n_{f}") for f in fields], F.lit(True).alias("__new"))
    both = a.join(b, key, "full_outer")
    cells = F.filter(F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f"__o_{f}").alias("old"), F.col(f"__n_{f}").alias("new")) for f in fields]),
        lambda c: ~c["old"].eqNullSafe(c["new"]))
    kind = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "removed").otherwise("updated")
    return both.select(key, kind.alias("change"), cells.alias("changes")).filter("size(changes) > 0")


def debounce(events: DataFrame, gap_us: int = config.DEBOUNCE_MS * 1000, key: str = "entity_id",
             bucket_us: int = 86_400_000_000) -> DataFrame:
    """The last event of each burst per entity (a burst ends when the next event is more than the gap away).

    Each day of an entity is looked at on its own; only the first event of each day crosses to the day before,
    so an entity with very many events is never sorted in one task.
    """
    b = events.withColumn("__b", F.floor(F.col("ts_us") / F.lit(bucket_us)).cast("bigint"))
    heads = b.groupBy(key, "__b").agg(F.min("ts_us").alias("__first"))
    after = heads.select(key, "__b", F.lead("__first").over(Window.partitionBy(key).orderBy("__b")).alias("__after"))
    w = Window.partitionBy(key, "__b").orderBy("ts_us", "event_id")
    nxt = F.coalesce(F.lead("ts_us").over(w), F.col("__after"))
    return (b.join(after, [key, "__b"]).withColumn("__next", nxt)
            .filter(F.col("__next").isNull() | (F.col("__next") - F.col("ts_us") > gap_us))
            .drop("__b", "__after", "__next"))


def as_of(log: DataFrame, version: int) -> DataFrame:
    """The last change of each entity at or before a version; removed entities carry their last state too."""
    return log.filter(F.col("graph_version") <= version).groupBy("entity_type", "entity_id").agg(
        F.max("graph_version").alias("graph_version"),
        F.max_by("mutation_type", "graph_version").alias("mutation_type"),
        F.max_by("diff_payload", "graph_version").alias("diff_payload"))


def signal_sessions(mentions: DataFrame, gap_us: int = config.SIGNAL_GAP_DAYS * 86_400_000_000,
                    threshold: int = config.SIGNAL_THRESHOLD) -> DataFrame:
    """Mentions of a form until a gap resets its counter; the counter triggers at every threshold.

    Mentions are first summed per time bucket of one gap's length (all of a bucket belongs together), before the
    shuffle; what is left to order per form is one row per bucket.
    """
    cells = mentions.groupBy("normalized_form", F.floor(F.col("ts_us") / F.lit(gap_us)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    w = Window.partitionBy("normalized_form").orderBy("b")
    new = F.coalesce((F.col("first") - F.lag("last").over(w) > gap_us).cast("int"), F.lit(0))
    told = cells.withColumn("__new", new).withColumn("session", F.sum("__new").over(w))
    return told.groupBy("normalized_form", "session").agg(
        F.sum("n").alias("mentions"), F.min("first").alias("first_us"), F.max("last").alias("last_us")).withColumn(
        "triggers", F.floor(F.col("mentions") / threshold))
