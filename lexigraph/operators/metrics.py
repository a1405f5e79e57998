"""Growth, coverage, quality, cost and load metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.plans.scale import broadcast_if_small, cut

DAY = "date_format(ts, 'yyyy-MM-dd')"


def signals(mentions: DataFrame, recent_from: str) -> DataFrame:
    """A3: per form the frequency, source diversity and growth (recent mentions over earlier ones)."""
    recent = F.col("ts") >= F.expr(f"timestamp_ntz'{recent_from}'")
    return mentions.groupBy("normalized_form").agg(
        F.count(F.lit(1)).alias("frequency"), F.count_distinct("source").alias("sources"),
        F.count_if(recent).alias("recent"), F.count_if(~recent).alias("earlier")).withColumn(
        "velocity", F.when(F.col("earlier") > 0, F.round(F.col("recent") / F.col("earlier"), 6)))


def daily_velocity(mentions: DataFrame) -> DataFrame:
    """Mentions per form and calendar day (batch twin of the streaming T11)."""
    return mentions.groupBy("normalized_form", F.expr(DAY).alias("day")).agg(F.count(F.lit(1)).alias("mentions"))


def version_info(log: DataFrame, skills: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """A4: one row: version, last change and active counts; version 0 for an empty log."""
    top = log.agg(F.coalesce(F.max("graph_version"), F.lit(0)).alias("graph_version"), F.max("ts").alias("last"))
    n_skills = skills.filter("status = 'active'").agg(F.count(F.lit(1)))
    n_edges = edges.filter("status = 'active'").agg(F.count(F.lit(1)))
    n_aliases = aliases.agg(F.count(F.lit(1)))
    n_locales = aliases.agg(F.count_distinct("locale"))
    return top.select(
        "graph_version", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_mutation_at"),
        n_skills.scalar().alias("total_skills"), n_edges.scalar().alias("total_edges"),
        n_aliases.scalar().alias("total_aliases"), n_locales.scalar().alias("supported_locales"))


def locale_coverage(skills: DataFrame, aliases: DataFrame, locales: DataFrame, least: float = 0.8) -> DataFrame:
    """A5: share of active concepts with a primary alias, per locale."""
    act = skills.filter("status = 'active'").select(F.col("id").alias("skill_id"))
    total = act.agg(F.count(F.lit(1)))
    n = (aliases.filter("is_primary").join(act, "skill_id", "left_semi").groupBy("locale")
         .agg(F.count_distinct("skill_id").alias("covered")))
    share = F.round(F.coalesce("covered", F.lit(0)) / total.scalar(), 6)
    return (locales.join(n, "locale", "left").select("locale", "is_active", share.alias("coverage"))
            .withColumn("alert", F.col("is_active") & (F.col("coverage") < least)))


def growth(skills: DataFrame, factor: float = 2.0) -> DataFrame:
    """New concepts per week (gaps filled) against the mean of the four weeks before."""
    weekly = skills.groupBy(F.date_trunc("week", "created_at").alias("week")).agg(F.count(F.lit(1)).alias("added"))
    span = weekly.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    calendar = span.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    filled = calendar.join(weekly, "week", "left").fillna(0, ["added"])
    # One row per calendar week: a single ordered window over them is small whatever the table size.
    before = Window.orderBy("week").rowsBetween(-4, -1)
    return filled.withColumn("mean_before", F.round(F.avg("added").over(before), 6)).withColumn(
        "alert", F.coalesce(F.col("added") > F.col("mean_before") * factor, F.lit(False)))


def source_share(skills: DataFrame, least: float = 0.1) -> DataFrame:
    """Share of concepts added by curators and by models."""
    share = lambda s: F.round(F.avg((F.col("source") == s).cast("int")), 6)
    return skills.agg(share("curator").alias("curator_share"), share("llm_discovered").alias("llm_share")) \
        .withColumn("alert", F.col("curator_share") < least)


def match_coverage(results: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Share of mentions that map to a concept, and the mean confidence, with their alerts."""
    n = unmatched.agg(F.count(F.lit(1)))
    return results.agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg("confidence"), 4).alias("mean_confidence")) \
        .withColumn("unmatched", n.scalar()).withColumn(
        "coverage", F.round(F.col("matched") / (F.col("matched") + F.col("unmatched")), 6)).withColumns({
            "on_target": F.col("coverage") > 0.95, "coverage_alert": F.col("coverage") < 0.8,
            "confidence_alert": F.col("mean_confidence") < 0.6})


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def evaluate(pred: DataFrame, gold: DataFrame, per: list[str] | None = None) -> DataFrame:
    """A10: precision, recall and F1 over (doc_id, skill_id), in all or per given column of both inputs."""
    keys = ["doc_id", "skill_id", *[c for c in (per or []) if c != "doc_id"]]
    both = (pred.select(*keys).distinct().withColumn("p", F.lit(1))
            .join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full_outer"))
    sums = both.groupBy(*(per or [])).agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = sums.withColumns({"precision": F.round(_ratio(tp, tp + fp), 6), "recall": F.round(_ratio(tp, tp + fn), 6),
                               "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6)})
    return scored.withColumn("passed", (F.col("f1") >= config.GOLDEN_MIN_F1)
                             & (F.col("precision") >= config.GOLDEN_MIN_PRECISION)
                             & (F.col("recall") >= config.GOLDEN_MIN_RECALL))


def regression(history: DataFrame, most: float = 0.01) -> DataFrame:
    """Change of F1 from release to release; a drop over the limit fails (one row per release)."""
    last = F.lag("f1").over(Window.orderBy("release"))
    return history.withColumn("drop", F.round(last - F.col("f1"), 6)).withColumn(
        "passed", F.coalesce(F.col("drop") <= most, F.lit(True)))


def cube_rows(log: DataFrame, by: list[str], *carry: str) -> DataFrame:
    """Each row once for every subset of ``by``: its key ``__g`` (NULL where a column is rolled up; ``__set`` tells which) and ``carry``."""
    keys = [F.struct(F.lit(s).alias("__set"), *[(F.col(c) if s >> k & 1 else F.lit(None).cast(log.schema[c].dataType)).alias(c) for k, c in enumerate(by)])
            for s in range(1 << len(by))]
    return log.select(F.explode(F.array(*keys)).alias("__g"), *carry)


def exact_quantiles(rows: DataFrame, points: tuple[float, ...], value: str = "latency", buckets: int = 1024) -> DataFrame:
    """``__g`` and ``q`` (an array, one value a point; between two ranks by proportion) of every group of ``rows(__g, value)``.

    Rank selection by histograms: a round counts the values of each group in buckets of the intervals that hold a wanted
    rank, and keeps of each the bucket the rank falls into, until its values are all equal. A task holds buckets, never a
    group's values; an interval shrinks by the number of buckets each round.
    """
    rows = rows.select("__g", F.col(value).cast("double").alias("__v")).filter("__v is not null")
    whole = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("__n") - 1)).alias("at")) for i, p in enumerate(points)])
    asked = whole.withColumn("__w", F.explode(wanted)).withColumn("__rank", F.explode(F.array(F.floor("__w.at"), F.ceil("__w.at"))))
    ranks = cut(asked.select("__g", "__rank", "__lo", "__hi", F.lit(0).cast("bigint").alias("__before")).distinct())
    spots = cut(asked.select("__g", "__w.i", "__w.at").distinct())
    while not ranks.filter("__lo < __hi").isEmpty():
        open_ = ranks.filter("__lo < __hi").select("__g", "__lo", "__hi", "__before").distinct()
        # The largest value has a bucket of its own, so that every interval gets smaller.
        place = F.when(F.col("__v") == F.col("__hi"), F.lit(buckets)).otherwise(
            F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets), F.lit(buckets - 1)))
        counts = (rows.join(broadcast_if_small(open_), "__g").filter("__v between __lo and __hi")
                  .groupBy("__g", "__lo", "__hi", "__before", place.alias("__b"))
                  .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__first"), F.max("__v").alias("__last")))
        w = Window.partitionBy("__g", "__lo", "__hi").orderBy("__b")
        upto = counts.withColumn("__upto", F.col("__before") + F.sum("__c").over(w)).drop("__before")
        found = ranks.drop("__before").filter("__lo < __hi").join(upto, ["__g", "__lo", "__hi"]).filter("__rank < __upto and __rank >= __upto - __c")
        ranks = cut(ranks.filter("__lo = __hi").unionByName(found.select(
            "__g", "__rank", F.col("__first").alias("__lo"), F.col("__last").alias("__hi"), (F.col("__upto") - F.col("__c")).alias("__before"))))
    low, high = (ranks.select("__g", F.col("__rank").alias(f"__{x}"), F.col("__lo").alias(x)) for x in ("a", "b"))
    both = (spots.withColumns({"__a": F.floor("at"), "__b": F.ceil("at")}).join(low, ["__g", "__a"]).join(high, ["__g", "__b"])
            .select("__g", F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("__a"))).alias("x")).alias("q")))
    return both.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["x"]).alias("q"))


def log_metrics(log: DataFrame, by: list[str], exact: bool = True, load: bool = False) -> DataFrame:
    """Latency percentiles, error rate and load by every combination of the given columns.

    With ``load`` also what the log has columns for: requests a minute between the first and the last (``ts_us``; NULL for a single
    moment), the share of ``cache_hit``, and sums of ``input_tokens`` and ``output_tokens``.
    """
    minutes = (F.max("ts_us") - F.min("ts_us")) / F.lit(60e6)
    more = {"ts_us": F.round(F.when(minutes > 0, F.count(F.lit(1)) / minutes), 6).alias("per_minute"),
            "cache_hit": F.round(F.avg(F.col("cache_hit").cast("int")), 6).alias("cache_hit_ratio"),
            "input_tokens": F.sum("input_tokens").alias("input_tokens"), "output_tokens": F.sum("output_tokens").alias("output_tokens")}
    has = [c for c in more if load and c in log.columns]
    rows = cube_rows(log, by, "latency", "failed", *has)
    points = (0.5, 0.95, 0.99)
    sums = [F.count(F.lit(1)).alias("requests"), F.round(F.avg(F.col("failed").cast("int")), 6).alias("error_rate"), *[more[c] for c in has]]
    if exact:
        q = exact_quantiles(rows, points).withColumnRenamed("__g", "__h")
        out = rows.groupBy("__g").agg(*sums).join(q, F.col("__g").eqNullSafe(F.col("__h")), "left")
    else:
        out = rows.groupBy("__g").agg(*sums, F.percentile_approx("latency", list(points), 10_000).alias("q"))
    extra = [c for c in out.columns if c not in ("__g", "__h", "q", "requests", "error_rate")]
    return out.select(*[F.col(f"__g.{c}").alias(c) for c in by], "requests",
                      *[F.round(F.col("q")[i], 4).alias(f"p{round(100 * p)}") for i, p in enumerate(points)], "error_rate", *extra)


def cost_alerts(log: DataFrame, factor: float = 1.2) -> DataFrame:
    """Cost per day against the mean of the seven calendar days before (one row per day).

    A day without cost counts as zero; before the first week is over the mean is that of the days since the first.
    """
    daily = log.groupBy(F.expr(DAY).alias("day")).agg(F.round(F.sum("cost"), 4).alias("cost"))
    daily = daily.withColumn("__n", F.datediff(F.to_date("day"), F.lit("1970-01-01").cast("date")))
    before = Window.orderBy("__n").rangeBetween(-7, -1)
    age = F.col("__n") - F.min("__n").over(Window.orderBy("__n").rangeBetween(Window.unboundedPreceding, 0))
    mean = F.when(age > 0, F.coalesce(F.sum("cost").over(before), F.lit(0.0)) / F.least(age, F.lit(7)))
    return daily.withColumn("mean_before", F.round(mean, 4)).withColumn(
        "alert", F.coalesce(F.col("cost") > F.col("mean_before") * factor, F.lit(False))).drop("__n")


def job_status(documents: DataFrame) -> DataFrame:
    """Progress of each batch job from the status of its documents (queued, completed or failed)."""
    n = F.count(F.lit(1))
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    s = documents.groupBy("job_id").agg(n.alias("total"), done.alias("completed"), failed.alias("failed"))
    ended = F.col("completed") + F.col("failed")
    status = (F.when(ended == 0, "queued").when(ended < F.col("total"), "processing")
              .when(F.col("failed") > 0, "partial_failure").otherwise("completed"))
    return s.withColumn("progress_pct", F.round(ended * 100 / F.col("total"), 4)).withColumn("status", status)


def over_limit(limit: int | dict[str, int] | None, calls: str = "calls") -> Column:
    """Whether a count is over the limit; with a dict by ``request_class`` (an unknown class has the lowest of them)."""
    limit = config.RATE_LIMITS if limit is None else limit
    if isinstance(limit, int):
        return F.col(calls) > limit
    table = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
    return F.col(calls) > F.coalesce(F.try_element_at(table, F.col("request_class")), F.lit(min(limit.values())))


def rate_violations(log: DataFrame, limit: int | dict[str, int] | None = None, window_us: int = 60_000_000,
                    per_bucket: int = 16) -> DataFrame:
    """Calls above the limit within a sliding window, per key (and request class, if limits go by class).

    Time is cut into buckets of several windows and each call is also handed to the next bucket if it may count
    there, so the calls of one busy key are spread over its buckets instead of sorted in one task.
    """
    keys = ["key"] if isinstance(limit, int) else ["key", "request_class"]
    width = window_us * per_bucket
    bucket = F.floor(F.col("ts_us") / F.lit(width)).cast("bigint")
    late = F.col("ts_us") >= (bucket + 1) * width - window_us
    spread = log.withColumn("__b", F.explode(F.when(late, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    w = Window.partitionBy(*keys, "__b").orderBy("ts_us").rangeBetween(-window_us, 0)
    counted = spread.withColumn("calls", F.count(F.lit(1)).over(w))
    own = F.floor(F.col("ts_us") / F.lit(width)).cast("bigint") == F.col("__b")
    return counted.filter(own & over_limit(limit)).drop("__b")


def discovery_summary(routed: DataFrame) -> DataFrame:
    """What became of the discovered candidates."""
    return routed.agg(F.count(F.lit(1)).alias("candidates_found"),
                      F.count_if(F.col("route") != "alias").alias("added_to_queue"),
                      F.count_if(F.col("route") == "alias").alias("auto_aliased"))
