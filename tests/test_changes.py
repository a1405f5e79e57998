import itertools
import random

from pyspark.sql import functions as F

from conftest import EDGE, rows
from lexigraph.operators import cooccur, discovery, metrics, mutate, windows
from lexigraph.plans.scale import nest_pages, self_pairs

ALIAS = "id string, skill_id string, surface_form string, locale string, source string, is_primary boolean"
FULL = ("id string, external_id string, canonical_name string, slug string, description string, status string, "
        "category string, path string, version int, source string")


def mentions(spark, data):
    return spark.createDataFrame([(d, s, "cv" if d % 2 else "jd") for d, s in data],
                                 "doc_id int, skill_id string, source_type string").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(doc_id)"))


def test_three_skills_make_three_pairs(spark):
    got = cooccur.document_pairs(mentions(spark, [(1, "a"), (1, "b"), (1, "c"), (1, "a")]))
    assert rows(got, "skill_a_id", "skill_b_id") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_hot_group_pairs_match_plain_ones(spark):
    d = spark.createDataFrame([(1, f"s{i:03d}") for i in range(40)] + [(2, "x"), (2, "y")], "k int, item string")
    got = rows(self_pairs(d, ["k"], "item", hot_items=10, cells=3), "k", "a", "b")
    assert got == sorted([(1, a, b) for a, b in itertools.combinations([f"s{i:03d}" for i in range(40)], 2)] + [(2, "x", "y")])


def test_counts_do_not_depend_on_the_split(spark):
    rng = random.Random(1)
    data = [(d, f"s{rng.randrange(8)}") for d in range(40) for _ in range(4)]
    whole = cooccur.cooccurrence(cooccur.document_pairs(mentions(spark, data)))
    a = cooccur.cooccurrence(cooccur.document_pairs(mentions(spark, [x for x in data if x[0] < 13])))
    b = cooccur.cooccurrence(cooccur.document_pairs(mentions(spark, [x for x in data if x[0] >= 13])))
    key = lambda df: sorted((r[0], r[1], r.co_occurrence_count, tuple(sorted(r.source_type_counts.items())),
                             r.last_seen_at, r.created_at) for r in df.collect())
    assert key(whole) == key(cooccur.merge_cooccurrence(a, b))


def test_strengthen(spark):
    c = spark.createDataFrame([("a", "b", 30), ("a", "c", 250), ("b", "c", 5)],
                              "skill_a_id string, skill_b_id string, co_occurrence_count long")
    e = spark.createDataFrame([("e1", "b", "a", "related_to", 0.5, "active", "llm_predicted", 0.5)], EDGE)
    got = {(r.skill, r.other): r for r in cooccur.strengthen(c, e).withColumnsRenamed(
        {"source_skill_id": "skill", "target_skill_id": "other"}).collect()}
    assert len(got) == 2
    assert round(got["b", "a"].weight, 6) == 0.8 and got["b", "a"].mutation_type == "edge_updated"
    assert got["a", "c"].weight == 1.0 and got["a", "c"].provenance == "empirical"


def full_skills(spark, *states):
    return spark.createDataFrame([(i, f"SK-{i}", i.upper(), i, None, s, "tool", i, 1, "curator") for i, s in states], FULL)


def test_merge_moves_everything_and_is_idempotent(spark):
    skills = full_skills(spark, ("ml", "active"), ("x", "active"), ("y", "active"), ("src", "active"), ("old", "merged"))
    aliases = spark.createDataFrame([("1", "ml", "ML", "en", "curated", True), ("2", "src", "Src", "en", "curated", True),
                                     ("3", "src", "Quelle", "de", "curated", True)], ALIAS)
    edges = spark.createDataFrame([
        ("1", "src", "x", "requires", 0.9, "active", "human_curated", 1.0),
        ("2", "ml", "x", "requires", 0.4, "active", "human_curated", 1.0),
        ("3", "src", "ml", "related_to", 0.4, "active", "human_curated", 1.0),
        ("4", "y", "src", "parent_of", 0.4, "active", "human_curated", 1.0)], EDGE)
    co = cooccur.cooccurrence(cooccur.document_pairs(mentions(
        spark, [(1, "ml"), (1, "src"), (1, "x"), (2, "src"), (2, "x"), (3, "ml"), (3, "x")])))
    merges = spark.createDataFrame([("src", "ml"), ("x", "x"), ("old", "ml"), ("gone", "ml")], "source_id string, target_id string")
    out = mutate.merge_skills(skills, aliases, edges, co, merges)
    assert rows(out.rejected, "source_id", "reason") == [("gone", "unknown concept"), ("old", "not active"), ("x", "self merge")]
    assert rows(out.tables["aliases"], "id", "skill_id", "is_primary") == [("1", "ml", True), ("2", "ml", False), ("3", "ml", True)]
    assert rows(out.tables["edges"], "source_skill_id", "target_skill_id", "relationship_type") == [
        ("ml", "x", "requires"), ("src", "ml", "superseded_by"), ("y", "ml", "parent_of")]
    assert rows(out.tables["edges"].filter("relationship_type = 'requires'"), "confidence") == [(0.9,)]
    assert rows(out.tables["co_occurrences"], "skill_a_id", "skill_b_id", "co_occurrence_count") == [("ml", "x", 4)]
    again = mutate.merge_skills(out.tables["skills"], out.tables["aliases"], out.tables["edges"],
                                out.tables["co_occurrences"], merges)
    assert again.changelog.count() == 0 and again.rejected.count() == 4


def test_deprecate_rules(spark):
    skills = full_skills(spark, ("a", "active"), ("b", "active"), ("c", "deprecated"), ("d", "active"), ("e", "active"))
    aliases = spark.createDataFrame([("1", "a", "A", "en", "curated", True), ("2", "b", "B", "en", "curated", True)], ALIAS)
    reqs = spark.createDataFrame([("a", ["b"]), ("d", ["c"]), ("c", ["b"]), ("e", []), ("zz", ["b"])],
                                 "skill_id string, successor_ids array<string>")
    out = mutate.deprecate(skills, aliases, spark.createDataFrame([], EDGE), reqs)
    assert rows(out.rejected) == [("c", "not active"), ("d", "successor is retired"), ("e", "no successor"), ("zz", "unknown concept")]
    assert rows(out.tables["edges"], "source_skill_id", "target_skill_id") == [("a", "b")]
    assert rows(out.tables["aliases"], "id", "skill_id", "is_primary") == [("1", "b", False), ("2", "b", True)]
    versions = rows(mutate.record([out.changelog], 7), "graph_version")
    assert versions == [(8 + i,) for i in range(len(versions))]


def test_routes_at_the_thresholds(spark):
    v = spark.createDataFrame([("a", "duplicate"), ("b", "review"), ("c", "unique")], "query_id string, verdict string")
    assert rows(discovery.route_candidates(v), "query_id", "route") == [("a", "alias"), ("b", "review"), ("c", "new")]
    assert rows(metrics.discovery_summary(discovery.route_candidates(v))) == [(3, 2, 1)]


def test_queue_add_twice_counts_up(spark):
    q = spark.createDataFrame([], "queue_id string, candidate_name string, normalized_name string, category_guess string, "
                              "signals_count bigint, llm_score double, similar_existing array<string>, "
                              "suggested_parents array<string>, status string")
    c = spark.createDataFrame([("LangGraph", "tool", 0.9, [], []), (" langgraph ", "tool", 0.8, [], [])],
                              "candidate_name string, category_guess string, llm_score double, "
                              "similar_existing array<string>, suggested_parents array<string>")
    once = discovery.queue_add(q, c)
    assert rows(discovery.queue_add(once, c), "normalized_name", "signals_count") == [("langgraph", 4)]


def events(spark, times, key="k"):
    return spark.createDataFrame([(i, key, t) for i, t in enumerate(times)], "event_id int, entity_id string, ts_us bigint")


def test_bursts_and_rates_match_brute_force(spark):
    rng = random.Random(2)
    times = sorted(rng.randrange(0, 3_000) for _ in range(300))
    ev = events(spark, times)
    last = [i for i, t in enumerate(times) if i + 1 == len(times) or times[i + 1] - t > 15]
    assert [r[0] for r in rows(windows.debounce(ev, 15, bucket_us=100), "event_id")] == last
    log = ev.withColumnRenamed("entity_id", "key")
    calls = {i: sum(1 for u in times if t - 60 <= u <= t) for i, t in enumerate(times)}
    got = dict(rows(metrics.rate_violations(log, 6, window_us=60, per_bucket=4), "event_id", "calls"))
    assert got == {i: n for i, n in calls.items() if n > 6}


def test_sessions_match_brute_force(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 5_000) for _ in range(200))
    want, n, prev = [], 0, None
    for t in times:
        if prev is not None and t - prev > 40:
            want.append(n)
            n = 0
        n, prev = n + 1, t
    want.append(n)
    ev = events(spark, times).withColumnRenamed("entity_id", "normalized_form")
    got = windows.signal_sessions(ev, 40, 5).orderBy("session").collect()
    assert [r.mentions for r in got] == want and [r.triggers for r in got] == [x // 5 for x in want]


def test_pages_hold_everything(spark):
    d = spark.createDataFrame([("hub", i) for i in range(95)] + [("leaf", 1)], "k string, v int")
    got = nest_pages(d, ["k"], F.col("v"), "vs", page_rows=10).collect()
    assert sorted(v for r in got if r.k == "hub" for v in r.vs) == list(range(95))
    assert [r.page for r in got if r.k == "leaf"] == [0] and len({r.page for r in got if r.k == "hub"}) > 5


def test_evaluation(spark):
    s = "doc_id int, skill_id string"
    pred, gold = spark.createDataFrame([(1, "a"), (1, "b")], s), spark.createDataFrame([(1, "a"), (2, "c")], s)
    r = metrics.evaluate(pred, gold).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1, r.passed) == (1, 1, 1, 0.5, 0.5, 0.5, False)


REQ = "req_id string, name string, description string, category string, source string"


def test_no_request_is_lost(spark):
    reqs = spark.createDataFrame([("1", "Web", None, "tool", "c"), ("2", "Web", None, "tool", "c"), ("3", "Web 2", None, "tool", "c"),
                                  ("4", None, None, "tool", "c"), ("5", " ", None, "tool", "c"), ("6", "日本語", None, None, "c"),
                                  ("7", "x" * 300, None, None, "c"), ("8", "Gadget", None, "nonsense", "c")], REQ)
    none = spark.createDataFrame([], FULL)
    out = mutate.create_skills(none, spark.createDataFrame([], ALIAS), reqs)
    assert out.extra["skills"].count() + out.rejected.count() == 8
    slugs = [r.slug for r in out.extra["skills"].collect()]
    assert len(set(slugs)) == len(slugs) == 4 and {"web", "web-2"} < set(slugs) and all(slugs)
    assert {r.req_id for r in out.rejected.collect()} == {"4", "5", "7", "8"}


def test_slugs_are_unique_against_those_in_use(spark):
    have = spark.createDataFrame([("web",), ("web-3",), (None,)], "slug string")
    new = spark.createDataFrame([("a", "Web"), ("b", "Web 3"), ("c", "Web 4"), ("d", "Web")], "id string, name string")
    got = [r.slug for r in windows.unique_slugs(new, have).collect()]
    assert len(set(got)) == 4 and not {"web", "web-3"} & set(got)


def test_alias_ops_keep_one_primary(spark):
    al = spark.createDataFrame([("a1", "s", "one", "en", "curated", True), ("a2", "s", "two", "en", "curated", False),
                                ("s|en|three", "s", "three", "en", "curated", False)], ALIAS)
    ops = spark.createDataFrame(
        [("1", "add", None, "s", "three", "en", False), ("2", "update", "a1", None, None, None, False), ("3", "update", "zz", None, "q", None, None),
         ("4", "add", None, "s", "four", "en", False), ("5", "add", None, "s", "four", "en", False), ("6", "add", None, "s", None, "en", False)],
        "op_id string, op string, alias_id string, skill_id string, surface_form string, locale string, is_primary boolean")
    out = mutate.apply_alias_ops(al, ops)
    assert rows(out.rejected, "op_id", "reason") == [("1", "alias exists"), ("2", "last primary alias"), ("3", "unknown alias"),
                                                    ("5", "alias exists"), ("6", "form is missing")]
    left = out.tables["aliases"].collect()
    assert len(left) == len({r.id for r in left}) == 4 and sum(r.is_primary for r in left) == 1
    # A new primary may take over in the same batch.
    take = spark.createDataFrame([("1", "update", "a1", None, None, None, False), ("2", "update", "a2", None, None, None, True)], ops.schema)
    out = mutate.apply_alias_ops(al, take)
    assert out.rejected.count() == 0 and [r.id for r in out.tables["aliases"].collect() if r.is_primary] == ["a2"]


def test_merge_that_closes_a_cycle(spark, make_edges, make_skills):
    cooc = spark.createDataFrame([], "skill_a_id string, skill_b_id string, co_occurrence_count long, source_type_counts map<string,long>, "
                                     "last_seen_at timestamp_ntz, created_at timestamp_ntz")
    merges = spark.createDataFrame([("c", "a"), ("e", "d")], "source_id string, target_id string")
    al = spark.createDataFrame([("x", "e", "eee", "en", "curated", True)], ALIAS)
    out = mutate.merge_skills(make_skills(list("abcde")), al, make_edges([("a", "b"), ("b", "c"), ("a", "d"), ("a", "e")]), cooc, merges)
    assert rows(out.rejected, "source_id", "reason") == [("c", "closes a cycle")]
    assert {r.id: r.status for r in out.tables["skills"].collect()}["c"] == "active"
    assert {"alias_removed", "alias_added"} <= {r.mutation_type for r in out.changelog.collect()}


def test_decisions_are_applied_once(spark, make_skills, make_edges):
    queue = spark.createDataFrame([("q1", "New  Tool", "new tool", "tool", 3, 0.5, [], ["p", "gone"], "pending"),
                                   ("q2", "Other", "other", "tool", 3, 0.5, [], [], "pending"),
                                   ("q3", None, "nameless", "tool", 3, 0.5, [], [], "pending")],
                                  "queue_id string, candidate_name string, normalized_name string, category_guess string, signals_count long, "
                                  "llm_score double, similar_existing array<string>, suggested_parents array<string>, status string")
    skills = spark.createDataFrame([("p", "SK-p", "p", "p", None, "active", "tool", "p", 1, "curator")], FULL)
    dec = spark.createDataFrame([("q1", "approve", None, "a"), ("q2", "approve", None, "b"), ("q2", "reject", None, "c"), ("q3", "approve", None, "d")],
                                "queue_id string, decision string, merge_target_id string, notes string")
    out = discovery.decide(queue, skills, spark.createDataFrame([], ALIAS), spark.createDataFrame([], EDGE), dec)
    state = rows(out.tables["queue"], "queue_id", "status")
    assert state == [("q1", "approved"), ("q2", "approved"), ("q3", "pending")]
    assert rows(out.rejected, "queue_id", "reason") == [("q2", "decided twice"), ("q3", "name is empty")]
    assert rows(out.extra["edges"], "source_skill_id") == [("p",)]
    assert rows(out.extra["rejected_edges"], "parent_id") == [("gone",)] and out.extra["activations"].count() == 2


def test_cost_means_follow_the_calendar(spark):
    day = 86_400_000_000
    log = spark.createDataFrame([(0, 7.0), (60 * day, 1.0), (61 * day, 2.0)], "ts_us long, cost double").withColumn("ts", F.timestamp_micros("ts_us"))
    got = {r.day: (r.mean_before, r.alert) for r in metrics.cost_alerts(log).collect()}
    assert got["1970-01-01"] == (None, False) and got["1970-03-02"] == (0.0, True) and got["1970-03-03"] == (round(1 / 7, 4), True)


def test_names_are_cleaned_once(spark, make_skills):
    """One Python step a stage: cleaned names are stored before slugs are made of them."""
    reqs = spark.createDataFrame([("1", " <b>Rust</b> ", None, "tool", "x"), ("2", "<i></i>", None, "tool", "x")],
                                 "req_id string, name string, description string, category string, source string")
    made = mutate.create_skills(make_skills(["Rust"]), spark.createDataFrame([], ALIAS), reqs)
    assert rows(made.extra["skills"], "canonical_name", "slug") == [("Rust", "rust-2")]
    assert rows(made.rejected) == [("2", "name is empty")]
    assert "EvalPython" not in made.rejected._jdf.queryExecution().optimizedPlan().toString()


def test_forms_of_a_log_row_are_read_without_lambdas(spark):
    from lexigraph.operators import joins

    logs = spark.createDataFrame([(1, "h", 5, [("A", "a"), ("a", "a"), ("B", "b")]), (2, "i", 6, []), (3, "j", 7, None)],
                                 "log_id int, document_hash string, created_at int, discovered_candidates array<struct<surface_form:string,normalized_form:string>>")
    df = joins.candidate_forms(logs)
    assert rows(df, "log_id", "normalized_form") == [(1, "a"), (1, "b")]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
