import random

from pyspark.sql import functions as F

from conftest import EDGE, edge_rows, rows
from lexigraph.operators import graph, quality


def test_ancestors_in_a_diamond_and_a_chain(spark, make_edges, make_skills):
    e = make_edges([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    seeds = spark.createDataFrame([("d",)], "id string")
    assert rows(graph.ancestors(e, seeds), "skill_id", "depth") == [("a", 2), ("b", 1), ("c", 1)]
    chain = make_edges([(f"n{i}", f"n{i + 1}") for i in range(10)])
    start = spark.createDataFrame([("n0",)], "id string")
    assert graph.descendants(chain, start, depth=10).count() == 10
    assert graph.descendants(chain, start).count() == 5
    got = graph.breadcrumbs(e, make_skills(["a", "b", "c", "d"]))
    assert ("d", "a > b > d") in rows(got, "id", "breadcrumb") and ("d", "a > c > d") in rows(got, "id", "breadcrumb")


def test_deep_chains_are_whole(spark, make_edges, make_skills):
    import pytest

    names = [f"n{i:02d}" for i in range(15)]
    chain, skills = make_edges(list(zip(names, names[1:]))), make_skills(names)
    got = {r.id: (r.length, r.truncated) for r in graph.breadcrumbs(chain, skills).collect()}
    assert got["n14"] == (15, False) and len(got) == 15
    cut_ = {r.id: (r.breadcrumb, r.truncated) for r in graph.breadcrumbs(chain, skills, depth=2).collect()}
    assert cut_["n14"] == ("n12 > n13 > n14", True) and cut_["n02"] == ("n00 > n01 > n02", False)
    roots = spark.createDataFrame([("n00",)], "id string")
    assert sum(r.nodes for r in graph.depth_histogram(chain, roots).collect()) == 14
    looped = make_edges([*zip(names, names[1:]), ("n14", "n12"), ("n00", "x"), ("n03", "x")])
    assert {r.depth: r.nodes for r in graph.depth_histogram(looped, roots).collect()}[4] == 2  # n04, and x at its deepest place
    assert graph.breadcrumbs(looped, make_skills([*names, "x"])).filter("id = 'n13'").count() >= 1
    with pytest.raises(ValueError):
        graph.ancestors(chain, roots, depth=11)


def test_cycle_checks(spark, make_edges):
    e = make_edges([("a", "b"), ("b", "c"), ("a", "d"), ("c", "d")])
    new = spark.createDataFrame(edge_rows([("b", "a"), ("c", "a"), ("b", "d"), ("d", "e")]), EDGE)
    got = {r.id.split("|", 1)[1]: r.cycle_path for r in graph.check_cycles(new, e).collect()}
    assert got["b|a"] == ["b", "a"] and got["c|a"] == ["c", "b", "a"] and got["b|d"] is None and got["d|e"] is None


def test_validate_edges_first_reason(spark, make_edges):
    e = make_edges([("a", "b")])
    new = spark.createDataFrame(edge_rows([("a", "a"), ("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("b", "c")]), EDGE)
    got = {r.id.split("|", 1)[1]: r.reason for r in quality.validate_edges(new, e).collect()}
    assert got == {"a|a": "self edge", "a|b": "duplicate edge", "b|a": "cycle", "x|y": "cycle within batch",
                   "y|x": "cycle within batch", "b|c": None}


def components(pairs):
    """Brute force: nodes that reach one another."""
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    return {(n, max(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


def test_cycles_match_brute_force(make_edges):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(45)})
    assert set(rows(graph.cycles(make_edges(pairs)), "node", "component")) == components(pairs)
    assert graph.cycles(make_edges([("a", "b"), ("b", "c")])).count() == 0


def test_folded_chains_match_brute_force(make_edges):
    """Sparse graphs: long chains between few branching nodes, loops, rings and dead ends, folded from the first round on."""
    for seed in range(3):
        rng = random.Random(seed)
        pairs, free = set(), iter(range(100, 1000))
        for _ in range(9):
            path = [rng.randrange(6), *(next(free) for _ in range(rng.randrange(9))), rng.randrange(6)]
            pairs |= set(zip(path, path[1:]))
        ring = [next(free) for _ in range(11)]
        tail = [ring[3], *(next(free) for _ in range(7))]
        pairs |= set(zip(ring, ring[1:] + ring[:1])) | set(zip(tail, tail[1:])) | {(tail[4], tail[4]), (ring[5], ring[5])}
        named = [(f"n{a:04d}", f"n{b:04d}") for a, b in sorted(pairs)]
        want = components(named)
        assert set(rows(graph.cycles(make_edges(named), strip_rounds=1), "node", "component")) == want
        assert set(rows(graph.cycles(make_edges(named)), "node", "component")) == want


def test_long_cycles_take_few_rounds(make_edges, monkeypatch):
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    names = [f"n{i:04d}" for i in range(4096)]
    ring = list(zip(names, names[1:] + names[:1]))
    # A plain ring, and one that leads through a branching node into a dead end as long.
    for pairs in (ring, [*ring, *((a + "x", b + "x") for a, b in ring[:-1]), (names[7], names[0] + "x")]):
        rounds.clear()
        got = rows(graph.cycles(make_edges(pairs)), "node", "component")
        assert got == [(n, names[-1]) for n in names] and len(rounds) <= 50


def test_expand_never_repeats_or_revives(spark, make_edges, make_skills):
    e = make_edges([("p", "x"), ("p", "y"), ("p", "old"), ("x", "k"), ("g", "p")])
    skills = make_skills(["p", "x", "y", "k", "g"]).unionByName(make_skills(["old"], "deprecated"))
    r = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.5)], "doc_id int, skill_id string, confidence double")
    got = {x.skill_id: (round(x.confidence, 4), x.expansion_type) for x in graph.expand(r, e, skills).collect()}
    assert got == {"p": (0.54, "parent"), "k": (0.54, "child")}
    deep = {x.skill_id: round(x.confidence, 4) for x in graph.expand(r, e, skills, depth=2).collect()}
    assert deep["g"] == 0.324 and graph.expand(r, e, skills, depth=0).count() == 0


def test_expanded_leaves_stay_where_they_are(spark, make_skills):
    """Leaves of one parent are listed in the last stage: no shuffle carries them. The rest is compared with all ways, one by one."""
    r = random.Random(4)
    names = [f"n{i:02d}" for i in range(40)]
    links = sorted({(names[r.randrange(12)], names[r.randrange(40)]) for _ in range(70)} - {(n, n) for n in names})
    e = spark.createDataFrame(edge_rows(links), EDGE)
    skills = make_skills(names[:33]).unionByName(make_skills(names[33:], "deprecated"))
    have = {(d, n): r.randrange(1, 9) / 8 for d in range(6) for n in r.sample(names, 5)}
    docs = spark.createDataFrame([(d, n, c) for (d, n), c in have.items()], "doc_id int, skill_id string, confidence double")
    want: dict = {}
    for (d, n), c in have.items():
        ups = [a for a, b in links if b == n]
        ways = ([(a, 0) for a in ups] + [(b, 1) for a, b in links if a == n] + [(b, 2) for a, b in links if a in ups])
        for x, kind in ways:
            if (d, x) not in have and x in names[:33]:
                want[d, x] = max(want.get((d, x), (0, -9)), (c, -kind))
    got = rows(graph.expand(docs, e, skills), "doc_id", "skill_id", "confidence", "expansion_type")
    assert got == sorted((d, x, c * 0.6, graph.EXPANSIONS[-k]) for (d, x), (c, k) in want.items())
    assert {k for *_, k in got} == set(graph.EXPANSIONS)

    star = spark.range(3000).selectExpr("concat('e', id) AS id", "'p' AS source_skill_id", "concat('k', id) AS target_skill_id",
                                        "'parent_of' AS relationship_type", "'active' AS status")
    every = star.selectExpr("target_skill_id AS id", "'active' AS status")
    docs = spark.range(200).selectExpr("id AS doc_id", "'k7' AS skill_id", "1.0D AS confidence")
    before = max(spark.sparkContext.statusTracker().getJobIdsForGroup() or [-1])
    assert graph.expand(docs, star, every).count() == 200 * 2999
    store, moved = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup():
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds if job > before else ():
            moved = max(moved, store.lastStageAttempt(stage).shuffleWriteRecords())
    assert 0 < moved < 100_000


def test_new_siblings_stay_where_they_are(spark):
    """Children of one parent are not shuffled once they are listed; those of several come once."""
    from lexigraph.operators import joins

    pairs = [("p", f"c{i:04d}") for i in range(1500)] + [("q", "x"), ("q", "y"), ("p", "y"), ("r", "y"), ("r", "z")]
    us = [(1, "c0003"), (1, "c0003"), (1, "x"), (2, "y"), (3, "p")]
    df = joins.new_siblings(spark.createDataFrame(us, "doc_id long, skill_id string"), spark.createDataFrame(pairs, "parent_id string, child_id string"))
    want = set()
    for d, s in us:
        for p in {p for p, c in pairs if c == s}:
            want |= {(d, c) for q, c in pairs if q == p and (d, c) not in us}
    assert rows(df, "doc_id", "skill_id") == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" not in plan[:plan.index("Generate")]


def test_proposals_from_one_file_are_dealt_to_all_tasks(spark, make_edges, tmp_path):
    """Proposals of a single file were joined and sorted in the tasks that read it."""
    make_edges([("R", "A"), ("A", "B")]).write.parquet(f"{tmp_path}/edges")
    make_edges([("B", "R"), ("A", "B"), ("C", "D"), ("D", "C")]).coalesce(1).write.parquet(f"{tmp_path}/new")
    e, new = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/new")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dup = quality.check_duplicate_edges(new, e)
        assert dup.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = {r.id.split("|", 1)[1]: r.reason for r in quality.validate_edges(new, e).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {"B|R": "cycle", "A|B": "duplicate edge", "C|D": "cycle within batch", "D|C": "cycle within batch"}


def test_proposals_that_share_a_start_walk_once(spark, make_edges):
    """Every proposal carried its own copy of the paths up from its start; cycles and ties stay as they were."""
    e = make_edges([("r", "b"), ("r", "a"), ("a", "x"), ("b", "x"), ("x", "y"), ("y", "x2"), ("x2", "x")])
    new = make_edges([("y", g) for g in ("r", "a", "x", "y", "z")] + [("q", "r")]).unionByName(make_edges([("r", "y")], "child_of"))
    new = new.unionByName(make_edges([("y", "r")], "requires"))
    seen = []
    real = graph.join_uneven
    graph.join_uneven = lambda df, *a: seen.append(df.count()) or real(df, *a)
    try:
        got = {r.id: r.cycle_path for r in graph.check_cycles(new, e).collect()}
    finally:
        graph.join_uneven = real
    assert seen[0] == 2  # y and q, not eight proposals
    assert got == {"parent_of|y|r": ["y", "x", "a", "r"], "parent_of|y|a": ["y", "x", "a"], "parent_of|y|x": ["y", "x"],
                   "parent_of|y|y": ["y"], "parent_of|y|z": None, "parent_of|q|r": None,
                   "child_of|r|y": ["y", "x", "a", "r"], "requires|y|r": None}


def test_expansion_deals_no_rows_by_concept(spark, make_edges, make_skills):
    """A concept found in very many documents would be one task's rows."""
    e, skills = make_edges([("a", "b"), ("a", "c"), ("x", "c"), ("c", "d")]), make_skills(["a", "b", "c", "d", "x"])
    found = spark.createDataFrame([(i, s, 1.0) for i in range(3) for s in ("b", "c", "W:unknown")], "doc_id int, skill_id string, confidence double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.expand(found, e, skills)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(skill_id#" not in plan
        assert {(r.doc_id, r.skill_id) for r in out.collect()} == {(i, s) for i in range(3) for s in ("a", "x", "d")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_listings_are_dealt_by_their_rows(spark, make_skills, monkeypatch):
    """Few bytes may stand for very many siblings: the tasks that list them follow the rows to come, not the bytes shuffled."""
    from lexigraph import config
    from lexigraph.operators import joins

    star = spark.range(3000).selectExpr("concat('e', id) AS id", "'p' AS source_skill_id", "concat('k', id) AS target_skill_id",
                                        "'parent_of' AS relationship_type", "'active' AS status").cache()
    every = star.selectExpr("target_skill_id AS id", "'active' AS status")
    docs = spark.range(64).selectExpr("id AS doc_id", "'k7' AS skill_id", "1.0D AS confidence")
    monkeypatch.setattr(config, "LISTED_TASK_ROWS", 3000, raising=False)
    for most, least in ((10_000, 30), (10, 9)):  # pages sent to all executors, pages met by parent and part
        monkeypatch.setattr(config, "LISTED_BROADCAST_ROWS", most, raising=False)
        for listed in (joins.new_siblings(docs, graph.hierarchy(star)), graph.expand(docs, star, every).filter("expansion_type = 'sibling'")):
            seen = listed.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task"), F.count("*"), F.count_distinct("doc_id", "skill_id")).first()
            assert seen[0] >= least and seen[1] == seen[2] == 64 * 2999
