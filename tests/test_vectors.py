import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lexigraph.functions import vectors
from lexigraph.operators import search


def frame(spark, m, key="id", prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:03d}", [float(x) for x in r]) for i, r in enumerate(m)],
                                 f"{key} string, embedding array<float>")


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])],
                              "a array<float>, b array<float>")
    assert [r[0] for r in d.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


@pytest.mark.parametrize("way", ["broadcast", "blocks"])
def test_nearest_is_exact(spark, monkeypatch, way):
    rng = np.random.default_rng(3)
    m, q = rng.normal(size=(60, 8)), rng.normal(size=(25, 8))
    m[7] = m[3]
    if way == "blocks":
        monkeypatch.setattr(vectors, "BROADCAST_MAX_VALUES", 8)
    got = vectors.nearest(frame(spark, q, "query_id", "q"), frame(spark, m), 4, block_rows=16)
    m32, q32 = m.astype("float32").astype(float), q.astype("float32").astype(float)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(q32) @ unit(m32).T, 6)
    want = sorted((f"q{i:03d}", f"v{j:03d}", r + 1) for i in range(25)
                  for r, j in enumerate(sorted(range(60), key=lambda j: (-s[i, j], j))[:4]))
    assert rows(got, "query_id", "id", "rank") == want


def test_similar_pairs_links_copies_once(spark):
    m = np.eye(6)[[0, 0, 0, 1, 2]] + 0.0
    m[4] = [0.8, 0.6, 0, 0, 0, 0]
    got = rows(search.similar_pairs(frame(spark, m)), "skill_a_id", "skill_b_id", "relation")
    assert got == [("v000", "v001", "identical"), ("v000", "v002", "identical"), ("v000", "v004", "related_medium")]


def test_trigram_prefix_filter_loses_nothing(spark):
    words = ["machine learning", "mahcine lerning", "machines", "learning machine", "python", "pyton", "pythons", "c",
             "deep learning", "data science", "date science"]
    q = spark.createDataFrame([(w,) for w in words], "q string")
    f = spark.createDataFrame([(w,) for w in words], "form string")

    def grams(s):
        return {("  " + w + " ")[i:i + 3] for w in s.split() for i in range(len(w) + 1)}

    for t in (0.2, 0.3, 0.6):
        want = {(a, b) for a in words for b in words
                if round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6) >= t}
        assert set(rows(search.trigram_matches(q, f, t), "q", "form")) == want


def test_keyword_search_tiers(spark):
    skills = spark.createDataFrame(
        [("1", "Machine Learning", "active", "domain", "learn from data"), ("2", "Python", "active", "tool", None),
         ("3", "Pythonic", "retired", "tool", None)],
        "id string, canonical_name string, status string, category string, description string")
    aliases = spark.createDataFrame([("1", "ML")], "skill_id string, surface_form string")
    q = spark.createDataFrame([(x,) for x in ("machine learning", "ml", "pyth", "mahcine lerning", "data", "")], "q string")
    got = {r.q: (r.id, r.score, r.highlight) for r in search.keyword_search(q, skills, aliases).collect()}
    assert got["machine learning"][:2] == ("1", 5) and got["ml"][:2] == ("1", 4)
    assert got["pyth"] == ("2", 3, "<mark>Pyth</mark>on") and got["mahcine lerning"][:2] == ("1", 2)
    assert got["data"][:2] == ("1", 1) and "" not in got
    assert search.keyword_search(q, skills, aliases, category="tool").select("id").distinct().count() == 1


def test_fusion(spark):
    kw = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    se = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, id string, rank int")
    got = search.hybrid_search(kw, se).orderBy("rank").collect()
    assert [(r.id, r.match_type) for r in got] == [("b", "both"), ("a", "keyword"), ("c", "semantic")]
    assert abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-8


def test_chunk_without_vector_uses_keywords(spark):
    skills = spark.createDataFrame([("s1", "x1", "Red Ring", None, "active", [1.0, 0.0]), ("s2", "x2", "Blue Rod", None, "active", [0.0, 1.0])],
                                   "id string, external_id string, canonical_name string, description string, status string, embedding array<float>")
    chunks = spark.createDataFrame([("c1", "any", [1.0, 0.1]), ("c2", "a blue thing", None)],
                                   "query_id string, text string, embedding array<float>")
    got = rows(search.candidates(chunks, skills, 5, skills), "query_id", "id")
    assert got == [("c1", "s1"), ("c1", "s2"), ("c2", "s2")]


def test_equal_vectors_give_k_rows_a_block():
    from lexigraph.functions.vectors import _Side

    side = _Side([f"i{n:04d}" for n in range(2000)], np.ones((2000, 2)) / np.sqrt(2))
    got = side.best(["i0003", "zz"], np.ones((2, 2)) / np.sqrt(2), 5, None, exclude_self=True)
    assert got[got.query_id == "i0003"].id.tolist() == ["i0000", "i0001", "i0002", "i0004", "i0005"] and len(got) == 10
    later = side.best(["i1997"], np.ones((1, 2)) / np.sqrt(2), None, 0.5, exclude_self=True, later=True)
    assert later.id.tolist() == ["i1998", "i1999"]


def test_typos_match_brute_force(spark):
    words = ["python", "pyton", "javascript", "machine learning", "mahcine lerning", "c", "go", "rust", "rest", "docker", "dokcer", "sql"]
    q = spark.createDataFrame([(w,) for w in (*words, "pyhton", "machne learnin")], "q string")
    forms = spark.createDataFrame([(w,) for w in words], "form string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    slack = lambda s: sum(2 if len(w) >= 5 else 1 if len(w) >= 3 else 0 for w in s.split())
    want = sorted((a, b) for a in (*words, "pyhton", "machne learnin") for b in words if slack(a) and distance(a, b) <= slack(a))
    assert rows(search.typo_matches(q, forms), "q", "form") == want and ("pyhton", "python") in want


@pytest.mark.parametrize("k,least", [(3, None), (None, 0.9), (2, 0.95)])
def test_cells_prune_and_lose_nothing(spark, monkeypatch, k, least):
    """Clustered vectors, copies of one, a zero vector: results of brute force, and few of all pairs are compared."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centres] + [np.tile(centres[0], (50, 1)), np.zeros((1, 16))]).astype("float32")
    q = np.concatenate([c + 0.05 * rng.normal(size=(5, 16)) for c in centres] + [np.zeros((1, 16)), rng.normal(size=(2, 16))]).astype("float32")
    monkeypatch.setattr(vectors, "BROADCAST_MAX_VALUES", 1024)
    pairs = []
    whole = vectors._meet_in_cells

    def counted(asked, placed, cells, match, block_rows):
        pairs.append(sum(int(cells.sizes[r["cell"]]) for r in asked.select("cell").collect()))
        return whole(asked, placed, cells, match, block_rows)

    monkeypatch.setattr(vectors, "_meet_in_cells", counted)
    got = vectors.nearest(frame(spark, q, "query_id", "q"), frame(spark, m), k, least, block_rows=32)
    with np.errstate(invalid="ignore"):
        unit = lambda x: x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        s = np.round(unit(q) @ unit(m).T, 6)
    want = []
    for i in range(len(q)):
        order = [j for j in sorted(range(len(m)), key=lambda j: (-s[i, j], f"v{j:03d}")) if s[i, j] >= (-2 if least is None else least)]
        want += [(f"q{i:03d}", f"v{j:03d}", float(s[i, j])) for j in order[:k]]
    assert rows(got, "query_id", "id", "similarity") == sorted(want)
    assert sum(pairs) < 0.35 * len(q) * len(m)


def test_bound_of_a_cell_holds():
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    m, q, c = unit(rng.normal(size=(300, 5))), unit(rng.normal(size=(200, 5))), unit(rng.normal(size=(9, 5)))
    cells = vectors.Cells(c, np.zeros(9), np.zeros(9))
    angles = cells.angles(m)
    home = angles.argmin(axis=1)
    cells.sizes = np.bincount(home, minlength=9)
    cells.radii = np.array([angles[home == i, i].max() if (home == i).any() else 0 for i in range(9)])
    best = np.stack([(q @ m[home == i].T).max(axis=1) if (home == i).any() else np.full(200, -np.inf) for i in range(9)], axis=1)
    assert (cells.bounds(cells.angles(q)) >= best).all()
    near = cells.near(cells.angles(q), 60)
    assert ((near * cells.sizes).sum(axis=1) >= 60).all()


@pytest.mark.parametrize("own", [False, True])
def test_copies_meet_once_and_spread_vectors_meet_in_blocks(spark, monkeypatch, own):
    """Bounds leave out nothing among random vectors: queries are not sent to every cell, copies not compared again."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 16)).astype("float32")
    m = base[np.arange(1000) % 200]
    q = m[:300] if own else m[100:400]
    monkeypatch.setattr(vectors, "BROADCAST_MAX_VALUES", 1024)
    asked, whole = [], vectors._meet_in_cells

    def counted(asks, placed, cells, match, block_rows):
        asked.append(asks.count())
        return whole(asks, placed, cells, match, block_rows)

    monkeypatch.setattr(vectors, "_meet_in_cells", counted)
    got = vectors.nearest(frame(spark, q, "query_id", "v"), frame(spark, m), 7, exclude_self=own, block_rows=64)
    unit = lambda x: x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(m).T, 6)
    want = []
    for i in range(len(q)):
        order = sorted((j for j in range(len(m)) if not (own and i == j)), key=lambda j: (-s[i, j], f"v{j:03d}"))
        want += [(f"v{i:03d}", f"v{j:03d}", r + 1) for r, j in enumerate(order[:7])]
    assert rows(got, "query_id", "id", "rank") == sorted(want)
    assert sum(asked) < 3 * 200


@pytest.mark.parametrize("share", [-1.0, 1e9])  # in blocks, in cells
def test_search_within_groups_meets_its_group_only(spark, monkeypatch, share):
    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(400, 8)), rng.normal(size=(90, 8))
    m[17] = m[3]
    monkeypatch.setattr(vectors, "BROADCAST_MAX_VALUES", 1024)
    monkeypatch.setattr(vectors, "GRID_SHARE", share)
    monkeypatch.setattr(vectors, "GRID_ROWS", 32)
    grp = lambda i: "abc"[0 if i % 7 else 1 + i % 2]
    by = F.udf(lambda i: grp(int(i[1:])) if i != "v399" else "alone")
    qs, vs = frame(spark, q, "query_id", "q").withColumn("grp", by("query_id")), frame(spark, m).withColumn("grp", by("id"))
    got = vectors.nearest(qs, vs, 4, least=-0.2, same_group=True, block_rows=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("FlatMapGroupsInPandas [grp#" in plan) == (share < 0)
    unit = lambda x: x.astype("float32").astype(float) / np.linalg.norm(x.astype("float32").astype(float), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(m).T, 6)
    want = []
    for i in range(90):
        mine = sorted((j for j in range(399) if grp(j) == grp(i) and s[i, j] >= -0.2), key=lambda j: (-s[i, j], j))
        want += [(f"q{i:03d}", f"v{j:03d}", r + 1) for r, j in enumerate(mine[:4])]
    assert rows(got, "query_id", "id", "rank") == sorted(want)


def test_places_of_a_mask():
    rng = np.random.default_rng(1)
    for shape, share in (((3, 5), 0.5), ((7, 9), 0.0), ((61, 1000), 0.001), ((1, 8), 1.0), ((2, 0), 0.5)):
        mask = rng.random(shape) < share
        assert (vectors._places(mask) == np.flatnonzero(mask)).all()
