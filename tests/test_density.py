"""Density clusters against a brute-force tree, cut from the top."""

import collections

import numpy as np
import pytest

from conftest import rows
from lexigraph.operators import density


def brute_graph(m, k):
    """Mutual reachability of the k nearest neighbours, all pairs compared."""
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    names = [f"v{i:04d}" for i in range(len(m))]
    near = [sorted((j for j in range(len(m)) if j != i), key=lambda j: (-s[i, j], names[j]))[:k] for i in range(len(m))]
    core = [round(1 - min(s[i, j] for j in near[i]), 6) for i in range(len(m))]
    return {(min(i, j), max(i, j)): max(round(1 - s[i, j], 6), core[i], core[j], 1e-6) for i in range(len(m)) for j in near[i]}


def brute_labels(n, edges, least):
    """HDBSCAN from its definition: take away the longest tree edge, look at what it leaves, and so on down."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    tree = []
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            tree.append((w, a, b))

    def parts(nodes, inner):
        near = collections.defaultdict(list)
        for _, a, b in inner:
            near[a].append(b)
            near[b].append(a)
        seen, out = set(), []
        for v in sorted(nodes):
            if v not in seen:
                todo, group = [v], set()
                while todo:
                    x = todo.pop()
                    if x not in group:
                        group.add(x)
                        todo += near[x]
                seen |= group
                out.append(group)
        return [(g, [e for e in inner if e[1] in g]) for g in out]

    def cluster(nodes, inner, birth, allowed):
        """(total stability, chosen sets) of one cluster and what is below it."""
        left, inner, own, kids = set(nodes), sorted(inner), 0.0, []
        while True:
            if not inner:
                break
            w, a, b = inner.pop()
            two = parts(left, inner)
            big = [p for p in two if len(p[0]) >= least]
            if len(big) == 2:
                own += len(left) * (1 / w - birth)
                kids = [cluster(*p, 1 / w, True) for p in big]
                break
            if not big:
                own += len(left) * (1 / w - birth)
                break
            gone = len(left) - len(big[0][0])
            own += gone * (1 / w - birth)
            left, inner = big[0][0], sorted(big[0][1])
        below = sum(k[0] for k in kids)
        if allowed and (not kids or round(own, 9) >= round(below, 9)):
            return own, [set(nodes)]
        return below, [s for k in kids for s in k[1]]

    whole = [p for p in parts(range(n), tree) if len(p[0]) >= least]
    chosen = [s for p in whole for s in cluster(*p, 0.0, len(whole) > 1)[1]]
    return {v: min(s) for s in chosen for v in s}


def points(seed, n, spread, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 6))
    return np.concatenate([centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, 6)), rng.normal(size=(n // 8, 6)), np.tile(centres[:1], (7, 1))])


def frame(spark, m):
    return spark.createDataFrame([(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(m)], "id string, embedding array<double>")


@pytest.mark.parametrize("seed,n,spread,k,least,ranged", [(1, 150, 0.25, 4, 5, 200_000), (2, 150, 0.5, 3, 6, 60), (3, 1700, 0.3, 5, 12, 200_000)])
def test_clusters_equal_a_brute_force_tree(spark, seed, n, spread, k, least, ranged):
    """Also with the tree's edges merged in several ranges."""
    m = points(seed, n, spread)
    want = brute_labels(len(m), brute_graph(m, k), least)
    got = {r["id"]: r["cluster"] for r in density.density_clusters(frame(spark, m), k, least, range_edges=ranged).collect()}
    assert len(got) == len(m) and got == {f"v{i:04d}": f"v{want[i]:04d}" if i in want else None for i in range(len(m))}
    assert len(set(want.values())) > 1 and len(want) < len(m)


def test_spanning_tree_is_shortest(spark):
    rng = np.random.default_rng(4)
    edges = {(a, b): round(float(rng.integers(1, 9)) / 8, 6) for a, b in rng.integers(0, 60, size=(150, 2)) if a < b}
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", w) for (a, b), w in edges.items()], "a string, b string, w double")
    tree, labels = density.spanning_tree(df)
    up = {v: v for e in edges for v in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    want = []
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            want.append((f"{a:02d}", f"{b:02d}", w))
    assert rows(tree, "a", "b", "w") == sorted(want)
    groups = collections.defaultdict(set)
    for v in up:
        groups[top(v)].add(f"{v:02d}")
    mine = collections.defaultdict(set)
    for r in labels.collect():
        mine[r["component"]].add(r["v"])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_few_vectors(spark):
    none = density.density_clusters(frame(spark, np.zeros((0, 6))))
    assert none.count() == 0
    got = density.density_clusters(frame(spark, np.array([[1.0, 0], [0, 0], [0.5, 0.5]])))
    assert [r["cluster"] for r in got.collect()] == [None] * 3


def test_few_edges_take_few_steps(spark, monkeypatch):
    """The number of Spark jobs does not follow the length of paths; with more edges than one task takes the tree is the same."""
    names = [f"{i:03d}" for i in range(130)]
    df = spark.createDataFrame([(a, b, 1.0 + (i * 37 % 11)) for i, (a, b) in enumerate(zip(names, names[1:])) if i != 70], "a string, b string, w double")
    steps, whole = [], density.cut
    monkeypatch.setattr(density, "cut", lambda frame: steps.append(1) or whole(frame))
    tree, labels = density.spanning_tree(df)
    assert len(steps) <= 5 and rows(tree, "a", "b", "w") == rows(df, "a", "b", "w")
    assert sorted(r["count"] for r in labels.groupBy("component").count().collect()) == [59, 71]
    monkeypatch.setattr(density, "FEW_EDGES", 40)
    tree, labels = density.spanning_tree(df)
    assert rows(tree, "a", "b", "w") == rows(df, "a", "b", "w")
    assert sorted(r["count"] for r in labels.groupBy("component").count().collect()) == [59, 71]


def test_estimates_do_not_grow_with_the_rounds(spark):
    """Pointers up a long chain of clusters: a join's estimated size is a product, and must not be multiplied on from round to round."""
    n = 200
    chain = spark.createDataFrame([(f"c{i:03d}", f"c{i - 1:03d}" if i else None, i in (20, 90)) for i in range(n)], "cid string, parent string, chosen boolean")
    top = density.highest_chosen(chain)
    assert top._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 ** 20
    assert [tuple(r) for r in top.orderBy("cid").collect()] == [(f"c{i:03d}", "c020" if i >= 20 else None) for i in range(n)]
