"""Density clusters of vectors (G10): mutual reachability, minimum spanning tree, condensed tree, most stable clusters.

Distances are one minus the cosine, to six digits. A vector's core distance is that of its ``k``-th neighbour; the reach of two
neighbours is the largest of their distance and both core distances. The graph has an edge for each of the ``k`` nearest
neighbours; clusters never span two of its components. Its spanning tree is found by Borůvka rounds (each
component takes its shortest way out, pointers are doubled), until the edges between components are few enough for one task.

The tree's edges are then merged in order of length, a range of them at a time: each range joins components that the
earlier ones have contracted, so no task holds more edges than a range has. Groups of at least ``least`` vectors are clusters;
two of them that meet make a new one, smaller groups fall out of the cluster they meet. A cluster's stability is the
sum over its vectors of 1/distance where they leave it, less 1/distance where it was made by a split; clusters that are more stable
than the best below them are chosen. Vectors in no chosen cluster are noise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.vectors import DIGITS, nearest
from lexigraph.plans.scale import cut, stored

CLOSEST = 10.0 ** -DIGITS  # copies count as this far apart
FEW_EDGES = 200_000  # joined in one task at most, as in a range of ``condense``
NODE = "rep string, n bigint, cid string, acc double, sub double"


def reach_graph(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``a, b, w`` (a < b): the mutual reachability of each vector and its ``k`` nearest neighbours."""
    v = vectors.filter("embedding is not null").select(F.col("id").cast("string").alias("id"), "embedding")
    near = cut(nearest(v.withColumnRenamed("id", "query_id"), v, k, exclude_self=True))
    core = near.groupBy(F.col("query_id").alias("v")).agg(F.round(1 - F.min("similarity"), DIGITS).alias("core"))
    ends = [core.select(F.col("v").alias(x), F.col("core").alias(f"c{x}")) for x in "ab"]
    pairs = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.round(1 - F.col("similarity"), DIGITS).alias("d")).distinct()
    return (pairs.join(ends[0], "a").join(ends[1], "b")
            .select("a", "b", F.greatest("d", "ca", "cb", F.lit(CLOSEST)).alias("w")))


def follow(pointers: DataFrame) -> DataFrame:
    """``(v, up)`` with every ``up`` replaced by the end of its chain (a node that points to itself), doubling each step."""
    pointers = stored(pointers.select("v", "up"))
    while True:
        step = stored(pointers.join(pointers.select(F.col("v").alias("up"), F.col("up").alias("top")), "up")
                   .select("v", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("v", "up")
        pointers = step.select("v", "up")


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """Kruskal over contracted edges ``a, b, w, la, lb``: rows ``tree`` (a, b, w) and ``label`` (a: old label, b: its component)."""
    up = {v: v for side in ("la", "lb") for v in edges[side]}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for r in edges.sort_values(["w", "a", "b"]).itertuples(index=False):
        x, y = sorted((top(r.la), top(r.lb)))
        if x != y:
            up[y] = x
            kept.append(("tree", r.a, r.b, r.w))
    return pd.DataFrame(kept + [("label", v, top(v), 0.0) for v in up], columns=["kind", "a", "b", "w"])


def spanning_tree(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shortest tree of each component of ``edges(a, b, w)`` (ties by ends), and ``(v, component)``."""
    left = cut(edges.select("a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")))
    labels = cut(left.select(F.col("a").alias("v")).unionByName(left.select(F.col("b").alias("v"))).distinct().withColumn("component", F.col("v")))
    tree = []
    while count := left.count():
        if count <= FEW_EDGES:
            done = cut(left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_forest, "kind string, a string, b string, w double"))
            tree.append(done.filter("kind = 'tree'").select("a", "b", "w"))
            ends = done.filter("kind = 'label'").select(F.col("a").alias("component"), F.col("b").alias("to"))
            labels = stored(labels.join(ends, "component", "left").select("v", F.coalesce("to", "component").alias("component")))
            break
        out = (left.select(F.col("la").alias("v"), F.struct("w", "a", "b", F.col("lb").alias("to")).alias("e"))
               .unionByName(left.select(F.col("lb").alias("v"), F.struct("w", "a", "b", F.col("la").alias("to")).alias("e"))))
        best = stored(out.groupBy("v").agg(F.min("e").alias("e")).select("v", "e.*"))
        tree.append(best.select("a", "b", "w").distinct())
        # Two components that chose each other's edge would point in a circle: the smaller one is the root.
        back = best.select(F.col("v").alias("to"), F.col("to").alias("back"))
        roots = follow(best.join(back, "to", "left").select("v", F.when((F.col("back") == F.col("v")) & (F.col("v") < F.col("to")), F.col("v")).otherwise(F.col("to")).alias("up")))
        moved = roots.withColumnRenamed("up", "to")
        labels = stored(labels.join(moved.withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("to", "component").alias("component")))
        for end in ("la", "lb"):
            left = left.join(moved.withColumnRenamed("v", end), end).drop(end).withColumnRenamed("to", end)
        left = (left.filter("la <> lb").groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
                .agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "la", "lb"))
        left = stored(left)
    all_edges = edges.limit(0).select("a", "b", "w")
    for part in tree:
        all_edges = all_edges.unionByName(part)
    return cut(all_edges), labels


def _merge(edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """Merges the edges of one component and range in order. Returns rows of three kinds: ``node`` (an old node, the one that it is
    now part of, with its state), ``home`` (an old node whose vectors now belong to a cluster) and ``closed`` clusters."""
    state, up, small, out = {}, {}, {}, []
    for side in "ab":
        for r in edges[[f"{c}{side}" for c in ("rep", "n", "cid", "acc", "sub")]].drop_duplicates().itertuples(index=False):
            state[r[0]] = [int(r[1]), r[2], float(r[3]), float(r[4])]
            up[r[0]] = r[0]
            small[r[0]] = [r[0]] if r[2] is None else []  # old nodes whose vectors are in no cluster yet

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in edges.sort_values(["w", "a", "b"]).itertuples():
        x, y = sorted((top(r.repa), top(r.repb)))
        lam, key = 1.0 / r.w, f"{r.a}\0{r.b}"
        (nx, cx, ax, sx), (ny, cy, ay, sy) = state[x], state[y]
        n = nx + ny
        if cx is not None and cy is not None:
            total = 0.0
            for c, acc, sub, m in ((cx, ax, sx, nx), (cy, ay, sy, ny)):
                own = acc - m * lam
                chosen = sub < 0 or round(own, 9) >= round(sub, 9)
                out.append(("closed", c, key, m, own, chosen))
                total += own if chosen else sub
            new = [n, key, n * lam, total]
        elif cx is not None or cy is not None:
            cid, acc, sub, fell = (cx, ax, sx, ny) if cx is not None else (cy, ay, sy, nx)
            new = [n, cid, acc + fell * lam, sub]
        else:
            new = [n, key, n * lam, -1.0] if n >= least else [n, None, 0.0, 0.0]  # below a leaf there is nothing: -1
        up[y] = x
        small[x] += small.pop(y)
        state[x] = new
        if new[1] is not None:
            out += [("home", old, new[1], 0, 0.0, False) for old in small[x]]
            small[x] = []
    nodes = [("node", v, top(v), 0, 0.0, False) for v in up]
    ends = [("state", v, state[v][1], state[v][0], state[v][2], state[v][3]) for v in {top(v) for v in up}]
    cols = ["kind", "x", "y", "n", "p", "chosen"]
    frame = pd.DataFrame([(*r[:5], bool(r[5])) for r in out + nodes], columns=cols).assign(q=0.0)
    return pd.concat([frame, pd.DataFrame([(*r[:5], False, r[5]) for r in ends], columns=[*cols, "q"])])


def condense(tree: DataFrame, labels: DataFrame, least: int = 5, range_edges: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Every vector's lowest cluster ``(v, home)`` (NULL: in none), and the clusters ``(cid, parent, n, stability, chosen)``.

    Edges are merged by ranges of about ``range_edges``, shortest first, so a task holds a range's edges at most.
    """
    parts = max(1, -(-tree.count() // range_edges))
    ranged = cut(tree.repartitionByRange(parts, "w", "a", "b").withColumn("part", F.spark_partition_id()) if parts > 1 else tree.withColumn("part", F.lit(0)))
    places = cut(labels.select("v", "component", F.col("v").alias("rep"), F.lit(None).cast("string").alias("home")))
    nodes = cut(labels.select(F.col("v").alias("rep"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("string").alias("cid"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("sub")))
    if least <= 1:
        raise ValueError("a cluster has at least two vectors")
    closed = []
    for part in range(parts):
        rows = ranged.filter(F.col("part") == part)
        for side in "ab":
            at = places.select(F.col("v").alias(side), F.col("rep").alias(f"rep{side}"), *([F.col("component")] if side == "a" else []))
            rows = rows.join(at, side).join(nodes.select(*[F.col(c).alias(f"{c}{side}") for c in ("rep", "n", "cid", "acc", "sub")]), f"rep{side}")
        done = cut(rows.groupBy("component").applyInPandas(
            lambda frame: _merge(frame, least), "kind string, x string, y string, n bigint, p double, chosen boolean, q double"))
        closed.append(done.filter("kind = 'closed'").select(F.col("x").alias("cid"), F.col("y").alias("parent"), "n", F.col("p").alias("stability"), "chosen"))
        moved = done.filter("kind = 'node'").select(F.col("x").alias("rep"), F.col("y").alias("to"))
        homes = done.filter("kind = 'home'").select(F.col("x").alias("rep"), F.col("y").alias("into"))
        places = stored(places.join(homes, "rep", "left").join(moved, "rep", "left")
                     .select("v", "component", F.coalesce("to", "rep").alias("rep"), F.coalesce("home", "into").alias("home")))
        states = done.filter("kind = 'state'").select(F.col("x").alias("rep"), "n", F.col("y").alias("cid"), F.col("p").alias("acc"), F.col("q").alias("sub"))
        nodes = stored(nodes.join(moved, "rep", "left_anti").unionByName(states))
    # What is left open are the components themselves; they count as clusters if there are several.
    roots = cut(nodes.filter("cid is not null"))
    several = roots.limit(2).count() > 1
    last = roots.select("cid", F.lit(None).cast("string").alias("parent"), "n", F.col("acc").alias("stability"),
                        (F.lit(several) & ((F.col("sub") < 0) | (F.round("acc", 9) >= F.round("sub", 9)))).alias("chosen"))
    for more in closed:
        last = last.unionByName(more)
    return places.select("v", "home"), cut(last)


def highest_chosen(clusters: DataFrame) -> DataFrame:
    """``(cid, top)``: the highest chosen cluster at or above each one, by pointers doubled up the tree."""
    up = stored(clusters.select("cid", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cid")).alias("top")))
    while not up.filter("up is not null").isEmpty():
        above = up.select(F.col("cid").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        up = stored(up.join(above, "up", "left").select("cid", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")))
    return up.select("cid", "top")


def density_clusters(vectors: DataFrame, k: int = 5, least: int = 5, sparse: int = 8, range_edges: int = 200_000) -> DataFrame:
    """``id, cluster`` (its smallest id; NULL: noise), ``size`` (0 for noise) and ``gap`` (a cluster of under ``sparse`` vectors) of every vector.

    Vectors without length have no neighbours and are noise.
    """
    every = vectors.filter("embedding is not null").select(F.col("id").cast("string").alias("id")).distinct()
    tree, labels = spanning_tree(reach_graph(vectors, k))
    places, clusters = condense(tree, labels, least, range_edges)
    member = places.join(highest_chosen(clusters), F.col("home") == F.col("cid")).filter("top is not null").select(F.col("v").alias("id"), "top")
    named = member.groupBy("top").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("size"))
    return (every.join(member.join(named, "top").drop("top"), "id", "left")
            .withColumns({"size": F.coalesce("size", F.lit(0).cast("bigint")), "gap": F.coalesce(F.col("size") < sparse, F.lit(False))}))


def density_cut(vectors: DataFrame, distance: float, k: int = 5, least: int = 5) -> DataFrame:
    """One level of the tree: ``id, cluster`` of the groups of at least ``least`` vectors within ``distance`` of each other's reach."""
    every = vectors.filter("embedding is not null").select(F.col("id").cast("string").alias("id")).distinct()
    _, labels = spanning_tree(reach_graph(vectors, k).filter(F.col("w") <= distance))
    named = labels.groupBy("component").agg(F.min("v").alias("cluster"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    found = labels.join(named, "component").select(F.col("v").alias("id"), "cluster", "size")
    return every.join(found, "id", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
