"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Equal sets are one class and only its smallest document goes on. Of
``BANDS * ROWS`` minima the bands give candidate keys; of each minimum only the low two bits are kept, packed into longs,
and the similarity of a candidate pair is estimated from the count of equal bit pairs, corrected for chance (a quarter
of them agree anyway). Pairs within six standard deviations of the threshold are confirmed on their full sets.

Candidates are never written out as all pairs of a bucket. Each bucket's members are compared with its first member (a
minimum, taken before the shuffle as well). Where a bucket then still holds several components, its members' sets meet in
tiles of bounded size, and only pairs that could still join two components are compared, the likeliest first, each in the
first bucket that it shares. So components are those of all links; a link of exactly the threshold is missed by all bands
with a probability below 1e-8 at 85 percent and of about 3e-6 at 80.

Null or empty text, or text without words: an empty set, linked with nothing. A null id is linked with nothing (null
component, kept). Rows with one id are one document: what any of its texts is linked with counts for it. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.llm import vec
from lexigraph.llm.common import components
from lexigraph.plans.scale import cut

SHINGLE = 5
BANDS, ROWS = 32, 5
K = BANDS * ROWS
LANES = 32  # two-bit lanes in a long
SIG = tuple(f"s{i}" for i in range(K // LANES))
STRIP = 256  # rows of a tile compared at once
TILE = 400_000  # shingles on each side of a tile, about
_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * vec.U(2) + vec.U(1)
_B = _rng.integers(1, 1 << 63, K, dtype=np.uint64)


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, sorted within the row, and where each row's begin (one more)."""
    data = _lower(data)
    w = vec.Words(data, off)
    h = w.hashes(data)
    rows = len(off) - 1
    full = vec.window_hash(h, SHINGLE)
    ok = w.row[:len(full)] == w.row[SHINGLE - 1:] if len(full) else np.zeros(0, bool)
    row, value = [w.row[:len(full)][ok]], [full[ok]]
    for n in range(1, SHINGLE):  # fewer words than a shingle: the whole sequence
        short = np.flatnonzero(w.count == n)
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for k in range(n):
                x = vec.mix(x * vec.U(0x9E3779B97F4A7C15) + h[w.first[:-1][short] + k] + vec.U(n))
            row.append(short)
            value.append(x)
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in vec.slices(b.column(1)):
            value, first = shingles(data, off)
            n = np.diff(first)
            full = np.flatnonzero(n > 0)
            heads = first[:-1][full]
            rows = hi - lo
            c1, c2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            sig = np.zeros((len(SIG), rows), np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                c1[full] = np.add.reduceat(vec.mix(value), heads)
                c2[full] = np.add.reduceat(vec.mix(value ^ vec.U(0x5851F42D4C957F2D)), heads)
                for k in range(K):
                    low = np.minimum.reduceat((value * _A[k] + _B[k]) >> vec.U(24), heads)
                    sig[k // LANES, full] |= (vec.mix(low + vec.U(k)) & vec.U(3)) << vec.U(2 * (k % LANES))
                    bands[:, k // ROWS] = vec.mix(bands[:, k // ROWS] * vec.U(31) + low + vec.U(k + 1))
            place = np.zeros(rows + 1, np.int32)
            np.cumsum(np.where(n > 0, BANDS, 0), out=place[1:])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, rows), pa.array(n.astype(np.int64)), pa.array(vec.signed(c1)), pa.array(vec.signed(c2)),
                 *[pa.array(vec.signed(s)) for s in sig], pa.ListArray.from_arrays(pa.array(place), pa.array(vec.signed(bands.reshape(-1))))],
                ["doc_id", "n_shingles", "c1", "c2", *SIG, "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``c1``/``c2`` (128-bit digest of the set), the packed two-bit signature, the band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _signatures, f"doc_id {kind}, n_shingles long, c1 long, c2 long, {', '.join(f'{s} long' for s in SIG)}, bands array<long>")


def margin(percent: int) -> float:
    """Six standard deviations of the estimate at a similarity of ``percent`` (rounded up: 0.2 at 85, 0.23 at 80)."""
    agree = 0.25 + 0.75 * percent / 100
    return math.ceil(600 * math.sqrt(agree * (1 - agree) / K) / 0.75) / 100


def estimate(a: str, b: str) -> Column:
    """Similarity by counts of equal two-bit lanes, corrected for the quarter that agrees by chance."""
    odd = F.lit(0x5555555555555555)
    differ = None
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        differ = n if differ is None else differ + n
    return 1 - (differ / F.lit(float(K))) / 0.75


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in vec.slices(b.column(1)):
            value, first = shingles(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(vec.signed(value)))],
                                             ["id", "set"])


def _tile(left: dict, right: dict, same: bool, percent: int) -> list[tuple[int, int]]:
    """Places (in ``left``, in ``right``) of links that join components; ``same``: both sides are one, take each pair once.

    A side has ``sig`` (rows of longs), ``bands``, ``band`` (the bucket's place among the bands), ``part`` and ``set``.
    """
    n, m = len(left["part"]), len(right["part"])
    odd = vec.U(0x5555555555555555)
    up: dict[int, int] = {}
    out = []

    def root(p):
        while p in up:
            p = up[p]
        return p

    for lo in range(0, n, STRIP):  # bounds the memory of the comparison
        rows = slice(lo, min(lo + STRIP, n))
        differ = np.zeros((rows.stop - lo, m), np.int16)
        for k in range(len(SIG)):
            x = left["sig"][rows, k, None] ^ right["sig"][None, :, k]
            differ += np.bitwise_count((x | (x >> vec.U(1))) & odd)
        likely = 1 - (differ / np.float32(K)) / np.float32(0.75)
        wanted = (likely >= percent / 100 - margin(percent)) & (left["part"][rows, None] != right["part"][None, :])
        if same:
            wanted &= np.arange(m)[None, :] > np.arange(lo, rows.stop)[:, None]
        for k in range(int(left["band"])):  # met in an earlier bucket
            wanted &= left["bands"][rows, k, None] != right["bands"][None, :, k]
        i, j = np.nonzero(wanted)
        order = np.argsort(-likely[i, j], kind="stable")
        for a, b in zip((i[order] + lo).tolist(), j[order].tolist(), strict=True):
            p, q = root(int(left["part"][a])), root(int(right["part"][b]))
            if p == q:
                continue
            x, y = left["set"][a], right["set"][b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                up[p] = q
                out.append((a, b))
    return out


def _block(t: pa.Table, percent: int) -> pa.Table:
    """One tile of a bucket: columns key, i, j, side, band, id, part (a number), bands, signature, set."""
    side = t.column("side").to_numpy()
    part = t.column("part").to_numpy()
    wide = lambda name, k: np.array(t.column(name).combine_chunks().flatten()).view(np.uint64).reshape(-1, k)
    bands, sig = wide("bands", BANDS), wide("sig", len(SIG))
    sets = t.column("set").combine_chunks()
    ids = t.column("id").combine_chunks()
    same = t.column("i")[0].as_py() == t.column("j")[0].as_py()

    def take(at):
        return {"part": part[at], "bands": bands[at], "sig": sig[at], "band": t.column("band")[0].as_py(),
                "set": [np.asarray(sets[int(k)].values) for k in at]}

    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    found = _tile(take(left), take(right), same, percent)
    a, b = [left[x] for x, _ in found], [right[y] for _, y in found]
    return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sigs = cut(signatures(docs))
    known = sigs.filter("doc_id is not null and n_shingles > 0")
    same = cut(known.groupBy("c1", "c2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", *SIG)).alias("r"))
               .select("c1", "c2", "n_shingles", "r.*"))
    reps = same.select(F.col("doc_id").alias("id"), "n_shingles", "bands", F.struct(*SIG).alias("sig"))
    # Texts of one id that are in several classes are one document.
    several = known.groupBy("doc_id").agg(F.min("c1").alias("p"), F.max("c1").alias("q")).filter("p <> q").select("doc_id")
    several = cut(several)
    joined = (known.join(several, "doc_id").join(same.select("c1", "c2", "n_shingles", F.col("doc_id").alias("rep")), ["c1", "c2", "n_shingles"])
              .select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).filter("a <> b"))

    keys = reps.select(F.posexplode("bands").alias("band", "key"), "id")
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").select("key", "leader")
    rows = cut(keys.join(shared, "key"))  # members of buckets that two or more share
    met = rows.select("id").distinct()
    sets = cut(docs.select("doc_id", "text").join(met.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "text")
               .mapInArrow(_sets, f"id {kind}, set array<long>"))

    pairs = (rows.filter("leader < id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
             .join(reps.select(F.col("id").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("na")), "a")
             .join(reps.select(F.col("id").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("nb")), "b")
             .filter((estimate("x", "y") >= percent / 100 - margin(percent)) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
             .select("a", "b").distinct())
    both = F.size(F.array_intersect("sa", "sb"))
    linked = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
              .join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
              .filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    links = cut((linked.unionByName(joined) if several.limit(1).count() else linked).distinct())
    parts = components(links)

    # Buckets in which several components are left, in tiles.
    placed = (rows.select("key", "band", "id").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
    open_ = (placed.join(reps.select("id", "n_shingles"), "id").groupBy("key")
             .agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
             .filter("p <> q and n > 2").select("key", F.ceil(F.col("total") / F.lit(float(TILE))).cast("int").alias("tiles")))
    tiled = placed.join(open_, "key").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    sides = F.concat(
        F.transform(F.sequence("t", F.col("tiles") - 1), lambda j: F.struct(F.col("t").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("t")), lambda i: i < F.col("t")),
                    lambda i: F.struct(i.alias("i"), F.col("t").alias("j"), F.lit(1).alias("side"))))
    spread = (tiled.select("key", "band", "id", F.xxhash64("part").alias("part"), F.explode(sides).alias("s")).select("key", "band", "id", "part", "s.*")
              .join(reps.select("id", "bands", F.array(*[F.col(f"sig.{c}") for c in SIG]).alias("sig")).join(sets, "id"), "id"))
    more = spread.groupBy("key", "i", "j").applyInArrow(lambda t: _block(t, percent), f"a {kind}, b {kind}")
    more = cut(more.distinct())
    if more.limit(1).count():
        parts = components(links.unionByName(more))
    classes = (same.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
               .select("c1", "c2", "n_shingles", F.coalesce("component", "doc_id").alias("__part")))
    found = sigs.select("doc_id", "n_shingles", "c1", "c2").join(classes, ["c1", "c2", "n_shingles"], "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("__part", "doc_id"))
    return found.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is the one that stays of its component, with all their columns."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
