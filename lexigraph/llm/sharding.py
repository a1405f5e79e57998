"""Shards of nearly equal bytes by minimax contiguous partition.

Documents with equal texts are one atomic group; groups are ordered by their smallest id. The smallest capacity for which
the ordered groups fit into the shards is found by binary search, each guess checked greedily, and the cuts are made
within it, as even as it allows.

The search runs on the driver over a summary of fixed size: running sums of the groups' sizes, first of the whole at about
``MARKS`` places, then finer only where a cut may fall. A guess is surely feasible if the known places suffice and surely
not if even unknown places could not help; what lies between is looked up in the next round, until the capacity is exact.

Null text: no bytes, a group of its own. A size is the UTF-8 bytes plus one. Null ids come first in the order. Rows that
repeat are one group. An empty table gives an empty result. A group larger than an even share makes its shard as large.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.plans.scale import cut

SHARDS = 16
MARKS = 1 << 16


def running_sum(df: DataFrame, order: list[str], value: str, name: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows up to this one in ``order`` (per ``within``, if given).

    Rows are dealt out by ranges and stored, summed per range, and the sums of earlier ranges (a row a task and key) added.
    """
    within = within or []
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part", *within).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("__own", F.sum(value).over(own)).join(sums, ["__part", *within])
            .withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before"))


class _Places:
    """Known running sums, and the open intervals that may hide more of them."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.known, self.hidden = [0], [(0, total)]

    def look(self, gaps: list[tuple[int, int]]) -> None:
        """Replaces the intervals ``gaps`` by finer ones: the first and last sum in each of about ``MARKS`` buckets."""
        share = max(1, MARKS // len(gaps))
        case, grain = None, {}
        for i, (a, b) in enumerate(gaps):
            grain[i] = max(1, -(-(b - a) // share))
            inside = (F.col("end") > a) & (F.col("end") < b)
            bucket = F.struct(F.lit(i).alias("gap"), F.floor((F.col("end") - F.lit(a)) / F.lit(grain[i])).alias("bucket"))
            case = F.when(inside, bucket) if case is None else case.when(inside, bucket)
        found = (self.ends.select("end", case.alias("b")).filter("b is not null").groupBy("b")
                 .agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count_distinct("end").alias("n")).collect())
        self.hidden = sorted({*self.hidden} - {*gaps} | {(r["lo"], r["hi"]) for r in found if r["n"] > 2})
        self.known = sorted({*self.known, self.total, *(r["lo"] for r in found), *(r["hi"] for r in found)})

    def sure(self, x: int) -> int:
        """The largest known sum up to ``x``."""
        return self.known[bisect.bisect_right(self.known, x) - 1]

    def hoped(self, x: int) -> int:
        """No sum up to ``x`` is larger than this."""
        i = bisect.bisect_right(self.hidden, (x, float("inf"))) - 1
        return x if i >= 0 and self.hidden[i][0] <= x < self.hidden[i][1] else self.sure(x)


def _greedy(step, capacity: int, shards: int, total: int) -> list[int]:
    at, cuts = 0, []
    for _ in range(shards):
        at = min(step(min(at + capacity, total)), total)
        cuts.append(at)
    return cuts


def _smallest(step, low: int, shards: int, total: int) -> int:
    high = total
    while low < high:
        guess = (low + high) // 2
        if _greedy(step, guess, shards, total)[-1] >= total:
            high = guess
        else:
            low = guess + 1
    return low


def capacity_and_cuts(ends: DataFrame, total: int, largest: int, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity, and the running sum at which each shard ends. ``ends``: column ``end``, a group's running sum."""
    if not total:
        return 0, [0] * shards
    places, low = _Places(ends, total), max(largest, -(-total // shards))
    places.look(places.hidden)
    while True:
        low = _smallest(places.hoped, low, shards, total)
        high = _smallest(places.sure, low, shards, total)
        if low == high:
            break
        ranges = list(zip(_greedy(places.sure, low, shards, total), _greedy(places.hoped, high, shards, total), strict=True))
        # A step may also land in a hidden stretch between two of these, at capacities in between.
        gaps = [(a, b) for a, b in places.hidden if any(b > lo and a <= hi for lo, hi in ranges)]
        places.look(gaps)
    # Even cuts within the capacity: each as near to its share as what remains allows.
    latest, at = [total], total
    for _ in range(shards - 1):
        at = places.known[bisect.bisect_left(places.known, max(0, at - high))]
        latest.append(at)
    latest.reverse()
    cuts, at = [], 0
    for k in range(shards):
        aim = at + -(-(total - at) // (shards - k))
        i = bisect.bisect_left(places.known, aim)
        near = min(places.known[max(0, i - 1):i + 1], key=lambda p: abs(p - aim))
        at = max(min(near, places.sure(at + high)), latest[k], at)
        cuts.append(at)
    return high, cuts


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``."""
    raw = F.col("text").cast("binary")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
                       F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("group"))
    groups = rows.groupBy("group").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    ends = cut(running_sum(groups, ["first", "group"], "bytes", "end"))
    most = ends.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    _, cuts = capacity_and_cuts(ends.select("end"), most["total"] or 0, most["largest"] or 0, shards)
    number = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    placed = rows.join(ends.select("group", "end"), "group").withColumn("shard", number.cast("int")).withColumn("one", F.lit(1).cast("long"))
    slots = running_sum(placed.drop("group"), ["end", "doc_id"], "one", "slot", ["shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
