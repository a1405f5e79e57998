"""Best-fit packing of token sequences by a linear grouping scheme.

Documents are tokenised in tasks and cut into pieces of at most ``cap`` tokens. Only the histogram of piece lengths (at
most ``cap`` rows, whatever the corpus) comes to the driver, where the plan is made on counts:

1. Large lengths are sorted and put into ``groups`` groups of equal cardinality; each is rounded up to its group's largest.
2. The few sizes that result are packed by optimal fractional configurations (column generation: a basis of
   configurations, priced by a knapsack over the capacity), rounded down to whole sequences.
3. Actual lengths take the places of the rounded ones, each the longest left that its place and the room saved so far hold.
4. All that is left, small lengths above all, goes to the sequence with the least room that holds it, or to a new one.

The plan is a list of patterns (lengths in one sequence) with their numbers. A piece finds its sequence by its rank among
the pieces of its length: ranks are counted in each task and set off by a sum over tasks.

Null or empty text: one piece with the end mark alone. Rows that repeat are packed as often. An empty table gives an
empty result. Any text is tokenised whole.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.plans.scale import cut

CAP, END = 1024, 2
#: The pre-tokenising pattern and special token of the byte-level vocabulary. Fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The vocabulary as ranks: the same ids as the tokenizer file of the same name (tested), several times faster."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str):
    """The tokenizer file of the same name: slower, but its pattern has no limit on white space in a row."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{ranks_path.removesuffix('.tiktoken')}.json")


def encoded(text: str, ranks_path: str) -> np.ndarray:
    try:
        return encoder(ranks_path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # about a million blanks or line feeds in a row: the pattern's stack is full
        return np.array(tokenizer(ranks_path).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, ranks_path: str, cap: int = CAP, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, its task and its rank among the task's equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                row, out = [], []
                for i, text in enumerate(b.column(1).slice(lo, 2000)):
                    ids = np.append(encoded(text.as_py() or "", ranks_path), np.uint32(end)).astype("<u4")
                    at, k = 0, 0
                    while at < len(ids):
                        n = (len(ids) % cap or cap) if at == 0 and len(ids) > cap else min(cap, len(ids) - at)
                        row.append(i)
                        out.append((k, at, n, zlib.crc32(ids[at:at + n].tobytes()), seen[n]))
                        seen[n] += 1
                        at, k = at + n, k + 1
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, 2000).take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                     pa.array([task] * len(row), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, task int")


def _knapsack(sizes: np.ndarray, worth: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """The configuration (count per size) of greatest worth within ``cap``."""
    best, took = np.zeros(cap + 1), np.full(cap + 1, -1)
    for c in range(int(sizes.min()), cap + 1):
        fits = sizes <= c
        value = np.where(fits, worth + best[np.maximum(c - sizes, 0)], -1.0)
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-12:
            best[c], took[c] = value[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), int), cap
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[cap]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, cap: int, rounds: int = 500) -> list[tuple[np.ndarray, float]]:
    """Fractional numbers of configurations that cover ``demand`` with the fewest sequences (column generation)."""
    k = len(sizes)
    basis = np.diag(cap // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for _ in range(rounds):
        worth = inverse.sum(0)  # duals: every configuration costs one sequence
        value, column = _knapsack(sizes, np.maximum(worth, 0), cap)
        if value <= 1 + 1e-6:
            break
        step = inverse @ column
        up = np.flatnonzero(step > 1e-9)
        ratio = np.maximum(x[up], 0) / step[up]
        leave = int(up[ratio.argmin()])
        theta = float(ratio.min())
        x = x - theta * step
        x[leave] = theta
        basis[:, leave] = column
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k) if x[i] > 1e-9]


def plan(histogram: dict[int, int], cap: int = CAP, groups: int = 128, small: int = 8, spare: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, in order) and how many sequences have each. Lengths up to ``cap / small`` are small."""
    left = {n: c for n, c in histogram.items() if c > 0}
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left.get(cap):
        patterns.append(((cap,), left.pop(cap)))
    large = sorted((n for n in left if n * small > cap), reverse=True)
    opened: list[tuple[tuple[int, ...], int]] = []
    if large:
        total = sum(left[n] for n in large)
        share = -(-total // groups)
        sizes: dict[int, int] = {}  # rounded size -> how many
        top, room = large[0], share
        for n in large:
            c = left[n]
            while c:
                if not room:
                    top, room = n, share
                m = min(c, room)
                sizes[top] = sizes.get(top, 0) + m
                c, room = c - m, room - m
        size, demand = np.array(sorted(sizes, reverse=True)), None
        demand = np.array([sizes[n] for n in size], float)
        keys = sorted(large)  # lengths with some left, ascending
        for config, number in sorted(configurations(size, demand, cap), key=lambda c: -c[1]):
            slots = [int(n) for n, c in zip(size, config, strict=True) for _ in range(int(c))]
            opened += _substitute(slots, int(number + 1e-6), left, keys, cap)
    # What substitution did not fill to within ``spare`` is taken apart again and packed with the rest.
    for items, n in opened:
        if cap - sum(items) > spare:
            for length in items:
                left[length] = left.get(length, 0) + n
    return patterns + _best_fit([x for x in opened if cap - sum(x[0]) <= spare], left, cap)


def _substitute(slots: list[int], number: int, left: dict[int, int], keys: list[int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """``number`` sequences with places ``slots``: runs of sequences that get the same actual lengths."""
    done, runs = [], [((), number, cap - sum(slots))] if number else []
    for slot in slots:
        after = []
        for items, n, room in runs:
            while n:
                i = bisect.bisect_right(keys, slot + room) - 1
                if i < 0:
                    after.append((items, n, room + slot))
                    break
                actual = keys[i]
                m = min(n, left[actual])
                left[actual] -= m
                if not left[actual]:
                    del left[actual], keys[i]
                after.append(((*items, actual), m, room + slot - actual))
                n -= m
        runs = after
    done += [(items, n) for items, n, _ in runs if items]
    return done


def _best_fit(opened: list[tuple[tuple[int, ...], int]], left: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths from the longest down, each into the sequences with the least room that holds it."""
    rooms: dict[int, list[list]] = {}
    for items, n in opened:
        rooms.setdefault(cap - sum(items), []).append([items, n])
    keys = sorted(rooms)
    for length in sorted(left, reverse=True):
        c = left[length]
        while c:
            i = bisect.bisect_left(keys, length)
            if i == len(keys):
                fill = min(cap // length, c)
                n = c // fill
                items, room = (length,) * fill, cap - fill * length
                c -= n * fill
            else:
                old = keys[i]
                entry = rooms[old][-1]
                n = min(c, entry[1])
                items, room = (*entry[0], length), old - length
                c -= n
                entry[1] -= n
                if not entry[1]:
                    rooms[old].pop()
                    if not rooms[old]:
                        del rooms[old], keys[i]
            if room not in rooms:
                bisect.insort(keys, room)
                rooms[room] = []
            rooms[room].append([items, n])
    return [(items, n) for entries in rooms.values() for items, n in entries]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): key ``length << 44 | rank``, the sequence of that rank, the offset in it."""
    base, seen, rows = 0, Counter(), []
    for items, n in patterns:
        at = 0
        for length in items:
            rows.append(((length << 44) | seen[length], base, at))
            seen[length] += n
            at += length
        base += n
    rows.sort()
    key, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return key, sequence, offset


def pack(docs: DataFrame, ranks_path: str, cap: int = CAP, end: int = END, groups: int = 128) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where each piece stands."""
    cutup = cut(pieces(docs, ranks_path, cap, end))
    per_task = cutup.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``cap`` rows
    key, sequence, offset = _places(plan(histogram, cap, groups))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            mine = (length << 44) | rank
            at = np.searchsorted(key, mine, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + mine - key[at]), pa.array(offset[at])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cutup.join(starts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
