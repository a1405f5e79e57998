"""Benchmark decontamination by template canonicalisation.

Texts become tokens, of which numbers, units after a number and names (capitalised inside a sentence) are replaced by typed
placeholders; what stood there is kept as the slot's value. Windows of ``WINDOW`` template tokens of documents and benchmark
items are hash-joined. A document holds an item if enough of the item's windows are found and the slots agree: one value
of the item's always has become the same value in the document (other numbers and names may have been put in).

A bit table of fixed size, made of the benchmark's windows, drops in the scan all document windows that cannot join.
An item shorter than a window is one window of its own length. Windows of placeholders mostly say nothing as templates, and so
do items under ``LEAST`` tokens: these are joined by their literal values (in lower case) instead, so that verbatim copies are
found and other fillings are not. An item counts by its templates alone, or by all its windows. An item of a single token is
too common to judge and matches nothing. Null or empty texts have no windows. Rows with
a null id are answered for with a null id and never contaminated. Rows that share an id are one document. Equal items
are found alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm import vec

WINDOW, LEAST, SHORTEST = 8, 4, 2
BITS = 1 << 23
SHARE = 0.5
#: Units of measure that count after a number. Fixed values.
UNITS = ("m cm mm km kilometers kilometres kilometer meters metres meter miles mile feet foot ft inch inches yards g kg mg grams gram "
         "kilograms kilogram pounds pound lb lbs oz ounces ton tons l ml liters litres liter litre gallons s sec seconds second min minutes minute "
         "h hr hours hour days day weeks week months month years year dollars dollar cents cent euros euro percent degrees degree c f mph kmh "
         "watts volts joules newtons hz kb mb gb tb").split()

_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_alpha = np.zeros(256, bool)
_alpha[65:91] = _alpha[97:123] = True
_alpha[128:] = True
_stop = np.zeros(256, bool)
_stop[np.frombuffer(b".!?:;\n\"", np.uint8)] = True
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, 3, dtype=np.uint64)
NUMBER, UNIT, NAME = (int(x) for x in _SEEDS)
LITERAL = vec.U(0x6C62272E07BB0142)  # keys of literal windows differ from those of templates


def _word_hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return vec.Prefix(data, vec.BASE1, vec.TABLE1).of(end - [len(w) for w in words], end)


_UNITS = np.sort(_word_hash([u.encode() for u in UNITS]))


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of a slice: template hash, value hash, whether it is a slot; and where each row's tokens begin (one more)."""
    rows = len(off) - 1
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(rows + 1, np.int64)
    upper = _upper[data]
    accent = np.zeros(n, bool)  # the second byte of a capital of Latin-1
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    low = np.where(upper | accent, data + 32, data).astype(np.uint8)
    digit = _digit[data]
    point = np.zeros(n, bool)  # a separator inside a number
    point[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    kind = np.where(digit | point, 1, np.where(_alpha[data], 2, 0)).astype(np.int8)
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    real = kind[start] > 0
    start, end = start[real], end[real]
    row = np.searchsorted(off, start, "right") - 1
    value = vec.Prefix(low, vec.BASE1, vec.TABLE1).of(start, end)
    number = kind[start] == 1
    after = np.zeros(len(start), bool)
    after[1:] = number[:-1] & (row[1:] == row[:-1])
    unit = after & ~number & np.isin(value, _UNITS)
    stops = np.zeros(n + 1, np.int64)
    np.cumsum(_stop[data], out=stops[1:])
    inner = np.zeros(len(start), bool)
    inner[1:] = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
    capital = upper[start] | (data[start] == 0xC3) & accent[np.minimum(start + 1, n - 1)]
    name = inner & ~number & capital & ~unit
    token = np.where(number, vec.U(NUMBER), np.where(unit, vec.U(UNIT), np.where(name, vec.U(NAME), value)))
    return token, value, number | unit | name, np.searchsorted(row, np.arange(rows + 1))


def windows(data: np.ndarray, off: np.ndarray, sizes: list[int], literal: list[int]):
    """(row, place, hash, size, first token, literal, slots) of windows, with the tokens' values and slots.

    As templates all windows of ``sizes`` tokens with at most half slots; by their values all windows of ``literal`` tokens.
    """
    token, value, slot, first = template(data, off)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    slots = np.concatenate(([0], np.cumsum(slot)))
    none = np.zeros(0, np.int64)
    out = [(none, none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool), none)]
    for size, exact in [*((n, False) for n in sizes), *((n, True) for n in literal)]:
        h = vec.window_hash(value if exact else token, size)
        at = np.flatnonzero(row[:len(h)] == row[size - 1:]) if len(h) else none
        held = slots[at + size] - slots[at]
        if not exact:
            at, held = at[2 * held <= size], held[2 * held <= size]
        key = vec.mix(h[at] + vec.U(size) + (LITERAL if exact else vec.U(0)))
        out.append((row[at], at - first[row[at]], key, np.full(len(at), size), at, np.full(len(at), exact), held))
    return [np.concatenate(x) for x in zip(*out, strict=True)], value, slot, count


def _emit(ids: pa.Array, found, value: np.ndarray, slot: np.ndarray, keep: np.ndarray, extra: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    row, place, h, size, at, literal, _ = (x[keep] for x in found)
    inside = np.repeat(at, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    taken = slot[inside] & ~np.repeat(literal, size)
    lengths = np.add.reduceat(taken.astype(np.int64), np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vec.signed(value[inside[taken]])))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(vec.signed(h)), pa.array(place), values, *extra], names)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, h, place, slots, n_templates, n_windows, size, literal``: the windows of each item (of an item under ``window`` tokens: one)."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in vec.slices(b.column(1)):
                found, value, slot, count = windows(data, off, list(range(LEAST, window + 1)), list(range(SHORTEST, window + 1)))
                row, _, _, size, _, literal, held = found
                keep = np.flatnonzero((size == np.minimum(count[row], window)) & (~literal | (2 * held > size) | (size < LEAST)))
                total = np.bincount(row[keep], minlength=hi - lo)
                templates = np.bincount(row[keep][~literal[keep]], minlength=hi - lo)
                yield _emit(b.column(0).slice(lo, hi - lo), found, value, slot, keep,
                            [pa.array(templates[row[keep]].astype(np.int64)), pa.array(total[row[keep]].astype(np.int64)),
                             pa.array(size[keep].astype(np.int32)), pa.array(literal[keep])],
                            ["item_id", "h", "place", "slots", "n_templates", "n_windows", "size", "literal"])

    return benchmark.filter("item_id is not null").select("item_id", "text").mapInArrow(
        run, f"item_id {kind}, h long, place long, slots array<long>, n_templates long, n_windows long, size int, literal boolean")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """``doc_id, item_id, share``: which documents hold which items, and the share of the item's windows found."""
    items = item_windows(benchmark, window)
    # At most ``bits / 64`` words and ``window`` sizes, whatever the benchmark.
    word = F.pmod(F.shiftrightunsigned("h", 6), F.lit(bits // 64))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    table = np.zeros(bits // 64, np.uint64)
    for r in items.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        table[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    kinds = sorted((r["size"], r["literal"]) for r in items.select("size", "literal").distinct().collect())
    sizes, exact = [n for n, x in kinds if not x], [n for n, x in kinds if x]
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            for lo, hi, data, off in vec.slices(b.column(1)):
                if not kinds:
                    continue
                found, value, slot, _ = windows(data, off, sizes, exact)
                h = found[2]
                place = ((h >> vec.U(6)) % vec.U(bits // 64)).astype(np.int64)
                keep = np.flatnonzero((known[place] >> (h & vec.U(63))) & vec.U(1))
                if len(keep):
                    yield _emit(b.column(0).slice(lo, hi - lo), found, value, slot, keep, [], ["doc_id", "h", "place", "values"])

    found = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, h long, place long, values array<long>")
    hits = found.select("doc_id", "h", "values").join(items.withColumnRenamed("place", "at"), "h")
    hits = hits.filter(F.size("slots") == F.size("values"))
    # One row for each window of an item and each way its slots are filled in the document.
    ways = hits.groupBy("doc_id", "item_id", "at", "literal", "n_templates", "n_windows", "slots", "values").agg(F.count(F.lit(1)).alias("n"))
    of = lambda column, total: F.coalesce(F.count_distinct(column) / F.nullif(F.max(total), F.lit(0)), F.lit(0.0))
    seen = (ways.groupBy("doc_id", "item_id").agg(
        F.greatest(of(F.when(~F.col("literal"), F.col("at")), "n_templates"), of(F.col("at"), "n_windows")).alias("share"),
        of(F.when(F.col("literal"), F.col("at")), "n_windows").alias("verbatim")).filter(F.col("share") >= share))
    pairs = (ways.filter(F.size("slots") > 0).join(seen.select("doc_id", "item_id"), ["doc_id", "item_id"])
             .select("doc_id", "item_id", "at", F.explode(F.arrays_zip("slots", "values")).alias("p")))
    # A value of the item's agrees if one value stands for it in most of the windows that hold it.
    votes = pairs.groupBy("doc_id", "item_id", "p.slots", "p.values").agg(F.count_distinct("at").alias("n"))
    held = votes.groupBy("doc_id", "item_id", "slots").agg(F.max("n").alias("most"))
    windows_of = pairs.groupBy("doc_id", "item_id", F.col("p.slots").alias("slots")).agg(F.count_distinct("at").alias("all"))
    agree = (held.join(windows_of, ["doc_id", "item_id", "slots"]).groupBy("doc_id", "item_id")
             .agg((F.sum("most") / F.sum("all")).alias("agree")))
    return (seen.join(agree, ["doc_id", "item_id"], "left").filter((F.coalesce("agree", F.lit(1.0)) >= 0.7) | (F.col("verbatim") >= share))
            .select("doc_id", "item_id", "share"))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items``, ``item_ids`` (sorted) and the highest ``share``, one row per row of ``docs``."""
    found = matches(docs, benchmark).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array()).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all their columns."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
