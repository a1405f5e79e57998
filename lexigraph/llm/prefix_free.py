"""Repeated byte strings by prefix-free parsing.

Text is parsed into phrases at triggers: positions whose rolling hash (of ``TRIGGER`` bytes) is the least of a window, so
that every ``width``-byte string holds exactly one trigger of its own, chosen by its bytes alone. A phrase is the stretch
of all strings with one trigger; neighbouring phrases overlap by ``width - 1`` bytes. So no phrase's string runs past its
phrase, a string is found in phrases of its own trigger only, and the order of the corpus' strings is that of the
dictionary's suffixes (to ``width`` bytes), equal ones in order of the parse, that is of document and place.

1. Parse: phrases with their digests. A phrase met again in the same batch is settled there and only named as a span.
2. Dictionary: phrases are dealt out by trigger. All places of a phrase but its first hold repeats only. A trigger with one
   phrase holds no other repeats, and its phrase is done.
3. Suffix arrays: the phrases of each remaining trigger are sorted by their suffixes; strings with a common prefix of
   ``width`` bytes stand together and all but the earliest are repeats. A trigger with very many phrases is dealt out
   over several tasks; the strings each of them finds first are then settled by digest.
4. The spans of each document are united and cut out.

What grows is proportional to the text; a trigger that a third of all documents share adds at most ``CROWD`` rows a batch
to any key. Null or empty text: nothing to remove. Rows with a null id have no place in the order and stay as they are.
Rows that share an id are one place: none of them is earlier than the other. A text shorter than ``width`` has no string.
Long texts are parsed in blocks. Digests have 128 bits; strings in suffix arrays are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.llm import vec
from lexigraph.plans.scale import cut

WIDTH = 100
TRIGGER = 32
CROWD = 16  # phrases of one trigger in one batch from which they are dealt out by phrase
PART = 1024  # phrases of one trigger that one suffix array holds at most, on average
_POS = vec.U((1 << 21) - 1)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` values in a row, by running minima from both ends of blocks of ``span``."""
    n = len(values) - span + 1
    blocks = np.full(-(-len(values) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(values)] = values
    grid = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[span - 1:span - 1 + n])


def phrases(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(row, start in the slice, strings, place of the trigger, trigger, digest, second digest) of a slice's phrases."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    if n < width:
        return none
    rolled = vec.rolling(data, TRIGGER)
    ranked = (rolled & ~_POS) | np.arange(len(rolled), dtype=np.uint64)
    trigger = (_least(ranked, width - TRIGGER + 1) & _POS).astype(np.int64)
    whole = np.zeros(n + 1, np.int64)
    size = np.diff(off)
    long = np.flatnonzero(size >= width)
    whole[off[:-1][long]] += 1
    np.add.at(whole, off[1:][long] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:-1]))
    if not len(at):
        return none
    own = trigger[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
    head = np.flatnonzero(new)
    start, count = at[head], np.diff(np.append(head, len(at)))
    end = start + count + width - 1
    row = np.searchsorted(off, start, "right") - 1
    one = vec.Prefix(data, vec.BASE1, vec.TABLE1).of(start, end)
    two = vec.Prefix(data, vec.BASE2, vec.TABLE2).of(start, end)
    return row, start, count, own[head] - start, rolled[own[head]], one, two


def _blocks(col: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the bytes in the row): slices, long texts in overlapping blocks."""
    for lo, hi, data, off in vec.slices(col):
        if hi - lo > 1 or len(data) <= vec.SLICE:
            yield lo, data, off, 0
            continue
        for at in range(0, len(data) - width + 1, vec.SLICE):
            part = data[at:at + vec.SLICE + width - 1]
            yield lo, part, np.array([0, len(part)]), at


def _parse(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for lo, data, off, base in _blocks(b.column(1), width):
            row, start, count, place, trig, one, two = phrases(data, off, width)
            found.append((row + lo, start - off[row] + base, count, place, trig, one, two))
        if not found:
            continue
        row, pos, count, place, trig, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(row):
            continue
        rank = pc.rank(b.column(0), tiebreaker="dense").to_numpy().astype(np.int64)[row]
        order = np.lexsort((pos, rank, two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        again = np.zeros(len(order), bool)
        again[order] = (rank[order] != rank[first]) | (pos[order] != pos[first])
        named = np.zeros(len(order), bool)
        named[order[fresh]] = True
        # Repeats within the batch, joined to spans. They pass the shuffle by a key of their own place.
        at = np.flatnonzero(again)
        if len(at):
            begin = np.ones(len(at), bool)
            begin[1:] = (row[at[1:]] != row[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + count[at[:-1]])
            head = np.flatnonzero(begin)
            total = np.add.reduceat(count[at], head)
            head = at[head]
            key = vec.mix(one[head] ^ pos[head].astype(np.uint64))
            yield _rows(b, key, key, key, row[head], pos[head], total, np.full(len(head), -1))
        at = np.flatnonzero(named)
        by = at[np.argsort(trig[at], kind="stable")]
        edge = np.flatnonzero(np.append(True, trig[by][1:] != trig[by][:-1]))
        many = np.repeat(np.diff(np.append(edge, len(by))), np.diff(np.append(edge, len(by))))
        crowd = by[many > CROWD]
        calm = by[many <= CROWD]
        yield _rows(b, trig[calm], one[calm], two[calm], row[calm], pos[calm], count[calm], place[calm])
        if len(crowd):
            # Dealt out by phrase; one row under the trigger's own key says that there are such. Place: 1000 and more.
            yield _rows(b, vec.mix(trig[crowd] ^ one[crowd]), one[crowd], two[crowd], row[crowd], pos[crowd], count[crowd], place[crowd] + 1000, trig[crowd])
            _, at = np.unique(trig[crowd], return_index=True)
            sign = crowd[at]
            zero = np.zeros(len(sign), np.uint64)
            yield _rows(b, trig[sign], zero, zero, row[sign], pos[sign], np.zeros(len(sign), np.int64), np.full(len(sign), -2))


def _rows(b, key, one, two, row, pos, count, place, trig=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(vec.signed(key)), pa.array(vec.signed(one)), pa.array(vec.signed(two)), b.column(0).take(pa.array(row)), pa.array(pos),
         pa.array(count.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(vec.signed(key if trig is None else trig))],
        ["key", "h1", "h2", "doc_id", "pos", "n", "place", "trig"])


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the phrases asked for: (doc_id, text, list of (trig, part, parts, pos, n)) -> one row a phrase."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for lo in range(0, len(ids), 256):
            data, off = vec.utf8(texts.slice(lo, 256))
            want = b.column(2).slice(lo, 256)
            flat = want.flatten()
            row = np.repeat(np.arange(len(want)), pc.list_value_length(want).fill_null(0).to_numpy())
            trig, part, parts, pos, n = (flat.field(i) for i in range(5))
            start = off[row] + pos.to_numpy()
            end = start + n.to_numpy() + width - 1
            raw = data.tobytes()
            blob = pa.array([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([trig, part, parts, ids.slice(lo, 256).take(pa.array(row)), pos, blob],
                                             ["trig", "part", "parts", "doc_id", "pos", "bytes"])


def _suffix_array(t: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Sorts all strings of the phrases in ``t`` (whole groups of (trig, part)) and tells repeats from first ones."""
    data, off = vec.utf8(t.column("bytes").combine_chunks())
    ids = t.column("doc_id").combine_chunks()
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    pos = t.column("pos").to_numpy()
    trig, part, parts = (t.column(c).to_numpy() for c in ("trig", "part", "parts"))
    group = np.cumsum(np.append(0, (trig[1:] != trig[:-1]) | (part[1:] != part[:-1])))
    order = np.lexsort((pos, rank, group))  # phrases of a group in order of the parse
    count = np.diff(off)[order] - width + 1
    row = np.repeat(order, count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    strings = np.lib.stride_tricks.sliding_window_view(data, width)[off[:-1][row] + step]
    strings = np.ascontiguousarray(strings).view(f"S{width}").reshape(-1)
    array = np.argsort(strings, kind="stable")
    array = array[np.argsort(group[row[array]], kind="stable")]
    s, g = strings[array], group[row[array]]
    fresh = np.ones(len(array), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
    first = array[np.maximum.accumulate(np.where(fresh, np.arange(len(array)), 0))]
    place = pos[row] + step
    again = np.zeros(len(array), bool)
    again[array] = (rank[row[array]] != rank[row[first]]) | (place[array] != place[first])

    at = np.flatnonzero(again)
    if len(at):
        begin = np.ones(len(at), bool)
        begin[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(begin)
        n = np.diff(np.append(head, len(at)))
        zero = np.zeros(len(head), np.int64)
        yield _settled(ids, row[at[head]], place[at[head]], n, zero, zero)
    open_ = array[fresh]
    open_ = open_[parts[row[open_]] > 1]
    if len(open_):
        start = off[:-1][row[open_]] + step[open_]
        one = vec.Prefix(data, vec.BASE1, vec.TABLE1).of(start, start + width)
        two = vec.Prefix(data, vec.BASE2, vec.TABLE2).of(start, start + width)
        yield _settled(ids, row[open_], place[open_], np.zeros(len(open_), np.int64), vec.signed(one), vec.signed(two))


def _settled(ids, row, pos, n, one, two) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(pos), pa.array(n.astype(np.int32)), pa.array(one), pa.array(two)],
                                      ["doc_id", "pos", "n", "s1", "s2"])


def _arrays(batches: Iterator[pa.RecordBatch], width: int, most: int = 3000) -> Iterator[pa.RecordBatch]:
    """Runs ``_suffix_array`` over rows sorted by (trig, part), whole groups at a time and about ``most`` phrases."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for lo in range(0, b.num_rows, most):
            held.append(b.slice(lo, most))
            t = pa.Table.from_batches(held)
            trig, part = t.column("trig").to_numpy(), t.column("part").to_numpy()
            last = np.flatnonzero((trig[1:] != trig[:-1]) | (part[1:] != part[:-1]))
            if len(last) and t.num_rows >= most:
                done = int(last[-1]) + 1
                yield from _suffix_array(t.slice(0, done), width)
                held = t.slice(done).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield from _suffix_array(t, width)


def _cut_out(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            ids, texts, lists = (b.column(i).slice(lo, 64) for i in range(3))
            data, off = vec.utf8(texts)
            out = []
            for i, spans in enumerate(lists):
                raw = data[off[i]:off[i + 1]]
                merged = _union(spans, width)
                removed = sum(e - s for s, e in merged)
                digest, at = hashlib.sha256(), 0
                for s, e in [*merged, (len(raw), len(raw))]:
                    digest.update(raw[at:s].tobytes())
                    at = e
                out.append((len(raw), removed, len(merged), digest.hexdigest()))
            n, removed, spans, digests = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _union(spans: pa.Scalar, width: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a list of (pos, n): the bytes of ``n`` strings from ``pos`` on."""
    values = spans.values
    if values is None or not len(values):
        return []
    pos, n = values.field(0).to_numpy(), values.field(1).to_numpy()
    order = np.argsort(pos, kind="stable")
    start, end = pos[order], np.maximum.accumulate(pos[order] + n[order] + width - 1)
    new = np.append(True, start[1:] > end[:-1])
    head = np.flatnonzero(new)
    return list(zip(start[head].tolist(), end[np.append(head[1:], len(start)) - 1].tolist(), strict=True))


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, pos, n): the strings that start at ``pos`` and the ``n - 1`` places after it start earlier somewhere."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(
        lambda it: _parse(it, width), f"key long, h1 long, h2 long, doc_id {kind}, pos long, n int, place int, trig long")
    dealt = rows.repartition("key")
    same = Window.partitionBy("key", "h1", "h2").orderBy("doc_id", "pos")
    marked = (dealt.withColumn("rank", F.rank().over(same)).withColumn("number", F.row_number().over(same))
              .withColumn("others", F.sum(F.when(F.col("number") == 1, 1).otherwise(0)).over(Window.partitionBy("key")))
              .withColumn("again", (F.col("place") == -1) | ((F.col("place") >= 0) & (F.col("rank") > 1)))
              .filter("place <> -2 and (again or (number = 1 and (place >= 1000 or others > 1)))"))
    marked = cut(marked.select("trig", "doc_id", "pos", "n", "again"))

    asked = marked.filter("not again")
    parts = asked.groupBy("trig").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PART))).cast("int").alias("parts"))
    asked = (asked.join(parts, "trig")
             .withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.col("parts")).cast("int")))
    lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("trig", "part", "parts", "pos", "n")).alias("want"))
    texts = docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "want").mapInArrow(
        lambda it: _texts(it, width), f"trig long, part int, parts int, doc_id {kind}, pos long, bytes binary")
    settled = cut(texts.repartition("trig", "part").sortWithinPartitions("trig", "part").mapInArrow(
        lambda it: _arrays(it, width), f"doc_id {kind}, pos long, n int, s1 long, s2 long"))
    again = Window.partitionBy("s1", "s2").orderBy("doc_id", "pos")
    late = (settled.filter("n = 0").withColumn("rank", F.rank().over(again)).filter("rank > 1")
            .select("doc_id", "pos", F.lit(1).alias("n")))
    return (marked.filter("again").select("doc_id", "pos", "n")
            .unionByName(settled.filter("n > 0").select("doc_id", "pos", "n")).unionByName(late))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = repeats(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        lambda it: _cut_out(it, width), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
