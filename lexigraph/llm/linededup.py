"""Line deduplication by content-defined chunks of lines.

A line whose hash is 0 modulo ``DIVISOR`` closes a chunk, so that the same lines are cut alike wherever they stand. A chunk
of several lines whose digest stands earlier in the corpus (smaller id, or earlier in the document) is a candidate for
removal. What a chunk can't decide is found by its lines: at a passage's two ends, where a chunk also holds lines of the host,
and in passages shorter than a chunk, each two neighbouring lines with a word (and the lines without one between them), and
each line of over ``LONG`` words, are candidates of their own. A confirmed chunk speaks for all lines inside it; candidates
that lie side by side in both places grow into one run. A run is removed only after its bytes have been compared with those
of the place it repeats. The first place of every line stays.

Hence a line goes where it is part of a repeated passage of two or more lines with a word, or one line of over ``LONG`` words.

Null text stays null, empty text empty. Rows with a null id stay as they are and are compared with nothing. Rows that share an id are
one place: neither is earlier. Lines are cut at line feeds only. What remains is joined by line feeds. Columns of any name pass through.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.llm import vec
from lexigraph.llm.common import fresh
from lexigraph.plans.scale import work_dir

LONG = 50  # a line of more words counts alone
DIVISOR = 4  # lines in a chunk, on average
PAIR, ALONE, CHUNK = 0, 1, 2


def lines(data: np.ndarray, off: np.ndarray):
    """Lines of a slice: row, start, end (without the line feed), words; and where each row's lines begin (one more)."""
    feed = np.flatnonzero(data == 10)
    full = np.flatnonzero(off[:-1] < off[1:])
    start = np.sort(np.concatenate((off[:-1][full], feed + 1)), kind="stable")
    # A line feed at a text's end opens an empty last line, which begins where the next text does.
    owner = np.searchsorted(off, feed, "right") - 1
    row = np.sort(np.concatenate((full, owner)))
    end = np.where(_ends(row), off[row + 1], np.append(start[1:], 0) - 1)
    begins = vec.Words(data, off).start
    words = np.searchsorted(begins, end) - np.searchsorted(begins, start)
    return row, start, end, words, np.searchsorted(row, np.arange(len(off)))


def _ends(row: np.ndarray) -> np.ndarray:
    """Per line whether it is the last of its row."""
    return np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)


def chunks(hashes: np.ndarray, row: np.ndarray, real: np.ndarray, divisor: int = DIVISOR) -> tuple[np.ndarray, np.ndarray]:
    """First and last line with a word of each chunk that has three of them or more (of two lines, the pair says the same).

    ``hashes``: of all lines; ``real``: the lines with a word. A chunk ends behind a line whose hash the divisor divides.
    """
    closes = (vec.mix(hashes) % vec.U(divisor) == 0) | _ends(row)
    number = np.cumsum(closes) - closes
    at = np.searchsorted(number[real], np.arange(number[-1] + 2 if len(number) else 1))
    many = np.flatnonzero(np.diff(at) >= 3)
    return real[at[many]], real[at[many + 1] - 1]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every candidate: its first line's number in the text, its lines, its kind and two digests."""
    for b in batches:
        for lo, hi, data, off in vec.slices(b.column(1)):
            row, start, end, words, first = lines(data, off)
            one, two = vec.Prefix(data, vec.BASE1, vec.TABLE1), vec.Prefix(data, vec.BASE2, vec.TABLE2)
            real = np.flatnonzero(words > 0)
            near = np.flatnonzero(row[real[1:]] == row[real[:-1]])
            alone = np.flatnonzero(words > LONG)
            heads, tails = zip((real[near], real[near + 1]), (alone, alone), chunks(one.of(start, end), row, real), strict=True)
            kind = np.repeat([PAIR, ALONE, CHUNK], [len(x) for x in heads])
            head, tail = np.concatenate(heads), np.concatenate(tails)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo).take(pa.array(row[head])), pa.array((head - first[row[head]]).astype(np.int32)), pa.array((tail - head + 1).astype(np.int32)),
                 pa.array(kind.astype(np.int8)), pa.array(vec.signed(one.of(start[head], end[tail]))), pa.array(vec.signed(two.of(start[head], end[tail])))],
                ["doc_id", "line", "n", "kind", "h1", "h2"])


def grow(found: list[dict]) -> list[tuple]:
    """The candidates of one document that stand earlier, as runs ``(line, n, first_doc, first_line)``.

    Chunks come first: what lies inside one needs no candidate of its own. Those that repeat the same stretch and touch or
    overlap become one run.
    """
    spans = sorted((x["line"], x["line"] + x["n"]) for x in found if x["kind"] == CHUNK)
    starts = [s for s, _ in spans]
    by: dict[tuple, list[tuple[int, int]]] = {}
    for x in found:
        s, e = x["line"], x["line"] + x["n"]
        if x["kind"] != CHUNK and starts:
            k = bisect.bisect_right(starts, s) - 1
            if k >= 0 and e <= spans[k][1]:
                continue
        by.setdefault((x["fd"], x["fl"] - s), []).append((s, e))
    out = []
    for (doc, shift), parts in by.items():
        parts.sort()
        s, e = parts[0]
        for a, b in parts[1:]:
            if a > e:
                out.append((s, e - s, doc, s + shift))
                s, e = a, b
            e = max(e, b)
        out.append((s, e - s, doc, s + shift))
    return out


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, list of stretches) -> the bytes of each stretch asked for, one row each."""
    for b in batches:
        for lo, hi, data, off in vec.slices(b.column(1)):
            _, start, end, _, first = lines(data, off)
            want = b.column(2).slice(lo, hi - lo)
            flat = want.flatten()
            mine = np.repeat(np.arange(hi - lo), pc.list_value_length(want).to_numpy())
            line, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            # Rows that share an id may have different texts: a stretch that a text does not hold is no stretch of it.
            there = np.flatnonzero(first[mine] + line + n <= first[mine + 1])
            head = (first[mine] + line)[there]
            raw = data.tobytes()
            blob = pa.array([raw[s:e] for s, e in zip(start[head].tolist(), end[head + n[there] - 1].tolist(), strict=True)], pa.binary())
            keep = flat.take(pa.array(there))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(mine[there])), *[keep.field(k) for k in range(5)], blob],
                                             ["doc_id", "line", "n", "fd", "fl", "first", "bytes"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n): the runs of lines to remove."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    rows = known.mapInArrow(_digests, f"doc_id {kind}, line int, n int, kind byte, h1 long, h2 long")
    firsts = (rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count(F.lit(1)).alias("times"))
              .filter("times > 1").select("h1", "h2", F.col("f.doc_id").alias("fd"), F.col("f.line").alias("fl")))
    again = rows.join(firsts, ["h1", "h2"]).filter("doc_id <> fd or line <> fl")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, r) for i, x in enumerate(b.column(1)) for r in grow(x.as_py())]
            cols = list(zip(*[r for _, r in out], strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in out], pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], b.schema.field(0).type), pa.array(cols[3], pa.int32())], ["doc_id", "line", "n", "fd", "fl"])

    lists = again.groupBy("doc_id").agg(F.collect_set(F.struct("line", "n", "kind", "fd", "fl")).alias("found"))
    path = work_dir(spark, "line_runs")
    lists.mapInArrow(runs, f"doc_id {kind}, line int, n int, fd {kind}, fl int").write.parquet(path)
    stored = spark.read.parquet(path)
    # Each document is asked for its own runs, and once for every stretch that others repeat.
    asked = (stored.withColumn("first", F.lit(False))
             .unionByName(stored.select(F.col("fd").alias("doc_id"), F.col("fl").alias("line"), "n", "fd", "fl").distinct().withColumn("first", F.lit(True))))
    wanted = asked.groupBy("doc_id").agg(F.collect_set(F.struct("line", "n", "fd", "fl", "first")).alias("want"))
    blobs = work_dir(spark, "line_bytes")
    (known.join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(_bytes, f"doc_id {kind}, line int, n int, fd {kind}, fl int, first boolean, bytes binary")
     .write.option("compression", "zstd").parquet(blobs))
    found = spark.read.parquet(blobs)
    origin = found.filter("first").select("fd", "fl", "n", F.col("bytes").alias("original")).dropDuplicates(["fd", "fl", "n"])
    return found.filter("not first").join(origin, ["fd", "fl", "n"]).filter("bytes = original").select("doc_id", "line", "n").distinct()


def _without(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(columns..., text, runs to remove) -> columns, what is left of the text, its lines and the removed ones."""
    for b in batches:
        texts, lists = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        out, total, removed = [], [], []
        for lo, hi, data, off in vec.slices(texts):
            row, start, end, _, first = lines(data, off)
            gone = lists.slice(lo, hi - lo)
            mine = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(gone), 0).to_numpy())
            flat = gone.flatten()
            head = np.minimum(first[mine] + flat.field(0).to_numpy(), first[mine + 1])
            tail = np.minimum(head + flat.field(1).to_numpy(), first[mine + 1])
            edge = np.bincount(head, minlength=len(row) + 1) - np.bincount(tail, minlength=len(row) + 1)
            stays = np.cumsum(edge)[:-1] == 0
            n = np.bincount(row[~stays], minlength=hi - lo)
            total += np.diff(first).tolist()
            removed += n.tolist()
            raw = data.tobytes()
            for i in range(hi - lo):
                at = np.arange(first[i], first[i + 1])[stays[first[i]:first[i + 1]]] if n[i] else ()
                out.append(b"\n".join([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]).decode() if n[i] else texts[lo + i].as_py())
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                                         names)


def deduplicate(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` with ``text`` shortened, and two more: lines (before) and removed lines; with these columns' names."""
    number, gone, text, count, removed = fresh(docs, "id", "gone", "shortened", "lines", "removed")
    runs = repeated_runs(docs).groupBy(F.col("doc_id").alias(number)).agg(F.collect_list(F.struct("line", "n")).alias(gone))
    rest = [c for c in docs.columns if c != "text"]
    wide = docs.join(runs, F.col("doc_id") == F.col(number), "left").select(*[F.col(f"`{c}`") for c in rest], "text", gone)
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(text, T.StringType()),
                           T.StructField(count, T.LongType()), T.StructField(removed, T.LongType())])
    out = wide.mapInArrow(lambda batches: _without(batches, schema.names), schema)
    return out.select(*[F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], count, removed), count, removed


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` (lines) and ``kept_sha256`` of every row (a null text counts as empty)."""
    out, count, removed = deduplicate(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(count).alias("n_lines"), F.col(removed).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def shortened(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` (and ``n_chars`` counted again, if there is such a column)."""
    out, _, removed = deduplicate(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
