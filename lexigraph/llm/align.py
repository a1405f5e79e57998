"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Both tokenizers see the same bytes (a space and the text). The ends of A's and B's tokens are two sorted lists, and merging
them shows which tokens overlap. The merge is cut into pieces of equal work: a binary search on each diagonal of the merge
grid finds how many ends of A and of B come before it, so that pieces are merged on their own. A piece emits the overlaps
whose end it holds; where a diagonal parts two equal ends, A's piece emits the overlap and B's piece passes it over. Groups
(the bytes between two offsets where both end a token) that run over a diagonal are stitched by the pieces' running counts.

Defined results: texts that are null or empty, or whose tokens do not give back the bytes (a tokenizer that normalises,
say), have no tokens. Rows that repeat, or share an id, are each a row of their own and count as often. Null ids are ids
like any other. Any text is tokenised whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.packing import encoder, tokenizer
from lexigraph.plans.scale import work_dir

WORK = 4096  # ends that a piece of the merge takes
ROWS, BYTES = 2000, 1 << 20  # texts that are aligned at once
#: Pairs of ids with the most links that are sent to all tasks (24 bytes each); the other pairs are joined by a shuffle.
SENT = 1 << 20


class Vocabulary:
    """The bytes of each id, end to end, and the ids as text with each mark that may follow them."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.marked = {m: np.array([f"{i}{m}" for i in range(len(pieces))], object) for m in ",|;"}


def byte_level(piece: str, alphabet: dict[str, int] = {}) -> bytes:  # noqa: B006
    """A byte-level piece back to bytes: printable bytes stand for themselves, the others for characters from U+0100 on."""
    if not alphabet:
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        alphabet |= {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    return bytes(alphabet[c] for c in piece)


@lru_cache(maxsize=2)
def side_a(ranks_path: str) -> Vocabulary:
    tok = tokenizer(ranks_path)
    special = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
    return Vocabulary([special[i] if i in special else byte_level(tok.id_to_token(i)) for i in range(tok.get_vocab_size())])


@lru_cache(maxsize=2)
def side_b(model_path: str):
    """The processor and its vocabulary (a byte piece is its byte, U+2581 a space)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return p, Vocabulary([bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()
                          for i, s in ((i, p.id_to_piece(i)) for i in range(p.get_piece_size()))])


def plain(text: str, ranks_path: str) -> list[int]:
    """A's ids of a text in which the strings of special tokens are text like any other."""
    try:
        return encoder(ranks_path).encode(text, allowed_special=set(), disallowed_special=())
    except ValueError:  # about a million blanks or line feeds in a row
        tok = tokenizer(ranks_path)
        tok.encode_special_tokens = True
        try:
            return tok.encode(text, add_special_tokens=False).ids
        finally:  # the tokenizer is shared
            tok.encode_special_tokens = False


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ends ``a`` and ``b`` come before each diagonal; of equal ends, ``a``'s comes first.

    All diagonals are searched at once: the first i on diagonal d with a[i] > b[d - i - 1] is where the merge crosses it.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        k = np.flatnonzero(open_)
        first = a[mid[k]] <= b[d[k] - mid[k] - 1]  # then a[mid] lies before the diagonal
        lo[k[first]] = mid[k[first]] + 1
        hi[k[~first]] = mid[k[~first]]
    return lo, d - lo


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece: its overlaps as (token of A, token of B, both end there). Each ends at one of the piece's ends."""
    mine = b[j0:j1]
    if i0 and len(mine) and mine[0] == a[i0 - 1]:  # emitted by the piece before
        mine = mine[1:]
    ends = np.concatenate((a[i0:i1], mine))
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    i, j = i0 + np.searchsorted(a[i0:i1], ends), j0 + np.searchsorted(b[j0:j1], ends)
    both = (a[np.minimum(i, len(a) - 1)] == ends) & (b[np.minimum(j, len(b) - 1)] == ends)
    return i, j, both


@dataclass
class Aligned:
    """Tokens of some texts laid end to end: ids, ends, texts' first tokens, and overlaps with those that end together."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    first: tuple[np.ndarray, np.ndarray]
    over: tuple[np.ndarray, np.ndarray]
    both: np.ndarray


def align(texts: list[str | None], ranks_path: str, model_path: str, work: int = WORK) -> Aligned:
    one, (processor, two) = side_a(ranks_path), side_b(model_path)
    kept = [t or "" for t in texts]
    coded_b = iter(processor.encode([t for t in kept if t], num_threads=1))
    ids: tuple[list, list] = ([], [])
    for t in kept:
        x, y = (plain(f" {t}", ranks_path), next(coded_b)) if t else ([], [])
        if t:
            raw = b" " + t.encode()
            if b"".join([one.pieces[i] for i in x]) != raw or b"".join([two.pieces[i] for i in y]) != raw:
                x, y = [], []
        ids[0].append(np.array(x, np.int64))
        ids[1].append(np.array(y, np.int64))
    first = tuple(np.append(0, np.cumsum([len(x) for x in side])) for side in ids)
    flat = tuple(np.concatenate(side) if side else np.zeros(0, np.int64) for side in ids)
    # Texts lie behind each other, so that one merge takes them all; no token reaches over a text's end.
    a, b = np.cumsum(one.size[flat[0]]), np.cumsum(two.size[flat[1]])
    found = []
    if len(a) and len(b):
        i, j = diagonals(a, b, work)
        found = [overlaps(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True)]
    i, j, both = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, bool if k == 2 else np.int64) for k in range(3))
    return Aligned(flat, (a, b), first, (i, j), both)


def group_texts(x: Aligned, ranks_path: str, model_path: str) -> list[str]:
    """Per text its groups, ``a1,a2|b1;a3|b2,b3``: tokens of A, then of B, between two offsets where both end."""
    marks = side_a(ranks_path).marked, side_b(model_path)[1].marked
    i, j = x.over[0][x.both], x.over[1][x.both]  # the last token of each group
    na, nb = len(x.ids[0]), len(x.ids[1])
    # A token of A stands behind the tokens of B in earlier groups; one of B behind those of A up to its own group.
    group_a, group_b = np.searchsorted(i, np.arange(na)), np.searchsorted(j, np.arange(nb))
    before_a, before_b = np.append(0, j + 1)[group_a], (i + 1)[group_b] if len(i) else np.zeros(0, int)
    out = np.empty(na + nb, object)
    for k, ids, at, last in ((0, x.ids[0], np.arange(na) + before_a, i), (1, x.ids[1], np.arange(nb) + before_b, j)):
        words = marks[k][","][ids]
        words[last] = marks[k]["|;"[k]][ids[last]]
        out[at] = words
    starts = (x.first[0] + x.first[1]).tolist()
    return ["".join(out[s:e].tolist())[:-1] for s, e in zip(starts[:-1], starts[1:], strict=True)]


def _slices(col: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``BYTES`` bytes."""
    lo, size = 0, 0
    for k, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()):
        if k > lo and (size + n > BYTES or k - lo >= ROWS):
            yield lo, col.slice(lo, k - lo)
            lo, size = k, 0
        size += n
    if lo < len(col):
        yield lo, col.slice(lo)


def aligned_documents(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and its links: distinct ``pairs`` of ids
    (A's times 2^32, plus B's) and how often each is linked (``times``). Links are tokens that end together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, col in _slices(batch.column(1)):
                x = align(col.to_pylist(), ranks_path, model_path)
                i, j = x.over[0][x.both], x.over[1][x.both]
                pair = (x.ids[0][i] << 32) | x.ids[1][j]
                at = np.searchsorted(i, x.first[0])  # each text's first link
                row = np.repeat(np.arange(len(col)), np.diff(at))
                order = np.lexsort((pair, row))
                row, pair = row[order], pair[order]
                new = np.append(True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])) if len(row) else np.zeros(0, bool)
                head = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(row[head], np.arange(len(col) + 1)).astype(np.int32))
                times = np.diff(np.append(head, len(row)))
                n = np.diff(at)
                texts = group_texts(x, ranks_path, model_path)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(col)), *[pa.array(v.astype(np.int64)) for v in (np.diff(x.first[0]), np.diff(x.first[1]), n, n)],
                    pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pair[head])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def token_overlaps(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Every overlap of a token of A with one of B: ``doc_id``, the tokens' ``place_a`` and ``place_b`` in the text, their
    ids ``a`` and ``b``, the byte offset ``end`` of what they share (in space and text), its length ``size``, whether both end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, col in _slices(batch.column(1)):
                x = align(col.to_pylist(), ranks_path, model_path)
                i, j = x.over
                if not len(i):
                    continue
                end = np.minimum(x.ends[0][i], x.ends[1][j])
                row = np.searchsorted(x.first[0], i, "right") - 1
                base = np.append(0, x.ends[0])[x.first[0][row]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(col)).take(pa.array(row)), *[pa.array(v.astype(np.int64)) for v in (
                        i - x.first[0][row], j - x.first[1][row], x.ids[0][i], x.ids[1][j], end - base, np.diff(end, prepend=0))], pa.array(x.both)],
                    ["doc_id", "place_a", "place_b", "a", "b", "end", "size", "together"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, place_a long, place_b long, a long, b long, end long, size long, together boolean")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, its ``count`` of links in all documents, and ``best``: no pair of the same B id has more.

    Links are summed per task before the shuffle; the highest count is one row a B id.
    """
    counts = (aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")).withColumn("b", F.expr("pair & 4294967295L")))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def measure(docs: DataFrame, ranks_path: str, model_path: str, sent: int = SENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    The documents' distinct pairs are stored once. Counts come back to them by a join: the ``sent`` most frequent pairs
    (nearly all links) are broadcast, a set of fixed size; what is left over of the links is joined by a shuffle.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "aligned")
    aligned_documents(docs, ranks_path, model_path).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    kept = work_dir(spark, "link_counts")
    link_counts(stored).write.parquet(kept)
    counts = spark.read.parquet(kept)
    # The least power of two that at most ``sent`` pairs reach; one row of sums, whatever the number of pairs.
    reached = counts.agg(*[F.coalesce(F.sum((F.col("count") >= F.lit(1 << k)).cast("long")), F.lit(0)) for k in range(63)]).first()
    heavy = F.col("count") >= next(1 << k for k in range(63) if reached[k] <= sent or k == 62)
    links = stored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    near = links.join(F.broadcast(counts.filter(heavy)), "pair", "left")
    sums = lambda df: df.groupBy("row").agg(
        F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"))
    found = sums(near.filter("count is not null"))
    if reached[0] > sent:
        far = near.filter("count is null").select("row", "pair", "n").join(counts.filter(~heavy), "pair")
        found = found.unionByName(sums(far)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (stored.drop("pairs", "times").join(found, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
