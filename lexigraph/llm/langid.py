"""Languages of mixed text: script ranges narrow the candidates, then Viterbi over the words.

Each language is a table of letter-trigram log-probabilities, learnt from labelled texts and folded into ``BUCKETS`` hash
buckets, so the model has a fixed size. A word scores the sum over its trigrams for each language; languages never seen in
the word's script are ruled out. Viterbi with a penalty for switching labels every word; runs of one label are the spans. The
document's language is the one that labels the most letters.

Null text and text without a letter: ``und`` with score 0 and no spans. Without any labelled text every answer is ``und``.
Repeated rows are judged alike. All documents of a batch walk through Viterbi side by side, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.common import held_out
from lexigraph.llm.vec import U, mix

BUCKETS = 1 << 16
UNDETERMINED = "und"

# The first and last code point of common scripts, and their numbers. Everything else is script 0.
SCRIPTS = (("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
           ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F),
           ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
           ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
           ("han", 0x20000, 0x323AF))
_names = sorted({n for n, _, _ in SCRIPTS})
_SIZE = 0x110000
_script = np.zeros(_SIZE, np.uint8)
for _name, _lo, _hi in SCRIPTS:
    _script[_lo:_hi + 1] = _names.index(_name) + 1
_letter = np.array([chr(i).isalpha() for i in range(_SIZE)])
N_SCRIPTS = len(_names) + 1


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (lower case, a blank between two), and each word's start, end and text number."""
    points = np.frombuffer(" ".join(t.lower() for t in texts).encode("utf-32-le", "replace"), np.uint32)
    inside = _letter[points]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    return points, start, end, np.searchsorted(ends, start, "right")


def _grams(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word's trigrams (with a blank before and after it), and where each word's begin (one more than words)."""
    n = end - start
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[:-1][word] + start[word]
    before = np.where(at > start[word], points[np.maximum(at - 1, 0)], 32).astype(np.uint64)
    after = np.where(at + 1 < end[word], points[np.minimum(at + 1, len(points) - 1)], 32).astype(np.uint64)
    key = (before << U(42)) | (points[at].astype(np.uint64) << U(21)) | after
    return (mix(key) & U(BUCKETS - 1)).astype(np.int64), first


class Model:
    """Names of the languages, their log-probabilities per bucket (float32) and the scripts each was seen in."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table, scripts


def learn(docs: DataFrame, sample: int = 8_000, smooth: float = 0.5) -> Model:
    """Trigram tables from at most ``sample`` documents outside the held-out third (by hash of the id), whole texts."""
    rows = (docs.filter(~held_out()).filter("lang is not null and text is not null and doc_id is not null")
            .select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang"))
    chosen = rows.orderBy("h", "doc_id").limit(sample).select("doc_id", "lang").distinct()
    # At most ``sample`` ids: texts stay where they are.
    rows = docs.filter("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in set(langs):
                texts = [t for t, y in zip(b.column(1).to_pylist(), langs, strict=True) if y == lang and t]
                points, start, end, _ = _words(texts)
                if len(start):
                    total = sums.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    total[:BUCKETS] += np.bincount(_grams(points, start, end)[0], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(_script[np.minimum(points[start], _SIZE - 1)], minlength=N_SCRIPTS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    found = (rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
             .collect())  # at most BUCKETS + N_SCRIPTS rows a language
    langs = sorted({r["lang"] for r in found})
    counts = np.zeros((len(langs), BUCKETS + N_SCRIPTS))
    for r in found:
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    p = np.log((grams + smooth) / (grams.sum(1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float32)
    seen = scripts > 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(p), seen.T)


def _viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``first``: where each document's words begin (one more). Documents advance side by side."""
    n, k = scores.shape
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    head, count = first[:-1][order], count[order]
    active = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")
    back = np.zeros((n, k), np.uint8)
    state = np.zeros((len(order), k), np.float32)
    for t, m in enumerate(active):
        at = head[:m] + t
        old = state[:m]
        best = old.argmax(1)
        top = old[np.arange(m), best] - np.float32(penalty)
        stay = old >= top[:, None]
        back[at] = np.where(stay, np.arange(k), best[:, None]) if t else np.arange(k)
        state[:m] = np.where(stay, old, top[:, None]) + scores[at]
    label = np.zeros(n, np.uint8)
    now = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = head[:m] + t
        label[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return label


def _label(model: Model, texts: list[str], penalty: float):
    points, start, end, row = _words(texts)
    bucket, first = _grams(points, start, end)
    k = len(model.langs)
    scores = np.zeros((len(start), k), np.float32)
    if len(start):
        for j in range(k):
            scores[:, j] = np.add.reduceat(model.table[bucket, j], first[:-1])
        allowed = model.scripts[_script[np.minimum(points[start], _SIZE - 1)]]
        some = allowed.any(1, keepdims=True)
        scores = np.where(allowed | ~some, scores, scores - np.float32(1e4))
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    return points, start, end, row, begin, scores, _viterbi(scores, begin, penalty)


def identify(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (share of the letters so labelled, times how sure their words are)
    and ``n_spans``."""
    return _run(docs, model, penalty, False)


def spans(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """One row per span: ``doc_id``, ``span``, ``lang``, ``n_words``, ``n_letters``, in text order."""
    return _run(docs, model, penalty, True)


def _run(docs: DataFrame, model: Model, penalty: float, as_spans: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.langs, UNDETERMINED], object)
        k = len(model.langs)
        for b in batches:
            size = np.array([len(t or "") for t in b.column(1).to_pylist()])
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[lo:]), 1 << 21, "right")))
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                ids = b.column(0).slice(lo, hi - lo)
                lo = hi
                if not k:
                    n = len(texts)
                    if not as_spans:
                        yield pa.RecordBatch.from_arrays([ids, pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32))],
                                                         ["doc_id", "lang_pred", "score", "n_spans"])
                    continue
                _, start, end, row, begin, scores, label = _label(model, texts, penalty)
                letters = end - start
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                if as_spans:
                    stop = np.append(at[1:], len(label))
                    total = np.concatenate(([0], np.cumsum(letters)))
                    number = np.arange(len(at)) - np.searchsorted(at, begin[:-1])[row[at]] if len(at) else at
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at])), pa.array(number.astype(np.int32)), pa.array(langs[label[at]], pa.string()),
                                                      pa.array((stop - at).astype(np.int64)), pa.array((total[stop] - total[at]).astype(np.int64))],
                                                     ["doc_id", "span", "lang", "n_words", "n_letters"])
                    continue
                n = len(texts)
                share = np.bincount(row * k + label, letters, n * k).reshape(n, k)
                total = share.sum(1)
                best = np.where(total > 0, share.argmax(1), k)
                # How far the words of the winner lead, as a probability of the whole against the runner-up.
                gap = scores - np.where(np.arange(k) == label[:, None], -np.inf, scores).max(1, keepdims=True) if k > 1 else np.ones_like(scores)
                lead = np.bincount(row, np.clip(gap[np.arange(len(label)), label], -5, 5) if len(label) else None, n)
                sure = 1 / (1 + np.exp(-np.clip(lead, -50, 50)))
                score = np.where(total > 0, share.max(1) / np.maximum(total, 1) * sure, 0.0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs[best], pa.string()), pa.array(score), pa.array(np.bincount(row[at], minlength=n).astype(np.int32))],
                                                 ["doc_id", "lang_pred", "score", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if as_spans:
        return rows.mapInArrow(run, f"doc_id {kind}, span int, lang string, n_words long, n_letters long")
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_spans int")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")
