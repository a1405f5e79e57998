"""Quality by weak supervision: rules vote or abstain, and a two-class latent model weighs their votes.

Each rule looks at one measure of a whole text and votes *good*, *bad* or abstains. Expectation-maximisation estimates how
often each rule votes bad on good and on bad documents, without labels, from the histogram of vote patterns (at most
``3 ** len(RULES)`` rows, whatever the corpus; that bound is why it may come to the driver). A document is kept if the
posterior probability of *good* reaches the threshold, instead of having to pass every rule.

Null or empty text: no words, every measure 0, fails the base rule. Rows that repeat are scored alike. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.llm import vec

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_MARKS = np.zeros(256, bool)
_MARKS[np.frombuffer(b"!?|{}=\\^~", np.uint8)] = True
WINDOW = 5

#: name -> (SQL of the measure, good if at most, bad if at least); in between the rule abstains. Fixed values.
RULES = {
    "short": ("1.0 / greatest(n_words, 1)", 1 / 40, 1 / 12),
    "word_length": ("abs(word_chars / greatest(n_words, 1) - 6.0)", 2.5, 4.5),
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.05, 0.15),
    "upper": ("n_upper / greatest(n_letters, 1)", 0.15, 0.35),
    "marks": ("n_marks / greatest(n_words, 1)", 0.05, 0.2),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.05, 0.2),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.1, 0.3),
    "letters": ("1 - n_letters / greatest(word_chars, 1)", 0.12, 0.3),
}


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    w = vec.Words(data, off)
    h = w.hashes(data)
    rows = len(off) - 1
    count = lambda flags: vec.per_row(flags, off)
    lead = (data & 0xC0) != 0x80

    five = vec.window_hash(h, WINDOW)
    whole = w.row[:len(five)] == w.row[WINDOW - 1:] if len(five) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    again = at[_repeated(five[at], w.row[at], first_too=True)]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeat = vec.per_row(np.cumsum(cover[:-1]) > 0, w.first)

    # Lines: cut at every \n and at the texts' ends.
    cut = np.union1d(np.flatnonzero(data == 10) + 1, off[:-1]) if len(data) else off[:1]
    start = cut[cut < len(data)]
    end = np.append(start[1:], len(data))
    row = np.searchsorted(off, start, "right") - 1
    stop = np.where((end > start) & (data[end - 1] == 10), end - 1, end) if len(start) else end
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.inside, out=words[1:])
    real = words[stop] > words[start]
    start, stop, row = start[real], stop[real], row[real]
    lines = vec.Prefix(data, vec.BASE2, vec.TABLE2).of(start, stop)
    dup = np.bincount(row[_repeated(lines, row, first_too=False)], minlength=rows)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters = upper | lower | ((data >= 0xC3) & lead)
    return [w.count, count(w.inside & lead), count(_SYMBOLS[data]), dup, repeat, np.bincount(row, minlength=rows),
            count(upper), count(letters), count(_MARKS[data])]


def _repeated(h: np.ndarray, row: np.ndarray, first_too: bool) -> np.ndarray:
    """True where a hash was seen earlier in its row (``first_too``: or is seen again later)."""
    key = vec.mix(h + row.astype(np.uint64) * vec.U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    if first_too:
        out[order[:-1][same]] = True
    return out


def measures(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: ``doc_id``) of each row, and ``__q``: a struct of ``MEASURES`` (long) of its whole text."""
    carry = carry or ["doc_id"]
    wide = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_measure(data, off) for _, _, data, off in vec.slices(b.column(b.num_columns - 1))]
            cols = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * len(MEASURES)
            found = pa.StructArray.from_arrays([*map(pa.array, cols)], list(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*b.schema.names[:-1], "__q"])

    out = T.StructType([*wide.schema.fields[:-1], T.StructField("__q", T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])
    return wide.mapInArrow(run, out)


def votes(measured: DataFrame) -> DataFrame:
    """Adds ``__pattern``: one letter a rule, g(ood), b(ad) or - (abstains)."""
    one = []
    for formula, good, bad in RULES.values():
        x = F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"__q.\1", formula))
        one.append(F.when(x <= F.lit(good), "g").when(x >= F.lit(bad), "b").otherwise("-"))
    return measured.withColumn("__pattern", F.concat(*one))


#: Bounds of the rates of bad votes: a rule errs on few good documents and finds a fair share of the bad ones.
ON_GOOD, ON_BAD = (1e-3, 0.02), (0.2, 0.95)


def fit(patterns: dict[str, int], rounds: int = 200, prior: float = 0.85) -> dict[str, float]:
    """Posterior probability of *good* per vote pattern, by expectation-maximisation over the pattern counts.

    A rule has two rates, of bad votes on good and on bad documents; abstaining says nothing. The rates stay within
    ``ON_GOOD`` and ``ON_BAD``: otherwise the largest kind of junk would take the bad class for itself and every other
    kind would count as good, or the classes would change places.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    bad = np.array([[c == "b" for c in p] for p in names], float)
    good = np.array([[c == "g" for c in p] for p in names], float)
    on_good, on_bad = np.full(bad.shape[1], 0.01), np.full(bad.shape[1], 0.5)
    post = np.full(len(names), prior)
    for _ in range(rounds):
        score = (np.log(prior / (1 - prior)) + bad @ np.log(on_good / on_bad) + good @ np.log((1 - on_good) / (1 - on_bad)))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
        wg, wb = n * post, n * (1 - post)
        on_good = np.clip((wg @ bad + 0.1) / (wg @ (bad + good) + 10), *ON_GOOD)
        on_bad = np.clip((wb @ bad + 5) / (wb @ (bad + good) + 10), *ON_BAD)
        prior = float(np.clip((wg.sum() + 8.5) / (n.sum() + 10), 0.5, 0.99))
    return {p: float(x) for p, x in zip(names, post, strict=True)}


def _judged(docs: DataFrame, carry: list[str], threshold: float) -> DataFrame:
    counts = votes(measures(docs)).groupBy("__pattern").count()
    post = fit({r["__pattern"]: r["count"] for r in counts.collect()})
    known = docs.sparkSession.createDataFrame(list(post.items()) or [("", 0.0)], "__pattern string, __good double")
    failed = F.expr("__q.n_words < 10 or 100 * __q.n_repeat_words > 20 * __q.n_words")
    return (votes(measures(docs, carry)).join(F.broadcast(known), "__pattern", "left")  # at most 3 ** len(RULES) rows
            .withColumn("__failed", failed).withColumn("__kept", ~failed & (F.col("__good") >= threshold)))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``kept`` and ``quality``, the posterior probability of good."""
    return _judged(docs, ["doc_id"], threshold).select(
        "doc_id", *[F.col(f"__q.{m}").alias(m) for m in MEASURES[:5]], F.col("__failed").alias("base_failed"),
        F.col("__kept").alias("kept"), F.col("__good").alias("quality"))


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Decided beside the row: no text is shuffled.

    A row travels as one struct, so that its columns may have any name.
    """
    packed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    return _judged(packed, ["__row"], threshold).filter("__kept").select("__row.*")
