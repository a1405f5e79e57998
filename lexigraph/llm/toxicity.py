"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols, and five small weighted transducers are composed: insult and threat mark the one word that a clause
(text between sentence marks, line breaks or semicolons) is matched by, target raises its weight, negation and reported
speech lower it. The weight of a clause is that of its best path; a document's score is the noisy-or of its matched
clauses, so isolated words that no path accepts add nothing. Pairs of states are made as they are reached and kept.

The insult alphabet starts from a short fixed list and is widened by words and word stems learnt from labelled rows
(``learn``): those found nearly only in toxic documents. Rounds of the search leave out documents that are explained
already, so that chance words of a copied document do not enter.

Null or empty text scores 0. Labels that are null count as none; a document with several labels is toxic if one says so.
Without any labels the fixed list remains. Repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.common import held_out

# Seed words of the transducers and the weight of an insult, the probability that a clause with it is toxic.
INSULTS = dict.fromkeys("idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile "
                        "jerk bastard bitch asshole retard vermin".split(), 0.8)
THREAT_VERBS = frozenset("kill hurt destroy stab shoot burn beat hang murder smash strangle".split())
# Words of the other alphabets in English, German, Spanish and French.
INTENT = frozenset("will gonna going shall must should let lets ll werde werden soll sollte muss vamos voy debe deben vais vas va doit doivent".split())
TARGETS = frozenset("you your youre u ur yourself he she him her they them these those this that all people everyone "
                    "du dich dir dein deine ihr euch sie alle tú tu te ti vosotros ustedes usted ellos ellas todos toi vous vos votre ils elles tous".split())
NEGATION = frozenset("not no never isnt arent wasnt dont doesnt didnt cannot cant neither nor without hardly "
                     "nicht kein keine keinen niemals nie ohne weder nunca jamás tampoco ni sin pas jamais aucun aucune sans".split())
REPORTING = frozenset("said says say called calls call told tells claims claimed wrote writes quoted quotes accused alleged reported "
                      "sagt sagte nannte nennt schrieb behauptet behauptete dijo dice llamó escribió afirma dit disait appelle écrit affirme".split())

# Weights of the arcs, and the distances in words within which a symbol still counts.
THREAT, BOOST, NEGATED, REPORTED, CERTAIN = 0.8, 1.15, 0.25, 0.35, 0.99
INTENT_BEFORE, TARGET_BEFORE, TARGET_AFTER, NEGATION_BEFORE = 3, 4, 3, 3

# Classes of a word as bits of its symbol. MARK is put on the word a path matches, AS_THREAT if it does so as a threat.
NEG, REP, INT, TAR, VERB, INS, QUOTE, MARK, AS_THREAT = (1 << i for i in range(9))

CLAUSE = re.compile(r"[^.!?;:\n\r…]+")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile("[^\\W\\d_]+|[\"“”«»„]")
STEMS = (4, 5, 6)

Arcs = list[tuple[int, float, object]]


class Transducer:
    """Reads one symbol a step: ``arcs(state, symbol)`` lists (output symbol, weight, next state), ``final`` tells accepted states."""

    def __init__(self, start: object, arcs: Callable[[object, int], Arcs], final: Callable[[object], bool]):
        self.start, self._arcs, self.final = start, arcs, final
        self._known: dict[tuple[object, int], Arcs] = {}

    def arcs(self, state: object, symbol: int) -> Arcs:
        key = (state, symbol)
        if key not in self._known:
            self._known[key] = self._arcs(state, symbol)
        return self._known[key]

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads; states are pairs, made as they are reached."""
        def arcs(state, symbol: int) -> Arcs:
            return [(out, w * v, (p, q)) for mid, w, p in self.arcs(state[0], symbol) for out, v, q in other.arcs(state[1], mid)]

        return Transducer((self.start, other.start), arcs, lambda s: self.final(s[0]) and other.final(s[1]))

    def best(self, symbols: list[tuple[int, float]]) -> float:
        """Weight of the best accepted path (0 if none); a word marked as an insult brings its own weight."""
        now = {self.start: 1.0}
        for symbol, weight in symbols:
            after: dict[object, float] = {}
            for state, value in now.items():
                for out, w, to in self.arcs(state, symbol):
                    v = value * w * (weight if out & MARK and not out & AS_THREAT else 1.0)
                    if v > after.get(to, 0.0):
                        after[to] = v
            now = after
        return max((v for s, v in now.items() if self.final(s)), default=0.0)


def _since(d: int, seen: bool, limit: int) -> int:
    """Words since a symbol was read (1: the last word), 0 if none lies within ``limit``."""
    return 1 if seen else d + 1 if 0 < d < limit else 0


def _insult(state, s: int) -> Arcs:
    """Marks at most one insult."""
    return [(s, 1.0, state)] + ([(s | MARK, 1.0, "marked")] if s & INS and state == "open" else [])


def _threat(state, s: int) -> Arcs:
    """Marks a threat verb between an intent and a target unless an insult is marked; accepts exactly one mark."""
    kind, n = state
    if kind == "done" or s & QUOTE:
        return [] if s & MARK and kind != "open" else [(s, 1.0, state)]
    if kind == "wait":
        return [] if s & MARK else [(s, 1.0, ("done", 0))] if s & TAR else [(s, 1.0, ("wait", n + 1))] if n < TARGET_AFTER else []
    if s & MARK:
        return [(s, 1.0, ("done", 0))]
    marked = [(s | MARK | AS_THREAT, THREAT, ("wait", 1))] if s & VERB and n else []
    return [(s, 1.0, ("open", _since(n, bool(s & INT), INTENT_BEFORE))), *marked]


def _target(state, s: int) -> Arcs:
    """Raises a marked word that has a target before it, or one after it that a path has to meet."""
    kind, n = state
    if kind == "done" or s & QUOTE:
        return [(s, 1.0, state)]
    if kind == "wait":
        return [(s, 1.0, ("done", 0))] if s & TAR else [(s, 1.0, ("wait", n + 1))] if n < TARGET_AFTER else []
    if s & MARK:
        return [(s, BOOST, ("done", 0))] if n else [(s, 1.0, ("done", 0)), (s, BOOST, ("wait", 1))]
    return [(s, 1.0, ("open", _since(n, bool(s & TAR), TARGET_BEFORE)))]


def _negation(state, s: int) -> Arcs:
    """Lowers a marked word shortly after a negation."""
    if s & QUOTE:
        return [(s, 1.0, state)]
    return [(s, NEGATED if s & MARK and state else 1.0, _since(state, bool(s & NEG), NEGATION_BEFORE))]


def _reported(state, s: int) -> Arcs:
    """Lowers a marked word after a reporting verb or within quotation marks."""
    if s & QUOTE:
        return [(s, 1.0, {"plain": "quoted", "quoted": "plain"}.get(state, state))]
    return [(s, REPORTED if s & MARK and state != "plain" else 1.0, "told" if s & REP else state)]


def clauses() -> Transducer:
    """The grammar of a clause: insult, threat, target, negation and reported speech, composed in this order."""
    steps = [Transducer("open", _insult, lambda s: True), Transducer(("open", 0), _threat, lambda s: s[0] == "done"),
             Transducer(("open", 0), _target, lambda s: s[0] != "wait"), Transducer(0, _negation, lambda s: True),
             Transducer("plain", _reported, lambda s: True)]
    return reduce(Transducer.then, steps)


class Grammar:
    """The compiled transducers. ``stems``: learnt (prefix or whole word marked by a final ``$``) -> weight."""

    def __init__(self, stems: dict[str, float]):
        self.words = INSULTS | {k[:-1]: v for k, v in stems.items() if k.endswith("$")}
        self.stems = {k: v for k, v in stems.items() if not k.endswith("$")}
        parts = [rf"{re.escape(w)}\b" for w in sorted(self.words, key=len, reverse=True)] + [re.escape(s) for s in sorted(self.stems)]
        threats = [rf"{w}\b" for w in sorted(THREAT_VERBS)]
        self.paths = clauses()
        #: Only texts in which this finds something can have a clause that matches.
        self.trigger = re.compile(r"\b(?:" + "|".join(parts + threats) + ")")

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def symbol(self, token: str) -> tuple[int, float]:
        """Classes of a word, and its weight as an insult."""
        if not token[0].isalpha():
            return QUOTE, 0.0
        weight = self.weight(token)
        return ((NEG if token in NEGATION else 0) | (REP if token in REPORTING else 0) | (INT if token in INTENT else 0)
                | (TAR if token in TARGETS else 0) | (VERB if token in THREAT_VERBS else 0) | (INS if weight else 0)), weight

    def clause(self, text: str) -> float:
        """Weight of the best path of a clause through the composed transducers."""
        tokens = TOKEN.findall(text.replace("'", "").replace("’", ""))
        return min(CERTAIN, self.paths.best([self.symbol(w) for w in tokens]))

    def score(self, text: str | None) -> tuple[float, int]:
        """Noisy-or over the clauses that match, and how many do."""
        if not text:
            return 0.0, 0
        low = text.lower()
        clear, clauses, last = 1.0, 0, -1
        for m in self.trigger.finditer(low):
            if m.start() < last:
                continue
            start = max(low.rfind(c, 0, m.start()) for c in ".!?;:\n\r…") + 1 if last < 0 else max(last, 0)
            # The clause around the match; what lies between two matches of one clause is read once.
            c = CLAUSE.match(low, _clause_start(low, m.start(), max(start, 0)))
            last = c.end() if c else m.end()
            value = self.clause(c.group()) if c else 0.0
            if value:
                clear, clauses = clear * (1 - value), clauses + 1
        return 1 - clear, clauses


def _clause_start(low: str, at: int, floor: int) -> int:
    k = at
    while k > floor and low[k - 1] not in ".!?;:\n\r…":
        k -= 1
    return k


def _features(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add(w + "$")
        for n in STEMS:
            if len(w) > n:
                out.add(w[:n])
    return out


def learn(docs: DataFrame, labels: DataFrame, rounds: int = 3, per_round: int = 64, share: float = 0.2, least: int = 3,
          precision: float = 0.95, sample: int = 20_000, prior: float = 3.0) -> dict[str, float]:
    """Words and stems that mark toxic documents, with their precision as weights, shrunk by ``prior`` clean documents.

    The features found are the best of very many, so a rare one looks better than it is; shrunk, one clause with it does
    not reach the threshold, two do.

    Learns from at most ``sample`` labelled rows outside the held-out third, taken by hash of the id. Features are counted
    in tasks and summed by Spark; at most ``per_round`` features a round come to the driver.
    """
    label = (labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(~held_out()))
    label = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids and marks: texts stay where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(label), "doc_id").select("text", "toxic")
    known: dict[str, float] = {}
    for _ in range(rounds):
        found = _round(rows, Grammar(known) if known else None, per_round, share, least, precision, prior)
        new = {k: v for k, v in found.items() if k not in known}
        if not new:
            break
        known |= new
    return known


def _round(rows: DataFrame, grammar: Grammar | None, per_round: int, share: float, least: int, precision: float,
           prior: float) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and not (y == 1 and grammar and grammar.trigger.search(text.lower())):
                    (toxic if y == 1 else clean).update(_features(text))
        seen = list(toxic)  # a feature of clean documents only is of no use
        rest = [f for f in clean if f not in toxic]
        for names in (seen, rest):
            for k in range(0, len(names), 50_000):
                part = names[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[f] for f in part], pa.int64()),
                                                  pa.array([clean[f] for f in part], pa.int64())], ["feature", "toxic", "clean"])

    counts = rows.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = (counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
            .orderBy(F.desc("toxic"), F.length("feature"), "feature").limit(per_round).collect())
    if not good:
        return {}
    floor = share * good[0]["toxic"]
    # Of a stem and a longer form found as often, the longer one says what was seen.
    good = [r for r in good if not any(o["feature"] != r["feature"] and o["feature"].startswith(r["feature"]) and o["toxic"] >= 0.9 * r["toxic"]
                                       for o in good)]
    return {r["feature"]: min(0.97, r["toxic"] / (r["toxic"] + r["clean"] + prior)) for r in good if r["toxic"] >= floor}


def score(docs: DataFrame, stems: dict[str, float], threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``n_clauses`` (matched) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for b in batches:
            found = [grammar.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()),
                                              pa.array([n for _, n in found], pa.int32())], ["doc_id", "score", "n_clauses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_clauses int")
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
