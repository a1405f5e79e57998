"""The composed transducers of op1 against all ways to match short clauses."""

import random

from lexigraph.llm import toxicity as tox

WORDS = ["idiot", "veju", "kill", "beat", "will", "you", "them", "not", "nicht", "said", "dit", '"', "lorem", "ipsum", "dolor", "amet"]


def brute(g, tokens):
    """Each word that may be matched, with the rules spelt out on positions; the best of them counts."""
    words = [t for t in tokens if t != '"']
    quoted, inside, told = [], False, False
    for t in tokens:
        if t == '"':
            inside = not inside
        else:
            quoted.append(told or inside)
            told = told or t in tox.REPORTING
    best = 0.0
    for i, w in enumerate(words):
        after, values = words[i + 1:i + 4], [g.weight(w)]
        if w in tox.THREAT_VERBS and any(t in tox.INTENT for t in words[max(0, i - 3):i]) and any(t in tox.TARGETS for t in after):
            values.append(tox.THREAT)
        near = any(t in tox.TARGETS for t in words[max(0, i - 4):i] + after)
        for v in values:
            v *= (tox.BOOST if near else 1) * (tox.REPORTED if quoted[i] else 1)
            best = max(best, v * (tox.NEGATED if any(t in tox.NEGATION for t in words[max(0, i - 3):i]) else 1))
    return min(tox.CERTAIN, best)


def test_composition_against_all_matches_of_short_clauses():
    rng, g = random.Random(11), tox.Grammar({"veju": 0.9})
    seen = set()
    for _ in range(6000):
        tokens = [rng.choice(WORDS) for _ in range(rng.randrange(1, 10))]
        got, want = g.clause(" ".join(tokens)), brute(g, tokens)
        assert abs(got - want) < 1e-12, (tokens, got, want)
        seen.add(round(want, 6))
    assert len(seen) > 10


def test_words_alone_compose_to_nothing():
    g = tox.Grammar({})
    assert g.clause("") == g.clause("kill you") == g.clause("you will") == g.clause('"') == 0.0
    assert g.clause("i will kill you") > 0.7 > g.clause("i will not kill you") > 0.0
    assert g.clause("x " * 50_000 + "you idiot") > 0.9  # one pass over a very long clause
    assert len(g.paths._known) < 2000
