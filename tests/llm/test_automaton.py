import random

from docengine.llm.automaton import Automata
from docengine.llm.scans import MISREAD

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _one_edit(w, letters=LETTERS):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return (out | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}) - {w, ""}


def test_all_neighbours_come_back():
    words = ["company", "statement", "collateral", "borrower", "repayment", "covenant", "amount", "interest"]
    trie = Automata(words)
    for w in words:
        near = sorted(_one_edit(w))
        assert all(c.get(w) == 1 for c in trie.candidates(near))
        rng = random.Random(w)
        far = sorted(set().union(*(_one_edit(x, "aenz") for x in rng.sample(near, 25))) - {w})
        far = [x for x in far if _distance(x, w, (), 2) is not None]  # not those edited within a swapped pair
        assert len(far) > 1000 and all(c.get(w, 99) <= 2 for c in trie.candidates(far))
    got = trie.candidates(["conpany", "compny", "companny", "statenent", "ocmpany", "zzzzzz", "", "x" * 100])
    assert [set(c) for c in got] == [{"company"}] * 3 + [{"statement"}, {"company"}, set(), set(), set()]


def _distance(a, b, pairs, most):
    """Restricted edit distance by dynamic programming."""
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best = 0 if i == j == 0 else 99
            if i and j:
                best = min(best, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i:
                best = min(best, d[i - 1, j] + 1)
            if j:
                best = min(best, d[i, j - 1] + 1)
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                best = min(best, d[i - 2, j - 2] + 1)
            for seen, meant in pairs:
                if a[:i].endswith(seen) and b[:j].endswith(meant):
                    best = min(best, d[i - len(seen), j - len(meant)] + 1)
            d[i, j] = best
    return d[len(a), len(b)] if d[len(a), len(b)] <= most else None


def test_equals_dynamic_programming_with_scanner_pairs():
    rng = random.Random(2)
    vocabulary = {"".join(rng.choice("ruinmdcl") for _ in range(rng.randint(1, 7))) for _ in range(60)}
    words = ["".join(rng.choice("ruinmdcl") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    got = Automata(vocabulary, MISREAD).candidates(words)
    for w, found in zip(words, got, strict=True):
        want = {v: n for v in vocabulary if v != w and (n := _distance(w, v, MISREAD, 2)) is not None}
        assert found == want, w


def test_empty_vocabulary_and_ties():
    assert Automata([]).candidates(["a", "b"]) == [{}, {}]
    assert Automata(["cat", "cat", "car"]).candidates(["cas", "cas"]) == [{"cat": 1, "car": 1}] * 2
