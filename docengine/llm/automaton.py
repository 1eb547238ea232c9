"""Levenshtein automata intersected with a vocabulary trie.

For a word of n characters the automaton's state after a path of the trie is, for each
number k of edits, the set of prefixes of the word that k edits turn into the path, held as
n + 1 bits. An edit inserts, deletes or substitutes a character, swaps two neighbours (which
are then left alone), or is one of the given pairs (what is seen for what is meant, of one or two characters each).
The trie is walked level by level for a block of words at once, one array element for each
(word, node) whose state is not empty, so that every word of the vocabulary within the
given number of edits is found and no branch without one is followed to its end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LONGEST = 62  # characters of a word; longer ones have no candidates
BLOCK = 512  # words walked at once
ONE = np.uint64(1)


class Automata:
    """The trie of a vocabulary, ready to be intersected with automata."""

    def __init__(self, vocabulary: Sequence[str], pairs: Sequence[tuple[str, str]] = ()):
        self.vocabulary = sorted(w for w in set(vocabulary) if 0 < len(w) <= LONGEST)
        letters = sorted({c for w in self.vocabulary for c in w} | {c for a, b in pairs for c in a + b})
        self.code = {c: i for i, c in enumerate(letters)}
        # level by level: nodes in the order of their prefixes
        parent_of: dict[str, int] = {"": 0}
        chars, firsts, counts, word = [0], [], [], [-1]
        low, high = [], []
        level = [("", 0, len(self.vocabulary))]
        while level:
            below = []
            for prefix, a, b in level:
                d = len(prefix)
                sizes = [len(w) for w in self.vocabulary[a:b]]
                low.append(min(sizes, default=0))
                high.append(max(sizes, default=0))
                if a < b and len(self.vocabulary[a]) == d:
                    word[parent_of[prefix]] = a
                    a += 1
                firsts.append(len(chars))
                at, n = a, 0
                while at < b:
                    c, end = self.vocabulary[at][d], at
                    while end < b and self.vocabulary[end][d] == c:
                        end += 1
                    parent_of[prefix + c] = len(chars)
                    chars.append(self.code[c])
                    word.append(-1)
                    below.append((prefix + c, at, end))
                    at, n = end, n + 1
                counts.append(n)
            level = below
        self.char, self.word = np.array(chars), np.array(word)
        self.first, self.count = np.array(firsts), np.array(counts)
        self.low, self.high = np.array(low), np.array(high)
        code = self.code
        self.two_for_one = [(code[a[0]], code[a[1]], code[b]) for a, b in pairs if len(a) == 2 and len(b) == 1]
        self.one_for_two = [(code[a], code[b[0]], code[b[1]]) for a, b in pairs if len(a) == 1 and len(b) == 2]

    def _block(self, words: Sequence[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(words)
        size = np.array([len(w) for w in words])
        mask = np.zeros((n, len(self.code)), dtype=np.uint64)
        for i, w in enumerate(words):
            for k, c in enumerate(w):
                if (j := self.code.get(c)) is not None:
                    mask[i, j] |= ONE << np.uint64(k)
        whole = (ONE << (size + 1).astype(np.uint64)) - ONE
        full = ONE << size.astype(np.uint64)
        at, node = np.arange(n), np.zeros(n, dtype=np.int64)
        state = [np.ones(n, dtype=np.uint64)]
        for _ in range(edits):
            state.append((state[-1] | state[-1] << ONE) & whole)
        before = [np.zeros(n, dtype=np.uint64)] * (edits + 1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            times = self.count[node]
            child = np.repeat(self.first[node] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
            rows = np.repeat(np.arange(len(at)), times)
            near = (self.low[child] <= size[at[rows]] + edits) & (self.high[child] >= size[at[rows]] - edits)
            child, rows = child[near], rows[near]
            word = at[rows]
            c, last = self.char[child], self.char[node[rows]]
            inner = node[rows] > 0
            m = mask[word, c]
            swap = np.where(inner, m & (mask[word, last] >> ONE), 0)
            after = [((state[0][rows] & m) << ONE)]
            for k in range(edits):
                r = state[k][rows]
                out = ((state[k + 1][rows] & m) << ONE) | r | (r << ONE) | (after[k] << ONE) | after[k]
                old = before[k][rows]
                out |= (old & swap) << np.uint64(2)
                for a, b, meant in self.two_for_one:
                    hit = np.flatnonzero(c == meant)
                    out[hit] |= (r[hit] & mask[word[hit], a] & (mask[word[hit], b] >> ONE)) << np.uint64(2)
                for a, first, second in self.one_for_two:
                    hit = np.flatnonzero(inner & (last == first) & (c == second))
                    out[hit] |= (old[hit] & mask[word[hit], a]) << ONE
                after.append(out & whole[word])
            live = after[edits] > 0
            before = [s[rows[live]] for s in state]
            state = [s[live] for s in after]
            at, node = word[live], child[live]
            end = self.word[node] >= 0
            if end.any():
                w = at[end]
                cost = np.full(len(w), edits + 1)
                for k in range(edits, -1, -1):
                    cost[(state[k][end] & full[w]) > 0] = k
                ok = cost <= edits
                found.append((w[ok], self.word[node[end]][ok], cost[ok]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def candidates(self, words: Sequence[str], edits: int = 2) -> list[dict[str, int]]:
        """For each word all words of the vocabulary within ``edits`` edits, itself left out,
        with the least number of edits."""
        out: list[dict[str, int]] = [{} for _ in words]
        asked = [i for i, w in enumerate(words) if 0 < len(w) <= LONGEST]
        asked.sort(key=lambda i: len(words[i]))
        for a in range(0, len(asked) if self.vocabulary else 0, BLOCK):
            part = asked[a : a + BLOCK]
            for w, v, cost in zip(*self._block([words[i] for i in part], edits), strict=True):
                i, meant = part[w], self.vocabulary[v]
                if meant != words[i]:
                    out[i][meant] = min(int(cost), out[i].get(meant, 99))
        return out
