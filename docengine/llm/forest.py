"""Random-projection trees and their search through one shared priority queue.

A tree's inner nodes hold a plane; its leaves hold rows. The queue of a query holds
unexpanded branches of all trees, ordered by priority: the smallest distance by which the
query lies on the wrong side of a plane on the way to the branch (0 for none, at the
roots). Taking a branch walks down to one leaf and puts the branches passed by into the
queue, so that only planes on visited ways are computed: for ``probes`` leaves at most
probes x depth of them, however many leaves there are. Queries run in batches; a batch's
queues are rows of one array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

FEW = 400  # points that place a plane


class Tree:
    """Planes fitted on rows x until no leaf has more than ``leaf`` of them. A node's
    children are inner nodes from 0 on, or leaves as -1 - number."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        planes, offsets, children, leaves = [], [], [], []
        todo = [(np.arange(len(x)), -1, 0)]
        self.root = 0
        while todo:
            rows, parent, side = todo.pop()
            if len(rows) <= leaf:
                place = -1 - len(leaves)
                leaves.append(rows)
            else:
                place = len(planes)
                plane = self._plane(x[rows], rng)
                along = x[rows] @ plane
                order = np.argsort(along, kind="stable")
                # halves by rank, so that equal rows can't make a leaf larger than asked for
                half = len(rows) // 2
                planes.append(plane)
                offsets.append((along[order[half - 1]] + along[order[half]]) / 2)
                children.append([0, 0])
                todo.append((rows[order[:half]], place, 0))
                todo.append((rows[order[half:]], place, 1))
            if parent < 0:
                self.root = place
            else:
                children[parent][side] = place
        width = x.shape[1]
        self.planes = np.array(planes, dtype=np.float32).reshape(-1, width)
        self.offsets = np.array(offsets, dtype=np.float32)
        self.children = np.array(children, dtype=np.int64).reshape(-1, 2)
        self.leaves = leaves

    @staticmethod
    def _plane(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The direction between the means of the neighbourhoods of two random points."""
        few = x[rng.choice(len(x), min(len(x), FEW), replace=False)]
        a, b = few[rng.choice(len(few), 2, replace=False)]
        for _ in range(4):
            side = few @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = few[side].mean(axis=0), few[~side].mean(axis=0)
        w = a - b
        size = np.linalg.norm(w)
        if size < 1e-9:
            w = rng.standard_normal(x.shape[1])
            size = np.linalg.norm(w)
        return (w / size).astype(np.float32)


class Forest:
    """Trees with common numbering: nodes and leaves of all trees stand one after another."""

    def __init__(self, trees: Sequence[Tree]):
        nodes = np.cumsum([0, *(len(t.planes) for t in trees)])
        leaves = np.cumsum([0, *(len(t.leaves) for t in trees)])
        self.planes = np.concatenate([t.planes for t in trees])
        self.offsets = np.concatenate([t.offsets for t in trees])
        moved = [np.where(t.children >= 0, t.children + n, t.children - m) for t, n, m in zip(trees, nodes, leaves, strict=False)]
        self.children = np.concatenate(moved)
        self.roots = np.array([t.root + n if t.root >= 0 else t.root - m for t, n, m in zip(trees, nodes, leaves, strict=False)])
        self.count = int(leaves[-1])

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The leaves of the ``probes`` best branches of each row, in the order of the queue
        (all leaves where there are fewer): the first visits of the trees come first, since
        their roots have the best priority."""
        n, trees = len(x), len(self.roots)
        probes = min(probes, self.count)
        room = trees + 64
        node = np.zeros((n, room), dtype=np.int64)
        cost = np.full((n, room), np.inf, dtype=np.float32)
        node[:, :trees] = self.roots
        cost[:, :trees] = -1.0
        used = np.full(n, trees)
        out = np.empty((n, probes), dtype=np.int64)
        every = np.arange(n)
        for p in range(probes):
            best = cost.argmin(axis=1)
            at, price = node[every, best], np.maximum(cost[every, best], 0)
            cost[every, best] = np.inf
            active = np.flatnonzero(at >= 0)
            while len(active):
                here = at[active]
                margin = np.einsum("ij,ij->i", x[active], self.planes[here]) - self.offsets[here]
                side = (margin > 0).astype(np.int64)
                slot = used[active]
                if slot.max() >= node.shape[1]:
                    node = np.concatenate([node, np.zeros((n, 64), dtype=np.int64)], axis=1)
                    cost = np.concatenate([cost, np.full((n, 64), np.inf, dtype=np.float32)], axis=1)
                node[active, slot] = self.children[here, 1 - side]
                cost[active, slot] = np.maximum(price[active], np.abs(margin))
                used[active] += 1
                at[active] = self.children[here, side]
                active = active[at[active] >= 0]
            out[:, p] = -1 - at
        return out
