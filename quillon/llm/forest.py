"""A forest of random-projection trees: fit on a sample, placing of vectors, and search by one priority queue over all trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from quillon.llm.shingles import mixed


@dataclass
class Forest:
    """All trees in one numbering. Node i parts vectors by their product with directions[i] at cuts[i]; a child below 0 is leaf -1 - child."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray  # nodes x 2
    roots: list[int]
    leaves: int


def coins(rows: np.ndarray, node: int | np.ndarray) -> np.ndarray:
    """A side for each row that lies on a node's cut, so that equal vectors are parted too."""
    return (mixed(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(node).astype(np.uint64)) >> np.uint64(33)) & np.uint64(1) == 1


def tree(units: np.ndarray, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(directions, cuts, children, leaves) of one tree over unit vectors; node 0 is the root, if there are nodes. A node's direction is
    the difference of two vectors drawn from it, its cut the median; it ends at `leaf` vectors."""
    rng = np.random.default_rng(seed)
    directions: list[np.ndarray] = []
    cuts: list[float] = []
    children: list[list[int]] = []
    leaves = 0
    todo = [(np.arange(len(units)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        if len(own) <= leaf:
            me = -1 - leaves
            leaves += 1
        else:
            me = len(cuts)
            for _ in range(4):
                a, b = rng.choice(own, 2, replace=False)
                direction = units[a] - units[b]
                size = np.linalg.norm(direction)
                if size > 1e-9:
                    direction = direction / size
                    break
                direction = np.zeros(units.shape[1])  # all alike: coins part them
            direction = direction.astype(np.float32).astype(np.float64)
            at = units[own] @ direction
            cut = float(np.median(at))
            right = (at > cut) | ((at == cut) & coins(own, me))
            if right.all() or not right.any():
                direction, cut = np.zeros_like(direction), 0.0
                right = coins(own, me)
                if right.all() or not right.any():
                    right = np.arange(len(own)) % 2 == 1
            directions.append(direction)
            cuts.append(cut)
            children.append([0, 0])
            todo += [(own[~right], me, 0), (own[right], me, 1)]
        if parent >= 0:
            children[parent][side] = me
    return np.array(directions).reshape(-1, units.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves


def joined(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Forest:
    """One forest of several trees."""
    roots, parts, nodes, leaves = [], [], 0, 0
    for _, cuts, children, own in trees:
        roots.append(nodes if len(cuts) else -1 - leaves)
        parts.append(np.where(children < 0, children - leaves, children + nodes))
        nodes, leaves = nodes + len(cuts), leaves + own
    return Forest(np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees]), np.concatenate(parts), roots, leaves)


def places(forest: Forest, units: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaf of every vector in every tree, as vectors x trees."""
    out = np.empty((len(units), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots):
        at = np.full(len(units), root)
        going = np.flatnonzero(at >= 0)
        while len(going):
            node = at[going]
            p = np.einsum("ij,ij->i", units[going], forest.directions[node]) - forest.cuts[node]
            right = (p > 0) | ((p == 0) & coins(rows[going], node))
            at[going] = forest.children[node, right.astype(np.int64)]
            going = going[at[going] >= 0]
        out[:, t] = -1 - at
    return out


def margins(forest: Forest, units: np.ndarray) -> np.ndarray:
    """Signed distances of vectors from the cut of every node."""
    return units @ forest.directions.T - forest.cuts


def visits(forest: Forest, margin: list[float], children: list[list[int]], most: int) -> list[int]:
    """The first `most` leaves that a query meets. One queue holds the branches not taken of all trees, the least sum of squared
    distances from the cuts that part the query from a branch first."""
    queue = [(0.0, root) for root in forest.roots]
    heapq.heapify(queue)
    found: list[int] = []
    while queue and len(found) < most:
        far, at = heapq.heappop(queue)
        while at >= 0:
            m = margin[at]
            near = 1 if m > 0 else 0
            heapq.heappush(queue, (far + m * m, children[at][1 - near]))
            at = children[at][near]
        found.append(-1 - at)
    return found
