"""A cover tree over vectors of one norm, kept as flat arrays, and its best-first search by inner product.

Candidates get one more component, sqrt(M^2 - |c|^2), so that all have norm M; a query gets a zero there, so inner products
stay the same. All candidates then lie on a sphere, and a node whose members are within the chord r of its centre is a cap
of the angle 2 asin(r / 2M): an anchor at the angle t from the centre has inner products between |q| M cos(t + cap) and
|q| M cos(t - cap) with all members. Each level covers a node's members by centres at most half its radius away; members
that are alone under their centre stay in the node as points of their own. A node of few members, or of members that are
all the same, is not divided.

Bounds only decide what is looked at; scores are exact integer inner products.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np

from flowlake.llm.vectors import EXACT, exact

#: Members up to which a node is not divided, and centres after which members that only stand alone are left as points.
LEAF, CENTRES = 48, 256
#: A tree of its own is made for each label with so many rows; the others share one.
OWN_TREE = 64
_MIXED, _SHARED = np.int64(0), np.int64(1)


def augmented(vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows of float64 with one more component, so that all have the squared norm ``most``."""
    v = vectors.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(float(most) - (v * v).sum(axis=1), 0.0))[:, None]])


@dataclass
class Forest:
    """Nodes in level order: each has a centre (a row), a radius, rows of its own [first, last) and children [begin, end);
    roots come first. Rows of a tree of one label have its label; ``shared`` is the node's tree of several labels."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    most: int
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    shared: np.ndarray
    roots: int

    def __post_init__(self):
        peak = int(np.abs(self.vectors).max(initial=0))
        self.safe = self.vectors.shape[1] * peak * peak < EXACT
        self.rows = exact(self.vectors, self.safe)
        self.norm = float(self.most) ** 0.5
        self.cap = 2 * np.arcsin(np.minimum(1.0, self.radius / (2 * self.norm))) if self.norm else np.zeros(len(self.radius))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        # the largest squared norm may be beyond 64 bits
        np.savez(out, most=np.frombuffer(str(self.most).encode(), dtype=np.uint8), roots=np.int64(self.roots), **{k: getattr(self, k) for k in _ARRAYS})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> "Forest":
        with np.load(io.BytesIO(data)) as z:
            return Forest(most=int(z["most"].tobytes()), roots=int(z["roots"]), **{k: z[k] for k in _ARRAYS})

    def search(self, query: np.ndarray, label: int, same: bool, windows: list[tuple[int | None, int | None]], k: int, without: int | None = None) -> list[list[tuple[int, int]]]:
        """For each window (least and largest score, None: open), the first k (score, id) of rows with the same label (or of
        those with another): highest scores first, then smallest ids."""
        peak = int(np.abs(query).max(initial=0))
        if self.safe and len(query) * peak * max(peak, int(np.abs(self.vectors).max(initial=0))) < EXACT:
            q, rows = query.astype(np.float64), self.rows
        else:
            q, rows = query.astype(object), self.vectors.astype(object)
        length = float(sum(x * x for x in query.tolist())) ** 0.5
        found = [_Best(low, high, k) for low, high in windows]

        def bounds(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = (rows[self.centre[nodes]] @ q).astype(np.float64)
            full = length * self.norm
            if full == 0:
                return np.full(len(nodes), -1.0), np.full(len(nodes), 1.0)
            angle = np.arccos(np.clip(s / full, -1.0, 1.0))
            margin = 1 + 1e-7 * full  # of rounding in angles
            return full * np.cos(np.minimum(np.pi, angle + self.cap[nodes])) - margin, full * np.cos(np.maximum(0.0, angle - self.cap[nodes])) + margin

        def push(nodes: np.ndarray) -> None:
            low, high = bounds(nodes)
            for node, a, b in zip(nodes.tolist(), low.tolist(), high.tolist()):
                if any(w.open(a, b) for w in found):
                    heapq.heappush(heap, (-b, a, node))

        heap: list[tuple[float, float, int]] = []
        roots = np.arange(self.roots)
        push(roots[(self.shared[roots] == _SHARED) | ((self.labels[self.centre[roots]] == label) == same)])
        while heap:
            high, low, node = heapq.heappop(heap)
            if not any(w.open(low, -high) for w in found):
                continue
            a, b = int(self.first[node]), int(self.last[node])
            if b > a:
                s, ids = rows[a:b] @ q, self.ids[a:b]
                if self.shared[node] == _SHARED or without is not None:
                    keep = (self.labels[a:b] == label) == same
                    if without is not None:
                        keep &= ids != without
                    s, ids = s[keep], ids[keep]
                for w in found:
                    w.take(s, ids)
            if self.end[node] > self.begin[node]:
                push(np.arange(self.begin[node], self.end[node]))
        return [w.rows() for w in found]


_ARRAYS = ("ids", "labels", "vectors", "centre", "radius", "first", "last", "begin", "end", "shared")


class _Best:
    """The first k of a window so far."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def least(self) -> int | None:
        """A score below this is of no use."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def open(self, low: float, high: float) -> bool:
        """Whether a node with such bounds may hold a row that counts; ties still do, by their ids."""
        least = self.least
        return (least is None or high >= least) and (self.high is None or low <= self.high)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least
        keep = np.ones(len(scores), dtype=bool)
        if least is not None:
            keep &= scores >= least
        if self.high is not None:
            keep &= scores <= self.high
        if not keep.any():
            return
        scores, ids = scores[keep], ids[keep]
        if len(scores) > 4 * self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= kth], ids[scores >= kth]
        scores = np.concatenate([self.scores, scores.astype(np.int64)])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def rows(self) -> list[tuple[int, int]]:
        return [(int(s), int(i)) for s, i in zip(self.scores, self.ids)]


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int) -> Forest:
    """A tree for each label with many rows, and one for all others."""
    sphere = augmented(vectors, most)
    order = np.argsort(labels, kind="stable")
    sets = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []
    small = [s for s in sets if len(s) < OWN_TREE]
    trees = [(s, _MIXED) for s in sets if len(s) >= OWN_TREE] + ([(np.concatenate(small), _SHARED)] if small else [])
    placed: list[np.ndarray] = []
    n_placed, nodes = 0, []
    level = [(members, int(members[0]), shared) for members, shared in trees]
    behind = len(level)  # the next free node
    while level:
        below = []
        for members, centre, shared in level:
            d = np.sqrt(((sphere[members] - sphere[centre]) ** 2).sum(axis=1))
            radius = float(d.max(initial=0.0))
            alone, groups = (members, []) if len(members) <= LEAF or radius == 0 else _cover(sphere, members, centre, radius / 2)
            nodes.append((centre, radius, n_placed, n_placed + len(alone), behind, behind + len(groups), shared))
            placed.append(alone)
            n_placed += len(alone)
            behind += len(groups)
            below += [(m, c, shared) for m, c in groups]
        level = below
    row = np.concatenate(placed) if placed else np.empty(0, dtype=np.int64)
    place = np.empty(len(row), dtype=np.int64)
    place[row] = np.arange(len(row))
    cols = [np.array(x) for x in zip(*nodes)] if nodes else [np.empty(0, dtype=np.int64)] * 7
    return Forest(ids[row], labels[row], vectors[row], most, place[cols[0].astype(np.int64)] if len(row) else cols[0], cols[1].astype(np.float64), *(c.astype(np.int64) for c in cols[2:]), roots=len(trees))


def _cover(sphere: np.ndarray, members: np.ndarray, centre: int, radius: float) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Members that stand alone, and (members, centre) of each group within ``radius`` of its centre."""
    alone: list[np.ndarray] = []
    groups: list[tuple[np.ndarray, int]] = []
    left, at = members, centre
    tried = 0
    while len(left):
        near = ((sphere[left] - sphere[at]) ** 2).sum(axis=1) <= radius * radius
        near |= left == at
        group, left = left[near], left[~near]
        if len(group) > 1:
            groups.append((group, at))
        else:
            alone.append(group)
        tried += 1
        if tried >= CENTRES and len(alone) * 10 >= tried * 9:
            alone.append(left)
            break
        if len(left):
            at = int(left[0])
    return (np.concatenate(alone) if alone else members[:0]), groups
