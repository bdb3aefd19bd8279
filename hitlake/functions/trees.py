"""Boosted trees on binned features: logistic loss, Newton steps, one histogram for each node and feature.

A value's bin is the number of edges at or below it, plus one; bin 0 holds missing values. At each split
missing values go to the side that gains more. Trees grow leaf by leaf, the most gainful leaf first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Rate, leaves of a tree, rows of a leaf, and the least sum of second derivatives in one.
RATE, LEAVES, ROWS, CURVATURE = 0.1, 31, 20, 1e-3


@dataclass
class Forest:
    """Trees of at most 32 leaves as flat arrays, (trees, nodes): a node's feature (-1 for a leaf), last bin to the left, side of missing values, left child (the right is next) and value."""

    base: float
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    value: np.ndarray
    _tables: tuple | None = field(default=None, repr=False, compare=False)

    def tables(self, features: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and feature the leaves that a bin leaves possible, as bits, (trees, features, 256); and the leaves' values, (trees, 32).

        Leaves are numbered from left to right. A bin that goes right at a node rules out the leaves on
        its left; the lowest leaf that no node rules out is the row's.
        """
        if self._tables is None:
            allowed = np.full((len(self.feature), features, 256), 0xFFFFFFFF, np.uint32)
            values, every = np.zeros((len(self.feature), 32)), np.arange(256)
            for t in range(len(self.feature)):
                n = 0

                def visit(k: int, t: int = t) -> int:
                    """Bits of the leaves below a node."""
                    nonlocal n
                    j = self.feature[t, k]
                    if j < 0:
                        values[t, n], n = self.value[t, k], n + 1
                        return 1 << (n - 1)
                    low = visit(self.left[t, k])
                    right = (every > self.bin[t, k]) | ((every == 0) & ~self.missing_left[t, k])
                    allowed[t, j, right] &= np.uint32(0xFFFFFFFF ^ low)
                    return low | visit(self.left[t, k] + 1)

                visit(0)
            self._tables = allowed, values
        return self._tables


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of columns, at most 255 each, in 8 bits."""
    out = np.zeros(x.shape, np.uint8, order="F")
    for j, e in enumerate(edges):
        known = np.isfinite(x[:, j])
        out[known, j] = np.searchsorted(e, x[known, j], "right") + 1
    return out


def _histogram(bins: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, times: np.ndarray | None = None) -> np.ndarray:
    """(3, features, width): sums of gradients, second derivatives and rows."""
    out = np.empty((3, bins.shape[1], width))
    gr, hr, tr = g[rows], h[rows], None if times is None else times[rows]
    for j in range(bins.shape[1]):
        own = bins[:, j].take(rows).astype(np.intp)
        out[0, j], out[1, j], out[2, j] = np.bincount(own, gr, width), np.bincount(own, hr, width), np.bincount(own, tr, width)
    return out


def _best_split(hist: np.ndarray) -> tuple[float, int, int, bool]:
    """(gain, feature, last bin to the left, missing to the left); gain 0 where no split helps."""
    best, (g, h, n) = (0.0, 0, 0, False), hist[:, 0].sum(axis=1)
    if n < 2 * ROWS:
        return best
    left = np.cumsum(hist[:, :, 1:-1], axis=2)
    for missing_left in (False, True) if hist[2, :, 0].any() else (False,):
        if missing_left:
            left += hist[:, :, :1]
        other_h, other_n = h - left[1], n - left[2]
        fits = (left[2] >= ROWS) & (other_n >= ROWS) & (left[1] >= CURVATURE) & (other_h >= CURVATURE)
        gain = np.where(fits, left[0] ** 2 / np.where(fits, left[1], 1.0) + (g - left[0]) ** 2 / np.where(fits, other_h, 1.0), -np.inf)
        at = int(gain.argmax())
        if gain.flat[at] - g * g / h > best[0]:
            j, b = divmod(at, gain.shape[1])
            best = float(gain.flat[at] - g * g / h), j, b + 1, missing_left
    return best


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, leaves: int = LEAVES, times: np.ndarray | None = None) -> tuple[list, np.ndarray]:
    """One tree, as nodes [feature, bin, missing_left, left, value], and each row's leaf value. times: how often each row stands; g and h are of all its times."""
    rows, values = [np.arange(len(g))], np.zeros(len(g))
    nodes = [[-1, 0, False, 0, 0.0]]
    hists = {0: _histogram(bins, rows[0], g, h, width, times)}
    open_ = {0: _best_split(hists[0])}
    for _ in range(leaves - 1):
        at = max(open_, key=lambda k: (open_[k][0], -k))
        gain, j, b, missing_left = open_.pop(at)
        if gain <= 1e-9:
            break
        own = bins[:, j].take(rows[at])
        goes = (own <= b) & ((own > 0) | missing_left)
        parts = rows[at][goes], rows[at][~goes]
        left = len(nodes)
        nodes[at][:4] = [j, b, missing_left, left]
        nodes += [[-1, 0, False, 0, 0.0], [-1, 0, False, 0, 0.0]]
        rows += list(parts)
        small = int(len(parts[1]) < len(parts[0]))
        hists[left + small] = _histogram(bins, parts[small], g, h, width, times)
        hists[left + 1 - small] = hists.pop(at) - hists[left + small]
        for k in (left, left + 1):
            open_[k] = _best_split(hists[k])
        if len(nodes) >= 2 * leaves - 1:
            break
    for k, node in enumerate(nodes):
        if node[0] < 0:
            own = rows[k]
            node[4] = float(-g[own].sum() / max(h[own].sum(), 1e-12) * RATE)
            values[own] = node[4]
    return nodes, values


def boost(bins: np.ndarray, y: np.ndarray, rounds: int, leaves: int = LEAVES, times: np.ndarray | None = None) -> Forest:
    """bins (n, features) as binned() gives them; y 0 or 1; times: how often each row stands, else once.

    All start from even odds, not from the rows' own, so that scores of folds with other shares of labels compare after few rounds too.
    """
    base = 0.0
    raw, trees, width = np.full(len(y), base), [], int(bins.max()) + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        nodes, values = grow(bins, g if times is None else g * times, h if times is None else h * times, max(width, 3), leaves, times)
        raw += values
        trees.append(nodes)
    return stacked(base, trees)


def stacked(base: float, trees: list[list]) -> Forest:
    """Trees as grow() and Growing.tree() give them, as one forest."""
    size = max((len(t) for t in trees), default=1)
    flat = lambda k, kind: np.array([[n[k] for n in t] + [(-1, 0, False, 0, 0.0)[k]] * (size - len(t)) for t in trees], kind).reshape(len(trees), size)
    return Forest(base, flat(0, np.int16), flat(1, np.uint8), flat(2, bool), flat(3, np.int32), flat(4, np.float64))


@dataclass
class Growing:
    """A tree whose nodes are measured elsewhere: grow()'s order of splits, asked for as many nodes at once as may be needed.

    nodes: [feature, bin, missing to the left, left child] of each node, 0 for no child. known: (gain, feature, bin, missing to the left, value) of each measured one.
    """

    leaves: int = LEAVES
    nodes: list[list] = field(default_factory=lambda: [[-1, 0, False, 0]])
    known: dict[int, tuple] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)

    def asks(self) -> list[int]:
        """Nodes that must be measured before the next split is known; none for a tree that is complete."""
        if not self.known:
            return [0]
        open_, self.order = [0], []  # in the order in which grow() numbers them
        while len(open_) < self.leaves:
            ready = [k for k in sorted(open_, key=lambda k: -self.known[k][0]) if self.known[k][0] > 1e-9][: self.leaves - len(open_)]
            if not ready:
                break
            at = ready[0]
            if not self.nodes[at][3]:
                new = [k for k in ready if not self.nodes[k][3]]
                for k in new:
                    self.nodes[k] = [*self.known[k][1:4], len(self.nodes)]
                    self.nodes += [[-1, 0, False, 0], [-1, 0, False, 0]]
                return [c for k in new for c in (self.nodes[k][3], self.nodes[k][3] + 1)]
            open_.remove(at)
            open_ += [self.nodes[at][3], self.nodes[at][3] + 1]
            self.order.append(at)
        return []

    def tree(self) -> list[list]:
        """The complete tree as grow() gives it."""
        out, place = [[-1, 0, False, 0, self.known[0][4]]], {0: 0}
        for at in self.order:
            j, b, missing_left, left = self.nodes[at]
            out[place[at]] = [j, b, missing_left, len(out), 0.0]
            for c in (left, left + 1):
                place[c] = len(out)
                out.append([-1, 0, False, 0, self.known[c][4]])
        return out


def parts(nodes: list[list], bins: np.ndarray) -> dict[int, np.ndarray]:
    """Rows at each of a growing tree's nodes."""
    rows = {0: np.arange(len(bins))}
    for k, (j, b, missing_left, left) in enumerate(nodes):
        if left:
            own = bins[:, j].take(rows[k])
            goes = (own <= b) & ((own > 0) | missing_left)
            rows[left], rows[left + 1] = rows[k][goes], rows[k][~goes]
    return rows


def measured(hist: np.ndarray) -> tuple[float, int, int, bool, float]:
    """What Growing has to know of a node: its best split, and its value as a leaf."""
    g, h = hist[:2, 0].sum(axis=1)
    return *_best_split(hist), float(-g / max(h, 1e-12) * RATE)


def probability(forest: Forest, bins: np.ndarray) -> np.ndarray:
    """Of label 1, for each row; equal rows are looked up once."""
    if not len(bins):
        return np.zeros(0)
    _, first, same = np.unique(np.ascontiguousarray(bins).view(np.dtype((np.void, bins.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return (1 / (1 + np.exp(-raw_scores(forest, bins[first]))))[same.ravel()]


def raw_scores(forest: Forest, bins: np.ndarray) -> np.ndarray:
    """The sum of the trees' values for each row."""
    raw = np.full(len(bins), forest.base)
    columns = [np.ascontiguousarray(bins[:, j]) for j in range(bins.shape[1])]
    for allowed, values in zip(*forest.tables(len(columns)), strict=True):
        left = allowed[0][columns[0]]
        for j in range(1, len(columns)):
            left &= allowed[j][columns[j]]
        lowest = (left & (~left + np.uint32(1))).astype(np.float32).view(np.int32)
        raw += values[(lowest >> 23) - 127]  # the exponent is the place of the lowest bit
    return raw
