"""Forests of extremely random trees: thresholds drawn per node, all trees grown side by side.

A level takes two scans, whatever the number of trees, masks and folds: one for the least and greatest
value of every feature in every open node, one for the rows and sums on the left of a threshold drawn
between them. The best of a node's drawn splits is taken. The first nodes of all trees of a fit hold the same
rows, which are counted once between the sorted thresholds of these trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np

from featurelab.functions.draws import SEED
from featurelab.models.trees import BinnedTable, Block, Ensemble, Fit, Tree, _learned

# Bytes of sums asked for by one scan; trees of which there are more go one page after the other.
_SCAN_BYTES = 64 << 20


@dataclass(frozen=True)
class Forest:
    """All rows and no bootstrap. A node of fewer than twice ``leaf_rows`` rows, or whose target is constant, is a leaf."""

    trees: int = 200
    depth: int = 30
    leaf_rows: int = 1
    seed: int = SEED


def node_draw(seed: int, tree: int, node: int, feature: int) -> float:
    """A number from 0 to 1 by its keys alone: the first 32 bits of their MD5."""
    return int(hashlib.md5(f"{seed}|{tree}|{node}|{feature}".encode()).hexdigest()[:8], 16) / 2**32


class _Growing:
    """A tree on its way. Nodes are numbered as they come; ``told`` holds rows, sum and squares of each."""

    def __init__(self, fit: Fit, number: int):
        self.fit, self.number = fit, number
        self.columns = np.array(fit.features, dtype=np.int64)
        self.feature, self.cut, self.left, self.value = [-1], [0.0], [0], [0.0]
        self.told: list[np.ndarray | None] = [None]
        self.open_ = np.array([0])
        self.cuts = np.zeros((0, 0))

    def tree(self) -> Tree:
        kinds = (np.int64, np.float64, np.int64, np.float64)
        return Tree(*(np.array(x, dtype=k) for x, k in zip((self.feature, self.cut, self.left, self.value), kinds, strict=True)))

    def draw(self, ends: np.ndarray) -> None:
        """Thresholds of all open nodes between the ends (least, minus greatest) of their features."""
        low, high = ends[..., 0], -ends[..., 1]
        seed = self.fit.settings.seed
        share = np.array([[node_draw(seed, self.number, int(n), int(c)) for c in self.columns] for n in self.open_])
        self.cuts = np.where(low < high, low + share * (high - low), np.inf)

    def split(self, sums: np.ndarray, deeper: bool) -> None:
        settings, still = self.fit.settings, []
        least = max(1, settings.leaf_rows)
        whole = sums[:, -1]
        left = sums[:, :-1]
        right = whole[:, None] - left
        allowed = (left[..., 0] >= least) & (right[..., 0] >= least)
        force = sum(x[..., 1] ** 2 / np.maximum(x[..., 0], 1) for x in (left, right))
        force = np.where(allowed, force, -np.inf)
        for k, node in enumerate(self.open_.tolist()):
            rows, total, squares = whole[k]
            if node == 0:
                self.value[0] = total / rows if rows else 0.0
            spread = squares - total * total / max(rows, 1)
            top = force[k].max(initial=-np.inf)
            if top == -np.inf or spread <= 1e-12 * max(squares, 1e-300):
                continue
            best = int(np.argmax(force[k] >= top * (1 - 1e-12)))
            self.feature[node], self.cut[node], self.left[node] = int(self.columns[best]), float(self.cuts[k, best]), len(self.feature)
            for side in (left[k, best], right[k, best]):
                if deeper and side[0] >= 2 * least:
                    still.append(len(self.feature))
                for told, x in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.value, side[1] / side[0])):
                    told.append(x)
        self.open_ = np.array(still, dtype=np.int64)


def _rows_of(block: Block, fit: Fit, tree: Tree, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in open nodes and which of these, in order of the nodes."""
    rows = np.flatnonzero(_learned(block, fit))
    slot = np.full(tree.numNodes, -1)
    slot[open_] = np.arange(open_.size)
    at = slot[tree.leaves(block.bins, rows)]
    rows, at = rows[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    return rows[order], at[order]


def _ends(plans: list[tuple], part: Iterator[Block]) -> Iterator[np.ndarray]:
    found = [np.full((open_.size, columns.size, 2), np.inf) for _, _, open_, columns, _ in plans]
    for block in part:
        for (fit, tree, open_, columns, _), ends in zip(plans, found, strict=True):
            rows, at = _rows_of(block, fit, tree, open_)
            if not rows.size:
                continue
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            for c, feature in enumerate(columns):
                values = block.bins[feature, rows]
                for k, x in ((0, values), (1, -values)):
                    ends[at[heads], c, k] = np.minimum(ends[at[heads], c, k], np.minimum.reduceat(x, heads))
    yield np.concatenate([x.ravel() for x in found])


def _lefts(plans: list[tuple], part: Iterator[Block]) -> Iterator[np.ndarray]:
    found = [np.zeros((open_.size, columns.size + 1, 3)) for _, _, open_, columns, _ in plans]
    first: dict[Fit, list[int]] = {}
    for i, (fit, tree, *_) in enumerate(plans):
        if tree.numNodes == 1:
            first.setdefault(fit, []).append(i)
    steps = {fit: np.sort(np.concatenate([plans[i][4] for i in own]), axis=0) for fit, own in first.items()}  # tree x feature
    between = {fit: np.zeros((x.shape[1], len(x) + 1, 3)) for fit, x in steps.items()}
    for block in part:
        for fit, cuts in steps.items():
            rows = np.flatnonzero(_learned(block, fit))
            target = block.target[rows]
            for c, feature in enumerate(plans[first[fit][0]][3]):
                at = np.searchsorted(cuts[:, c], block.bins[feature, rows], "left")  # thresholds below the value
                for k, x in enumerate((None, target, target * target)):
                    between[fit][c, :, k] += np.bincount(at, x, minlength=len(cuts) + 1)
        for (fit, tree, open_, columns, cuts), sums in zip(plans, found, strict=True):
            if tree.numNodes == 1:
                continue
            rows, at = _rows_of(block, fit, tree, open_)
            target = block.target[rows]
            for c in range(columns.size + 1):
                inside = block.bins[columns[c], rows] <= cuts[at, c] if c < columns.size else np.ones(rows.size, dtype=bool)
                for k, x in enumerate((None, target, target * target)):
                    sums[:, c, k] += np.bincount(at[inside], None if x is None else x[inside], minlength=open_.size)
    for fit, own in first.items():
        upto = between[fit].cumsum(axis=1)
        for i in own:
            for c, cut in enumerate(plans[i][4][0]):
                found[i][0, c] = upto[c, np.searchsorted(steps[fit][:, c], cut, "left")]
            found[i][0, -1] = upto[0, -1] if len(upto) else 0.0
    yield np.concatenate([x.ravel() for x in found])


def _pages(growing: list[_Growing]) -> Iterator[list[_Growing]]:
    page, size = [], 0
    for one in growing:
        own = 24 * one.open_.size * (one.columns.size + 1)
        if page and size + own > _SCAN_BYTES:
            yield page
            page, size = [], 0
        page.append(one)
        size += own
    if page:
        yield page


def _scan(table: BinnedTable, task, growing: list[_Growing], width: int, extra: int, least: bool) -> list[np.ndarray]:
    plans = [(g.fit, g.tree(), g.open_, g.columns, g.cuts) for g in growing]
    shapes = [(g.open_.size, g.columns.size + extra, width) for g in growing]
    flat = table.total(table.blocks, partial(task, plans), np.minimum if least else np.add)
    parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return [x.reshape(s) for x, s in zip(parts, shapes, strict=True)]


def grow_forests(table: BinnedTable, fits: list[Fit]) -> list[Ensemble]:
    """The forests of all fits over a table of values (``binned`` with ``bins`` None); ``settings`` of the fits
    are ``Forest``. An ensemble's margin is the mean of its trees.

    The trees themselves are held on the driver: about 64 bytes a row and tree if every row is a leaf, which
    ``leaf_rows`` and ``depth`` bound. A fit without training rows is a constant 0.
    """
    every = [_Growing(fit, t) for fit in fits for t in range(fit.settings.trees)]
    level, growing = 0, [g for g in every if g.fit.settings.depth > 0]
    while growing:
        for page in _pages(growing):
            # All trees of a fit begin with the same node.
            asked = list({g.fit: g for g in page}.values()) if level == 0 else page
            ends = _scan(table, _ends, asked, 2, 0, True)
            of_fit = {g.fit: x for g, x in zip(asked, ends, strict=True)} if level == 0 else {}
            for k, g in enumerate(page):
                g.draw(of_fit[g.fit] if level == 0 else ends[k])
            for g, sums in zip(page, _scan(table, _lefts, page, 3, 1, False), strict=True):
                g.split(sums, level + 1 < g.fit.settings.depth)
        level += 1
        growing = [g for g in growing if g.open_.size]
    found, at = [], 0
    for fit in fits:
        own, at = every[at : at + fit.settings.trees], at + fit.settings.trees
        trees = [g.tree() for g in own]
        found.append(Ensemble(fit, 0.0, [Tree(t.feature, t.cut, t.left, t.value / len(trees)) for t in trees]))
    return found
