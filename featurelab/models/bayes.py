"""Naive Bayes for any number of classes.

Counts, sums and variances of every class are one grouped table. To predict, tasks walk over
that table in blocks and keep the best class of each row so far, so that neither the plan nor the
driver holds anything per class beyond one page of bounded size.

Gaussian classes are bounded from both sides over a box of rows: one that nowhere reaches what another one has
everywhere cannot be the best there. Boxes are cut in halves, each with the classes that its parent has left, until
few are; the classes found are the same as without. Of many classes, those that can be the best nowhere in the
space of the rows are put aside before any row meets them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.operators.profile import plain_column
from featurelab.sources.work import materialize

# Bytes of the class table sent to the tasks at a time: two million classes of two features.
PAGE_BYTES = 64 << 20
# Classes and cells (rows x classes) a task scores at a time.
_CLASS_BLOCK = 4096
_CELLS = 1 << 20
# Gaussian classes, or rows, of a box that is not cut any more, and rows that boxes are cut from at a time.
_LEAF = 64
_FEW_ROWS = 4
_ROWS_TOGETHER = 1 << 17
# Gaussian classes from which contenders are looked for: over so many boxes, whose bounds are those of the highest
# classes and of some drawn ones. Rows that tell where boxes are cut, bounds drawn on the driver, and classes that a task looks at together.
_MANY = 1 << 14
_BOXES = 1 << 12
_HIGHEST = 1 << 12
_DRAWN = 1 << 15
_CUT_ROWS = 1 << 14
_BOUNDS = 1 << 27
_CLASSES_TOGETHER = 1 << 18
# Share of a bound by which rounding may miss it.
_SLACK = 1e-9

_BEST = "score double, class double"


def _numbers(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Complete rows as doubles: class, x0, x1, ..."""
    return df.select(
        plain_column(target).cast("double").alias("class"),
        *[plain_column(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    ).na.drop()


@dataclass
class ClassTable:
    """One written row per class: its prior and, by feature, a first and a second parameter.

    multinomial: log shares; gaussian: means and variances.
    """

    table: DataFrame
    kind: str
    size: int
    classes: int

    def pages(self, page_bytes: int = PAGE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(classes, log priors, parameters by class) in ascending order of class, page by page."""
        pages = max(1, -(-self.classes * 8 * (2 + 2 * self.size) // page_bytes))
        for page in range(pages):
            here = self.table.where(F.pmod(F.xxhash64("class"), F.lit(pages)) == page).toArrow()
            found = np.column_stack([c.to_numpy() for c in here.columns]) if here.num_rows else np.empty((0, here.num_columns))
            found = found[np.argsort(found[:, 0], kind="stable")]
            yield found[:, 0], found[:, 1], found[:, 2:]


def class_table(train: DataFrame, features: list[str], target: str, kind: str, smoothing: float = 1.0) -> ClassTable:
    """Fit: two scans and one shuffle of a row per class and task, whatever the number of classes.

    Rows with a NULL or NaN in a feature or the target take no part. Shares of classes are plain; the
    multinomial model smooths the shares of features and refuses negative values (ValueError), the
    Gaussian adds 1e-9 of the largest variance to each. A table without rows raises ValueError.
    """
    data, xs = _numbers(train, features, target), [f"x{i}" for i in range(len(features))]
    whole = data.agg(
        F.count(F.lit(1)).alias("rows"), F.least(F.lit(0.0), *[F.min(x) for x in xs]).alias("low"),
        F.greatest(F.lit(0.0), *[F.var_pop(x) for x in xs]).alias("spread"),
    ).first()
    if not whole["rows"]:
        raise ValueError("no complete row to learn classes from")
    grouped, prior = data.groupBy("class"), F.log(F.count(F.lit(1)) / F.lit(float(whole["rows"]))).alias("prior")
    if kind == "multinomial":
        if whole["low"] < 0:
            raise ValueError("multinomial naive Bayes needs features of 0 or more")
        sums = [F.sum(x) for x in xs]
        total = sum(sums, F.lit(smoothing * len(xs)))
        told = [F.log((s + F.lit(smoothing)) / total).alias(x) for s, x in zip(sums, xs)]
    elif kind == "gaussian":
        extra = F.lit(1e-9 * whole["spread"])
        told = [F.avg(x).alias(x) for x in xs] + [(F.var_pop(x) + extra).alias(f"v{x}") for x in xs]
    else:
        raise ValueError(f"unknown kind: {kind}")
    table = materialize(grouped.agg(prior, *told), "classes")
    return ClassTable(table, kind, len(xs), table.count())


def _log_likelihood(kind: str, x: np.ndarray, prior: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Rows x classes."""
    if kind == "multinomial":
        return x @ told.T + prior
    size = x.shape[1]
    mean, spread = told[:, :size], told[:, size:]
    found = np.broadcast_to(prior - 0.5 * np.log(2 * np.pi * spread).sum(axis=1), (len(x), len(prior))).copy()
    for j in range(size):
        found -= np.square(x[:, j, None] - mean[:, j]) * (0.5 / spread[:, j])
    return found


@dataclass
class Leaves:
    """Gaussian classes, ascending, and what bounds them: one row a feature."""

    page: tuple[np.ndarray, np.ndarray, np.ndarray]
    height: np.ndarray  # the largest density, as a logarithm with the prior
    mean: np.ndarray
    half: np.ndarray  # what a squared distance counts by

    def bounds(self, low: np.ndarray, high: np.ndarray, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that some classes have in a box, up to rounding."""
        height = self.height[some]
        most, least = height.copy(), height.copy()
        with np.errstate(over="ignore"):
            for lo, hi, mean, half in zip(low, high, self.mean, self.half):
                mean, half = mean[some], half[some]
                below, above = lo - mean, mean - hi
                most -= np.square(np.maximum(np.maximum(below, above), 0.0)) * half
                least -= np.square(np.maximum(-below, -above)) * half
        return most, least

    def reaching(self, most: np.ndarray, least: float, some: np.ndarray | slice) -> np.ndarray:
        """Which of some classes may come up to ``least``."""
        if not np.isfinite(least):
            return np.ones(len(most), dtype=bool)
        with np.errstate(invalid="ignore"):
            return ~(most + _SLACK * (1.0 + np.abs(least) + np.abs(most) + 2 * np.abs(self.height[some])) < least)


def _bounded(page: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Leaves:
    classes, prior, told = page
    size = told.shape[1] // 2
    mean, spread = told[:, :size], told[:, size:]
    return Leaves(page, prior - 0.5 * np.log(2 * np.pi * spread).sum(axis=1), mean.T.copy(), (0.5 / spread).T.copy())


def _fair(prior: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Classes that bounds can be drawn for."""
    spread = told[:, told.shape[1] // 2 :]
    with np.errstate(divide="ignore", over="ignore"):
        return np.isfinite(told).all(axis=1) & np.isfinite(prior) & (spread > 0).all(axis=1) & np.isfinite(0.5 / spread).all(axis=1)


def _leaves(page: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Leaves | None:
    """None where there are few classes, or values no bound can be drawn from."""
    classes, prior, told = page
    return _bounded(page) if len(classes) > 2 * _LEAF and told.shape[1] and _fair(prior, told).all() else None


def _best_of_leaves(kind: str, x: np.ndarray, leaves: Leaves, score: np.ndarray, best: np.ndarray) -> None:
    """As ``_best_of``, where rows that lie together meet the classes that can be the best of one of them alone."""
    classes, prior, told = leaves.page
    fair = np.isfinite(x).all(axis=1)
    rest = np.flatnonzero(~fair)
    if len(rest):
        found, label = score[rest], best[rest]
        _best_of(kind, x[rest], leaves.page, found, label)
        score[rest], best[rest] = found, label
    if not fair.any():
        return
    scale = np.maximum(x[fair].std(axis=0), 1e-300)
    todo: list[tuple[np.ndarray, np.ndarray | slice]] = [(np.flatnonzero(fair), slice(None))]
    while todo:
        own, some = todo.pop()
        part = x[own]
        low, high = part.min(axis=0), part.max(axis=0)
        most, least = leaves.bounds(low, high, some)
        # What the rows have from earlier pages counts as well.
        here = np.flatnonzero(leaves.reaching(most, max(least.max(), score[own].min()), some))
        some = here if isinstance(some, slice) else some[here]
        if not len(some):
            continue
        if len(some) <= _LEAF or len(own) <= _FEW_ROWS or (low == high).all():
            found, label = score[own], best[own]
            _best_of(kind, part, (classes[some], prior[some], told[some]), found, label)
            score[own], best[own] = found, label
            continue
        widest = np.argmax((high - low) / scale)
        order, half = np.argpartition(part[:, widest], len(own) // 2), len(own) // 2
        todo += [(own[order[:half]], some), (own[order[half:]], some)]


@dataclass
class Boxes:
    """Boxes that cover all rows, each the parent of two or of none, and what the best class has in each at least."""

    low: list[np.ndarray]
    high: list[np.ndarray]
    left: list[int]
    least: list[float]

    def contenders(self, leaves: Leaves) -> np.ndarray:
        """Which classes may be the best somewhere."""
        found, todo = np.zeros(len(leaves.height), dtype=bool), [(0, np.arange(len(leaves.height)))]
        while todo:
            box, some = todo.pop()
            some = some[~found[some]]
            some = some[leaves.reaching(leaves.bounds(self.low[box], self.high[box], some)[0], self.least[box], some)]
            if len(some) and self.left[box]:
                todo += [(self.left[box], some), (self.left[box] + 1, some)]
            found[some] |= not self.left[box]
        return found


def _boxes(sample: np.ndarray, low: np.ndarray, high: np.ndarray, leaves: Leaves) -> Boxes:
    """Those with the most classes left are cut first."""
    scale = np.maximum(sample.std(axis=0), 1e-300)
    boxes, todo, drawn = Boxes([], [], [], []), [], 0

    def put(low: np.ndarray, high: np.ndarray, rows: np.ndarray, some: np.ndarray) -> None:
        nonlocal drawn
        most, least = leaves.bounds(low, high, some)
        drawn += len(some)
        some = some[leaves.reaching(most, least.max(), some)]
        heappush(todo, (-len(some), len(boxes.left), rows, some))
        for told, one in ((boxes.low, low), (boxes.high, high), (boxes.left, 0), (boxes.least, float(least.max()))):
            told.append(one)

    put(low, high, np.arange(len(sample)), np.arange(len(leaves.height)))
    while todo and len(boxes.left) < 2 * _BOXES and drawn < _BOUNDS:
        _, box, rows, some = heappop(todo)
        lo, hi = boxes.low[box], boxes.high[box]
        widest = np.argmax((hi - lo) / scale)
        cut = np.median(sample[rows, widest]) if len(rows) > _FEW_ROWS else (lo[widest] + hi[widest]) / 2
        if not lo[widest] < cut < hi[widest]:
            cut = lo[widest] + (hi[widest] - lo[widest]) / 2
        if len(some) <= 1 or not lo[widest] < cut < hi[widest]:
            continue
        boxes.left[box] = len(boxes.left)
        for side in (0, 1):
            own = rows[(sample[rows, widest] > cut) == bool(side)]
            lower, upper = lo.copy(), hi.copy()
            (lower if side else upper)[widest] = cut
            put(lower, upper, own, some)
    for box in reversed(range(len(boxes.left))):
        if boxes.left[box]:
            boxes.least[box] = min(boxes.least[boxes.left[box]], boxes.least[boxes.left[box] + 1])
    return boxes


def _contenders(df: DataFrame, fitted: ClassTable, features: list[str]) -> ClassTable:
    """The classes that may be the best of a row of ``df``, and the smallest one, which a row infinitely far gets."""
    if fitted.kind != "gaussian" or fitted.classes < _MANY or not fitted.size:
        return fitted
    xs = [f"x{i}" for i in range(fitted.size)]
    rows = df.select(*[plain_column(f).cast("double").alias(x) for f, x in zip(features, xs, strict=True)]).na.drop()
    rows = rows.where(" and ".join(f"abs({x}) < double('infinity')" for x in xs))
    ends = rows.agg(F.count(F.lit(1)), *[F.min(x) for x in xs], *[F.max(x) for x in xs]).first()
    prior, told = F.col("prior"), fitted.table.columns[2:]
    if not ends[0]:
        return fitted
    share = max(1, ends[0] // _CUT_ROWS)
    sample = rows.where(F.pmod(F.xxhash64(*xs), F.lit(share)) == 0).distinct().limit(4 * _CUT_ROWS).toArrow()
    sample = np.column_stack([c.to_numpy() for c in sample.columns]) if sample.num_rows else np.array([ends[1 : 1 + fitted.size]], dtype=float)
    height = prior - sum(F.log(F.col(v)) for v in told[fitted.size :]) / 2
    # The highest classes tell the bounds where rows are many, drawn ones elsewhere, and how many others pass.
    drawn = F.pmod(F.xxhash64("class"), F.lit(max(1, fitted.classes // _DRAWN))) == 0
    top = fitted.table.orderBy(height.desc_nulls_last(), "class").limit(_HIGHEST).unionByName(fitted.table.where(drawn)).toArrow()
    top = np.column_stack([c.to_numpy() for c in top.columns])
    top = top[_fair(top[:, 1], top[:, 2:])]
    if not len(top):
        return fitted
    low, high = (np.array(x, dtype=float) for x in (ends[1 : 1 + fitted.size], ends[1 + fitted.size :]))
    boxes = df.sparkSession.sparkContext.broadcast(_boxes(sample, low, high, _bounded((top[:, 0], top[:, 1], top[:, 2:]))))
    smallest = fitted.table.agg(F.min("class")).first()[0]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in [*batches, None]:
            held += [batch] if batch is not None else []
            if held and (batch is None or sum(b.num_rows for b in held) >= _CLASSES_TOGETHER):
                whole = pa.Table.from_batches(held)
                found = np.column_stack([c.to_numpy() for c in whole.columns])
                fair = _fair(found[:, 1], found[:, 2:])
                keep = ~fair | (found[:, 0] == smallest)
                keep[fair] |= boxes.value.contenders(_bounded((found[fair, 0], found[fair, 1], found[fair, 2:])))
                yield from whole.filter(pa.array(keep)).to_batches()
                held = []

    left = materialize(fitted.table.mapInArrow(kept, fitted.table.schema), "contenders")
    return ClassTable(left, fitted.kind, fitted.size, left.count())


def _best_of(kind: str, x: np.ndarray, page: tuple | Leaves, score: np.ndarray, best: np.ndarray) -> None:
    """Raise score and best in place; of equal scores the smaller class stays."""
    if isinstance(page, Leaves):
        _best_of_leaves(kind, x, page, score, best)
        return
    classes, prior, told = page
    for first in range(0, len(classes), _CLASS_BLOCK):
        block = slice(first, first + _CLASS_BLOCK)
        step = max(1, _CELLS // len(classes[block]))
        for row in range(0, len(x), step):
            rows = slice(row, row + step)
            found = _log_likelihood(kind, x[rows], prior[block], told[block])
            at = found.argmax(axis=1)
            top, named = found[np.arange(len(at)), at], classes[block][at]
            better = (top > score[rows]) | ((top == score[rows]) & ~(named >= best[rows]))
            score[rows] = np.where(better, top, score[rows])
            best[rows] = np.where(better, named, best[rows])


def _scored(shared, kind: str, size: int):
    def found(columns: list[pa.Array]) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns[:size]])
        whole = ~np.isnan(x).any(axis=1)
        score, named = np.full(len(x), -np.inf), np.full(len(x), np.nan)
        if len(columns) > size:
            before = columns[size]
            for into, field in ((score, "score"), (named, "class")):
                held = before.field(field).to_numpy(zero_copy_only=False).astype(float)
                into[:] = np.where(np.isnan(held), into, held)
        part, top, label = x[whole], score[whole], named[whole]
        _best_of(kind, part, shared.value, top, label)
        score[whole], named[whole] = top, label
        gone = np.isnan(named)
        return pa.StructArray.from_arrays([pa.array(score, mask=gone), pa.array(named, mask=gone)], ["score", "class"])

    @F.arrow_udf(_BEST)
    def best(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: list[tuple[pa.Array, ...]] = []
        for columns in batches:
            held.append(columns)
            if sum(len(c[0]) for c in held) >= (_ROWS_TOGETHER if isinstance(shared.value, Leaves) else 1):
                yield from told(held)
                held = []
        yield from told(held)

    def told(held: list[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        """Answers batch by batch to batches that are looked at together."""
        if held:
            answer, at = found([pa.concat_arrays(c) for c in zip(*held, strict=True)]), 0
            for columns in held:
                yield answer.slice(at, len(columns[0]))
                at += len(columns[0])

    return best


def predict_class(
    df: DataFrame, fitted: ClassTable, features: list[str], out: str = "prediction", page_bytes: int = PAGE_BYTES
) -> DataFrame:
    """``df`` with the likeliest class as a double; NULL where a feature is NULL or NaN.

    The class table goes out in pages of ``page_bytes``; beyond one page the running best is written
    between pages, so a worker never holds two. Of many Gaussian classes only the contenders go out, for
    which the features of ``df`` are read beforehand.
    """
    spark, held = df.sparkSession, "_best_class"
    while held in df.columns:
        held += "_"
    xs: list[Column] = [plain_column(f).cast("double") for f in features]
    scored, fitted = df, _contenders(df, fitted, features)
    for number, page in enumerate(fitted.pages(page_bytes)):
        if number:
            scored = materialize(scored, "best_class")
        before = [plain_column(held)] if number else []
        page = (_leaves(page) if fitted.kind == "gaussian" else None) or page
        best = _scored(spark.sparkContext.broadcast(page), fitted.kind, fitted.size)
        scored = scored.withColumn(held, best(*xs, *before))
    return scored.withColumn(out, plain_column(held)["class"]).drop(held)
