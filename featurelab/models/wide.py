"""Linear models of thousands of features, from sums of products kept as a table.

The matrix of sums is cut into square blocks; a line holds the sums of one column with the
columns of one block, for one fold. Tasks add up as many blocks at a time as fit into their
share of memory, so a very wide matrix takes several scans, and lines are summed by a shuffle
on their key. The driver never holds the matrix: a product of matrix and vector is one job
over the lines, and fits of all folds go forward together by such products.

The features of a row are an array, or, where most are zero, a struct of the arrays ``indices`` (from 0,
ascending) and ``values``: then a row costs what its entries cost, not what its width would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from featurelab.sources.work import materialize

SIDE = 128  # columns of a block
TASK_BYTES = 64 << 20  # sums a task holds in one scan, for all folds
_LINES = "code bigint, sums array<double>"
_ROWS_AT_ONCE = 1024
_PAIRS_AT_ONCE = 1 << 18  # products of entries of sparse rows


def _lists(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equally long lists as a matrix; a NULL inside a list is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"every row needs {width} features")
    return flat.reshape(len(column), width)


def _entries(indices: pa.ListArray, values: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of the entries of whole sparse rows, and which rows are whole: without a NULL or NaN."""
    counts = indices.value_lengths().to_numpy(zero_copy_only=False)
    if not np.array_equal(counts, values.value_lengths().to_numpy(zero_copy_only=False)):
        raise ValueError("every sparse row needs as many values as indices")
    row, at = np.repeat(np.arange(len(counts)), counts), indices.flatten()
    value = values.flatten().to_numpy(zero_copy_only=False)
    whole = np.ones(len(counts), dtype=bool)
    whole[row[at.is_null().to_numpy(zero_copy_only=False) | np.isnan(value)]] = False
    used = whole[row]
    row, at, value = row[used], at.fill_null(0).to_numpy().astype(np.int64)[used], value[used]
    if ((at < 0) | (at >= size)).any():
        raise ValueError(f"indices of {size} features go from 0 to {size - 1}")
    if (np.diff(row * size + at) <= 0).any():
        raise ValueError("indices of a sparse row need to ascend")
    return row, at, value, whole


def _numbers(df: DataFrame, features: str) -> list[Column]:
    """The array of a row, or the indices and values of its entries."""
    column = F.col(features)
    if isinstance(df.select(column).schema[0].dataType, StructType):
        return [column["indices"].cast("array<int>").alias("_i"), column["values"].cast("array<double>").alias("_x")]
    return [column.cast("array<double>").alias("_x")]


def _batch(codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(sums).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), lists], names=["code", "sums"])


def _added(codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(sums[order], starts, axis=0)


def _summed(lines: DataFrame, keys: int, side: int) -> DataFrame:
    """One line per code. A partition holds a bounded number of codes and adds lines as they stream in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = [np.zeros(0, dtype=np.int64)], [np.zeros((0, side))]
        waiting = 0
        for batch in batches:
            codes.append(batch.column("code").to_numpy())
            sums.append(_lists(batch.column("sums"), side))
            waiting += batch.num_rows
            if waiting > max(10_000, len(sums[0])):  # as many new lines as kept ones: each is moved a few times only
                merged = _added(np.concatenate(codes), np.concatenate(sums))
                codes, sums, waiting = [merged[0]], [merged[1]], 0
        if waiting or len(codes[0]):
            yield _batch(*_added(np.concatenate(codes), np.concatenate(sums)))

    parts = max(1, -(-keys * side * 8 // TASK_BYTES))
    return lines.repartition(parts, "code").mapInArrow(add, _LINES)


@dataclass(frozen=True)
class WideMoments:
    """Sums of products of (1, y - shift, x - shift) by fold, as a written table of lines."""

    lines: DataFrame
    folds: list[int]
    shift: np.ndarray  # of y, then of the features
    side: int

    @property
    def columns(self) -> int:
        return len(self.shift) + 1

    @property
    def blocks(self) -> int:
        return -(-self.columns // self.side)

    def _left(self):
        return F.expr(f"(code div {self.blocks}) % {self.columns}")

    def edges(self, held: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without each held fold: sums with 1, sums with y, and the diagonal (sets by columns)."""
        left, block = self._left(), F.expr(f"code % {self.blocks}")
        fold = F.expr(f"code div {self.blocks * self.columns}").alias("fold")
        found = np.zeros((3, len(held), self.blocks * self.side))
        others = {f: np.array([h != f for h in held]) for f in self.folds}
        top = self.lines.filter(left < 2).select(fold, left.alias("left"), block.alias("block"), "sums")
        for r in top.collect():
            at = slice(r["block"] * self.side, (r["block"] + 1) * self.side)
            found[r["left"], others[r["fold"]], at] += np.array(r["sums"])
        own = self.lines.filter(F.floor(left / self.side) == block)
        own = own.select(fold, left.alias("left"), F.element_at("sums", (left % self.side + 1).cast("int")).alias("value"))
        for r in own.collect():
            found[2, others[r["fold"]], r["left"]] += r["value"]
        ones, y, diagonal = found[:, :, : self.columns]
        return ones, y, diagonal

    def times(self, vectors: np.ndarray, held: list[int]) -> np.ndarray:
        """The matrix of all folds but ``held[i]`` times ``vectors[i]``, for all i in one job."""
        side, blocks, columns = self.side, self.blocks, self.columns
        padded = np.zeros((len(held), blocks * side))
        padded[:, :columns] = vectors
        kept_out = np.array(held)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(padded)
            for batch in batches:
                if not batch.num_rows:
                    continue
                code, sums = batch.column("code").to_numpy(), _lists(batch.column("sums"), side)
                block, left, fold = code % blocks, code // blocks % columns, code // (blocks * columns)
                used = (fold[:, None] != kept_out).astype(float)
                for b in np.unique(block):
                    at, here = slice(b * side, (b + 1) * side), block == b
                    part = sums[here] @ padded[:, at].T * used[here]
                    np.add.at(total.T, left[here], part)
                    beside = here & (left // side != b)  # blocks beside the diagonal stand for two
                    total[:, at] += (padded[:, left[beside]].T * used[beside]).T @ sums[beside]
            yield _batch(np.arange(len(total)), total)

        result = np.zeros_like(padded)
        # One row per task and set; the tasks grow with the matrix, not with the rows it came from.
        for r in self.lines.mapInArrow(multiply, _LINES).collect():
            result[r["code"]] += np.array(r["sums"])
        return result[:, :columns]


def wide_moments(
    df: DataFrame, features: str, size: int, target: str, fold: str | None = None,
    side: int = SIDE, task_bytes: int = TASK_BYTES,
) -> WideMoments:
    """Sums of products per fold of the ``size`` numbers in the column ``features``, arrays or sparse rows.

    ``fold`` holds numbers from 0; without it there is one fold 0. Rows with a NULL or NaN in the target,
    the fold, the array or any of its numbers are left out; an array of another length raises an error, and
    so does a sparse row whose indices do not ascend below ``size``. Where only some sparse rows have an entry of
    a feature, it is not shifted, which keeps its zeros. An empty table has no folds. ``df`` should be a written table: one scan finds the means, then one more for every ``task_bytes`` of sums;
    wide rows also need ``spark.sql.execution.arrow.maxRecordsPerBatch`` such that a batch fits a task.
    """
    columns = size + 2
    blocks = -(-columns // side)
    at = F.col(fold) if fold else F.lit(0)
    numbers = _numbers(df, features)
    sparse = len(numbers) == 2
    data = df.select(at.cast("bigint").alias("k"), F.col(target).cast("double").alias("y"), *numbers).na.drop()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
                piece = batch.slice(start, _ROWS_AT_ONCE)
                values = np.column_stack([piece.column("y").to_numpy(zero_copy_only=False), _lists(piece.column("_x"), size)])
                whole = ~np.isnan(values).any(axis=1)
                yield piece.column("k").to_numpy()[whole], values[whole]

    def sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            row, index, value, whole = _entries(batch.column("_i"), batch.column("_x"), size)
            whole &= ~np.isnan(y)
            used, place = whole[row], np.cumsum(whole) - 1
            yield batch.column("k").to_numpy()[whole], y[whole], place[row[used]], index[used], value[used]

    # Sums of the columns; of sparse rows also their entries, from a block of their own on.
    width = blocks * (2 if sparse else 1)

    def plain_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for k, values in rows(batches):
            for f in np.unique(k):
                here = values[k == f]
                total = found.setdefault(int(f), np.zeros(blocks * side))
                total[:columns] += np.r_[len(here), here.sum(axis=0)]
        for f, total in found.items():
            yield _batch(f * width + np.arange(width), total.reshape(width, side))

    def plain_sparse_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for k, y, row, index, value in sparse_rows(batches):
            for f in np.unique(k):
                here, entries = k == f, (k == f)[row]
                total = found.setdefault(int(f), np.zeros((2, blocks * side)))
                total[0, :2] += here.sum(), y[here].sum()
                total[0, 2:columns] += np.bincount(index[entries], value[entries], minlength=size)
                total[1, 2:columns] += np.bincount(index[entries], minlength=size)
        for f, total in found.items():
            yield _batch(f * width + np.arange(width), total.reshape(width, side))

    sums: dict[int, np.ndarray] = {}
    for r in _summed(data.mapInArrow(plain_sparse_sums if sparse else plain_sums, _LINES), width, side).collect():
        f, b = divmod(r["code"], width)
        sums.setdefault(f, np.zeros(width * side))[b * side : (b + 1) * side] = r["sums"]
    total = sum(sums.values(), np.zeros(width * side))
    shift = total[1:columns] / max(total[0], 1.0)
    if sparse:
        seen = total[blocks * side + 2 : blocks * side + columns]
        shift[1:][seen < total[0]] = 0.0

    pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    at_once = max(1, task_bytes // (side * side * 8 * max(1, len(sums))))
    pages = [pairs[p : p + at_once] for p in range(0, len(pairs), at_once)]

    def products(page: list[tuple[int, int]]):
        first: dict[int, tuple[int, int]] = {}  # the blocks of a page that share a row of blocks follow each other
        for i, j in page:
            first[i] = (min(first.get(i, (j, j))[0], j), j)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for k, values in rows(batches):
                for f in np.unique(k):
                    here = values[k == f] - shift
                    z = np.zeros((len(here), blocks * side))
                    z[:, 0], z[:, 1:columns] = 1.0, here
                    for i, (low, high) in first.items():
                        part = z[:, i * side : (i + 1) * side].T @ z[:, low * side : (high + 1) * side]
                        if (int(f), i) in found:
                            found[int(f), i] += part
                        else:
                            found[int(f), i] = part
            for (f, i), part in found.items():
                yield from told(f, i, part)

        def told(f: int, i: int, part: np.ndarray) -> Iterator[pa.RecordBatch]:
            left = np.arange(i * side, min((i + 1) * side, columns))
            for b in range(first[i][0], first[i][1] + 1):
                sums = part[: len(left), (b - first[i][0]) * side : (b - first[i][0] + 1) * side]
                yield _batch((f * columns + left) * blocks + b, sums)

        # A row of blocks is a stretch of cells, one after the other.
        low, high = np.ones(blocks, dtype=np.int64), np.zeros(blocks, dtype=np.int64)
        for i, ends in first.items():
            low[i], high[i] = ends
        across = (high - low + 1) * side
        cells = np.cumsum(across * side)
        begin = cells - across * side - low * side  # cell of a column is counted from the first of the lowest block

        def multiply_sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for k, y, row, index, value in sparse_rows(batches):
                length = np.bincount(row, minlength=len(k)) + 2  # with 1 and y
                end = np.cumsum(length)
                column, number = np.zeros(len(row) + 2 * len(k), dtype=np.int64), np.ones(len(row) + 2 * len(k))
                column[end - length + 1], number[end - length + 1] = 1, y - shift[0]
                at = np.arange(len(row)) + 2 * (row + 1)
                column[at], number[at] = index + 2, value - shift[index + 1]
                fold, block = np.repeat(k, length), column // side
                # An entry meets itself and those that follow in its row.
                meets = np.where(across[block] > 0, np.repeat(end, length) - np.arange(len(column)), 0)
                until = np.cumsum(meets)
                start = 0
                while start < len(column):
                    before = until[start] - meets[start]
                    stop = max(start + 1, int(np.searchsorted(until, before + _PAIRS_AT_ONCE, side="right")))
                    here = meets[start:stop]
                    left = np.repeat(np.arange(start, stop), here)
                    right = left + np.arange(len(left)) - np.repeat(until[start:stop] - here - before, here)
                    start = stop
                    inside = (block[right] >= low[block[left]]) & (block[right] <= high[block[left]])
                    left, right = left[inside], right[inside]
                    i = block[left]
                    cell = begin[i] + (column[left] - i * side) * across[i] + column[right]
                    product = number[left] * number[right]
                    for f in np.unique(fold[left]):
                        own = fold[left] == f
                        total = found.setdefault(int(f), np.zeros(cells[-1]))
                        np.add.at(total, cell[own], product[own])
            for f, total in found.items():
                for i in first:
                    part = total[cells[i] - across[i] * side : cells[i]].reshape(side, across[i])
                    if low[i] == i:  # only one half of a block on the diagonal was summed
                        part[:, :side] += np.triu(part[:, :side], 1).T
                    yield from told(f, i, part)

        return multiply_sparse if sparse else multiply

    lines = None
    for page in pages:
        keys = len(page) * side * max(1, len(sums))
        found = _summed(data.mapInArrow(products(page), _LINES), keys, side)
        lines = found if lines is None else lines.unionByName(found)
    return WideMoments(materialize(lines, "products"), sorted(sums), shift, side)


class _Fits:
    """Centred and scaled normal equations of several training sets."""

    def __init__(self, moments: WideMoments, held: list[int]):
        self.moments, self.held = moments, held
        ones, y, diagonal = moments.edges(held)
        self.rows = np.maximum(ones[:, :1], 1.0)
        self.means = ones[:, 1:] / self.rows  # of y, then of the features, from the shift on
        spread = diagonal[:, 2:] - ones[:, 2:] * self.means[:, 1:]
        # A column without spread, but for rounding, has no part in the fit.
        self.live = spread > 1e-12 * np.maximum(diagonal[:, 2:], 1e-300)
        self.scale = np.sqrt(np.where(self.live, spread, 1.0))
        self.y_spread = np.maximum(y[:, 1] - ones[:, 1] * self.means[:, 0], 0.0)
        self.right = np.where(self.live, (y[:, 2:] - ones[:, 2:] * self.means[:, :1]) / self.scale, 0.0)

    def times(self, scaled: np.ndarray) -> np.ndarray:
        away = np.where(self.live, scaled / self.scale, 0.0)
        full = np.concatenate([-(self.means[:, 1:] * away).sum(axis=1, keepdims=True), np.zeros((len(away), 1)), away], axis=1)
        return np.where(self.live, self.moments.times(full, self.held)[:, 2:] / self.scale, 0.0)

    def finished(self, scaled: np.ndarray) -> list[tuple[float, np.ndarray]]:
        shift, coef = self.moments.shift, np.where(self.live, scaled / self.scale, 0.0)
        means = self.means + shift
        return [(float(m[0] - m[1:] @ c), c) for m, c in zip(means, coef)]


def wide_least_squares(
    moments: WideMoments, held: list[int] | None = None, iterations: int = 1000, tolerance: float = 1e-11
) -> list[tuple[float, np.ndarray]]:
    """Intercept and coefficients without each fold of ``held`` (-1: on all rows), by conjugate gradients.

    Collinear features get the smallest scaled solution. Ends once every residual is below ``tolerance``
    of its start; a fit that is not there after ``iterations`` raises an error. Default: every fold.
    """
    fits = _Fits(moments, moments.folds if held is None else held)
    coef, rest = np.zeros_like(fits.right), fits.right.copy()
    towards, size = rest.copy(), (rest**2).sum(axis=1)
    goal = tolerance**2 * size
    for _ in range(iterations):
        if (size <= goal).all():
            return fits.finished(coef)
        turned = fits.times(towards)
        open_ = size > goal
        step = np.where(open_, size / np.where(open_, (towards * turned).sum(axis=1), 1.0), 0.0)[:, None]
        coef += step * towards
        rest -= step * turned
        now = (rest**2).sum(axis=1)
        towards = rest + np.where(open_, now / np.where(open_, size, 1.0), 0.0)[:, None] * towards
        size = np.where(open_, now, size)
    raise ValueError(f"no fit within {iterations} steps")


def wide_elastic_net(
    moments: WideMoments, held: list[int] | None = None, alpha: float = 1.0, l1_ratio: float = 0.5,
    iterations: int = 5000, tolerance: float = 1e-9,
) -> list[tuple[float, np.ndarray]]:
    """The fit of ``gram.elastic_net`` by accelerated proximal steps, without each fold of ``held``.

    Ends once no step moves a fit by more than ``tolerance`` of the target's spread.
    """
    fits = _Fits(moments, moments.folds if held is None else held)
    n, spread = fits.rows, np.sqrt(fits.y_spread)
    l1, l2 = n * alpha * l1_ratio / fits.scale, n * alpha * (1 - l1_ratio) / fits.scale**2
    bound = np.maximum(_largest(fits), 1e-300)[:, None]
    coef = np.zeros_like(fits.right)
    ahead, pace = coef, np.ones((len(coef), 1))
    for _ in range(iterations):
        moved = ahead + (fits.right - fits.times(ahead)) / bound
        new = np.sign(moved) * np.maximum(np.abs(moved) - l1 / bound, 0.0) / (1 + l2 / bound)
        back = ((ahead - new) * (new - coef)).sum(axis=1, keepdims=True) > 0  # start over where the pace overshoots
        faster = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * pace**2)) / 2)
        ahead = new + np.where(back, 0.0, (pace - 1) / faster) * (new - coef)
        still = (np.sqrt(((new - coef) ** 2).sum(axis=1)) <= tolerance * spread).all()
        coef, pace = new, faster
        if still:
            return fits.finished(coef)
    raise ValueError(f"no fit within {iterations} steps")


def out_of_fold(
    df: DataFrame, features: str, fold: str, held: list[int], fits: list[tuple[float, np.ndarray]], out: str = "prediction"
) -> DataFrame:
    """Every row with the prediction of the fit that left out its fold: ``fits[i]`` for fold ``held[i]``.

    The features are arrays or sparse rows, as for ``wide_moments``. NULL where the fold has no fit, or the
    features or one of their numbers are NULL or NaN. Narrow: the coefficients
    go out with the tasks. A column named ``out`` must not be there already.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    intercepts, coefs = np.array([f[0] for f in fits]), np.array([f[1] for f in fits])
    numbers = _numbers(df, features)
    given = df.select("*", F.col(fold).cast("bigint").alias("_k"), *numbers)
    names = [*df.columns, out]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(start, _ROWS_AT_ONCE)
                value = np.full(batch.num_rows, np.nan)
                k, x = batch.columns[-2].to_numpy(zero_copy_only=False), batch.columns[-1]
                there = x.is_valid().to_numpy(zero_copy_only=False)
                for f, intercept, coef in zip(held, intercepts, coefs):
                    here = there & (k == f)
                    if here.any():
                        value[here] = _lists(x.filter(pa.array(here)), len(coef)) @ coef + intercept
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(value, from_pandas=True)], names=names)

    def predict_sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, (indices, values) = batch.columns[-3].to_numpy(zero_copy_only=False), batch.columns[-2:]
            there = indices.is_valid().to_numpy(zero_copy_only=False) & values.is_valid().to_numpy(zero_copy_only=False)
            fit = np.full(batch.num_rows, -1)
            for i, f in enumerate(held):
                fit[there & (k == f)] = i
            known = np.flatnonzero(fit >= 0)
            value = np.full(batch.num_rows, np.nan)
            if len(known):
                row, index, number, whole = _entries(indices.take(pa.array(known)), values.take(pa.array(known)), coefs.shape[1])
                products = np.bincount(row, number * coefs[fit[known[row]], index], minlength=len(known))
                value[known[whole]] = (products + intercepts[fit[known]])[whole]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(value, from_pandas=True)], names=names)

    return given.mapInArrow(predict_sparse if len(numbers) == 2 else predict, df.withColumn(out, F.lit(None).cast("double")).schema)


def _largest(fits: _Fits, steps: int = 30) -> np.ndarray:
    """A bound on the largest eigenvalue of each set: power steps, then a tenth more; the trace at most."""
    vector = np.where(fits.live, np.random.default_rng(0).normal(size=fits.right.shape), 0.0)
    value = np.zeros(len(vector))
    for _ in range(steps):
        length = np.sqrt((vector**2).sum(axis=1, keepdims=True))
        vector = fits.times(vector / np.maximum(length, 1e-300))
        value = np.sqrt((vector**2).sum(axis=1))
    return np.minimum(1.1 * value, fits.live.sum(axis=1))
