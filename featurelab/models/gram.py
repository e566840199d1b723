"""Linear models from sums of products.

One scan gives, per fold, the sums of products of all features and the target. Any
mask's least-squares fit on the other folds is then a small solve, independent of the
number of rows, and one more scan gives the fold errors of all masks together. Rows
stay in Arrow batches; each task sends on one row of sums per fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_MOMENTS = "fold int, at int, value double"


@dataclass
class Moments:
    """Sums of products of (1, x - shift, y - shift) for one set of rows."""

    products: np.ndarray
    shift: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.products - other.products, self.shift)

    @property
    def rows(self) -> float:
        return self.products[0, 0]

    def centred(self, picked: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, X'y and y'y of the picked features about their means."""
        at = [1 + i for i in picked]
        y = self.products.shape[0] - 1
        sums, n = self.products[0], max(self.rows, 1.0)
        xx = self.products[np.ix_(at, at)] - np.outer(sums[at], sums[at]) / n
        xy = self.products[at, y] - sums[at] * sums[y] / n
        return xx, xy, self.products[y, y] - sums[y] ** 2 / n

    def means(self, picked: list[int]) -> tuple[np.ndarray, float]:
        n = max(self.rows, 1.0)
        sums = self.products[0]
        at = [1 + i for i in picked]
        return sums[at] / n + self.shift[picked], sums[-1] / n + self.shift[-1]

    def squared_error(self, intercept: float, coef: np.ndarray) -> float:
        """Sum of squared errors of a linear fit with one coefficient per feature on these rows."""
        away = np.concatenate([[intercept + coef @ self.shift[:-1] - self.shift[-1]], coef, [-1.0]])
        return max(0.0, float(away @ self.products @ away))


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def fold_moments(df: DataFrame, features: list[str], target: str, fold: str | None = None) -> dict[int, Moments]:
    """Moments per fold, from rows without NULLs (two scans: means, then products)."""
    names = [*features, target]
    data = df.select(
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"),
        *[F.col(n).cast("double").alias(f"_c{i}") for i, n in enumerate(names)],
    ).na.drop()
    columns = data.columns[1:]
    means = data.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    size = len(names) + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("_fold").to_numpy(zero_copy_only=False)
            values = _matrix(batch, columns) - shift
            for k in np.unique(folds):
                rows = values[folds == k]
                z = np.column_stack([np.ones(len(rows)), rows])
                found[int(k)] = found.get(int(k), 0.0) + z.T @ z
        for k, products in found.items():
            flat = products[upper]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(flat), k, dtype=np.int32)),
                    pa.array(np.arange(len(flat), dtype=np.int32)),
                    pa.array(flat),
                ],
                names=["fold", "at", "value"],
            )

    # Collects folds * size * (size + 1) / 2 rows, whatever the number of input rows.
    total = data.mapInArrow(sums, _MOMENTS).groupBy("fold", "at").agg(F.sum("value").alias("value"))
    result: dict[int, Moments] = {}
    for row in total.collect():
        moments = result.setdefault(row["fold"], Moments(np.zeros((size, size)), shift))
        i, j = upper[0][row["at"]], upper[1][row["at"]]
        moments.products[i, j] = moments.products[j, i] = row["value"]
    return result


def total_moments(folds: dict[int, Moments]) -> Moments:
    first = next(iter(folds.values()))
    return Moments(sum(m.products for m in folds.values()), first.shift)


def least_squares(moments: Moments, picked: list[int]) -> tuple[float, np.ndarray]:
    """Intercept and coefficients; collinear features get the smallest solution."""
    if not picked:
        return moments.means([])[1], np.zeros(0)
    xx, xy, _ = moments.centred(picked)
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    solved = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-11)[0] / scale
    x_mean, y_mean = moments.means(picked)
    return float(y_mean - x_mean @ solved), solved


def elastic_net(
    moments: Moments, picked: list[int], alpha: float = 1.0, l1_ratio: float = 0.5, iterations: int = 10_000, tolerance: float = 1e-12
) -> tuple[float, np.ndarray]:
    """1/(2n) |y - Xw|^2 + alpha l1_ratio |w|_1 + alpha (1 - l1_ratio) / 2 |w|_2^2, one coordinate after the other.

    The same at any number of features. Ends once a round over all coordinates changes the fit by less
    than ``tolerance`` of the target's spread.
    """
    xx, xy, yy = moments.centred(picked)
    n = max(moments.rows, 1.0)
    xx, xy, spread = xx / n, xy / n, np.sqrt(max(yy / n, 0.0))
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    coef, rest = np.zeros(len(picked)), xy.copy()  # rest: the products of features and residuals
    size = np.diag(xx)
    for _ in range(iterations):
        moved = 0.0
        for j in range(len(picked)):
            pull = rest[j] + size[j] * coef[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / max(size[j] + l2, 1e-300)
            if new != coef[j]:
                moved = max(moved, abs(new - coef[j]) * np.sqrt(size[j]))
                rest -= xx[:, j] * (new - coef[j])
                coef[j] = new
        if moved <= tolerance * spread:
            break
    x_mean, y_mean = moments.means(picked)
    return float(y_mean - x_mean @ coef), coef


def bayesian_ridge(
    moments: Moments, picked: list[int], prior: float = 1e-6, iterations: int = 300, tolerance: float = 1e-3
) -> tuple[float, np.ndarray]:
    """Ridge regression whose noise and weight precision maximise the evidence."""
    xx, xy, yy = moments.centred(picked)
    n = moments.rows
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ xy
    noise, weight = 1.0 / max(yy / n, 1e-300), 1.0
    old = None
    for _ in range(iterations):
        coef = vectors @ (rotated / (values + weight / noise))
        residual = max(yy - 2 * coef @ xy + coef @ xx @ coef, 0.0)
        effective = float(np.sum(noise * values / (weight + noise * values)))
        weight = (effective + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (n - effective + 2 * prior) / (residual + 2 * prior)
        if old is not None and np.abs(old - coef).sum() < tolerance:
            break
        old = coef
    coef = vectors @ (rotated / (values + weight / noise))
    x_mean, y_mean = moments.means(picked)
    return float(y_mean - x_mean @ coef), coef


def relevance_regression(
    moments: Moments,
    picked: list[int],
    prior: float = 1e-6,
    iterations: int = 300,
    prune_above: float = 1e4,
    tolerance: float = 1e-3,
) -> tuple[float, np.ndarray]:
    """Bayesian regression with one precision per feature; irrelevant features are pruned."""
    xx, xy, yy = moments.centred(picked)
    n, size = moments.rows, len(picked)
    noise, weights = 1.0 / max(yy / n, 1e-300), np.ones(size)
    kept, coef = np.ones(size, dtype=bool), np.zeros(size)
    for _ in range(iterations):
        old = coef
        spread = np.linalg.inv(np.diag(weights[kept]) + noise * xx[np.ix_(kept, kept)])
        coef = np.zeros(size)
        coef[kept] = noise * spread @ xy[kept]
        residual = max(yy - 2 * coef @ xy + coef @ xx @ coef, 0.0)
        certain = 1.0 - weights[kept] * np.diag(spread)
        weights[kept] = (certain + 2 * prior) / (coef[kept] ** 2 + 2 * prior)
        noise = (n - certain.sum() + 2 * prior) / (residual + 2 * prior)
        kept &= weights < prune_above
        coef[~kept] = 0.0
        if np.abs(old - coef).sum() < tolerance or not kept.any():
            break
    x_mean, y_mean = moments.means(picked)
    return float(y_mean - x_mean @ coef), coef


def linear_prediction(features: list[str], intercept: float, coef: np.ndarray) -> Column:
    """The prediction as a column expression."""
    total = F.lit(float(intercept))
    for name, weight in zip(features, coef):
        total = total + F.col(name) * F.lit(float(weight))
    return total
