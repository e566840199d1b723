"""Wide linear fits against the dense ones."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.models import gram, wide
from featurelab.plans import scoring

SIZE, ROWS = 40, 900


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(ROWS, SIZE)) * 10.0 ** rng.integers(-3, 4, SIZE) + 50
    x[:, 5] = 7.0  # without spread
    x[:, 9] = 2 * x[:, 8]  # collinear
    y = x @ rng.normal(size=SIZE) / x.std(axis=0).clip(1).max() + rng.normal(size=ROWS) + 1000
    return x, y, rng.integers(0, 3, ROWS)


@pytest.fixture(scope="module")
def tables(spark, rows):
    x, y, k = rows
    plain = [(int(f), float(t), *map(float, r)) for f, t, r in zip(k, y, x)]
    names = [f"x{i}" for i in range(SIZE)]
    columns = spark.createDataFrame(plain, ["fold", "y", *names]).repartition(5).cache()
    return names, columns, columns.select("fold", "y", F.array(*names).alias("x"))


@pytest.fixture(scope="module")
def moments(tables):
    return wide.wide_moments(tables[2], "x", SIZE, "y", "fold", side=16, task_bytes=16 * 16 * 8 * 3 * 2)


def test_products_equal_the_dense_matrix(moments, rows):
    x, y, k = rows
    z = np.column_stack([np.ones(ROWS), y, x]) - np.r_[0.0, moments.shift]
    vectors = np.random.default_rng(1).normal(size=(4, SIZE + 2))
    held = [0, 1, 2, -1]
    got = moments.times(vectors, held)
    for g, v, h in zip(got, vectors, held):
        want = z[k != h].T @ (z[k != h] @ v)
        assert g == pytest.approx(want, rel=1e-9, abs=1e-9 * np.abs(want).max())
    ones, with_y, diagonal = moments.edges([0, -1])
    assert ones[0] == pytest.approx(z[k != 0].sum(axis=0), abs=1e-6)
    assert with_y[1] == pytest.approx(z.T @ z[:, 1], rel=1e-9, abs=1e-6)
    assert diagonal[0] == pytest.approx((z[k != 0] ** 2).sum(axis=0), rel=1e-9, abs=1e-12)
    assert moments.lines.count() == moments.lines.select("code").distinct().count()


def test_least_squares_equals_the_dense_fit(moments, rows):
    x, y, k = rows
    for h, (intercept, coef) in zip(moments.folds, wide.wide_least_squares(moments)):
        z = np.column_stack([np.ones((k != h).sum()), x[k != h] - x.mean(axis=0)])
        found = np.linalg.lstsq(z, y[k != h], rcond=1e-12)[0]
        want = (x[k == h] - x.mean(axis=0)) @ found[1:] + found[0]
        assert intercept + x[k == h] @ coef == pytest.approx(want, rel=1e-6)
        assert coef[5] == 0.0


def test_elastic_net_equals_the_dense_fit(moments, tables, rows):
    names, columns, _ = tables
    dense = gram.total_moments(gram.fold_moments(columns, names, "y", "fold"))
    want = gram.elastic_net(dense, list(range(SIZE)))
    intercept, coef = wide.wide_elastic_net(moments, [-1])[0]
    x = rows[0]
    assert intercept + x @ coef == pytest.approx(want[0] + x @ want[1], rel=1e-6)


def test_predictions_of_the_fold_left_out(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 0, [3.0, -1.0]), (3, 7, [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, 0, None), (6, 0, [None, 1.0])]
    table = spark.createDataFrame(rows, "id int, fold int, x array<double>").repartition(3)
    fits = [(10.0, np.array([1.0, 2.0])), (-5.0, np.array([0.0, 3.0]))]
    got = wide.out_of_fold(table, "x", "fold", [0, 1], fits)
    assert got.columns == ["id", "fold", "x", "prediction"]
    assert {r["id"]: r["prediction"] for r in got.collect()} == {0: 1.0, 1: 1.0, 2: 11.0, 3: None, 4: None, 5: None, 6: None}
    assert wide.out_of_fold(table.limit(0), "x", "fold", [0, 1], fits).count() == 0
    with pytest.raises(ValueError, match="already"):
        wide.out_of_fold(got, "x", "fold", [0, 1], fits)


def test_incomplete_rows_and_odd_tables(spark):
    schema = "fold int, y double, x array<double>"
    full = [(0, 1.0, [1.0, 2.0]), (0, 2.0, [2.0, 0.5]), (1, 3.5, [3.0, 1.0]), (1, 4.0, [0.0, 1.0])]
    odd = [(None, 1.0, [9.0, 9.0]), (0, None, [9.0, 9.0]), (1, 1.0, None), (1, 9.0, [None, 1.0]), (0, float("nan"), [1.0, 1.0])]
    clean = wide.wide_moments(spark.createDataFrame(full, schema), "x", 2, "y", "fold")
    mixed = wide.wide_moments(spark.createDataFrame(full + odd, schema), "x", 2, "y", "fold")
    assert mixed.shift == pytest.approx(clean.shift) and mixed.folds == [0, 1]
    for a, b in zip(wide.wide_least_squares(clean, [-1]), wide.wide_least_squares(mixed, [-1])):
        assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])
    empty = wide.wide_moments(spark.createDataFrame([], schema), "x", 2, "y", "fold")
    assert empty.folds == [] and wide.wide_least_squares(empty) == []
    (intercept, coef), = wide.wide_least_squares(empty, [-1])
    assert intercept == 0.0 and not coef.any()
    with pytest.raises(Exception, match="needs 3 features"):
        wide.wide_moments(spark.createDataFrame(full, schema), "x", 3, "y")


_SPARSE = "id int, fold int, y double, x array<double>, s struct<indices array<int>, values array<double>>"


@pytest.fixture(scope="module")
def both_forms(spark):
    """The same rows as arrays and as entries: rare and common features, one in every row and far from zero, rows with few or all."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ROWS, SIZE)) * (rng.random((ROWS, SIZE)) < rng.choice([0.02, 0.1, 0.6], SIZE))
    x[:, 7] = 5000 + rng.normal(size=ROWS) / 100
    x[:3, :7] = x[:3, 8:] = 0.0
    x[3:6] = rng.normal(size=(3, SIZE))
    x[:, 11] = 0.0
    y = x @ rng.normal(size=SIZE) + rng.normal(size=ROWS) + 1000
    table = []
    for i, (r, t, f) in enumerate(zip(x, y, rng.integers(0, 3, ROWS))):
        at = [int(j) for j in np.flatnonzero((r != 0) | (rng.random(SIZE) < 0.02))]  # a zero may be an entry too
        table.append((i, int(f), float(t), [float(v) for v in r], (at, [float(r[j]) for j in at])))
    return spark.createDataFrame(table, _SPARSE).repartition(4).cache()


@pytest.mark.parametrize("task_bytes, pairs", [(wide.TASK_BYTES, wide._PAIRS_AT_ONCE), (16 * 16 * 8 * 3 * 2, 50)])
def test_sparse_rows_fit_as_their_arrays(both_forms, monkeypatch, task_bytes, pairs):
    monkeypatch.setattr(wide, "_PAIRS_AT_ONCE", pairs)
    sparse, dense = [wide.wide_moments(both_forms, c, SIZE, "y", "fold", side=16, task_bytes=task_bytes) for c in "sx"]
    assert sparse.folds == dense.folds == [0, 1, 2]
    assert sparse.shift[[0, 8]] == pytest.approx(dense.shift[[0, 8]], rel=1e-12) and not np.delete(sparse.shift, [0, 8]).any()
    assert sparse.lines.count() == sparse.lines.select("code").distinct().count() == dense.lines.count()
    fits = wide.wide_least_squares(dense)
    for a, b in zip(wide.wide_least_squares(sparse), fits, strict=True):
        assert a[0] == pytest.approx(b[0], rel=1e-6) and a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-6)
    told = [wide.out_of_fold(both_forms, c, "fold", dense.folds, fits) for c in "sx"]
    assert told[0].columns == [*both_forms.columns, "prediction"]
    a, b = [{r["id"]: (r["prediction"], r["s"]) for r in t.collect()} for t in told]
    assert len(a) == ROWS and a.keys() == b.keys()
    assert all(a[i][0] == pytest.approx(b[i][0], rel=1e-12) and a[i][1] == b[i][1] for i in a)


def test_incomplete_and_odd_sparse_rows(spark):
    schema = "id int, fold int, y double, s struct<indices array<int>, values array<double>>"
    full = [(0, 0, 1.0, ([0, 1], [1.0, 2.0])), (1, 0, 2.0, ([0], [2.0])), (2, 1, 3.5, ([0, 1], [3.0, 1.0])), (3, 1, 4.0, ([], []))]
    odd = [
        (4, None, 1.0, ([0], [9.0])), (5, 0, None, ([0], [9.0])), (6, 1, 1.0, None), (7, 1, 9.0, ([0, 1], [None, 1.0])),
        (8, 0, float("nan"), ([0], [1.0])), (9, 0, 1.0, ([0, None], [1.0, 2.0])), (10, 0, 1.0, (None, [1.0])),
        (11, 0, 1.0, ([1], None)), (12, 0, 1.0, ([1], [float("nan")])),
    ]
    clean, mixed = [wide.wide_moments(spark.createDataFrame(t, schema).repartition(2), "s", 2, "y", "fold") for t in (full, full + odd)]
    assert mixed.shift == pytest.approx(clean.shift) and mixed.folds == [0, 1]
    for a, b in zip(wide.wide_least_squares(clean, [-1]), wide.wide_least_squares(mixed, [-1]), strict=True):
        assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])
    fits = [(10.0, np.array([1.0, 2.0])), (-5.0, np.array([0.0, 3.0]))]
    got = {r["id"]: r["prediction"] for r in wide.out_of_fold(spark.createDataFrame(full + odd, schema), "s", "fold", [0, 1], fits).collect()}
    assert got == {0: 15.0, 1: 12.0, 2: -2.0, 3: -5.0, 5: 19.0, 8: 11.0} | dict.fromkeys((4, 6, 7, 9, 10, 11, 12))
    none = wide.out_of_fold(spark.createDataFrame(full, schema), "s", "fold", [], [])
    assert {r["prediction"] for r in none.collect()} == {None}
    empty = wide.wide_moments(spark.createDataFrame([], schema), "s", 2, "y", "fold")
    assert empty.folds == [] and wide.wide_least_squares(empty) == []
    for entries, error in ((([0, 2], [1.0, 1.0]), "go from 0 to 1"), (([1, 0], [1.0, 1.0]), "ascend"), (([1, 1], [1.0, 1.0]), "ascend"), (([0], []), "as many")):
        with pytest.raises(Exception, match=error):
            wide.wide_moments(spark.createDataFrame([*full, (4, 0, 1.0, entries)], schema), "s", 2, "y", "fold")


def test_days_are_entries_and_score_as_their_means(spark, tmp_path):
    rng = np.random.default_rng(3)
    days = [datetime(2024, 1, 1) + timedelta(days=int(d)) for d in rng.choice([0, 1, 58, 59, 200, 364, 365], 500)]
    rows = [(i, float(q), d) for i, (q, d) in enumerate(zip(rng.integers(1, 50, 500), days))]
    rows += [(500, 7.0, None), (501, None, days[0]), (None, 7.0, days[0])]
    spark.createDataFrame(rows, "l_orderkey bigint, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines, held, _ = scoring._day_fits(spark, str(tmp_path))
    # A line's features take what its entries take, however many days there are.
    assert lines.agg(F.max(F.size("x.indices")), F.max(F.size("x.values"))).first() == (1, 1)
    assert held == [0, 1, 2]
    whole = [(i % 3, q, d) for i, q, d in rows[:500]]
    found = {r["fold"]: r for r in scoring.wide_fold_scores(spark, str(tmp_path)).collect()}
    for k in held:
        means = {d: np.mean([q for f, q, e in whole if f != k and e == d]) for d in set(days)}
        assert found[k]["mae"] == pytest.approx(np.mean([abs(q - means[d]) for f, q, d in whole if f == k]), abs=1e-5)
        assert found[k]["rows"] == sum(i is not None and i % 3 == k for i, _, _ in rows)
