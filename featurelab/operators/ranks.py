"""Ranks and order statistics of whole tables without a one-task window."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bits of the hash counted per pass to place a cut: 2**10 counts per open bucket.
_CUT_BITS = 10
# Rows of one hash bucket that are ranked to place a cut.
_CUT_ROWS = 200_000
# Ranges a whole-table order is split into.
SPREAD_BUCKETS = 1024
# Distinct values a final order-statistic window may hold.
_FINISH_DISTINCT = 100_000
# Pieces a band is split into where a sketch does not narrow it.
_PIECES = 16


def range_bucket(
    df: DataFrame,
    column: str,
    out: str,
    buckets: int = SPREAD_BUCKETS,
) -> DataFrame:
    """Number rows by ascending ranges of ``column`` holding about equally many rows.

    Equal values share a range, so callers fold them to one row first or break ties inside it.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    inner = df.approxQuantile(column, probabilities, 0.25 / buckets)
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(
        splits=splits, inputCol=column, outputCol=out, handleInvalid="keep"
    ).transform(df)


def ordered_position(
    df: DataFrame, sort_key: str, order: list[Column], out: str, buckets: int = SPREAD_BUCKETS
) -> DataFrame:
    """0-based position over the whole table in ``order``.

    ``sort_key`` is a double that never falls along ``order``; it splits the table
    into ranges, each is numbered on its own and shifted by the rows before it.
    """
    ranged = range_bucket(df, sort_key, "_range", buckets)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )  # at most buckets + 1 rows
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(F.broadcast(shifts), "_range")
        .withColumn(out, F.col("_shift") + F.row_number().over(inside) - 1)
        .drop("_range", "_shift")
    )


@dataclass(frozen=True)
class Cut:
    """Rows whose (hash, key) lies before this point come first."""

    draw: int
    key: object


def hash_cuts(
    df: DataFrame,
    key: str,
    draw: Column,
    positions: Callable[[int], list[int]],
    rank_rows: int = _CUT_ROWS,
) -> list[Cut]:
    """The (hash, key) found at 0-based positions of the order by (draw, key).

    ``draw`` is a hash of the unique ``key`` in [0, 2**32); ``positions`` gives them for the number of rows, and those past
    the last row give no cut. Counting hash buckets finds the few that hold a position;
    large ones are counted again by further bits, and only the rows of the last, small
    ones are ranked. The table itself is never shuffled.
    """
    drawn = df.select(F.col(key).alias("key"), draw.alias("draw"))
    asked, wanted, bits = None, {0: []}, 0
    while True:
        rows = drawn if asked is None else drawn.filter(F.shiftright("draw", 32 - bits).isin(*wanted))
        fine = F.shiftright("draw", 32 - bits - _CUT_BITS)
        counts = sorted(tuple(r) for r in rows.groupBy(fine.alias("b")).count().collect())
        if asked is None:
            total = sum(count for _, count in counts)
            asked = [p for p in positions(total) if p < total]
            wanted = {0: sorted(set(asked))}
            if not asked:
                return []
        bits += _CUT_BITS
        wanted, largest = _holding(wanted, counts)
        if largest <= rank_rows or bits + _CUT_BITS > 32:
            break
    bucket = F.shiftright("draw", 32 - bits)
    place = Window.partitionBy("b").orderBy("draw", "key")
    ranked = (
        drawn.withColumn("b", bucket)
        .filter(F.col("b").isin(*wanted))
        .withColumn("place", F.row_number().over(place) - 1)
    )
    hit = reduce(or_, [(F.col("b") == b) & F.col("place").isin(*ps) for b, ps in wanted.items()])
    rows = ranked.filter(hit).select("draw", "key").collect()
    by_place = dict(zip(sorted(set(asked)), sorted((r["draw"], r["key"]) for r in rows)))
    return [Cut(*by_place[p]) for p in asked]


def _holding(wanted: dict[int, list[int]], counts: list[tuple[int, int]]) -> tuple[dict[int, list[int]], int]:
    """The finer buckets that hold the wanted positions, and the rows of the largest one."""
    found: dict[int, list[int]] = {}
    start, coarse, largest = 0, None, 0
    for bucket, count in counts:
        if bucket >> _CUT_BITS != coarse:
            start, coarse = 0, bucket >> _CUT_BITS
        here = [p - start for p in wanted[coarse] if start <= p < start + count]
        if here:
            found[bucket] = here
            largest = max(largest, count)
        start += count
    return found, largest


def section(key: str, draw: Column, cuts: list[Cut]) -> Column:
    """How many cuts lie at or before the row: a narrow expression, no join and no shuffle."""
    passed = [
        ((draw > c.draw) | ((draw == c.draw) & (F.col(key) >= F.lit(c.key)))).cast("int")
        for c in cuts
    ]
    return reduce(lambda a, b: a + b, passed, F.lit(0))


def _band_rows(value: Column, low, high) -> Column:
    return (value >= low) & (value <= high)


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    finish_distinct: int = _FINISH_DISTINCT,
    accuracy: int = 10_000,
) -> dict[tuple[str, float], float | None]:
    """Quantiles with linear interpolation, exact on any number of rows.

    A sketch brackets each quantile, counting proves the bracket right, and it is
    narrowed again until it holds few distinct values; those are counted by value
    and searched in order. A bracket that a sketch leaves as wide as it was is split by the
    bits of the double instead, which ends after 16 splits whatever the values. No task ever
    holds a whole column. NaN counts as NULL; a column without a value has None. Columns may
    have any names: inside they go by place.
    """
    names = {f"v{i}": c for i, c in enumerate(columns)}
    given = {v: F.col("`" + c.replace("`", "``") + "`").cast("double") for v, c in names.items()}
    data = df.select(*[F.when(~F.isnan(x), x).alias(v) for v, x in given.items()])
    columns = list(names)
    summary = data.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.min(c).alias("low"),
                F.max(c).alias("high"),
                F.approx_count_distinct(c).alias("distinct"),
            ).alias(c)
            for c in columns
        ]
    ).first()

    answers: dict[tuple[str, float], float | None] = {}
    open_: dict[tuple[str, float], dict] = {}
    for c in columns:
        s = summary[c]
        for p in probabilities:
            if s["n"] == 0:
                answers[c, p] = None
                continue
            place = (s["n"] - 1) * p
            open_[c, p] = {
                "low": s["low"], "high": s["high"], "below": 0, "inside": s["n"],
                "distinct": s["distinct"], "first": int(place), "place": place,
                "last": min(int(place) + 1, s["n"] - 1),
            }
    while True:
        wide = {k: b for k, b in open_.items() if b["distinct"] > finish_distinct and b["low"] < b["high"]}
        if not wide:
            break
        stuck = _narrow(data, wide, accuracy)
        if stuck:
            _split(data, stuck)
    answers.update(_finish(data, open_))
    return {(names[v], p): found for (v, p), found in answers.items()}


def _narrow(data: DataFrame, bands: dict, accuracy: int) -> dict:
    """One sketch and one counting pass for all open bands; updates them in place and returns those left as they were.

    Quantiles looked for in the same band of a column share a sketch.
    """
    names = {f"q{i}": key for i, key in enumerate(bands)}
    shared: dict[tuple, list[str]] = {}
    for name, key in names.items():
        band = bands[key]
        shared.setdefault((key[0], band["low"], band["high"]), []).append(name)
    sketches = []
    for i, ((column, low, high), users) in enumerate(shared.items()):
        ends: list[float] = []
        for name in users:
            band = bands[names[name]]
            first = (band["first"] - band["below"]) / band["inside"]
            last = (band["last"] + 1 - band["below"]) / band["inside"]
            ends += [max(0.0, first - 2.0 / accuracy), min(1.0, last + 2.0 / accuracy)]
        inside = F.when(_band_rows(F.col(column), low, high), F.col(column))
        sketches.append(F.percentile_approx(inside, ends, accuracy).alias(f"s{i}"))
    sketched = data.agg(*sketches).first()
    bracket = {
        name: sketched[f"s{i}"][2 * u : 2 * u + 2]
        for i, users in enumerate(shared.values())
        for u, name in enumerate(users)
    }
    counted = []
    for name, key in names.items():
        low, high = bracket[name]
        value = F.col(key[0])
        counted.append(
            F.struct(
                F.count_if(value < low).alias("below"),
                F.count_if(_band_rows(value, low, high)).alias("inside"),
                F.approx_count_distinct(F.when(_band_rows(value, low, high), value)).alias("distinct"),
            ).alias(name)
        )
    counts = data.agg(*counted).first()
    stuck = {}
    for name, key in names.items():
        band, found = bands[key], counts[name]
        holds = found["below"] <= band["first"] and band["last"] < found["below"] + found["inside"]
        if holds and found["inside"] < band["inside"]:
            low, high = bracket[name]
            band.update(low=low, high=high, below=found["below"],
                        inside=found["inside"], distinct=found["distinct"])
        else:
            stuck[key] = band
    return stuck


def _ordinal(value: float) -> int:
    """Place of a double among all doubles."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _double(ordinal: int) -> float:
    size = struct.unpack("<d", struct.pack("<q", abs(ordinal)))[0]
    return size if ordinal >= 0 else -size


def _split(data: DataFrame, bands: dict) -> None:
    """Cut each band into pieces with equally many doubles and keep the one that holds its place.

    One scan counts the pieces of all bands. Where the two values between which a quantile lies
    fall into two pieces, the band shrinks to these values.
    """
    edges, counted = {}, []
    for i, (key, band) in enumerate(bands.items()):
        start, stop = _ordinal(band["low"]), _ordinal(band["high"])
        cuts = sorted({start + (stop - start) * k // _PIECES for k in range(_PIECES)} | {start - 1, stop})
        edges[key] = [(_double(a + 1), _double(b)) for a, b in zip(cuts, cuts[1:])]
        for j, (low, high) in enumerate(edges[key]):
            value = F.when(_band_rows(F.col(key[0]), low, high), F.col(key[0]))
            counted.append(
                F.struct(
                    F.count(value).alias("inside"), F.min(value).alias("low"), F.max(value).alias("high"),
                    F.approx_count_distinct(value).alias("distinct"),
                ).alias(f"p{i}_{j}")
            )
    counts = data.agg(*counted).first()
    for i, (key, band) in enumerate(bands.items()):
        below, pieces = band["below"], []
        for j in range(len(edges[key])):
            piece = counts[f"p{i}_{j}"]
            if below <= band["last"] and band["first"] < below + piece["inside"]:
                pieces.append((below, piece))
            below += piece["inside"]
        (start, first), last = pieces[0], pieces[-1][1]
        if len(pieces) == 1:
            band.update(low=first["low"], high=first["high"], below=start, inside=first["inside"], distinct=first["distinct"])
        else:  # the greatest value of one piece and the least of the next that has any
            band.update(low=first["high"], high=last["low"], distinct=0, found=True)


def _between(band: dict, low: float, high: float) -> float:
    share = band["place"] - band["first"]
    return low if low == high or not share else low + (high - low) * share


def _finish(data: DataFrame, open_: dict) -> dict:
    result = {k: _between(b, b["low"], b["high"]) for k, b in open_.items() if "found" in b}
    bands = {k: b for k, b in open_.items() if k not in result}
    if not bands:
        return result
    shared: dict[tuple, int] = {}
    for (c, _), b in bands.items():
        shared.setdefault((c, b["low"], b["high"]), len(shared))
    entries = [
        F.when(
            _band_rows(F.col(c), low, high),
            F.struct(F.lit(i).alias("band"), F.col(c).alias("value")),
        )
        for (c, low, high), i in shared.items()
    ]
    counted = (
        data.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.band", "e.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    before = Window.partitionBy("band").orderBy("value")
    placed = counted.withColumn("stop", F.sum("rows").over(before))
    tests, targets = [], {}
    for key, b in bands.items():
        band = shared[key[0], b["low"], b["high"]]
        targets[key] = (band, b["first"] - b["below"], b["last"] - b["below"])
        for place in {targets[key][1], targets[key][2]}:
            tests.append(
                (F.col("band") == band)
                & (F.col("stop") > place)
                & (F.col("stop") - F.col("rows") <= place)
            )
    hits = placed.filter(reduce(or_, tests)).collect()

    def at(band: int, place: int) -> float:
        return next(
            h["value"] for h in hits
            if h["band"] == band and h["stop"] - h["rows"] <= place < h["stop"]
        )

    for key, (band, first, last) in targets.items():
        result[key] = _between(bands[key], at(band, first), at(band, last))
    return result
