"""SimHash near copies: fingerprints of word shingles, linked through vantage-point trees.

A tree on a bounded sample of fingerprints deals all distinct fingerprints into shards. At a node
with vantage point ``v`` and radius ``m`` a fingerprint lies inside if its distance to ``v`` is at
most ``m``. Two fingerprints at most ``r`` bits apart lie on different sides only if the outer one
is within ``m + r``; it is then sent into the inner side as a visitor, where both branches are
pruned by the same triangle bounds. So each pair meets once, in the shard that is home to one of
them. Inside a shard the same split goes on until the rest is compared pair by pair.

A shard returns one link per fingerprint, to the smallest of those it is connected with there, so a
group of copies gives as many links as fingerprints and not as many as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.llm.components import connected_components
from featurelab.sources.work import materialize

# Fingerprints the splitting tree is fitted on.
TREE_SAMPLE = 50_000
# Distinct fingerprints a shard is home to, about.
SHARD_SIZE = 1_024
# Shards of the tree; beyond this many they grow instead, and split further inside their task.
MAX_SHARDS = 4_096
# Fingerprints that are compared with all others of their branch.
_LEAF = 256


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """Bit ``i`` is set if it is set in over half of the hashes of all shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, last, strict=False)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint): 64-bit SimHash of each whole text, as a signed long.

    Texts are lower-cased in A-Z and split at ASCII white space. A text of fewer than ``width``
    words is one shingle; a NULL text or one without words has fingerprint 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            signed = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


def _distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def _vantage(points: np.ndarray, bits: int, draws: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The point and radius, of a few drawn points, that put fewest points near the border."""
    best = None
    for point in points[draws.integers(0, points.size, 8)]:
        counts = np.bincount(_distance(points, point), minlength=65 + bits).cumsum()
        for radius in range(64):
            inside = counts[radius] / points.size
            if not 0.25 <= inside <= 0.75:
                continue
            border = (counts[radius + bits] - counts[max(radius - bits, 0)]) / points.size
            if best is None or border < best[0]:
                best = (border, point, radius)
    return best and best[1:]


def build_tree(sample: np.ndarray, bits: int, shards: int, seed: int = 42) -> list[tuple]:
    """Nodes (vantage point, radius, inner node, outer node), or (shard,) at the ends; the first is the root."""
    draws = np.random.default_rng(seed)
    nodes: list[tuple] = []
    least = max(16, sample.size // max(1, shards))
    shard = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shard
        at = len(nodes)
        nodes.append(())
        cut = _vantage(points, bits, draws) if points.size > 1.5 * least else None
        if cut is None:
            nodes[at] = (shard,)
            shard += 1
            return at
        inner = _distance(points, cut[0]) <= cut[1]
        nodes[at] = (cut[0], cut[1], grow(points[inner]), grow(points[~inner]))
        return at

    grow(sample)
    return nodes


def _route(nodes: list[tuple], points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, indices of points, whether it is their home) for all shards the points go to."""
    todo = [(0, np.arange(points.size), np.arange(0))]
    while todo:
        at, home, visit = todo.pop()
        if len(nodes[at]) == 1:
            for which, own in ((home, True), (visit, False)):
                if which.size:
                    yield nodes[at][0], which, own
            continue
        point, radius, inner, outer = nodes[at]
        of_home, of_visit = _distance(points[home], point), _distance(points[visit], point)
        crossing = home[(of_home > radius) & (of_home <= radius + bits)]
        sides = (
            (inner, home[of_home <= radius], np.concatenate([visit[of_visit <= radius + bits], crossing])),
            (outer, home[of_home > radius], visit[of_visit.astype(np.int64) > radius - bits]),
        )
        todo += [side for side in sides if side[1].size or side[2].size]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the index of each group's first point) after joining a[i] with b[i]."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def groups_of_shard(points: np.ndarray, home: np.ndarray, bits: int, seed: int = 42) -> np.ndarray:
    """For each of the sorted points the first one it is connected to by links with a home point."""
    draws = np.random.default_rng(seed)
    label = np.arange(points.size)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, visit = todo.pop()
        cut = _vantage(points[own], bits, draws) if own.size > _LEAF else None
        if cut is not None:
            point, radius = cut
            of_own, of_visit = _distance(points[own], point), _distance(points[visit], point)
            crossing = own[(of_own > radius) & (of_own <= radius + bits)]
            todo.append((own[of_own <= radius], np.concatenate([visit[of_visit <= radius + bits], crossing])))
            todo.append((own[of_own > radius], visit[of_visit.astype(np.int64) > radius - bits]))
            continue
        for at in range(0, own.size, _LEAF):
            block, others = own[at : at + _LEAF], np.concatenate([own[at:], visit])
            for start in range(0, others.size, 1 << 14):
                part = others[start : start + (1 << 14)]
                a, b = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[part][None, :]) <= bits)
                label = _unite(label, block[a], part[b])
    return label


def fingerprint_links(points: DataFrame, bits: int, tree_sample: int = TREE_SAMPLE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints at most ``bits`` apart, directly or through others.

    ``points`` is a written table of distinct ``fingerprint`` longs. The tree is fitted on at most
    about ``tree_sample`` of them; all of them are dealt out and searched.
    """
    total = points.count()
    drawn = points.sample(min(1.0, tree_sample / max(1, total)), 42).select("fingerprint").toPandas()
    sample = np.sort(drawn["fingerprint"].to_numpy(np.int64)).view(np.uint64)
    nodes = build_tree(sample, bits, min(MAX_SHARDS, -(-total // shard_size)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, which, own in _route(nodes, points.view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(which.size, shard, np.int32)), pa.array(points[which]), pa.array(np.full(which.size, own))],
                    ["shard", "fingerprint", "home"],
                )

    def search(table: pa.Table) -> pa.Table:
        signed = table.column("fingerprint").to_numpy()
        order = np.argsort(signed)
        signed, home = signed[order], table.column("home").to_numpy()[order]
        first = groups_of_shard(signed.view(np.uint64), home, bits)
        linked = first != np.arange(signed.size)
        return pa.table({"a": signed[linked], "b": signed[first[linked]]})

    dealt = points.select("fingerprint").mapInArrow(deal, "shard int, fingerprint long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, seed: int = 42,
    tree_sample: int = TREE_SAMPLE, shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per document.

    Documents whose fingerprints of ``width``-word shingles differ in at most ``max_bits`` bits are
    linked; ``component_id`` is the smallest id reachable over links, the document's own included.
    ``fingerprint`` is 16 lowercase hexadecimal digits.

    NULL and wordless texts have fingerprint 0 and are linked like any other. A row with a NULL id
    stays, and its component is the smallest id that is not NULL (NULL if there is none). Repeated
    rows stay repeated. Other columns of ``docs`` are not read. An empty table gives an empty one.
    """
    found = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    points = materialize(found.groupBy("fingerprint").agg(F.min("id").alias("first")), "points")
    links = fingerprint_links(points, max_bits, tree_sample, shard_size)
    roots = connected_components(materialize(links, "links")).withColumnRenamed("node", "fingerprint")
    linked = materialize(roots.join(points, "fingerprint"), "linked")
    low = materialize(linked.groupBy("root").agg(F.min("first").alias("low")), "lowest")
    moved = linked.join(low, "root").select("fingerprint", "low")
    component = materialize(
        points.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("low", "first").alias("component_id")),
        "component",
    )
    return found.join(component, "fingerprint").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
