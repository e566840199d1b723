"""Joins against a side that is usually small but need not be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.sources.work import materialize

# Rows a side may have to be broadcast. Callers pass narrow keys and counts only.
BROADCAST_ROWS = 100_000
# Bytes of all values of such a side.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast when it has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes.

    The side is written once and counted, so neither way computes it twice. Beyond the
    bound the join shuffles and AQE splits skew.
    """
    written = materialize(side, "side")
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in written.columns]
    rows, size = written.agg(F.count(F.lit(1)), F.sum(sum(texts, F.lit(0)))).first()
    return F.broadcast(written) if rows <= max_rows and (size or 0) <= BROADCAST_BYTES else written
