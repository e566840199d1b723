"""Expressions on genomes: strings of '0' and '1', one sign per gene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurelab.functions.draws import SEED, digest

# Each md5 sign becomes one gene: the lower eight signs 0, the upper eight 1.
_HEX = "0123456789abcdef"
_BITS = "0000000011111111"
_GENES_PER_DIGEST = 32


def random_genome(length: int, *keys, seed: int = SEED) -> Column:
    """``length`` fair genes drawn from the keys."""
    blocks = -(-length // _GENES_PER_DIGEST)
    if blocks == 1:
        drawn = F.translate(digest(*keys, seed=seed), _HEX, _BITS)
    else:
        drawn = F.concat(
            *[F.translate(digest(*keys, b, seed=seed), _HEX, _BITS) for b in range(blocks)]
        )
    return F.substring(drawn, 1, length)


def ones(genome: Column) -> Column:
    """OneMax: the number of genes set."""
    return F.length(F.replace(genome, F.lit("0"), F.lit(""))).cast("bigint")


def digit_sum(digits: Column) -> Column:
    """Sum of the decimal digits of a string."""
    total = F.lit(0)
    for d in range(1, 10):
        count = F.length(digits) - F.length(F.replace(digits, F.lit(str(d)), F.lit("")))
        total = total + count * d
    return total.cast("bigint")


def _slice(genome: Column, start: Column, stop: Column) -> Column:
    """Genes from ``start`` up to, not including, ``stop``; both count from 0."""
    return F.substr(genome, (start + 1).cast("int"), (stop - start).cast("int"))


def crossover(own: Column, other: Column, cut: Column) -> Column:
    """``own`` with half of its genes, a ring segment starting at ``cut``, taken from ``other``.

    The segment holds round(G/2) genes (halves to even) and wraps past the last gene.
    Crossing the second parent with the same cut gives the complementary child.
    """
    size = F.length(own)
    reach = cut + F.bround(size / 2).cast("bigint")
    wrapped = F.greatest(F.lit(0), reach - size)
    stop = F.least(reach, size)
    return F.concat(
        _slice(other, F.lit(0), wrapped),
        _slice(own, wrapped, cut),
        _slice(other, cut, stop),
        _slice(own, stop, size),
    )


def flip(genome: Column, position: Column) -> Column:
    """The genome with the gene at ``position`` (from 0) inverted."""
    gene = _slice(genome, position, position + 1)
    return F.concat(
        _slice(genome, F.lit(0), position),
        F.translate(gene, "01", "10"),
        _slice(genome, position + 1, F.length(genome)),
    )


def selected(genome: Column, names: list[str]) -> Column:
    """Array of the names whose gene is 1, in order."""
    if not names:
        return F.array().cast("array<string>")
    every = F.array(*[F.lit(name) for name in names])
    return F.filter(every, lambda _, i: F.substr(genome, i + 1, F.lit(1)) == "1")


def from_binary(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("bigint")


def settings(genome: Column, population_bits: int, pc_bits: int, pm_bits: int, eps: float) -> list[Column]:
    """Population size, crossover and mutation probability written in a settings genome."""
    pc_at, pm_at = population_bits + 1, population_bits + pc_bits + 1
    size = from_binary(F.substring(genome, 1, population_bits)) + 1
    pc = F.lit(1.0) / (from_binary(F.substring(genome, pc_at, pc_bits)) + F.lit(eps))
    pm = F.lit(1.0) / (from_binary(F.substring(genome, pm_at, pm_bits)) + F.lit(eps))
    return [size.alias("n"), pc.alias("pc"), pm.alias("pm")]
