"""How the sources of a language diverge from each other and from the language, term by term.

Shares and divergences depend on counts alone, so nothing is evaluated per term: terms with the same
(count in the group, count in the language) form a cell, the divergence is evaluated once per cell, and
cells are ranked by it with the number of their terms added up. Cells of equal values are merged; only
those within the asked ranks are expanded to their terms, in the order of UTF-8.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.sources.work import materialize

# Documents of a language that hold a term, for the term to be kept.
LEAST_DOCUMENTS = 10
# Terms listed of each group.
TERM_RANKS = 10
# Counts and bytes of texts a task holds before it hands them on.
_HELD_TERMS = 200_000
_HELD_BYTES = 64 << 20
# ASCII signs that are no letters become blanks, A-Z become a-z; all other bytes belong to terms.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted in parts: add up equal keys."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))

    def told(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, within) in held.items():
            terms = list(count)
            size = len(terms)
            for start in range(0, size, 10_000):
                part = terms[start : start + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()), pa.array([count[t] for t in part], pa.int64()),
                        pa.array([within[t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries, size = 0, 0
        for batch in batches:
            for lang, source, text in zip(*[batch.column(k) for k in range(3)], strict=True):
                data = text.as_py()
                terms = data.translate(_SIGNS).split()
                count, within = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before = len(count)
                count.update(terms)
                within.update(set(terms))
                entries, size = entries + len(count) - before, size + len(data)
                if entries > _HELD_TERMS or size > _HELD_BYTES:
                    yield from told(held)
                    held, entries, size = {}, 0, 0
        yield from told(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(parts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, leads): counts of the terms that at least ``least`` documents of
    the language hold; ``leads`` is 1 in one row of each term of a language.

    Dealt out once, by language and term: a key has at most one row per source after the sums.
    """
    counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (
        counts.withColumns(
            {
                "lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term),
                "leads": (F.min("source").over(of_term) == F.col("source")).cast("long"),
            }
        )
        .where(F.col("lang_docs") >= least)
        .drop("docs", "lang_docs")
    )


def _share(count: str, total: str) -> str:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) in SQL; NULL in a language without terms."""
    return (
        f"(1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0)))"
        f" div cast(nullif({total} + 2 * terms, 0) as decimal(20,0)))"
    )


def _divergence(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def group_sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, held): one row per occurring group; ``held`` is how many kept
    terms occur in it."""
    sums = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"), F.sum("leads").alias("_leads")
    )
    of_lang = Window.partitionBy("lang")  # one row per source
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "held", "_leads")}
    return (
        groups.join(sums, ["lang", "source"], "left")
        .withColumns(zero)
        .withColumns({"terms": F.sum("_leads").over(of_lang), "lang_total": F.sum("total").over(of_lang)})
        .drop("_leads")
    )


def leading_terms(kept: DataFrame, sizes: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, item, value, rank): the terms whose share in the group is above the language's, by
    divergence; equal values by UTF-8."""
    key = ["lang", "source"]
    cells = kept.groupBy(*key, "n", "lang_n").agg(F.count(F.lit(1)).alias("terms_of")).join(sizes, key)
    cells = cells.withColumns({"p": F.expr(_share("n", "total")), "q": F.expr(_share("lang_n", "lang_total"))})
    cells = materialize(
        cells.where("p > q").select(*key, "n", "lang_n", "terms_of", F.expr(_divergence("p", "q")).alias("value")), "cells"
    )
    by_value = Window.partitionBy(*key).orderBy(F.col("value").desc())
    # No more than ``ranks`` values can be within the ranks, so each task hands on only so many of a group.
    values = cells.groupBy(*key, "value").agg(F.sum("terms_of").alias("terms_of"))
    values = values.withColumn("nth", F.row_number().over(by_value)).where(F.col("nth") <= ranks)
    before = F.coalesce(F.sum("terms_of").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = values.withColumn("before", before).where(F.col("before") < ranks).select(*key, "value")
    chosen = cells.join(within, [*key, "value"]).select(*key, "n", "lang_n", "value")
    by_term = Window.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    return (
        kept.join(chosen, [*key, "n", "lang_n"])
        .select(*key, F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(by_term))
        .where(F.col("rank") <= ranks)
    )


def source_pairs(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): divergence of every two sources of a language, over all kept terms.

    Only terms that both sources hold are joined, and at once grouped into cells of equal counts. All
    others follow from the histogram of each source's counts: with d(x, y) the divergence of counts x
    and y, the sum is that of d(x, 0) over the terms of one, of d(0, y) over those of the other, of
    d(0, 0) as often as terms are left, and for each term of both d(x, y) - d(x, 0) - d(0, y) + d(0, 0).
    """
    one, two = (sizes.select("lang", *[F.col(c).alias(f"{side}_{c}") for c in ("source", "total", "held")], *more)
                for side, more in (("a", ["terms"]), ("b", [])))
    # The answer itself has a row for every two sources of a language; here each pair is once.
    pairs = materialize(one.join(two, "lang").where("a_source < b_source"), "pairs")
    key = ["lang", "a_source", "b_source"]
    hist = materialize(kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), "histogram")
    left, right = (
        kept.select("lang", "term", F.col("source").alias(f"{side}_source"), F.col("n").alias(f"{side}_n")) for side in "ab"
    )
    joint = left.join(right, ["lang", "term"]).where("a_source < b_source").groupBy(*key, "a_n", "b_n").agg(F.count(F.lit(1)).alias("m"))

    def d(a: str, b: str) -> str:
        return _divergence(_share(a, "a_total"), _share(b, "b_total"))

    def summed(cells: DataFrame, value: str, on: list[str]) -> DataFrame:
        return pairs.join(cells, on).groupBy(*key).agg(F.sum(F.expr(f"m * ({value})")).alias("part"))

    both = summed(joint, f"{d('a_n', 'b_n')} - {d('a_n', '0')} - {d('0', 'b_n')} + {d('0', '0')}", key)
    of_a = summed(hist.withColumnRenamed("source", "a_source"), d("n", "0"), ["lang", "a_source"])
    of_b = summed(hist.withColumnRenamed("source", "b_source"), d("0", "n"), ["lang", "b_source"])
    rest = pairs.select(*key, F.expr(f"(terms - a_held - b_held) * ({d('0', '0')})").alias("part"))
    total = both.unionByName(of_a).unionByName(of_b).unionByName(rest).groupBy(*key).agg(F.coalesce(F.sum("part"), F.lit(0)).alias("value"))
    total = materialize(total, "divergences")
    ways = [("a_source", "b_source"), ("b_source", "a_source")]
    sides = [total.select("lang", F.col(s).alias("source"), F.col(i).alias("item"), "value") for s, i in ways]
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return sides[0].unionByName(sides[1]).withColumn("rank", F.row_number().over(by_value))


def audit(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (language, source) that occurs.

    Terms are runs of letters A-Z, in lower case, and of signs beyond ASCII; each language keeps those
    that ``least`` of its documents hold. A count c of a group or language has the share p = 1 +
    floor(10^9 (c + 2) / (N + 2 V)), N being its counts of all V kept terms, and shares p and q diverge
    by floor((p - q)^2 / (p + q)). Part ``pair``: each other source of the language and the divergences
    of all kept terms added up. Part ``term``: the first ``ranks`` terms of the group with a share above
    the language's. Ranks start at 1, by value descending, then by item in UTF-8.

    NULL texts, languages and sources are empty ones; a group without terms is listed with its pairs, and
    in a language without kept terms all pairs have value 0; repeated rows count again; very long terms
    are terms; other columns are not read; an empty table gives an empty one.
    """
    parts = term_counts(docs, text_col, lang_col, source_col)
    kept = materialize(kept_terms(parts, least), "kept")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    sizes = materialize(group_sizes(docs.select(*names).distinct(), kept), "sizes")
    order = ["lang", "source", "part", "item", "value", "rank"]
    pair = source_pairs(kept, sizes).withColumn("part", F.lit("pair")).select(*order)
    return pair.unionByName(leading_terms(kept, sizes, ranks).withColumn("part", F.lit("term")).select(*order))
