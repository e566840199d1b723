"""Language of a text by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every stretch of signs that are no letters becomes one space; n-grams of the
letters and spaces are hashed into buckets. Spark counts the buckets of each language over the learned
texts; the matrix of log-probabilities, languages by buckets, is sent to all tasks, which score many
texts at a time: a batch is a sparse matrix of texts by buckets, and its product with a language's row
is one sum per text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.llm.quality import held_out

# Lengths of the n-grams, in signs.
SIZES = (1, 2, 3)
# Buckets, as a power of two.
BUCKET_BITS = 16
# Texts a language is learned from, about, drawn by a hash of their id.
FIT_PER_LANGUAGE = 20_000
# Languages at most: the matrix then has 256 MB.
MAX_LANGUAGES = 512
# Added to the count of every bucket.
SMOOTHING = 0.1
# Signs of text handled at a time, and n-grams scored at a time.
_CHUNK = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text of each): every text as one space, its letters in lower case, and one space
    for each stretch of other signs."""
    lower = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.flatnonzero(np.diff(of, prepend=-1))] = True
    return np.where(letter, codes, 32)[keep], of[keep]


def buckets(codes: np.ndarray, of: np.ndarray, sizes: tuple[int, ...] = SIZES, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of all n-grams with a letter, some at a time."""
    for size in sizes:
        for start in range(0, codes.size - size + 1, _CHUNK):
            part = codes[start : start + _CHUNK + size - 1].astype(np.uint64)
            text = of[start : start + _CHUNK + size - 1]
            count = part.size - size + 1
            value = np.full(count, size, dtype=np.uint64)
            for k in range(size):
                value = (value + part[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(32)
            value = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
            whole = text[:count] == text[size - 1 :]
            if size == 1:
                whole &= part != 32
            yield value[whole].astype(np.int64), text[:count][whole]


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of about ``_CHUNK`` signs, a longer text alone."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= _CHUNK or at + 1 == len(texts):
            yield first, texts[first : at + 1]
            first, size = at + 1, 0


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages in order, log shares of their texts, log-probabilities (language, bucket)."""

    languages: list[str]
    shares: np.ndarray
    matrix: np.ndarray
    sizes: tuple[int, ...]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, whether the text has a letter) of each text."""
        best, sure, known = [], [], []
        bits = int(self.matrix.shape[1]).bit_length() - 1
        for _, part in _parts(texts):
            codes, of = signs(part)
            total = np.tile(self.shares, (len(part), 1))
            for bucket, text in buckets(codes, of, self.sizes, bits):
                for k, row in enumerate(self.matrix):
                    total[:, k] += np.bincount(text, weights=row[bucket], minlength=len(part))
            top = total.argmax(axis=1)
            best.append(top)
            sure.append(1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
            known.append(np.bincount(of[codes != 32], minlength=len(part)) > 0)
        return tuple(np.concatenate([np.zeros(0, kind), *x]) for kind, x in ((int, best), (float, sure), (bool, known)))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_PER_LANGUAGE,
    sizes: tuple[int, ...] = SIZES, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING, seed: int = 42,
) -> LanguageModel | None:
    """Learned from about ``per_language`` texts of each language at most, drawn by a hash of their id;
    n-grams are counted over their whole texts. The shares are those of all rows that may be learned.

    Held-out ids and NULL ids, texts and languages are left out; repeated rows count again. None if
    nothing is left. More than ``MAX_LANGUAGES`` languages: ValueError.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    rows = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not rows:
        return None
    texts = {r["lang"]: r["count"] for r in rows}
    many = [lang for lang in sorted(texts) if texts[lang] > per_language]
    if many:
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
        shares = F.create_map(*[F.lit(x) for lang in many for x in (lang, per_language / texts[lang])])
        known = known.where(draw < F.coalesce(F.element_at(shares, F.col("lang")), F.lit(1.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, part in _parts(batch.column(0).to_pylist()):
                codes, of = signs(part)
                number = {lang: k for k, lang in enumerate(sorted(set(langs[first : first + len(part)])))}
                at = np.array([number[lang] for lang in langs[first : first + len(part)]])
                for bucket, text in buckets(codes, of, sizes, bits):
                    found = np.bincount((at[text] << bits) + bucket, minlength=len(number) << bits).reshape(len(number), -1)
                    for lang, k in number.items():
                        counts[lang] = counts.get(lang, 0) + found[k]
        for lang, found in counts.items():
            bucket = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * bucket.size, pa.string()), pa.array(bucket), pa.array(found[bucket])], ["lang", "bucket", "n"])

    counted = known.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    # One row per language and bucket at most.
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(texts)
    matrix = np.zeros((len(languages), 1 << bits))
    place = {lang: k for k, lang in enumerate(languages)}
    at = np.array([place[lang] for lang in table.column("lang").to_pylist()], dtype=np.int64)
    matrix[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    matrix = np.log((matrix + smoothing) / (matrix.sum(axis=1, keepdims=True) + smoothing * matrix.shape[1]))
    total = sum(texts.values())
    return LanguageModel(languages, np.array([math.log(texts[lang] / total) for lang in languages]), matrix, sizes)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), one row per row of ``docs``: the likeliest language of the whole text
    and its probability; the first in order of equally likely ones.

    A NULL text and one without a letter is ``und`` with score 0, as is every text without a model. NULL
    ids and repeated rows stay; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if shared.value is None:
                named, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                best, sure, known = shared.value.scores(texts)
                named = [shared.value.languages[k] if letter else UNKNOWN for k, letter in zip(best, known, strict=True)]
                sure = np.where(known, sure, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(sure)], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
