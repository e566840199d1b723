"""Tokens of two tokenizers over the same bytes, aligned by galloping intersection.

Both tokenizers tile the bytes of a text, so a tokenization is its list of token ends. The shorter end
list drives: each of its ends is sought in the longer one, by doubling steps from where an earlier end
was found and then by halving. Ends that are in both lists cut the text into groups; differences of the
ranks found are the tokens of the longer list that a token of the shorter one overlaps.

The searches of many texts go side by side in numpy: their ends are made one ascending list by adding
up the texts' sizes. An end starts where the end ``s`` places before it was found, with ``s`` halved
from pass to pass, so that the last pass, over half of all ends, starts next to its answer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.llm.packing import IdReader

# Signs of text aligned side by side; one longer text goes alone.
_CHUNK = 1 << 20


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # The public byte-level alphabet: printable signs stand for themselves, the others for 256 and on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = spec["model"]["vocab"] | {content: i for i, content in special.items()}
    tokens = [b""] * (1 + max(vocabulary.values()))
    for entry, i in vocabulary.items():
        tokens[i] = entry.encode() if i in special else bytes(byte[c] for c in entry)
    return tokens


class PieceReader:
    """Ids and token bytes of a piece model; it puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.uint32)


@dataclass(frozen=True)
class Tokenizers:
    """Both readers, the bytes and sizes of their tokens, and what each id looks like in a group."""

    reader: IdReader
    pieces: PieceReader
    tokens: list[bytes]
    sizes: tuple[np.ndarray, np.ndarray]
    shown: np.ndarray

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none for a NULL or empty text or one that either does not give back."""
        if text:
            whole = (" " + text).encode()
            a, b = self.reader.ids(" " + text), self.pieces.ids(text)
            if whole == b"".join(map(self.tokens.__getitem__, a.tolist())) == b"".join(map(self.pieces.tokens.__getitem__, b.tolist())):
                return a, b
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """Read once in a worker, whatever the number of its tasks."""
    tokens, pieces = byte_level_tokens(byte_path), PieceReader(piece_path)
    shown = [f"{i}{sign}" for ids, signs in ((len(tokens), ",|"), (len(pieces.tokens), ",;")) for i in range(ids) for sign in signs]
    sizes = tuple(np.array([len(t) for t in side], dtype=np.int64) for side in (tokens, pieces.tokens))
    return Tokenizers(IdReader(byte_path, plain=True), pieces, tokens, sizes, np.array(shown, dtype=object))


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the place of the first of ``long`` that is not smaller; both ascend strictly."""
    found = np.zeros(short.size, dtype=np.int64)
    stride = 1 << max(0, short.size - 1).bit_length()
    while stride:
        # Ends at the odd multiples of the stride, from what the end a stride before has found.
        driven = np.arange(stride, short.size, 2 * stride) if stride < short.size else np.arange(min(1, short.size))
        value = short[driven]
        low = found[driven - stride] if stride < short.size else np.zeros(driven.size, dtype=np.int64)
        high, step = np.minimum(low + 1, long.size), 1
        open_ = np.flatnonzero((high > low) & (long[np.maximum(high - 1, 0)] < value)) if long.size else np.zeros(0, np.int64)
        while open_.size:
            step *= 2
            low[open_] = high[open_]
            high[open_] = np.minimum(low[open_] + step, long.size)
            open_ = open_[(high[open_] > low[open_]) & (long[high[open_] - 1] < value[open_])]
        open_ = np.flatnonzero(high > low)
        while open_.size:
            middle = (low[open_] + high[open_]) >> 1
            smaller = long[middle] < value[open_]
            low[open_[smaller]] = middle[smaller] + 1
            high[open_[~smaller]] = middle[~smaller]
            open_ = open_[high[open_] > low[open_]]
        found[driven] = low
        stride >>= 1
    return found


@dataclass(frozen=True)
class Aligned:
    """Token ids of many texts and where both end.

    ``ids`` and ``of`` (the text of each token) per side; ``common`` the places of the common ends per
    side, ascending; ``first`` and ``last`` per side, for the tokens that drove: the tokens of the other
    side they overlap (-1 for the others).
    """

    ids: tuple[np.ndarray, np.ndarray]
    of: tuple[np.ndarray, np.ndarray]
    common: tuple[np.ndarray, np.ndarray]
    first: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]


def intersect(read: list[tuple[np.ndarray, np.ndarray]], sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Ids of both tokenizers for some texts, aligned; in each text the side of fewer tokens drives."""
    counts = [np.array([pair[side].size for pair in read], dtype=np.int64) for side in (0, 1)]
    ids = tuple(np.concatenate([pair[side] for pair in read]).astype(np.int64) for side in (0, 1))
    of = tuple(np.repeat(np.arange(len(read)), n) for n in counts)
    ends = [np.cumsum(sizes[side][ids[side]]) for side in (0, 1)]
    common: list[tuple[np.ndarray, np.ndarray]] = []
    first = tuple(np.full(i.size, -1, dtype=np.int64) for i in ids)
    last = tuple(np.full(i.size, -1, dtype=np.int64) for i in ids)
    for driver in (0, 1):
        drives = (counts[0] <= counts[1]) == (driver == 0)
        own, other = (np.flatnonzero(drives[of[side]]) for side in (driver, 1 - driver))
        short, long = ends[driver][own], ends[1 - driver][other]
        if not short.size:
            continue
        rank = gallop(short, long)
        same = long[rank] == short
        common.append(tuple(x if driver == 0 else y for x, y in ((own[same], other[rank[same]]), (other[rank[same]], own[same]))))
        # The next token starts behind a common end, else inside the token that the last end lies in.
        first[driver][own] = other[np.append(0, rank[:-1] + same[:-1])]
        last[driver][own] = other[rank]
    both = tuple(np.sort(np.concatenate([np.zeros(0, np.int64), *[c[side] for c in common]])) for side in (0, 1))
    return Aligned(ids, of, both, first, last)


def _groups(found: Aligned, texts: int, shown: np.ndarray, vocabulary: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids of its groups in order."""
    codes = np.empty(sum(i.size for i in found.ids), dtype=np.int64)
    for side, base in ((0, 0), (1, 2 * vocabulary)):
        ids, ends = found.ids[side], found.common[side]
        closes = np.zeros(ids.size, dtype=np.int64)
        closes[ends] = 1
        group = np.cumsum(closes) - closes
        # Before it lie the tokens of its own side and the other side's groups up to its own or the one before.
        others = np.append(0, found.common[1 - side] + 1)
        codes[np.arange(ids.size) + others[group + side]] = base + 2 * ids + closes
    counts = np.bincount(found.of[0], minlength=texts) + np.bincount(found.of[1], minlength=texts)
    told, cuts = shown[codes].tolist(), np.append(0, np.cumsum(counts)).tolist()
    return ["".join(told[a:b])[:-1] for a, b in zip(cuts, cuts[1:])]


def _lists(of: np.ndarray, texts: int, values: pa.Array) -> pa.Array:
    cuts = np.append(0, np.cumsum(np.bincount(of, minlength=texts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), values)


def align_tokens(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", overlaps: bool = False,
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups, links), one row per row of ``docs``.

    A is the byte-level tokenizer of ``byte_path`` over a space and the text, B the piece model of
    ``piece_path``, which adds that space itself; strings of special tokens are plain text to both. Byte
    offsets at which tokens of both end cut the tokens into groups: ``groups`` is ``a1,a2|b1;a3|b2,b3``,
    the ids in order. ``links`` are the pairs of tokens that end together as (a, b, times). With
    ``overlaps`` also the array ``overlaps`` of (side, token, first, last): which tokens of the other
    side, from 0, the tokens of the text's shorter list overlap.

    A NULL or empty text, and one whose bytes either tokenizer does not give back, has no tokens: zeros,
    an empty string and empty arrays. NULL ids and repeated rows stay, each with its own row; other
    columns are not read; an empty table gives an empty one. Texts are read whole, however long.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])
    overlap = pa.struct([("side", pa.string()), ("token", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])

    def told(batch: pa.RecordBatch, read: list[tuple[np.ndarray, np.ndarray]], known: Tokenizers) -> pa.RecordBatch:
        texts, vocabulary = len(read), len(known.tokens)
        found = intersect(read, known.sizes)
        a, b = (found.ids[side][found.common[side]] for side in (0, 1))
        of = found.of[0][found.common[0]]
        groups = np.bincount(of, minlength=texts)
        order = np.lexsort((b, a, of))
        a, b, of = a[order], b[order], of[order]
        new = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(a, prepend=-1) | np.diff(b, prepend=-1))
        times = np.diff(np.append(new, of.size))
        values = [pa.array(a[new].astype(np.int32)), pa.array(b[new].astype(np.int32)), pa.array(times.astype(np.int64))]
        columns = [
            batch.column(0), *[pa.array(np.bincount(found.of[side], minlength=texts).astype(np.int64)) for side in (0, 1)],
            pa.array(groups.astype(np.int64)), pa.array(np.bincount(of[new], times, minlength=texts).astype(np.int64)),
            pa.array(_groups(found, texts, known.shown, vocabulary), pa.string()),
            _lists(of[new], texts, pa.StructArray.from_arrays(values, fields=list(link))),
        ]
        if overlaps:
            sides = []
            begins = [np.searchsorted(of, np.arange(texts)) for of in found.of]
            for side, name in ((0, "a"), (1, "b")):
                drove = np.flatnonzero(found.first[side] >= 0)
                text = found.of[side][drove]
                place = [drove - begins[side][text], *(x[side][drove] - begins[1 - side][text] for x in (found.first, found.last))]
                sides.append((text, [name] * text.size, *place))
            text, name, *place = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.argsort(text, kind="stable")
            values = [pa.array(name[order].tolist(), pa.string()), *[pa.array(x[order].astype(np.int32)) for x in place]]
            columns.append(_lists(text[order], texts, pa.StructArray.from_arrays(values, fields=list(overlap))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers(byte_path, piece_path)
        for batch in batches:
            start, signs, read = 0, 0, []
            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                read.append(known.read(text))
                signs += len(text or "")
                if signs >= _CHUNK or at + 1 == batch.num_rows:
                    yield told(batch.slice(start, len(read)), read, known)
                    start, signs, read = at + 1, 0, []

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "links", *(["overlaps"] if overlaps else [])]
    schema = (
        f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "links array<struct<a:int,b:int,times:long>>"
    )
    return rows.mapInArrow(run, schema + (", overlaps array<struct<side:string,token:int,first:int,last:int>>" if overlaps else ""))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links): how many links of the whole corpus hold the id pair.

    Of two tokens that end together the shorter is a suffix of the longer, so there are no more pairs
    than suffixes of all entries of both vocabularies: some 600,000 for vocabularies of 50,000 and
    32,000 ids, whatever the corpus.
    """
    return aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("times").alias("links"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best``, its links whose pair has its B id's highest count (ties included), and
    ``count_sum``, the counts of its links added up; 0 without links. ``counts`` is ``link_counts``' table
    and is sent to all tasks: 24 bytes a pair, bounded by the vocabularies as told there."""
    table = counts.select("a", "b", "links").toArrow()
    a, b, links = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "links"))
    width = int(b.max(initial=0)) + 1
    order = np.argsort(a * width + b)
    best = np.zeros(width, dtype=np.int64)
    np.maximum.at(best, b, links)
    shared = aligned.sparkSession.sparkContext.broadcast(((a * width + b)[order], links[order], (links == best[b])[order]))
    names = aligned.columns
    at = names.index("links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, highest = shared.value
        for batch in batches:
            column = batch.column(at)
            flat = column.flatten()
            a, b, times = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            place = np.searchsorted(keys, a * width + b)
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            sums = []
            for value in (np.where(highest[place], times, 0), times * numbers[place]):
                total = np.zeros(len(column), dtype=np.int64)
                np.add.at(total, row, value)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields)
    return aligned.mapInArrow(run, f"{schema}, n_best long, count_sum long")
