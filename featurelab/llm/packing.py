"""Best-fit packing of documents into sequences by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So Spark tokenizes,
cuts and counts; the search works on the table of (length, count), which has at most ``capacity``
rows whatever the corpus; and its answer, a list of fillings with multiplicities, is dealt back to
the pieces by their number within their length. No piece passes through the driver.

The search is bin completion: the longest length left is filled up with an undominated set of
shorter ones, as often as the counts allow, with branches over fewer repetitions and over all other
such sets. Waste is bounded by the best known answer: a branch that has wasted more than that answer
could spare is cut. The first answer is best fit decreasing. The lower bound on the number of
sequences ends the search, or the number of its steps.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.llm.common import number_within
from featurelab.sources.work import materialize

# Steps of the search before the best answer so far is taken.
MAX_STEPS = 3_000
# Places of a walk over the fillings of one longest length that count as a step.
WALK = 1_000
# White space in a row that is left to ``tokenizers``: ``tiktoken`` ends the process on some million.
LONG_BLANK = 10_000
# Fixed value: how byte-level tokenizers cut a text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)


class IdReader:
    """Token ids of a whole text as little-endian 32-bit numbers.

    If the merges of the file are ranked by id, ``tiktoken`` reads that same file and encodes in a
    quarter of the time; the ids are the same. Texts that hold a special token's string or
    ``LONG_BLANK`` white-space signs in a row, and any text of another kind of file, go to
    ``tokenizers``. With ``plain`` the strings of special tokens are text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(path)

    def __call__(self, text: str) -> bytes:
        return self.ids(text).astype("<u4", copy=False).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special) or (len(text) >= LONG_BLANK and _BLANKS.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.ranked(text, disallowed_special=())


def _ranked(path: str):
    """The encoder of ``tiktoken`` for a byte-level file whose merges are ranked by id, else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
    steps = spec.get("pre_tokenizer") or {}
    joined = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
    if steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or spec.get("normalizer") or joined != sorted(joined):
        return None
    import tiktoken

    # The public byte-level alphabet: printable signs stand for themselves, the others for 256 and on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("words", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, CRC-32 of the ids) of each piece; all but the first have ``capacity`` ids."""
    total = len(ids) // 4
    start, end = 0, total % capacity or min(total, capacity)
    while start < total:
        yield start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start, end = end, end + capacity


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) plus where the row was made: ``part`` and ``nth``, its
    0-based number among the pieces of its length in that part. To be written before use."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = IdReader(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            at: list[int] = []
            found: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                for k, (start, length, crc) in enumerate(cut(reader(text.as_py() or "") + end, capacity)):
                    at.append(i)
                    found.append((k, start, length, crc, seen[length]))
                    seen[length] += 1
            table = np.array(found, dtype=np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(table[:, 0].astype(np.int32))]
            columns += [pa.array(table[:, k].copy()) for k in (1, 2, 3)]
            columns += [pa.array(np.full(len(at), part, np.int32)), pa.array(table[:, 4].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return rows.mapInArrow(run, schema)


Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by total length, and by the lengths of which no two fit together."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in [0, *sorted(n for n in counts if n <= capacity // 2)]:
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        half = {n: c for n, c in counts.items() if capacity // 2 < n <= capacity - k}
        room = sum((capacity - n) * c for n, c in half.items())
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        best = max(best, alone + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing on counts: equal lengths go together into equally filled sequences."""
    free: dict[int, list[tuple[Filling, int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in free:
            free[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        free[room].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    put(capacity - per * length, ((length, per),), whole)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            filling, times = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
            per = min(room // length, left)  # best fit keeps on filling the fullest that still has room
            use = min(times, left // per)
            if times > use:
                put(room, filling, times - use)
            put(room - per * length, (*filling, (length, per)), use)
            left -= per * use
    return [x for room in rooms for x in free[room]]


def _reach(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Which sums up to ``room`` can be made from each place of the list on, as bits."""
    full = (1 << (room + 1)) - 1
    reach = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        bits, length = reach[i + 1], lengths[i]
        left, step = min(counts[length], room // length), 1
        while left > 0:  # counts by doubling
            step = min(step, left)
            bits |= (bits << (step * length)) & full
            left -= step
            step *= 2
        reach[i] = bits
    return reach


def fillings(
    lengths: list[int], counts: dict[int, int], room: int, allowed: int, after: tuple[int, Filling] | None = None
) -> Iterator[tuple[int, Filling] | None]:
    """Every (waste, filling) of undominated sets that leave at most ``allowed`` of ``room``, lazily.

    By waste; equal ones by their lengths, longest first and oftenest first. Only what comes after
    ``after`` in this order, which does not depend on the counts. A set is dominated, and left out, if
    one of its lengths can be replaced by a longer one still to be had, or another fits in as well.
    ``None`` stands for ``WALK`` places of the walk, so that whoever reads on can stop.
    """
    reach = _reach(lengths, counts, room)
    ascending = lengths[::-1]
    taken: dict[int, int] = {}
    walked = 0

    def walk(i: int, left: int, waste: int, big: int, reach: list[int], bar: Filling | None) -> Iterator[Filling | None]:
        # ``bar``: the rest of ``after``, while the walk has taken just what it starts with.
        nonlocal walked
        if not left:
            if bar is None:
                yield tuple(taken.items())
            return
        i = max(i, len(lengths) - bisect_right(ascending, left))
        if bar is not None:
            i = max(i, len(lengths) - bisect_right(ascending, bar[0][0]))
        while i < big and reach[i] >> left & 1:
            walked += 1
            if walked % WALK == 0:
                yield None
            length, on = lengths[i], i - 1
            while on >= 0 and lengths[on] <= length + waste and counts[lengths[on]] == taken.get(lengths[on], 0):
                on -= 1
            if on < 0 or lengths[on] > length + waste:  # no longer one to be had instead
                tight = bar is not None and bar[0][0] == length
                for k in range(min(counts[length], left // length, bar[0][1] if tight else left), 0, -1):
                    if reach[i + 1] >> (left - k * length) & 1:
                        taken[length] = k
                        yield from walk(i + 1, left - k * length, waste, big, reach, bar[1:] if tight and k == bar[0][1] else None)
                        del taken[length]
            bar, i = None, i + 1

    sums = reach[0] & ((1 << (room + 1 - after[0])) - 1) if after else reach[0]
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        waste = room - total
        if waste > allowed:
            return
        # What is no longer than the waste would fit in: such lengths are all taken, the others walked.
        big = len(lengths) - bisect_right(ascending, waste)
        small = tuple((n, counts[n]) for n in lengths[big:])
        left = total - sum(n * c for n, c in small)
        walked += 1
        if walked % WALK == 0:
            yield None
        ways = _reach(lengths[:big], counts, room) if small and left >= 0 else reach
        if left < 0 or not ways[0] >> left & 1:
            continue
        # A set that leaves the same waste has taken all small ones, so there are none if ``after`` bars here.
        for found in walk(0, left, waste, big, ways, after[1] if after and after[0] == waste else None):
            if found is None:
                yield None
            elif not small or _undominated([*found, *small], waste, ascending, counts):
                yield waste, found + small


def _undominated(chosen: list[tuple[int, int]], waste: int, ascending: list[int], counts: dict[int, int]) -> bool:
    taken = dict(chosen)
    for n in (0, *taken):  # 0: what fits in besides
        at = bisect_right(ascending, n)
        while at < len(ascending) and ascending[at] <= n + waste:
            if counts[ascending[at]] > taken.get(ascending[at], 0):
                return False
            at += 1
    return True


def complete_bins(counts: dict[int, int], capacity: int, max_steps: int = MAX_STEPS) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities that hold each length as often as ``counts`` says.

    Ends when the lower bound is met, the search is exhausted or ``max_steps`` steps are made, and
    returns the best answer found: never worse than best fit decreasing, and an optimum unless the
    steps ended the search.

    Of the optima, take the one whose sequences with the longest length are the fullest, by the fullest
    of them first, and so on for the next longest. Its fullest sequence with the longest length left is
    undominated, else an exchange would make it fuller. So it is enough to try every undominated filling
    with every multiplicity, those of one longest length in one order, each at one place of it.

    Memory: a frame holds one filling, at most 16 bytes a length in it and some 400 besides, so that
    ``max_steps`` frames take some 2 MB for fillings of 20 lengths. The tables of one walk, 2 bits a
    length and place of ``capacity``, exist for the last frame alone: below 4 MB for 2,048 lengths.
    """
    left = {n: c for n, c in counts.items() if c}
    answer = best_fit(left, capacity)
    used = sum(times for _, times in answer)
    bound = lower_bound(left, capacity)
    total = sum(n * c for n, c in left.items())
    # Depth first. What is left to place is one table, changed in place; a frame is only [longest length,
    # the filling that is tried (waste, what is besides the longest) or the last one barred, how often it
    # is placed]. The fillings to come are held for the last frame alone and sought anew, from the one
    # tried last on, when the search comes back to a frame.
    frames: list[list] = []
    to_come: Iterator[tuple[int, Filling] | None] | None = None
    sequences, waste, steps = 0, 0, 0

    def put(frame: list, times: int) -> None:
        nonlocal sequences, waste
        longest, (gap, extra), _ = frame
        for n, k in _whole(longest, extra):
            now = left.get(n, 0) - times * k
            if now:
                left[n] = now
            else:
                del left[n]
        frame[2] += times
        sequences, waste = sequences + times, waste + times * gap

    def spare() -> int:  # what a better answer may still waste
        return (used - 1) * capacity - total - waste

    while used > bound and steps < max_steps:
        steps += 1
        if not left and sequences < used:
            answer, used = [(_whole(longest, extra), times) for longest, (_, extra), times in frames], sequences
        elif left and spare() >= 0:
            longest = max(left)
            after = frames[-1][1] if frames and frames[-1][0] == longest else None
            frames.append([longest, after, 0])
            to_come = None
        while frames and steps < max_steps:
            frame = frames[-1]
            if frame[2]:
                put(frame, -1)
            if not frame[2]:
                if to_come is None:
                    to_come = _fillings_left(frame[0], left, capacity, spare(), frame[1])
                option = next(to_come, ())
                if option is None:  # a long walk
                    steps += 1
                    continue
                if not option or option[0] > spare():
                    frames.pop()
                    to_come = None
                    continue
                frame[1] = option
                put(frame, min(left[n] // k for n, k in _whole(frame[0], option[1])))
            if spare() >= 0:
                break
        if not frames:
            break
    return answer


def _fillings_left(
    longest: int, left: dict[int, int], capacity: int, allowed: int, after: tuple[int, Filling] | None
) -> Iterator[tuple[int, Filling] | None]:
    rest = dict(left)
    rest[longest] -= 1
    lengths = sorted((n for n, c in rest.items() if c and n <= capacity - longest), reverse=True)
    return fillings(lengths, rest, capacity - longest, allowed, after)


def _whole(longest: int, extra: Filling) -> Filling:
    if extra and extra[0][0] == longest:
        return ((longest, 1 + extra[0][1]), *extra[1:])
    return ((longest, 1), *extra)


def slots(answer: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: the ones numbered from ``first`` on, ``each`` to a sequence
    from ``sequence`` on, at ``offset``. Sorted by length and first number."""
    rows, given, sequence = [], {}, 0
    for filling, times in answer:
        offset = 0
        for length, each in filling:
            first = given.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            given[length] = first + each * times
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T.copy(), strict=True))


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    max_steps: int = MAX_STEPS,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Each document's ids, ``end_id`` last, are one piece if they fit into ``capacity``; longer ones
    are cut into pieces of ``capacity``, of which the first may be shorter. A sequence's pieces lie
    side by side from offset 0.

    A NULL or empty text has the end id alone. Rows with a NULL id and repeated rows are packed like
    any other. Other columns are not read. An empty table gives an empty one. ``max_steps`` bounds
    the search, not the data: all pieces are packed whatever it is.
    """
    found = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    place = slots(complete_bins(counts, capacity, max_steps))
    numbered = number_within(found, ["length"], "part", "nth")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = place["length"]
        for batch in batches:
            length, nth = (batch.column(k).to_numpy() for k in ("length", "nth"))
            slot = np.empty(length.size, dtype=np.int64)
            for n in np.unique(length):
                a, b = np.searchsorted(lengths, [n, n + 1])
                of = length == n
                slot[of] = a + np.searchsorted(place["first"][a:b], nth[of], "right") - 1
            over = nth - place["first"][slot]
            sequence = place["sequence"][slot] + over // place["each"][slot]
            offset = place["offset"][slot] + over % place["each"][slot] * length
            keep = [batch.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], out)

    out = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = found.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(deal, schema)
