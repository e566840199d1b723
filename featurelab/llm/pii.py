"""Personal data in whole texts: exact patterns, and a linear-chain CRF for what they leave out.

The patterns find e-mail and IP addresses, card and phone numbers. The CRF labels white-space tokens
by their shape and that of the tokens before and after; its spans are added where no pattern span lies and the kind's own check holds, so it
can find a phone number without a country code but never takes a pattern span away. It is trained
from a small labelled table, on the driver, and decoded by Viterbi for many stretches at a time.

Decoded are the tokens that hold a digit, an ``@`` or a ``+``, the words beside them, and separators
that stand alone (as in ``212 - 555 - 0148``) with the words beside these, as far as they go. Every
other token is outside any span by constraint: most tokens of a text are never decoded. It so falls
into stretches between which nothing is passed on, and decoding them is decoding the text under this
constraint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Labelled rows the CRF may be trained on.
MAX_LABELLED = 10_000

Span = tuple[str, int, int]

_CANDIDATE = re.compile(r"[0-9@+]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_SEPARATOR = re.compile(r"[-./()]+")
# An e-mail address whose parts stand apart, without the white space.
_APART = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is what reaches it, so that long runs
    of letters are not tried from every start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    if not _CANDIDATE.search(text):
        return []
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# Labels: outside, and first and further token of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
# Sizes of the buckets a token's shape is described by; see ``_shape``.
_SIZES = (8, 2, 4, 2, 2, 4, 3, 2, 2, 2, 3)


def _sort(token: str) -> int:
    return 0 if _CANDIDATE.search(token) else 1 if _SEPARATOR.fullmatch(token) else 2


def _shape(token: str) -> tuple[int, ...]:
    """Buckets: digits, @, dots, leading plus, brackets, dashes, letters, other signs, all digits, leading zero, sort (0: digit, @ or +; 1: separators only; 2: word)."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    other = sum(not (c.isalnum() or c in "@.+()-") for c in token.rstrip(".,;:!?"))
    core = token.rstrip(".,;:!?")
    steps = (0, 1, 2, 3, 4, 6, 9, 13)
    return (
        sum(digits >= s for s in steps) - 1, int("@" in core), min(core.count("."), 3), int(token[0] == "+"),
        int("(" in core or ")" in core), min(core.count("-"), 3), (letters > 0) + (letters > 3),
        int(other > 0), int(core.isascii() and core.isdigit()), int(token[0] == "0"),
        _sort(token),
    )


_short_shape = lru_cache(1 << 16)(_shape)


_STARTS = np.cumsum((0, *_SIZES[:-1]))
_OWN = sum(_SIZES)
_FEATURES = 3 * _OWN + 2  # own, before and after; and whether the stretch goes on to the left and to the right


def _features(tokens: list[str]) -> np.ndarray:
    """Indices of the active features of each token of a stretch."""
    own = np.array([_short_shape(t) if len(t) <= 64 else _shape(t) for t in tokens], dtype=np.int16) + _STARTS.astype(np.int16)
    rows = np.full((len(tokens), 3 * len(_SIZES) + 2), _FEATURES, dtype=np.int16)
    n = len(_SIZES)
    rows[:, :n] = own
    rows[1:, n : 2 * n] = own[:-1] + _OWN
    rows[:-1, 2 * n : 3 * n] = own[1:] + 2 * _OWN
    rows[1:, 3 * n] = _FEATURES - 2
    rows[:-1, 3 * n + 1] = _FEATURES - 1
    return rows


def _stretches(text: str) -> Iterator[list[tuple[str, int]]]:
    """Runs of neighbouring tokens that are decoded, with their places: tokens with a digit, an @ or a +;
    separators beside a decoded token; words beside a token with such a sign or beside a decoded separator."""
    tokens = [(m[0], m.start()) for m in _TOKEN.finditer(text)]
    pull = [2 - _sort(t) for t, _ in tokens]
    inside = [p == 2 for p in pull]
    for order in (range(len(tokens)), range(len(tokens) - 1, -1, -1)):
        beside = -1  # the pull of the token before, if it is decoded
        for i in order:
            if not inside[i] and (beside > 0 or beside == 0 and pull[i]):
                inside[i] = True
            beside = pull[i] if inside[i] else -1
    run: list[tuple[str, int]] = []
    for token, decoded in zip(tokens, inside, strict=True):
        if decoded:
            run.append(token)
        elif run:
            yield run
            run = []
    if run:
        yield run


@dataclass(frozen=True)
class Crf:
    """Weights by feature and label, and by pair of labels; row 0 of ``moves`` also starts a stretch."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        padded = np.vstack([self.weights, np.zeros((1, len(LABELS)))])
        out = np.zeros((len(features), len(LABELS)))
        for column in features.T:
            out += padded[column]
        return out


def _allowed() -> np.ndarray:
    """A further token follows a token of its kind only."""
    moves = np.zeros((len(LABELS), len(LABELS)))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            moves[[i for i, other in enumerate(LABELS) if other[2:] != label[2:]], j] = -1e9
    return moves


def _allowed_words() -> np.ndarray:
    """A word is outside or part of an e-mail address."""
    weights = np.zeros((_FEATURES + 1, len(LABELS)))
    weights[_OWN - 1, [j for j, label in enumerate(LABELS) if label[2:] not in ("", "email")]] = -1e9
    return weights


def _gold(run: list[tuple[str, int]], spans: list[Span]) -> list[int]:
    labels = []
    for token, at in run:
        inside = [s for s in spans if s[1] < at + len(token) and at < s[2]]
        if not inside:
            labels.append(0)
            continue
        kind, start, _ = inside[0]
        labels.append(LABELS.index(("B-" if at <= start < at + len(token) else "I-") + kind))
    return labels


def train_crf(rows: list[tuple[str, list[Span]]], steps: int = 300, rate: float = 0.1, penalty: float = 0.02) -> Crf:
    """Maximum penalized likelihood by Adam; the same rows give the same weights."""
    data = [
        (_features([t for t, _ in run]), np.array(_gold(run, spans))) for text, spans in rows for run in _stretches(text)
    ]
    size = len(LABELS)
    fixed, words = _allowed(), _allowed_words()
    params = [np.zeros((_FEATURES + 1, size)), np.zeros((size, size))]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        grads = [penalty * p for p in params]
        weights, moves = params[0] + words, params[1] + fixed
        for features, gold in data:
            emit = weights[features].sum(axis=1)
            n = len(gold)
            ahead, back = np.empty((n, size)), np.zeros((n, size))
            ahead[0] = moves[0] + emit[0]
            for t in range(1, n):
                ahead[t] = log_sum(ahead[t - 1][:, None] + moves, 0) + emit[t]
            for t in range(n - 2, -1, -1):
                back[t] = log_sum(moves + (emit[t + 1] + back[t + 1])[None, :], 1)
            whole = log_sum(ahead[-1], 0)
            chance = np.exp(ahead + back - whole)
            chance[np.arange(n), gold] -= 1
            np.add.at(grads[0], features, chance[:, None, :])
            grads[1][0] += chance[0]
            for t in range(1, n):
                both = np.exp(ahead[t - 1][:, None] + moves + (emit[t] + back[t])[None, :] - whole)
                both[gold[t - 1], gold[t]] -= 1
                grads[1] += both
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g / max(1, len(data))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf((params[0] + words)[:-1], params[1] + fixed)


def viterbi(crf: Crf, stretches: list[np.ndarray], cells: int = 1 << 18) -> list[np.ndarray]:
    """Best labels of each stretch (a feature matrix); stretches of like length are decoded together."""
    best: list[np.ndarray] = [np.zeros(0, int)] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
    while order:
        longest = len(stretches[order[-1]])
        take = max(1, cells // longest)
        batch, order = order[-take:], order[:-take]
        lengths = np.array([len(stretches[i]) for i in batch])
        emit = np.zeros((len(batch), longest, len(LABELS)))
        for row, i in enumerate(batch):
            emit[row, : lengths[row]] = crf.scores(stretches[i])
        score = crf.moves[0] + emit[:, 0]
        came = np.zeros((longest, len(batch), len(LABELS)), dtype=np.int8)
        for t in range(1, longest):
            ways = score[:, :, None] + crf.moves[None]
            came[t] = ways.argmax(axis=1)
            on = (lengths > t)[:, None]
            score = np.where(on, ways.max(axis=1) + emit[:, t], score)
        label = score.argmax(axis=1)
        paths = np.zeros((len(batch), longest), dtype=int)
        for t in range(longest - 1, -1, -1):
            on = lengths > t
            paths[on, t] = label[on]
            label = np.where(on, came[t, np.arange(len(batch)), label], label)
        for row, i in enumerate(batch):
            best[i] = paths[row, : lengths[row]]
    return best


def _passes(kind: str, text: str) -> bool:
    """The kind's check, without separators and white space that stand apart."""
    tokens = text.split()
    if kind == "email":
        if len(tokens) > 1:
            return _APART.fullmatch(re.sub(r"\s*@\s*|\s+\.\s+", lambda m: m[0].strip(), text)) is not None
        return 0 < text.find("@") < len(text) - 1 and text.count("@") == 1
    text = re.sub(r"\s+\.\s+", ".", text) if kind == "ip" else text
    if kind == "ip":
        return text.count(".") == 3 and all(p.isascii() and p.isdigit() for p in text.split(".")) and _is_ip(text)
    if not all(_SEPARATOR.fullmatch(t) or _digits(t) for t in tokens):  # a word
        return False
    if kind == "card":
        return _is_card(text)
    return 9 <= len(_digits(text)) <= 15 and all(c in "0123456789 ()+./-" for c in text)


def spans_of(texts: list[str], crf: Crf | None) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, added by the CRF) of each text, by kind and start; code points, ends exclusive."""
    out: list[list[tuple[str, int, int, bool]]] = []
    runs: list[tuple[int, list[tuple[str, int]]]] = []
    for i, text in enumerate(texts):
        out.append([(*s, False) for s in base_spans(text)])
        if crf is not None and _CANDIDATE.search(text):
            runs += [(i, run) for run in _stretches(text)]
    labels = viterbi(crf, [_features([t for t, _ in run]) for _, run in runs]) if runs else []
    for (i, run), path in zip(runs, labels, strict=True):
        at = 0
        while at < len(path):
            if path[at] == 0:
                at += 1
                continue
            end = at + 1
            kind = LABELS[path[at]][2:]
            while end < len(path) and LABELS[path[end]] == f"I-{kind}":
                end += 1
            start, stop = run[at][1], run[end - 1][1] + len(run[end - 1][0])
            found = texts[i][start:stop]
            core = found.rstrip(".,;:!?\"'>]}").lstrip("\"'<[{")
            if core.endswith(")") and "(" not in core:
                core = core[:-1]
            start += found.find(core)
            stop = start + len(core)
            if _passes(kind, core) and not any(a < stop and start < b for _, a, b, _ in out[i]):
                out[i].append((kind, start, stop, True))
            at = end
    return [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1])) for s in out]


def labelled_rows(marked: list[str]) -> list[tuple[str, list[Span]]]:
    """Texts and spans of lines in which spans are marked as ``[kind:text]``."""
    rows = []
    for line in marked:
        text, spans, last = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone):([^\]]*)\]", line):
            text += line[last : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            last = m.end()
        rows.append((text + line[last:], spans))
    return rows


def train(labelled: DataFrame, text_col: str = "text", spans_col: str = "spans") -> Crf:
    """A CRF from a table of texts and spans (array of kind, start, end); at most ``MAX_LABELLED`` rows (ValueError)."""
    rows = labelled.select(text_col, spans_col).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows")
    clean = [(r[0] or "", [(s[0], s[1], s[2]) for s in r[1] or []]) for r in rows]
    return train_crf(sorted(clean))


_SPAN = "array<struct<kind:string,start:int,end:int,added:boolean>>"


def find_spans(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): personal data of each whole text, one row per document.

    A NULL text is an empty one. NULL ids and repeated rows stay. Other columns are not read. An empty
    table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of([t or "" for t in batch.column(1).to_pylist()], crf)
            told = [[dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, kind)], [id_col, "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, spans {_SPAN}")


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each span, or stretch of overlapping ones, replaced by its first kind, as in ``<EMAIL>``."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, crf: Crf | None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data masked, all columns kept; ``length_col``, if there, follows the new text.

    A NULL text stays NULL. Every one of repeated rows is masked; an empty table gives an empty one. Columns
    may have any names: they go through the tasks by place.
    """
    names = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    size = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = spans_of([t or "" for t in texts], crf)
            new = [t if t is None or not s else masked(t, s) for t, s in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if size is not None:
                old = columns[size].to_pylist()
                told = [len(n) if s else o for n, s, o in zip(new, found, old, strict=True)]
                columns[size] = pa.array(told, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return placed.mapInArrow(run, placed.schema).toDF(*names)
