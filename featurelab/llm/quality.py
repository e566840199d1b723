"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, and only the document has a label. Every passage is encoded from
statistics of its signs and words; gated attention weighs the passages; the weighted mean of their
encodings is scored. Encoder, attention and scorer are learned together from document labels.

Statistics are counted on the raw bytes of many texts at a time, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a passage.
PASSAGE = 64
# Labelled documents of each class that the model is fitted on, at most.
FIT_PER_CLASS = 4_000
# Bytes of text whose statistics are counted at a time.
_CHUNK = 4 << 20

_GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()", b"!", b"|", b"#$%&*+<=>@[\\]^_`{}~/",
    bytes(range(128, 256)), b"\n",
)
_GROUP = np.zeros((len(_GROUPS), 256), dtype=np.int32)
for _k, _signs in enumerate(_GROUPS):
    _GROUP[_k, list(_signs)] = 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
# Words are told apart by a sum of numbers drawn for their signs.
_DRAWN = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.int64)
_DRAWN[_SPACE] = 0
FEATURES = len(_GROUPS) + 6


def _count(data: np.ndarray, offsets: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, document of every passage) for texts ``data[offsets[i]:offsets[i+1]]``."""
    documents = offsets.size - 1
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = ~space[firsts]
    words = np.flatnonzero(begins)
    if not words.size:
        return np.zeros((documents, FEATURES)), np.arange(documents)
    doc = np.searchsorted(offsets, words, "right") - 1
    of_doc = np.bincount(doc, minlength=documents)
    nth = np.arange(words.size) - (np.cumsum(of_doc) - of_doc)[doc]
    heads = np.flatnonzero(nth % passage == 0)  # first word of each passage
    per = np.diff(np.append(heads, words.size))  # words of each passage
    # Ends of texts cut the sums too, so that nothing of the next text is counted.
    cuts = np.union1d(words[heads], offsets[1:][offsets[1:] < data.size])
    own = np.searchsorted(cuts, words[heads])
    sums = np.column_stack([np.add.reduceat(_GROUP[k][data], cuts)[own] for k in range(len(_GROUPS))]).astype(float)
    signs = np.add.reduceat((~space).astype(np.int32), cuts)[own].astype(float)
    word_cuts = np.union1d(words, offsets[1:][offsets[1:] < data.size])
    key = np.add.reduceat(_DRAWN[data], word_cuts)[np.searchsorted(word_cuts, words)]
    again = [np.zeros(words.size), np.zeros(words.size)]
    for step in (1, 2):
        again[step - 1][step:] = (key[step:] == key[:-step]) & (nth[step:] >= step)
    of_word = np.repeat(np.arange(heads.size), per)
    order = np.lexsort((key, of_word))
    new = np.ones(words.size, dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][new], minlength=heads.size)
    full = np.maximum(signs, 1)
    share = sums / full[:, None]
    rest = [
        signs / per / 10, np.log(per), distinct / per,
        np.add.reduceat(again[0], heads) / per, np.add.reduceat(again[1], heads) / per, np.ones(heads.size),
    ]
    features, of = np.column_stack([np.sqrt(share), *rest]), doc[heads]
    empty = np.flatnonzero(of_doc == 0)  # a text without words is one passage of zeros
    features = np.vstack([features, np.zeros((empty.size, FEATURES))])
    of = np.concatenate([of, empty])
    order = np.argsort(of, kind="stable")
    return features[order], of[order]


def passage_features(column: pa.Array, passage: int = PASSAGE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, features, document within these) over a column of texts, some at a time."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        part = offsets[first : last + 1]
        features, of = _count(data[part[0] : part[-1]], part - part[0], passage)
        yield first, features, of
        first = last


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class AttentionModel:
    """Encoder (W, b), gated attention (V, U, w) and scorer (c, d), on standardized statistics."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def _forward(self, features: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        W, b, V, U, w, c, d = self.weights
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ W + b)
        t, g = np.tanh(h @ V), _sigmoid(h @ U)
        logit = (t * g) @ w
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        top = np.repeat(np.maximum.reduceat(logit, heads), np.diff(np.append(heads, of.size)))
        weight = np.exp(logit - top)
        attention = weight / np.repeat(np.add.reduceat(weight, heads), np.diff(np.append(heads, of.size)))
        bag = np.add.reduceat(attention[:, None] * h, heads)
        return x, h, t, g, attention, heads, bag, _sigmoid(bag @ c + d)

    def scores(self, features: np.ndarray, of: np.ndarray) -> np.ndarray:
        """One score per document; ``of`` is sorted and every document has a passage."""
        return self._forward(features, of)[-1]


def fit_attention(
    features: np.ndarray, of: np.ndarray, labels: np.ndarray, prior: float, hidden: int = 16, epochs: int = 40, batch: int = 256,
    rate: float = 0.01, penalty: float = 1e-4, seed: int = 42,
) -> AttentionModel:
    """Adam on the log loss. ``of`` is sorted from 0; ``prior`` is the share of label 1 that scores are
    calibrated to, whatever the share among the documents fitted on."""
    draws = np.random.default_rng(seed)
    size = features.shape[1]
    scale = features.std(axis=0)
    shapes = ((size, hidden), (hidden,), (hidden, hidden), (hidden, hidden), (hidden,), (hidden,), ())
    params = [draws.normal(0, 1 / np.sqrt(s[0]), s) if s else np.zeros(()) for s in shapes]
    params[1][:] = 0
    model = AttentionModel(features.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), tuple(params))
    ones = max(labels.mean(), 1e-9)
    cost = np.where(labels == 1, prior / ones, (1 - prior) / max(1 - ones, 1e-9))
    starts = np.searchsorted(of, np.arange(labels.size + 1))
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(draws.permutation(labels.size), max(1, labels.size // batch)):
            step += 1
            chosen = np.sort(chosen)
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen])
            x, h, t, g, a, heads, bag, score = model._forward(features[rows], np.repeat(np.arange(chosen.size), starts[chosen + 1] - starts[chosen]))
            W, b, V, U, w, c, d = params
            per = np.diff(np.append(heads, rows.size))
            out = cost[chosen] * (score - labels[chosen]) / chosen.size
            to_bag = np.repeat(out[:, None] * c, per, axis=0)
            pull = (to_bag * h).sum(axis=1)
            to_logit = a * (pull - np.repeat(np.add.reduceat(a * pull, heads), per))
            to_t, to_g = to_logit[:, None] * w * g * (1 - t * t), to_logit[:, None] * w * t * g * (1 - g)
            to_h = (a[:, None] * to_bag + to_t @ V.T + to_g @ U.T) * (1 - h * h)
            grads = [x.T @ to_h, to_h.sum(axis=0), h.T @ to_t, h.T @ to_g, (t * g).T @ to_logit, bag.T @ out, out.sum()]
            for k, (p, grad) in enumerate(zip(params, grads, strict=True)):
                grad = grad + penalty * p
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                p -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = FIT_PER_CLASS, passage: int = PASSAGE, seed: int = 42,
) -> AttentionModel | None:
    """Fit on at most ``per_class`` labelled documents of each class, drawn by a hash of their id.

    Held-out ids, NULL ids and labels other than 0 and 1 are left out. Scores are calibrated to the
    share of label 1 among all labelled rows that are not held out. None if a class has no document.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    drawn = [known.where(F.col("label") == k).orderBy(order, "id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class narrow rows: small enough to be sent to every task.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "label", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, features, of in passage_features(batch.column(2), passage):
                heads = np.searchsorted(of, np.arange(of[-1] + 2))
                flat = [features[a:b].ravel().tolist() for a, b in zip(heads[:-1], heads[1:], strict=True)]
                part = batch.slice(start, len(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(flat, pa.list_(pa.float64()))], ["id", "label", "features"]
                )

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(encode, f"id {kind}, label int, features array<double>").toArrow()
    if not rows.num_rows or len(set(rows.column("label").to_pylist())) < 2:
        return None
    table = rows.sort_by([("id", "ascending"), ("label", "ascending")])
    bags = [np.asarray(f).reshape(-1, FEATURES) for f in table.column("features").to_pylist()]
    of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit_attention(np.vstack(bags), of, table.column("label").to_numpy().astype(float), counts[1] / sum(counts.values()), seed=seed)


def score(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", out: str = "score", passage: int = PASSAGE) -> DataFrame:
    """``docs`` with all columns and ``out``, a double from 0 to 1: how likely label 1 is.

    A NULL or empty text is one passage without words. Without a model every score is 1: nothing is
    known against a document. A column called ``out`` is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()])
    names = docs.columns
    if model is None:
        return docs.withColumn(out, F.lit(1.0))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(features, of) for _, features, of in passage_features(batch.column(at), passage)]
            values = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
