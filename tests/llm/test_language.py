"""Language prediction against plain counting, and on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from featurelab.llm import language, queries
from featurelab.sources.tables import read_table

SCHEMA = "doc_id long, text string, lang string, source string, score double, bucket int"
FOLDER = "/root/testdata/sf0.01"


def _bucket(gram, bits):
    value, mask = len(gram), (1 << 64) - 1
    for sign in gram:
        value = (value + ord(sign)) * 0x9E3779B97F4A7C15 & mask
        value ^= value >> 32
    return (value * 0xD6E8FEB86659FD93 & mask) >> (64 - bits)


def _grams(text, sizes, bits):
    clean = " "
    for sign in f" {text.lower()} ":
        if sign.isalpha():
            clean += sign
        elif clean[-1] != " ":
            clean += " "
    return Counter(
        _bucket(clean[i : i + n], bits) for n in sizes for i in range(len(clean) - n + 1) if any(c.isalpha() for c in clean[i : i + n])
    )


ROWS = [
    (1, "The cat sat on the mat", "en", "s", 0.0, 1), (4, "der Hund und die Katze", "de", "s", 0.0, 1), (5, "the dog and the cat", "en", None, 0.0, 1),
    (8, "die Straße ÄÖÜ 12", "de", "s", 0.0, 1), (9, None, "de", "s", 0.0, 1), (10, "", "en", "s", 0.0, 1), (11, "12 - 34 !?", "en", "s", 0.0, 1),
    (12, "the the the", None, "s", 0.0, 1), (None, "Katze und Hund", "de", "s", 0.0, 1), (5, "the dog and the cat", "en", None, 0.0, 1),
    (13, "long text of the cat " * 9_000, "en", "s", 0.0, 1), (14, "x" * 30_000, "de", "s", 0.0, 1), (15, "İSTANBUL ΣΑΣ 日本語", "xx", "s", 0.0, 1),
]


def test_counts_and_scores(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    sizes, bits, smooth = (1, 2, 3), 10, 0.5
    model = language.fit(docs, sizes=sizes, bits=bits, smoothing=smooth)
    known = [r for r in ROWS if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = sorted({r[2] for r in known})
    assert model.languages == langs and len(known) < len(ROWS) - 3
    counts = {lang: sum((_grams(r[1], sizes, bits) for r in known if r[2] == lang), Counter()) for lang in langs}
    rows = {}
    for lang in langs:
        total = sum(counts[lang].values()) + smooth * (1 << bits)
        rows[lang] = [math.log((counts[lang][b] + smooth) / total) for b in range(1 << bits)]
        assert np.allclose(model.matrix[langs.index(lang)], rows[lang])
    shares = {lang: math.log(sum(r[2] == lang for r in known) / len(known)) for lang in langs}
    got = sorted(language.predict(docs, model).collect(), key=lambda r: (str(r["doc_id"]), r["lang_pred"]))
    assert len(got) == len(ROWS)
    for r, row in zip(got, sorted(ROWS, key=lambda r: str(r[0])), strict=True):
        text = row[1] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = [shares[lang] + sum(n * rows[lang][b] for b, n in _grams(text, sizes, bits).items()) for lang in langs]
        assert r["lang_pred"] == langs[int(np.argmax(sums))]
        assert np.isclose(r["score"], 1 / sum(math.exp(s - max(sums)) for s in sums))


def test_nothing_learned_and_bounds(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert language.fit(docs.where("lang is null")) is None
    none = language.predict(docs, None).collect()
    assert len(none) == len(ROWS) and {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language.predict(docs.limit(0), language.fit(docs)).count() == 0
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.fit(docs)


def test_blocks_change_nothing(monkeypatch):
    texts = [r[1] or "" for r in ROWS]
    codes, of = language.signs(texts)
    whole = [Counter(zip(*(x.tolist() for x in part), strict=True)) for part in language.buckets(codes, of, (2,), 12)]
    monkeypatch.setattr(language, "_CHUNK", 77)
    parts = [Counter(zip(*(x.tolist() for x in part), strict=True)) for part in language.buckets(codes, of, (2,), 12)]
    assert len(parts) > 100 and sum(parts, Counter()) == sum(whole, Counter())


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op12_language(spark, FOLDER).collect()}
    docs = [r for r in read_table(spark, FOLDER, "documents").select("doc_id", "text", "lang").collect() if r["text"] and r["lang"]]
    held = [r for r in docs if got[r["doc_id"]]["held_out"] and len(r["text"]) > 50]
    assert len(held) > 150 and all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())
