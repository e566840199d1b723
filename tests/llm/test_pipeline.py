"""The stages of the corpus pipeline on a small table with odd rows."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_text_operators import _fingerprint, _plain_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(500)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words, int(rng.integers(15, 120))))
        rows.append((i, [text, text.upper().replace(" ", "!! "), f"{text} a{i}@b{i}.example.com", text][i % 4], "en", f"s{i % 3}"))
    rows += [(300, rows[0][1], "en", "s0"), (301, rows[0][1], None, None), (301, rows[0][1], "en", "s0"), (400, None, None, None), (401, "", "en", "s1")]
    rows += [(3, rows[3][1], "en", "s0")]
    told = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(told, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 1), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    good, single, clean, mixed, packed = ([tuple(r) for r in t.collect()] for t in tables[1:])
    assert {r[0] for r in good} >= {i for i in range(240) if i % 4 != 1} and not {r[0] for r in good} & set(range(1, 240, 4))
    assert Counter(r[0] for r in single).most_common(1)[0][1] == 1 and {r[0] for r in single} <= {r[0] for r in good}
    prints = [_fingerprint(r[1]) for r in single]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    every = [(r[0], _fingerprint(r[1])) for r in good]
    assert all(any((f ^ g).bit_count() <= 2 for g in prints) or any((f ^ g).bit_count() <= 2 for _, g in every if g != f) for _, f in every)
    assert Counter(r[0] for r in clean) == Counter(r[0] for r in single)
    assert all(r[1] is None or not _plain_spans(r[1]) for r in clean) and any("<EMAIL>" in (r[1] or "") for r in clean)
    assert all(r[1] is None or r[4] == len(r[1]) for r in clean)
    copies = Counter(r[0] for r in mixed)
    words = {r[0]: len(re.findall(r"\S+", r[1] or "")) for r in clean}
    assert set(copies) <= set(words) and max(copies.values()) <= 2
    assert abs(sum(words[i] * n for i, n in copies.items()) - 1.5 * sum(words.values())) <= 4 * max(words.values())
    assert Counter(r[0] for r in packed if r[1] == 0) == copies
    assert len({zlib.crc32(str(r).encode()) for r in packed}) > 1


def test_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_same_id_and_clashing_names(spark, folder):
    words = [f"word{k}" for k in range(300)]
    rng = np.random.default_rng(5)
    one, two, three = (" ".join(rng.choice(words, 80)) for _ in range(3))
    rows = [(7, one, "en", "s", 1, "a", 1, 2, 0.5), (7, two, "en", "s", 1, "b", 1, 2, 0.5), (8, three, "en", "s", 1, "c", 1, 2, 0.5)]
    rows += [(9, two, "en", "s", 1, "d", 1, 2, 0.5), (None, one.upper(), "en", "s", 1, "e", 1, 2, 0.5), (8, three, "en", "s", 1, "c", 1, 2, 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, _rows int, key int, _score double"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and got.schema == docs.schema, name
        assert all(r["_score"] == 0.5 and r["key"] == 2 and r["_rows"] == 1 for r in got.collect())
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, folder).collect()]
    assert len(kept) == 3 and {r[1].lower() for r in kept} == {one, two, three}


def test_long_blanks(spark):
    from featurelab.llm import packing, queries
    from tokenizers import Tokenizer

    texts = [" " * 1_200_000 + "word", "\n" * 1_200_000 + "word", "a" + " \t" * 6_000 + "b"]
    reader, plain = packing.IdReader(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for text in texts:
        assert reader.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
