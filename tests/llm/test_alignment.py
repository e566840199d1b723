"""Cross-tokenizer alignment against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from featurelab.llm import align, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, n_a string, links int, groups double"
TEXTS = [
    "The quick brown fox", "naïve café – 12,345 <|endoftext|> </s> end", "", None, "x", "  two  blanks ", "\n\n\ttab", "▁under", "日本語のテキスト😀",
    "The quick brown fox", "<0x41> <s> [INST]", "a\x00b", "word " * 3_000, "y" * 40_000, " " * 30_000 + "z", "é‍﻿", "ﬁ ½ Ａ",
]


def _paths():
    return queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    tokenizer, pieces = Tokenizer.from_file(_paths()[0]), SentencePieceProcessor(model_file=_paths()[1])
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = dict(zip((chr(b) for b in shown), shown, strict=True))
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def read(text):
        """[(id, end)] of both, or none."""
        if not text:
            return [], []
        a = [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
            return [], []
        return tuple(list(zip((i for i, _ in side), np.cumsum([len(t) for _, t in side]).tolist(), strict=True)) for side in (a, b))

    return read


def _told(a, b):
    """(groups, links) by a walk over both lists."""
    groups, links, i, j = [], [], 0, 0
    ends = {e for _, e in a} & {e for _, e in b}
    for end in sorted(ends):
        left, right = [], []
        while i < len(a) and a[i][1] <= end:
            left.append(a[i][0])
            i += 1
        while j < len(b) and b[j][1] <= end:
            right.append(b[j][0])
            j += 1
        groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        links.append((left[-1], right[-1]))
    return ";".join(groups), links


def test_alignment(spark, plain):
    rows = [(i if i != 3 else None, t, "clash", 1, 0.5) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash", 1, 0.5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    aligned = align.align_tokens(docs, *_paths(), overlaps=True)
    got = align.with_counts(aligned, align.link_counts(aligned)).collect()
    expected = [(r[0], *plain(r[1])) for r in rows]
    told = [(i, a, b, *_told(a, b)) for i, a, b in expected]
    counts = Counter(link for row in told for link in row[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    assert len(got) == len(rows) and any(not row[1] for row in told if row[0] == 7)
    by_id = sorted(told, key=lambda r: (str(r[0]), r[3]))
    for r, (i, a, b, groups, links) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["groups"])), by_id, strict=True):
        assert (r["doc_id"], r["n_a"], r["n_b"], r["groups"], r["n_groups"], r["n_links"]) == (i, len(a), len(b), groups, len(links), len(links))
        assert Counter({(x["a"], x["b"]): x["times"] for x in r["links"]}) == Counter(links)
        assert r["n_best"] == sum(counts[x] == best[x[1]] for x in links) and r["count_sum"] == sum(counts[x] for x in links)
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        spans = [(x["token"], x["first"], x["last"]) for x in r["overlaps"]]
        begins = [0, *[e for _, e in long]]
        start = 0
        for k, (_, end) in enumerate(short[:300]):
            touched = [n for n in range(len(long)) if begins[n] < end and long[n][1] > start] if len(long) < 400 else None
            assert touched is None or spans[k] == (k, touched[0], touched[-1])
            start = end
        assert len(spans) == len(short) and {x["side"] for x in r["overlaps"]} <= {"a" if len(a) <= len(b) else "b"}
    assert align.align_tokens(docs.limit(0), *_paths()).count() == 0
    none = align.align_tokens(docs.where("text is null"), *_paths())
    assert align.with_counts(none, align.link_counts(none)).select("n_best", "count_sum").collect()[0] == (0, 0)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400), max_size=60))
def test_gallop(long, short):
    long, short = (np.array(sorted(x), dtype=np.int64) for x in (long, short))
    assert align.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_query_digest(spark, plain, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_token_alignment(spark, str(tmp_path)).collect():
        groups = _told(*plain(TEXTS[r["doc_id"]]))[0]
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert [f.dataType.simpleString() for f in queries.op11_token_alignment(spark, str(tmp_path)).schema] == ["bigint"] * 7 + ["string"]
