"""Source divergence against plain loops on a small table with odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
from featurelab.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value int"


def _plain(rows, least, ranks):
    terms = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        for _, text, lang, source, *_ in rows
    ]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), {(lang, source) for lang, source, _ in terms}
    for lang, source, words in terms:
        held[lang].update(set(words))
        count[lang, source].update(words)
    out = []

    def share(n, total, size):
        return 1 + 1_000_000_000 * (n + 2) // (total + 2 * size)

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for lang in {lang for lang, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        whole = sum((count[lang, s] for s in sources), Counter())
        p = {}
        for s in [*sources, None]:
            of = whole if s is None else count[lang, s]
            total = sum(of[t] for t in kept)
            p[s] = {t: share(of[t], total, len(kept)) for t in kept}
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(term)[:ranks], 1)]
    return sorted(out)


def _rows():
    rng = np.random.default_rng(2)
    words = ["the", "The", "a", "naïve", "ÄÖ", "日本", "it's", "x1y", "zz", "\U00010348", "￮", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)), p=weights / weights.sum()))
        rows.append((i, text, ["en", "de", None, ""][i % 4] if i % 7 else "en", [f"s{i % 5}", None, "", "S"][int(rng.integers(0, 4))], 1, "t", 2))
    rows += [(900, None, "en", "only-null", 1, "t", 2), (901, "12 34", "en", "no-words", 1, "t", 2), (902, "rare words", "xx", "a", 1, "t", 2)]
    rows += [(903, "rare", "xx", "b", 1, "t", 2), (None, "the the", "en", "s1", 1, "t", 2), (904, "q" * 100_000, "en", "s1", 1, "t", 2)]
    return [*rows, rows[5], rows[5]]


def test_audit(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    for least, ranks in ((10, 10), (2, 3)):
        got = sorted(tuple(r) for r in divergence.audit(docs.repartition(5), least, ranks).collect())
        assert got == _plain(rows, least, ranks)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_small_holds_add_up(spark, monkeypatch):
    """Counts handed on in many parts, and shares beyond 64 bits."""
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = {tuple(r) for r in divergence.kept_terms(divergence.term_counts(docs), 3).collect()}
    monkeypatch.setattr(divergence, "_HELD_TERMS", 5)
    parts = divergence.term_counts(docs)
    assert {tuple(r) for r in divergence.kept_terms(parts, 3).collect()} == whole and parts.count() > len(whole)
    big = 10**15
    share = divergence._share("n", "total")
    got = spark.createDataFrame([(big, 3 * big, 7)], "n long, total long, terms long").selectExpr(f"{share} as p").first()["p"]
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 14)
