"""Lexical search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from qalytics.llm import blocked_search as S
from tests.llm.test_operators import frame


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(rows), sum(c.total() for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in rows:
            m = 25 + (75 * c.total() * n) // total
            score = 0
            for w in terms(text):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                score += weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) if c[w] else 0
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=repr)


def sample():
    rng = np.random.default_rng(4)
    words = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(80)] + ["Ünï", "日本", "x9", "9"]
    texts = [None, "", "--- !", "the", "THE the", "the " * 500]
    texts += [" ".join(rng.choice(words, rng.integers(1, 50))) for _ in range(250)]
    copies = [texts[30]] * 25
    docs = list(enumerate(texts + copies)) + [(None, texts[40]), (12, "a repeated id w3"), (12, "a repeated id w3")]
    items = [(0, texts[30]), (1, None), (2, "..."), (3, "nowhere"), (4, "the of a the"), (5, "w1-w2,w1;W1 ünï Ünï 日本"),
             (6, texts[40]), (6, "w5 w6"), (None, "w7")]
    return docs, items + [(10 + i, " ".join(rng.choice(words, 12))) for i in range(12)]


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS query", "2 AS doc_id")


@pytest.mark.parametrize("options, dense", [({}, S.DENSE), ({"postings": 300, "batch_bytes": 150}, S.DENSE), ({}, 900)])
def test_search_matches_brute_force(spark, options, dense, monkeypatch):
    monkeypatch.setattr(S, "DENSE", dense)
    docs, items = sample()
    found = S.search(frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3), items_frame(spark, items), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = sample()
    assert S.search(frame(spark, []), items_frame(spark, items)).collect() == []
    assert S.search(frame(spark, ["the"]), items_frame(spark, [])).collect() == []
    assert S.search(frame(spark, [None, "?"]), items_frame(spark, items)).collect() == []


def shard_of(rng, docs, size, groups):
    """Documents of ``groups`` topics over ``size`` terms, all with term 0."""
    rows = []
    for d in range(docs):
        low = 1 + (d % groups) * ((size - 1) // groups)
        t = np.unique(np.concatenate([[0], rng.integers(low, low + (size - 1) // groups, 8)]))
        rows.append((t, rng.integers(1, 1000, len(t))))
    ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    return ptr, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows])


def test_blocks_bound_their_documents_and_are_skipped():
    rng = np.random.default_rng(0)
    size = 161
    ptr, t, v = shard_of(rng, 2000, size, 20)
    s = S.build_shard(np.arange(2000), np.zeros(2000, bool), ptr, t, v, size)
    # summaries are exact maxima
    for b in range(len(s["block_ptr"]) - 1):
        members = s["block_docs"][s["block_ptr"][b]:s["block_ptr"][b + 1]]
        want = {}
        for d in members:
            for term, value in zip(t[ptr[d]:ptr[d + 1]], v[ptr[d]:ptr[d + 1]]):
                want[term] = max(want.get(term, 0), value)
        a, e = s["sum_ptr"][b], s["sum_ptr"][b + 1]
        assert dict(zip(s["sum_terms"][a:e].tolist(), s["sum_max"][a:e].tolist())) == want
    scored = []
    for _ in range(20):
        q = np.concatenate([[0], rng.choice(np.arange(1, size), 5, replace=False)])
        w = rng.integers(1, 50, len(q))
        dense_q = np.zeros(size, np.int64)
        dense_q[q] = w
        scores = np.add.reduceat(dense_q[t] * v, ptr[:-1])
        best = np.lexsort((np.arange(2000), -scores))[:10]
        got, n = S.search_shard(s, q, w, size, 10)
        assert sorted(got, key=lambda x: (-x[0], x[1])) == [(scores[d], d) for d in best]
        scored.append(n)
    assert np.mean(scored) < 1200


def test_long_text_is_cut_at_terms(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 9)
    text = ("Alpha,beta-gamma_delta  " * 7 + "z" * 60 + " é9").encode()
    assert [w.decode() for part in S.terms_of(text) for w in part] == terms(text.decode())
