"""Collocation mining against plain counts, and its filters on their own."""

import re
from collections import Counter

import numpy as np
import pytest

from qalytics.llm import collocations as L
from tests.llm.test_operators import frame


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for p in re.split(r"[.,;:!?\x0A-\x0D]", low):
        yield re.findall(r"[^\x20\x09]+", p)


def brute(rows, least, most):
    out = []
    for lang in {l or "und" for l, _ in rows}:
        f, n = Counter(), 0
        for l, t in rows:
            if (l or "und") == lang:
                for w in pieces(t):
                    n += len(w)
                    f.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, b in cand.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def sample():
    rng = np.random.default_rng(2)
    words = ["a", "The", "new", "york", "times", "é", "ß", "x\x00y", "日本", "to", "be", "or"]
    weights = np.array([5, 5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]) / 20
    rows = [(None, None), ("en", ""), ("en", " .\n,"), ("de", "new york times. " * 40), (None, "new york\ttimes " * 30)]
    for i in range(150):
        w = list(rng.choice(words, rng.integers(1, 60), p=weights))
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = ["New", "York", "Times"]
        if i % 4 == 0:
            w += ["to", "be", "or", "not", "to", "be"]
        text = " ".join(w)
        rows.append((["en", "de", None, "und"][i % 4], text + rng.choice([".", "!", "\r\n", ""]) + text[: rng.integers(1, 40)]))
    return rows


@pytest.mark.parametrize("block_bytes, shard_words", [(400, 50), (10**7, 10**6)])
def test_phrases_match_plain_counts(spark, block_bytes, shard_words):
    rows = sample()
    docs = frame(spark, [t for _, t in rows], langs=[l for l, _ in rows]).repartition(3)
    got = L.collocations(docs, least=12, most=25, block_bytes=block_bytes, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 12, 25)
    assert len({w[0] for w in want}) == 3 and sorted(map(tuple, got.collect())) == want


def test_empty_table_and_texts(spark):
    assert L.collocations(frame(spark, [])).collect() == []
    assert L.collocations(frame(spark, [None, "", "one"], langs=[None, "en", "en"])).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("width", [1, 5, 18, 31, 32])
def test_packing_and_permutation_are_lossless(n, width):
    rng = np.random.default_rng(width)
    ids = [rng.integers(0, 1 << width, 500, dtype=np.uint64) for _ in range(n)]
    half = L._half(n, width)
    left, right = L.pack(ids, width)
    assert int(max(left.max(), right.max())).bit_length() <= half
    a, b = L.permute(left, right, half)
    assert int(max(a.max(), b.max())).bit_length() <= half
    back = L.unpack(*L.restore(a, b, half), n, width)
    assert all((x == y).all() for x, y in zip(ids, back))


@pytest.mark.parametrize("half, shard_bits", [(1, 0), (4, 2), (18, 3), (32, 5), (36, 0), (64, 4)])
def test_filters_round_trip_and_merge(half, shard_bits):
    rng = np.random.default_rng(half)
    merged, parts = Counter(), []
    for _ in range(3):
        left = rng.integers(0, 1 << half, 400, dtype=np.uint64) if half < 64 else rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
        right = rng.integers(0, 1 << min(half, 3), 400, dtype=np.uint64)
        left, right = np.concatenate([left, left[:50]]), np.concatenate([right, right[:50]])
        merged.update(zip(left.tolist(), right.tolist()))
        left, right, counts = L.tally(left, right, None, half)
        spare = half - shard_bits
        for shard in range(1 << shard_bits):
            inside = (left >> np.uint64(spare)) == shard if spare < 64 else np.ones(len(left), bool)
            raw = L.encode(left[inside], right[inside], counts[inside] + 300, spare, half)
            back = L.decode(raw, shard, spare, half)
            for x, y in zip(back, (left[inside], right[inside], counts[inside] + 300)):
                assert (x == y).all()
            parts.append((back[0], back[1], back[2] - 300))
    left, right, counts = L.tally(*(np.concatenate(x) for x in zip(*parts)), half)
    assert dict(zip(zip(left.tolist(), right.tolist()), counts.tolist())) == merged


def test_long_text_is_cut_at_words(monkeypatch):
    import zstandard

    monkeypatch.setattr(L, "CHUNK", 7)
    text = b"alpha beta\ngamma   delta\n\nepsilon " * 9 + b"z" * 40
    got = [t for part in L._tokens(zstandard.compress(text)) for t in part]
    assert got == re.findall(rb"\n|[^ \n]+", text)
