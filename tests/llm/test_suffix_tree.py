"""LM scoring against a plain suffix tree and plain token counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from qalytics.llm import suffix_tree as T
from tests.llm.test_operators import frame


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows, depth, least_gain):
    train = [tokens(t) for i, t in rows if not held_out(i)]
    c = Counter(w for t in train for w in t + [None])
    n, v = sum(c.values()), len(c)
    symbols = [b"\n" * depth + " ".join(tokens(t)).encode() + b"\n" for _, t in rows]
    nxt = [defaultdict(Counter) for _ in range(depth + 1)]
    for (i, _), s in zip(rows, symbols):
        if not held_out(i):
            for at in range(depth, len(s)):
                for d in range(depth + 1):
                    nxt[d][s[at - d:at]][s[at]] += 1
    total = sum(nxt[0][b""].values())

    def p(context, x):
        """Probability after the longest kept suffix of ``context``."""
        if not context:
            return (nxt[0][b""][x] + 0.1) / (total + 25.6)
        own = nxt[len(context)].get(context)
        if own and context not in kept:
            m = sum(own.values())
            gain = 0.0
            for y, k in own.items():
                if m > 1:
                    back = p(context[1:], y)
                    rest = (max(k - 1.75, 0) + 0.75 * (len(own) - (k == 1)) * back) / (m - 1)
                    gain += k * math.log10(rest / back)
            kept[context] = m > 1 and gain >= least_gain
        if own and kept[context]:
            m = sum(own.values())
            return max(own[x] - 0.75, 0) / m + 0.75 * len(own) / m * p(context[1:], x)
        return p(context[1:], x)

    kept: dict = {}
    out = []
    for (i, t), s in zip(rows, symbols):
        w = tokens(t) + [None]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(p(s[at - depth:at], s[at])) for at in range(depth, len(s)))
        out.append((i, held_out(i), len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out, kept


def same(got, want):
    def order(r):
        return (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)


def sample():
    rng = np.random.default_rng(3)
    stems = ["an", "ber", "cal", "dor", "é", "fin", "ga"]
    texts = [None, "", " \n\t", "One", "one TWO", "x" * 3000, "ünï Ünï"]
    texts += [" ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(rng.integers(1, 60))) for _ in range(90)]
    rows = list(enumerate(texts))
    return rows + [(None, "one two"), (5, "repeated id"), (20, texts[20]), (20, texts[20])]


@pytest.mark.parametrize("block_bytes", [700, 10**6])
def test_scores_match_a_plain_tree(spark, block_bytes):
    rows = sample()
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    want, kept = brute(rows, 3, T.LEAST_GAIN)
    assert any(kept.values()) and not all(kept.values())
    same(T.score_texts(docs, depth=3, block_bytes=block_bytes).collect(), want)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    texts = ["ab ba " * 50 + "z" * 30, "ab " * 90, "q" * 200]
    monkeypatch.setattr(T, "CHUNK", 16)
    rows = [(owner, code) for owner, codes in T._runs([t.encode() for t in texts], 2) for owner, code in zip(owner, codes)]
    whole = []
    for j, t in enumerate(texts):
        s = b"\n\n" + t.encode() + b"\n"
        whole += [(j, int.from_bytes(s[i:i + 3])) for i in range(len(s) - 2)]
    assert rows == whole
    found = Counter(int(o) for owner, _ in T._words([" ".join(t.split()).encode() for t in texts]) for o in owner)
    assert found == Counter({j: len(t.split()) for j, t in enumerate(texts)})


def test_distributions_sum_to_one(spark):
    text = "abra cadabra abra abracadabra " * 20
    s = b"\n\n" + " ".join(text.split()).encode() + b"\n"
    seen = Counter(int.from_bytes(s[i:i + 3]) for i in range(len(s) - 2))
    asked = [(c << 8 | x, 0) for c in {k >> 8 for k in seen} for x in range(256) if c << 8 | x not in seen]
    runs = spark.createDataFrame([*seen.items(), *asked], "code long, n long")
    sums = T.tree_values(runs, 3).groupBy((T.F.shiftright("code", 8)).alias("c")).agg(T.F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0, abs=1e-9) for r in sums)


def test_empty_table(spark):
    assert T.score_texts(frame(spark, [])).collect() == []


def test_context_model_predicts_held_out_texts_better(spark):
    rng = np.random.default_rng(1)
    phrases = [" ".join("".join(rng.choice(list("aeioubcdfg"), 6)) for _ in range(5)) for _ in range(20)]
    texts = [" ".join(rng.choice(phrases, 8)) + f" {rng.integers(10**6)}" for _ in range(300)]
    got = [r for r in T.score_texts(frame(spark, texts)).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.base_score for r in got)
