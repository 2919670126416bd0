"""Each operator against a brute-force version, with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalytics.llm import common as C
from qalytics.llm import exact_trie, language_id, licenses, line_dedup, mixing, multi_index, ngram_join, packing, pii, queries, url_rules
from tests.conftest import SF0001

WORDS = [f"w{i}" for i in range(60)]
KIND = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, key string, id string, size string, length string"


def frame(spark, texts, ids=None, langs=None, sources=None):
    """documents with columns whose names operators use inside."""
    C.on_workers(spark)
    ids = ids if ids is not None else range(len(texts))
    data = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], 0, 7, 7, "k", "x", "y", "z")
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(data, KIND)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_texts():
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(3)]
    out = [None, "", " \n\t ", "One two", "one TWO", "one two three four five", "x" * 5000]
    for b in base:
        w = b.split()
        out += [b, b.upper()]
        for n in (1, 1, 2, 3, 6, 12):
            v = list(w)
            for _ in range(n):
                v[rng.integers(len(v))] = f"new{rng.integers(10**6)}"
            out.append(" ".join(v))
    shared = " ".join(rng.choice(WORDS, 12))
    return out + [shared + " " + " ".join(f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 40)))) for _ in range(25)]


def brute_components(ids, texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and ids[i] is not None and ids[j] is not None and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low[find(i)], x)
    return sorted(((-1 if x is None else x), len(sets[i]), -1 if x is None else low[find(i)]) for i, x in enumerate(ids))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_classes(spark, k, num):
    texts = near_texts()
    texts += [texts[7], texts[7], "left out"]
    ids = [*range(100, 100 + len(texts) - 3), 3, 3, None]
    got = ngram_join.jaccard_classes(frame(spark, texts, ids), k, num, 100).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute_components(ids, texts, k, num, 100)
    assert ngram_join.jaccard_classes(frame(spark, []), k, num, 100).collect() == []


def test_hot_shingles_are_salted_without_change(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 3)
    texts = near_texts()
    got = ngram_join.jaccard_classes(frame(spark, texts), 3, 90, 100).collect()
    assert sorted(map(tuple, got)) == brute_components(range(len(texts)), texts, 3, 90, 100)


def test_near_duplicates_leave_one(spark):
    texts = near_texts()
    df = frame(spark, texts)
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {i for i, n, c in brute_components(range(len(texts)), texts, 5, 80, 100) if n == 0 or c == i}
    assert {r.doc_id for r in kept.collect()} == want


def test_near_duplicates_of_repeated_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c, d, e = (" ".join(rng.choice(WORDS, 40)) for _ in range(5))
    near = lambda x: x + " more"
    rows = [(1, a), (1, b), (1, b), (1, near(b)), (2, near(a)), (2, c), (2, ""), (2, None), (2, ""), (3, d), (3, e), (3, near(c)),
            (None, a), (None, a), (4, near(d)), (4, near(e))]
    kept = ngram_join.drop_near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert kept.columns == frame(spark, []).columns
    want = [(1, a), (1, b), (2, c), (2, ""), (2, None), (2, ""), (3, d), (3, e), (None, a), (None, a)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


def test_word_hashes_tell_words_apart():
    text = " ".join(f"{a}{b}" for a in WORDS for b in range(300)).encode()
    _, h = C.word_hashes([text, b"", b"A a"])
    assert len(np.unique(h[:-2])) == len(set(text.split())) and h[-1] == h[-2]


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(rng.choice(WORDS, 30)) for _ in range(12)]

    def change(line, n):
        w = line.split()
        for _ in range(n):
            w[rng.integers(len(w))] = f"v{rng.integers(10**6)}"
        return " ".join(w)
    texts = [None, "", "a b c\n\nA  b c", "\n".join(lines[:4]), "\n".join(change(x, 1) for x in lines[:6]), "\n".join(change(x, 3) for x in lines),
             "solo\n" + lines[7].upper() + "\nsolo", "\n".join(change(lines[0], i % 4) for i in range(40)), "x" * 4000 + "\n" + "x" * 4000]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    earlier = []
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        kept = []
        for line in t.split("\n"):
            s = shingles(line.lower(), 5)
            bad = bool(s) and any(len(s & e) * 100 >= 80 * len(s | e) for e in earlier)
            if s:
                earlier.append(s)
            if not bad:
                kept.append(line)
        assert got[i].text == "\n".join(kept), i
        assert (got[i].n_lines, got[i].n_removed) == (t.count("\n") + 1, t.count("\n") + 1 - len(kept))
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def brute_line_dedup(ids, texts):
    """Texts less each line that matches one of a smaller (id, line number)."""
    lines = [(-1 if i is None else i, no, shingles(line.lower(), 5)) for i, t in zip(ids, texts) for no, line in enumerate(t.split("\n"))]

    def gone(i, no, line):
        s = shingles(line.lower(), 5)
        return bool(s) and any((j, m) < (i, no) and len(s & e) * 100 >= 80 * len(s | e) for j, m, e in lines)
    return ["\n".join(x for no, x in enumerate(t.split("\n")) if not gone(-1 if i is None else i, no, x)) for i, t in zip(ids, texts)]


def test_line_dedup_cuts_words_at_any_ascii_white_space(spark):
    a, b = "one two three four five six", "p q"
    texts = [f"{a}\n{b}\n \n\t\n\x0b\x0c", "\t" + a.replace(" ", "  ") + "\r", a.replace(" ", "\t"), f"  {a}  ", "p\x0bq \n\x0cp  q",
             a.replace(" ", "\u00a0"), a.replace("two three", "two  three"), "\r\n \r", "p\x1fq"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_line_dedup(range(len(texts)), texts)


@pytest.mark.parametrize("salt_rows", [50_000, 3])
def test_line_dedup_of_repeated_ids(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", salt_rows)
    rng = np.random.default_rng(8)
    a, b, c, d, e, f, g = (" ".join(rng.choice(WORDS, 30)) for _ in range(7))
    near = lambda x: " ".join([*x.split()[:-1], "other"])
    data = [(1, f"{a}\n{b}\nend"), (1, f"{a}\n{b}\nend"),              # a row twice
            (2, f"{c}\n{a}\n{d}"), (2, f"{c}\n{e}\n{near(d)}\n{c}"), (2, f"{c}\n{near(b)}\n{f}"),  # an id of several texts
            (None, f"{g}\nx y"), (None, f"{g}\nx y"), (None, f"{g}\n{near(g)}\n{f}"), (None, f"{f}\nx y"),
            (3, f"{g}\n{e}\nx y"), (3, f"{near(f)}\nnew words"), (3, f"{near(f)}\nnew words")]
    ids, texts = [i for i, _ in data], [t for _, t in data]
    got = line_dedup.dedup_lines(frame(spark, texts, ids)).collect()
    key = lambda r: (r[0] is not None, *r[1:], r[0] or 0)
    want = [(i, k, t.count("\n") + 1) for i, t, k in zip(ids, texts, brute_line_dedup(ids, texts))]
    assert sorted(((r.doc_id, r.text, r.n_lines) for r in got), key=key) == sorted(want, key=key)
    twice = line_dedup.dedup_lines(frame(spark, [a, a, b, b], [1, 1, 2, 2])).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in twice) == [(1, a, 0), (1, a, 0), (2, b, 0), (2, b, 0)]


def test_line_dedup_meets_by_one_long_and_looks_again_at_wanted_lines(spark, monkeypatch):
    """Entries are dealt and sorted by a single long, and of a document with one
    line of a pair, the other lines are left out before their words are cut."""
    staged, cut, stage, sets = {}, [], C.stage, line_dedup._sets
    monkeypatch.setattr(C, "stage", lambda df, label: staged.setdefault(label, df) is None or stage(df, label))
    monkeypatch.setattr(line_dedup, "_sets", lambda lines, *a: cut.append(lines) or sets(lines, *a))
    rng = np.random.default_rng(12)
    line = lambda: " ".join(f"n{x}" for x in rng.integers(10**9, size=30))
    a = line()
    texts = ["\n".join([a, *(line() for _ in range(50))]), "\n".join([*(line() for _ in range(50)), a + " more"])]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1}
    plan = staged["met"]._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\((.*?), \d+\)", plan))
    assert len(dealt) == 1 and "," not in dealt.pop()
    again = cut[1]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"getbit\(.*pmod\(xxhash64\(id#\d+L?, line_no#\d+", again) and cut[1].count() == 2


def base_spans(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_personal_data(spark):
    texts = [None, "", "mail a.b+c@x-y.example.com, or é ü q@r.s.t@u.v", "1.2.3.4.5.6.7.8 and 300.1.1.1 999999999999.1.1.1 001.002.003.004",
             "4111 1111 1111 1111 and 4111-1111-1111-1112 4222222222222", "call +1 (386) 555-3733 or +49 30 1234567. +1", "a@b-c_d@e.f b@@c.d a@b.c_x@d.e",
             "9 " * 3000, "a" * 20000, "@.".join(["x"] * 2000), "no (at) spam (dot) org or me [at] host.com 555-123-4567 ß 10.0.0.1"]
    got = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        counts = Counter(s.split(":")[0] for s in want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, got[i].spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in pii.KINDS)
        shown = [s for s in got[i].spans.split(",") if s]
        assert set(want) <= set(shown) and len(shown) == len(want) + got[i].n_added
    assert pii.find(frame(spark, [])).collect() == []


def test_special_tokens_keep_their_ids(monkeypatch):
    path = queries.tokenizer_path()
    words = packing.Words(path)
    monkeypatch.setattr(packing, "MEMORY", 3)
    texts = ["", "Plain Text, again", "a<|endoftext|>b", "a <|ENDOFTEXT|> B.", "<|StartOfText|>", "<|startoftext|> x<|endoftext", "plain text"]
    for _ in range(2):
        for got, text in zip(words.encode([t.encode() for t in texts]), texts):
            assert got.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_latin_letters_need_no_batch_encoding():
    words = packing.Words(queries.tokenizer_path())
    known = words.tokenizer
    texts = ["ciónñez é. ñandú, über straße", "Émentré É.", "éa e\u0301. a\u0301é", "ªº µ÷×", "l'été d'où"]
    for got, text in zip(words.encode([t.encode() for t in texts]), texts):
        assert got.tolist() == known.encode(text, add_special_tokens=False).ids, text

    class Counted:
        seen: list[str] = []

        def __getattr__(self, name):
            return getattr(known, name)

        def encode_batch(self, batch, **options):
            self.seen += batch
            return known.encode_batch(batch, **options)

    words.tokenizer = Counted()
    words.encode(["ciónña éé. plus".encode(), "x9 ñóñ,".encode()])
    assert Counted.seen == ["x9"]  # point and comma are known by now


def test_the_configuration_program_packs_most_pieces():
    random = np.random.default_rng(5)
    for sizes in (np.exp(random.normal(4, 1, 4000)).astype(int), random.integers(190, 310, 3000), random.integers(1, 30, 4000), [125] * 900 + [170] * 600 + [7] * 3):
        histogram = Counter(np.clip(sizes, 1, 512).tolist())
        program, rest = packing._best_program(dict(histogram), 512, packing.ROUNDS)
        packed = Counter()
        for config, times in program + rest:
            assert sum(config) <= 512 and times > 0
            for n in config:
                packed[n] += times
        assert packed == histogram
        assert sum(len(config) * times for config, times in program) >= 0.9 * len(sizes)
        # no more sequences than best fit decreasing alone takes, but for one in 200
        assert packing._count(program + rest) <= 1.005 * packing._count(packing._best_fit(dict(histogram), 512)) + 1
    assert packing.solve({}) == []


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [None, "", "İstanbul ﬁ d'accord it's, don't!! a.b,c ..., ½ 中文,字", "Hello, World. " * 900] + ["tie here"] * 5 + [" ".join(WORDS[: i % 60]) for i in range(150)]
    got = packing.packed_sequences(frame(spark, texts), path, capacity=256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 256)) and sum(r.length for r in pieces) == len(ids)
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[s:s + 256].tobytes()) for s in range(0, len(ids), 256)]
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    assert len(sequences) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.packed_sequences(frame(spark, []), path).collect() == []


def test_url_rules(spark):
    C.on_workers(spark)
    urls = [None, "", "no scheme", "http://a.NET/x", "http://net/", "http://xnet/", "https://a.example.net/en/1?q#f", "https://example.net/english/", "http://example.com/de/",
            "http://aexample.com/de/", "http://w.org/fr/?x", "http://w.org/de/", "http://b.net", "http://b.net?x=/y", "ftp://u@c.net:80/z"] + ["http://hot.net/p"] * 60
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_rules.judge(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [(len(r), r, v) for r, v in url_rules.BASE_RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/"):])]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
    assert url_rules.judge(df.limit(0)).collect() == []


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    C.on_workers(spark)
    got = language_id.identify(language_id.document_rows(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.95 * len(got)
    assert language_id.accepted_documents(docs).columns == docs.columns
    pages = spark.read.parquet(f"{SF0001}/pages.parquet")
    found = language_id.identify(language_id.page_rows(pages)).collect()
    assert len(found) == pages.count() and sum(r.accepted for r in found) >= 0.9 * len(found)
    odd = frame(spark, [None, "", "123 456"] + ["the cat and the dog"] * 30, ids=[None, 1, 1, *range(3, 33)], langs=[None, "??", "en-GB"] + ["en"] * 30)
    kept = language_id.accepted_documents(odd).collect()
    assert len(kept) == 30 and all(r.text for r in kept)
    assert language_id.accepted_documents(frame(spark, [])).collect() == []


def test_mixing(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(rng.integers(0, 60))) for _ in range(900)] + [None, "", "w " * 20000]
    sources = [None if i % 9 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}" for i in range(len(texts))]
    df = frame(spark, texts, sources=sources)
    got = mixing.mix(df, block_words=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df, block_words=64).collect()))
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)))
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-6
    taken = Counter()
    for r in got:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    longest = {s: max(len(words(t)) for t, x in zip(texts, sources) if x == s) for s in names}
    assert all(abs(taken[s] - goal[s]) <= 2 * longest[s] for s in names)
    times = {r.doc_id: r.times for r in got}
    assert Counter(r.doc_id for r in mixing.mixed_documents(df, block_words=64).collect()) == Counter({i: n for i, n in times.items() if n})
    assert mixing.mix(frame(spark, [])).collect() == []


def test_mixing_of_many_sources(spark):
    count = 101_000  # more than were once allowed
    C.on_workers(spark)
    many = spark.range(count).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('h', lpad(id, 7, '0')) as source")
    goal = mixing.targets([float(1 + i % 7) for i in range(count)], [float(mixing.WEIGHTS[i % 3]) for i in range(count)], 1.5 * sum(1 + i % 7 for i in range(count)), 2)
    got = mixing.mix(many).select("doc_id", "target").toArrow().sort_by("doc_id")["target"].to_numpy()
    assert np.allclose(got, goal, rtol=1e-9)


def test_mixed_order_follows_the_schedule(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(["w"] * int(rng.integers(1, 9))) for _ in range(3000)]
    sources = [["a", "b", "c"][i % 3] for i in range(3000)]
    rows = mixing.mix(frame(spark, texts, sources=sources), block_words=64).collect()
    assert all(len(r.places) == r.times for r in rows)
    order = sorted((p.place, p.word, r.source, r.size) for r in rows for p in r.places)
    assert len({x[:2] for x in order}) == len(order)
    # each stretch of the mixed order holds the sources by their targets
    share = {r.source: r.target for r in rows}
    whole = sum(share.values())
    for k in range(4):
        part = order[k * len(order) // 4:(k + 1) * len(order) // 4]
        words_of = Counter()
        for _, _, s, n in part:
            words_of[s] += n
        assert all(abs(words_of[s] / sum(words_of.values()) - share[s] / whole) < 0.1 for s in share)


def test_exact_groups(spark):
    texts = [None, "", "A b", "a B", "a b", "É", "é", "x" * 9000, "X" * 9000, "x" * 9000 + "y", "a b"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 4]
    got = exact_trie.exact_groups(frame(spark, texts, ids)).collect()
    norm = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    want = [(i, max(j for j, u in zip(ids, norm) if u == t), norm.count(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm)]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_trie.exact_groups(frame(spark, [])).collect() == []


def test_trie_holds_whole_strings():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, int(rng.integers(0, 12)), dtype=np.uint8)) for _ in range(2000)]
    trie = exact_trie.Trie(min)
    for i, t in enumerate(texts):
        trie.insert(t, i)
    assert sorted(trie.terminals()) == sorted((t, texts.index(t), n) for t, n in Counter(texts).items())


def test_nearest(spark):
    C.on_workers(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype("float32").tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(1000 + i, x[0], 0) for i in range(30)] + [
        (2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, [None] * 8, 0), (2004, [1.0], 0), (None, x[1], 0), (5, x[5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    got = defaultdict(list)
    for r in multi_index.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and i < 2000}
    for q in [i for i in good if i % 100 == 0]:
        d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [(n + 1, i) for n, (_, i) in enumerate(d)] == [(r, i) for r, i, _ in sorted(got[q])]
        assert np.allclose([s for _, _, s in sorted(got[q])], [s for s, _ in d], rtol=1e-12)
    assert multi_index.nearest(df.limit(0), df.limit(0)).collect() == []


def test_recall_reaches_nine_tenths(spark):
    C.on_workers(spark)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    found = defaultdict(set)
    for r in multi_index.nearest(df, df.where("vec_id % 100 = 0"), candidates=1).collect():
        found[r.query_id].add(r.vec_id)
    hits = n = 0
    for q in (i for i in rows if i % 100 == 0):
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        hits += len(found[q] & set(best))
        n += len(best)
    assert hits >= 0.9 * n


def test_licenses(spark):
    texts = [None, "", "Licensed under CC BY-NC 4.0. All Rights Reserved; all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
             "Released under the MIT License.", "cc by cc by cc", "permit the license of an accept", "SPDX-License-Identifier: Apache-2.0", "é" * 9000, "xcc by"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(j, label) for p, label in licenses.BASE_PHRASES for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "mit" in got[4].labels and "apache-2.0" in got[7].labels and got[6].labels == "" and "cc-by-nc" in got[2].labels.split(",")
    assert len(licenses.rules()) > 200 and licenses.scan(frame(spark, [])).collect() == []


def test_license_suppression_equals_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(300):
        found = []
        for _ in range(int(rng.integers(0, 40))):
            start = int(rng.integers(0, 30))
            found.append((start, start + int(rng.integers(1, 12)), "abc"[int(rng.integers(0, 3))], int(rng.integers(1, 4)) * 10))
        kept: list[tuple] = []
        for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert licenses.outermost(found) == sorted(kept)


def test_license_detections_of_a_long_text():
    sentence = "Copyright 2021 Someone. Released under the MIT License, without warranty of any kind, express or implied. "
    scanner = licenses.Scanner()
    normal = lambda t: b" " + b" ".join(t.encode().translate(licenses._WORD).split()) + b" "
    one, n = scanner.detections(normal(sentence)), 20_000
    words = len(sentence.split())
    many = scanner.detections(normal(sentence * n))
    assert {d[2] for d in one} >= {"copyright", "mit", "warranty"}
    assert many == sorted(((s + i * words, e + i * words, label, p) for i in range(n) for s, e, label, p in one), key=lambda d: d[:2])
    assert scanner.base(normal("All rights reserved. " * 3)) == [(0, "reserved"), (3, "reserved"), (6, "reserved")]


ENGLISH = "the house on the hill is old and the people who live there say that it was built by a miller number {}"
FINNISH = "vanha talo on makien keskella ja ihmiset jotka asuvat siella sanovat etta sen rakensi mylly {}"


def test_every_declared_language_is_modelled(spark):
    C.on_workers(spark)
    texts = [ENGLISH.format(i) for i in range(80)] + [FINNISH.format(i) for i in range(4)] + [FINNISH.format("tuntematon")]
    langs = ["en"] * 80 + ["fi"] * 4 + [None]
    got = {r.doc_id: r for r in language_id.identify(language_id.document_rows(frame(spark, texts, langs=langs))).collect()}
    assert all(got[i].accepted and got[i].language == ("en" if i < 80 else "fi") for i in range(85))
    few = frame(spark, [ENGLISH.format(i) for i in range(4)], langs=["en"] * 4)
    assert language_id.accepted_documents(few).count() == 4
    # 280 languages of three rows each, every one with its own words: none goes for their number
    rng = np.random.default_rng(6)
    codes = [a + b + c for a in "bcdfghk" for b in "aeiouvwxyz" for c in "lmnp"]
    own = {c: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for c in codes}
    odd = frame(spark, [" ".join(rng.permutation(own[c])) for c in codes for _ in range(3)], langs=[c for c in codes for _ in range(3)])
    found = language_id.identify(language_id.document_rows(odd)).join(odd.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 3 * len(codes) and all(r.accepted and r.language == r.lang for r in found)
    none = frame(spark, [ENGLISH.format(1)] * 3, langs=["und", "zxx", None])
    assert language_id.accepted_documents(none).count() == 0


def test_language_model_equals_its_definition():
    rng = np.random.default_rng(3)
    texts = ["".join("abcd "[int(j)] for j in rng.integers(0, 5, int(rng.integers(0, 60)))).encode() for _ in range(40)]
    langs = [("aa", "bb", None)[int(j)] for j in rng.integers(0, 3, 40)]
    per = []
    for t in texts:
        per.append(Counter(int(b) for b in language_id._trigrams([t])[1]))
    counts = {x: sum((p for p, y in zip(per, langs) if y == x), Counter()) for x in ("aa", "bb")}
    both = counts["aa"] + counts["bb"]
    rows = [(i, b, n) for i, x in enumerate(("aa", "bb")) for b, n in counts[x].items()]
    model = language_id.Model(["aa", "bb"], *(np.array(c) for c in zip(*rows)))
    size, mean, own = model.means(texts, langs)
    buckets = 1 << language_id.BITS
    share = lambda b: 0.5 / buckets + 0.5 * (both[b] + 0.5) / (both.total() + 0.5 * buckets)
    for j, (p, y) in enumerate(zip(per, langs)):
        assert size[j] == p.total()
        for i, x in enumerate(("aa", "bb")):
            c = counts[x] - p if x == y else counts[x]
            want = sum(n * np.log((c[b] + language_id.SHRINK * share(b)) / (c.total() + language_id.SHRINK)) for b, n in p.items()) / max(1, p.total())
            assert np.isclose(mean[j, i], want)


def test_language_of_held_out_documents(spark):
    C.on_workers(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    got = language_id.identify(language_id.document_rows(hidden)).join(hidden.select("doc_id", "truth", F.col("lang").alias("said")), "doc_id")
    got = got.where("said is null").collect()
    assert len(got) == 200 and sum(r.language == r.truth for r in got) >= 0.95 * len(got)


def test_mixed_rows_that_repeat_an_id_and_text(spark):
    rows = [(7, "one two three four five six seven eight nine ten", "a", 1)] * 500 + [(i, f"word{i} " * 9, "b", i) for i in range(100, 140)]
    rows += [(7, "one two three four five six seven eight nine ten", None, 2)] * 3 + [(None, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    plan = mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("times").alias("n")).where("n > 0").collect()
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.source): r["count"] for r in got.groupBy("doc_id", "source").count().collect()} == {(r.doc_id, r.source): r.n for r in plan}


def test_nearest_of_one_component(spark):
    C.on_workers(spark)
    x = [float((i * 37) % 301) + 1 for i in range(300)]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in multi_index.nearest(df, df.where("vec_id % 100 = 0")).collect())
    want = [(q, n + 1, i) for q in (0, 100, 200)
            for n, (_, i) in enumerate(sorted((abs(x[q] - v), i) for i, v in enumerate(x) if i != q)[:10])]
    assert got == want
