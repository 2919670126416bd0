"""Phrase collocation mining with counting quotient filters.

Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at space and
tab into words, A-Z lower-cased. Everything is counted per language.

* Texts of one language are cut into blocks of about ``BLOCK_BYTES``. A block
  asks for its distinct words; words seen ``least`` times or more in their
  language get a number. (A phrase is never more frequent than its words, so
  others are in no candidate.)
* A block packs each phrase of 2 to 4 numbered words into one integer of
  ``words * width`` bits, permutes it invertibly (a Feistel network) and stores
  it in a counting quotient filter: the leading bits are the quotient, kept as
  runs in a bitmap, the rest is the full remainder, each with a counter. As
  the permutation is a bijection and no bit is dropped, counts are exact.
* The first quotient bits name a shard. A task merges the sorted filters of
  all blocks for its shard, inverts the permutation and returns the phrases
  that reach ``least``. The permutation spreads phrases evenly, a block sends
  a phrase once, and the number of shards follows the number of words, so a
  shard's size is bounded whatever the skew. Only the largest languages' tables
  of frequent phrases go on, as rows, to joins for cuts and containment.

Results: null text is empty, null lang is ``und``; the id plays no part, so
repeated rows count each; an empty table gives an empty frame; other columns
are ignored; ties rank by count, then phrase in byte order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

BLOCK_BYTES = 16_000_000
HELD_BYTES = 48_000_000      # text of all languages a task holds before it writes the longest block
SHARD_WORDS = 2_000_000      # words of text for each shard of a phrase length
SLICE = 2_000_000            # words packed at once
CHUNK = 2_000_000            # text bytes cut into words at once
LONGEST = 4
MOST_BITS = 32               # of a word number: 2**32 words seen 30 times or more in one language

_PIECE = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes(0x0A if b in _PIECE else 0x20 if b in b" \t" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TOKEN = re.compile(rb"\n|[^ \n]+")

_BLOCK = "block long, lang string, body binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("body", pa.binary())])
_ASK = "block long, lang string, word string, n long"
_ASK_SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_KNOWN = "block long, lang string, word string, total long, id long, first boolean"
_KNOWN_SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("total", pa.int64()),
                           ("id", pa.int64()), ("first", pa.bool_())])
_FILTER = "words int, shard long, filter binary"
_FILTER_SCHEMA = pa.schema([("words", pa.int32()), ("shard", pa.int64()), ("filter", pa.binary())])
_GRAM = "words int, ids array<long>, f long"
_GRAM_SCHEMA = pa.schema([("words", pa.int32()), ("ids", pa.list_(pa.int64())), ("f", pa.int64())])


# --- blocks and words ----------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal number
        body = zstandard.compress(b"".join(held.pop(lang)), 3)
        del sizes[lang]
        number += 1
        return pa.RecordBatch.from_pydict({"block": [number - 1], "lang": [lang], "body": [body]}, schema=_BLOCK_SCHEMA)

    for batch in batches:
        for part, texts in C.text_slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                held.setdefault(lang, []).append(text.translate(_BYTES) + b"\n")
                sizes[lang] += len(text) + 1
                if sizes[lang] >= block_bytes:
                    yield flush(lang)
                elif sizes.total() >= HELD_BYTES:
                    yield flush(sizes.most_common(1)[0][0])
    for lang in list(held):
        yield flush(lang)


def _tokens(body: bytes) -> Iterator[list[bytes]]:
    """Words and piece ends of a block, a part at a time."""
    raw = zstandard.decompress(body)
    at = 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= CHUNK else raw.find(b" ", at + CHUNK)
        stop = len(raw) if stop < 0 else stop
        yield _TOKEN.findall(raw, at, stop)
        at = stop


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's distinct words with their counts; the row with an empty word
    has the number of all its words."""
    for batch in batches:
        for row in batch.to_pylist():
            count: Counter = Counter()
            for tokens in _tokens(row["body"]):
                count.update(tokens)
            count.pop(b"\n", None)
            words, n = [b"", *count], [count.total(), *count.values()]
            for at in range(0, len(words), 100_000):
                w = pa.array(words[at:at + 100_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(w)), pa.array([row["lang"]] * len(w), pa.string()), w,
                                                  pa.array(n[at:at + 100_000], pa.int64())], schema=_ASK_SCHEMA)


def _number(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Number the words of rows sorted by (lang, word); the task's number is
    the low ``bits`` so that numbers stay small."""
    task, nth, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        ids, first = [], []
        for key in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
            first.append(key != last)
            nth += key != last
            ids.append((nth << bits) | task)
            last = key
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "lang", "word", "total")), pa.array(ids, pa.int64()),
                                          pa.array(first, pa.bool_())], schema=_KNOWN_SCHEMA)


# --- packed phrases ------------------------------------------------------------

def _half(words: int, width: int) -> int:
    return (words * width + 1) // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the integer that holds the word numbers side by side."""
    n, w = len(ids), np.uint64(width)
    ids = [i.astype(np.uint64) for i in ids]
    if n == 2:
        return ids[0], ids[1]
    if n == 4:
        return (ids[0] << w) | ids[1], (ids[2] << w) | ids[3]
    over = np.uint64(_half(3, width) - width)      # bits of the middle word in the left half
    under = w - over
    return (ids[0] << over) | (ids[1] >> under), ((ids[1] & _mask(int(under))) << w) | ids[2]


def unpack(left: np.ndarray, right: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    w, m = np.uint64(width), _mask(width)
    if n == 2:
        return [left, right]
    if n == 4:
        return [left >> w, left & m, right >> w, right & m]
    over = np.uint64(_half(3, width) - width)
    under = w - over
    return [left >> over, ((left & _mask(int(over))) << under) | (right >> w), right & m]


_ROUNDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def permute(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of the integers of ``2 * half`` bits."""
    m = _mask(half)
    for key in _ROUNDS:
        left, right = right, left ^ (C.mix(right + np.uint64(key)) & m)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    m = _mask(half)
    for key in reversed(_ROUNDS):
        left, right = right ^ (C.mix(left + np.uint64(key)) & m), left
    return left, right


# --- counting quotient filters -------------------------------------------------

def tally(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: int):
    """Sorted distinct (left, right) with summed counts. The sort is a merge
    sort, which joins runs that are sorted already."""
    if half <= 32:
        code = (left << np.uint64(half)) | right
        order = None
        if counts is None:
            code.sort()
        else:
            order = np.argsort(code, kind="stable")
            code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        left, right = code[first] >> np.uint64(half), code[first] & _mask(half)
        size = len(code)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        first = np.flatnonzero(np.concatenate([[True], new])) if len(left) else np.zeros(0, np.int64)
        size = len(left)
        left, right = left[first], right[first]
    if counts is None:
        return left, right, np.diff(np.append(first, size))
    return left, right, np.add.reduceat(counts[order], first) if size else counts


def _planes(x: np.ndarray, bits: int) -> bytes:
    return b"".join((x >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(-(-bits // 8)))


def _from_planes(raw: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    x = np.zeros(n, np.uint64)
    for i in range(-(-bits // 8)):
        x |= np.frombuffer(raw, np.uint8, n, at).astype(np.uint64) << np.uint64(8 * i)
        at += n
    return x, at


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, spare: int, half: int) -> bytes:
    """The filter of one shard: sorted entries whose ``left`` has ``spare``
    bits below the shard's. Quotients are a bitmap of runs (a one for every
    entry, a zero after every slot); then remainders, then counters."""
    n = len(left)
    q = min(spare, n.bit_length())
    rest = spare - q
    quotient = ((left >> np.uint64(rest)) & _mask(q)).astype(np.int64)
    bits = np.zeros(n + (1 << q), np.uint8)
    bits[quotient + np.arange(n)] = 1
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"".join((np.array([n, q], np.int64).tobytes(), np.packbits(bits).tobytes(), _planes(left & _mask(rest), rest),
                     _planes(right, half), small.tobytes(), counts[counts >= 255].astype(np.int64).tobytes()))


def decode(raw: bytes, shard: int, spare: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, q = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at, size = 16, n + (1 << q)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size)
    at += -(-size // 8)
    quotient = (np.flatnonzero(bits) - np.arange(n)).astype(np.uint64)
    rest, at = _from_planes(raw, at, n, spare - q)
    right, at = _from_planes(raw, at, n, half)
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, -1, at + n)
    lead = np.uint64(shard) << np.uint64(spare) if spare < 64 else np.uint64(0)
    return lead | (quotient << np.uint64(spare - q)) | rest, right, counts


def _filters(blocks: pa.Table, replies: pa.Table, width: int, shard_bits: int) -> pa.Table:
    """The filters of one block, a row for every phrase length and shard."""
    if not blocks.num_rows:
        return _FILTER_SCHEMA.empty_table()
    number = dict(zip(replies.column("word").cast(pa.binary()).to_pylist(), replies.column("id").to_pylist()))
    ids = [np.array([number.get(t, 0) for t in tokens], np.int64) for tokens in _tokens(blocks.column("body")[0].as_py())]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    out = {"words": [], "shard": [], "filter": []}
    for n in range(2, LONGEST + 1):
        half = _half(n, width)
        lefts, rights, counts = [], [], []
        for at in range(0, max(len(ids) - n + 1, 0), SLICE):
            part = ids[at:at + SLICE + n - 1]
            columns = [part[j:len(part) - n + 1 + j] for j in range(n)]
            whole = np.logical_and.reduce([c > 0 for c in columns])
            left, right, c = tally(*permute(*pack([c[whole] for c in columns], width), half), None, half)
            lefts.append(left), rights.append(right), counts.append(c)
        if not lefts:
            continue
        left, right, c = (lefts[0], rights[0], counts[0]) if len(lefts) == 1 else tally(
            np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts), half)
        lead = min(shard_bits, half)
        spare = half - lead
        shard = (left >> np.uint64(spare)).astype(np.int64) if spare < 64 else np.zeros(len(left), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
        for a, b in zip(edges, [*edges[1:], len(shard)]):
            out["words"].append(n)
            out["shard"].append(shard[a])
            out["filter"].append(encode(left[a:b], right[a:b], c[a:b], spare, half))
    return pa.Table.from_pydict(out, schema=_FILTER_SCHEMA)


def _merge(key: tuple, filters: pa.Table, width: int, shard_bits: int, least: int) -> pa.Table:
    """Phrases of one shard that reach ``least``."""
    n, shard = key[0].as_py(), key[1].as_py()
    half = _half(n, width)
    spare = half - min(shard_bits, half)
    parts = [decode(f.as_py(), shard, spare, half) for f in filters.column("filter")]
    left, right, counts = tally(*(np.concatenate(x) for x in zip(*parts)), half)
    keep = counts >= least
    ids = np.stack(unpack(*restore(left[keep], right[keep], half), n, width), axis=1).astype(np.int64)
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n)
    return pa.Table.from_arrays([pa.array(np.full(len(ids), n, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids.ravel())),
                                 pa.array(counts[keep])], schema=_GRAM_SCHEMA)


# --- the operator --------------------------------------------------------------

def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30,
                     block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of 1 to 4 words seen ``least``
    times or more, (lang, n) with all word occurrences)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    blocks = C.stage(rows.mapInArrow(lambda b: _blocks(b, block_bytes), _BLOCK), "pieces")
    asked = blocks.mapInArrow(_ask, _ASK).repartition("lang", "word")
    word = Window.partitionBy("lang", "word")
    asked = asked.withColumn("total", F.sum("n").over(word)).where(f"word = '' OR total >= {least}").sortWithinPartitions("lang", "word")
    bits = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, 1).bit_length()
    known = C.stage(asked.select("block", "lang", "word", "total").mapInArrow(lambda b: _number(b, bits), _KNOWN), "words")
    dictionary = known.where("first AND word <> ''").select("lang", "id", "word", "total")
    sums = known.where("first AND word = ''").select("lang", F.col("total").alias("n"))
    facts = known.agg(F.max("id").alias("id"), F.sum(F.when(F.col("first") & (F.col("word") == ""), F.col("total"))).alias("n")).first()
    width = max(int(facts["id"] or 1).bit_length(), 1)
    if width > MOST_BITS:
        raise ValueError(f"word numbers of {width} bits: at most {MOST_BITS} fit")
    shard_bits = max(0, (-(-int(facts["n"] or 0) // shard_words) - 1).bit_length()) if facts["n"] else 0
    replies = known.where("word <> ''").select("block", "word", "id")
    filters = (blocks.groupBy("block").cogroup(replies.groupBy("block"))
               .applyInArrow(lambda a, b: _filters(a, b, width, shard_bits), _FILTER))
    grams = filters.groupBy("words", "shard").applyInArrow(lambda k, t: _merge(k, t, width, shard_bits, least), _GRAM)
    grams = C.stage(grams, "grams").withColumn("gram", F.monotonically_increasing_id())
    spelled = (grams.select("gram", "words", "f", F.posexplode("ids").alias("at", "id")).join(dictionary.drop("total"), "id")
               .groupBy("gram", "words", "f", "lang")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    single = dictionary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("total").alias("f"))
    return C.stage(single.unionByName(spelled.select("lang", "phrase", "words", "f")), "phrases"), sums


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, most: int = 2000,
                 block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each
    language."""
    phrases, sums = frequent_phrases(docs, lang_col, text_col, least, block_bytes, shard_words)
    candidates = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    head = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cut = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(8, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # the most frequent longer candidate around each phrase
    inner = candidates.where(F.size("w") > 2).select(
        "lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("start"))
    longer = (inner.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    wide = "DECIMAL(38, 0)"
    left = lowest.join(longer, ["lang", "phrase"], "left").where(
        f"around IS NULL OR CAST(around AS {wide}) * 100 < CAST(a AS {wide}) * 80")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                          F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
