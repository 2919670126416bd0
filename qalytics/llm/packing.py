"""Best-fit packing of token sequences by a configuration linear program.

Method. Every document is tokenised and cut into pieces of at most ``capacity``
tokens (only longer documents are cut). The histogram of piece lengths, at most
``capacity`` rows whatever the corpus size, goes to the driver, where the
packing over configurations (multisets of lengths that fit one sequence) is
solved by multiplicative weights: lengths carry weights that shrink as they are
covered, an unbounded-knapsack dynamic program over the capacity prices
configurations, and each round adds many of them: their first pieces are drawn
by weight, the knapsack fills the rest. They are rounded to whole sequences,
fullest first, within the stock. What is left over, a few pieces in a hundred,
is packed by best fit decreasing on the histogram. The result is a table of
(length, rank range) -> (sequence, offset) rules, bounded by the configurations
kept; pieces are ranked within their length and joined to it, so no piece
passes through the driver.

Defined results. Null text is empty; an empty document is the end id alone.
Pieces of one length are interchangeable: they are ranked in id order, and ties
(repeated ids) by their content. A null id sorts first. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalytics.llm import common as C

CAPACITY = 4096
# Rounds of the configuration program; it ends sooner when all but this share
# of the pieces is packed.
ROUNDS = 60
REMAINDER = 0.03
# How fast weights answer coverage, and the powers of a length by which longer
# pieces are preferred, tried in turn.
RATE = 3.0
BIAS = (4, 16)
# Configurations accepted and piece places drawn in one round, at most: they
# bound the rules.
COLUMNS = 4096
ENTRIES = 20_000
# Words whose ids a worker remembers.
MEMORY = 200_000
# Text bytes encoded at once: each distinct word in them is looked up once.
SLICE_BYTES = 2_000_000
# Rows of one length that one window task ranks.
RANK_ROWS = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words:
    """Token ids of white-space separated words. Two generations of at most
    ``MEMORY`` words are remembered: words met again move to the young one.

    The vocabulary's pre-tokenizer never joins characters across white space
    and always parts a small letter (of Latin-1) from a following point or comma, so a
    text's ids are its words' ids one after another. Texts that hold a special
    token, in any case, are encoded whole: it is recognised as it is spelled,
    before words are lower-cased."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Latin-1 small letters as the byte-level model spells them
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [c for c in map(chr, range(0xAA, 0x100)) if c.isalpha() and c.islower()]
        self.letters = str.maketrans({c: spell(c)[0][0] for c in letters})
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, words: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        easy, hard = [], []
        for w in words:
            # small letters up to Latin-1 are a single pre-token, composed already
            (easy if w.isalpha() and w.islower() and (w.isascii() or max(w) <= "\xff") else hard).append(w)
        ids = [[t.id for t in tokenize(w if w.isascii() else w.translate(self.letters))] for w in easy]
        ids += [e.ids for e in self.tokenizer.encode_batch(hard, add_special_tokens=False)]
        raw = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32).tobytes()
        ends = itertools.accumulate(4 * len(i) for i in ids)
        begin = 0
        for w, end in zip(easy + hard, ends):
            self.known[w] = raw[begin:end]
            begin = end

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        lower = [t.lower() for t in texts]
        whole = {i: texts[i].decode() for i, t in enumerate(lower) if any(s in t for s in self.special)}
        out = self._by_words([b"" if i in whole else t for i, t in enumerate(texts)])
        for i, text in whole.items():
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return out

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        column = pc.replace_substring_regex(pc.ascii_lower(pa.array([t.decode() for t in texts], pa.string())), r"([a-zß-öø-ÿ])([.,])", r"\1 \2")
        split = pc.ascii_split_whitespace(column)
        words = split.values.dictionary_encode()
        per_text = np.diff(split.offsets.to_numpy())
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        names = words.dictionary.to_pylist()
        fresh = [w for w in names if w not in self.known]
        self.known.update((w, self.older[w]) for w in fresh if w in self.older)
        self._learn([w for w in fresh if w not in self.known])
        ids = [self.known[w] for w in names]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        begin = np.cumsum(sizes) - sizes
        w = words.indices.to_numpy()
        each = sizes[w]
        done = np.cumsum(each)
        out = flat[np.repeat(begin[w] - (done - each), each) + np.arange(int(each.sum()))]
        bounds = np.concatenate(([0], done))[np.concatenate(([0], np.cumsum(per_text)))]
        return np.split(out, bounds[1:-1]) if len(texts) else []


@functools.lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """One vocabulary per worker, kept between its tasks."""
    return Words(path)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for part, texts in C.text_slices(batch, most=SLICE_BYTES):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode(texts)):
                    own = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for j, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s:s + capacity]
                        rows.append((doc, j, s, len(cut), zlib.crc32(cut.tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(tokenizer_path, end_id, capacity), PIECES)


def _price(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: per room, the last piece of
    the configuration of greatest price that fits it (0: no piece adds one)."""
    low, high = int(lengths.min()), int(lengths.max())
    value = np.full(capacity + 1, -np.inf)
    value[lengths] = prices
    best = np.zeros(capacity + 1)  # best[capacity - c] belongs to room c
    pick = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(low, capacity + 1):
        most = min(c, high)
        gain = best[capacity - c + low:capacity - c + most + 1] + value[low:most + 1]
        j = int(gain.argmax())
        before = best[capacity - c + 1]
        if gain[j] > before:
            best[capacity - c], pick[c] = gain[j], j + low
        else:
            best[capacity - c] = before
    return pick


def _columns(stock: np.ndarray, weights: np.ndarray, pick: np.ndarray, n: int, rest: float, random: np.random.Generator) -> np.ndarray:
    """``n`` configurations, longest pieces first, 0 after the last: pieces are
    drawn in proportion to stock and weight while there is more room than
    ``rest``, the knapsack fills what is left. No length comes more often than
    it is in stock."""
    capacity = len(stock) - 1
    sums = np.cumsum(stock * weights)
    sums /= sums[-1]
    filled = np.maximum.accumulate(np.where(pick > 0, np.arange(capacity + 1), 0))
    room, taken, more = np.full(n, capacity), [], np.ones(n, dtype=bool)
    while more.any():
        piece = np.searchsorted(sums, random.random(n) * sums[room], side="right")
        more &= piece <= room
        taken.append(np.where(more, piece, 0))
        room = room - taken[-1]
        more &= room > rest
    room = filled[room]
    while room.any():
        taken.append(pick[room])
        room = filled[room - taken[-1]]
    rows = np.sort(np.stack(taken, axis=1), axis=1)[:, ::-1]
    at = np.arange(rows.shape[1])
    fresh = np.diff(rows, axis=1, prepend=-1) != 0
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0), axis=1)
    return np.where(nth < stock[rows], rows, 0)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: each sequence starts with the
    longest piece and takes, again and again, the longest that still fits.
    Equal sequences are made together."""
    stock = {n: m for n, m in left.items() if m}
    order = sorted(stock)
    made: list[tuple[tuple[int, ...], int]] = []
    while order:
        room, took = capacity, Counter()
        i = len(order) - 1
        while i >= 0:
            n = order[i]
            m = min(stock[n], room // n)
            if m:
                took[n] += m
                room -= m * n
            i = min(i - 1, int(np.searchsorted(order, room, side="right")) - 1)
        times = min(stock[n] // m for n, m in took.items())
        made.append((tuple(took.elements()), times))
        for n, m in took.items():
            stock[n] -= m * times
        order = [n for n in order if stock[n]]
    return made


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times) covering the histogram exactly, in few sequences."""
    program, rest = _best_program(histogram, capacity, rounds)
    return program + rest


def _count(configurations: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in configurations)


def _best_program(histogram: dict[int, int], capacity: int, rounds: int) -> tuple[list, list]:
    """What the configuration program packs and its remainder. Where long
    pieces are many, the program is solved again with more weight on them, and
    the solution of fewest sequences stays."""
    bound = -(-sum(n * m for n, m in histogram.items()) // capacity)
    best = None
    for bias in BIAS:
        found = _program(histogram, capacity, rounds, bias)
        count = _count(found[0]) + _count(found[1])
        if best is None or count < best[0]:
            best = count, found
        if count <= 1.001 * bound + 1:
            break
    return best[1]


def _program(histogram: dict[int, int], capacity: int, rounds: int, bias: int) -> tuple[list, list]:
    """One solution: what the configuration program packs, and its remainder
    by best fit."""
    made: Counter = Counter()
    if histogram.get(capacity):
        made[(capacity,)] = histogram[capacity]
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for n, m in histogram.items():
        if n < capacity:
            stock[n] = m
    sizes = np.arange(capacity + 1)
    start, total, tokens = np.maximum(stock, 1), stock.sum(), int(stock @ sizes)
    random = np.random.default_rng(0)  # reruns agree
    for _ in range(rounds):
        left = int(stock @ sizes)
        if stock.sum() <= REMAINDER * total:
            break
        # Multiplicative weights on the covering program: covered / stock is to
        # grow evenly; a length that is ahead weighs less. Its price starts at
        # its share of a sequence, the dual of a perfect packing, and is moved
        # by its weight and, among equals, at random.
        lengths = np.flatnonzero(stock)
        weights = np.exp(RATE * (stock / start - left / tokens))
        prices = sizes / capacity * weights ** 0.02 * (1 + 1e-4 * random.random(capacity + 1))
        pick = _price(lengths, prices[lengths], capacity)
        mean = left / stock.sum()
        wanted = max(1.0, min(tokens / capacity / 8, left / capacity / 2))
        n = int(min(COLUMNS, max(64, ENTRIES * mean / capacity), np.ceil(wanted)))
        step = max(1, int(wanted / n))
        rows = _columns(stock, weights * (sizes / capacity) ** bias, pick, 3 * n, min(capacity / 2, 2 * mean), random)
        rows = rows[np.argsort(-rows.sum(axis=1), kind="stable")]
        # Rounding: the fullest first, whole times only, never more of a
        # length than is left of it.
        count = 0
        for row in rows:
            own, m = np.unique(row[row > 0], return_counts=True)
            here = np.minimum(m, stock[own])
            if own @ here < 0.995 * (own @ m):
                continue
            own, m = own[here > 0], here[here > 0]
            times = min(step, int((stock[own] // m).min()))
            stock[own] -= m * times
            made[tuple(np.repeat(own, m).tolist())] += times
            count += times
            if count >= wanted:
                break
    return list(made.items()), _best_fit({int(n): int(stock[n]) for n in np.flatnonzero(stock)}, capacity)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank from 0 of every piece within its length. A length may hold a third
    of all pieces, so pieces are dealt into buckets of their id, ranked within
    (length, bucket) and moved on by the buckets before."""
    total = pieces.count()
    buckets = max(1, -(-total // RANK_ROWS))
    key = ["length", "__bucket"]
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*key, (F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("__rank", within).join(before, key).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__bucket", "__before")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules, used, sequence = [], Counter(), 0
    for config, times in solve(histogram, capacity, rounds):
        offset = 0
        for n in config:
            rules.append((n, used[n], used[n] + times, sequence - used[n], offset))
            used[n] += times
            offset += n
        sequence += times
    # At most (configurations kept) x (pieces in one) rules, bounded by
    # ``rounds`` and ``ENTRIES`` whatever the corpus; workers find a piece's
    # rule by binary search.
    shared = spark.sparkContext.broadcast(np.array(sorted(rules), dtype=np.int64).reshape(-1, 5))
    ranked = _ranked(pieces)
    kept = [f for f in ranked.schema if f.name != "__rank"]
    out = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            rule = np.searchsorted(starts, batch.column("length").to_numpy() * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(rank + table[rule, 3]), pa.array(table[rule, 4])],
                names=out.names)

    return ranked.mapInArrow(place, out)


def packed_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text)."""
    pieces = C.stage(tokenized_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
