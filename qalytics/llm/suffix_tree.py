"""LM scoring by a probabilistic suffix tree.

A text is the byte sequence of its words (A-Z lower-cased, whitespace runs as
one space) and one end symbol. The tree's states are contexts of up to
``DEPTH`` symbols. Counting and testing are grouped sums and joins:

* Count: texts are cut into blocks of about ``BLOCK_BYTES``. Every block asks
  for its distinct words and its distinct runs of ``DEPTH + 1`` symbols, with
  their numbers in training texts, so a run that is everywhere moves once a
  block, not once an occurrence. Runs of ``DEPTH`` symbols are counted before,
  and shorter ones are their sums.
* Divergence test, shortest contexts first: a context stays if its smoothed
  next-symbol distribution predicts its own occurrences, each left out in
  turn, better than the longest kept suffix does, by ``LEAST_GAIN`` decimal
  digits in all.
* Smoothing: absolute discount, the mass taken going to the distribution of
  the longest kept suffix; the root adds 0.1 to each of the 256 symbols. Every
  state's distribution sums to one.
* Score: the state of a position is its longest kept suffix, so one value per
  distinct run gives every position. Values travel back to the blocks that
  asked (at most one row a block and run), where texts are summed.

The requests are shuffled once, by the symbols between the first and the last
of a run: a context's continuations and the runs they fall back on lie
together, and windows over them give each request its value. There are at most
65,536 such runs and a block asks once for each, so a group grows with the
number of blocks only. Nothing is broadcast by hand and nothing but two totals
is a scalar.

Results: null text is empty (one end token); a null id counts as training and
is returned as null; repeated rows are scored each; an empty table gives an
empty frame; other columns are ignored. Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

DEPTH = 5               # symbols in the longest context
BLOCK_BYTES = 24_000_000
CHUNK = 1_000_000       # symbols turned into runs at once
DISCOUNT = 0.75
LEAST_GAIN = 2.0        # decimal digits
ROOT_MASS = 0.1
END = b"\n"             # the end symbol; also what precedes a text
END_WORD = -1           # key of the end token among the words

_BLOCK = "block long, ids binary, nulls binary, held binary, sizes binary, body binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "nulls", "held", "sizes", "body")]])
_ASK = "block long, key long, n long"
_ASK_SCHEMA = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
_COUNT = "code long, n long"
_COUNT_SCHEMA = pa.schema([("code", pa.int64()), ("n", pa.int64())])
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, owned long"
_SCORED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                            ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("owned", pa.int64())])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


# --- blocks --------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of normalised texts, numbered by task and place in it."""
    number = TaskContext.get().partitionId() << 24
    ids, nulls, held, bodies, size = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        row = {"block": [number], "ids": [np.array(ids, np.int64).tobytes()], "nulls": [np.array(nulls, np.uint8).tobytes()],
               "held": [np.array(held, np.uint8).tobytes()], "sizes": [np.array([len(b) for b in bodies], np.int64).tobytes()],
               "body": [zstandard.compress(b"".join(bodies), 3)]}
        return pa.RecordBatch.from_pydict(row, schema=_BLOCK_SCHEMA)

    for batch in batches:
        for part, texts in C.text_slices(batch, "text"):
            for doc_id, out, text in zip(part.column("doc_id").to_pylist(), part.column("held").to_pylist(), texts):
                body = b" ".join(text.lower().split())
                if bodies and size + len(body) > block_bytes:
                    yield flush()
                    number += 1
                    ids, nulls, held, bodies, size = [], [], [], [], 0
                ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                held.append(out)
                bodies.append(body)
                size += len(body) + 1
    if bodies:
        yield flush()


def _texts(row: dict) -> list[bytes]:
    """The texts of one block row."""
    raw = zstandard.decompress(row["body"])
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
    return [raw[e - s:e] for s, e in zip(np.frombuffer(row["sizes"], np.int64), ends)]


# --- runs of symbols and words -------------------------------------------------

def _grouped(pieces: Iterator[tuple[int, bytes, int]]) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (text number, bytes) of about ``CHUNK`` bytes; few enough texts
    that a run and a text's place in the list fit 64 bits."""
    held, size = [], 0
    for j, piece, length in pieces:
        if held and (size + length > CHUNK or len(held) == 1 << 15):
            yield held
            held, size = [], 0
        held.append((j, piece))
        size += length
    if held:
        yield held


def _runs(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, run of ``depth + 1`` symbols) of every predicted symbol;
    a long text comes in parts that overlap by their contexts."""
    def parts():
        for j, text in enumerate(texts):
            s = END * depth + text + END
            for at in range(0, len(s) - depth, CHUNK):
                piece = s[at:at + CHUNK + depth]
                yield j, piece, len(piece)

    for group in _grouped(parts()):
        raw = np.frombuffer(b"".join(p for _, p in group), np.uint8).astype(np.uint64)
        sizes = np.array([len(p) for _, p in group])
        code = np.zeros(len(raw) - depth, np.uint64)
        for j in range(depth + 1):
            code = (code << np.uint64(8)) | raw[j:len(raw) - depth + j]
        inside = np.ones(len(raw), bool)
        starts = np.cumsum(sizes) - sizes
        inside[(starts[:, None] + np.arange(depth)).ravel()] = False
        yield np.repeat([j for j, _ in group], sizes - depth), code[inside[depth:]].astype(np.int64)


def _words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, key) of every word; keys are negative."""
    def parts():
        for j, text in enumerate(texts):
            at = 0
            while at < len(text):
                stop = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
                stop = len(text) if stop < 0 else stop
                yield j, text[at:stop], stop - at
                at = stop + 1

    for group in _grouped(parts()):
        if len(group) == 1 and len(group[0][1]) > 2 * CHUNK:  # few, very long words
            words = group[0][1].split()
            h = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest()) if len(w) > CHUNK
                          else C.word_hashes([w])[1][0] for w in words], np.uint64)
            owner = np.zeros(len(h), np.int64)
        else:
            owner, h = C.word_hashes([p for _, p in group])
        yield np.array([j for j, _ in group])[owner], (h | np.uint64(1 << 63)).view(np.int64)


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.diff(k, prepend=k[0] - 1)) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _parts(row: dict) -> tuple[list[bytes], list[bytes]]:
    """The training and the held-out texts of a block."""
    texts, held = _texts(row), np.frombuffer(row["held"], np.uint8)
    return [t for t, h in zip(texts, held) if not h], [t for t, h in zip(texts, held) if h]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _counted(parts: tuple[list[bytes], list[bytes]], keys_of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block's texts with their training counts."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for training, texts in zip((1, 0), parts):
        for _, k in keys_of(texts):
            u, n = np.unique(k, return_counts=True)
            keys.append(u)
            counts.append(n * training)
            if sum(map(len, keys[1:])) > max(CHUNK, len(keys[0])):
                keys, counts = ([x] for x in _tally(keys, counts))
    return _tally(keys, counts)


def _count(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """Distinct runs of ``symbols`` symbols with their training counts, summed
    over the blocks of a task (``CHUNK`` runs are held at most, about)."""
    keys, counts = [], []
    for row in _rows(batches):
        k, n = _counted(_parts(row), lambda texts: _runs(texts, symbols - 1))
        k, n = _tally([*keys, k], [*counts, n])
        keys, counts = [k], [n]
        if len(k) > CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], schema=_COUNT_SCHEMA)
            keys, counts = [], []
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0].astype(np.int64))], schema=_COUNT_SCHEMA)


def _ask(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Distinct words and runs of a block with their training counts."""
    for row in _rows(batches):
        parts = _parts(row)
        k, n = _tally([np.array([END_WORD])], [np.array([len(parts[0])])])
        for keys_of in (_words, lambda texts: _runs(texts, depth)):
            more, counts = _counted(parts, keys_of)
            k, n = _tally([k, more], [n, counts])
        for at in range(0, len(k), 250_000):
            part = slice(at, at + 250_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), row["block"])), pa.array(k[part]),
                                              pa.array(n[part].astype(np.int64))], schema=_ASK_SCHEMA)


# --- the tree ------------------------------------------------------------------

def _suffix(code: Column, symbols: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def _smoothed(group: list[str], once: Column, least_gain: float) -> tuple[dict[str, Column], Column]:
    """(columns to add, then the probability) for rows with a run's ``total``
    count, the probability ``back`` of its last symbol after a shorter context,
    and the run's context in ``group``. ``once`` marks one row of each run."""
    context = Window.partitionBy(*group)
    n, of, kinds, back, zero = F.col("total"), F.col("of"), F.col("kinds"), F.col("back"), F.lit(0.0)
    sums = {"of": F.sum(F.when(once, n)).over(context), "kinds": F.count_if(once & (n > 0)).over(context)}
    own = F.greatest(n - DISCOUNT, zero) / of + DISCOUNT * kinds / of * back
    left_out = (F.greatest(n - 1 - DISCOUNT, zero) + DISCOUNT * (kinds - (n == 1).cast("int")) * back) / (of - 1)
    gain = F.sum(F.when(once & (of > 1) & (n > 0), n * F.log10(left_out / back)).otherwise(zero)).over(context)
    return sums, F.when((of > 1) & (gain >= least_gain), own).otherwise(back)


def tree_values(runs: DataFrame, symbols: int, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(code, p) of runs of ``symbols`` symbols (code, n): the probability of
    the last one after its longest kept context. Runs that don't occur in
    training texts have n = 0."""
    counts = {symbols: runs}
    for k in range(symbols - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy(_suffix(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(F.shiftright("code", 8))   # of single symbols: at most 256 rows
    values = counts[1].withColumn("p", (F.col("n") + ROOT_MASS) / (F.sum("n").over(whole) + 256 * ROOT_MASS)).select("code", "p")
    for k in range(2, symbols + 1):
        step = counts[k].select("code", F.col("n").alias("total"), F.shiftright("code", 8).alias("context"),
                                _suffix(F.col("code"), k - 1).alias("tail"))
        step = step.join(values.select(F.col("code").alias("tail"), F.col("p").alias("back")), "tail")
        sums, p = _smoothed(["context"], F.lit(True), least_gain)
        values = step.withColumns(sums).withColumn("p", p).select("code", "p")
    return values


def replies(asked: DataFrame, shorter: DataFrame, depth: int, least_gain: float) -> DataFrame:
    """(block, key, value) for every request: of a run the logarithm of its
    probability, of a word its training count, below zero in all blocks but
    the first one that asked."""
    key, word = F.col("key"), F.col("key") < 0
    # the shorter run that a run falls back on ends it, without its first symbol
    between = F.when(word, key).when(F.col("block").isNull(), F.shiftright(key, 8)).otherwise(_suffix(F.shiftright(key, 8), depth - 1))
    known = shorter.select(F.lit(None).cast("long").alias("block"), F.col("code").alias("key"), F.lit(0).cast("long").alias("n"),
                           F.col("p").alias("back"))
    rows = asked.withColumn("back", F.lit(None).cast("double")).unionByName(known).repartition(between)
    rows = rows.withColumns({"between": between, "last": F.when(word, F.lit(0).cast("long")).otherwise(_suffix(key, 1))})
    rows = rows.withColumn("back", F.max("back").over(Window.partitionBy("between", "last"))).where("block IS NOT NULL")
    rows = rows.withColumn("context", F.when(word, key).otherwise(F.shiftright(key, 8)))
    run = Window.partitionBy("between", "context", "last")
    rows = rows.withColumns({"total": F.sum("n").over(run), "owner": F.min("block").over(run)})
    sums, p = _smoothed(["between", "context"], F.col("block") == F.col("owner"), least_gain)
    rows = rows.withColumns(sums).withColumn("p", p)
    count = F.when(F.col("block") == F.col("owner"), F.col("total")).otherwise(-F.col("total"))
    return rows.select("block", "key", F.when(word, count.cast("double")).otherwise(F.log10("p").cast("float").cast("double")).alias("value"))


# --- scoring -------------------------------------------------------------------

def _score_block(blocks: pa.Table, replies: pa.Table, depth: int) -> pa.Table:
    if not blocks.num_rows:
        return _SCORED_SCHEMA.empty_table()
    row = blocks.to_pylist()[0]
    texts = _texts(row)
    keys = replies.column("key").to_numpy()
    order = np.argsort(keys)
    keys, value = keys[order], replies.column("value").to_numpy()[order]
    first = np.searchsorted(keys, 0)
    size = len(texts)
    score, logs, known, words = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for owner, code in _runs(texts, depth):
        # sorted with their texts' numbers, equal runs are looked up once
        low = int(owner[0])
        shift = np.uint64(int(owner[-1] - low).bit_length())
        both = (code.astype(np.uint64) << shift) | (owner - low).astype(np.uint64)
        both.sort()
        code = (both >> shift).astype(np.int64)
        new = np.flatnonzero(np.diff(code, prepend=-1))
        found = value[first + np.searchsorted(keys[first:], code[new])]
        owner = (both & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
        part = np.bincount(owner, np.repeat(found, np.diff(np.append(new, len(code)))))
        score[low:low + len(part)] += part
    for owner, key in _words(texts):
        c = np.abs(value[np.searchsorted(keys[:first], key)])
        logs += np.bincount(owner, np.log10(c + 0.1), size)
        known += np.bincount(owner[c > 0], minlength=size)
        words += np.bincount(owner, minlength=size)
    c = abs(value[np.searchsorted(keys[:first], END_WORD)])
    owned = np.zeros(size, np.int64)
    owned[0] = int((value[:first] > 0).sum())
    ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
    return pa.Table.from_arrays([ids, pa.array(np.frombuffer(row["held"], np.uint8).astype(bool)), pa.array(words + 1),
                                 pa.array(known + int(c > 0)), pa.array(logs + np.log10(c + 0.1)), pa.array(score),
                                 pa.array(owned)], schema=_SCORED_SCHEMA)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                least_gain: float = LEAST_GAIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       is_held_out(F.col(id_col)).alias("held"))
    blocks = C.stage(rows.mapInArrow(lambda b: _blocks(b, block_bytes), _BLOCK), "texts")
    counts = blocks.mapInArrow(lambda b: _count(b, depth), _COUNT).groupBy("code").agg(F.sum("n").alias("n"))
    shorter = C.stage(tree_values(C.stage(counts, "runs"), depth, least_gain), "tree")
    answers = replies(blocks.mapInArrow(lambda b: _ask(b, depth), _ASK), shorter, depth, least_gain)
    scored = (blocks.groupBy("block").cogroup(answers.groupBy("block"))
              .applyInArrow(lambda a, b: _score_block(a, b, depth), _SCORED))
    scored = C.stage(scored, "scored")
    tokens = scored.where("not held_out").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).scalar()
    kinds = scored.agg(F.coalesce(F.sum("owned"), F.lit(0)).alias("v")).scalar()
    base = F.col("logs") - F.col("n_tokens") * F.log10(tokens + 0.1 * (kinds + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", tokens.cast("long").alias("train_tokens"),
                         base.alias("base_score"), "score")
