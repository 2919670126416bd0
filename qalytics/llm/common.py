"""Shared helpers: table access, lineage cuts, bounded-memory batches, hashing
of words and shingles, rarity ranks, and connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics.session import fresh_shared_path

# Text bytes handled at once inside a Python worker (bounds its memory).
CHUNK_BYTES = 500_000
# Bytes of rows that Spark hands to a Python worker at once (a longer single
# row goes alone): its default counts rows, so long texts would add up.
BATCH_BYTES = 4_000_000
# Slots of the bitmap that tells which documents a second scan must look at.
ID_SLOTS = 1_048_573


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (clusters that deploy it, by --py-files or otherwise, find it first), and
    bound the bytes that they get at once."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the
    lineage is cut and the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_shared_path(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also fold other alphabets)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda that names
    an outer expression would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_slices(batch: pa.RecordBatch, column: str = "text",
                most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of ``batch`` holding about ``most`` text bytes each (a longer
    single text is a part of its own), with the texts as bytes; null is empty."""
    texts = batch.column(column)
    start = size = 0
    held: list[bytes] = []
    for i, value in enumerate(texts):
        raw = value.as_py()
        raw = raw.encode() if raw is not None else b""
        if held and size + len(raw) > most:
            yield batch.slice(start, i - start), held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield batch.slice(start), held


# --- word and shingle hashes ---------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240210)).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word ``[^\\x20\\x09-\\x0D]+`` of the
    texts with A-Z lower-cased, in order. Words are polynomials over their
    bytes, taken from one running sum over the whole chunk."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer((b"\n".join(texts) + b"\n").lower(), dtype=np.uint8)
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[raw] * _power(_BASE, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(_ODD))
    begins = np.cumsum(sizes) - sizes
    return np.searchsorted(begins, starts, side="right") - 1, h


def shingle_hashes(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text, the hashes of its ``k``-word shingles in order (repeats kept);
    a text of fewer words has its whole word sequence as one shingle."""
    owner, h = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(counts)
    acc = h
    for j in range(1, k):
        acc = mix(acc[:-1] * np.uint64(_ODD) + h[j:]) if len(acc) > 1 else acc[:0]
    out = []
    for i, n in enumerate(counts):
        s = last[i] - n
        if n >= k:
            out.append(acc[s:last[i] - k + 1])
        elif n:
            with np.errstate(over="ignore"):
                one = np.uint64(n) * np.uint64(_BASE)
                for x in h[s:last[i]]:
                    one = mix(np.array([one * np.uint64(_ODD) + x]))[0]
            out.append(np.array([one], dtype=np.uint64))
        else:
            out.append(h[:0])
    return out


def rare_first(h: np.ndarray, rank: np.ndarray, bits: int) -> np.ndarray:
    """Distinct tokens as sorted non-negative longs, rarest first: the low
    ``bits`` of the hash, which name its frequency bucket, are replaced by the
    bucket's rank and moved to the front."""
    bucket = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    code = (rank[bucket].astype(np.uint64) << np.uint64(63 - bits)) | (h >> np.uint64(bits + 1))
    return np.unique(code.astype(np.int64))


# --- connected components ------------------------------------------------------

def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; the root is the
    smallest node it reaches.

    Alternating large-star and small-star steps: every node points its larger
    (then all its smaller) neighbours at its smallest neighbour, until nothing
    changes. Each step is a grouped minimum and a join, written to the shared
    folder; no neighbourhood is ever collected."""
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u")
        small = (hop.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(hop.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        then = stage(small, "edges")
        # a star forest: no root points on, and every node has one root
        count = then.agg(F.count("*"), F.countDistinct("u")).first()
        chained = not then.join(then.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        now = then
        if count[0] == count[1] and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
