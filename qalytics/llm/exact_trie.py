"""Exact dedup: Patricia-trie owners.

Method. Texts (A-Z lower-cased) are inserted as whole byte strings into
compressed radix tries; a terminal node keeps the owner of its text and the
number of rows that ended there. Map tasks first insert their own rows, chunk
by chunk, so a group of copies leaves each chunk as one row before anything is
shuffled. Rows are then partitioned by text length and content hash and arrive
sorted by them, and a trie holds one (length, hash) subtree at a time: when the
sorted stream has passed it, its terminals are written out and its memory is
given back. The external sort does the spilling; no task holds more than the
different texts of one length and one hash.

Defined results. Null text counts as empty; all empty texts are one group.
The owner is the largest id (or the smallest, ``keep="smallest"``); null ids
lose against any id. Rows that repeat an id and text are all marked kept when
their id is the owner's: they are one document. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalytics.llm import common as C


# Text bytes that a map task's trie holds before it is written out.
HELD_BYTES = 16_000_000


class Node:
    """A trie node: the bytes on its edge, its children by first byte, and,
    where a text ends, that text's owner and number of rows."""

    __slots__ = ("edge", "children", "owner", "rows")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner, self.rows = edge, {}, None, 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling halves of byte comparisons."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo] != b[lo] else hi


class Trie:
    """Whole byte strings with owners."""

    def __init__(self, better=max):
        self.root, self.better = Node(b""), better

    def insert(self, text: bytes, owner: int | None, rows: int = 1) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                node = child
                break
            n = _common(child.edge, text[at:at + len(child.edge)])
            if n < len(child.edge):  # split the edge
                upper = Node(child.edge[:n])
                child.edge = child.edge[n:]
                upper.children[child.edge[0]] = child
                node.children[text[at]] = upper
                child = upper
            node, at = child, at + n
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)
        node.rows += rows
        return node

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        """(text, owner, rows) of every text held."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node.edge
            if node.rows:
                yield text, node.owner, node.rows
            stack.extend((child, text) for child in node.children.values())


COMBINED = "size long, hash long, body binary, owner long, members long"


def _combine(better):
    """Map side: one row per different text, as long as the trie of the texts
    so far holds at most ``HELD_BYTES``; then it is written out."""
    def combined(trie: Trie) -> pa.RecordBatch:
        rows = list(trie.terminals())
        return pa.RecordBatch.from_arrays(
            [pa.array([len(t) for t, _, _ in rows], pa.int64()),
             pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _, _ in rows], pa.int64()),
             pa.array([t for t, _, _ in rows], pa.binary()),
             pa.array([o for _, o, _ in rows], pa.int64()),
             pa.array([m for _, _, m in rows], pa.int64())],
            names=["size", "hash", "body", "owner", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Trie(better), 0
        for batch in batches:
            for part, texts in C.text_slices(batch):
                for text, i in zip(texts, part.column("doc_id").to_pylist()):
                    if trie.insert(text.lower(), i).rows == 1:
                        held += len(text)
                if held > HELD_BYTES:
                    yield combined(trie)
                    trie, held = Trie(better), 0
        yield combined(trie)
    return run


def _owners(better):
    """Reduce side: rows sorted by (size, hash); one subtree in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key = Trie(better), None
        out: list[tuple] = []

        def passed():
            out.extend((hashlib.sha256(t).hexdigest(), len(t), o, m) for t, o, m in trie.terminals())

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["sha", "size", "keep_id", "group_size"])
            out.clear()

        for batch in batches:
            for size, h, body, owner, members in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (size, h) != key:
                    passed()
                    trie, key = Trie(better), (size, h)
                    if len(out) >= 5_000:
                        yield from flush()
                trie.insert(body, owner, members)
        passed()
        yield from flush()
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in C.text_slices(batch):
            texts = [t.lower() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                 pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "text_sha256", "size"])


def text_owners(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(sha, size, keep_id, group_size) per different text of ``docs`` (doc_id, text)."""
    better = max if keep == "largest" else min
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_combine(better), COMBINED)
    return (rows.repartition("size", "hash").sortWithinPartitions("size", "hash")
            .mapInArrow(_owners(better), "sha string, size long, keep_id long, group_size long"))


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``.

    Every row meets its text's owner through the text's digest and length. That
    join carries no texts; a large group of copies is one owner row against
    many small rows, which AQE splits."""
    owners = text_owners(docs, keep)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _digests, "doc_id long, text_sha256 string, size long")
    return (rows.join(owners.withColumnRenamed("sha", "text_sha256"), ["text_sha256", "size"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
