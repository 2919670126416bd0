"""Ranked lexical search over geometrically blocked posting lists.

Documents are dealt into shards of at most about ``SHARD_POSTINGS`` postings
and ``DENSE`` cells. Within a shard every term's posting list is cut into blocks
of similar documents: about one in ``BLOCK`` of its documents is a centre, and
each document joins the centre nearest to it in a projection of the document
vectors. A block stores the coordinatewise maximum of its documents' vectors
over all terms, so the inner product with a query bounds the score of every
document in the block.

A query takes its lists by falling largest contribution and its blocks by
falling bound. A block is skipped only if its exact integer bound is below the
k-th best score found, and a list only if all lists still to come can't reach
that score together; everything else is scored in full. Results are therefore
exact whatever the clustering; it decides only how much is skipped.

Scale: the queries are a stated set, taken in batches of about ``BATCH_BYTES``
of text. A batch's vocabulary is sent to the tasks (its size follows the batch,
never the documents); one scan of the texts writes their lengths and their
occurrences of that vocabulary. Terms that no query of the batch holds can't
add to any score, so they get no postings; document lengths and counts cover
every term. A task indexes a shard, searches it and goes on to the next; a lost
task starts again from the written occurrences. Shards are independent; each
returns at most k rows a query, and a window of k rows a query joins them, so
no list, however frequent its term, meets in one task.

Results: null texts have no terms; a document without terms isn't counted;
rows that repeat an id are documents of their own, as are repeated items; a null
doc_id sorts last among equal scores; empty tables give empty frames; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

BATCH_BYTES = 250_000       # query text handled at once
SHARD_POSTINGS = 150_000
BLOCK = 64                  # documents in a block, about
PROJECTION = 32             # coordinates that the clustering sees
CHUNK = 2_000_000           # text bytes cut into terms at once
DENSE = 8_000_000           # cells (documents x terms) of a shard's table of vectors
NO_ID = np.iinfo(np.int64).max

# Digits, letters (upper case folded) and all bytes of other characters stay; the rest separates.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))

_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
_VECTOR_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_HIT = "query long, doc_id long, score long"
_HIT_SCHEMA = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


# --- terms ---------------------------------------------------------------------

def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``CHUNK`` bytes."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        stop = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in C.text_slices(batch, "text"):
            sizes, terms, tfs = [], [], []
            for text in texts:
                n, found = 0, Counter()
                for words in terms_of(text):
                    n += len(words)
                    found.update(filter(vocabulary.__contains__, words))
                sizes.append(n)
                terms.append([vocabulary[w] for w in found])
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int32()))], schema=_VECTOR_SCHEMA)


# --- index ---------------------------------------------------------------------

def _spans(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the entries of ``rows``, number of the row among them)."""
    sizes = ptr[rows + 1] - ptr[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - first[owner] + ptr[rows][owner], owner


def _block_of(docs: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Block number of each document of one posting list."""
    if len(docs) <= BLOCK:
        return np.zeros(len(docs), np.int64)
    centres = docs[::BLOCK]
    out = np.empty(len(docs), np.int64)
    for at in range(0, len(docs), 20_000):
        out[at:at + 20_000] = (sketch[docs[at:at + 20_000]] @ sketch[centres].T).argmax(1)
    return np.unique(out, return_inverse=True)[1]


def build_shard(ids: np.ndarray, nulls: np.ndarray, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int) -> dict:
    """The index of one shard; documents are rows of (ptr, terms, values)."""
    docs = len(ids)
    owner = np.repeat(np.arange(docs), np.diff(ptr))
    spread = np.random.Generator(np.random.PCG64(7)).integers(0, PROJECTION, size)
    sketch = np.zeros(docs * PROJECTION, np.float32)
    np.add.at(sketch, owner * PROJECTION + spread[terms], values.astype(np.float32))
    sketch = sketch.reshape(docs, PROJECTION)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1)
    order = np.argsort(terms, kind="stable")
    list_terms, first = np.unique(terms[order], return_index=True)
    bounds = [*first, len(order)]
    table = np.zeros((docs, size), np.int32)
    table[owner, terms] = values
    list_ptr, block_sizes, block_docs, sum_sizes, sum_terms, sum_max = [0], [], [], [], [], []
    for i in range(len(list_terms)):
        members = owner[order[bounds[i]:bounds[i + 1]]]
        block = _block_of(members, sketch)
        members = members[np.argsort(block, kind="stable")]
        block_docs.append(members)
        block_sizes.append(np.bincount(block))
        edges = np.concatenate([[0], np.cumsum(block_sizes[-1])])
        for a, b in zip(edges[:-1], edges[1:]):
            most = table[members[a:b]].max(0) if b - a > 1 else table[members[a]]
            held = np.flatnonzero(most)
            sum_sizes.append([len(held)])
            sum_terms.append(held.astype(np.int32))
            sum_max.append(most[held])
        list_ptr.append(list_ptr[-1] + len(block_sizes[-1]))

    def joined(parts: list) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    # the largest value of each list's own term
    peak = np.maximum.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)
    return {"ids": ids, "nulls": nulls, "doc_ptr": ptr, "doc_terms": terms, "doc_values": values, "list_terms": list_terms, "peak": peak,
            "list_ptr": np.array(list_ptr), "block_ptr": np.concatenate([[0], np.cumsum(joined(block_sizes))]),
            "block_docs": joined(block_docs), "sum_ptr": np.concatenate([[0], np.cumsum(joined(sum_sizes))]),
            "sum_terms": joined(sum_terms), "sum_max": joined(sum_max)}


def _shards(batches: Iterator[pa.RecordBatch], total_docs: int, total_terms: int, size: int, postings: int) -> Iterator[dict]:
    """The indexes of a task's shards, one at a time."""
    held, docs, count = [], 0, 0

    def flush() -> dict:
        part = pa.Table.from_batches(held).combine_chunks()
        ids, n = part.column("doc_id").combine_chunks(), part.column("n").to_numpy()
        terms, tfs = (part.column(c).combine_chunks() for c in ("terms", "tfs"))
        lengths = pc.list_value_length(terms).to_numpy()
        t, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        m = np.repeat(25 + 75 * n * total_docs // total_terms, lengths)
        values = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        return build_shard(ids.fill_null(NO_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                           np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), t, values, size)

    for batch in batches:
        lengths = pc.list_value_length(batch.column("terms")).to_numpy()
        at = 0
        while at < len(lengths):
            room = min(max(DENSE // max(size, 1) - docs, 1), len(lengths) - at)
            fits = int(np.searchsorted(np.cumsum(lengths[at:at + room], dtype=np.int64), postings - count, side="right"))
            taken = max(fits, 0 if held else 1)
            if taken:
                held.append(batch.slice(at, taken))
                at, docs, count = at + taken, docs + taken, count + int(lengths[at:at + taken].sum())
            if fits < room or docs * size >= DENSE:
                yield flush()
                held, docs, count = [], 0, 0
    if held:
        yield flush()


# --- search --------------------------------------------------------------------

def search_shard(s: dict, terms: np.ndarray, weights: np.ndarray, size: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, row) of a shard, and how many documents were scored."""
    query = np.zeros(size, np.int64)
    query[terms] = weights
    lists = np.searchsorted(s["list_terms"], terms)
    here = lists < len(s["list_terms"])
    here[here] = s["list_terms"][lists[here]] == terms[here]
    terms, lists = terms[here], lists[here]
    best = np.array([s["peak"][i] for i in lists], np.int64) * query[terms]
    order = np.lexsort((lists, -best))
    lists, best = lists[order], best[order]
    rest = np.cumsum(best[::-1])[::-1]
    seen = np.zeros(len(s["ids"]), bool)
    top_score, top_row, floor, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    for i, reach in zip(lists, rest):
        if reach < floor or reach == 0:
            break
        low, high = s["list_ptr"][i], s["list_ptr"][i + 1]
        a, b = s["sum_ptr"][low], s["sum_ptr"][high]
        bound = np.add.reduceat(query[s["sum_terms"][a:b]] * s["sum_max"][a:b], s["sum_ptr"][low:high] - a)
        by_bound = np.argsort(-bound, kind="stable")
        at, step = 0, 1
        while at < len(by_bound) and bound[by_bound[at]] >= floor:
            chosen = by_bound[at:at + step]
            chosen = chosen[bound[chosen] >= floor]
            at, step = at + step, min(2 * step, 64)
            places, _ = _spans(s["block_ptr"], low + chosen)
            rows = s["block_docs"][places].astype(np.int64)
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            seen[rows] = True
            scored += len(rows)
            entries, owner = _spans(s["doc_ptr"], rows)
            part = query[s["doc_terms"][entries]] * s["doc_values"][entries]
            score = np.add.reduceat(part, np.flatnonzero(np.diff(owner, prepend=-1)))
            good = (score > 0) & (score >= floor)
            top_score, top_row = np.concatenate([top_score, score[good]]), np.concatenate([top_row, rows[good]])
            if len(top_score) > k:
                keep = np.lexsort((s["ids"][top_row], -top_score))[:k]
                top_score, top_row = top_score[keep], top_row[keep]
            if len(top_score) == k:
                floor = int(top_score.min())
    return list(zip(top_score.tolist(), top_row.tolist())), scored


def _hits(shard: dict, queries: list[tuple[int, np.ndarray, np.ndarray]], size: int, k: int) -> pa.RecordBatch:
    hits = [(q, row, score) for q, terms, weights in queries for score, row in search_shard(shard, terms, weights, size, k)[0]]
    rows = np.array([h[1] for h in hits], np.int64)
    ids = pa.array(shard["ids"][rows], mask=shard["nulls"][rows].astype(bool))
    return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), ids, pa.array([h[2] for h in hits], pa.int64())],
                                      schema=_HIT_SCHEMA)


def _one_batch(rows: DataFrame, items: list, k: int, postings: int) -> DataFrame:
    wanted = [(r["query"], Counter(w for part in terms_of((r["text"] or "").encode()) for w in part)) for r in items]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, c in wanted for w in c}))}
    size = len(vocabulary)
    vectors = C.stage(rows.mapInArrow(lambda b: _vectors(b, vocabulary), _VECTOR).where("n > 0"), "vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return rows.sparkSession.createDataFrame([], _HIT)
    # one row a term of the batch's own vocabulary
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(size)], np.int64)
    queries = []
    for q, counts in wanted:
        t = np.array([vocabulary[w] for w in counts], np.int64)
        queries.append((q, t, weight[t] * np.array(list(counts.values()), np.int64)))
    docs, terms = total["docs"], total["terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, docs, terms, size, postings):
            yield _hits(shard, queries, size, k)

    return vectors.where(F.size("terms") > 0).mapInArrow(run, _HIT)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", batch_bytes: int = BATCH_BYTES, postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    asked = C.stage(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"),
                                 F.monotonically_increasing_id().alias("query")), "items")
    batches = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes))
    hits = None
    for b in range(batches):
        # one batch of the stated queries reaches the driver
        batch = asked.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == b).collect()
        found = _one_batch(rows, batch, k, postings)
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
