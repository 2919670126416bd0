"""Approximate nearest neighbours: inverted multi-index.

Method. A vector's two halves are quantised separately, by codebooks fitted
with k-means on a bounded sample (``SAMPLE`` vectors by hash order); the pair of
centroids is its cell. A query walks centroid pairs by growing summed squared
distance, with a heap, until their cells hold ``candidates`` entries, and the
entries are reranked by exact distance in double precision.

Scale. Every vector is indexed; equal vectors are one entry with their
smallest ids (as many as a result can show, so nothing is lost), which keeps a
vector repeated by a third of all rows at one entry. Cells are dealt into
shards of at most ``SHARD`` entries (a large cell into several); queries go to
the shards their cells lie in, and a shard visited by many queries is copied
for groups of them. Each task ranks one shard against one group of queries.
Codebooks and cell counts (at most ``MOST_CENTROIDS`` squared rows) are the only
data on the driver.

Defined results. Vectors that are null, zero or hold null or non-finite
components, rows with a null id, and vectors of another length than most take
no part. Fewer candidates than k give fewer rows. Equal distances go to the
smaller id. Rows that repeat an id and vector count once. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

SAMPLE = 20_000
MOST_CENTROIDS = 256
# Entries a query walks to: at least CANDIDATES, and SHARE of all. On vectors
# with little cluster structure a quarter of all gave a recall of 0.76.
CANDIDATES = 6000
SHARE = 0.65
SHARD = 4096
QUERIES_PER_GROUP = 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``; fewer if ``x`` has fewer different rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    different = np.unique(x, axis=0)
    centers = different[rng.permutation(len(different))[:k]]
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i:i + 4096], centers).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold ``wanted`` entries."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out, held = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for s, t in ((i + 1, j), (i, j + 1)):
            if s < len(a) and t < len(b) and (s, t) not in seen:
                seen.add((s, t))
                heapq.heappush(heap, (left[a[s]] + right[b[t]], s, t))
    return out


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.array([np.asarray(r, dtype=np.float64) for r in rows])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES,
            share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k``
    nearest rows of ``vectors`` (both vec_id, embedding), itself excepted."""
    sc = vectors.sparkSession.sparkContext

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(finite).where(F.exists("v", lambda x: x != 0))

    good = usable(vectors)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], empty)
    width = lengths[0]["d"]
    half = width // 2
    good = good.where(F.size("v") == width).distinct()
    asked = usable(queries).where(F.size("v") == width).distinct()

    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = good.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sample = _matrix(points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()["v"])
    n = points.count()
    wanted = max(candidates, int(np.ceil(share * n)))
    size = int(min(MOST_CENTROIDS, max(2, round(4 * n ** 0.25))))
    books = sc.broadcast((kmeans(sample[:, :half], size), kmeans(sample[:, half:], size)))
    right_size = len(books.value[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                cell = _nearest(x[:, :half], one) * len(two) + _nearest(x[:, half:], two)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", *batch.schema.names])

    index = C.stage(points.mapInArrow(place, "cell int, v array<double>, ids array<long>"), "index")
    counts = np.zeros(len(books.value[0]) * right_size, dtype=np.int64)
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["cell"]] = r["n"]
    first = (np.cumsum(counts) - counts) // SHARD
    last = np.maximum(first, (np.cumsum(counts) - 1) // SHARD)
    plan = sc.broadcast((counts, first, last))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        counts, first, last = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            near, far = _squares(x[:, :half], one), _squares(x[:, half:], two)
            rows, shards, cells = [], [], []
            for r in range(len(x)):
                by: dict[int, list[int]] = {}
                for cell in walk(near[r], far[r], counts, wanted):
                    for s in range(first[cell], last[cell] + 1):
                        by.setdefault(s, []).append(cell)
                for s, own in by.items():
                    rows.append(r)
                    shards.append(s)
                    cells.append(own)
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(cells, pa.list_(pa.int32())), part.column("vec_id"), part.column("v")],
                                             names=["shard", "cells", "query_id", "q"])

    visits = C.stage(asked.mapInArrow(visit, "shard long, cells array<int>, query_id long, q array<double>"), "visits")
    groups = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_GROUP).cast("int").alias("groups"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, last = plan.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            spread = last[cell] - first[cell] + 1
            own = np.array([hash(tuple(i[:1])) for i in batch.column("ids").to_pylist()], dtype=np.int64)
            shard = first[cell] + np.mod(own, spread)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    entries = (index.mapInArrow(deal, "shard long, cell int, v array<double>, ids array<long>").join(groups, "shard")
               .withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups"))
    visits = visits.join(groups, "shard").withColumn("grp", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups")

    def rerank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(held):
            x, cell, ids = _matrix(held["v"]), held["cell"].to_numpy(), list(held["ids"])
            least = np.array([i[0] for i in ids])
            order = np.argsort(cell, kind="stable")
            x, cell, least = x[order], cell[order], least[order]
            ids = [ids[i] for i in order]
            for query, q, cells in zip(asked["query_id"], asked["q"], asked["cells"]):
                own = np.flatnonzero(np.isin(cell, cells))
                if not len(own):
                    continue
                d = np.sqrt(((x[own] - np.asarray(q, dtype=np.float64)) ** 2).sum(axis=1))
                for j in np.lexsort((least[own], d))[:k + 1]:
                    out += [(query, int(i), float(d[j])) for i in ids[own[j]] if i != query]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    ranked = (visits.groupBy("shard", "grp").cogroup(entries.groupBy("shard", "grp"))
              .applyInPandas(rerank, "query_id long, vec_id long, score double"))
    # rows that repeat an id may bring several vectors of one id: its nearest counts
    ranked = ranked.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place_ = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", place_.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
