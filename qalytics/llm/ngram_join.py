"""N-gram Jaccard join: near-duplicate documents by word shingles.

Method. Every document is its set of distinct word shingles. Shingles are
ordered rare-first by corpus frequency; two sets that reach the threshold must
share a shingle among their first ``n - ceil(t*n) + 1`` (prefix filter). Index
entries are joined on prefix shingles, pruned by set sizes (length filter), by
the places of the shared shingle (positional filter) and by per-range counts of
the remaining shingles (suffix filter), and each surviving pair is verified
once on the whole sets.

Scale. Documents with the same set form one class before anything is joined.
Within the entries of a shingle each class is first paired with one hub (the
class with the fewest rarer shingles), so a group of m near copies costs m
pairs. Only pairs whose classes are still in different components are then
enumerated and verified, so no link between different components is lost and
no group is expanded into all its pairs. Frequencies are kept in 2**18 hash
buckets: the rank table is bounded and broadcast, and any ranking keeps the
prefix filter exact. Shingles more frequent than ``SALT_ROWS`` above the
typical bucket are salted; their local hubs meet in a second level.

Defined results. Null text is empty; an empty document has size 0, links with
nothing and is its own component. A row with a null id links with nothing and
has a null component. Rows that repeat an id are separate rows of the result.
An id's rows may hold different texts; each row follows its own text. Other
columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

BITS = 18
RANGES = 128
SALT_ROWS = 100_000


def _counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for _, texts in C.text_slices(batch):
                h = np.concatenate(C.shingle_hashes(texts, k)) & np.uint64((1 << BITS) - 1)
                total += np.bincount(h.astype(np.int64), minlength=1 << BITS)
        found = np.flatnonzero(total)
        for i in range(0, len(found), 50_000):
            part = found[i:i + 50_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part, pa.int32()), "n": pa.array(total[part], pa.int64())})
    return run


def rarity(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every frequency bucket (rarest 0) and the number of salts its
    shingles get, from occurrence counts over all documents. At most 2**18 rows
    reach the driver."""
    found = (docs.select("text").mapInArrow(_counts(k), "bucket int, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(1 << BITS, dtype=np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    rank = np.empty(1 << BITS, dtype=np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << BITS, dtype=np.int32)
    salts = 1 + np.maximum(0, counts - int(np.median(counts))) // SALT_ROWS
    return rank, salts.astype(np.int32)


SIGNED = "doc_id long, text_hash long, n long, h1 long, h2 long, ranges array<short>, prefix array<long>, salts array<int>"


def _signed(k: int, num: int, den: int, shared):
    """Per document: set size, 128-bit set hash, range counts, rarest shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, salts = shared.value
        by_rank = np.empty_like(salts)
        by_rank[rank] = salts
        for batch in batches:
            for part, texts in C.text_slices(batch):
                out: dict[str, list] = {f: [] for f in ("n", "h1", "h2", "ranges", "prefix", "salts")}
                for h in C.shingle_hashes(texts, k):
                    codes = C.rare_first(h, rank, BITS)
                    n = len(codes)
                    d = xxhash.xxh3_128_intdigest(codes.tobytes())
                    prefix = codes[:n - -(-num * n // den) + 1] if n else codes
                    s = by_rank[prefix >> (63 - BITS)]
                    out["n"].append(n)
                    out["h1"].append((d >> 64) - (1 << 63))
                    out["h2"].append((d & ((1 << 64) - 1)) - (1 << 63))
                    out["ranges"].append(np.minimum(np.bincount(codes & (RANGES - 1), minlength=RANGES), 32_000).astype(np.int16))
                    out["prefix"].append(prefix)
                    out["salts"].append(s if n and s.max() > 1 else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(out["n"], pa.int64()), pa.array(out["h1"], pa.int64()),
                     pa.array(out["h2"], pa.int64()), pa.array(out["ranges"], pa.list_(pa.int16())),
                     pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["salts"], pa.list_(pa.int32()))],
                    names=["doc_id", "text_hash", *out])
    return run


def _sets(k: int, shared, wanted):
    """Whole sets of the documents whose id slot is wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, _ = shared.value
        slots = wanted.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(slots[np.mod(ids, C.ID_SLOTS).astype(np.int64)]))
            for part, texts in C.text_slices(batch):
                codes = [C.rare_first(h, rank, BITS) for h in C.shingle_hashes(texts, k)]
                d = [xxhash.xxh3_128_intdigest(c.tobytes()) for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([(x >> 64) - (1 << 63) for x in d], pa.int64()),
                     pa.array([(x & ((1 << 64) - 1)) - (1 << 63) for x in d], pa.int64()),
                     pa.array(codes, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "codes"])
    return run


def _required(num: int, den: int, na, nb):
    """Smallest intersection at which two sets of these sizes reach num/den."""
    return F.ceil(F.lit(num) * (na + nb) / F.lit(num + den))


def _plausible(num: int, den: int, x: str, y: str):
    """Length and positional filters for two entries of one shingle."""
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    return ((F.least(nx, ny) * den >= F.greatest(nx, ny) * num)
            & (1 + F.least(nx - px, ny - py) - 1 >= _required(num, den, nx, ny)))


def jaccard_classes(docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Two documents link when ``den * |A & B| >= num * |A | B|`` over their sets
    of ``shingle_words``-word shingles; component_id is the smallest id
    reachable by links."""
    return _placed(docs, shingle_words, num, den).select("doc_id", "n_shingles", "component_id")


def _placed(docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``jaccard_classes`` with each row's ``text_hash`` and ``root``, which
    tells components apart that have the same smallest id."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    shared = sc.broadcast(rarity(docs, shingle_words))
    signed = C.stage(docs.mapInArrow(_signed(shingle_words, num, den, shared), SIGNED)
                     .withColumn("rid", F.monotonically_increasing_id()), "sets")

    live = signed.where("n > 0 and doc_id is not null")
    classes = C.stage(live.groupBy("h1", "h2", "n").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_doc")), "classes")

    # entries of the classes, one row per prefix shingle
    entries = (live.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
               .select(F.col("rid").alias("node"), "n", "salts", F.posexplode("prefix").alias("pos", "token"))
               .withColumn("hot", F.coalesce(F.get("salts", F.col("pos")), F.lit(1)))
               .select("token", "node", "n", "pos", (F.col("hot") > 1).alias("hot"),
                       F.when(F.col("hot") > 1, F.pmod(F.xxhash64("node"), F.col("hot"))).otherwise(F.lit(0)).alias("salt")))
    near = Window.partitionBy("token", "salt")
    met = (entries.withColumn("hub", F.min(F.struct("pos", "node", "n")).over(near))
           .withColumn("many", F.count(F.lit(1)).over(near))
           .where("many > 1 or hot").drop("many"))
    met = C.stage(met, "entries")

    me = F.struct("n", "pos")
    hubs = met.select(me.alias("x"), F.col("hub").alias("y"), "node")
    heads = (met.where("hot").select("token", "hub").distinct()
             .withColumn("top", F.min("hub").over(Window.partitionBy("token")))
             .select(F.col("hub").alias("x"), F.col("top").alias("y"), F.col("hub.node").alias("node")))
    first = (hubs.select("node", "x.n", "x.pos", "y").union(heads.select("node", "x.n", "x.pos", "y"))
             .select("node", F.struct("n", "pos").alias("x"), "y")
             .where(F.col("node") != F.col("y.node")).where(_plausible(num, den, "x", "y"))
             .select(F.least("node", F.col("y.node")).alias("a"), F.greatest("node", F.col("y.node")).alias("b")).distinct())

    ranges = live.select(F.col("rid").alias("node"), "n", "ranges")

    def suffix_filter(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(ranges.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("ranges").alias(f"r{side}")), side)
        shared_most = F.aggregate(F.zip_with("ra", "rb", lambda p, q: F.least(p, q).cast("int")), F.lit(0), lambda s, v: s + v)
        capped = F.greatest(F.array_max("ra"), F.array_max("rb")) >= 32_000
        return pairs.where(capped | (shared_most >= _required(num, den, F.col("na"), F.col("nb")))).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that verify on whole sets, computed again for their documents alone."""
        nodes = (pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
                 .join(classes, "node").select("node", "h1", "h2", F.col("first_doc").alias("doc_id")))
        slots = np.zeros(C.ID_SLOTS, dtype=bool)
        slots[nodes.select(F.pmod("doc_id", F.lit(C.ID_SLOTS)).alias("s")).distinct().toArrow()["s"].to_numpy()] = True
        wanted = sc.broadcast(slots)
        sets = (docs.where("doc_id is not null").mapInArrow(_sets(shingle_words, shared, wanted), "doc_id long, h1 long, h2 long, codes array<long>")
                .join(nodes, ["doc_id", "h1", "h2"]).select("node", "codes"))
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("codes").alias(f"c{side}")), side)
        both = F.size(F.array_intersect("ca", "cb"))
        return (pairs.where(both * den >= (F.size("ca") + F.size("cb") - both) * num).select("a", "b").distinct())

    first = C.stage(suffix_filter(first), "pairs")
    links = C.stage(linked(first), "links")
    roots = C.connected_components(links, "a", "b")

    # what no hub has joined: pairs of one shingle in different components
    placed = (met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .select("token", "node", "n", "pos", "root"))
    own = Window.partitionBy("token")
    placed = C.stage(placed.withColumn("lo", F.min("root").over(own)).withColumn("hi", F.max("root").over(own)).where("lo < hi").drop("lo", "hi"), "mixed")
    rest = (placed.alias("x").join(placed.alias("y"), F.col("x.token") == F.col("y.token"))
            .where("x.node < y.node and x.root <> y.root").where(_plausible(num, den, "x", "y"))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
            .join(first, ["a", "b"], "left_anti"))
    rest = C.stage(suffix_filter(rest), "pairs")
    if not rest.isEmpty():
        more = C.stage(linked(rest), "links")
        if not more.isEmpty():
            roots = C.connected_components(links.union(more), "a", "b")

    known = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    known = known.join(least, "root").select("h1", "h2", "n", "component_id", "root")
    return (signed.select("doc_id", "text_hash", "n", "h1", "h2").join(known, ["h1", "h2", "n"], "left")
            .select("doc_id", "text_hash", "root", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies: of each component the row with the
    smallest id stays, and if that id has several rows in the component, the
    first of them by text. Each row goes or stays by its own text, so a row of
    a repeated id that links with nothing stays. Documents without words and
    rows with a null id stay."""
    found = _placed(docs, **options).where("n_shingles > 0 and doc_id is not null")
    # rows of one id and text have one root
    found = C.stage(found.groupBy("doc_id", "text_hash", "root", "component_id").agg(F.count(F.lit(1)).alias("rows")), "placed")
    key = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__text") == F.col("__hash"))
    named = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    left = docs.withColumn("__text", F.xxhash64("text")).join(found.where("doc_id <> component_id").select(*named), key, "left_anti")
    first = found.where("doc_id = component_id")
    several = C.stage(first.join(first.groupBy("doc_id", "root").agg(F.sum("rows").alias("all")).where("all > 1"), ["doc_id", "root"])
                      .select(*named, F.col("root").alias("__root")), "several")
    if several.isEmpty():
        return left.drop("__text")
    # all other rows are spread by their text
    again = Window.partitionBy("doc_id", F.col("__root").isNull(), F.coalesce("__root", "__text")).orderBy("text")
    return (left.join(several, key, "left").withColumn("__nth", F.row_number().over(again))
            .where(F.col("__root").isNull() | (F.col("__nth") == 1)).drop("__text", "__id", "__hash", "__root", "__nth"))
