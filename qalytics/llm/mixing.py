"""Mixing sources to target weights by a low-discrepancy schedule.

Method. Sources, in code-point order (null last), carry weights; each gets a
target number of words, its share of ``total_share`` times all words, and
targets stop at ``most_epochs`` times the source's size (the excess is shared
again by weight). Golden-ratio points are mapped through the cumulative target
shares to sources; a source's slots are ranked in schedule order. Its documents
are shuffled by hash, laid end to end and cut into blocks of equal word counts;
slot r takes block r (the second round over a source's blocks is its second
epoch), so slots join blocks by (source, block). A document goes with the block
in which it starts, so documents stay whole.

Scale. The table of sources has one row per source and stays distributed:
targets come from grouped sums (the level at which the shares stop, found in
rounds), numbers and stretches from sums by sorted parts, so any number of
sources will do. Running word counts
and slot ranks come in two levels (buckets, then rows inside a bucket), so a
source with a third of all rows is spread over many tasks, in windows, the
join of slots to blocks, and the final join.

Defined results. Null text has 0 words. Words are ``[^\\x20\\x09-\\x0D]+``. A
document without words is never taken. A null source is a source of its own.
The shuffle depends on id and text alone: reruns agree, and rows that repeat
both are taken next to each other. A null id is hashed as null. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1024
ROWS_PER_BUCKET = 4096
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[float], weights: list[float], total: float, most_epochs: float) -> list[float]:
    """Shares of ``total`` by weight, each at most ``most_epochs`` times its
    size, what is over shared again among the others."""
    out = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most_epochs * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = most_epochs * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in over]
    return out


def _numbered(spark, sized: DataFrame, total_share: float, most_epochs: float, weights: tuple, block_words: int) -> DataFrame:
    """(sid, source, source_size, target, lo, hi, slots, buckets) per source:
    ``targets`` and the stretches of [0, 1) without a list of the sources."""
    order = [F.col("source").isNull(), F.col("source")]
    # sorted parts: place in the part and the sums of the parts before give running sums
    parts = C.stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
                    .repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")

    def before(rows: DataFrame, value: Column) -> DataFrame:
        """Per part, the sum of ``value`` over the parts before."""
        sums = rows.groupBy("__part").agg(F.sum(value).alias("__x"))
        return sums.select("__part", (F.sum("__x").over(Window.orderBy("__part")) - F.col("__x")).alias("__before"))

    sid = F.col("__nth") + F.col("__before")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(sid, F.lit(len(weights))).cast("int"))
    rows = parts.join(before(parts, F.lit(1).cast("long")), "__part").select(
        "__part", "__nth", sid.alias("sid"), "source", "source_size", "rows", weight.alias("__w"), (F.lit(float(most_epochs)) * F.col("source_size")).alias("__cap"))
    # the level: a source gets its weight times it, or its cap if that is less
    live = rows.where("source_size > 0")
    first = live.agg(F.sum("source_size").alias("n"), F.sum("__w").alias("w")).first()
    total = total_share * (first["n"] or 0)
    level, known = total / (first["w"] or 1.0), 0
    while True:
        over = F.col("__w") * F.lit(level) > F.col("__cap")
        now = live.agg(F.sum(F.when(over, F.col("__cap"))).alias("full"), F.sum(F.when(~over, F.col("__w"))).alias("w"), F.count_if(over).alias("n")).first()
        if now["n"] == known or not now["w"]:
            break
        level, known = (total - now["full"]) / now["w"], now["n"]
    target = F.when(F.col("source_size") > 0, F.least(F.col("__w") * F.lit(level), F.col("__cap"))).otherwise(0.0)
    rows = rows.withColumn("target", target).withColumn("slots", F.ceil(F.col("target") / block_words))
    all_slots = F.lit(float(max(1, rows.agg(F.sum("slots")).first()[0] or 0)))
    upto = F.sum("slots").over(Window.partitionBy("__part").orderBy("__nth")) + F.col("__before")
    return C.stage(rows.join(before(rows, F.col("slots")), "__part").withColumn("__upto", upto).select(
        "sid", "source", "source_size", "target", ((F.col("__upto") - F.col("slots")) / all_slots).alias("lo"), (F.col("__upto") / all_slots).alias("hi"), "slots",
        F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_PER_BUCKET)).alias("buckets")), "sources")


def mix(docs: DataFrame, total_share: float = 1.5, most_epochs: int = 2, weights: tuple = WEIGHTS,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times, places) per row
    of ``docs`` (doc_id, text, source); ``times`` is 0 to ``most_epochs``, and
    ``places`` tells for each time the slot's place in the schedule and the
    row's first word in the slot: sorted by them (and by source, where slots
    drawn at the end share a place) the rows are in mixed order."""
    spark = docs.sparkSession
    sized = C.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
                                F.xxhash64("doc_id", "text").alias("__shuffle")), "sizes")
    sources = _numbered(spark, sized, total_share, most_epochs, weights, block_words)

    # documents end to end in shuffled order: bucket sums, then rows of a bucket
    dealt = (sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
             .withColumn("__bucket", F.floor(F.shiftrightunsigned("__shuffle", 20) / F.lit(2.0 ** 44) * F.col("buckets"))))
    sums = dealt.groupBy("sid", "__bucket").agg(F.sum("size").alias("__n"))
    before = sums.select("sid", "__bucket", (F.sum("__n").over(Window.partitionBy("sid").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("sid", "__bucket").orderBy("__shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (dealt.withColumn("__upto", F.sum("size").over(inside)).join(before, ["sid", "__bucket"])
            .withColumn("start", F.col("__before") + F.col("__upto") - F.col("size"))
            .withColumn("block", F.floor(F.col("start") / block_words)))

    # the schedule: golden-ratio points through the cumulative shares, ranked per source
    schedule = _schedule(spark, sources)
    # Slot r of a source takes words [r * block, (r + 1) * block) of its epochs
    # laid end to end, as far as its target; a document belongs to its start.
    wraps = schedule.join(sources.select("sid", "source_size", "target"), "sid").select(
        "sid", "target", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1))).alias("epoch"),
        (F.col("rank") * block_words).alias("__from"), "place")
    wraps = (wraps.withColumn("__base", F.col("__from") - F.col("epoch") * F.col("source_size")).withColumn("__lo", F.greatest(F.col("__from") - F.col("epoch") * F.col("source_size"), F.lit(0)))
             .withColumn("__hi", F.least(F.col("__from") + block_words, F.ceil("target")) - F.col("epoch") * F.col("source_size"))
             .withColumn("__hi", F.least("__hi", F.col("source_size"))).where("__lo < __hi")
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("__lo") / block_words), F.floor((F.col("__hi") - 1) / block_words))))
             .select(F.col("sid").alias("__sid"), F.col("block").alias("__block"), "epoch", "__lo", "__hi", "place", "__base"))
    # a block meets at most 2 slots of each epoch: gather them in one short row
    taken = wraps.groupBy("__sid", "__block").agg(F.collect_list(F.struct("epoch", "__lo", "__hi", "place", "__base")).alias("__slots"))
    joined = laid.join(taken, (F.col("sid") == F.col("__sid")) & (F.col("block") == F.col("__block")), "left")
    own = F.filter("__slots", lambda s: (F.col("size") > 0) & (s["__lo"] <= F.col("start")) & (F.col("start") < s["__hi"]))
    places = F.array_sort(F.transform(own, lambda s: F.struct(s["place"].alias("place"), (F.col("start") - s["__base"]).alias("word"))))
    places = F.coalesce(places, F.array().cast("array<struct<place:bigint,word:bigint>>"))
    return (joined.withColumn("places", places).withColumn("times", F.size("places").cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "places", "__shuffle"))


def _schedule(spark, sources: DataFrame) -> DataFrame:
    """(sid, rank, place): the slots in schedule order.

    Point i is frac(i * golden); a source's stretch of [0, 1) receives its
    share of the points up to a bounded discrepancy, so a few points more than
    slots are drawn and each source keeps its first ``slots``. A source whose
    stretch is so thin that it still lacks some gets them at the end."""
    total, count = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    points = int(total + 8 * count * (2 + math.log(total + 2)))
    cells = max(4096, 1 << count.bit_length())  # points and stretches meet by cell, not by comparing all with all
    chunk = 1 << 16
    drawn = spark.range(points).withColumn("u", F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))).withColumn("cell", F.floor(F.col("u") * cells))
    stretch = sources.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    hit = drawn.join(stretch, "cell").where("lo <= u and u < hi").select("sid", "slots", "id", F.floor(F.col("id") / chunk).alias("part"))
    sums = hit.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("sid", "part", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("before"))
    ranked = (hit.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "part").orderBy("id")) - 1)
              .join(before, ["sid", "part"]).select("sid", "slots", "id", (F.col("nth") + F.col("before")).alias("rank")).where("rank < slots"))
    have = sums.groupBy("sid").agg(F.sum("n").alias("have"))
    lacking = (sources.where("slots > 0").join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
               .select("sid", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank")))
    return ranked.select("sid", "rank", F.col("id").alias("place")).union(
        lacking.select("sid", "rank", (F.lit(points) + F.col("rank")).alias("place")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (0 to
    ``most_epochs``).

    Rows of one id, text and source can't be told apart by the plan: together
    they come as often as the plan takes all of them, each the whole share, and
    what a division leaves from the one whose columns hash lowest."""
    plan = mix(docs, **options).groupBy("doc_id", "__shuffle", "source").agg(
        F.sum("times").alias("__times"), F.count(F.lit(1)).alias("__copies")).where("__times > 0").select(
        F.col("doc_id").alias("__id"), F.col("__shuffle").alias("__key"), F.col("source").alias("__source"),
        F.floor(F.col("__times") / F.col("__copies")).alias("__each"), (F.col("__times") % F.col("__copies")).alias("__left"))
    rows = docs.withColumn("__key0", F.xxhash64("doc_id", "text"))
    joined = rows.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key0") == F.col("__key"))
                       & F.col("source").eqNullSafe(F.col("__source")))
    hashed = [rows[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = joined.where("__each > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__each")))).select(*[rows[c] for c in docs.columns])
    # the same join again: its shuffle of the texts is reused
    rest = (joined.where("__left > 0").groupBy("__id", "__key", "__source")
            .agg(F.min_by(F.struct(*[rows[c] for c in docs.columns]), F.xxhash64(*hashed)).alias("__row"), F.first("__left").alias("__left"))
            .select("__row", F.explode(F.sequence(F.lit(1), F.col("__left"))).alias("__again")).select("__row.*"))
    return whole.union(rest)
