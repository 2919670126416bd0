"""Line dedup: exact set-similarity join of lines, in DataFrame and SQL functions only.

Method. A line is the set of its ``shingle_words``-word shingles (lower-cased;
a shorter line is one shingle). Shingles are ordered rare-first by corpus
frequency; two lines that reach the threshold share a shingle among their first
``n - ceil(t*n) + 1`` (prefix filter). Length and positional filters prune what
shares one, the rest is verified by exact Jaccard, and a line goes when an
earlier line (smaller id, then smaller line number) matches it.

Scale. Frequencies are kept in 2**16 hash buckets as one of 128 rarity levels, so
the table is bounded; any ranking keeps the prefix filter exact. One
shuffle brings the entries of a shingle together. There, lines of equal sets
are decided by the earliest of them, without pairs. Other lines first meet the
earliest and the most central line of the shingle; only lines that match
neither meet the rest of the earlier ones. Whole sets are computed a second
time only for documents that hold a line of such a pair. Shingles more frequent
than ``SALT_ROWS`` above the typical bucket are salted; the first lines of their
salts meet in a second level.

Defined results. Null text stays null; lines without words are never matched
and stay. A null id is the smallest. Rows may repeat an id: each row loses only
its own lines that match an earlier one, and lines of the same id and line
number do not remove each other, whichever rows they are in. All other columns
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

BITS = 16
SALT_ROWS = 50_000
SLOT_WORDS = 1 << 14  # 64 slots each: bitmaps of what to look at again
NO_ID = -(1 << 63)


def _places(k: int) -> Column:
    """Where the shingles of ``w`` start: null without words, one of fewer words."""
    return F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))))


def _lines(docs: DataFrame, *kept: str) -> DataFrame:
    """(id, *kept, line_no, line) of every line of ``docs`` (id, text, *kept), with
    no white space but spaces. Only texts with other than that and line feeds
    pass through a regular expression."""
    text = F.lower("text")
    odd = functools.reduce(Column.__or__, [F.contains("text", F.lit(c)) for c in "\t\x0b\x0c\r"])
    plain = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    return docs.select("id", *kept, F.posexplode(F.split(plain, "\n", -1)).alias("line_no", "line"))


def _words(lines: DataFrame) -> DataFrame:
    """``lines`` with ``w``, the words in order, instead of ``line``. No filter by
    them: the optimizer would cut every line twice for it."""
    return lines.withColumn("w", F.array_remove(F.split("line", " ", -1), "")).drop("line")


def _levels(docs: DataFrame, k: int) -> tuple[bytes, DataFrame]:
    """The rarity level (0 to 127) of every frequency bucket as one byte each,
    and, as a one-row table, the buckets' numbers of salts."""
    shingle = F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(k)])
    # explode_outer: of explode, the optimizer infers a filter that would cut
    # every line a second time
    seen = (_words(_lines(docs)).select("w", F.explode_outer(_places(k)).alias("i")).where("i is not null")
            .groupBy(F.shiftrightunsigned(shingle, 64 - BITS).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    buckets = docs.sparkSession.range(1 << BITS).withColumnRenamed("id", "bucket").join(seen, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    # 2**16 counts whatever the input
    row = C.stage(buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.greatest(F.median("n"), F.lit(1.0)).alias("m")).select(
        F.transform("b", lambda x: F.least(F.lit(127), F.floor(32 * F.log2(1 + x["n"] / F.col("m")))).cast("int")).alias("levels"),
        F.transform("b", lambda x: (1 + F.floor(F.greatest(x["n"] - F.col("m"), F.lit(0.0)) / SALT_ROWS)).cast("int")).alias("salts")), "rarity")
    return bytes(row.select("levels").first()[0]), row.select("salts")


def _sets(lines: DataFrame, levels: bytes, k: int) -> DataFrame:
    """``lines`` with ``codes``: distinct shingles as non-negative longs that sort rare-first
    (the rarity level of the bucket, then the hash); empty without words."""
    # a constant, folded once
    ranks = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<long>")
    # never null: coalesce says so, and longs without nulls are sorted unboxed
    rank = lambda s: F.coalesce(F.get(ranks, F.shiftrightunsigned(s, 64 - BITS).cast("int")), F.lit(0))
    code = lambda s: F.shiftleft(rank(s), 56).bitwiseOR(F.shiftrightunsigned(s, 8))
    starts = F.slice("w", 1, F.greatest(F.size("w") - (k - 1), F.lit(1)))
    shingles = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, k)]))
    return (_words(lines).withColumn("s", shingles).drop("w")
            .withColumn("codes", F.sort_array(F.array_distinct(F.transform("s", code)))).drop("s"))


def _plausible(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filters for two entries of one shingle."""
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    need = F.ceil(F.lit(num) * (nx + ny) / F.lit(num + den))
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (F.least(nx - px, ny - py) >= need)


def removed_lines(docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, text_hash, line_no) of the lines of ``docs`` (id, text, text_hash)
    that match an earlier line."""
    k = shingle_words
    texts = C.stage(docs.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("text_hash").alias("text_hash"), F.max("text_hash").alias("last")), "texts")
    repeats = not texts.where("rows > 1").isEmpty()
    levels, salts = _levels(docs, k)
    n = F.size("codes")
    prefix = F.slice("codes", 1, (n - F.ceil(n * F.lit(num) / F.lit(den)) + 1).cast("int"))
    salt = F.when(F.col("hot") > 1, F.pmod(F.xxhash64("id"), F.col("hot")))
    # spot, one long that rows meet by: the shingle itself, or a hash of it and
    # the salt; only salted shingles stay beside it
    entries = (_sets(_lines(docs), levels, k)
               .select("id", "line_no", n.alias("n"), F.xxhash64("codes").alias("key"), prefix.alias("prefix"))
               .select("id", "line_no", "n", "key", F.posexplode_outer("prefix").alias("pos", "token")).where("token is not null")
               .withColumn("hot", F.get(salts.scalar(), F.shiftright("token", 56 - BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
               .select(F.when(F.col("hot") > 1, F.xxhash64("token", salt)).otherwise(F.col("token")).alias("spot"),
                       F.when(F.col("hot") > 1, F.col("token")).alias("salted"), "key", "n", "id", "line_no", "pos"))

    def meet(rows: DataFrame) -> DataFrame:
        """Per spot: later lines of equal sets are told (``nth`` > 1), the
        others get the spot's earliest and most central line. Of lines with
        the id, number and set of the earliest one stands for all."""
        same = Window.partitionBy("spot", "key", "n").orderBy("id", "line_no")
        near = Window.partitionBy("spot")
        me = F.struct("id", "line_no", "key", "n", "pos")
        hot = F.col("salted").isNotNull()
        # first of all, what is alone goes: the wider sort sees few rows, this
        # one is by one long, and its partitions are those of this count
        rows = rows.withColumn("all", F.count(F.lit(1)).over(near)).where((F.col("all") > 1) | hot).drop("all")
        return (rows.withColumn("nth", F.row_number().over(same)).withColumn("place", F.dense_rank().over(same))
                .withColumn("many", F.count_if(F.col("nth") == 1).over(near))
                .withColumn("first", F.min(me).over(near)).withColumn("mid", F.min(F.struct("pos", me.alias("l"))).over(near)["l"])
                .where(((F.col("place") > 1) & (F.col("pos") == 0)) | ((F.col("nth") == 1) & ((F.col("many") > 1) | hot))).drop("many", "place"))

    met = C.stage(meet(entries), "met")
    # the first lines of a shingle's salts, by the shingle
    over = meet(met.where("salted is not null and nth = 1").drop("nth", "first", "mid").withColumn("spot", F.col("salted")))
    met = met.unionByName(over).withColumn("token", F.coalesce("salted", "spot"))
    equal = met.where("nth > 1").select("id", "line_no", "key")
    met = met.where("nth = 1").select("token", F.struct("id", "line_no", "key", "n", "pos").alias("me"), "first", "mid")

    def ordered(x: str, y: str) -> list[Column]:
        p, q = (F.struct(f"{s}.id", f"{s}.line_no", f"{s}.key") for s in (x, y))
        return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b")]

    def pairs_of(rows: DataFrame, x: str, y: str) -> DataFrame:
        different = (F.col(f"{x}.id") != F.col(f"{y}.id")) | (F.col(f"{x}.line_no") != F.col(f"{y}.line_no"))
        return rows.where(different & _plausible(x, y, num, den)).select(*ordered(x, y))

    pairs = C.stage(pairs_of(met, "first", "me").union(pairs_of(met, "mid", "me")).distinct(), "pairs")

    def among(rows: DataFrame, wanted: DataFrame, number: Column) -> DataFrame:
        """``rows`` less most of those whose ``number`` no row of ``wanted`` has,
        by a bitmap of bounded size."""
        slot = F.pmod(number, F.lit(SLOT_WORDS * 64))
        words = (wanted.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")))
        words = docs.sparkSession.range(SLOT_WORDS).withColumnRenamed("id", "w").join(words, "w", "left")
        bitmap = C.stage(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits")), "bitmap")
        bits = F.get(bitmap.select("bits").scalar(), F.floor(slot / 64).cast("int"))
        return rows.where(F.getbit(bits, F.pmod(slot, F.lit(64)).cast("int")) == 1)

    def matched(pairs: DataFrame) -> DataFrame:
        """(id, line_no, key) of the later lines of the pairs that verify."""
        wanted = C.stage(pairs.select("a.*").union(pairs.select("b.*")).distinct(), "wanted")
        # rows of one id may hold other lines at a wanted number: the joins by p leave them out
        again = among(_lines(among(docs, wanted, F.col("id"))), wanted, F.xxhash64("id", "line_no")).join(wanted, ["id", "line_no"], "left_semi")
        sets = _sets(again, levels, k).select(F.struct("id", "line_no", F.xxhash64("codes").alias("key")).alias("p"), "codes")
        if repeats:
            sets = sets.dropDuplicates(["p"])
        sets = C.stage(sets, "sets")
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("p").alias(side), F.col("codes").alias(f"c{side}")), side)
        both = F.size(F.array_intersect("ca", "cb"))
        return pairs.where(both * den >= (F.size("ca") + F.size("cb") - both) * num).select("b.*").distinct()

    gone = C.stage(matched(pairs), "gone")
    # lines that neither hub has decided, against all earlier lines of a shingle
    open_lines = (met.where("me.pos <= me.n").withColumn("id", F.col("me.id")).withColumn("line_no", F.col("me.line_no")).withColumn("key", F.col("me.key"))
                  .join(gone, ["id", "line_no", "key"], "left_anti").select("token", F.col("me").alias("x")))
    rest = (open_lines.join(met.select("token", F.col("me").alias("y")).distinct(), "token")
            .where((F.col("y.id") < F.col("x.id")) | ((F.col("y.id") == F.col("x.id")) & (F.col("y.line_no") < F.col("x.line_no")))))
    rest = C.stage(pairs_of(rest, "x", "y").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    late = matched(rest) if not rest.isEmpty() else gone.limit(0)
    removed = equal.union(gone).union(late).distinct()
    found = removed.join(texts.where("text_hash = last").select("id", "text_hash"), "id").select("id", "text_hash", "line_no")
    several = texts.where("text_hash <> last").select("id")
    if repeats and not several.isEmpty():
        # an id of several texts: the lines of each that have a removed set
        own = _sets(_lines(docs.join(several, "id", "left_semi"), "text_hash"), levels, k).withColumn("key", F.xxhash64("codes"))
        found = found.union(own.join(removed, ["id", "line_no", "key"], "left_semi").select("id", "text_hash", "line_no").distinct())
    return found


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` less the lines that match an earlier line, and the
    columns ``n_lines`` and ``n_removed`` (both 0 for a null text)."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    gone = removed_lines(docs.select(ids.alias("id"), "text", F.xxhash64("text").alias("text_hash")).where("text is not null"), **options)
    words = gone.groupBy("id", "text_hash", F.expr("line_no div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, line_no % 64)")).alias("bits"))
    per_doc = words.groupBy("id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("top"))
    per_doc = per_doc.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0))).alias("__gone"))
    lines = F.split("text", "\n", -1)
    stays = lambda line, i: F.coalesce(F.getbit(F.get("__gone", F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64))), F.lit(0)) == 0
    kept = F.when(F.col("__gone").isNull(), lines).otherwise(F.filter(lines, stays))
    own = (F.col("__key") == F.col("__id")) & (F.col("__text_key") == F.col("__hash"))
    joined = docs.withColumn("__key", ids).withColumn("__text_key", F.xxhash64("text")).join(per_doc, own, "left").withColumn("__kept", kept)
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")).alias("text") if c == "text" else docs[c] for c in docs.columns],
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long").alias("n_removed"))
