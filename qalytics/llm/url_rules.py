"""URL filters: sort-merge range join of urls with nested prefix rules.

Method. A rule (host, path) fits its host and all subdomains where the path
starts with the rule's; its canonical key, the reversed host and then the path,
turns that into an interval of keys. A url has one key per host suffix (of the
depths that rules have). Keys and rules are dealt into ranges by sampled
boundaries and sorted; one sweep per range keeps a stack of the rules whose
intervals are open, nested inside each other, and the top of the stack is a
key's longest rule. The longest rule over a url's keys wins.

Scale. One shuffle of short keys. Boundaries carry a salt below the key, so one
url or host that holds a third of all rows is cut into many ranges. A rule is
copied to the ranges its interval touches; at a boundary only the rules nested
around it are open, so copies are at most ranges x nesting depth plus rules.

Defined results. Null urls and urls without ``://`` have empty host and path,
fit no rule, and get the default verdict. Rules are given as text ``host/path``;
a host without labels is refused. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalytics.llm import common as C

# The rules of the contract, as (rule, verdict).
BASE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLED_KEYS = 20_000
KEYS_PER_RANGE = 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)
    return C.ascii_lower(host), path


def _key(labels: list[str], path: str) -> str:
    return ".".join(labels) + "\x01" + path


def rule_key(rule: str) -> tuple[int, str]:
    """(number of host labels, canonical key) of a rule ``host/path``."""
    host, slash, path = rule.partition("/")
    if not host or not slash:
        raise ValueError(f"a rule is host/path: {rule!r}")
    labels = host.split(".")[::-1]
    return len(labels), _key(labels, slash + path)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, rule first): rules open and close, keys take
    the top of the stack."""
    stack: list[tuple[str, str, str]] = []
    at = None
    for batch in batches:
        ids, rules, verdicts = [], [], []
        for span, key, i, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("span", "key", "page", "rule", "verdict"))):
            if span != at:
                stack, at = [], span
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if i is None:
                stack.append((key, rule, verdict))
            elif stack:
                ids.append(i)
                rules.append(stack[-1][1])
                verdicts.append(stack[-1][2])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                                         names=["page", "rule", "verdict"])


def judge(pages: DataFrame, rules: tuple = BASE_RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = C.stage(pages.select("page_id", host.alias("host"), path.alias("path"))
                    .withColumn("row", F.monotonically_increasing_id()), "urls")
    keyed_rules = sorted({(*rule_key(r), r, v) for r, v in rules})
    depths = sorted({d for d, *_ in keyed_rules})
    labels = F.reverse(F.split("host", r"\."))
    keys = (parts.where("host <> ''").withColumn("labels", labels)
            .withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).where(F.size("labels") >= F.col("depth"))
            .select(F.col("row").alias("page"),
                    F.concat(F.array_join(F.slice("labels", 1, F.col("depth")), "."), F.lit("\x01"), "path", F.lit("\x00"),
                             F.lpad(F.hex(F.pmod(F.xxhash64("row"), F.lit(65536))), 4, "0")).alias("key")))

    # boundaries from a bounded sample; the salt after the key parts equal keys
    total = parts.count() * max(1, len(depths))
    spans = max(spark.sparkContext.defaultParallelism, -(-total // KEYS_PER_RANGE))
    sample = sorted(r["key"] for r in keys.sample(min(1.0, SAMPLED_KEYS / max(1, total)), seed=7).select("key").limit(2 * SAMPLED_KEYS).collect())
    bounds = [sample[len(sample) * i // spans] for i in range(1, spans)] if sample else []
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            spots = [bisect.bisect_right(cuts, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int32()), *batch.columns], names=["span", *batch.schema.names])

    dealt = keys.mapInArrow(deal, "span int, page long, key string")
    copies = [(s, k, r, v) for _, k, r, v in keyed_rules
              for s in range(bisect.bisect_right(bounds, k), bisect.bisect_right(bounds, k + "\U0010ffff") + 1)]
    rule_rows = spark.createDataFrame(copies, "span int, key string, rule string, verdict string").withColumn("page", F.lit(None).cast("long"))
    rows = dealt.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string")).unionByName(rule_rows)
    rows = rows.repartition(spans, "span").sortWithinPartitions("span", "key", F.col("page").asc_nulls_first())
    hits = rows.mapInArrow(_sweep, "page long, rule string, verdict string")
    longest = hits.groupBy(F.col("page").alias("row")).agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("top"))
    return (parts.join(longest, "row", "left")
            .select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")))
