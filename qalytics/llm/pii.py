"""Personal data by weak supervision, in DataFrame and SQL functions only.

Method. Candidates are spans of four kinds (email, ip, card, phone) found by a
strict pattern (the base spans) and a looser one. Labelers vote on every
candidate (1 for, -1 against, 0 silent): the pattern, a gazetteer (top-level
domains, reserved address ranges, issuer prefixes, calling codes), the words
before, the words after, and the span's shape. Expectation-maximisation over the
counts of vote combinations estimates each labeler's reliability per kind. The
resulting probabilities train the final span classifier, a naive Bayes model
over span features whose weights are grouped sums over all candidates. Base
spans always stay; looser ones join them when the classifier says so and they
overlap none of them.

Scale. Texts are scanned once; what leaves the scan are matches, the gaps
between them and short contexts. Positions are running sums of gaps per row.
At most 3**5 vote combinations and a fixed set of feature values per kind reach
the driver.

Patterns are linear in the text: possessive repeats, and a match may only begin
where the previous one ended or no earlier start could run into it.

Defined results. Null text is empty; a row without spans has counts 0, the
digest of the empty string and empty spans. Rows that repeat an id are judged
one by one. Offsets are code points, end exclusive. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalytics.llm import common as C

KINDS = ("email", "ip", "card", "phone")
# Strict patterns, as the contract gives them, leftmost and non-overlapping.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns: spelled-out addresses, hexadecimal addresses, grouped
# numbers, national phone numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}+ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([ ._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# A text without this cannot match.
GATE = {"email": ("@", "(?i)[(\\[]at[)\\]]"), "ip": (".", ":"), "card": (None, None), "phone": ("+", None)}
BEFORE = {"email": r"mail|contact|write|reach|from|to:?\s*$", "ip": r"\bip\b|host|addr|server|login|client|from", "card": r"card|visa|master|amex|pay|credit",
          "phone": r"phone|tel|call|mobile|cell|fax|dial|whatsapp"}
AGAINST = {"email": r"git|ssh|npm", "ip": r"version|\bv\.?\s*$|release|section|chapter", "card": r"isbn|order|serial|tracking|invoice|ref|\bid\b",
           "phone": r"isbn|order|serial|invoice|ref|version"}
AFTER = {"email": r"^\W{0,3}(?:or|for|to|and)\b", "ip": r"^\s*(?::[0-9]{2,5}|port|/[0-9]{1,2}\b)", "card": r"^\W{0,3}(?:exp|cvv|cvc|valid)", "phone": r"^\W{0,3}(?:ext|x[0-9]|or|for|to)\b"}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "uk", "us", "eu", "it", "nl", "ch", "at", "be", "pl", "ru", "cn",
             "jp", "in", "br", "ca", "au", "mx", "se", "no", "dk", "fi", "cz", "pt", "gr", "ie", "tr", "kr", "za", "ar", "cl", "co", "dev", "app", "me", "tv")
VOTES = 5
ROUNDS = 30


def _gated(kind: str, which: int) -> Column:
    gate = GATE[kind][which]
    if gate is None:
        return F.lit(True)
    return F.col("text").rlike(gate) if gate.startswith("(?i)") else F.contains("text", F.lit(gate))


def _matches(pattern: str) -> Column:
    """Array of (gap, span, before, after): the characters between the previous
    match and this one, the match, and its surroundings."""
    def with_gaps(found: Column) -> Column:
        return F.when(F.size(found) > 0, C.bind(F.split("text", pattern, -1), lambda gaps: F.transform(found, lambda span, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"), span.alias("span"), F.right(F.get(gaps, i), F.lit(32)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(16)).alias("after")))))

    return C.bind(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), with_gaps)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows with a row number, their candidate spans) of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = {f"{k}_{w}": F.when(_gated(k, i), _matches(p[k])) for k in KINDS for i, (w, p) in enumerate((("strict", STRICT), ("loose", LOOSE)))}
    rows = C.stage(rows.select("doc_id", *(c.alias(n) for n, c in found.items())).withColumn("row", F.monotonically_increasing_id()), "matches")
    lists = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(w == "strict").alias("strict"), F.col(f"{k}_{w}").alias("found"))
                      for i, k in enumerate(KINDS) for w in ("strict", "loose")])
    some = F.coalesce(*[F.col(n) for n in found]).isNotNull()
    spans = (rows.where(some).select("row", F.explode(lists).alias("l")).select("row", "l.kind", "l.strict", F.posexplode("l.found").alias("nth", "m"))
             .select("row", "kind", "strict", "nth", "m.*").withColumn("size", F.length("span")))
    upto = Window.partitionBy("row", "kind", "strict").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    return rows.select("doc_id", "row"), spans


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the check sum."""
    def total(d: Column) -> Column:
        n = F.length(d)
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _luhn_digit(d, n, i)), F.lit(0), lambda s, v: s + v)

    return F.pmod(C.bind(digits, total), F.lit(10)) == 0


def _luhn_digit(digits: Column, n: Column, i: Column) -> Column:
    d = F.coalesce(F.substr(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
    twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)


def _byte_parts(span: Column) -> Column:
    """Whether every part is at most 255, whatever its length."""
    return F.forall(F.split(span, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))


def _valid(kind: Column, span: Column) -> Column:
    """What a strict match must also satisfy."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == 1, _byte_parts(span)).when(kind == 2, n.between(13, 19) & luhn(F.left(digits, F.lit(19)))).when(kind == 3, n.between(9, 15)).otherwise(True))


def _by_kind(patterns: dict[str, str], text: Column) -> Column:
    out = F.lit(False)
    for i, k in enumerate(KINDS):
        out = F.when(F.col("kind") == i, text.rlike("(?i)" + patterns[k])).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def votes(spans: DataFrame) -> DataFrame:
    """Columns v0 to v4, a vote of each labeler, and the classifier's features."""
    kind, span = F.col("kind"), F.col("span")
    digits = F.regexp_replace(span, "[^0-9]", "")
    top = F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1))
    first = F.regexp_extract(span, r"^([0-9]{1,3})\.", 1).try_cast("int")
    known = (F.when(kind == 0, _vote(top.isin(*TOP_LEVEL), F.length(top) < 2)).when(kind == 1, _vote(first.between(1, 223) & (first != 127), first.isin(0, 127) | (first > 223)))
             .when(kind == 2, _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^0")))
             .otherwise(_vote(digits.rlike("^(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-58])"), digits.rlike("^0{3}"))))
    shape = (F.when(kind == 0, _vote(F.length(span).between(6, 64), F.length(span) > 254))
             .when(kind == 1, _vote(_byte_parts(span), ~span.rlike("^[0-9.]+$") & ~span.rlike(":")))
             .when(kind == 2, _vote(luhn(F.left(digits, F.lit(19))) & F.length(digits).between(13, 19), ~luhn(F.left(digits, F.lit(19)))))
             .otherwise(_vote(F.length(digits).between(10, 13), ~F.length(digits).between(7, 15))))
    return (spans.withColumn("v0", F.when(F.col("strict"), 1).otherwise(0))
            .withColumn("v1", known).withColumn("v2", _vote(_by_kind(BEFORE, F.col("before")), _by_kind(AGAINST, F.col("before"))))
            .withColumn("v3", _vote(_by_kind(AFTER, F.col("after")), F.lit(False))).withColumn("v4", shape)
            .withColumn("features", F.array(
                F.concat(F.lit("pattern="), F.col("strict").cast("string")), F.concat(F.lit("digits="), F.least(F.length(digits), F.lit(24)).cast("string")),
                F.concat(F.lit("known="), F.col("v1").cast("string")), F.concat(F.lit("shape="), F.col("v4").cast("string")),
                F.concat(F.lit("said="), F.col("v2").cast("string")),
                F.concat(F.lit("word="), F.pmod(F.xxhash64(F.lower(F.regexp_extract("before", r"(\w+)\W*$", 1))), F.lit(64)).cast("string")))))


def reliabilities(counts: list[tuple]) -> dict[tuple, float]:
    """(kind, votes) -> probability that such a span is personal data, by
    expectation-maximisation over ``(kind, votes, n)``: labelers vote
    independently given the truth, with a reliability table each."""
    out: dict[tuple, float] = {}
    for kind in sorted({c[0] for c in counts}):
        own = [(v, n) for k, v, n in counts if k == kind]
        p = [1 / (1 + math.exp(-sum(v))) for v, _ in own]
        for _ in range(ROUNDS):
            yes = sum(n * q for (_, n), q in zip(own, p))
            no = sum(n * (1 - q) for (_, n), q in zip(own, p))
            prior = math.log((yes + 1) / (no + 1))
            # a labeler is taken to be right more often than wrong: pseudo-counts
            table = {(j, x): math.log((sum(n * q for (v, n), q in zip(own, p) if v[j] == x) + (1.0 + x)) + 0.1) - math.log(yes + 3.3)
                     - math.log((sum(n * (1 - q) for (v, n), q in zip(own, p) if v[j] == x) + (1.0 - x)) + 0.1) + math.log(no + 3.3)
                     for j in range(VOTES) for x in (-1, 0, 1)}
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(table[j, x] for j, x in enumerate(v)))))) for v, _ in own]
        out.update({(kind, v): q for (v, _), q in zip(own, p)})
    return out


def classified(spans: DataFrame) -> DataFrame:
    """``spans`` with ``score``, the classifier's log-odds."""
    spark = spans.sparkSession
    ballot = [f"v{j}" for j in range(VOTES)]
    counts = [(r["kind"], tuple(r[v] for v in ballot), r["n"]) for r in spans.groupBy("kind", *ballot).agg(F.count(F.lit(1)).alias("n")).collect()]
    truth = spark.createDataFrame([(k, *v, q) for (k, v), q in sorted(reliabilities(counts).items())], "kind int, " + ", ".join(f"{v} int" for v in ballot) + ", p double")
    soft = spans.join(truth, ["kind", *ballot])
    each = soft.select("kind", "p", F.explode("features").alias("feature"))
    sums = each.groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    totals = soft.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    weights = sums.join(totals, "kind").withColumn("weight", F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1.0)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 1.0)))
    prior = totals.select("kind", F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"))
    # at most a few hundred weights per kind, as one map each
    model = weights.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights")).join(prior, "kind")
    score = F.col("prior") + F.aggregate("features", F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at("weights", f), F.lit(0.0)))
    return spans.join(model, "kind").withColumn("score", score).drop("weights", "prior")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row of ``docs``."""
    rows, spans = candidates(docs)
    spans = C.stage(votes(spans).withColumn("base", F.col("strict") & _valid(F.col("kind"), F.col("span"))), "votes")
    judged = C.stage(classified(spans).where(F.col("base") | (~F.col("strict") & (F.col("score") > 0))).select("row", "kind", "start", "end", "base", "score"), "judged")
    # a looser span must not touch a base span of its row: running end of the base spans before, start of the next
    ahead = Window.partitionBy("row").orderBy("start", F.desc("base"), "end")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    base_next = F.min(F.when(F.col("base"), F.col("start"))).over(ahead.rowsBetween(1, Window.unboundedFollowing))
    any_end = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    kept = (judged.withColumn("be", base_end).withColumn("bn", base_next).withColumn("ae", any_end)
            .where(F.col("base") | ((F.coalesce("be", F.lit(0)) <= F.col("start")) & (F.coalesce("bn", F.col("end")) >= F.col("end")) & (F.coalesce("ae", F.lit(0)) <= F.col("start")))))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string"))
    listed = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("kind", "start", "end", shown.alias("s")))))
    per_row = kept.groupBy("row").agg(*[F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                                      F.concat_ws(",", F.transform(listed(F.col("base")), lambda x: x["s"])).alias("base_spans"),
                                      F.concat_ws(",", F.transform(listed(F.lit(True)), lambda x: x["s"])).alias("spans"),
                                      F.count_if(~F.col("base")).alias("n_added"))
    out = rows.join(per_row, "row", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
                      F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))
