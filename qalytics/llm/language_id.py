"""Language ID by Bayesian evidence fusion.

Method. Text likelihoods come from a naive Bayes model over hashed letter
trigrams, counted by grouped aggregation over all rows that declare a language.
Every declared language is modelled, however few rows declare it: its counts
are shrunk towards half the trigrams of all rows and half a uniform share, so a
rare one rests on what is known of all. A row's own trigrams are taken out of
its declared language before it is scored there, so no text is evidence for itself.
The likelihoods are combined with the declared markup language, the address suffix (a
path part or top-level domain that names a language) and a host prior. Host
priors are smoothed hierarchically: host -> registered domain -> all rows, each
level's grouped counts of text-only decisions added to its parent's shares.

The best posterior wins. A row is rejected when it has no letters, when the text fits its best
language (the declared one with the row's own trigrams) worse than unstructured
noise, or when no language reaches ``accept``.

Scale. One scan counts trigrams, one scan scores. Codes of two or three letters
bound the languages; of each only the trigrams that it has reach the driver (at
most 2**13) and the workers. Scores, not texts, meet the host priors, by
equi-joins on small rows; priors are a written table, so the join shuffles both
sides or broadcasts, and a host with a third of the rows can be split.

Defined results. Null text is empty and rejected as ``und``. Unknown, null and
malformed declarations and the codes for no one language (und, mis, mul, zxx)
count as missing evidence; a null host has the prior of all
rows. Ties go to the first language by code. If no row declares a
language, every row is rejected. Rows that repeat an id are judged
one by one. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalytics.llm import common as C

BITS = 13
# Trigrams that the shares of all rows count for in each language.
SHRINK = 1000.0
# Distinct (language, trigram) pairs that a worker holds between two folds.
FOLD_PAIRS = 1_000_000
# Codes that name no single language.
NO_LANGUAGE = ("mis", "mul", "und", "zxx")
# Letters depend on each other: a text counts as at most so many trigrams.
EFFECTIVE = 40.0
DECLARED_RIGHT = 0.95
ADDRESS_RIGHT = 0.85
HOST_STRENGTH = 20.0
ACCEPT = 0.5

_LETTER = np.full(256, 32, dtype=np.uint64)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the letter trigrams (with one blank around
    words) of all texts."""
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    a = _LETTER[np.frombuffer(b"  ".join(texts) + b"  ", dtype=np.uint8)]
    a = np.concatenate(([np.uint64(32)], a))
    x, y, z = a[:-2], a[1:-1], a[2:]
    keep = np.flatnonzero((y != 32) | ((x != 32) & (z != 32)))
    code = (x[keep] << np.uint64(16)) | (y[keep] << np.uint64(8)) | z[keep]
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.searchsorted(np.cumsum(sizes) - sizes, keep, side="right") - 1, bucket


def _train(languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}

    def fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list, list]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return [key], [np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for part, texts in C.text_slices(batch):
                of = np.array([place[x] for x in part.column("declared").to_pylist()], dtype=np.int64)
                owner, bucket = _trigrams(texts)
                key, n = np.unique((of[owner] << BITS) + bucket, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > FOLD_PAIRS:
                    keys, counts = fold(keys, counts)
                    held = len(keys[0]) // 2
        if keys:
            (key,), (n,) = fold(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key >> BITS, pa.int32()), pa.array(key & ((1 << BITS) - 1), pa.int32()), pa.array(n, pa.int64())],
                                             names=["lang", "bucket", "n"])
    return run


class Model:
    """Trigram counts per language, shrunk to those of all rows; only the
    trigrams that a language has are held for it."""

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.place = {name: i for i, name in enumerate(languages)}
        order = np.lexsort((bucket, lang))
        lang, self.bucket, self.n = lang[order], bucket[order], n[order].astype(np.float64)
        self.first = np.searchsorted(lang, np.arange(len(languages) + 1))
        self.total = np.bincount(lang, weights=self.n, minlength=len(languages))
        every = np.bincount(bucket, weights=n, minlength=1 << BITS) + 0.5
        self.shrunk = SHRINK * (0.5 / (1 << BITS) + 0.5 * every / every.sum())
        self.base = np.log(self.shrunk)

    def __len__(self) -> int:
        return len(self.place)

    def logs(self, i: int) -> np.ndarray:
        """Log probability of every trigram in language ``i``."""
        at = slice(self.first[i], self.first[i + 1])
        out = self.base.copy()
        out[self.bucket[at]] = np.log(self.n[at] + self.shrunk[self.bucket[at]])
        return out - np.log(self.total[i] + SHRINK)

    def without(self, i: int, bucket: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        """As ``logs``, at ``bucket``, for texts that hold it ``n`` times among
        ``size`` trigrams and were counted for language ``i`` themselves."""
        at = slice(self.first[i], self.first[i + 1])
        have = self.n[at][np.searchsorted(self.bucket[at], bucket)]
        return np.log(have - n + self.shrunk[bucket]) - np.log(self.total[i] - size + SHRINK)

    def means(self, texts: list[bytes], declared: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: its trigrams, their mean log probability per language (in
        the declared one without the text itself), and in the declared one with it."""
        owner, bucket = _trigrams(texts)
        size = np.bincount(owner, minlength=len(texts)).astype(np.float64)
        key, n = np.unique((owner << BITS) + bucket, return_counts=True)
        owner, bucket = key >> BITS, key & ((1 << BITS) - 1)
        of = np.array([self.place.get(x, -1) for x in declared], dtype=np.int64)
        scores, own = np.zeros((len(texts), len(self))), np.full(len(texts), -np.inf)
        for i in range(len(self)):
            each = n * self.logs(i)[bucket]
            scores[:, i] = np.bincount(owner, weights=each, minlength=len(texts))
            mine = of == i
            if mine.any():
                own[mine] = scores[mine, i]
                at = mine[owner]
                left = n[at] * self.without(i, bucket[at], n[at], size[owner[at]])
                scores[mine, i] = np.bincount(owner[at], weights=left, minlength=len(texts))[mine]
        some = np.maximum(size, 1)
        return size.astype(np.int64), scores / some[:, None], own / some


def _score(shared):
    noise = -BITS * float(np.log(2.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in C.text_slices(batch):
                n, mean, own = model.means(texts, part.column("declared").to_pylist())
                fits = (n > 0) & (np.maximum(mean.max(axis=1, initial=-np.inf), own) >= noise)
                best = mean.argmax(axis=1) if len(model) else np.zeros(len(texts), dtype=np.int64)
                rest = [part.column(c) for c in ("doc_id", "key", "declared", "address", "host")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(list(mean), pa.list_(pa.float64())), pa.array(best, pa.int32(), mask=~fits)],
                                                 names=["doc_id", "key", "declared", "address", "host", "n_trigrams", "mean", "text"])
    return run


def _dense(langs: pa.Array, counts: pa.Array, size: int) -> np.ndarray:
    """One row of counts per language for each list of (language, count); null is no counts."""
    out = np.zeros((len(langs), size))
    owner = np.repeat(np.arange(len(langs)), np.nan_to_num(pc.list_value_length(langs).to_numpy(zero_copy_only=False)).astype(np.int64))
    out[owner, pc.list_flatten(langs).to_numpy()] = pc.list_flatten(counts).to_numpy()
    return out


def _decide(languages: list[str], base: np.ndarray, accept: float):
    """Rows of scores and host counts to decisions: text, declaration, address
    and host prior add up as logarithms."""
    size = len(languages)
    place = {name: i for i, name in enumerate(languages)}

    def evidence(said: list[str | None], right: float) -> np.ndarray:
        out = np.zeros((len(said), size))
        if size > 1:
            for row, x in enumerate(said):
                if x in place:
                    out[row] = np.log((1.0 - right) / (size - 1))
                    out[row, place[x]] = np.log(right)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            n, text = batch.column("n_trigrams").to_numpy(), batch.column("text")
            fits = text.is_valid().to_numpy(zero_copy_only=False)
            names = [languages[i] if i is not None else None for i in text.to_pylist()]
            best, posterior = np.zeros(rows, dtype=np.int64), np.zeros(rows)
            if size:
                prior = base
                for level in ("domain", "host"):
                    counts = _dense(batch.column(f"{level}_langs"), batch.column(f"{level}_counts"), size)
                    prior = (counts + HOST_STRENGTH * prior) / (counts.sum(axis=1, keepdims=True) + HOST_STRENGTH)
                mean = pc.list_flatten(batch.column("mean")).to_numpy().reshape(rows, size)
                logs = (np.minimum(n, EFFECTIVE)[:, None] * mean + np.log(prior) + evidence(batch.column("declared").to_pylist(), DECLARED_RIGHT)
                        + evidence(batch.column("address").to_pylist(), ADDRESS_RIGHT))
                best = logs.argmax(axis=1)
                posterior = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            good = fits & (posterior >= accept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([languages[i] if ok else "und" for i, ok in zip(best, good)], pa.string()),
                 pa.array(posterior, pa.float64()), pa.array(names, pa.string()), pa.array(good)],
                names=["doc_id", "key", "language", "posterior", "text_language", "accepted"])
    return run


def declared_code(c: Column) -> Column:
    """Two- or three-letter code of a language tag (``en-GB`` is ``en``), else null."""
    code = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when((code != "") & ~code.isin(*NO_LANGUAGE), code)


def address_code(url: Column) -> Column:
    """What an address says: its first path part of two letters, else a
    two-letter top-level domain."""
    path = F.regexp_extract(url, "://[^/?#]*/([A-Za-z]{2})(?:/|$)", 1)
    top = F.regexp_extract(url, "://[^/?#]*\\.([A-Za-z]{2})(?::[0-9]+)?(?:[/?#]|$)", 1)
    return F.lower(F.when(path != "", path).when(top != "", top))


def markup_code(html: Column) -> Column:
    """The language that the page's root element declares."""
    return declared_code(F.regexp_extract(html, "(?i)<html[^>]*?\\slang\\s*=\\s*[\"']?([A-Za-z_-]+)", 1))


def identify(rows: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, key, language, posterior, text_language, accepted) per row of
    ``rows`` (doc_id, key, text, declared, address, host); any of the last
    three may be null throughout."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    spoken = rows.where("declared is not null")
    languages = sorted(r["declared"] for r in spoken.select("declared").distinct().collect())
    size = len(languages)
    found = (spoken.select("text", "declared").mapInArrow(_train(languages), "lang int, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    shared = sc.broadcast(Model(languages, *(found[c].to_numpy() for c in ("lang", "bucket", "n"))))
    wanted = rows.select("doc_id", "key", "text", "declared", "address", "host")
    scored = C.stage(wanted.mapInArrow(_score(shared), "doc_id long, key long, declared string, address string, host string, "
                                       "n_trigrams long, mean array<double>, text int"), "scores")

    # host priors: counts of text-only decisions, smoothed by the level above
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    domain = F.when(F.size(F.split("host", r"\.")) >= 2, domain).otherwise(F.col("host"))
    decided = scored.where("text is not null")
    world = {r["text"]: r["n"] for r in decided.groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = (np.array([world.get(i, 0) for i in range(size)]) + 1.0) / (sum(world.values()) + size or 1)

    def gathered(counts: DataFrame, by: str) -> DataFrame:
        """One row a host or domain: the languages that it has, and their counts."""
        found = F.collect_list(F.struct("text", "n"))
        return counts.groupBy(by).agg(found.alias("found")).select(by, F.col("found.text").alias(f"{by}_langs"), F.col("found.n").alias(f"{by}_counts"))

    at_host = decided.where("host is not null").groupBy("host", "text").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("domain", domain)
    at_domain = at_host.groupBy("domain", "text").agg(F.sum("n").alias("n"))
    priors = C.stage(gathered(at_host, "host").withColumn("domain", domain).join(gathered(at_domain, "domain"), "domain").drop("domain"), "priors")
    return scored.join(priors, "host", "left").mapInArrow(
        _decide(languages, base, accept), "doc_id long, key long, language string, posterior double, text_language string, accepted boolean")


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of ``documents``: the declared language is ``lang``, the host is ``source``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text",
                       declared_code(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("address"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of ``pages``: text between tags, markup language, address, host."""
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1>", " "), "<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("doc_id"), F.xxhash64("page_id", "url").alias("key"), text.alias("text"),
                        markup_code(F.col("html")).alias("declared"), address_code(F.col("url")).alias("address"),
                        F.when(host != "", host).alias("host"))


def accepted_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    gone = identify(document_rows(docs), **options).where("not accepted").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    return rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key")), "left_anti").drop("__row")
