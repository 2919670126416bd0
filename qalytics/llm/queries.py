"""One registered query per operator over its whole table, and the DuckDB SQL
of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics.llm import common as C
from qalytics.llm import blocked_search, collocations, exact_trie, language_id, licenses, line_dedup, mixing, multi_index, ngram_join, packing, pii, suffix_tree, url_rules


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file: below $QALYTICS_TOKENIZERS if that is set, else where
    the installed vocabularies are."""
    folder = os.environ.get("QALYTICS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(C.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(C.table(spark, sf_dir, "documents"), shingle_words=3, num=90, den=100)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(C.table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(C.table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(C.table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(language_id.document_rows(C.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "language", "posterior", "text_language", "accepted")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(language_id.page_rows(C.table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "language", "posterior", "text_language", "accepted")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_trie.exact_groups(C.table(spark, sf_dir, "documents"))


def op9_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(C.table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(C.table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked_search.search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(C.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_ngram_jaccard_join, op3_pii, op4_best_fit_packing, op5_url_filters, op6_language_id, op7_source_mixing,
    op8_exact_dedup, op9_multi_index_search, op10_license_scan, op11_lm_scoring, op12_lexical_search, op13_collocations, pages_language_id, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SHINGLES = """
  SELECT key, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')))
                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT key, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {texts})"""

ORACLES = {
    "op1_line_dedup": f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM docs),
texts AS (SELECT {{{{'d': doc_id, 'n': no}}}} AS key, lower(line) AS t FROM lines),
sets AS ({_SHINGLES.format(k=5, texts="texts")}),
tokens AS (SELECT key, len(s) AS n, unnest(s) AS s FROM sets WHERE len(s) > 0),
-- equal sets meet through one representative, the earliest
ids AS (SELECT key, len(s) AS n, md5(array_to_string(list_sort(s), chr(1))) AS h FROM sets WHERE len(s) > 0),
firsts AS (SELECT h, min(key) AS first, any_value(n) AS n FROM ids GROUP BY h),
grams AS (SELECT f.first AS key, t.n, t.s FROM firsts f JOIN tokens t ON t.key = f.first),
pairs AS (SELECT x.key AS a, y.key AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS hit
          FROM grams x JOIN grams y ON x.s = y.s AND x.key < y.key GROUP BY 1, 2),
late AS (SELECT DISTINCT b FROM pairs WHERE 100 * hit >= 80 * (na + nb - hit)),
gone AS (SELECT ids.key FROM ids JOIN firsts USING (h) WHERE ids.key <> firsts.first
         UNION SELECT ids.key FROM ids JOIN firsts USING (h) JOIN late ON late.b = firsts.first),
marked AS (SELECT lines.doc_id, no, line, gone.key IS NOT NULL AS bad FROM lines LEFT JOIN gone ON gone.key = {{{{'d': lines.doc_id, 'n': lines.no}}}})
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT bad), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed
FROM marked GROUP BY doc_id""".replace("{{", "{").replace("}}", "}"),
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE texts AS (SELECT doc_id AS key, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
sets AS ({_SHINGLES.format(k=3, texts="texts")}),
ids AS (SELECT key, len(s) AS n, md5(array_to_string(list_sort(s), chr(1))) AS h FROM sets),
firsts AS (SELECT h, min(key) AS first, any_value(n) AS n FROM ids WHERE n > 0 GROUP BY h),
grams AS (SELECT first AS key, firsts.n, unnest(s) AS s FROM firsts JOIN sets ON sets.key = firsts.first),
common AS (SELECT s FROM grams GROUP BY s HAVING count(*) > 1),
shared AS (SELECT grams.* FROM grams SEMI JOIN common USING (s)),
pairs AS (SELECT x.key AS a, y.key AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS hit
          FROM shared x JOIN shared y ON x.s = y.s AND x.key < y.key GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * hit >= 90 * (na + nb - hit)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT first, first FROM firsts UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT ids.key AS doc_id, ids.n AS n_shingles, CASE WHEN ids.n = 0 THEN ids.key ELSE roots.root END AS component_id
FROM ids LEFT JOIN firsts ON ids.h = firsts.h AND ids.n > 0 LEFT JOIN roots ON roots.a = firsts.first""",
    "op5_url_filters": f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1) END, ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) END, '') AS path FROM pages),
rules(rule, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
hits AS (SELECT page_id, host, path, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS nth
         FROM parts LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE nth = 1""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)""",
    "op12_lexical_search": f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents),
docs AS (SELECT doc_id, d, len(w) AS n, w FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM docs),
postings AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
scaled AS (SELECT doc_id, d, 25 + (75 * n * n_docs) // l AS m FROM docs, totals),
asked AS (SELECT q, item_id, term, count(*) AS times
          FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark)
          GROUP BY ALL),
scores AS (SELECT q, item_id, d, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN scaled USING (d) GROUP BY q, item_id, d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
         FROM words, range(1, 5) t(k) WHERE len(w) >= k),
seen AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM runs GROUP BY lang, phrase HAVING count(*) >= 30),
spelled AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM seen WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM spelled) c
         JOIN seen x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
         JOIN seen y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts),
inner_runs AS (SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda s: list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase
               FROM spelled WHERE k > 2),
around AS (SELECT lang, phrase, max(f) AS most FROM inner_runs GROUP BY lang, phrase),
ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
           FROM lowest LEFT JOIN around USING (lang, phrase) WHERE nth = 1 AND NOT coalesce(100::HUGEINT * most >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
}
