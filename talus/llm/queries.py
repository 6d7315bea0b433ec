"""The registered queries of this package: thin wrappers that apply an operator to its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import bitpack, counts, embeddings, licenses, lm, mixing, neardup, packing, phrases, quality, search, tokens, toxicity, warc
from talus.runtime import table


def id_crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("row_key", "removed_lines")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(table(spark, sf_dir, "documents"), tokens.default_path())


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), F.pmod(id_crc(), F.lit(10)) == 0)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), counts.default_path())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_best_fit_packing, op4_toxicity, op5_mixing, op6_token_files, op7_lm_scoring, op8_minhash_near_dedup, op9_warc, op10_embedding_near_dedup, op11_token_counts, op12_collocations, op13_lexical_search)}
SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text,''), '{SPACE}'), lambda x: x <> '')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text,'') AS text, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT doc_id, source, text, line, list_filter(string_split_regex(line, '{SPACE}'), lambda x: x <> '') AS lw FROM l),
g AS (SELECT * FROM f WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM g GROUP BY 1),
win AS (SELECT doc_id, unnest(range(len(w)-2)) AS i, w FROM d WHERE len(w) >= 3),
key AS (SELECT doc_id, i, w[i+1] AS a, w[i+2] AS b, w[i+3] AS c FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM key),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest([0,1,2]) AS o) WHERE n > 1 GROUP BY 1),
norm AS (SELECT doc_id, source, text, translate(lower(array_to_string(lw, ' ')), '0123456789', '0000000000') AS line, len(lw) AS words FROM g),
common AS (SELECT source, line FROM norm GROUP BY 1, 2 HAVING count(DISTINCT text) > 10),
gone AS (SELECT doc_id, sum(words) AS removed FROM norm JOIN common USING(source, line) GROUP BY 1),
r AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))),0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 coalesce(n_dup_lines,0) AS n_dup_lines, coalesce(n_repeat_words,0) AS n_repeat_words, CAST(coalesce(removed,0) AS BIGINT) AS removed_words FROM d LEFT JOIN dup USING(doc_id) LEFT JOIN rep USING(doc_id) LEFT JOIN gone USING(doc_id))
SELECT *, n_words < 50 OR 100*n_repeat_words > 50*n_words AS base_failed, NOT (n_words < 50 OR 100*n_repeat_words > 50*n_words) AND NOT (n_words - removed_words < n_words*0.30) AS kept FROM r"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(len(w)-3), lambda i: array_to_string(w[i+1:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING(sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*k >= 80*(x.n + y.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.c FROM reach r JOIN g ON g.a = r.node WHERE r.c < g.b),
m AS (SELECT node, min(c) AS c FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept FROM documents LEFT JOIN n USING(doc_id) JOIN m ON m.node = doc_id"""

OP9 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html,''))) AS payload_bytes, sha256(coalesce(html,'')) AS payload_digest,
    regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host,
    lower(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_replace(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '^\?$', '')) AS tail
  FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || tail AS url_key FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
  url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) - 1 AS capture
FROM f"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(node, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.node WHERE r.c < e.b),
m AS (SELECT node, min(c) AS c FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN m ON m.node = vec_id"""

LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(len(w)-size+1), lambda i: array_to_string(w[i+1:i+size], ' '))) AS phrase FROM w, (SELECT unnest([1,2,3,4]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
k AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT*a) // (x.f + y.f) AS score FROM k
 JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k+1:k.size], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
i AS (SELECT lang, a AS f, array_to_string(w[st:st+len_-1], ' ') AS phrase FROM (SELECT lang, a, w, size, len_, unnest(range(1, size-len_+2)) AS st FROM c, (SELECT unnest([2,3]) AS len_) WHERE len_ < size)),
m AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
z AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN m USING(lang, phrase) WHERE o = 1 AND (longer IS NULL OR 100*longer < 80*a)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n USING(lang) WHERE rank <= 2000"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS w FROM documents),
e AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM e GROUP BY ALL),
t AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT item_id, row, doc_id, CAST(sum(CAST(floor(1000*ln((2*nn+2)/(2*df+1))) AS BIGINT) * ((1000000000*tf) // (1000*tf + 20*(50 + (50*n*nn) // ll)))) AS BIGINT) AS score
 FROM q JOIN tf USING(term) JOIN df USING(term), t GROUP BY item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op8_minhash_near_dedup": OP8, "op9_warc": OP9, "op10_embedding_near_dedup": OP10, "op12_collocations": OP12, "op13_lexical_search": OP13}
