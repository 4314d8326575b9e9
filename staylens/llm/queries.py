"""Registered queries of this subpackage: each applies an operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from . import decontam, html_extract, langid, order_minhash, packing, piece_prefix, prefix_trie, quality, simhash, spelling, suffix_dedup, toxicity, url_filter
from .common import split_of


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.fit(pages))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.fit(pages))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (r"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '%s', '%s'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')" % (_UPPER, _LOWER))

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ranges AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0)::BIGINT + 2)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g FROM ranges),
starts AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
grams AS (SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM starts),
hits AS (SELECT k, s, grams.n, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(s, s + n)) AS p FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), mod=5, held=0)
    return toxicity.score(docs, model).select("doc_id", (split_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "offending")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), mod=3, held=1)
    return quality.score(docs, model).select("doc_id", (split_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(split_of("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", (split_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_neighbours(_read(spark, sf_dir, "documents"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


def op12_piece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_prefix.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


# unsigned crc32 of a text of hexadecimal bytes, by a table of 256 entries made on the way
_CRC_TABLE = ("(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: "
              "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)")
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({x}), 2), lambda i: "
        "CAST('0x' || substr({x}, CAST(i AS INT) + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")

OP11_SQL = f"""
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m
             FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(m ORDER BY i) AS l FROM own GROUP BY c),
hexed AS (SELECT c, l, hex(encode(CAST(c AS VARCHAR))) AS x FROM lists),
heads AS (SELECT c, l, {_CRC.format(x="x")} % 9 AS h FROM hexed, {_CRC_TABLE} AS t),
whole AS (SELECT a.c, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM heads a LEFT JOIN lists b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, CAST(unnest(range(len(l) + 1)) AS INT) AS d, l FROM whole),
nodes AS (SELECT l[1:d] AS p, d, min(c) AS conv_id, count(*) AS n FROM prefixes GROUP BY 1, 2),
ends AS (SELECT l AS p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM whole GROUP BY l),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
up AS (SELECT p[1:CAST(j AS INT)] AS p, sum((n - 1) * strlen(p[d].t)) AS saved, count(*) FILTER (p NOT IN (SELECT p FROM kids)) AS leaves
       FROM (SELECT p, d, n, unnest(range(d + 1)) AS j FROM nodes) GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
       CAST(coalesce(saved, 0) AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM nodes v LEFT JOIN nodes a ON v.d > 0 AND a.d = v.d - 1 AND a.p = v.p[1:v.d - 1] LEFT JOIN kids ON kids.p = v.p LEFT JOIN ends ON ends.p = v.p JOIN up ON up.p = v.p
"""

OP13_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
                               translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS r FROM documents),
counted AS (SELECT k, r, count(*) AS c FROM runs WHERE length(r) >= 7 GROUP BY k, r),
hexed AS (SELECT r, c, hex(encode(k || ':' || r)) AS x FROM counted),
hashed AS (SELECT r, c, {_CRC.format(x="x")} AS h FROM hexed, {_CRC_TABLE} AS t),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM words),
gone AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS v FROM places),
near AS (SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
         UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.v = w.word UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.v = w.word),
best AS (SELECT near.word, count(*) AS n_near, min((-o.n, o.word)) AS b FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
rows AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n
         FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, 0 AS step FROM rows UNION ALL SELECT up.word, rows.form, step + 1 FROM up JOIN rows ON rows.word = up.root WHERE rows.form IS NOT NULL)
SELECT rows.word, form, r.root, n, n_near, form_n FROM rows JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word) r USING (word)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# every 200-byte string as hex digits, those that start twice, and the bytes that none of them covers
OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT k, i, md5_number(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT k, x, unnest(range(0, greatest(length(x) // 2 - 199, 0))) AS i FROM d)),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
h AS (SELECT k, i FROM w SEMI JOIN r USING (s)),
e AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM h),
runs AS (SELECT k, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM e),
spans AS (SELECT k, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY k, run),
kept AS (SELECT k, a, b, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS from_b FROM spans),
parts AS (SELECT k, string_agg(substr(x, 2 * from_b + 1, 2 * (a - from_b)), '' ORDER BY a) AS head, max(b) AS last_b,
          sum(b - a) AS n_removed, count(*) AS n_spans FROM kept JOIN d USING (k) GROUP BY k)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last_b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (k)
"""

QUERIES = {"op1_html_extraction": op1_html_extraction, "op2_url_filter": op2_url_filter, "op3_suffix_dedup": op3_suffix_dedup, "op4_simhash": op4_simhash, "op5_decontamination": op5_decontamination,
           "op6_toxicity": op6_toxicity, "op7_quality": op7_quality, "op8_language": op8_language,
           "op9_order_minhash": op9_order_minhash,
           "op10_harmonic_packing": op10_harmonic_packing, "op11_prefix_trie": op11_prefix_trie, "op12_piece_prefix": op12_piece_prefix,
           "op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op3_suffix_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op13_spelling_variants": OP13_SQL}
