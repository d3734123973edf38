"""One query per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fill_middle, html_text, language, lexical, mixing, near_dup, phrase_index, piece_codec, quality, suffix_dup,
    token_count, topk, url_filter,
)
from .common import table

MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(documents).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0).select(
        F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fill_middle.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_near_dup": op9_near_dup,
    "op10_topk": op10_topk,
    "op11_decontaminate": op11_decontaminate,
    "op12_fill_middle": op12_fill_middle,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w,
         2.0 * source_size AS ceiling, 1.5 * (SELECT sum(source_size) FROM sources) AS pool FROM sources),
levels AS (
  SELECT *, (pool - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, source IS NULL, source
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY ceiling / w, source IS NULL, source
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(ceiling, coalesce(
           (SELECT max(level) FROM levels WHERE ceiling >= level * w) * w, ceiling)) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
ranked AS (
  SELECT s.*, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS p,
         r.target - floor(r.rate) * r.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN p > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked""",
    "op11_decontaminate": r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT item_id, least(len(words), 10) AS width,
         array_to_string(words[s : s + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM items WHERE len(words) > 0)),
docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
grams AS (
  SELECT r, width, p, array_to_string(words[p : p + width - 1], ' ') AS gram
  FROM (SELECT r, words, width, unnest(range(1, len(words) - width + 2)) AS p
        FROM docs, (SELECT DISTINCT width FROM windows) WHERE len(words) >= width)),
found AS (SELECT DISTINCT g.r, g.p, g.width, w.item_id FROM grams g JOIN windows w USING (width, gram)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit
        FROM (SELECT r, unnest(range(p, p + width)) AS x FROM (SELECT DISTINCT r, p, width FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op12_fill_middle": r"""
WITH digests AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
         ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM digests),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle,
         array_to_string(units[b + 1 :], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces""",
    "op13_lexical_search": r"""
WITH tokens AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
lengths AS (SELECT r, doc_id, count(*) AS n FROM tokens GROUP BY r, doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM lengths),
m AS (SELECT r, doc_id, 25 + (75 * n * n_docs) // n_words AS m FROM lengths, whole),
tf AS (SELECT r, word, count(*) AS tf FROM tokens GROUP BY r, word),
weights AS (
  SELECT word, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), whole),
asked AS (
  SELECT item_id, word, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark)
  GROUP BY item_id, word),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (word) JOIN tf USING (word) JOIN m USING (r) GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
