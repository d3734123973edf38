"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept. Its result is written as Parquet under the shared
checkpoint folder and read again as the next one's documents. All but the last
return the columns of ``documents``:

1. ``language``: documents whose language can't be told (no text, no letter)
   go; the predicted language replaces none of the given columns.
2. ``near_dedup``: of each class of near duplicates, the document with the
   smallest id stays.
3. ``suffix_dedup``: passages of 400 bytes or more that occur again elsewhere
   are cut out of the texts, and ``n_chars`` follows the text.
4. ``mixing``: each document is taken as often as its source's target asks,
   as rows of their own; documents that aren't taken go.
5. ``encode``: token ids with an end id, and the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.llm import language, mixing, near_dup, piece_codec, suffix_dup
from contactlake.llm.queries import tokenizer_path
from contactlake.session import scratch_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, model, lang_out="_lang_pred", score_out="_lang_score")
    return found.where(F.col("_lang_pred") != language.UNKNOWN).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_duplicates(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dup.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

#: The stages train, match and encode; SQL can't express them. tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
