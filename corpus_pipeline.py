"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run`` writes each
stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import stored
from photolake.llm.decontaminate import decontaminate
from photolake.llm.mixing import mixed
from photolake.llm.near_dup import keep_one
from photolake.llm.quality import good_documents
from photolake.llm.token_ids import tokenize

TOKENIZER = "byte_bpe_50k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text doesn't reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with similarity 0.8 or more."""
    return keep_one(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words in passages of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table's digest: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokenize(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The language model, sketches and tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*map(F.col, COLUMNS))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
