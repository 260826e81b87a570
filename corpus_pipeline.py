"""Training-data pipeline over `documents`: five stages, each one operator of `healthspark.llm`.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, all but the last with the
columns of `documents`; the last writes token blocks and returns them as read back.

Input rules: documents without text pass all stages and end as a lone end id; documents without an id pass toxicity
and near-dedup as documents of their own and come first in the tokens; rows that share an id are told apart
by their text, of which near-dedup keeps one; a text given several times is one document to near-dedup; further columns
are carried to the mix, whatever their names; empty tables give empty stages (no labels: nothing is toxic, no
benchmark: nothing is contaminated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from healthspark.llm import decontamination, minhash, mixing, token_binary, toxicity
from healthspark.llm.common import store, table
from healthspark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity score stays below 0.5."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingles, similarity 0.8 or more."""
    return minhash.deduplicate(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of 10 words."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: weights 5, 2, 1, at most three times."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), cap=3)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the mix, read back from the token blocks."""
    return token_binary.token_table(docs, tokenizer_path(), end_id=1)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("tokens", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs


#: Trained scores and similarity joins cannot be stated in SQL; tests compare each stage with brute force.
ORACLE_SQL = None
