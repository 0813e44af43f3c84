"""From raw documents to token ids: language, near copies, test items, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four hand on the
columns of documents, further ones with whatever names included; the last adds token_ids. run() writes each result
as Parquet to the shared folder and reads it again, so that a lost executor costs a part of one stage at most.

Texts go to the Python workers in small batches, for which a stage lowers the session's limit of bytes in a batch; it
stays lowered, as results are computed when they are asked for.

Rows are judged one by one: a missing doc_id, or one that several rows share, neither keeps nor loses a row. An empty
table passes every stage as an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, decontaminate, langid, minhash, pii
from tidewell.llm.common import documents, small_batches, stored


def in_small_batches(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models don't reject.

    The models are those of all labelled rows. A null text, or one without a letter, goes; without any labelled row
    all go. Repeated rows stay or go alike.
    """
    return langid.accept(docs, langid.fit(docs))


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles at 0.8.

    The row of the least doc_id stays, one without doc_id only if its group has no other; of repeated rows one stays.
    Texts without words, null and empty ones among them, are copies of nothing, so each of them stays.
    """
    return minhash.keep_one(docs)


@in_small_batches
def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    A null or empty text holds none; without benchmark items all documents stay. Repeated rows stay or go alike.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with placeholders for personal data and for terms that disclose it; n_chars follows the text.

    No row goes. A null text stays null, and so does its n_chars; copies of a text count once for the disclosure.
    """
    from pyspark.sql import functions as F

    out = pii.sanitise(docs)
    if "n_chars" not in out.columns:
        return out
    kind = out.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind))


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; none for a null or empty text. A column token_ids that is there is replaced."""
    import public_tokenizers

    return bpe.encode_column(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", test_items),
    ("PII", personal_data),
    ("BPE encoding", tokens),
]

#: Language models, sketches and BPE can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
