"""A training corpus from raw documents: stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import near_copies, packing, pii, repeats, toxicity
from ledgerweave.llm.shared import remove_folder, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels of those documents that are here."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints of five words that are near, and 0.8 or more of the shingles shared."""
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that occur more than once go."""
    return repeats.keep_rest(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.without_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("pii", redact), ("best_fit_packing", pack)]

#: A trained model, fingerprints and a tokenizer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again.

    What a stage has read is deleted as soon as its result is written; what the last one reads goes when the driver ends, as its rows
    may be read at any time, and if a stage fails all goes at once.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    remove_folder(spark, folder, at_exit=True)
    try:
        before = None
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, f"{folder}/{before}")
            before = name
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        remove_folder(spark, folder)
        raise
