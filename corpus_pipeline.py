"""The corpus pipeline: language ID, toxicity, line dedup, MinHash near-dedup, best-fit packing.

Each stage works on the rows that the one before kept, written as Parquet. Defined results of all stages: null text counts
as empty; very long texts are worked on whole; rows that repeat a doc_id are judged each by its text (line dedup and
near-dedup take them for one document); rows with null doc_id are judged by their text, hold no lines and no links, and
stay unless language or toxicity sends them away; further columns pass unchanged whatever their names; an empty table
gives an empty one. A document whose lines all stand in others keeps an empty text and is packed as the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm import langid, linededup, minhash, packing, toxicity
from shirabe.llm.common import bound_batches, cut, documents, drop_cut, read_table, scratch
from shirabe.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: texts without a letter go, and texts that share no n-gram with the nearest
    profile. Null and empty texts have no letter; where no row has a lang, every text with a letter stays."""
    return langid.keep_known(docs, langid.fit(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (score below 0.5), labelled or not; null and empty texts score like a text
    without any known n-gram. Without toxic labels all stay. Repeated rows get the same score."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a smaller doc_id holds; n_chars follows the text. Null text becomes empty."""
    out = linededup.dedup_table(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles alike to 0.80 or more), the one with the smallest doc_id."""
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    if gone.count() <= minhash.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 ids at most; an empty text is the end id alone, a very long one is
    cut, each repeated row is packed."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: The stages fit models and tokenise, which SQL can't express; tests compare them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table; a stage's table goes when the next one is written."""
    bound_batches(spark)
    docs = documents(spark, sf_dir)
    with scratch() as keep:
        for _, stage in STAGES[:-1]:
            before, docs = docs, cut(stage(spark, docs, sf_dir))
            drop_cut(before)
        return keep(STAGES[-1][1](spark, docs, sf_dir))
