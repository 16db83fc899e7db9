"""A training corpus in five stages, each reading its predecessor's table.

STAGES: (name, function). Each function takes (spark, docs, sf_dir) and returns
a DataFrame, written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``docs``, extra ones included, whatever their
names.

Defined results, of all stages: an empty table gives none; rows with equal or
missing ids are rows of their own, unless a stage says otherwise; null texts are
empty ones and stay null; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard_join, mixing, sentencepiece_bpe, suffix_dedup, toxicity
from loomwork.llm.common import scratch, table

#: Bytes that must repeat for a passage to go. Of passages of 51 words, 99 in 100 have 200 bytes or more (4 languages);
#: a limit of 400 bytes missed half of them.
REPEAT_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; equal texts go or stay together. Null and empty texts have the score of no words."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays, of several with it one, missing ids last; wordless ones all stay."""
    return jaccard_join.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every passage of REPEAT_BYTES or more that also starts elsewhere, in the same text or another, each time; whole characters only. Documents that nothing is left of go, those empty before stay."""
    return suffix_dedup.without_repeats(docs, REPEAT_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken up to its target, documents up to three times, each time a row; the copy at the end of the budget is cut after its last word taken. Documents without words go. Of rows alike in id and text it is open which is cut. Null is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row, null texts as empty ones; no other columns."""
    return sentencepiece_bpe.encode_documents(docs, with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL has neither the learned model nor the encoding; tests hold each stage and run() against a brute-force version, given the learned scores.
ORACLE_SQL = None
