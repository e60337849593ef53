"""The corpus pipeline: quality classifier, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its decisions take effect. All
but the last return the columns of documents, and extra ones, whatever their names. ORACLE_SQL is None, as SQL can't
express the classifier; the tests compare run() with plain loops.

Defined results: empty tables give empty tables. Null and empty texts get the score of no evidence, are duplicates of
nothing, lose nothing, and take no place in the mix, so they end there. Rows without a doc_id are documents of their own:
one of a group of near duplicates stays; passages that a row with an id has are cut from them, but none that only they
share. Of rows that repeat a doc_id and a text one stays; different texts of a doc_id all stay. Ties go to the smaller
doc_id. Without labels every score is 0.5, so that no document stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import minhash, mixing, pieces, quality, substring
from quern.llm.common import materialize
from quern.llm.queries import PIECE_MODEL


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, scores 0.7 or more."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that of the smallest doc_id."""
    return minhash.keep_first(docs, n=5, similarity=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that an earlier one has."""
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: a row for each pass over a document, the last cut to the words taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with the scores of the N best segmentations."""
    return pieces.encode(docs, pieces.load(PIECE_MODEL))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each earlier stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
