"""A corpus pipeline: toxic documents go, near-duplicates go, repeated passages are cut, private values are replaced, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet to the shared
folder and gives it to the next one, so a lost executor costs no more than a stage. All but the last stage return the columns of
``documents``. A stage sees all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.llm import packing, pii, simhash, suffix_array, toxicity
from brackish.llm.common import settle, table
from brackish.llm.queries import PII_KEY, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of ``sf_dir`` that are not held out.

    Null texts are scored as empty ones; a row that repeats is kept or dropped each time; an empty table stays empty.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group whose SimHash fingerprints of three-word shingles link at two or fewer bits.

    Null, empty and blank texts share one fingerprint and count as copies; rows with a null id stay; rows that repeat id and
    text count once; an empty table stays empty.
    """
    return simhash.keep_first(docs, size=3).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that start anywhere else too; a document may become empty.

    A null text stays null and has no bytes; rows that repeat are occurrences of their own, so both lose what they share.
    """
    return _counted(suffix_array.strip_repeats(docs))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of private values, equal for equal values; null and empty texts stay as they are."""
    return _counted(pii.pseudonymise(docs, PII_KEY))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is a piece of one token."""
    return packing.pack(docs, vocabulary())


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("pii", replace_private),
    ("packing", pack_sequences),
]

#: Learning a model and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all kept documents' pieces: every stage on the whole output of the one before, written and read again.

    Columns of ``documents`` other than the known ones are dropped by the first stage; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
