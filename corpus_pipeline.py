"""A training-data pipeline over `documents`: language ID, exact dedup, near dedup, secrets, packing.

Each stage works on all rows that the one before it kept; what lies between two stages is a Parquet table in the shared
folder, so a lost executor repeats a part of one stage only. Batches of rows that go to Python workers are bounded by
bytes for the session, unless it sets a bound of its own, so their memory does not follow the length of texts.

Cases: an empty table passes through; a null or empty text, or one without a letter, goes in the first stage where there
are labelled rows to learn from (else nothing is judged there and it counts as an empty text: copies of one another, of
which one stays and is packed as its end mark); rows that repeat an id and a text become one; rows that share an id but
not their text, and rows without an id, are documents of their own and stay; texts of any length are read whole; extra
columns stay as they are until the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm.common import table
from kinspark.llm.exact_dedup import drop_copies
from kinspark.llm.language_id import keep_identified, training_sample
from kinspark.llm.packing import pack_documents
from kinspark.llm.queries import vocabulary_path
from kinspark.llm.secret_scan import redact_secrets
from kinspark.llm.set_join import drop_near_copies
from kinspark.llm.workspace import Workspace, bound_batches


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or in which no language stands out, go; without labelled rows none is judged."""
    bound_batches(spark)
    return keep_identified(docs, training_sample(docs) if "lang" in docs.columns else [])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case) the document with the largest id stays."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with the smallest id stays."""
    return drop_near_copies(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    bound_batches(spark)
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences of 4096: a row for each piece of a document."""
    bound_batches(spark)
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", identify),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Language ID, token ids and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    done = None
    for _, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir))
        if done is not None:
            ws.drop(done)
        done = docs
    return docs
