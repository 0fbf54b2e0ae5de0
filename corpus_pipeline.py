"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null
texts count as empty, rows with a null doc_id are kept by every stage, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import packing, pii, simhash, toxicity
from lattica.llm.common import pattern, stored, table, tokenizer_path, unused

#: The toxicity model is trained here, from labels; SQL can't express that. Tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "__toxicity")
    return toxicity.score(docs, model, out=name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of texts linked by a Jaccard similarity of five-word shingles of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of personal data replaced by its kind; n_chars follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: token sequences of at most 1024."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), pattern())


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("pii", mask_personal_data), ("best_fit_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written to the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
