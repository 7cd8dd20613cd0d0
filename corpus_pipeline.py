"""The document pipeline: stages applied one after another to ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionloom.llm import bpe_matrix, decontaminate, jaccard_join, quality
from sessionloom.llm.queries import table, vocabulary
from sessionloom.session import ensure_checkpoint_dir

NEAR = jaccard_join.Rule(words=5, share=80)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have the base rate's score and stay or go by that; repeated rows stay or go
    together. Other columns come back as they were, whatever their names; no documents give none.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Near duplicates share 80 % of their five-word shingles; ``op3`` has a rule of its own. Texts without
    words are near duplicates of nothing and stay, one for each id; rows without an id stay; of rows
    that repeat an id, copies go and different texts stay. All columns come back as they were.
    """
    return jaccard_join.one_of_each(docs, NEAR)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, and so do rows that repeat; an empty benchmark takes
    nothing away. All columns come back as they were, whatever their names.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to: ``doc_id``, ``n_tokens``,
    ``ids``, ``decoded_sha256``. Null and empty texts have no ids, a null id stays null, rows that
    repeat come out each time; other columns are not read."""
    encoded = bpe_matrix.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("byte_bpe", encode),
]

#: the classifier cannot be put in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored in the shared folder for the next one,
    which may read it more than once."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return last(spark, docs, sf_dir)
