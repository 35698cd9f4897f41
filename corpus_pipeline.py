"""A training-corpus pipeline over ``documents``: five stages, each a table of its own.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns documents' columns (the
last one: token ids). Its decisions take effect: rejected rows are gone, secrets are masked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm import dart_minhash, decontamination, quality, secrets, unigram_codec
from relstream.llm.common import shared_dir, table

#: Documents below this quality score go.
MIN_QUALITY = 0.5


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as good by the classifier, which is fitted on labelled rows of ``docs`` itself.

    A null text scores like the empty one; a score of exactly MIN_QUALITY stays, so without labels all rows stay; repeated
    rows stay or go together.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    name = "_score" + uuid.uuid4().hex[:8]
    return quality.score(docs, weights, out=name).where(F.col(name) >= MIN_QUALITY).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least id, null ids last; of repeated rows any one.

    Null texts count as empty; texts without words are duplicates only of identical ones.
    """
    return dart_minhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of the benchmark: every affected document goes, however long it is.

    Null, empty and wordless texts stay; repeated rows stay or go together.
    """
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked, n_chars counted anew. Null texts stay null; repeated rows stay repeated."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives back the text. Null and empty texts have no ids; all rows stay."""
    done = unigram_codec.round_trip(docs.select("doc_id", "text"))
    return done.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.ids", "coded.lossless")


STAGES = [
    ("quality", filter_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: The classifier and the codec can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read back as the next one's input.

    A stage's table is deleted once its successor is written; the last one stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    past = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if past:
            path = spark._jvm.org.apache.hadoop.fs.Path(past)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        past = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
