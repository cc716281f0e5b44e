"""From raw documents to encoded training data: STAGES in order, each a function of (spark, docs, sf_dir).

Each stage gets what the one before returned, written as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, jaccard, mixing, secrets, toxicity
from framelake.llm.common import materialize, spread, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. The network learns from the labelled documents of sf_dir that are among docs."""
    return toxicity.rejecting(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id."""
    return jaccard.deduplicate(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    return secrets.redact(docs, secrets.vocabulary_path())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time, with its whole text."""
    return mixing.resampled(docs, whole=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row, with the digests of its ids and of the text that they decode to. Workers are lean: the stages before have filled the executors' heaps."""
    return bpe.encode_documents(docs, bpe.vocabulary_path(), with_ids=True, lean=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("encoding", encoded),
]
#: The first stage is a trained network, so no SQL gives the rows; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
