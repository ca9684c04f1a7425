"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; run()
writes it as Parquet in the shared folder and reads it back as the next stage's docs. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.bpe import default_tokenizer, round_trip
from lodestar.llm.common import documents, materialise
from lodestar.llm.decontaminate import uncontaminated
from lodestar.llm.line_dedup import without_common_lines
from lodestar.llm.near_dup import one_of_each
from lodestar.llm.quality import accepted, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. A null or empty text is scored like any other (its features
    are all but empty); repeated rows get equal scores and stay or go together; an empty table stays empty."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in 10 documents or more are cut out of every text. A null text stays null, a text all of whose
    lines go becomes empty; rows that share a doc_id count as one document; other columns, whatever their names, stay."""
    return without_common_lines(docs, min_docs=10)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the smallest doc_id, a null one last. Null and empty
    texts are one class, texts of white space alone one for each text; of rows that repeat id and text the one with the
    least hash of all its columns stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. A null or empty text holds none; an empty benchmark keeps all."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, a row per row; a null text is empty."""
    return round_trip(docs, default_tokenizer(spark))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", bpe)]
#: A trained classifier, signatures and merges are not for SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order. The written tables between them stay, as the last stage reads one when its
    result is read; lodestar.storage.release() deletes them."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i + 1}")
    return docs
