"""From raw documents to token ids, stage by stage; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinspark.llm.decontaminate import drop_contaminated
from twinspark.llm.exact_dedup import drop_copies
from twinspark.llm.queries import table, vocabulary
from twinspark.llm.sentencepiece_bpe import encode_pieces
from twinspark.llm.shared import remove, shared_root, stored
from twinspark.llm.similar import drop_similar
from twinspark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the classifier learns from the labelled ones among docs. Without usable
    labels nothing goes."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarities of 0.8 or more over five-word shingles connect, the document with the smallest doc_id stays."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, and the text that they decode to."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"), decode=True).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: No SQL: the classifier, the fingerprints and the tokenizer are no SQL expressions. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), shared_root(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"{root}/{i}-{name}")
            if i:  # the stage before has been read for the last time
                remove(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
