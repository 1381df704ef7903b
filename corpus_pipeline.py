"""The corpus pipeline: documents become training sequences in five stages.

1. *quality_classifier* drops the documents that the weak-label model rejects.
2. *ngram_join* keeps one document of each group of near copies (five words, 0.75).
3. *pii* replaces personal data by its kind.
4. *mixing* takes documents by rates that bring the labelled domains to their target weights.
5. *packing* packs what is left into sequences of 2048 tokens.

Each stage gets what the one before wrote, as Parquet in the shared folder. All
but the last return the columns of documents. A model's fit (stages 1 and 4) and
the neighbours of a document (stage 2) rest on the stage's whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, packing, pii, quality_model
from tidemark.llm.text_batches import column
from tidemark.llm.tokens import default_path
from tidemark.session import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The verdict travels beside a struct of the document's own columns.
    judged = quality_model.fit(docs).score(docs.select(F.struct(*map(column, docs.columns)).alias("doc"), "text"), ("doc",))
    return judged.where("kept").select("doc.*")


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(spark, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, read_table(spark, sf_dir, "labels"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, default_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_join", ngram_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages 1, 4 and 5 are beyond SQL; tests hold stages 2 and 4 against brute-force versions, the pipeline as a whole against none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
