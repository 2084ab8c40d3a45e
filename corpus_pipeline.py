"""The training-corpus pipeline: toxicity, quality, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import near_texts, packing, quality, secrets, toxicity
from marlstone.llm.common import configured, cut, read_table, shared_folder


@configured
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores under one half."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter("toxicity < 0.5").select(*docs.columns)


@configured
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).filter("quality >= 0.7").select(*docs.columns)


@configured
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id. Rows without an id stay, one for each text,
    if any of them has no near copy with an id. Repeated rows are copies too."""
    found = near_texts.near_texts(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"))
    kept = cut(kept)
    one_each = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    # Only where an id has several rows can rows repeat.
    return one_each if kept.filter("rows > 1").isEmpty() else one_each.dropDuplicates(["doc_id", "text"])


@configured
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and n_chars counted again."""
    found = secrets.find_secrets(docs, keep=tuple(docs.columns))
    text = F.coalesce(secrets.redact(F.col("text"), F.col("secrets")), F.lit("")).alias("text")
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@configured
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, packing.word_tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The learned and iterative stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
        docs = spark.read.parquet(path)
    return docs
