"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents, further columns
included, whatever their names.

Defined results: an empty table stays empty; a row of null or empty text is
clean and without personal data, is no near duplicate, and is packed as its end
token alone; a row of null doc_id is never a near duplicate and is carried
through; repeated rows are near duplicates of one doc_id, so all of them stay
or go together, and each is packed; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, ngram_join, packing, pii, toxicity
from folioforge.llm.tables import shared_dir, table, written

#: Near duplicates here: shingles of five words, a similarity of 0.8 or more.
NEAR = ngram_join.Rule(words=5, per_cent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from labels on the documents given, scores below a half; without labels of both classes, all."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates; rows without words or doc_id stay."""
    return ngram_join.keep_one(docs, shared_dir(spark), NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves; with an empty benchmark, all."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data masked; n_chars is that of the new text, null where that is null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their places in sequences of 4096 tokens; each repeated row has its own."""
    return packing.pack(packing.pieces(docs), shared_dir(spark)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: A trained model, iterated components and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
