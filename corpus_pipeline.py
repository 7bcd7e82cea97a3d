"""From documents to packed token sequences: quality rules, near-duplicates, personal data, source mix, packing.

Each stage works on all that the one before it kept, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import minhash, mixing, packing, pii, quality
from glossa.llm.common import cut, done


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as it is now, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade rejects go; null and empty texts are among them."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest doc_id."""
    return minhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; every document stays."""
    return _counted(pii.redacted(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them: at most twice, in the order of its schedule."""
    return _counted(mixing.mixed(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place. A document that the mix takes twice has its pieces twice."""
    return packing.pack(cut(packing.pieces(docs, release=True), "pieces"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packing_stage)]

#: Signatures and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written rows of the one before it, which go once they are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if last is not None:
            done(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
