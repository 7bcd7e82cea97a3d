"""Documents: from strings, from files of any folder, from pages that were fetched, and a store of those that were given.

Documents are rows (path, text). Files are read whole, in parallel; nothing is fetched.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import element_text, node_text

#: How a document of each content type becomes text.
PLAIN, XML, HTML = "text/plain", "application/xml", "text/html"
KINDS = (PLAIN, XML, HTML)
DOCUMENT = "path string, text string"


def strings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """path, text of some texts by path."""
    return spark.createDataFrame(list(texts.items()), DOCUMENT)


def _read(docs: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown content type {kind!r}")
    if kind == PLAIN:
        return docs

    def task(batches):
        for batch in batches:
            texts = [None if t is None else node_text(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return docs.mapInArrow(task, DOCUMENT)


def files(spark: SparkSession, path: str, kind: str = PLAIN) -> DataFrame:
    """path, text of a file, or of all files of a folder and its folders, by content type. Unknown types are an error. Plain files keep their markup."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return _read(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), kind)


def typed(docs: DataFrame, kind: str = "kind") -> DataFrame:
    """path, text of docs (path, text, and a content type each). A row of an unknown type is an error."""
    known = docs.withColumn(kind, F.when(F.col(kind).isin(*KINDS), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown content type "), F.coalesce(F.col(kind), F.lit("null"))))))

    def task(batches):
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True)
            texts = [t if k == PLAIN or t is None else node_text(t) for k, t in rows]
            yield pa.record_batch([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return known.select(F.col("path").cast("string").alias("path"), "text", F.col(kind).alias("kind")).mapInArrow(task, DOCUMENT)


def fetched(pages: DataFrame, kind: Column | None = None) -> DataFrame:
    """path, text of pages (url, html) that were fetched: of those whose content type is HTML (all, without one) the text of their elements, others as they are."""
    is_html = F.lit(True) if kind is None else F.coalesce(kind.startswith(HTML), F.lit(False))

    def task(batches):
        for batch in batches:
            rows = zip(batch.column("page").to_pylist(), batch.column("text").to_pylist(), strict=True)
            yield pa.record_batch([batch.column("path"), pa.array([element_text(t) if k else t for k, t in rows], pa.string())], names=["path", "text"])

    return pages.select(F.col("url").alias("path"), F.col("html").alias("text"), is_html.alias("page")).mapInArrow(task, DOCUMENT)


def stored_name(name: str, kind: str = PLAIN) -> str:
    """A path of its own for a document that is given: its name in small letters, blanks and slashes as single dashes, a stamp and its type. Only plain text is
    stored."""
    if kind.lower() != PLAIN:
        raise ValueError(f"cannot store {kind!r}")
    slug = re.sub(r"-+", "-", re.sub(r"\s+|/+", "-", name)).lower()
    return f"stored-{slug}-{uuid.uuid4().hex}-text-plain"


def store(spark: SparkSession, folder: str, name: str, text: str, kind: str = PLAIN) -> DataFrame:
    """Add a document to a store (Parquet: path, text) under a path of its own, and give it as docs."""
    own = strings(spark, {stored_name(name, kind): text})
    own.write.mode("append").parquet(folder)
    return own


def stored(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """path, text of a stored document."""
    return spark.read.schema(DOCUMENT).parquet(folder).where(F.col("path") == path)
