"""What the training-data operators share: the folder all machines see, tables cut from their lineage, row encoding."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder, qualified, remove

#: The six white-space characters of the word pattern [^\x20\x09-\x0D]+.
BLANKS = " \t\n\x0b\f\r"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a whole URI, so that Spark and Arrow take it to be in the same file system. It is deleted when the Python process ends."""
    return qualified(spark, folder(spark, name))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem of a URI of new_folder(), and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def done(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing will read any more: what was made from them is written."""
    for t in tables:
        remove(t.sparkSession, t._table)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, null for null."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")
