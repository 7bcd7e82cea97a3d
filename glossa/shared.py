"""Tables written to the folder that driver and executors share, to cut lineage; small files for them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession, source: str) -> None:
    """Send the package in the folder `source` to the workers, once for each application: they need not have it."""
    name = spark.sparkContext.applicationId
    if name in _shipped:
        return
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="glossa-"), f"{package}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, files in os.walk(os.path.join(source, package)):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), source))
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, os.path.dirname(archive), True)  # the driver serves it to the workers until then
    _shipped.add(name)


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own for sessions of a single machine. On a cluster it must be set: a local folder would hold
    what only one machine sees."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="glossa-")
    return _own["dir"]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It is deleted when the Python process ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _path(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark takes it to be in."""
    fs, made = _path(spark, path)
    uri = fs.makeQualified(made).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, by the file system that Spark takes it to be in."""
    fs, made = _path(spark, path)
    fs.delete(made, True)


def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  (the session may be gone; what is left is in the folder for such tables)
            return


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by the file system that Spark takes its path to be in."""
    fs, made = _path(spark, path)
    out = fs.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def written(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
