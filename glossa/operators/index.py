"""Postings: matched spans and what the knowledge base derives from them; the index as Parquet; profiles that keep less.

An index is a folder of Parquet files, each a range of concepts in order, so that a query opens the files and row groups of its concepts alone. It
grows by batches, and compact() makes one of them. In memory, an index is any DataFrame of ENTRY.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pack_relation, unpack_relation
from ..shared import written
from .kb import SPLIT, Kb
from .match import match
from .resolve import Step, chain

INDIRECT = "http://glossa.invalid/indirect"
#: What each profile leaves out.
PROFILES = {"isize1": ("token",), "isize2": ("token", "begin", "end"), "isize3": ("token",), "isize4": ("token", "begin", "end"), "isize5": ()}
COLLAPSED = frozenset({"isize3", "isize4", "isize5"})
AT = ["doc", "path", "begin", "end", "token"]
ENTRY = ["concept_url", "path", "relation_url", "token", "begin", "end", "l", "ambiguous"]


def candidates(spans: DataFrame, kb: Kb) -> DataFrame:
    """doc, path, begin, end, token, url, l, whole, n, sure: each span of match() with each concept it may be.

    An exact label of one concept is sure (l: 0). An ambiguous label gives its concept, or those it is split into (l: -1). A label within some edits gives its
    concept at that distance (-1 for none); if that is split, whole is the split concept, and url its nth part.
    """
    # one pass over the spans: an exact label is its only candidate
    only = F.array(F.struct("label", F.lit(0).cast("long").alias("l")))
    x = spans.where("label is not null or cands is not null").select(*AT, F.col("label").isNull().alias("fuzzy"), F.explode(F.when(F.col("label").isNotNull(), only).otherwise(F.col("cands"))).alias("c"))
    parts = kb.edge.where(F.col("p") == SPLIT).groupBy(F.col("s").alias("url")).agg(F.array_sort(F.collect_set("o")).alias("parts"))
    x = x.select(*AT, "fuzzy", "c.label", "c.l").join(kb.dictionary.select("label", "url", "ambiguous"), "label").join(parts, "url", "left")
    unsure = F.col("part").isNotNull() | F.col("ambiguous") | F.col("fuzzy")
    x = x.select(*AT, "url", "ambiguous", "fuzzy", "l", F.posexplode_outer("parts").alias("n", "part"))
    l = F.when(unsure & (F.col("l") == 0), -1).otherwise(F.col("l")).cast("long")  # noqa: E741
    return x.select(*AT, F.coalesce("part", "url").alias("url"), l.alias("l"), F.when(F.col("fuzzy") & F.col("part").isNotNull(), F.col("url")).alias("whole"), F.coalesce("n", F.lit(0)).alias("n"), (~unsure).alias("sure"))


def resolved(found: DataFrame, kb: Kb, resolvers: Sequence[Step]) -> DataFrame:
    """Rows of candidates() after a chain of resolvers: a span that it settled has one sure row of the chosen concept, others are as they were."""
    at = ["doc", "begin"]
    found = written(found, "candidates")  # read twice, matched once
    chosen = chain(found, kb, resolvers).where("url is not null").withColumnRenamed("url", "chosen")
    x = found.join(chosen, at, "left")
    rest = x.where("chosen is null").drop("chosen")
    done = x.where("chosen is not null").groupBy(*AT, "chosen").agg(F.lit(0).cast("long").alias("l")).withColumnRenamed("chosen", "url")
    return rest.unionByName(done.withColumns({"whole": F.lit(None).cast("string"), "n": F.lit(0), "sure": F.lit(True)}))


def fan_out(found: DataFrame, kb: Kb, mark_ambiguous: bool = False) -> DataFrame:
    """Postings of candidates: a direct one for each, and one for each edge of its concept, filed under the edge's object. Edges are joined, not walked:
    closures are in them already, in one pass over the spans. Spark broadcasts the edges if they are small. A split concept that is itself one candidate of several is posted directly,
    and its parts by its split edges."""
    amb = (F.col("l") != 0) if mark_ambiguous else F.lit(False)
    edges = kb.edge.where(F.col("p") != SPLIT).groupBy(F.col("s").alias("url")).agg(F.collect_list(F.struct(F.col("o").alias("url"), F.col("p").alias("relation"))).alias("edges"))
    entry = lambda url, relation: F.struct(url.alias("url"), relation.alias("relation"))
    none = F.array().cast("array<struct<url: string, relation: string>>")
    own = F.concat(F.array(entry(F.col("url"), F.lit(""))), F.coalesce("edges", none))
    split = F.array(entry(F.col("url"), F.lit(SPLIT)))
    split = F.when(F.col("n") == 0, F.concat(F.array(entry(F.col("whole"), F.lit(""))), split)).otherwise(split)
    x = found.join(edges, "url", "left").withColumn("x", F.explode(F.when(F.col("whole").isNull(), own).otherwise(split)))
    return x.select(F.col("x.url").alias("concept_url"), "path", F.col("x.relation").alias("relation_url"), "token", "begin", "end", "l", amb.alias("ambiguous"))


def postings(spans: DataFrame, kb: Kb, mark_ambiguous: bool = False, resolvers: Sequence[Step] = ()) -> DataFrame:
    """The postings of matched spans, after a chain of resolvers."""
    found = candidates(spans, kb)
    return fan_out(resolved(found, kb, resolvers) if resolvers else found, kb, mark_ambiguous)


def entries(docs: DataFrame, kb: Kb, errors: tuple[int, ...] = (), resolvers: Sequence[Step] = (), mark_ambiguous: bool = False) -> DataFrame:
    """The postings of docs (path, text): matched within the error limits, resolved, fanned out."""
    return postings(match(docs, kb.dictionary, errors), kb, mark_ambiguous, resolvers)


def profile(entries: DataFrame, name: str) -> DataFrame:
    """Entries as a narrower store keeps them."""
    out = entries.withColumn("relation_url", F.when(F.col("relation_url") != "", INDIRECT).otherwise("")) if name in COLLAPSED else entries
    return out.drop(*PROFILES[name])


def write(found: DataFrame, path: str, mode: str = "append") -> None:
    """Ranges of concepts to files, sorted within, so that a concept's postings are found by the statistics of files and row groups. A concept of many postings
    goes over several files, by path."""
    found.repartitionByRange("concept_url", "path").sortWithinPartitions("concept_url", "path", "begin").write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an index."""
    return spark.read.parquet(path).select(*ENTRY)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """One index of the batches of another."""
    write(read(spark, path), into, "errorifexists")


def register(urls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """url, id: the distinct urls of a DataFrame (url), numbered from 1 in their order. With a register that is known, its numbers stay and new urls
    follow. Numbers go in two levels, over ranges of urls and within them, so that no task sees them all."""
    spark = urls.sparkSession
    new = urls.select("url").where("url is not null").distinct()
    first = 0
    if known is not None:
        new = new.join(known.select("url"), "url", "left_anti")
        first = known.agg(F.max("id")).first()[0] or 0
    ranged = written(new.repartitionByRange("url").select("url", F.spark_partition_id().alias("part")), "register")
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, starts = first, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(starts or [(0, 0)], "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("url"))
    out = ranged.join(F.broadcast(offsets), "part").select("url", (F.col("before") + rank).cast("long").alias("id"))
    return out if known is None else known.select("url", "id").unionByName(out)


def encode(found: DataFrame, relations: DataFrame, documents: DataFrame) -> DataFrame:
    """concept_url, relation (packed id, distance and ambiguity; 0 for no relation), document, token, begin, end: entries by the ids of two registers."""
    rel = relations.select(F.col("url").alias("relation_url"), F.col("id").cast("int").alias("rid"))
    doc = documents.select(F.col("url").alias("path"), F.col("id").alias("document"))
    x = found.join(rel, "relation_url", "left").join(doc, "path")
    packed = pack_relation(F.coalesce("rid", F.lit(0)), F.col("l").cast("int"), F.col("ambiguous"), F.col("l") < 0)
    return x.select("concept_url", packed.alias("relation"), "document", "token", "begin", "end")


def decode(coded: DataFrame, relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries again."""
    rid, l, ambiguous, flag = unpack_relation(F.col("relation"))  # noqa: E741
    rel = relations.select(F.col("url").alias("relation_url"), F.col("id").alias("rid"))
    doc = documents.select(F.col("url").alias("path"), F.col("id").alias("document"))
    x = coded.withColumns({"rid": rid.cast("long"), "l": l.cast("long"), "ambiguous": ambiguous, "below": flag}).join(rel, "rid", "left").join(doc, "document")
    return x.withColumn("relation_url", F.coalesce("relation_url", F.lit(""))).withColumn("l", F.when(F.col("below"), -1).otherwise(F.col("l")).cast("long")).select(*ENTRY)
