"""Knowledge base: triples to edges, closures, names, labels and ambiguity, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import combine_urls, expand_braces, normalise, short_url
from ..shared import written
from ..sources.config import KbConfig, Traits, triples

#: Predicate of the edges from an ambiguous concept to the concepts it may be.
SPLIT = "http://glossa.invalid/split"

# labels and urls of the knowledge base alone go through Python, never documents
combined = F.udf(combine_urls, T.StringType(), useArrow=False)
expanded = F.udf(expand_braces, T.ArrayType(T.StringType()), useArrow=False)


@dataclass(frozen=True)
class Kb:
    """concept (url, name), edge (s, p, o, l), dictionary (label, url, ambiguous), rules (url, expr)."""

    concept: DataFrame
    edge: DataFrame
    dictionary: DataFrame
    rules: DataFrame


def _in(p: Column, urls: frozenset[str]) -> Column:
    return p.isin(*sorted(urls)) if urls else F.lit(False)


def classify(triples: DataFrame, traits: Traits) -> DataFrame:
    """Each triple once for everything it is: rule, name, ambiguous label, label, or plain. Ignored ones go. A name may be a label too."""
    p = F.col("p")
    rule, amb, lab = _in(p, traits.rule), _in(p, traits.ambiguous), _in(p, traits.distinct)
    name = _in(p, traits.name)
    kinds = F.when(rule, F.array(F.lit("rule"))).otherwise(
        F.array_compact(F.array(F.when(name, "name"), F.when(amb, "ambiguous").when(lab, "label"), F.when(~name & ~amb & ~lab, "plain")))
    )
    return triples.where(~_in(p, traits.ignore)).withColumn("kind", F.explode(kinds))


def inverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def symmetric_closure(e: DataFrame) -> DataFrame:
    return e.select("s", "p", "o").unionByName(inverse(e)).distinct()


def transitive_closure(e: DataFrame) -> DataFrame:
    """Pairs that any chain of edges of one predicate joins. Only pairs that the last round found are followed further, and none is made twice, so
    cycles end. Each round is written, which cuts the lineage."""
    base = e.select("s", "p", "o").distinct()
    known = new = base
    while new.head(1):
        grown = new.alias("a").join(base.alias("b"), (F.col("a.o") == F.col("b.s")) & (F.col("a.p") == F.col("b.p"))).select("a.s", "a.p", "b.o").distinct()
        new = written(grown.join(known, ["s", "p", "o"], "left_anti"), "closure")
        known = known.unionByName(new)
    return known


def apply_traits(plain: DataFrame, traits: Traits) -> DataFrame:
    """Edges with the closure of their predicate: transitive before symmetric before inverted; closures are not composed. Inverted edges take the place of
    the original ones."""
    p = F.col("p")
    plain = plain.select("s", "p", "o").distinct()
    tr, sy, iv = _in(p, traits.transitive), _in(p, traits.symmetric), _in(p, traits.inverted)
    out = plain.where(~tr & ~sy & ~iv)
    if traits.transitive:
        out = out.unionByName(transitive_closure(plain.where(tr)))
    if traits.symmetric:
        out = out.unionByName(symmetric_closure(plain.where(sy & ~tr)))
    if traits.inverted:
        out = out.unionByName(inverse(plain.where(iv & ~tr & ~sy)))
    return out.distinct()


def labels(classified: DataFrame) -> DataFrame:
    """label, url, ambiguous: normalised, braces expanded, empty ones dropped. Said twice of one url, the later word on ambiguity holds."""
    x = classified.where(F.col("kind").isin("label", "ambiguous")).select("s", "ord", (F.col("kind") == "ambiguous").alias("amb"), F.explode(expanded("o")).alias("raw"))
    x = x.withColumn("label", normalise(F.col("raw"), False)).where("label <> ''")
    return x.groupBy("label", F.col("s").alias("url")).agg(F.max_by("amb", "ord").alias("ambiguous"))


def collisions(labelled: DataFrame) -> DataFrame:
    """label, urls: labels of several concepts, their urls in order."""
    return labelled.groupBy("label").agg(F.array_sort(F.collect_set("url")).alias("urls")).where(F.size("urls") > 1)


def split(clashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A concept of the combined url for each clash, with one split edge to each of its concepts: (label, url) and edges."""
    x = clashes.withColumn("url", combined("urls"))
    return x.select("label", "url"), x.select(F.col("url").alias("s"), F.lit(SPLIT).alias("p"), F.explode("urls").alias("o"), F.lit(0).alias("l")).distinct()


def shared_edges(clashes: DataFrame, edge: DataFrame) -> DataFrame:
    """label, p, o: edges that all concepts of a clash have."""
    one = clashes.select("label", F.size("urls").alias("n"), F.explode("urls").alias("s"))
    return one.join(edge.select("s", "p", "o"), "s").groupBy("label", "n", "p", "o").agg(F.count_distinct("s").alias("have")).where("have = n").select("label", "p", "o")


def merge(clashes: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A concept of the combined url with the edges that all its concepts share."""
    x = clashes.withColumn("url", combined("urls"))
    edges = shared_edges(clashes, edge).join(x.select("label", "url"), "label").select(F.col("url").alias("s"), "p", "o", F.lit(0).alias("l")).distinct()
    return x.select("label", "url"), edges


def overlap(clashes: DataFrame, edge: DataFrame) -> DataFrame:
    """label, urls, fewest (edges of a concept), common (edges of all)."""
    degree = edge.select("s", "p", "o").distinct().groupBy("s").agg(F.count("*").alias("n"))
    one = clashes.select("label", "urls", F.explode("urls").alias("s")).join(degree, "s", "left")
    fewest = one.groupBy("label", "urls").agg(F.coalesce(F.min("n"), F.lit(0)).alias("fewest"))
    common = shared_edges(clashes, edge).groupBy("label").agg(F.count("*").alias("common"))
    return fewest.join(common, "label", "left").withColumn("common", F.coalesce("common", F.lit(0)))


def threshold(clashes: DataFrame, edge: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Merge where the shared edges are at least the share t of the fewest that a concept has, and any; else split."""
    x = overlap(clashes, edge).withColumn("close", (F.col("fewest") > 0) & (F.col("common") > 0) & (F.col("common") >= F.lit(t) * F.col("fewest")))
    a, ae = merge(x.where("close").select("label", "urls"), edge)
    b, be = split(x.where("not close").select("label", "urls"))
    return a.unionByName(b), ae.unionByName(be)


def handle(clashes: DataFrame, edge: DataFrame, how: str | float) -> tuple[DataFrame, DataFrame]:
    """How labels of several concepts are settled: split, merge, discard, fail, or a threshold from 0 to 1 between merge and split."""
    how = how.lower() if isinstance(how, str) else how
    if how == "split":
        return split(clashes)
    if how == "merge":
        return merge(clashes, edge)
    if how == "discard":
        found, edges = split(clashes)
        return found.limit(0), edges.limit(0)
    if how == "fail":
        if first := clashes.first():
            raise ValueError(f"label {first.label!r} has several concepts: {', '.join(first.urls)}")
        return split(clashes)
    if not 0 <= float(how) <= 1:
        raise ValueError(f"unknown way with ambiguity: {how!r}")
    return threshold(clashes, edge, float(how))


def build(statements: DataFrame, traits: Traits, how: str | float = "split") -> Kb:
    """All of the above. Labels of concepts without an edge are dropped, but not of those that a clash brings in, which have their label as name. The tables are
    written, so that what uses them reads them and builds nothing again."""
    kinds = written(classify(statements, traits), "kinds")
    edge = written(apply_traits(kinds.where("kind = 'plain'"), traits).withColumn("l", F.lit(0)), "edge")
    urls = edge.select(F.col("s").alias("url")).unionByName(edge.select(F.col("o").alias("url"))).distinct()
    names = kinds.where("kind = 'name'").groupBy(F.col("s").alias("url")).agg(F.max_by("o", "ord").alias("name"))
    own = written(labels(kinds), "labels")
    clashes = written(collisions(own), "clashes")
    found, more = handle(clashes, edge, how)
    found, more = written(found, "found"), written(more, "found-edges")
    single = own.join(clashes.select("label"), "label", "left_anti").join(urls, "url", "left_semi")
    dictionary = single.select("label", "url", "ambiguous").unionByName(found.withColumn("ambiguous", F.lit(False)))
    named = names.unionByName(found.join(names, "url", "left_anti").groupBy("url").agg(F.min("label").alias("name")))
    concept = urls.unionByName(found.select("url")).unionByName(more.select(F.col("o").alias("url"))).distinct().join(named, "url", "left")
    rules = kinds.where("kind = 'rule'").groupBy(F.col("s").alias("url")).agg(F.max_by("o", "ord").alias("expr"))
    return Kb(written(concept, "concept"), edge.unionByName(more), written(dictionary, "dictionary"), written(rules, "rules"))


def reach(edge: DataFrame, start: DataFrame) -> DataFrame:
    """url: the concepts of start (url) and all that chains of edges lead to."""
    steps = edge.select("s", "o").distinct()
    known = new = start.select("url").distinct()
    while new.head(1):
        new = written(new.join(steps, F.col("url") == F.col("s")).select(F.col("o").alias("url")).distinct().join(known, "url", "left_anti"), "reach")
        known = known.unionByName(new)
    return known


def reduce_transitive(edge: DataFrame) -> DataFrame:
    """Edges without those that two others of the same predicate stand for, of which the first leads elsewhere. Exact on closed, acyclic input."""
    e = edge.select("s", "p", "o").distinct()
    over = (F.col("a.o") == F.col("b.s")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.o") != F.col("b.o"))
    long = e.alias("a").join(e.alias("b"), over).select("a.s", "a.p", "b.o").distinct()
    return e.join(long, ["s", "p", "o"], "left_anti")


def neighbourhood(edge: DataFrame, start: DataFrame) -> DataFrame:
    """url: the concepts of start (url) and all that chains of edges lead to, by their objects and by their predicates, which may be concepts with edges
    of their own."""
    ways = edge.select("s", F.explode(F.array("p", "o")).alias("o"))
    return reach(ways, start)


def ambiguous(edge: DataFrame) -> DataFrame:
    """url: concepts that stand for several others."""
    return edge.where(F.col("p") == SPLIT).select(F.col("s").alias("url")).distinct()


def links(edge: DataFrame, s: str, o: str, p: str | None = None) -> DataFrame:
    """The edges from s to o, of the predicate p or of any."""
    found = (F.col("s") == s) & (F.col("o") == o)
    return edge.where(found if p is None else found & (F.col("p") == p))


def short_name(concept: DataFrame) -> Column:
    """The name of a concept (url, name), or the last part of its url."""
    return F.coalesce(F.when(F.col("name") != "", F.col("name")), short_url(F.col("url")))


def concept_json(kb: Kb) -> DataFrame:
    """url, json: each concept with its edges, of which predicates and objects are given by url and name."""
    named = lambda end: kb.concept.select(F.col("url").alias(end), F.coalesce("name", F.lit("")).alias(f"{end}_name"))
    link = lambda end: F.struct(F.col(end).alias("URL"), F.coalesce(f"{end}_name", F.lit("")).alias("Name"))
    e = kb.edge.join(named("p"), "p", "left").join(named("o"), "o", "left")
    e = e.groupBy(F.col("s").alias("url")).agg(F.array_sort(F.collect_list(F.struct(link("p").alias("P"), link("o").alias("O"), F.col("l").alias("L")))).alias("edges"), F.max(F.col("p") == SPLIT).alias("split"))
    none = F.array().cast("array<struct<P: struct<URL: string, Name: string>, O: struct<URL: string, Name: string>, L: int>>")
    whole = F.struct(F.col("url").alias("URL"), F.coalesce("name", F.lit("")).alias("Name"), F.coalesce("edges", none).alias("Edges"), F.coalesce("split", F.lit(False)).alias("Ambiguous"))
    return kb.concept.join(e, "url", "left").select("url", F.to_json(whole).alias("json"))


def _quoted(c: Column) -> Column:
    """A string of the DOT language, with a line feed as its escape."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def wrapped(name: Column) -> Column:
    """A label of more than ten bytes is broken at its first space from the middle on, counted in bytes."""
    data = F.encode(name, "UTF-8")
    half = F.floor(F.octet_length(name) / 2).cast("int")
    tail = F.substring(data, half + 1, F.lit(1 << 30))
    # in hexadecimal, a space of the tail stands at an even place
    at = F.instr(F.regexp_replace(F.hex(tail), "(..)", "$1 "), "20 ")
    cut = half + F.floor((at - 1) / 3).cast("int")
    broken = F.concat(F.decode(F.substring(data, F.lit(1), cut), "UTF-8"), F.lit("\n"), F.decode(F.substring(data, cut + 2, F.lit(1 << 30)), "UTF-8"))
    return F.when((F.octet_length(name) > 10) & (at > 0), broken).otherwise(name)


def _attributes(attributes: dict[str, Column]) -> Column:
    return F.concat(F.lit(" ["), F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), _quoted(v)) for k, v in attributes.items())), F.lit("]"))


def dot_lines(concept: DataFrame, edge: DataFrame, node: dict[str, Column] | None = None, link: dict[str, Column] | None = None) -> DataFrame:
    """line: the statements of a Graphviz digraph, one for each concept and each edge. node, link: their attributes, as columns of concept (url, name) and
    of edge (s, p, o); by default a label."""
    node = node or {"label": F.coalesce("name", short_url(F.col("url")))}
    link = link or {"label": short_url(F.col("p"))}
    nodes = concept.select(F.concat(_quoted(F.col("url")), _attributes(node)).alias("line"))
    return nodes.unionByName(edge.select(F.concat(_quoted(F.col("s")), F.lit(" -> "), _quoted(F.col("o")), _attributes(link)).alias("line")))


def graph_lines(kb: Kb, url: str) -> DataFrame:
    """line: the graph of a concept, with all it leads to, without edges that others stand for, and with long labels broken. The concept itself is filled."""
    near = reach(kb.edge, kb.concept.where(F.col("url") == url).select("url"))
    edge = reduce_transitive(kb.edge.join(near.select(F.col("url").alias("s")), "s", "left_semi"))
    concept = near.join(kb.concept, "url", "left").select("url", "name")
    names = kb.concept.select(F.col("url").alias("p"), F.col("name").alias("p_name"))
    edge = edge.join(names, "p", "left").withColumn("label", wrapped(F.coalesce(F.when(F.col("p_name") != "", F.col("p_name")), short_url(F.col("p")))))
    own = F.when(F.col("url") == url, F.lit("filled")).otherwise(F.lit(""))
    return dot_lines(concept, edge, {"label": wrapped(short_name(concept)), "shape": F.lit("box"), "style": own}, {"label": F.col("label")})


def dot(lines: DataFrame, name: str = "g", **settings: str) -> str:
    """The digraph of these lines, as text for Graphviz. A graph to be drawn is small, so its lines are collected."""
    body = [f'{k}="{v}"' for k, v in settings.items()] + sorted(r.line for r in lines.select("line").collect())
    return "\n".join([f'digraph "{name}" {{', *body, "}"])


PARTS = ("concept", "edge", "dictionary", "rules")


def save(kb: Kb, path: str) -> None:
    """Each table as Parquet under the path; what is there is replaced."""
    for part in PARTS:
        getattr(kb, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load(spark: SparkSession, path: str) -> Kb:
    return Kb(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))


def from_config(spark: SparkSession, config: KbConfig, use_cache: bool = True) -> Kb:
    """The knowledge base that a configuration names. With a cache, it is read where it is there and whole, else written and then read; with
    use_cache False neither."""
    cached = use_cache and config.cache
    if cached:
        try:
            return load(spark, config.cache)
        except AnalysisException:  # not there, or not whole
            pass
    made = build(triples(spark, config.path, config.type), config.traits, config.ambigs)
    if not cached:
        return made
    save(made, config.cache)
    return load(spark, config.cache)
