"""Looking into a knowledge base, and keyword in context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_slice, normalise
from ..plans.rules import Memory, compile_rules
from .kb import SPLIT, Kb


def _most(found: DataFrame, n: int) -> DataFrame:
    """At most n by url, all if negative."""
    return found if n < 0 else found.orderBy("url").limit(n)


def predicates(kb: Kb, q: str, n: int = -1) -> DataFrame:
    """url: concepts with an edge whose predicate contains q."""
    return _most(kb.edge.where(F.col("p").contains(q)).select(F.col("s").alias("url")).distinct(), n)


def parents(kb: Kb, url: str, n: int = -1) -> DataFrame:
    """url: concepts with an edge to this one."""
    return _most(kb.edge.where(F.col("o") == url).select(F.col("s").alias("url")).distinct(), n)


def find(kb: Kb, url: str = "", number: int = 0, numbers: DataFrame | None = None) -> DataFrame:
    """url, name: the concept of a number in a register (url, id), as far as one is given and known; else the concept of that url. A negative number means
    its concept, taken as ambiguous."""
    if number and numbers is not None:
        named = numbers.where(F.col("id") == abs(number)).select("url").first()
        url = named.url if named else url
    return kb.concept.where(F.col("url") == url).select("url", "name")


def dictionary_entries(kb: Kb, url: str) -> DataFrame:
    return kb.dictionary.where(F.col("url") == url).select("label")


def info(kb: Kb, url: str) -> DataFrame:
    """p, o: a concept's edges, and its labels under the empty predicate."""
    own = kb.edge.where(F.col("s") == url).select("p", "o")
    return own.unionByName(dictionary_entries(kb, url).select(F.lit("").alias("p"), F.col("label").alias("o")))


def concepts(kb: Kb, q: str, n: int = -1) -> DataFrame:
    """url, how: the concept of that url; else that of that label; else all whose url, name or label contains q. At most n by url, all if negative."""
    return _most(lookup(kb, [q]).select("url", F.col("how").cast("long").alias("how")), n)


def lookup(kb: Kb, queries: list[str]) -> DataFrame:
    """q, url, how: concepts() of each of some queries, in one pass over the knowledge base. how: 1 by url, 2 by label, 3 by a part of url, name or label.
    Queries are few, as they are typed or named in rules, and are compared in the scan, without a join."""
    asked = F.array(*(F.struct(F.lit(q).alias("q"), normalise(F.lit(q), False).alias("label")) for q in sorted(set(queries))))

    def found(rows: DataFrame, how: Callable[[Column], Column]) -> DataFrame:
        hits = F.filter(F.transform(asked, lambda a: F.struct(a["q"].alias("q"), how(a).alias("how"))), lambda x: x["how"].isNotNull())
        return rows.select("url", F.explode(hits).alias("x")).select("x.q", "url", "x.how")

    by_url = found(kb.concept, lambda a: F.when(F.col("url") == a["q"], 1).when(F.col("url").contains(a["q"]) | F.col("name").contains(a["label"]), 3))
    by_label = found(kb.dictionary, lambda a: F.when(F.col("label") == a["label"], 2).when(F.col("label").contains(a["label"]), 3))
    # one row for each concept: its best way of being found; then the best of all
    every = by_url.unionByName(by_label).groupBy("q", "url").agg(F.min("how").alias("how"))
    best = every.groupBy("q").agg(F.min("how").alias("how"))  # one row for each query
    return every.join(F.broadcast(best), ["q", "how"]).select("q", "url", "how")


def urls_of(kb: Kb, queries: list[str]) -> dict[str, list[str]]:
    """For each query the urls it stands for: the first concept that it finds, by url; of a split concept, those it is split into. Queries that find
    nothing are left out."""
    first = lookup(kb, queries).groupBy("q").agg(F.min("url").alias("url"))
    parts = kb.edge.where(F.col("p") == SPLIT).select(F.col("s").alias("url"), F.col("o").alias("part"))
    rows = first.join(parts, "url", "left").groupBy("q").agg(F.array_sort(F.collect_set(F.coalesce("part", "url"))).alias("urls")).collect()
    return {r.q: list(r.urls) for r in rows}


def compiled_rules(kb: Kb) -> dict[str, Callable[[Memory], float]]:
    """url -> rule of the knowledge base, compiled. A name in a rule must mean one concept; otherwise, and where a rule does not compile, this is an error."""
    return compile_rules({r.url: r.expr for r in kb.rules.collect()}, lambda names: known_names(kb, names))


def known_names(kb: Kb, names: list[str]) -> dict[str, str]:
    """name -> url, for those names that find exactly one concept."""
    rows = lookup(kb, names).groupBy("q").agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n = 1").collect() if names else []
    return {r.q: r.url for r in rows}


def in_context(docs: DataFrame, begin: int, end: int, n: int) -> DataFrame:
    """path, before, match, after: the bytes from begin to end of the normalised texts of docs (path, text), and n on both sides. A place outside of a text is
    an error."""
    text = normalise(F.col("text"))
    size = F.octet_length("text")
    x = docs.select(F.col("path").cast("string").alias("path"), text.alias("text"))
    x = x.withColumn("text", F.when(F.lit(begin < 0 or end < begin) | (F.lit(end) >= size), F.raise_error(F.lit(f"no place {begin} to {end}"))).otherwise(F.col("text")))
    cut = lambda a, b: byte_slice(F.col("text"), F.lit(a), b)
    return x.select("path", cut(max(0, begin - n), F.lit(begin)).alias("before"), cut(begin, F.lit(end)).alias("match"), cut(end, F.least(size, F.lit(end + n))).alias("after"))
