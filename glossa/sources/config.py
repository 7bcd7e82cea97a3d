"""Knowledge-base configuration in TOML, and triples from the file it names."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..shared import read_text
from . import rdfxml, turtle

TRIPLES = "s string, p string, o string, ord long"


@dataclass(frozen=True)
class Traits:
    """What predicates mean. A predicate in `ignore` means nothing else."""

    ignore: frozenset[str] = frozenset()
    transitive: frozenset[str] = frozenset()
    symmetric: frozenset[str] = frozenset()
    inverted: frozenset[str] = frozenset()
    name: frozenset[str] = frozenset()
    distinct: frozenset[str] = frozenset()
    ambiguous: frozenset[str] = frozenset()
    rule: frozenset[str] = frozenset()


@dataclass(frozen=True)
class KbConfig:
    path: str
    type: str
    ambigs: str = "split"
    cache: str = ""
    traits: Traits = field(default_factory=Traits)


def read_config(path: str, spark: SparkSession | None = None) -> KbConfig:
    """Read a configuration: a local file, or with a session any that Spark can read. Environment variables in paths are expanded. `rules` is another name
    for `rule`."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = read_text(spark, path)
    raw = {k.lower(): {a.lower(): b for a, b in v.items()} for k, v in tomllib.loads(text).items()}
    file, said = raw.get("file", {}), dict(raw.get("predicates", {}))
    said.setdefault("rule", said.get("rules", []))
    traits = Traits(**{f.name: frozenset(said.get(f.name, [])) for f in fields(Traits)})
    return KbConfig(os.path.expandvars(file["path"]), file.get("type", "turtle"), file.get("ambigs", "split"), os.path.expandvars(file.get("cache", "")), traits)


def triples(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """s, p, o, ord from the files at a path. A file is read whole, since prefixes hold for all of it; files are read in parallel."""
    parsers = {"turtle": turtle.parse, "rdfxml": rdfxml.parse}
    if kind.lower() not in parsers:
        raise ValueError(f"unknown type {kind!r}")
    parse = parsers[kind.lower()]

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["value"]:
                got = list(parse(content))
                yield pd.DataFrame({"s": [x[0] for x in got], "p": [x[1] for x in got], "o": [x[2] for x in got], "ord": range(len(got))})

    return spark.read.text(path, wholetext=True).mapInPandas(rows, TRIPLES)
