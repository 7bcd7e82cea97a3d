"""One knowledge base, one index and one store of documents, with what can be asked of them: the library's operators for a user.

Answers are plain Python values, small by their nature (concepts, a page of entries); entries() and put() of a DataFrame stay distributed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, kb, search
from .operators.match import match
from .operators.resolve import Step
from .plans import query
from .sources import documents
from .sources.config import read_config
from .shared import written


class NotFound(LookupError):
    pass


@dataclass
class Engine:
    """A knowledge base by its configuration (a TOML file), and a folder for the index and for documents that are given."""

    spark: SparkSession
    config: str
    folder: str
    use_cache: bool = True
    kb: kb.Kb = field(init=False)
    numbers: DataFrame = field(init=False)

    def __post_init__(self):
        self.kb = kb.from_config(self.spark, read_config(self.config, self.spark), self.use_cache)
        search.compiled_rules(self.kb)  # a rule that does not compile shows here
        self.numbers = written(index.register(self.kb.concept.select("url")), "numbers")

    @property
    def index(self) -> str:
        return f"{self.folder.rstrip('/')}/index"

    @property
    def store(self) -> str:
        return f"{self.folder.rstrip('/')}/documents"

    # ---- knowledge base

    def _one(self, url: str, number: int) -> str:
        found = search.find(self.kb, url, number, self.numbers).first()
        if found is None:
            raise NotFound(f"no concept {url or number}")
        return found.url

    def _concepts(self, urls: DataFrame) -> list[dict]:
        rows = kb.concept_json(self.kb).join(urls.select("url").distinct(), "url", "left_semi").join(self.numbers, "url", "left").orderBy("url").collect()
        return [{**json.loads(r.json), "ID": r.id} for r in rows]

    def concept(self, url: str = "", number: int = 0) -> dict:
        return self._concepts(search.find(self.kb, self._one(url, number)))[0]

    def search(self, q: str, most: int = -1) -> list[dict]:
        return self._concepts(search.concepts(self.kb, q, most))

    def predicates(self, q: str, most: int = -1) -> list[dict]:
        return self._concepts(search.predicates(self.kb, q, most))

    def parents(self, url: str = "", number: int = 0, most: int = -1) -> list[dict]:
        try:
            return self._concepts(search.parents(self.kb, self._one(url, number), most))
        except NotFound:
            return []

    def info(self, url: str = "", number: int = 0) -> dict:
        """A concept, its labels, and its targets by predicate."""
        concept = self.concept(url, number)
        labels = sorted(r.label for r in search.dictionary_entries(self.kb, concept["URL"]).collect())
        targets: dict[str, list[str]] = {}
        for e in concept["Edges"]:
            targets.setdefault(e["P"]["URL"], []).append(e["O"]["URL"])
        return {"Concept": concept, "Entries": labels, "Predicates": targets}

    def graph(self, url: str) -> str:
        """What a concept leads to, as text for Graphviz."""
        return kb.dot(kb.graph_lines(self.kb, self._one(url, 0)), url.rsplit("/", 1)[-1], rankdir="BT")

    # ---- documents

    def put(self, docs: DataFrame, errors: Sequence[int] = (), resolvers: Sequence[Step] = ()) -> DataFrame:
        """Append the postings of docs (path, text) to the index. The result is what was found in them: path, token, concept_url, begin, end."""
        spans = match(docs, self.kb.dictionary, tuple(errors))
        found = index.candidates(spans, self.kb)
        found = written(index.resolved(found, self.kb, resolvers) if resolvers else found, "found")
        index.write(index.fan_out(found, self.kb), self.index)
        own = F.coalesce("whole", "url").alias("concept_url")
        return found.select("doc", "path", "token", own, "begin", "end").distinct().drop("doc")

    def put_text(self, name: str, text: str, kind: str = documents.PLAIN, **settings) -> list[dict]:
        """Keep a text in the store, and put it."""
        return _entries(self.put(documents.store(self.spark, self.store, name, text, kind), **settings))

    def put_files(self, path: str, kind: str = documents.PLAIN, **settings) -> list[dict]:
        """Put a file, or all files of a folder; they stay where they are."""
        return _entries(self.put(documents.files(self.spark, path, kind), **settings))

    def dump(self, path: str) -> dict:
        """A document of the store."""
        row = self._stored(path).first()
        if row is None:
            raise NotFound(f"no document {path}")
        return {"Path": row.path, "ContentType": documents.PLAIN, "Content": row.text}

    def _stored(self, path: str) -> DataFrame:
        try:
            return documents.stored(self.spark, self.store, path)
        except AnalysisException:  # nothing was given yet
            return documents.strings(self.spark, {}).where("false")

    def context(self, path: str, begin: int, end: int, n: int) -> dict:
        """n bytes before and behind a place of a document: of the store, or else a file."""
        docs = self._stored(path)
        if not docs.head(1):
            try:
                docs = documents.files(self.spark, path)
            except AnalysisException as e:
                raise NotFound(f"no document {path}") from e
        row = search.in_context(docs, begin, end, n).first()
        return {"URL": path, "Before": row.before, "Match": row.match, "After": row.after, "Begin": begin, "End": end, "Len": n}

    # ---- index

    def entries(self) -> DataFrame:
        try:
            return index.read(self.spark, self.index)
        except AnalysisException:  # nothing was put yet
            return index.entries(documents.strings(self.spark, {}), self.kb)

    def get(self, text: str, most: int = 0, skip: int = 0) -> list[dict]:
        """The entries that a query finds, by names or urls; with `most` or `skip` a page of them."""
        return [r.asDict() for r in query.get(self.entries(), self.kb, text, most, skip).collect()]

    def flush(self) -> None:
        """Batches are written when they are put, so there is nothing to do."""


def _entries(found: DataFrame) -> list[dict]:
    return [r.asDict() for r in found.orderBy("path", "begin", "end", "concept_url").collect()]


def pretty_entry(e: dict) -> str:
    return f"{e['path']}:{e['begin']}-{e['end']} {e['concept_url']}{' ' + e['relation_url'] if e.get('relation_url') else ''} {json.dumps(e['token'], ensure_ascii=False)}"


def pretty_concept(c: dict) -> str:
    return f"{c['ID']} {c['URL']} {json.dumps(c['Name'], ensure_ascii=False)}"


def pretty_info(x: dict) -> str:
    lines = [pretty_concept(x["Concept"]), *(f"label {json.dumps(e, ensure_ascii=False)}" for e in x["Entries"])]
    return "\n".join(lines + [f"{p} {o}" for p, os in x["Predicates"].items() for o in os])
