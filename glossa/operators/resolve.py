"""Disambiguation: each document's ambiguous spans in order, against the concepts that it named last.

A resolved span goes into the memory that later ones are judged by, so this is a fold over a document, not a window: documents are groups of
applyInPandas, and one document's spans are the unit that must fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Memory, compile_rule, compile_rules, names
from .kb import SPLIT, Kb
from .search import known_names

Resolver = Callable[[Memory, list[str]], str | None]


def _best(scores: Mapping[str, float]) -> str | None:
    """The candidate with the highest score, if there is only one such."""
    top = max(scores.values(), default=None)
    found = [u for u, s in scores.items() if s == top]
    return found[0] if len(found) == 1 else None


def simple(targets: Mapping[str, tuple[str, ...]]) -> Resolver:
    """By how often the memory, with the targets of its concepts, names the candidate."""
    return lambda m, cands: _best({u: m.count(u, True) for u in cands})


def thematic(targets: Mapping[str, tuple[str, ...]], threshold: float = 0.5) -> Resolver:
    """By the share of the memory's concepts, with the targets of their edges, that the candidate has edges to; up to the threshold it is nothing."""

    def resolve(m: Memory, cands: list[str]) -> str | None:
        seen = set(m.distinct(True))
        share = {u: len(seen & set(targets.get(u, ()))) / len(seen) if seen else 0.0 for u in cands}
        return _best({u: s if s > threshold else 0.0 for u, s in share.items()})

    return resolve


def ruled(rules: Mapping[str, str], known: Callable[[str], str] = lambda name: name) -> Resolver:
    """By the candidate's rule: 1 if it is not below 1, else 0, as without a rule. known: the url of a name in a rule."""
    compiled = {u: compile_rule(r, known) for u, r in rules.items()}
    return lambda m, cands: _best({u: float(u in compiled and not compiled[u](m) < 1) for u in cands})


@dataclass(frozen=True)
class Step:
    """One resolver of a chain: simple, thematic or ruled, the size of its memory, and the threshold of a thematic one."""

    name: str
    size: int = 10
    threshold: float = 0.5

    def __post_init__(self):
        if self.name.lower() not in ("simple", "thematic", "ruled"):
            raise ValueError(f"unknown resolver {self.name!r}")


def steps(names: Sequence[str], size: int = 10, threshold: float = 0.5) -> list[Step]:
    return [Step(n, size, threshold) for n in names]


def _fold(urls: list[list[str]], sure: list[bool], resolver: Resolver, size: int, near: Mapping[str, tuple[str, ...]]) -> list[str | None]:
    """The concept of each span: its own where it is sure, else the one chosen, or none. What is known is remembered."""
    memory, out = Memory(size, []), []
    for cands, known in zip(urls, sure, strict=True):
        url = cands[0] if known else resolver(memory, cands)
        if url is not None:
            memory.push(url, near.get(url, ()))
        out.append(url)
    return out


def chain(found: DataFrame, kb: Kb, order: Sequence[Step]) -> DataFrame:
    """doc, begin, url: the concept of each span that is sure, or that the chain of resolvers chose; null where none did. found: doc, begin, url, sure, one row for each concept that
    a span may be.

    As in a chain of filters built from the last name to the first, the last step of `order` sees the spans first; each has a memory of its own for each
    document, and what it resolves is sure for the others. doc tells documents apart. The targets of concepts are joined to the rows, so the knowledge base may be large;
    its rules go to the tasks with the code.
    """
    rules, known = {}, {}
    if any(s.name.lower() == "ruled" for s in order):
        rules = {r.url: r.expr for r in kb.rules.collect()}
        known = known_names(kb, sorted({n for r in rules.values() for n in names(r)}))
        compile_rules(rules, lambda _: known)  # an error in a rule shows here
    edges = kb.edge.where(F.col("p") != SPLIT).groupBy(F.col("s").alias("url")).agg(F.sort_array(F.collect_list("o")).alias("targets"))
    order = list(reversed(order))
    by_rules: list[Resolver] = []  # compiled once in each task

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        if not by_rules:
            by_rules.append(ruled(rules, known.__getitem__))
        near = {u: () if t is None else tuple(t) for u, t in zip(pdf["url"], pdf["targets"], strict=True)}
        kinds = {"simple": simple(near), "ruled": by_rules[0]}
        pdf = pdf.sort_values(["begin", "url"], kind="stable")
        begins, urls, sure = [], [], []
        for at, url, known_ in zip(pdf["begin"].tolist(), pdf["url"], pdf["sure"].tolist(), strict=True):
            if not begins or begins[-1] != at:
                begins.append(at)
                urls.append([])
                sure.append(known_)
            if url not in urls[-1]:
                urls[-1].append(url)
        for step in order:
            resolver = kinds.get(step.name.lower()) or thematic(near, step.threshold)
            found = _fold(urls, sure, resolver, step.size, near)
            urls = [[f] if f is not None else u for f, u in zip(found, urls, strict=True)]
            sure = [s or f is not None for s, f in zip(sure, found, strict=True)]
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]] * len(begins), "begin": begins, "url": [u[0] if s else None for u, s in zip(urls, sure, strict=True)]})

    rows = found.select("doc", "begin", "url", "sure").join(edges, "url", "left")
    return rows.groupBy("doc").applyInPandas(fold, "doc long, begin long, url string")


def resolve(spans: DataFrame, make: Callable[[], Resolver], size: int = 10, targets: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """spans (path, begin, urls array) with url: the concept of a span with one candidate, or the one chosen; null where none is. Every span that has
    one is remembered, with its targets. `targets` is a table of the knowledge base's edges, sent with the code."""
    near = dict(targets or {})
    made: list[Resolver] = []  # one for each task: resolvers keep nothing

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(make())
        pdf = pdf.sort_values(["begin"], kind="stable")
        urls = [list(u) for u in pdf["urls"]]
        found = _fold(urls, [len(u) == 1 for u in urls], made[0], size, near)
        return pd.DataFrame({"path": pdf["path"].to_numpy(), "begin": pdf["begin"].to_numpy(), "n_cands": [len(u) for u in urls], "url": found})

    return spans.select("path", "begin", "urls").groupBy("path").applyInPandas(fold, "path string, begin long, n_cands long, url string")
