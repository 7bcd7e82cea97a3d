"""The query language over postings: ?[*][k](constraint(concepts)), to a DataFrame filter.

    query := '?' { '*' | number } '(' body ')'
    body  := '!' list '(' list ')' | '*' '(' list ')' | list [ '(' list ')' ]
    list  := [ word { ',' word } ]
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kb import Kb
from ..operators.search import urls_of


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    concepts: tuple[str, ...]
    relations: tuple[str, ...] = ()
    negated: bool = False
    every: bool = False
    distance: int = 0
    ambiguous: bool = False

    def __str__(self) -> str:
        names = ",".join(sorted(self.concepts))
        head = "*" if self.every else ("!" if self.negated else "") + ",".join(sorted(self.relations))
        return f"?{'*' * self.ambiguous}{self.distance or ''}({f'{head}({names})' if head else names})"

    def condition(self) -> Column:
        """A filter that Parquet scans can take: concepts, distance and ambiguity are compared with literals."""
        rel = F.col("relation_url")
        inside = F.lit(True) if self.every else rel.isin(*self.relations) if self.relations else F.lit(False)
        return F.col("concept_url").isin(*self.concepts) & (F.col("ambiguous") == self.ambiguous) & (F.col("l") <= self.distance) & ((rel == "") | (~inside if self.negated else inside))

    def run(self, entries: DataFrame) -> DataFrame:
        return entries.where(self.condition())


@dataclass
class _Reader:
    text: str
    at: int = 0
    tokens: list[str] = field(default_factory=list)

    def __post_init__(self):
        pattern = re.compile(r'\s+|"([^"]*)"|([?*!(),])|([^\s?*!(),"{}]+)')
        at = 0
        while at < len(self.text):
            m = pattern.match(self.text, at)
            if not m:
                raise QueryError(f"cannot read {self.text[at:]!r}")
            at = m.end()
            if m[1] is not None:
                self.tokens.append('"' + m[1])
            elif m[2] or m[3]:
                self.tokens.append(m[2] or m[3])

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, what: str = "") -> str:
        t = self.peek()
        if not t or what and t != what:
            raise QueryError(f"{what or 'more'} expected, not {t!r}")
        self.at += 1
        return t

    def words(self) -> tuple[str, ...]:
        out: list[str] = []
        while self.peek() not in ("", "(", ")"):
            if out:
                self.take(",")
            t = self.take()
            if t in "?*!,":
                raise QueryError(f"a name expected, not {t!r}")
            out.append(t.removeprefix('"'))
        return tuple(dict.fromkeys(out))


def parse(text: str) -> Query:
    r = _Reader(text)
    r.take("?")
    distance, ambiguous = 0, False
    while r.peek() != "(":
        t = r.take()
        if t == "*":
            ambiguous = True
        elif re.fullmatch(r"[0-9]{1,9}", t):
            distance = int(t)
        else:
            raise QueryError(f"unknown option {t!r}")
    r.take("(")
    negated = every = False
    if r.peek() == "!":
        r.take()
        negated = True
    elif r.peek() == "*":
        r.take()
        every = True
    first = () if every else r.words()
    if negated or every or r.peek() == "(":
        r.take("(")
        concepts, relations = r.words(), first
        r.take(")")
    else:
        concepts, relations = first, ()
    r.take(")")
    if r.peek():
        raise QueryError(f"text behind the query: {r.peek()!r}")
    if not concepts:
        raise QueryError("no concepts")
    return Query(concepts, relations, negated, every, distance, ambiguous)


def resolved(query: Query, lookup: Callable[[str], list[str]]) -> Query:
    """Names as urls; an unknown name is an error."""

    def urls(names: tuple[str, ...]) -> tuple[str, ...]:
        out = []
        for n in names:
            found = lookup(n)
            if not found:
                raise QueryError(f"unknown name {n!r}")
            out += found
        return tuple(dict.fromkeys(out))

    return Query(urls(query.concepts), urls(query.relations), query.negated, query.every, query.distance, query.ambiguous)


def compiled(text: str, kb: Kb, strict: bool = False) -> Query:
    """A query whose names are urls of the knowledge base: the concept of that url or label, else the first whose url, name or label has the name in it; of a split
    concept those it is split into. strict: names are urls already."""
    query = parse(text)
    if strict:
        return query
    found = urls_of(kb, [*query.concepts, *query.relations])
    return resolved(query, lambda name: found.get(name, []))


def get(entries: DataFrame, kb: Kb, text: str, most: int = 0, skip: int = 0, strict: bool = False) -> DataFrame:
    """The entries that a query finds; with `most` or `skip` a page of them."""
    found = compiled(text, kb, strict).run(entries)
    return page(found, skip, most) if most or skip else found


def written(concepts: str, relations: str = "", ambiguous: bool = False) -> str:
    """A query of what people type: names between commas, quoted unless they are a star; a relation after an exclamation mark is one to leave out."""

    def quoted(names: str) -> str:
        parts = [x for x in re.split(r"\s*,\s*", names) if x]
        return names if names == "*" else ",".join(f'!"{x[1:]}"' if x[0] == "!" else f'"{x}"' for x in parts)

    head = "?*" if ambiguous else "?"
    return f"{head}({quoted(relations)}({quoted(concepts)}))" if relations else f"{head}({quoted(concepts)})"


def page(entries: DataFrame, skip: int = 0, most: int = 0) -> DataFrame:
    """Entries in a fixed order, from one on, at most so many (0: all)."""
    out = entries.orderBy("path", "begin", "end", "concept_url", "relation_url", "l").offset(skip)
    return out.limit(most) if most else out
