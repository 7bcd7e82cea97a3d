"""Triples from Turtle text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(r'\s+|#[^\n]*\n|@(?P<note>[A-Za-z]+)|<(?P<iri>[^>]*)>|"(?P<text>[^"]*)"|(?P<mark>[;,.](?=\s|$|[;,.])|[;,])|(?P<word>[^\s;,<>"#@]+?(?=\.?(?:[\s;,<>"]|$)))|(?P<dot>\.)')


class TurtleError(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise TurtleError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind:
            yield ("mark" if kind == "dot" else kind), m[kind]


def parse(text: str) -> Iterator[tuple[str, str, str]]:
    """(s, p, o) of each statement. `;` repeats the subject, `,` subject and predicate. Prefixes and the base hold from where they stand."""
    tokens = list(_tokens(text))
    at, base, prefixes = 0, "", {}

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise TurtleError("the text ends within a statement")
        at += 1
        return tokens[at - 1]

    def term() -> str:
        kind, value = take()
        if kind == "text":
            return html.unescape(value)
        if kind not in ("iri", "word"):
            raise TurtleError(f"no term: {value!r}")
        if kind == "word" and value == "a":
            return RDF_TYPE
        if value.find("//") > 0:
            return value
        if ":" not in value:
            return base + value
        prefix, rest = value.split(":", 1)
        if prefix not in prefixes:
            raise TurtleError(f"unknown prefix {prefix!r}")
        return prefixes[prefix] + rest

    def dot() -> None:
        if take() != ("mark", "."):
            raise TurtleError("a dot is missing")

    while at < len(tokens):
        kind, value = tokens[at]
        word = value.lower()
        if kind == "note" or kind == "word" and value in ("BASE", "PREFIX"):
            at += 1
            if word == "base":
                base = take()[1]
            elif word == "prefix":
                name = take()[1].rstrip(":")
                prefixes[name] = take()[1]
            else:
                raise TurtleError(f"unknown annotation {value!r}")
            if kind == "note":
                dot()
            continue
        s, p = term(), term()
        while True:
            yield s, p, term()
            kind, mark = take()
            if (kind, mark) == ("mark", ","):
                continue
            if (kind, mark) == ("mark", ";"):
                p = term()
                continue
            if (kind, mark) == ("mark", "."):
                break
            raise TurtleError(f"no end of statement: {mark!r}")
