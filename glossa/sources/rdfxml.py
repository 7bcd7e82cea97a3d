"""Triples from SKOS in RDF/XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse(text: str) -> Iterator[tuple[str, str, str]]:
    """Of each Concept: its preferred label, its alternative labels, then every other element with a resource. Terms that are empty are skipped."""
    joined = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    local = lambda tag: tag.rsplit("}", 1)[-1]
    for concept in ET.fromstring(text):
        if local(concept.tag) != "Concept":
            continue
        s = concept.get(f"{{{RDF}}}about", "")
        for kind in ("prefLabel", "altLabel"):
            for e in concept:
                if local(e.tag) == kind and (e.text or "").strip() and s:
                    yield s, joined(e.tag), e.text.strip()
        for e in concept:
            o = e.get(f"{{{RDF}}}resource", "")
            if local(e.tag) not in ("prefLabel", "altLabel") and s and o:
                yield s, joined(e.tag), o
