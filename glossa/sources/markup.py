"""Plain text of HTML and XML documents, by element and by text node."""

from __future__ import annotations

from html.parser import HTMLParser

TEXT_TAGS = frozenset("p b h1 h2 h3 li a span td th".split())


class _ByElement(HTMLParser):
    """Text that stands directly inside one of TEXT_TAGS, a space before each piece. Elements without an end tag stay open until an end tag takes
    the topmost element away, so text after them is theirs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if self.stack:
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1] in TEXT_TAGS:
            self.out.append(" " + data)


class _ByNode(HTMLParser):
    """Every text node outside head, trimmed; empty ones go, one space after each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.head, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.head += tag == "head"

    def handle_endtag(self, tag):
        self.head -= tag == "head" and self.head > 0

    def handle_data(self, data):
        data = data.strip("\n\r\v\t ")
        if data and not self.head:
            self.out.append(data + " ")


def _text(kind, page: str | None) -> str:
    p = kind()
    p.feed(page or "")
    p.close()
    return "".join(p.out)


def element_text(page: str | None) -> str:
    return _text(_ByElement, page)


def node_text(page: str | None) -> str:
    return _text(_ByNode, page)
