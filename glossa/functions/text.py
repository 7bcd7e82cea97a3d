"""Text functions: normalisation, byte slices, label expansion, urls, packed relation ids."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, punctuation, symbols and separators; white space is spelled out since engines differ on vertical tabs.
JUNK = r"[\t\n\f\r \p{P}\p{S}\p{Z}]+"


def normalise(text: Column, surround: bool = True) -> Column:
    """Runs of JUNK become one space; outer spaces go, or are one each where `surround` is set."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), JUNK, " "))
    return F.concat(F.lit(" "), inner, F.lit(" ")) if surround else inner


def byte_slice(text: Column, begin: Column, end: Column) -> Column:
    """Bytes begin to end (exclusive) of the UTF-8 form, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (begin + 1).cast("int"), (end - begin).cast("int")), "UTF-8")


def short_url(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def combine_urls(urls: list[str]) -> str:
    """The first url whole, then the escaped last segment of each other, joined by dashes."""
    first, *rest = urls
    return "-".join([first, *(quote(u.rsplit("/", 1)[-1], safe="$&+=:@~!'()*,;") for u in rest)])


def expand_braces(label: str) -> list[str]:
    """All strings that a label with alternatives in braces stands for. Braces nest; a backslash takes the next character as it is."""

    def alternatives(at: int, inside: bool) -> tuple[list[str], int]:
        whole: list[str] = []
        now = [""]
        while at < len(label):
            c = label[at]
            if c == "\\" and at + 1 < len(label):
                now = [x + label[at + 1] for x in now]
                at += 1
            elif c == "{":
                inner, at = alternatives(at + 1, True)
                now = [x + y for x in now for y in inner]
            elif c == "}":
                if not inside:
                    raise ValueError(f"a brace closes nothing in {label!r}")
                return whole + now, at
            elif c == "," and inside:
                whole, now = whole + now, [""]
            else:
                now = [x + c for x in now]
            at += 1
        if inside:
            raise ValueError(f"a brace stays open in {label!r}")
        return now, at

    return alternatives(0, False)[0]


def pack_relation(rid: Column, l: Column, ambiguous: Column, flag: Column) -> Column:  # noqa: E741
    """24 bits of id, six of distance, two flags, in one integer."""
    bits = F.shiftleft(ambiguous.cast("int"), 1).bitwiseOR(flag.cast("int"))
    return F.shiftleft(rid.bitwiseAND(0xFFFFFF), 8).bitwiseOR(F.shiftleft(l.bitwiseAND(0x3F), 2)).bitwiseOR(bits)


def unpack_relation(packed: Column) -> list[Column]:
    return [
        F.shiftrightunsigned(packed, 8).bitwiseAND(0xFFFFFF).alias("rid"),
        F.shiftrightunsigned(packed, 2).bitwiseAND(0x3F).alias("l"),
        (packed.bitwiseAND(2) != 0).alias("ambiguous"),
        (packed.bitwiseAND(1) != 0).alias("flag"),
    ]
