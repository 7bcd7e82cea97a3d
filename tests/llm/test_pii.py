"""Personal data against the plain patterns, on random and on very long texts, and through Spark."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossa.llm import pii

#: The base patterns as they are stated, in plain form.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _digits(x):
    return [int(c) for c in x if c.isdigit()]


def _luhn(d):
    return sum(sum(divmod(2 * c, 10)) if k % 2 else c for k, c in enumerate(reversed(d))) % 10 == 0


CHECKS = {
    "email": lambda x: True,
    "ip": lambda x: all(int(p[-4000:]) <= 255 if p.strip("0") else True for p in x.split(".")),
    "card": lambda x: 14 <= len(_digits(x)) <= 19 and _luhn(_digits(x)),
    "phone": lambda x: 10 <= len(_digits(x)) <= 15,
}


def plain(text):
    return {k: [m.span() for m in p.finditer(text or "") if CHECKS[k](m[0])] for k, p in PLAIN.items()}


def digest(text):
    spans = sorted((a, k, b) for k, name in enumerate(PLAIN) for a, b in plain(text)[name])
    names = list(PLAIN)
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def _random_texts(seed, n):
    r = random.Random(seed)
    alphabets = ["1. 0", "a@b.", "+1 ()2.-9", "14 -", "a.@-é_%+1", "0123456789. -+()@ab\n"]
    for _ in range(n):
        yield "".join(r.choices(r.choice(alphabets), k=r.randrange(1, 60)))


def test_base_spans_are_those_of_the_plain_patterns():
    for t in [*_random_texts(1, 20_000), "a@b", "@@a@b.c@d.e", "a@b.c@d.e.", "@", "é@b.co a@é.b", "a@b.c._x@e.f", "1.2.3.4.5.6.7.8", "٣.1.2.3.4", "a" * 500 + "@b.c"]:
        assert pii.base_spans(t) == plain(t), t


@pytest.mark.parametrize("part,ok", [("0" * 5000 + "1", True), ("0" * 5000, True), ("0" * 5000 + "256", False), ("9" * 5000, False), ("255", True), ("0255", True), ("256", False), ("1000", False)])
def test_ip_parts_of_any_length(part, ok):
    assert [k for k, *_ in pii.find(f"1.1.1.{part}") if k == "ip"] == ["ip"] * ok


@pytest.mark.parametrize("text", ["7" * 10**6, "a" * 10**6 + "@", "a" * 10**6, "a-" * 500_000 + " token", "1." * 500_000, "a@" * 300_000, "a.b@" + "c" * 10**6, "a@b.c" * 200_000, "+1" * 300_000, "+1" + " " * 10**6, "1 " * 500_000, "DE89 " * 200_000, "a_-1" * 250_000 + " secret", "a@b.co 123-45-6789 " * 40_000])
def test_time_grows_with_the_text(text):
    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 15  # hours, were it quadratic


def test_added_spans_beside_base_spans():
    t = "ssn 123-45-6789, a@b.co, token: abcdefghijklmnopqrstuvwx12345@host.org and password=abcdefghijklmnopqrstuvwx12345"
    found = [(k, t[a:b]) for k, a, b, _ in pii.find(t)]
    assert found == [("ssn", "123-45-6789"), ("email", "a@b.co"), ("email", "abcdefghijklmnopqrstuvwx12345@host.org"), ("secret", "abcdefghijklmnopqrstuvwx12345")]


def test_whole_query(spark, tmp_path):
    """op9 over nulls, empty, long and repeated texts and repeated ids, against the plain patterns."""
    texts = [None, "", " ", "x a@b.co 1.2.3.4", "x a@b.co 1.2.3.4", "1.1.1." + "0" * 5000 + "1", "call +1 (555) 123-4567 or 4111 1111 1111 1111", "é " * 50_000 + "a@b.co", *_random_texts(2, 300)]
    rows = spark.createDataFrame([(k if k != 4 else 3, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "a@b.co", None, None)], "doc_id long, text string, pii string, n_email long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r)[:6] for r in pii.op9(spark, str(tmp_path)).collect()), key=repr)
    want = [(k if k != 4 else 3, *(len(plain(t)[x]) for x in PLAIN), digest(t)) for k, t in enumerate(texts)] + [(None, 1, 0, 0, 0, digest("a@b.co"))]
    assert got == sorted(want, key=repr)
    for made in (pii.detect(rows), pii.redacted(rows)):
        assert made.count() == len(texts) + 1
    assert pii.detect(rows).columns == ["doc_id", "text", "n_email", "pii"] and pii.redacted(rows).columns == rows.columns
    none = rows.limit(0)
    assert pii.detect(none).count() == pii.redacted(none).count() == 0
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pii.op9(spark, str(tmp_path / "none")).count() == 0
    assert {r.text for r in pii.redacted(rows.where(F.col("doc_id") == 3)).collect()} == {"x <EMAIL> <IP>"}
