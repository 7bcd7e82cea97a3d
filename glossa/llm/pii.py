"""Personal data: patterns propose spans, checks confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) are taken or dropped by their patterns and checks alone. The kinds that the method adds (iban, ssn,
secret) need a score of 0.5: a confirmed checksum gives 0.6, a bare pattern 0.3, a context word within 40 characters before or behind it adds 0.3
(for a secret, right before it) and a word before it that speaks against it takes 0.3 away, but nothing from a confirmed checksum. Places are code points,
ends are exclusive. A null text is empty and holds nothing. The work grows with a text's length, whatever it repeats.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

# The base patterns, so written that each place of a text is looked at a bounded number of times: a run of digits or of an address's characters is entered
# where it begins, and what is taken is not given back. They match what the plain patterns match, which tests hold them against.
_AT_RUN = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_AT_RUN}")
_EMAIL_HERE = re.compile(_AT_RUN)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Proposed anywhere, also inside another proposal; ibans() cuts them.
_IBAN = re.compile(r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
#: Characters of an IBAN by country; of other countries any end of a word from 15 to 34 is tried, the longest first.
IBAN_LENGTH = {
    k: n
    for n, ks in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in ks.split()
}
_SSN = re.compile(r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b")
#: Whole runs; is_secret() asks for more.
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+")
_DIGITS = re.compile(r"[0-9]+")
_HAS_SECRET = re.compile(r"token|secret|passw|api[ _-]?key|credential|bearer", re.I)

#: Words that speak for a kind, and words that speak against any.
CONTEXT = {
    "iban": re.compile(r"\b(?:iban|account|konto|bank|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id|taxpayer)\b", re.I),
    "secret": re.compile(r"(?:token|secret|passwd|password|api[ _-]?key|credential|bearer)\W*\Z", re.I),
}
AGAINST = re.compile(r"\b(?:example|sample|order|invoice|isbn|part|serial)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs, leftmost first, without overlaps."""
    done = 0
    for m in _IBAN.finditer(text):
        a = m.start()
        if a < done:
            continue
        ends = [k + 1 for k in range(a, m.end(1)) if text[k] != " "]  # by characters of the number
        fixed = IBAN_LENGTH.get(text[a : a + 2])
        for n in [fixed] if fixed else range(min(34, len(ends)), 14, -1):
            if n > len(ends):
                continue
            b = ends[n - 1]
            if (b == len(text) or not (text[b].isalnum() or text[b] == "_")) and mod97(text[a:b].replace(" ", "")):
                yield a, b
                done = b
                break


def is_secret(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As finditer with the plain pattern: leftmost first. An address may begin right behind another, within a run of its characters."""
    m = _EMAIL.search(text) if "@" in text else None
    while m:
        yield m.span()
        m = _EMAIL_HERE.match(text, m.end()) or _EMAIL.search(text, m.end())


def is_ip(found: str) -> bool:
    """Whether all parts are at most 255, whatever zeros lead them."""
    parts = [x.lstrip("0") for x in found.split(".")]
    return all(len(x) < 3 or len(x) == 3 and x <= "255" for x in parts)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans of each kind, leftmost first, without overlaps within a kind; a match that fails its check is dropped, not tried again."""
    out: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    if _DIGITS.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if is_ip(m[0])]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


def scored_spans(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the added kinds with their scores, from 0.5."""
    proposals: list[tuple[str, int, int, float]] = []
    if _DIGITS.search(text):
        proposals += [("iban", *x, 0.6) for x in ibans(text)]
        proposals += [("ssn", *m.span(), 0.3) for m in _SSN.finditer(text)]
        if _HAS_SECRET.search(text):
            proposals += [("secret", *m.span(), 0.3) for m in _SECRET.finditer(text) if is_secret(m[0])]
    for kind, a, b, score in proposals:
        before, behind = text[max(0, a - 40) : a], text[b : b + 40]
        # the word of a secret leads to it
        speaks = CONTEXT[kind].search(before) or kind != "secret" and CONTEXT[kind].search(behind)
        score += 0.3 * bool(speaks)
        if kind != "iban":
            score -= 0.3 * bool(AGAINST.search(before))
        if score >= 0.5:
            yield kind, a, b, score


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind as in KINDS. Base spans have score 1. Added spans that overlap a base one go."""
    text = text or ""
    base = [(kind, a, b, 1.0) for kind, spans in base_spans(text).items() for a, b in spans]
    # where the base spans that begin before a place end at the latest
    starts = sorted((a, b) for _, a, b, _ in base)
    ends = list(accumulate((b for _, b in starts), max))
    more = []
    for x in scored_spans(text):
        k = bisect_left(starts, (x[2],))
        if not k or ends[k - 1] <= x[1]:
            more.append(x)
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each run of overlapping spans replaced by <KIND> of its first."""
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, a, b, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[done:a], f"<{kind.upper()}>"]
        done, k = b, k + 1
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with the column pii added (or replaced): an array of (kind, start, end, score). Rows are independent."""
    element = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    rows = docs.drop("pii") if text != "pii" else docs.withColumnRenamed("pii", "pii_text")
    text = text if text != "pii" else "pii_text"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t)] for t in batch.column(text).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, element)], names=[*batch.schema.names, "pii"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(task, f"{fields}, pii array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with personal data in their text replaced by its kind; a null text stays null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            new = [t if t is None else redact(t, find(t)) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return docs.mapInArrow(task, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column("pii").to_pylist():
                names = [f"{x['kind']}:{x['start']}:{x['end']}" for x in spans]
                base = [n for n, x in zip(names, spans, strict=True) if x["kind"] in BASE]
                rows.append((*(sum(x["kind"] == k for x in spans) for k in BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(names)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(cols))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return detect(docs).drop("text").mapInArrow(task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
