"""Dictionary matching on normalised text: exact, fuzzy, and chains of both.

A text is scanned once, in Arrow batches, against a table of the dictionary's words, which goes to the tasks with the code. A dictionary of more than
MOST_LABELS is dealt to parts under that bound, one scan each, and the longest label at each word is settled among the parts. Spans are bytes of the
normalised, space-surrounded text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..shared import written

MOST_LABELS = 2_000_000
#: Runs of words that a task remembers at once: most of them it meets again and again.
MOST_RUNS = 300_000
CANDS = pa.list_(pa.struct({"label": pa.string(), "l": pa.int64()}))
TAKEN = pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64(), "cands": CANDS}))
FOUND = "id long, begin long, end long, cands array<struct<label: string, l: bigint>>"
STATE = "id long, path string, text string, taken array<struct<begin: bigint, end: bigint, cands: array<struct<label: string, l: bigint>>>>"
SPANS = "doc long, path string, begin long, end long, token string, label string, l long, cands array<struct<label: string, l: bigint>>"
CONTEXT = ", before binary, after binary"


#: What a matcher finds at a word: the word behind, and labels with their distances.
Hit = tuple[int, list[tuple[str, int]]]


class Exact:
    """Leftmost-longest, word by word: at each word the longest label that starts there, then on behind it."""

    def __init__(self, labels: list[str]):
        self.labels = frozenset(labels)
        self.longest: dict[str, int] = {}
        for x in labels:
            w = x.split(" ")
            self.longest[w[0]] = max(self.longest.get(w[0], 0), len(w))

    def at(self, words: list[str], i: int) -> Hit | None:
        k = min(self.longest.get(words[i], 0), len(words) - i)
        while k > 1 and " ".join(words[i : i + k]) not in self.labels:
            k -= 1
        label = words[i] if k == 1 else " ".join(words[i : i + k])
        return (i + k, [(label, 0)]) if k and label in self.labels else None

    def starts(self, words: list[str]) -> Iterable[int]:
        """The words at which something may be found."""
        return [i for i, w in enumerate(words) if w in self.longest]


def distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance of bytes, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


class Fuzzy:
    """Labels within k edits of a run of words. Of a label the run with fewest edits, then the longest; then the labels that end furthest. Runs with
    fewer than 3 bytes for each edit do not count. A single label without edits is a plain match."""

    def __init__(self, labels: list[str], k: int):
        self.k, self.most_words = k, max((x.count(" ") + 1 for x in labels), default=0) + k
        self.by_piece: dict[bytes, set[bytes]] = {}
        self.whole = [x.encode() for x in labels]
        # k edits leave one of k + 1 pieces of a label as it is
        for x in self.whole:
            for piece in self._pieces(x):
                self.by_piece.setdefault(piece, set()).add(x)
        self.sizes = sorted({len(p) for p in self.by_piece})
        self.memo: dict[str, list[tuple[bytes, int]]] = {}  # of runs that were met

    def _pieces(self, x: bytes) -> list[bytes]:
        n, parts = len(x), self.k + 1
        return [x[n * i // parts : n * (i + 1) // parts] for i in range(parts)]

    def _near(self, run: bytes) -> set[bytes]:
        return {x for size in self.sizes for i in range(len(run) - size + 1) for x in self.by_piece.get(run[i : i + size], ())}

    def starts(self, words: list[str]) -> Iterable[int]:
        return range(len(words))

    def labels(self, text: str) -> list[tuple[bytes, int]]:
        """The labels within k edits of a run of words, with their distances."""
        found = self.memo.get(text)
        if found is None:
            run = text.encode()
            near = ((x, distance(run, x, self.k)) for x in self._near(run))
            found = [(x, d) for x, d in near if d <= self.k and len(run) >= 3 * d]
            if len(self.memo) >= MOST_RUNS:
                self.memo.clear()
            self.memo[text] = found
        return found

    def at(self, words: list[str], i: int) -> Hit | None:
        best: dict[bytes, tuple[int, int]] = {}
        for j in range(i + 1, min(len(words), i + self.most_words) + 1):
            for x, d in self.labels(" ".join(words[i:j])):
                best[x] = min(best.get(x, (d, -j)), (d, -j))
        if not best:
            return None
        end = max(-j for _, j in best.values())
        return end, sorted((x.decode(), d) for x, (d, j) in best.items() if -j == end)


def _matcher(labels: list[str], k: int) -> Exact | Fuzzy:
    return Fuzzy(labels, k) if k else Exact(labels)


def _words(text: str) -> list[str]:
    return text.split(" ")[1:-1] if len(text) > 2 else []


def _free(taken: list[tuple], n: int) -> Iterator[tuple[int, int]]:
    """Runs of words that no span holds."""
    low = 0
    for a, b, *_ in [*taken, (n, n)]:
        if low < a:
            yield low, a
        low = b


def _walk(starts: Iterable[int], at: Callable[[int], Hit | None]) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
    """Leftmost hits that do not overlap, of those at some words in order."""
    done = 0
    for low in starts:
        if low >= done and (hit := at(low)):
            yield low, *hit
            done = hit[0]


def _chain(words: list[str], matchers: list[Exact | Fuzzy]) -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(first word, word behind, labels): what each matcher in turn finds in the gaps that the others left."""
    taken: list[tuple[int, int, list[tuple[str, int]]]] = []
    for m in matchers:
        new = []
        for a, b in _free(taken, len(words)):
            part = words[a:b]
            new += [(a + i, a + j, c) for i, j, c in _walk(m.starts(part), lambda i: m.at(part, i))]  # noqa: B023
        taken = sorted(taken + new)
    return taken


def _rows(path: str, text: str, words: list[str], taken: list[tuple], gaps: bool, doc: int = 0, context: int | None = None) -> Iterator[dict]:
    """Spans in bytes. One label without edits is a plain match; others are candidates. context: how many bytes before and after to add."""
    if not taken and not gaps:
        return
    sizes = map(len, words) if text.isascii() else (len(w.encode()) for w in words)
    starts = list(accumulate((n + 1 for n in sizes), initial=1))  # of each word, and behind the last
    done, whole = 0, text.encode() if gaps or context is not None else b""
    near = lambda a, b: {} if context is None else {"before": whole[max(0, a - context) : a], "after": whole[b : b + context]}
    gap = lambda a, b: {"doc": doc, "path": path, "begin": a, "end": b, "token": whole[a:b].decode(), "label": None, "l": 0, "cands": None, **near(a, b)}
    for i, j, cands in taken:
        a, b = starts[i], starts[j] - 1
        if gaps and done < a:
            yield gap(done, a)
        plain = len(cands) == 1 and cands[0][1] == 0
        yield {"doc": doc, "path": path, "begin": a, "end": b, "token": " ".join(words[i:j]), "label": cands[0][0] if plain else None, "l": max(d for _, d in cands), "cands": None if plain else [{"label": x, "l": d} for x, d in cands], **near(a, b)}
        done = b
    if gaps and done < len(whole):
        yield gap(done, len(whole))


_SPANS = pa.schema({"doc": pa.int64(), "path": pa.string(), "begin": pa.int64(), "end": pa.int64(), "token": pa.string(), "label": pa.string(), "l": pa.int64(), "cands": CANDS})
_FOUND = pa.schema({"id": pa.int64(), "begin": pa.int64(), "end": pa.int64(), "cands": CANDS})
_STATE = pa.schema({"id": pa.int64(), "path": pa.string(), "text": pa.string(), "taken": TAKEN})


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        # an empty column of lists is spared its conversion
        yield pa.record_batch([pa.nulls(len(part), f.type) if f.name == "cands" and not any(r["cands"] for r in part) else pa.array([r[f.name] for r in part], f.type) for f in schema], schema=schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[str], list[tuple]]]:
    """Rows of STATE with their words and spans."""
    for batch in batches:
        for x in batch.to_pylist():
            yield x, _words(x["text"]), [(t["begin"], t["end"], [(c["label"], c["l"]) for c in t["cands"]]) for t in x["taken"] or []]


def _packed(taken: list[tuple]) -> list[dict]:
    return [{"begin": i, "end": j, "cands": [{"label": x, "l": d} for x, d in c]} for i, j, c in taken]


def _find(labels: list[str], k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(labels, k)

        def rows() -> Iterator[dict]:
            for x, words, taken in _each(batches):
                for a, b in _free(taken, len(words)):
                    part = words[a:b]
                    for i in m.starts(part):
                        if hit := m.at(part, i):
                            yield {"id": x["id"], **_packed([(a + i, a + hit[0], hit[1])])[0]}

        return _batches(rows(), _FOUND)

    return task


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of STATE, of which `more` has what the parts found at each word, with the leftmost of it taken."""

    def rows() -> Iterator[dict]:
        for x, words, taken in _each(batches):
            hits = {t["begin"]: (t["end"], sorted((c["label"], c["l"]) for c in t["cands"])) for t in x["more"] or []}
            new = [s for a, b in _free(taken, len(words)) for s in _walk((i for i in sorted(hits) if a <= i < b), hits.get)]  # noqa: B023
            yield {"id": x["id"], "path": x["path"], "text": x["text"], "taken": _packed(sorted(taken + new))}

    return _batches(rows(), _STATE, 200)


def _in_parts(docs: DataFrame, labels: DataFrame, kinds: list[int], most: int) -> DataFrame:
    """Rows of STATE for docs (path, text), by scans of a part of the labels each. Only one part is on the driver at a time: what a scan finds is
    written before the next. At a word, each part keeps the labels that end furthest, and so do all parts together."""
    parts = -(-labels.count() * 11 // (most * 10))
    dealt = written(labels.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts))), "labels")
    state = written(docs.select(F.col("doc").alias("id"), "path", "text", F.lit(None).cast(STATE.split("taken ")[1]).alias("taken")), "texts")
    for k in kinds:
        found = None
        for part in range(parts):
            own = [r.label for r in dealt.where(F.col("part") == part).select("label").collect()]
            new = written(state.mapInArrow(_find(own, k), FOUND), "found")
            found = new if found is None else found.unionByName(new)
        ends = found.groupBy("id", "begin", "end").agg(F.flatten(F.collect_list("cands")).alias("cands"))
        best = ends.groupBy("id", "begin").agg(F.max_by(F.struct("end", "cands"), "end").alias("x"))
        more = best.groupBy("id").agg(F.collect_list(F.struct("begin", "x.end", "x.cands")).alias("more"))
        state = written(state.join(more, "id", "left").mapInArrow(_settle, STATE), "texts")
    return state


def match(docs: DataFrame, dictionary: DataFrame, errors: tuple[int, ...] = (), gaps: bool = False, most: int = MOST_LABELS, context: int | None = None) -> DataFrame:
    """Spans of docs (path, text): fuzzy matching for each positive error limit, the largest first, and exact matching last. With `gaps`, the text
    between matches too, with neither label nor candidates. With `context`, also the columns before and after: so many bytes on both sides, as they may cut a
    character. Documents are independent, also where they share a path: doc numbers their rows. A null text is empty. Null labels
    match nothing. A dictionary of more than `most` labels gives the same spans, by one scan for each part of it."""
    labels = dictionary.select("label").where("label is not null").distinct()
    kinds = [*sorted({k for k in errors if k > 0}, reverse=True), 0]
    texts = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("path").cast("string").alias("path"), normalise(F.col("text")).alias("text"))
    few = [r.label for r in labels.limit(most + 1).collect()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [_matcher(few, k) for k in kinds]

        def rows() -> Iterator[dict]:
            for batch in batches:
                for doc, path, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "path", "text")), strict=True):
                    words = _words(text)
                    yield from _rows(path, text, words, _chain(words, matchers), gaps, doc, context)

        return _batches(rows(), schema)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((r for x, words, taken in _each(batches) for r in _rows(x["path"], x["text"], words, taken, gaps, x["id"], context)), schema)

    schema, fields = (_SPANS, SPANS) if context is None else (pa.schema([*_SPANS, ("before", pa.binary()), ("after", pa.binary())]), SPANS + CONTEXT)
    if len(few) <= most:
        return texts.mapInArrow(whole, fields)
    few = []
    return _in_parts(texts, labels, kinds, most).mapInArrow(settled, fields)


def match_pattern(docs: DataFrame, pattern: str, url: str) -> DataFrame:
    """path, begin, end, token, url: what a regular expression (of Python) finds in the normalised texts of docs (path, text), from left to right without
    overlaps, for one concept. Empty finds are left out."""
    schema = pa.schema({"path": pa.string(), "begin": pa.int64(), "end": pa.int64(), "token": pa.string(), "url": pa.string()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(pattern)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                    at, done = 0, 0  # bytes before a place, and that place
                    for m in found.finditer(text):
                        at, done = at + len(text[done : m.start()].encode()), m.start()
                        if m[0]:
                            yield {"path": path, "begin": at, "end": at + len(m[0].encode()), "token": m[0], "url": url}

        return _batches(rows(), schema)

    texts = docs.select(F.col("path").cast("string").alias("path"), normalise(F.col("text")).alias("text"))
    return texts.mapInArrow(task, "path string, begin long, end long, token string, url string")
