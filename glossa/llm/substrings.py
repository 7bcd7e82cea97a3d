"""Removal of repeated substrings: every byte covered by a string of `length` bytes that also starts anywhere else.

Each window of `length` bytes has an anchor, its leftmost least hashed 64-byte string. Equal windows have equal anchors at equal places, so only
windows whose anchor string occurs twice can repeat. Those windows, in runs that share an anchor, are dealt by the anchor's hash; equal windows
meet in one partition, and each window of the corpus comes to exactly one. A partition writes its runs to disk in shards, and each shard's suffixes are sorted
by induced sorting with common prefixes (suffixes.py): a window repeats if its suffix shares `length` bytes with a neighbour. Hashes only
choose what is compared and where; what is removed is decided by bytes. A partition may be far larger than memory: its files are cut to further files, read
batch by batch, by anchor; an anchor with more runs than fit by the windows' distance from it; one distance by hashes of the windows' bytes; and the places
of one window are passed on without being held. A shard is sorted in memory: the queues of suffixes.py go to disk only for shards larger than those here.

Exact copies of a text are read once: all of it repeats if it has `length` bytes.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, done
from .hashing import BASE, INVERSE, U, mix, powers, prefix
from .suffixes import SHIFT, SEPARATOR, repeated

LENGTH, ANCHOR = 200, 64
#: Bytes of text in one round of numpy work; symbols sorted at once; bytes of runs meant for a partition.
CHUNK, SHARD, PARTITION = 2 << 20, 6 << 20, 24 << 20
_STEP = 1 << 16
_BITS = U(18)


def runs(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, place of the first window, number of windows, hash of the anchor string, its place."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, U), none
    place, hashed = np.empty(n, np.int64), np.empty(n, U)
    width = length - anchor + 1
    mask = (U(1) << _BITS) - U(1)
    for c in range(0, n, _STEP):
        part = data[c : c + _STEP + length - 1]
        p = prefix(part)
        m = len(part) - anchor + 1
        h = mix((p[anchor:] - p[:-anchor]) * powers(INVERSE, len(part))[:m])
        # least of `width` neighbours, by doubling; equal hashes are told apart by place, the leftmost least
        key = (h & ~mask) | np.arange(m, dtype=U)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if width > span:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        at = (key & mask).astype(np.int64)
        place[c : c + len(at)], hashed[c : c + len(at)] = at + c, h[at]
    starts = np.cumsum(sizes) - sizes
    edge = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + sizes[long] - length + 1, -1)
    place[np.cumsum(edge[:-1]) == 0] = -1
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(np.append(first, n))
    good = place[first] >= 0
    first, many = first[good], many[good]
    # two texts never share a run: between their windows lie some that belong to neither
    text = np.searchsorted(starts, first, side="right") - 1
    return text, first - starts[text], many, hashed[first], place[first] - starts[text]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


class _Once:
    """Tells texts met for the first time; beyond its limit it forgets, which costs time and no more."""

    def __init__(self, most: int = 1_000_000):
        self.seen: set[bytes] = set()
        self.most = most

    def __call__(self, key: bytes) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) < self.most:
            self.seen.add(key)
        return True


def _anchors(length: int, anchor: int):
    """(h, text, n): how often each anchor string is one in each text. text: eight bytes of the text's digest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t is not None and len(t) >= length]
            keys = [hashlib.sha256(t).digest() for t in texts]
            new = [i for i, k in enumerate(keys) if once(k)]
            texts, keys = [texts[i] for i in new], [keys[i] for i in new]
            short = np.frombuffer(b"".join(k[:8] for k in keys), "<i8")
            for a, b in _chunks(texts):
                text, _, _, h, _ = runs(texts[a:b], length, anchor)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                at = np.flatnonzero(new)
                yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(short[a:b][text[at]]), pa.array(np.diff(np.append(at, len(h))).astype(np.int32))], names=["h", "text", "n"])

    return task


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """short, key, text of each text that its task meets for the first time."""
    once = _Once()
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t is not None]
        keys = [hashlib.sha256(t).digest() for t in texts]
        new = [i for i, k in enumerate(keys) if once(k)]
        yield pa.record_batch([pa.array([int.from_bytes(keys[i][:8], "little", signed=True) for i in new], pa.int64()), pa.array([keys[i] for i in new], pa.binary()), pa.array([texts[i] for i in new], pa.binary())], names=["short", "key", "content"])


_PLACES = pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int64()), ("step", pa.int64()), ("times", pa.int64())]))


def _extend(found: list[dict], key: bytes, at: int) -> None:
    """Add a place behind the others of its text: as one more step of the last entry where it is one."""
    last = found[-1] if found else None
    if last and last["key"] == key and last["times"] == 1:
        last["step"], last["times"] = at - last["at"], 2
    elif last and last["key"] == key and at == last["at"] + last["step"] * last["times"]:
        last["times"] += 1
    else:
        found.append({"key": key, "at": at, "step": 1, "times": 1})


def _covered(place: tuple[bytes, int, int, int], low: int, high: int) -> Iterator[tuple[bytes, int, int]]:
    """The bytes from low to high of what was found at these places, as spans; places that leave no gap give one."""
    key, at, step, times = place
    if step <= high - low:
        yield key, at + low, at + step * (times - 1) + high
    else:
        for k in range(times):
            yield key, at + step * k + low, at + step * k + high


def _cut_runs(length: int, anchor: int):
    """(h, away, data, found): the bytes of each run of windows with a repeated anchor, the first window's distance from it, and where it was found; runs of equal bytes in one batch are
    one row. Places at equal steps are one entry, so that a text that repeats a few bytes has few of them, however long it is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, wanted = batch.column("content").to_pylist(), batch.column("key").to_pylist(), batch.column("hs")
            offsets, flat = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            for a, b in _chunks(texts):
                text, at, many, h, place = runs(texts[a:b], length, anchor)
                h = h.view(np.int64)
                good = np.zeros(len(h), bool)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                for t in range(b - a):
                    own = slice(bounds[t], bounds[t + 1])
                    good[own] = np.isin(h[own], flat[offsets[a + t] : offsets[a + t + 1]])
                rows: dict[bytes, tuple[int, int, list]] = {}
                for i in np.flatnonzero(good).tolist():
                    t, s = int(text[i]) + a, int(at[i])
                    data = texts[t][s : s + int(many[i]) - 1 + length]
                    _extend(rows.setdefault(data, (int(h[i]), int(place[i]) - s, []))[2], keys[t][:16], s)
                found = pa.array([x[2] for x in rows.values()], _PLACES)
                yield pa.record_batch([pa.array([x[0] for x in rows.values()], pa.int64()), pa.array([x[1] for x in rows.values()], pa.int32()), pa.array(list(rows), pa.binary()), found], names=["h", "away", "data", "found"])

    return task


#: Bytes that a place takes in memory, about.
_PLACE = 128


class _Rows:
    """Rows (h, away, data, found) in a file, batch by batch. weight: bytes they take in memory, about."""

    def __init__(self, folder: str):
        self.file = tempfile.TemporaryFile(dir=folder)  # noqa: SIM115
        self.weight = self.count = 0
        self.one_anchor = self.one_data = True
        self.first: tuple | None = None
        self.low = self.high = 0  # the windows' distances from their anchors

    def add(self, rows: list[tuple], length: int) -> None:
        if not rows:
            return
        if self.first is None:
            self.first = (rows[0][0], rows[0][2])
            self.low = self.high = rows[0][1]
        for h, away, data, found in rows:
            self.weight += len(data) + _PLACE * len(found)
            self.one_anchor &= h == self.first[0]
            self.one_data &= data == self.first[1]
            self.low, self.high = min(self.low, away - len(data) + length), max(self.high, away)
        self.count += len(rows)
        pickle.dump(rows, self.file, 5)

    def __iter__(self) -> Iterator[list[tuple]]:
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                return


_FOUND = "array<struct<key: binary, at: bigint, step: bigint, times: bigint>>"
Place = tuple[bytes, int, int, int]


def _marks_of_shard(data: list[bytes], found: list[list[Place]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(key, low, high): bytes to remove, from runs of equal anchors."""
    index: dict[bytes, int] = {}
    places: list[list[Place]] = []
    for x, f in zip(data, found, strict=True):
        k = index.setdefault(x, len(places))
        if k == len(places):
            places.append([])
        places[k] += f
    kept = list(index)
    several = np.array([sum(x[3] for x in set(f)) > 1 for f in places], bool)
    sizes = np.array([len(x) for x in kept], np.int64)
    if len(kept) > 1 or len(kept[0]) > length:
        joined = np.full(int(sizes.sum()) + len(kept), SEPARATOR, np.uint16)
        starts = np.cumsum(sizes + 1) - sizes - 1
        whole = np.frombuffer(b"\0".join(kept) + b"\0", np.uint8).astype(np.uint16) + SHIFT
        joined[:] = whole
        joined[starts + sizes] = SEPARATOR
        joined[-1] = 0
        hit = repeated(joined, length)
    else:
        starts, hit = np.zeros(1, np.int64), np.zeros(len(kept[0]) + 1, bool)
    for k, f in enumerate(places):
        windows = int(sizes[k]) - length + 1
        own = np.ones(windows, bool) if several[k] else hit[starts[k] : starts[k] + windows]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for x in set(f):
                yield from _covered(x, a, b - 1 + length)


def _marks(length: int, shard: int = SHARD):
    def marks(rows: _Rows) -> Iterator[tuple[bytes, int, int]]:
        held = [x for batch in rows for x in batch]
        rows.file.close()
        yield from _marks_of_shard([x[2] for x in held], [x[3] for x in held], length)

    def split(rows: _Rows, folder: str, part) -> list[_Rows]:
        """The rows in further files by part(row), from 0 to 15; their own file goes."""
        files: dict[int, _Rows] = {}
        for batch in rows:
            own: dict[int, list] = {}
            for x in batch:
                own.setdefault(part(x), []).append(x)
            for k, some in own.items():
                if k not in files:
                    files[k] = _Rows(folder)
                files[k].add(some, length)
        rows.file.close()
        return list(files.values())

    def between(rows: _Rows, folder: str, low: int, high: int) -> _Rows:
        """The windows whose distance from their anchor is from low to high, as runs of their own; equal ones of a batch are one row."""
        out = _Rows(folder)
        for batch in rows:
            own: dict[bytes, tuple] = {}
            for h, away, data, found in batch:
                a, b = max(0, away - high), min(len(data) - length + 1, away - low + 1)
                if a < b:
                    own.setdefault(data[a : b - 1 + length], (h, away - a, []))[2].extend((k, at + a, step, times) for k, at, step, times in found)
            out.add([(h, away, data, found) for data, (h, away, found) in own.items()], length)
        return out

    def by_anchor(rows: _Rows, folder: str, bits: int) -> Iterator[tuple[bytes, int, int]]:
        """Marks of the rows, in shards of at most `shard` bytes: by further bits of the anchor's hash, then by the windows' distance from the anchor."""
        if rows.weight <= shard or rows.count == 1:
            yield from marks(rows)
        elif not rows.one_anchor:
            for part in split(rows, folder, lambda x: (x[0] & (1 << 64) - 1) >> bits & 15):
                yield from by_anchor(part, folder, bits + 4)
        else:
            # equal windows have equal distances from the anchor; one band of distances is on disk at a time
            for band in range(rows.low // 8, rows.high // 8 + 1):
                near = between(rows, folder, band * 8, band * 8 + 7)
                if near.weight <= shard:
                    if near.count:
                        yield from marks(near)
                    continue
                for away in range(near.low, near.high + 1):
                    yield from by_bytes(between(near, folder, away, away), folder, 0)
                near.file.close()
            rows.file.close()

    def by_bytes(rows: _Rows, folder: str, bits: int) -> Iterator[tuple[bytes, int, int]]:
        """Marks of rows of one window each: by bits of a hash of their bytes; the places of a single window are not held."""
        if rows.one_data:
            places = lambda: (f for batch in rows for x in batch for f in x[3])
            first = next(places(), None)
            if any(f != first or f[3] > 1 for f in places()):
                for x in places():
                    yield from _covered(x, 0, length)
            rows.file.close()
        elif rows.weight <= shard:
            yield from marks(rows)
        else:
            for part in split(rows, folder, lambda x: hashlib.sha256(x[2]).digest()[bits // 8] >> bits % 8 & 15):
                yield from by_bytes(part, folder, bits + 4)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            files: dict[int, _Rows] = {}
            for batch in batches:
                own: dict[int, list] = {}
                for h, away, data, found in zip(*(batch.column(c).to_pylist() for c in ("h", "away", "data", "found")), strict=True):
                    own.setdefault((h & (1 << 64) - 1) >> 48 & 15, []).append((h, away, data, [(x["key"], x["at"], x.get("step", 1), x.get("times", 1)) for x in found]))
                for k, rows in own.items():
                    if k not in files:
                        files[k] = _Rows(folder)
                    files[k].add(rows, length)
            out: list[tuple[bytes, int, int]] = []

            def block() -> pa.RecordBatch:
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                return pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["key", "low", "high"])

            for rows in files.values():
                for x in by_anchor(rows, folder, 0):
                    out.append(x)
                    if len(out) >= 20_000:
                        yield block()
                        out = []
            yield block()

    return task


def _remove(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("content").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                merged = merge([(x["low"], x["high"]) for x in spans])
                kept = remaining(text, merged)
                rows.append((len(text) - len(kept), len(merged), hashlib.sha256(kept).digest(), [{"low": a, "high": b} for a, b in merged]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.record_batch([batch.column("key"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), span), strict=True))], names=["key", "n_removed", "n_spans", "kept", "spans"])

    return task


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remaining(text: bytes, merged: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in merged:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (SHA-256 of what remains), spans (maximal removed runs of bytes: low, high), for each row.

    docs: doc_id, text; other columns are ignored. A null text is empty. Texts under `length` bytes keep all. Rows of equal text repeat each other, also
    where they share a doc_id. No rows give none. length > anchor.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = cut(source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("key")), "rows")
    several = rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    anchors = cut(source.select("text").mapInArrow(_anchors(length, anchor), "h long, text long, n int"), "anchors")
    twice = anchors.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.max("n").alias("n")).where("a <> b or n > 1").select("h")
    suspects = anchors.join(twice, "h").groupBy(F.col("text").alias("short")).agg(F.collect_list("h").alias("hs"))
    digested = source.select("text").mapInArrow(_digested, "short long, key binary, content binary")
    # tasks leave one row each of a text
    held = cut(digested.join(suspects, "short").select("key", "content", "hs").dropDuplicates(["key"]), "suspects")
    done(anchors)
    size = held.agg(F.sum(F.least(F.size("hs") * F.lit(270), F.octet_length("content") * 4))).first()[0] or 0
    pieces = held.mapInArrow(_cut_runs(length, anchor), f"h long, away int, data binary, found {_FOUND}")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    marks = pieces.repartition(parts, "h").mapInArrow(_marks(length), "key binary, low long, high long")
    spans = marks.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    marked = held.select(F.substring("key", 1, 16).alias("k16"), "key", "content").join(spans.withColumnRenamed("key", "k16"), "k16").drop("k16")
    cleaned = cut(marked.mapInArrow(_remove(length), "key binary, n_removed long, n_spans long, kept binary, spans array<struct<low: bigint, high: bigint>>"), "removed")
    done(held)
    x = rows.join(several, "key", "left").join(cleaned, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").digest())
    zero = F.lit(0).cast("long")
    return x.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept", "key")).alias("kept"),
        F.when(whole, F.array(F.struct(zero.alias("low"), F.col("n_bytes").alias("high")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<low: bigint, high: bigint>>"))).alias("spans"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
