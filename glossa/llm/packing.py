"""Best-fit packing of documents into token sequences, certified by dual-feasible functions.

Documents become pieces of at most `most` tokens. Pieces are dealt to partitions; each packs its own by best-fit decreasing and compares
the number of sequences with a lower bound from dual-feasible functions. A partition at its bound is certified and final, and so is every full sequence. Partitions
with a gap exchange their other sequences: whole sequences are dealt anew, so that each group holds some of many partitions, and a group packs their pieces again, by
best-fit decreasing and by filling gaps exactly. A new packing is kept where it needs fewer sequences than the group had; so no round makes more of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import default_path, encoder, forget
from .token_files import END

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"
PACKED = f"{PLACED}, group_count long, group_bound long, certified boolean"
#: Rounds of exchange at most; a round that gains nothing is the last one anyway.
ROUNDS = 4


def pieces(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, release: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Documents of more than `most` ids are cut from the end, so that only the first piece is shorter.

    Null and empty texts are the end id alone. With `release`, a task ends without words in memory, for pipelines whose other stages need it; the
    result is the same. Repeated rows give their pieces each; other columns are ignored.
    """
    path = tokenizer or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(batch.column("text").to_pylist()), strict=True):
                ids += END
                n = len(ids) // 4
                ends = range((n - 1) % most + 1, n + 1, most)
                at = 0
                for k, end in enumerate(ends):
                    rows.append((doc, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
                    at = end
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if release:
            forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, PIECE)


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """At least so many sequences are needed: the largest value over dual-feasible functions.

    Used are the identity (total length), Martello and Toth's u_a, which counts lengths over most - a whole and leaves out those under a, and
    the rounding functions f_k, which count how many k-ths of a sequence each length takes alone.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=most + 1).astype(np.int64)
    size = np.arange(most + 1)
    best = -(-int(count @ size) // most)
    over = count[::-1].cumsum()[::-1]  # over[x]: how many are of length x or more
    total = (count * size)[::-1].cumsum()[::-1]
    for a in range(1, most // 2 + 1):
        big = int(over[most - a + 1])
        middle = int(total[a] - total[most - a + 1])
        best = max(best, big + -(-middle // most))
    for k in range(1, 33):
        units = (size * (k + 1)) // most
        exact = (size * (k + 1)) % most == 0
        value = np.where(exact, size * k * (k + 1), units * most * (k + 1))  # times k * (k + 1) * most / most
        best = max(best, -(-int(count @ value) // (k * (k + 1) * most)))
    return best


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence and the offset of each piece, and how much each sequence holds."""
    free: list[list[int]] = [[] for _ in range(most + 1)]  # sequences by the room that is left
    there = 0  # bit x: free[x] is not empty
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
        else:
            b, room, n = n, most, n + 1
        seq[i], off[i] = b, most - room
        if room > size:
            free[room - size].append(b)
            there |= 1 << (room - size)
    held = np.bincount(seq, lengths, n).astype(np.int64) if n else np.zeros(0, np.int64)
    return seq, off, held


def gap_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_fit(), but sequence by sequence: the longest piece that is left, then what fills the gap exactly, one piece or two, else the longest piece that fits, and
    so on."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    count = np.bincount(sizes, minlength=most + 1)
    first = np.concatenate([[0], np.cumsum(count[::-1])])[::-1][1:]  # where pieces of each length begin in order
    left = count.copy()
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    held: list[int] = []
    top = most
    for _ in range(len(lengths)):
        while top and not left[top]:
            top -= 1
        if not top:
            break
        room, taken = most, [top]
        while taken:
            for x in taken:
                i = order[first[x] + count[x] - left[x]]
                left[x] -= 1
                seq[i], off[i] = len(held), most - room
                room -= x
            there = left[: room + 1] > 0
            fits = np.flatnonzero(there)
            if not len(fits):
                break
            if there[room]:
                taken = [room]
                continue
            pairs = fits[(2 * fits >= room)]
            pairs = pairs[there[room - pairs]]
            pairs = pairs[(2 * pairs != room) | (left[pairs] > 1)]
            taken = [int(pairs[-1]), room - int(pairs[-1])] if len(pairs) else [int(fits[-1])]
        held.append(most - room)
    return seq, off, np.array(held, np.int64)


_COLUMNS = [c.split()[0] for c in PLACED.split(", ")]


def _pack(most: int, tier: int):
    """One round's work in a task. From the second round on, sequence_id and offset are those of the round before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        bound = lower_bound(lengths, most)
        seq, off, size = best_fit(lengths, most)
        base = (tier << 58) | (TaskContext.get().partitionId() << 34)
        if len(size) > bound:
            other = gap_fit(lengths, most)
            if len(other[2]) < len(size):
                seq, off, size = other
        if tier:
            names, place = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
            if len(size) >= len(names):  # as it was
                seq, off, size = place, table["offset"].to_numpy(), np.bincount(place, lengths).astype(np.int64)
                base = names
        final = (size == most) | (len(size) == bound)
        ids = base[seq] if isinstance(base, np.ndarray) else seq + base
        n = len(lengths)
        more = {"sequence_id": ids, "offset": off, "group_count": np.full(n, len(size)), "group_bound": np.full(n, bound), "certified": final[seq]}
        out = table.select(_COLUMNS[:5])
        for name, x in more.items():
            out = out.append_column(name, pa.array(x))
        yield from out.to_batches(50_000)

    return task


def pack(pieces: DataFrame, most: int = 2048, per_task: int = 100_000) -> DataFrame:
    """The pieces with sequence_id and offset, and the certificate of each: how many sequences its group had when it was packed last, the lower bound for them, and
    whether its own is proven to be one that cannot be spared (its group is at the bound, or it is full). No pieces give no rows; a piece longer than `most` is an error.

    per_task bounds the pieces a task packs, about. It sets the number of partitions, and drops nothing: every round deals what is not certified to as many
    partitions as that bound asks for.
    """
    rest = pieces.select(*_COLUMNS[:5])
    n = pieces.count()
    finished: list[DataFrame] = []
    before = None
    for tier in range(ROUNDS + 1):
        parts = max(1, -(-n // per_task))
        # pieces in turn, so that repeated rows spread too; then whole sequences, by the round as well, so that groups differ
        dealt = rest.repartition(parts) if not tier else rest.select(*_COLUMNS).repartition(parts, F.xxhash64("sequence_id", F.lit(tier)))
        packed = cut(dealt.mapInArrow(_pack(most, tier), PACKED), "packed")
        rest = packed.where("not certified")
        n, now = rest.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        full = packed.where("certified").agg(F.count_distinct("sequence_id")).first()[0]
        over = tier == ROUNDS or not n or tier and (parts == 1 or before == now + full)
        finished.append(packed if over else packed.where("certified"))
        if over:
            break
        before = now
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places, and the certificate of each."""
    return pack(cut(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces"))
