"""Exact top-k by inner product, by distributed histogram selection.

Vectors become integers, floor(256 * x). Every query is scored against every other row, in blocks: queries are packed into blocks in the shared
folder, and each task holds rows of up to HELD bytes and streams the query blocks past them, reading each block once for all rows held. Scores are not kept.
Each round counts them in a global histogram for each query, and the bin that holds the kth highest becomes the next round's range, until
the kth value itself is known. A last pass keeps the scores from there on, and ties go to the smaller id.

Of the rows that a task holds it reports a query's k highest scores alone: a bin counts less than its scores only where k of them are there, which changes
neither the bin of the kth nor how many lie above it. So a task sends at most k rows for each query and load, however many tie.

Scores are exact integers. Beyond the range of a long they saturate: such a score is the largest or the smallest value, and its ties go by id too. Of
a component beyond 2^53, floor is the component itself, and one beyond the range of a double saturates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import remove
from .common import cut, done, filesystem, new_folder

K, EVERY, SCALE = 5, 50, 256
#: Rows scored at once, queries in a block, bins, bytes of vectors that a task holds.
ROWS, QUERIES, BINS, HELD = 4096, 512, 4096, 64 << 20
#: The largest score, and below every score: marks pairs that are not scored.
MOST = (1 << 63) - 1
NONE = -(1 << 63)
_LARGEST = float(np.finfo(np.float64).max)


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of integers as double). Rows with a null id or vector, or with a component that is null, infinite or not a number, go."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # beyond 2^53 every double is an integer, and SQL's floor is a long
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), y)))
    return rows.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: whole(c * SCALE)).alias("v"))


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of up to HELD bytes at a time, by length of vector: (ids, matrix) of at most ROWS rows each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        for ids, m in _matrices(batch, ROWS):
            held.setdefault(m.shape[1], []).append((ids, m))
            size += m.nbytes
            if size >= HELD:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _matrices(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most `rows` vectors of equal length."""
    v = batch.column("v")
    first = v.offsets.to_numpy()
    size = np.diff(first)
    ids, flat = batch.column("id").to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        for k in range(0, len(at), rows):
            part = at[k : k + rows]
            yield ids[part], flat[first[part][:, None] + np.arange(dim)].reshape(len(part), dim)


_STATE = ("q", "low", "last", "left")


def _pack_queries(queries: DataFrame, folder: str) -> None:
    """Write query blocks (ids, dim, data and what _STATE names) as Parquet: one row for each block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column("v")], names=["id", "v"])
            for at, m in _matrices(place, QUERIES):
                own = batch.take(pa.array(at))
                lists = [pa.array([own.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("id", *_STATE)]
                yield pa.record_batch([*lists, pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["ids", *_STATE, "dim", "data"])

    fields = "".join(f"{c} array<long>, " for c in ("ids", *_STATE))
    queries.select("id", "v", *_STATE).mapInArrow(task, f"{fields}dim int, data binary").write.parquet(folder)


def _query_blocks(folder: str) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """The matrix of each block, and its lists."""
    fs, inner = filesystem(folder)
    for name in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(inner)) if x.path.endswith(".parquet")):
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                for x in batch.to_pylist():
                    yield np.frombuffer(x["data"], np.float64).reshape(len(x["ids"]), x["dim"]), {c: np.array(x[c], np.int64) for c in ("ids", *_STATE)}


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, saturated: in floating point where no sum can leave 53 bits, else, for the vectors that are too large for it,
    in Python's integers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    safe = np.sqrt(2.0**53 / q.shape[1])
    high_q, high_c = np.flatnonzero(np.abs(q).max(axis=1) >= safe), np.flatnonzero(np.abs(c).max(axis=1) >= safe)
    if not len(high_q) and not len(high_c):
        return (q @ c.T).astype(np.int64)
    small = lambda m, high: np.where(np.isin(np.arange(len(m)), high)[:, None], 0.0, m)
    out = (small(q, high_q) @ small(c, high_c).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    narrow = lambda x: np.clip(x, -MOST, MOST).astype(np.int64)
    if len(high_q):
        out[high_q] = narrow(whole(q[high_q]) @ whole(c).T)
    if len(high_c):
        out[:, high_c] = narrow(whole(q) @ whole(c[high_c]).T)
    return out


def _best(q: np.ndarray, ids: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k highest scores among the rows, ties to the smaller id, and their ids. NONE where there are fewer."""
    score, vec = np.full((len(q), 0), NONE), np.zeros((len(q), 0), np.int64)
    for own, m in rows:
        order = np.argsort(own, kind="stable")
        own, s = own[order], _scores(q, m[order])
        s[ids[:, None] == own[None, :]] = NONE
        if s.shape[1] > k:
            # the k highest, of those that tie with the kth the first
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            more = s > kth
            tie = s == kth
            take = more | tie & (np.cumsum(tie, axis=1) <= k - more.sum(axis=1, keepdims=True))
            at = np.nonzero(take)[1].reshape(len(s), k)
            s, own = np.take_along_axis(s, at, 1), own[at]
        else:
            own = np.broadcast_to(own, s.shape)
        score, vec = np.concatenate([score, s], axis=1), np.concatenate([vec, own], axis=1)
        if score.shape[1] > k:
            at = np.lexsort((vec, score == NONE, -np.maximum(score, -MOST)), axis=1)[:, :k]
            score, vec = np.take_along_axis(score, at, 1), np.take_along_axis(vec, at, 1)
    return score, vec


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def _histogram(folder: str, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _loads(batches):
            for q, b in _query_blocks(folder):
                s, _ = _best(q, b["ids"], held.get(q.shape[1], []), k)
                r, c = np.nonzero((s >= b["low"][:, None]) & (s <= b["last"][:, None]) & (s != NONE))
                # differences as unsigned numbers: a range may be wider than a long
                wide = (_unsigned(b["last"]) - _unsigned(b["low"])) // np.uint64(BINS) + np.uint64(1)
                bins = ((_unsigned(s[r, c]) - _unsigned(b["low"][r])) // wide[r]).astype(np.int64)
                pairs, n = np.unique(r * BINS + bins, return_counts=True)
                yield pa.record_batch([pa.array(b["q"][pairs // BINS]), pa.array(pairs % BINS), pa.array(n.astype(np.int64))], names=["q", "bin", "n"])

    return task


def _above(folder: str, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _loads(batches):
            for q, b in _query_blocks(folder):
                s, vec = _best(q, b["ids"], held.get(q.shape[1], []), k)
                r, c = np.nonzero((s >= b["low"][:, None]) & (s != NONE))
                yield pa.record_batch([pa.array(b["q"][r]), pa.array(b["ids"][r]), pa.array(vec[r, c]), pa.array(s[r, c])], names=["q", "query_id", "vec_id", "score"])

    return task


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest score for each query, all where there are fewer. Both inputs: id, v of quantised().

    A row with the query's own id is no candidate. Only vectors of equal length are compared. Rows with equal ids count each; queries with an id in common are
    one query each if their vectors differ, each with its own ranks, and one query if they do not. No rows, or no queries, give none.
    """
    spark = rows.sparkSession
    data = cut(rows.select("id", "v"), "vectors")
    asked = cut(queries.select("id", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    # no score is outside +-(longest query * longest row), by the largest sum of absolute values against the largest component
    size = lambda d: d.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)))).first()[0]
    sums, largest = size(asked), data.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    span = int(min(float(sums or 0) * float(largest or 0) * (1 + 1e-9) + 1, 2.0**63))
    span = min(span, MOST)
    state = asked.select("q", "id", "v", F.lit(-span).cast("long").alias("low"), F.lit(span).cast("long").alias("last"), F.lit(k).cast("long").alias("left"))
    first, width = state, 2 * span + 1
    while True:
        folder = new_folder(spark, "query-blocks")
        _pack_queries(state, folder)
        if width <= 1:
            break
        last_state = state
        width = (width - 1) // BINS + 1
        counts = data.mapInArrow(_histogram(folder, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        # the bin of the kth; with fewer than k scores the lowest bin, so that all stay
        found = state.select("q", "left").join(counts.withColumn("up_to", down), "q").where(F.col("up_to") >= F.col("left")).groupBy("q", "left").agg(F.max(F.struct("bin", (F.col("up_to") - F.col("n")).alias("above"))).alias("x"))
        found = found.select("q", F.col("x.bin").alias("bin"), F.col("x.above").alias("above"))
        wide = F.expr(f"(CAST(last AS DECIMAL(38,0)) - CAST(low AS DECIMAL(38,0))) div {BINS} + 1")
        low = F.when(F.col("bin").isNull(), F.col("low")).otherwise((F.col("low").cast("decimal(38,0)") + F.col("bin").cast("decimal(38,0)") * wide).cast("long"))
        state = state.join(found, "q", "left").withColumn("wide", wide).withColumn("low", low)
        last = F.least(F.col("last").cast("decimal(38,0)"), F.col("low").cast("decimal(38,0)") + F.col("wide") - 1).cast("long")
        state = cut(state.select("q", "id", "v", "low", last.alias("last"), (F.col("left") - F.coalesce(F.col("above"), F.lit(0))).alias("left")), "query-state")
        remove(spark, folder)
        if last_state is not first:
            done(last_state)
    best = data.mapInArrow(_above(folder, k), "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where(F.col("id") % EVERY == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
