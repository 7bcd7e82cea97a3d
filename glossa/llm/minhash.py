"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles. Each shingle has a Poisson process over time and weight, seeded by its hash: the weight
axis is split into [0, 1) and dyadic intervals [2^j, 2^(j+1)), each with a process of a rate equal to its length, and a point counts for a document if
its weight coordinate is below the shingle's count. (This is the hierarchy of BagMinHash with the splits drawn at once: the bits of the coordinate are
the splits.) Every point has a component of the signature drawn at random; a component is the earliest point it gets. Processes run in order of time and
stop at the latest component, so that most shingles cost one point. Two components are equal with the weighted Jaccard similarity as probability.

Documents with a band of components in common are candidates. All of a band's documents are compared with one of them, its hub, by exact multiset
overlap; where that leaves a band in more than one class, those outside the hub's class are compared with every other that exact bounds leave in
reach, so that no link is lost to a cap. Classes are connected components. Exact copies are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, done
from .tokens import forget
from .hashing import GOLDEN, M1, U, mix, multisets, times

SIMILARITY, SHINGLE = 0.8, 5
#: 42 bands of 6: a pair at 0.8 has no band in common with probability 3e-6, one at 0.5 with 0.51.
BANDS, ROWS = 42, 6
#: Bytes of text in one round of numpy work.
CHUNK = 2 << 20


def signatures(texts: list[bytes], size: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts x size) components, as the bits of the times of their points, and how many shingles each text has (repeats counted)."""
    doc, h, count = multisets(texts, shingle)
    total = np.bincount(doc, count, len(texts)).astype(np.int64)
    best = np.full(len(texts) * size, np.inf)
    # processes: unit interval, then [2^j, 2^(j+1)) for each j that the count reaches into
    parts = [(doc, h, np.ones(len(h)), np.zeros(len(h), np.int64), count)]
    j = 0
    while (count > 1 << j).any():
        own = count > 1 << j
        parts.append((doc[own], mix(h[own] + times(j + 1, M1)), np.full(own.sum(), float(1 << j)), np.full(own.sum(), 1 << j), count[own]))
        j += 1
    doc, seed, rate, low, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    x = np.zeros(len(doc))
    step = np.zeros(1, U)
    while len(doc):
        step = step + U(3)
        u, place, height = (mix(seed + (step + U(k)) * GOLDEN) for k in range(3))
        x = x - np.log(((u >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        good = low + ((height >> U(11)).astype(float) * 2.0**-53 * rate).astype(np.int64) < count
        np.minimum.at(best, doc[good] * size + (place[good] % U(size)).astype(np.int64), x[good])
        alive = x < best.reshape(-1, size).max(axis=1)[doc]
        doc, seed, rate, low, count, x = doc[alive], seed[alive], rate[alive], low[alive], count[alive], x[alive]
    return best.view(U).reshape(-1, size), total


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    out = np.empty((len(sig), bands), U)
    for b in range(bands):
        h = np.full(len(sig), times(b + 1, GOLDEN))
        for r in range(rows):
            h = mix(h * GOLDEN + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def _signed(bands: int, rows: int, shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        forget()
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or b"" for t in batch.column("text").to_pylist()]
            keys = [hashlib.sha256(t).digest()[:16] for t in texts]
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    new.append(i)
                    if len(seen) < 1_000_000:  # a copy that is not recognised here costs time, no more
                        seen.add(k)
            found: list[list[int] | None] = [None] * len(texts)
            totals = [0] * len(texts)
            at = 0
            while at < len(new):
                end, n = at, 0
                while end < len(new) and (end == at or n + len(texts[new[end]]) <= CHUNK):
                    n += len(texts[new[end]])
                    end += 1
                part = new[at:end]
                sig, total = signatures([texts[i] for i in part], bands * rows, shingle)
                for i, row, t in zip(part, band_keys(sig, bands, rows).tolist(), total.tolist(), strict=True):
                    totals[i] = t
                    found[i] = row if t else None
                at = end
            yield pa.record_batch([ids, pa.array(keys, pa.binary()), pa.array(totals, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bands"])

    return task


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted distinct hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _compare(shingle: int):
    """(a, b, similarity), from rows of which each hub's own (without b) comes before those of its members."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, bag = None, None
        for batch in batches:
            a, b, text = (batch.column(c).to_pylist() for c in ("a", "b", "text"))
            found = []
            for x, y, t in zip(a, b, text, strict=True):
                own = multisets([t], shingle)[1:]
                if y is None:
                    hub, bag = x, own
                else:
                    if x != hub:
                        raise ValueError("a member without its hub")
                    found.append((x, y, similarity(bag, own)))
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return task


#: Members that are compared with one copy of their hub's text, about.
MEMBERS = 500


def salted(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, salt, b, text: the members of each hub with their texts, dealt to groups of about MEMBERS, and first in each group, without b, the hub's own
    text. However many members a hub has, no task gets them all, and its text travels once for each group."""
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("long").alias("groups")), "hub-sizes")
    dealt = cut(pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups"))).drop("groups"), "dealt-pairs")
    own = texts.select("key", "text")
    members = dealt.join(own.withColumnRenamed("key", "b"), "b").select("a", "salt", "b", "text")
    hubs = dealt.select("a", "salt").distinct().join(own.withColumnRenamed("key", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.unionByName(hubs).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))


def verify(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """pairs (a, b) with their exact similarity; texts: key, text (binary), one row for each key."""
    return salted(pairs, texts).select("a", "b", "text").mapInArrow(_compare(shingle), "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """key, root: the smallest key of the connected component of each key in links (a, b).

    Large-star and small-star in turn, each with its lineage cut, until nothing changes: every step is a group-by and a join on keys, and no
    neighbourhood is gathered in one place.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        x = (both.where("b > a") if large else both.where("b < a")).join(low, "a")
        out = x.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(low.where("m < a").select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        large = cut(star(edges, True), "star")
        small = cut(star(large, False), "star")
        done(edges, large)
        edges = small
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("root"))).distinct()


def _rooted(rows: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(roots.select(F.col("key").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def classes(docs: DataFrame, similar: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id: the class of each row, named by its smallest doc_id.

    docs: doc_id, text; other columns are ignored. Rows of equal text are one class. Texts without words (null ones too) are linked to nothing: each
    such row is its own class. Texts of one to four words have one shingle, all their words. Rows with a null doc_id keep it, and do not name a class
    unless all its rows are without one. No rows give none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = cut(source.mapInArrow(_signed(bands, rows, shingle), "doc_id long, key binary, n long, bands array<long>"), "signatures")
    nodes = signed.where("bands is not null")
    # one row for each distinct text: tasks leave one each, so this is small work
    flat = nodes.select("key", "n", F.explode("bands").alias("band")).distinct()
    # grouped tables are written before they are joined with what they were made from: a join of two plain tables can split a key that many rows have
    several = cut(flat.groupBy("band").agg(F.count("*").alias("many")).where("many > 1"), "several")
    met = cut(flat.join(several, "band"), "bands")
    # a band's hub is its most central member, the one that meets the most others over all bands: the original rather than a copy of it
    central = cut(met.groupBy("key").agg(F.sum("many").alias("meets")), "central")
    hubs = cut(met.join(central, "key").groupBy("band").agg(F.max(F.struct("meets", "key")).alias("x")).select("band", F.col("x.key").alias("hub")), "hubs")
    shared = cut(met.drop("many").join(hubs, "band"), "bands")
    done(several, central, met, hubs)
    pairs = cut(shared.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    needed = shared.select("key").distinct()
    # texts of the nodes that share a band, one row each: of a node's rows the one of its smallest doc_id
    named = signed.groupBy("key").agg(F.min("doc_id").alias("_id")).join(needed, "key", "left_semi")
    texts = source.withColumn("_key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    texts = texts.join(named, (texts["_key"] == named["key"]) & texts["doc_id"].eqNullSafe(named["_id"])).select("key", "text")
    texts = cut(texts.mapInArrow(_first_of_key, "key binary, text binary").dropDuplicates(["key"]), "texts")
    checked = cut(verify(pairs, texts, shingle), "checked")
    links = checked.where(F.col("similarity") >= similar).select("a", "b")
    roots = components(links)
    # bands that still hold several classes: members outside the hub's class against all others that they can still be linked to
    held = _rooted(shared, roots, "key", "root")
    open_bands = held.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("band")
    left = cut(held.join(open_bands, "band"), "open-bands")
    if left.head(1):
        links = links.unionByName(_further(left, roots, texts, similar, shingle))
        roots = components(links)
    member = cut(_rooted(signed.select("doc_id", "key", "n"), cut(roots, "roots"), "key", "root"), "members")
    name = cut(member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("words")), "names")
    done(signed, shared, texts, checked)
    out = member.join(name, "root")
    # a copy without bands of its own (its task met the text before) has n = 0 as well; words tells it from a text without words
    own = F.when(F.col("words") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"))


def _first_of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        keep = []
        for k, key in enumerate(batch.column("key").to_pylist()):
            if key != last:
                keep.append(k)
            last = key
        yield batch.take(pa.array(keep, pa.int64()))


def _spread(parts: int, shingle: int):
    """(part, keys, sizes, data): the distinct shingles of a batch's texts, dealt by hash; data holds pairs (hash, count)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            doc, h, count = multisets(texts, shingle)
            where = (h % U(parts)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            there, begin = np.unique(where[order], return_index=True)
            rows = []
            for p, own in zip(there.tolist(), np.split(order, begin[1:]) if len(begin) else [], strict=True):
                docs, sizes = np.unique(doc[own], return_counts=True)
                rows.append((p, [keys[int(i)].as_py() for i in docs], sizes.tolist(), np.stack([h[own], count[own].astype(U)]).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "keys", "sizes", "data"])

    return task


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own): of the shingles of these parts, how many (counted) no other text holds. One row for each text and task."""
    keys: list[bytes] = []
    parts = []
    for batch in batches:
        for row in batch.to_pylist():
            data = np.frombuffer(row["data"], U).reshape(2, -1)
            parts.append((data[0], data[1], np.repeat(np.arange(len(keys), len(keys) + len(row["keys"])), row["sizes"])))
            keys += row["keys"]
    if parts:
        h, count, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, place, many = np.unique(h, return_inverse=True, return_counts=True)
        single = many[place] == 1
        own = np.bincount(doc[single], count[single].astype(float), len(keys)).astype(np.int64)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(own, pa.int64())], names=["key", "own"])


#: Shingles counted in one task by _alone.
TASK_SHINGLES = 2_000_000


def _elements(text: bytes, shingle: int) -> np.ndarray:
    """A multiset as a set: one hash for each shingle and number of its occurrence, sorted."""
    _, h, count = multisets([text], shingle)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(mix(np.repeat(h, count) + number.astype(U) * GOLDEN))


def _differences(shingle: int):
    """(hub, key, delta): the elements that one of both has and the other lacks, from rows of salted()."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, U)
        for batch in batches:
            a, b, text = (batch.column(c).to_pylist() for c in ("a", "b", "text"))
            found = []
            for x, y, t in zip(a, b, text, strict=True):
                own = _elements(t, shingle)
                if y is None:
                    held = own
                else:
                    found.append((x, y, np.setxor1d(held, own, assume_unique=True).view(np.int64)))
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["hub", "key", "delta"])

    return task


def _further(left: DataFrame, roots: DataFrame, texts: DataFrame, similar: float, shingle: int) -> DataFrame:
    """Links (a, b) between different classes of one open band. What is not compared is proven too far apart:

    A text shares at most s = n - own of its n shingles with any other of the open bands, where own counts those that no other holds, and two
    texts share at most the smaller s. Texts that no other of their band can reach go first. The rest is compared hub by hub, those outside the hub's
    class with all others, by their differences from the hub alone: where x and y differ from the hub by the sets X and Y, they differ from each
    other by the elements that are in one of X and Y only. Only links leave the join.
    """
    members = left.groupBy("key").agg(F.first("n").alias("n"))
    total = members.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // TASK_SHINGLES))
    blocks = texts.join(members.select("key"), "key", "left_semi").mapInArrow(_spread(parts, shingle), "part int, keys array<binary>, sizes array<long>, data binary")
    own = blocks.repartition(parts, "part").mapInArrow(_alone, "key binary, own long").groupBy("key").agg(F.sum("own").alias("own"))
    x = left.join(own, "key").withColumn("s", F.col("n") - F.col("own"))
    least = x.groupBy("band").agg(F.min("n").alias("least"))
    e = 1e-9
    live = x.join(least, "band").where(F.col("s") >= similar * (F.col("n") + F.greatest("least", "s") - F.col("s")) - e)
    live = cut(live.select("hub", "key", "n", "s", "root").distinct(), "live")
    pairs = live.select(F.col("hub").alias("a"), F.col("key").alias("b"))
    delta = salted(pairs, texts).select("a", "b", "text").mapInArrow(_differences(shingle), "hub binary, key binary, delta array<long>")
    live = cut(_rooted(live.join(delta, ["hub", "key"]), roots, "hub", "main"), "live")
    y = live.select("hub", *(F.col(c).alias(f"{c}2") for c in ("key", "n", "s", "root", "delta")))
    shared = F.least("s", "s2")
    reach = (shared >= similar * (F.col("n") + F.col("n2") - shared) - e) & (F.least("n", "n2") >= similar * F.greatest("n", "n2") - e)
    # by whole numbers: with difference d, shared = (n + n2 - d) / 2 and the union is (n + n2 + d) / 2
    differ = F.size("delta") + F.size("delta2") - 2 * F.size(F.array_intersect("delta", "delta2"))
    linked = F.col("n") + F.col("n2") - differ >= similar * (F.col("n") + F.col("n2") + differ)
    found = live.where("root <> main").join(y, "hub").where((F.col("root") != F.col("root2")) & reach & linked)
    return cut(found.select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct(), "further-links")


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that stay when one of each class does, all columns as they are: the row whose doc_id names the class. Rows without doc_id, and
    rows that share one, stay or go together. doc_id should tell rows apart."""
    own = classes(docs, **settings).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(own, docs["doc_id"].cast("long").eqNullSafe(own["_id"]), "left_semi")


def op3(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
