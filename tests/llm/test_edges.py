"""Operators and the pipeline on empty tables, null and repeated ids, repeated rows and clashing columns, and the pipeline against brute force down to its pieces."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _classes, _repeat_words

from glossa.llm import minhash, mixing, packing, pii, sharding, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, file string, slot string, a string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def stored(spark, rows, folder):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def ids():
    tok = tokens.Encoder(tokens.default_path()).tok
    return lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    d = stored(spark, [], tmp_path)
    assert sharding.op4(spark, d).count() == token_files.op5(spark, d).count() == packing.op6(spark, d).count() == minhash.op3(spark, d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0


def test_null_and_repeated_ids(spark, tmp_path, ids):
    texts = ["one two", "one two", None, "three\nfour", "", "x " * 5000, "one two"]
    rows = [(i, t, "s") for i, t in zip([3, 3, None, None, 3, 1, None], texts, strict=True)]
    d = stored(spark, rows, tmp_path)
    got = token_files.op5(spark, d).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    packed = packing.op6(spark, d).collect()
    check_packed(packed, [(i, t) for i, t, _ in rows], ids)
    assert sharding.op4(spark, d).count() == len(rows)


def check_packed(packed, docs, ids):
    """Pieces of all documents, each row's once, in sequences without gaps or overlaps."""
    want = collections.Counter()
    for i, t in docs:
        x, at = ids(t), 0
        for k, end in enumerate(range((len(x) - 1) % 2048 + 1, len(x) + 1, 2048)):
            want[i, k, at, end - at, zlib.crc32(x[at:end].tobytes())] += 1
            at = end
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    seqs = collections.defaultdict(list)
    for r in packed:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    return len(seqs)


def _pieces(spark, lengths):
    return spark.createDataFrame([(k, 0, 0, int(n), 7) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_rounds_of_exchange(spark):
    """Many partitions: no more sequences than they open alone, all pieces in place, certificates that hold."""
    r = np.random.default_rng(5)
    for lengths in (r.integers(300, 1100, 3000), np.array([1024] * 501 + [683] * 1000)):
        rows = packing.pack(_pieces(spark, lengths), per_task=200).collect()
        seqs = collections.defaultdict(list)
        for x in rows:
            seqs[x.sequence_id].append(x)
        assert sorted(x.length for x in rows) == sorted(lengths.tolist())
        for s in seqs.values():
            s.sort(key=lambda x: x.offset)
            assert [x.offset for x in s] == [sum(y.length for y in s[:k]) for k in range(len(s))] and s[-1].offset + s[-1].length <= 2048
            assert len({(x.group_count, x.group_bound, x.certified) for x in s}) == 1
            full = s[-1].offset + s[-1].length == 2048
            assert s[0].certified == (full or s[0].group_count == s[0].group_bound) and s[0].group_count >= s[0].group_bound
        alone = sum(len(packing.best_fit(p, 2048)[2]) for p in np.array_split(lengths, 15))
        assert packing.lower_bound(lengths, 2048) <= len(seqs) <= alone


def test_a_round_never_opens_more(spark):
    """A group keeps what it had unless a new packing needs fewer sequences."""
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 0)

    r = random.Random(4)
    for _ in range(300):
        bins, rows = [], []
        for b in range(12):
            at = 0
            while at < 60:
                n = r.randrange(5, 60)
                if at + n > 100:
                    break
                rows.append((len(rows), 0, 0, n, 0, 1000 + b, at))
                at += n
            bins.append(at)
        batch = pa.record_batch([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=packing._COLUMNS)
        keep, packing.TaskContext = packing.TaskContext, type("C", (), {"get": staticmethod(lambda: Task)})
        try:
            out = pa.Table.from_batches(list(packing._pack(100, 1)(iter([batch]))))
        finally:
            packing.TaskContext = keep
        assert len(set(out["sequence_id"].to_pylist())) <= 12 and sorted(out["length"].to_pylist()) == sorted(x[3] for x in rows)


@pytest.mark.parametrize("fit", [packing.best_fit, packing.gap_fit])
def test_fits(fit):
    r = random.Random(1)
    for _ in range(200):
        x = np.array([r.randrange(1, 101) for _ in range(r.randrange(0, 60))], np.int64)
        seq, off, held = fit(x, 100)
        assert (np.bincount(seq, x, len(held)) == held).all() and (held <= 100).all() and len(held) >= packing.lower_bound(x, 100)
        for s in range(len(held)):
            own = sorted(zip(off[seq == s].tolist(), x[seq == s].tolist(), strict=True))
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_hubs_of_many_members(spark, monkeypatch):
    """A hub whose members are dealt to several groups gives the classes of brute force."""
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    r = random.Random(3)
    base = [f"w{r.randrange(300)}" for _ in range(90)]
    texts = []
    for k in range(40):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(90)] = f"z{k}"
        texts.append(" ".join(w))
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = dict(map(tuple, minhash.classes(docs).collect()))
    assert [got[k] for k in range(40)] == _classes(texts)


WORD = r"[^\x20\x09-\x0D]+"


def _kept(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    chars, upper = sum(map(len, w)), sum(c.isupper() for c in t)
    symbols = sum(c in "#*$%&|<>" for c in t)
    return not (len(w) < 10 or 100 * _repeat_words(t) > 20 * len(w) or 10 * symbols > len(w) or not 2 * len(w) <= chars <= 15 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or 2 * upper > chars)


def test_pipeline_down_to_its_pieces(spark, tmp_path, ids):
    """Each stage on what its predecessor kept, against plain Python, and run() against the last of them."""
    import corpus_pipeline

    r = random.Random(8)
    word = lambda n, seed: " ".join(f"t{random.Random(seed + k).randrange(4000)}" for k in range(n))
    texts = [word(r.choice([15, 80, 400]), 1000 * k) for k in range(24)] + [None, "", "too short", "### $$$ " * 30, "UPPER CASE WORDS ARE ALL THAT THERE IS IN THIS ONE TEXT HERE", "the same line of it\n" * 9]
    texts += [texts[1], texts[2] + " more", "write to a.b@c.org or call +1 (555) 123-4567 now " + word(60, 99_000), "ip 10.0.0.1 " + word(50, 98_000), word(9000, 97_000)]
    rows = [(k, t, r.choice(["hot", "hot", "b", None])) for k, t in enumerate(texts)] + [(None, word(30, 96_000), "b")]
    d = stored(spark, rows, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    tables = [spark.read.parquet(f"{d}/documents.parquet")]
    for k, name in enumerate(["quality_rules", "near_dedup", "personal_data", "source_mix"]):
        stages[name](spark, tables[-1], d).write.parquet(f"{d}/{k}/documents.parquet")
        tables.append(spark.read.parquet(f"{d}/{k}/documents.parquet"))
        assert tables[-1].columns == tables[0].columns
    at = [[(x.doc_id, x.text, x.source) for x in t.collect()] for t in tables]
    key = lambda x: repr(x)
    kept = sorted((x for x in at[0] if _kept(x[1])), key=key)
    assert sorted(at[1], key=key) == kept
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0))
    first = [x for k, x in enumerate(kept) if _classes([t for _, t, _ in kept])[k] == k]
    assert sorted(at[2], key=key) == sorted(first, key=key)
    clean = [(i, pii.redact(t, pii.find(t)), s) for i, t, s in first]
    assert sorted(at[3], key=key) == sorted(clean, key=key) and sum("<EMAIL>" in t and "<PHONE>" in t for _, t, _ in clean) == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/2/documents.parquet/*.parquet'")
    taken = {(x[0], x[1]): x[4] for x in con.execute(mixing.OP10_SQL).fetchall()}
    mixed = []
    for i, t, s in clean:
        size = len(re.findall(WORD, t))
        n = taken[i, size]
        for part in (min(n, size), max(0, n - size)):
            if part:
                mixed.append((i, t if part == size else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part]), s))
    assert sorted(at[4], key=key) == sorted(mixed, key=key)
    docs = [(i, t) for i, t, _ in mixed]
    n = check_packed(stages["packing"](spark, tables[4], d).collect(), docs, ids)
    assert check_packed(corpus_pipeline.run(spark, d).collect(), docs, ids) == n == packing.lower_bound(np.array([len(x) for _, t in docs for x in np.split(ids(t), range((len(ids(t)) - 1) % 2048 + 1, len(ids(t)), 2048))]), 2048)
    assert tables[4].where(F.col("n_chars") != F.length("text")).count() == 0
