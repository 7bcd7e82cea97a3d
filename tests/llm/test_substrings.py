"""Repeated substrings in long uniform and periodic texts, whose places are few entries, against all windows."""

import collections
import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest

from glossa.llm import substrings


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for k, b in enumerate(data):
        spans = substrings.merge([(i, i + 200) for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1])
        kept = substrings.remaining(b, spans)
        out.append((k, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def test_query(spark, tmp_path):
    r = random.Random(2)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared, period = word(260), word(7)
    texts = ["a" * 5000, "a" * 199, "a" * 200, "x" + "a" * 300, period * 400, word(50) + period * 40, (word(230) + " ") * 3, shared + word(30), word(500) + shared, word(100) + shared[:205] + word(90), None, "", "é" * 1200, word(300), shared[30:240]]
    rows = [(k, t, "clash", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, key string, n_bytes long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, substrings.op1(spark, str(tmp_path)).collect())) == brute(texts)


@pytest.mark.parametrize("text", [b"a" * 400_000, b"abcdefg" * 60_000, bytes(range(97, 122)) * 16_000])
def test_places_of_a_uniform_text_are_few(text):
    """One row for each distinct window of a period, with one entry each, and one span in the end."""
    batch = pa.record_batch([pa.array([hashlib.sha256(text).digest()]), pa.array([text]), pa.array([sorted(set(substrings.runs([text])[3].view("int64").tolist()))], pa.list_(pa.int64()))], names=["key", "content", "hs"])
    tracemalloc.start()
    cut = list(substrings._cut_runs(200, 64)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(text) + (64 << 20)
    assert sum(len(f) for b in cut for f in b.column("found").to_pylist()) < 200
    spans = [(low, high) for b in substrings._marks(200)(iter(cut)) for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)]
    assert len(spans) < 400 and substrings.merge(spans) == [(0, len(text))]


def test_steps():
    found = []
    for at in (5, 8, 11, 14, 20, 21):
        substrings._extend(found, b"k", at)
    substrings._extend(found, b"l", 22)
    assert [(x["at"], x["step"], x["times"]) for x in found] == [(5, 3, 4), (20, 1, 2), (22, 1, 1)]
    assert list(substrings._covered((b"k", 5, 3, 4), 0, 2)) == [(b"k", 5, 7), (b"k", 8, 10), (b"k", 11, 13), (b"k", 14, 16)]
    assert list(substrings._covered((b"k", 5, 3, 4), 1, 4)) == [(b"k", 6, 18)]
