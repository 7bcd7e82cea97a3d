"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import html_text, minhash, mixing, packing, pii, quality, sharding, substrings, suffixes, token_files, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, slot string"


def frame(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", 0, "k", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


BASE = prose(1, 120)
TEXTS = [None, "", " \n", "one", "one two three four", BASE, BASE, BASE.replace("w1 ", "x ", 1), prose(2, 60) + " " + BASE, "aé " * 400, prose(3, 6000), prose(4, 30) + "\n" + prose(4, 30), "a", "a"]


def test_suffixes():
    r = random.Random(5)
    for _ in range(60):
        x = [r.randrange(1, 1 + r.choice([2, 3, 200])) for _ in range(r.randrange(2, 90))]
        x += x[: r.randrange(len(x))] * r.randrange(3)
        n, cap = len(x), r.choice([1, 2, 5, 40])
        seen = collections.Counter(tuple(x[i : i + cap]) for i in range(n - cap + 1))
        want = [i + cap <= n and seen[tuple(x[i : i + cap])] > 1 for i in range(n)]
        assert suffixes.repeated(np.array([*x, 0], np.uint16), cap, r.choice([0, 1 << 20]))[:-1].tolist() == want


def test_substrings(spark):
    got = sorted(map(tuple, substrings.repeats(frame(spark, TEXTS)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept"))).collect()))
    data = [(t or "").encode() for t in TEXTS]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for k, b in enumerate(data):
        spans = substrings.merge([(i, i + 200) for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1])
        kept = substrings.remaining(b, spans)
        want.append((k, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert got == want
    assert substrings.repeats(frame(spark, TEXTS[:1]).limit(0)).count() == 0


def test_one_anchor_is_cut_by_distance():
    """A shard limit so small that single anchors are split gives the same marks."""
    texts = [f"{k:03d}".encode() * 40 + BASE.encode()[:400] + f"{k:04d}".encode() * 40 for k in range(6)]
    text, at, many, h, place = substrings.runs(texts)
    rows = [(int(x), int(p - a), texts[t][a : a + m + 199], [(b"%d" % t, int(a))]) for t, a, m, x, p in zip(text, at, many, h.view(np.int64), place, strict=True)]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([[{"key": k, "at": a} for k, a in r[3]] for r in rows])], names=["h", "away", "data", "found"])
    spans = []
    for limit in (1, 1 << 30):
        found = collections.defaultdict(list)
        for b in substrings._marks(200, limit)(iter([batch])):
            for k, low, high in zip(*(b.column(c).to_pylist() for c in ("key", "low", "high")), strict=True):
                found[k].append((low, high))
        spans.append({k: substrings.merge(v) for k, v in found.items()})
    assert spans[0] == spans[1] and len(spans[0]) == 6


def _anchored(n, many, batch=500):
    """Batches of runs of one anchor among different neighbours: of the first 200 texts two each are equal, and all texts share the windows from their 24th byte on."""
    import pyarrow as pa

    for c in range(0, n, batch):
        ks = range(c, min(c + batch, n))
        data = [(b"%06d" % (k % 100)) * 4 + b"p" * (176 + many - 1) if k < 200 else (b"%08d" % k) * 3 + b"p" * (176 + many - 1) for k in ks]
        yield pa.record_batch([pa.array([7] * len(ks), pa.int64()), pa.array([many + 20] * len(ks), pa.int32()), pa.array(data, pa.binary()), pa.array([[{"key": b"%d" % k, "at": 3}] for k in ks], pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int64())])))], names=["h", "away", "data", "found"])


def test_one_anchor_is_never_held(monkeypatch):
    """No more than the limit is sorted or held at once, whatever one anchor or one window has, and the marks are those of brute force."""
    import tracemalloc

    n, many, limit = 700, 27, 60_000
    where = collections.defaultdict(set)
    for b in _anchored(n, many):
        for data, found in zip(b.column("data").to_pylist(), b.column("found").to_pylist(), strict=True):
            for a in range(many):
                where[data[a : a + 200]].add((found[0]["key"], 3 + a))
    want = collections.defaultdict(list)
    for places in where.values():
        for key, at in places if len(places) > 1 else ():
            want[key].append((at, at + 200))
    sizes, real = [], substrings._marks_of_shard
    monkeypatch.setattr(substrings, "_marks_of_shard", lambda data, found, length: sizes.append(sum(map(len, data))) or real(data, found, length))
    got = collections.defaultdict(list)
    for b in substrings._marks(200, limit)(_anchored(n, many)):
        for key, low, high in zip(*(b.column(c).to_pylist() for c in ("key", "low", "high")), strict=True):
            got[key].append((low, high))
    assert {k: substrings.merge(v) for k, v in got.items()} == {k: substrings.merge(v) for k, v in want.items()}
    assert max(sizes) <= limit
    monkeypatch.setattr(substrings, "_marks_of_shard", lambda *a: iter(()))
    tracemalloc.start()
    for _ in substrings._marks(200, limit)(_anchored(10_000, 2)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000 * 201


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=1>The menu</a></nav><div class="ad">the of and to a in is</div><header>The site of the day</header>
<article><h1>A &eacute;t&#233; &amp; b</h1><p>The   text of\nthe <b>day</b>.</p><script>var x = "</p>";</script><p>Short.<br>Line</p><form>the of <input></form><div class="comments">the reader of it</div></article><aside>x</aside><footer>&copy; y</footer>"""


def test_html(spark):
    want = "A été & b\nThe text of the day.\nShort. Line"
    rows = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, "u", None, "c"), (3, "u", "", "c"), (4, "u", "<p", "c"), (5, "u", "<div" * 5000, "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(rows).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0)
    long = "The house of the man is on the way to the sea. " * 6
    assert html_text.extract(f"<div class=menu><a>Home</a></div><h2>Heading</h2><p>{long}</p><div><a href=1>more of the</a></div>") == "Heading\n" + long.strip()


def test_html_containers():
    long = "It is one of the places that a traveller to the north would like to see, and it is not far from the road. " * 3
    kept = ['style="overflow:hidden"', 'data-hidden="false"', 'title="hidden gems"', "title='the hidden sidebar'", 'class="content-sidebar-wrap"', 'class="layout has-sidebar"', 'class="section no-comments"', 'class="elementor-widget-wrap"', 'id="related-work"', 'id="social-impact"', 'data-x="a>b hidden"', "data-id=footer"]
    for a in kept:
        assert html_text.extract(f"<div {a}><p>{long}</p></div>") == long.strip(), a
        assert html_text.extract(f"<article><section {a}><p>{long}</p></section></article>") == long.strip(), a
    gone = ["hidden", 'HIDDEN=""', 'title="x"hidden', 'class="a sidebar"', 'class="site-footer"', 'id="comments"', 'class="comment-list"', 'class="related-posts"', 'class="cookie-banner"', "class=nav", 'id="site-header"', 'class="x" class="y" hidden', 'aria-hidden="true"', 'role="navigation"']
    for a in gone:
        assert html_text.extract(f"<div {a}><p>{long}</p></div>") == "", a
    # an article reopens what class alone has closed, but neither what is hidden nor a comment
    for a in ('class="sidebar"', 'id="site-header"'):
        assert html_text.extract(f"<div {a}><p>{long}</p><article><p>{long}</p></article></div>") == long.strip(), a
        assert html_text.extract(f"<div {a}><main><div class=x><p>{long}</p></div></main></div>") == long.strip(), a
    assert html_text.extract(f"<div hidden class=sidebar><article><p>{long}</p></article></div>") == ""
    assert html_text.extract(f"<nav><div class=sidebar><article><p>{long}</p></article></div></nav>") == ""
    assert html_text.extract(f"<div id=comments><article class=comment-body><p>{long}</p></article></div>") == ""
    assert html_text.extract(f"<article><p>The article. {long}</p><div id=comments><article><p>{long}</p></article></div></article>") == f"The article. {long.strip()}"


def _bag(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def _classes(texts):
    bags, parent = [_bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            o = sum((bags[a] & bags[b]).values())
            if o and o >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - o):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(len(texts))]


def _near_copies(n, edits):
    r = random.Random(9)
    out = []
    for _ in range(n):
        w = BASE.split(" ")
        for _ in range(r.choice(edits)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    texts = TEXTS + _near_copies(60, [1, 2, 3, 4]) + ["x y " * 50, "x y " * 46, "x y " * 30]
    got = dict(map(tuple, minhash.classes(frame(spark, texts)).collect()))
    assert [got[k] for k in range(len(texts))] == _classes(texts)
    assert minhash.classes(frame(spark, ["a"]).limit(0)).count() == 0
    kept = {r.doc_id for r in minhash.representatives(frame(spark, texts)).collect()}
    assert kept == set(_classes(texts))


def test_bag_signature():
    a, b = " ".join(["x", "y"] * 50 + [f"w{k}" for k in range(200)]), " ".join(["x", "y"] * 20 + [f"w{k}" for k in range(180)])
    sig, _ = minhash.signatures([a.encode(), b.encode()], 2048)
    o = sum((_bag(a) & _bag(b)).values()) / sum((_bag(a) | _bag(b)).values())
    assert abs((sig[0] == sig[1]).mean() - o) < 0.05


def test_sharding(spark):
    names, slots = [f"n{k}" for k in range(7)], 211
    table = sharding.fill(names, slots)
    assert max(collections.Counter(table).values()) - min(collections.Counter(table).values()) <= 1
    less = sharding.fill(names[:-1], slots)
    assert sum(a != b for a, b in zip(table, less, strict=True) if a != 6) < slots / 4
    rows = sharding.place(frame(spark, ["a", "b", "c"], ids=[1, None, 1]), "doc_id", names, slots).collect()
    assert len(rows) == 3 and all(table[r.slot] == r.shard for r in rows)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, slots)


def _ids(t):
    return np.array(tokens.Encoder(tokens.default_path()).tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")


ODD = ["  a", "a\n\nb", "a \n b ", "a\tb", "a b c", "<|endoftext|> x", "it's ..., ok", "\n", "a\r\nb", "é" * 50, "x  y", "1.5 -- (z)"]


def test_encoder():
    e = tokens.Encoder(tokens.default_path(), most=10, chunk=20)
    texts = [*TEXTS, *ODD, *ODD]
    assert list(e.encode_all(texts)) == [e.whole(t) if t else b"" for t in texts]


def test_frames():
    b = io.BytesIO()
    w = token_files.FrameWriter(b, frame_bytes=100)
    docs = [bytes([k]) * (k % 7 * 12) for k in range(90)]
    at = [w.add(x) for x in docs]
    w.close()
    r = token_files.FrameReader(b)
    assert len(r.table) > 3 and all(r.read(a, len(x)) == x for a, x in zip(at, docs, strict=True))
    data = bytearray(b.getvalue())
    data[-12] ^= 1  # the last frame's checksum
    with pytest.raises(ValueError):
        token_files.FrameReader(io.BytesIO(bytes(data))).frame(len(r.table) - 1)


def test_token_files(spark, tmp_path):
    texts = TEXTS + ODD
    index = token_files.write(frame(spark, texts), str(tmp_path / "t"))
    got = sorted(map(tuple, token_files.digest(index, str(tmp_path / "t")).collect()))
    want, start = [], 0
    for k, t in enumerate(texts):
        ids = _ids(t)
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_packing(spark):
    texts = TEXTS + ODD
    rows = packing.pack(packing.pieces(frame(spark, texts))).collect()
    by_doc = collections.defaultdict(dict)
    for r in rows:
        by_doc[r.doc_id][r.piece] = r
    for k, t in enumerate(texts):
        ids, at = _ids(t), 0
        for p in range(len(by_doc[k])):
            r = by_doc[k][p]
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (p == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == packing.lower_bound(np.array([r.length for r in rows]), 2048)
    assert packing.pack(packing.pieces(frame(spark, ["a"]).limit(0))).count() == 0


def test_lower_bound():
    assert packing.lower_bound(np.array([60] * 5), 100) == 5 and packing.lower_bound(np.array([34] * 6), 100) == 3
    r = random.Random(2)
    for _ in range(30):
        x = np.array([r.randrange(1, 101) for _ in range(40)])
        assert packing.lower_bound(x, 100) <= len(packing.best_fit(x, 100)[2])


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(40)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = collections.defaultdict(list)
    for x in topk.top_k(v, v.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    fine = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows if e and None not in e and e[0] == e[0]}
    want = {q: sorted(((i, int(fine[q] @ e)) for i, e in fine.items() if i != q and len(e) == len(fine[q])), key=lambda t: (-t[1], t[0]))[:5] for q in fine if q % 50 == 0}
    assert dict(got) == want
    few = v.where("id < 3")
    assert topk.top_k(few, few).count() == 6 and topk.top_k(few.limit(0), few.limit(0)).count() == 0


def _repeat_words(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)})


def test_quality(spark):
    texts = TEXTS + ["a b c d e f " * 4 + prose(7, 40), "### $$$ " * 20 + prose(8, 20), prose(6, 40).replace("w", "WORDS"), (prose(6, 12) + "\n") * 3, "a b c d e a b c d e"]
    d = frame(spark, texts).withColumn("t", F.coalesce("text", F.lit("")))
    got = {r.doc_id: (r.a, r.b) for r in d.select("doc_id", quality.n_repeat_words(quality.words(F.col("text"))).alias("a"), quality.n_words(F.col("text")).alias("b")).collect()}
    assert got == {k: (_repeat_words(t), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t in enumerate(texts)}
    kept = {r.doc_id for r in quality.keep(frame(spark, texts)).collect()}
    assert {5, 6, 7, 8, 10} <= kept and not kept & {0, 1, 2, 3, 4, 11, len(texts) - 3, len(texts) - 4, len(texts) - 2}
    assert quality.keep(frame(spark, ["a"]).limit(0)).count() == 0


def test_pii(spark):
    t = "mail a.b@c-d.org, ip 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 and 4111111111111112 phone +1 (555) 123-4567 x iban DE89370400440532013000 token = \"a1b2c3d4e5f6a7b8c9d0e1f2a3b4\" aé@b.co"
    kinds = [(k, t[a:b]) for k, a, b, _ in pii.find(t)]
    assert kinds == [("email", "a.b@c-d.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567"), ("iban", "DE89370400440532013000"), ("secret", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4")]
    assert pii.find(None) == [] and pii.luhn("4111111111111111") and not pii.mod97("DE88370400440532013000")
    assert [r.text for r in pii.redacted(frame(spark, ["x a@b.co y", None])).orderBy("doc_id").collect()] == ["x <EMAIL> y", None]


def test_pii_ibans_and_context():
    number, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for t, want in [(f"IBAN {spaced} BIC COBADEFFXXX", spaced), (f"IBAN: {number} BIC COBADEFF", number), (f"to {number} 100 EUR", number), (f"order {number}", number), (f"AB12 {spaced} X", spaced), ("GB82 WEST 1234 5698 7654 32 AND", "GB82 WEST 1234 5698 7654 32"), ("123-45-6789 (SSN)", "123-45-6789"), ("SSN 123-45-6789 order", "123-45-6789")]:
        assert [t[a:b] for _, a, b, _ in pii.find(t)] == [want], t
    for t in (f"{number}1", number[:-1] + "1", "123-45-6789", "order 123-45-6789 (SSN)", f"{number}_"):
        assert not [x for x in pii.find(t) if x[0] in ("iban", "ssn")], t
    t = f"{number} {spaced} {number}"
    assert [t[a:b] for _, a, b, _ in pii.find(t)] == [number, spaced, number]
    assert pii.redact(t, pii.find(t)) == "<IBAN> <IBAN> <IBAN>"


def test_mixing(spark):
    r = random.Random(4)
    sources = [r.choice(["a", "a", "a", "b", "c", "d", None]) for _ in range(200)]
    texts = [prose(k, r.choice([0, 5, 40, 900])) or None for k in range(200)]
    docs = frame(spark, texts, sources)
    rows = mixing.mix(docs, block=64).collect()
    size = [len((t or "").split()) for t in texts]
    total = collections.Counter()
    for s, n in zip(sources, size, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size)
    while True:
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if now[s] > 2 * total[s]]
        if not over:
            target |= now
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    taken = collections.Counter()
    for x in rows:
        assert x.size == size[x.doc_id] and x.source_size == total[x.source] and abs(x.target - target[x.source]) < 1e-6 and 0 <= x.first <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert len(rows) == 200 and all(taken[s] == int(target[s] + 1e-9) for s in names)
    made = mixing.mixed(docs, block=64)
    assert made.columns == docs.columns and made.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(mixing.mix(docs).agg(F.sum("taken")).first())
    assert mixing.mix(docs.limit(0)).count() == 0
    order = mixing.schedule(spark.createDataFrame([(0, 6400, 9600.0), (1, 6400, 3200.0)], "sid long, source_size long, target double"), 64).orderBy("slot").collect()
    assert abs(sum(x.sid == 0 for x in order[:40]) - 30) <= 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [prose(k, 80, 2000) for k in range(20, 50)]
    texts = [*good, good[0], good[1] + " w1", "too short", "### $$$ " * 30, "write to a.b@c.org now " + prose(77, 60, 2000), None]
    frame(spark, texts, [["a", "b", "c"][k % 3] for k in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, d)
        assert docs.columns == SCHEMA_NAMES
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    n = len(good)
    assert kept[0] == {*range(n + 2), n + 4} and kept[1] == kept[2] == {*range(n), n + 4}
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in pieces} == kept[3]
    words = docs.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(words - 1.5 * sum(len(t.split()) for t in [*good, texts[n + 4]])) < 30


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
