"""Knowledge base, resolvers, index and documents: fixtures whose results are known, and folds against plain Python."""

import collections
import random

import pytest

from glossa import queries
from glossa.operators import index, kb, match, resolve, search
from glossa.plans import query, rules
from glossa.plans.rules import Memory, RuleError
from glossa.shared import folder, root
from glossa.sources import documents
from glossa.sources.config import Traits
from glossa.streaming.put import put

ONE = frozenset
FIXTURE = [
    ("A", "p", "B"), ("B", "p", "C"), ("X", "i", "X"), ("A", "n", "(name)"), ("A", "d", "distinct"), ("A", "d", "a{b,c}d"), ("A", "a", "ambiguous"), ("AS", "s", "BS"), ("AT", "t", "BT"), ("BT", "t", "CT"), ("AV", "v", "BV"),
    ("A", "d", "split-name"), ("B", "d", "split-name"), ("R", "r", "rule"), *((f"http://example.org/{x}", "d", "second-split-name") for x in "ABC"),
]
TRAITS = Traits(ONE("i"), ONE("t"), ONE("s"), ONE("v"), ONE("n"), ONE("dn"), ONE("a"), ONE("r"))


def base(spark, how="split", rows=FIXTURE):
    return kb.build(spark.createDataFrame([(*t, k) for k, t in enumerate(rows)], "s string, p string, o string, ord long"), TRAITS, how)


def test_fixture(spark):
    k = base(spark)
    assert {r.label for r in k.dictionary.collect()} == {"name", "distinct", "ambiguous", "abd", "acd", "split name", "second split name"}
    edges = {(r.s, r.p, r.o) for r in k.edge.where(k.edge.p != kb.SPLIT).collect()}
    assert edges == {("A", "p", "B"), ("B", "p", "C"), ("AS", "s", "BS"), ("BS", "s", "AS"), ("AT", "t", "BT"), ("AT", "t", "CT"), ("BT", "t", "CT"), ("BV", "v", "AV")}
    names = {r.url: r.name for r in k.concept.where("name is not null").collect()}
    assert names == {"A": "(name)", "A-B": "split name", "http://example.org/A-B-C": "second split name"}
    assert {r.url for r in kb.ambiguous(k.edge).collect()} == {"A-B", "http://example.org/A-B-C"}
    assert not {"X", "Y", "Z"} & {r.url for r in k.concept.collect()} and {(r.url, r.expr) for r in k.rules.collect()} == {("R", "rule")}
    assert kb.links(k.edge, "A", "B", "p").count() == 1 and kb.links(k.edge, "A", "B", "q").count() == 0 and kb.links(k.edge, "B", "A").count() == 0


@pytest.mark.parametrize("urls,merged", [("A1,A2", ["PA-a"]), ("B1,B2", ["PA-a", "PB-b"]), ("A1,B1,C1", ["PA-a"]), ("A1,C2", [])])
def test_merged_edges(spark, urls, merged):
    rows = [("A1", "PA", "a"), ("A2", "PA", "a"), *((x, p, p[1].lower()) for x in ("B1", "B2") for p in ("PA", "PB")), ("C1", "PA", "a"), ("C2", "PB", "b")]
    edge = spark.createDataFrame(rows, "s string, p string, o string")
    clash = spark.createDataFrame([("x", sorted(urls.split(",")))], "label string, urls array<string>")
    found, edges = kb.merge(clash, edge)
    assert found.first().url == urls.replace(",", "-") and sorted(f"{r.p}-{r.o}" for r in edges.collect()) == merged
    n = {"A1,C2": 0}.get(urls, 1)
    assert kb.threshold(clash, edge, 1.0)[1].where(f"p <> '{kb.SPLIT}'").count() == n * len(merged)


def test_ways_with_ambiguity(spark):
    with pytest.raises(ValueError, match="several concepts"):
        base(spark, "FAIL")
    assert base(spark, "Discard").dictionary.where("label = 'split name'").count() == 0
    with pytest.raises(ValueError):
        base(spark, "1.5")
    assert base(spark, "0.5").dictionary.where("label = 'split name'").count() == 1


def test_reduction_with_a_self_loop(spark):
    e = lambda rows: spark.createDataFrame([(a, "p", b) for a, b in rows], "s string, p string, o string")
    got = lambda rows: sorted(r.s + r.o for r in kb.reduce_transitive(e(rows)).collect())
    assert got(["ab", "bc", "ac"]) == ["ab", "bc"] and got(["ab", "bb"]) == ["ab", "bb"]


def test_saved_and_cached(spark, tmp_path):
    k = base(spark)
    kb.save(k, str(tmp_path / "kb"))
    again = kb.load(spark, str(tmp_path / "kb"))
    for part in kb.PARTS:
        assert sorted(map(tuple, getattr(k, part).collect()), key=repr) == sorted(map(tuple, getattr(again, part).collect()), key=repr)


def test_labels_are_broken_in_the_middle(spark):
    names = ["short name", "a longer name of it", "nospacesinthisname", "ééééé ééé éé", "one twothreefourfive", ""]
    want = ["short name", "a longer\\nname of it".replace("\\n", "\n"), "nospacesinthisname", "ééééé ééé\néé", "one twothreefourfive", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")

    def plain(x):
        b = x.encode()
        at = b.find(b" ", len(b) // 2) if len(b) > 10 else -1
        return x if at < 0 else (b[:at] + b"\n" + b[at + 1 :]).decode()

    got = [r[0] for r in df.select(kb.wrapped(df.n)).collect()]
    assert got == [plain(n) for n in names] and got[0] == want[0] and got[2] == want[2]


def test_graph(spark):
    lines = kb.graph_lines(queries.word_kb(spark, "discard"), queries.THE)
    text = kb.dot(lines, "the", rankdir="BT")
    assert text.startswith('digraph "the" {\nrankdir="BT"\n') and text.endswith("}") and f'"{queries.THE}" [label="the" shape="box" style="filled"]' in text


# thematic: of the memory's concepts and their targets
@pytest.mark.parametrize("held,threshold,out", [([("A1", ("t1", "t2"))], 0.5, "X"), ([("A1", ("t1", "t2"))], 0.7, None), ([("q", ())], 0.5, "Y"), ([("q", ("t1", "t2"))], 0.3, "X"), ([], 0.5, None)])
def test_thematic_counts_targets(held, threshold, out):
    assert resolve.thematic({"X": ("t1", "t2"), "Y": ("q",)}, threshold)(Memory(3, held), ["X", "Y"]) == out


def _chain(tokens, near, order):
    """The chain of resolvers, plainly."""
    for kind, size in reversed(order):
        memory, out = [], []
        for cands, sure in tokens:
            url = cands[0] if sure else None
            if not sure:
                every = [x for u in memory for x in (u, *near.get(u, ()))]
                if kind == "simple":
                    score = {u: every.count(u) for u in cands}
                else:
                    score = {u: len(set(every) & set(near.get(u, ()))) / len(set(every)) if every else 0 for u in cands}
                    score = {u: s if s > 0.4 else 0 for u, s in score.items()}
                best = [u for u, s in score.items() if s == max(score.values())]
                url = best[0] if len(best) == 1 else None
            if url:
                memory = [*memory, url][-size:]
            out.append(([url], True) if url else (cands, sure))
        tokens = out
    return [c[0] if s else None for c, s in tokens]


@pytest.mark.parametrize("order", [[("simple", 3)], [("thematic", 2)], [("simple", 2), ("thematic", 4)], [("thematic", 1), ("simple", 5)]])
def test_chains(spark, order):
    r = random.Random(str(order))
    near = {u: tuple(r.sample("pqrs", r.randrange(3))) for u in "ABCD"}
    k = kb.Kb(None, spark.createDataFrame([(s, "e", o) for s, ts in near.items() for o in ts], "s string, p string, o string"), None, spark.createDataFrame([], "url string, expr string"))
    docs = {d: [(sorted(r.sample("ABCD", n)), n == 1 and r.random() < 0.8) for n in r.choices([1, 1, 2, 3], k=20)] for d in range(6)}
    rows = [(d, at * 10, url, sure) for d, ts in docs.items() for at, (urls, sure) in enumerate(ts) for url in urls]
    r.shuffle(rows)
    got = resolve.chain(spark.createDataFrame(rows, "doc long, begin long, url string, sure boolean"), k, [resolve.Step(n, size, 0.4) for n, size in order])
    found = collections.defaultdict(list)
    for x in got.orderBy("doc", "begin").collect():
        found[x.doc].append(x.url)
    assert dict(found) == {d: _chain(ts, near, order) for d, ts in docs.items()}
    with pytest.raises(ValueError):
        resolve.steps(["simple", "best"])


_made = {}


def small(spark):
    """small_kb(), once."""
    return _made.get("small") or _made.setdefault("small", small_kb(spark))


def small_kb(spark):
    """Labels: cat (A), bat (B), the bat (B), dog (A or B, split), hen (C, marked ambiguous); edges A-p-T, B-p-U; a rule for A."""
    rows = [("A", "p", "T"), ("B", "p", "U"), ("C", "p", "V"), ("A", "d", "cat"), ("B", "d", "bat"), ("B", "d", "the bat"), ("A", "d", "dog"), ("B", "d", "dog"), ("C", "a", "hen"), ("A", "r", 'c("cat") > 0'), ("B", "r", 'c("bat") > 0')]
    return base(spark, "split", rows)


def _direct(df):
    return sorted((r.concept_url, r.relation_url, r.begin, r.l) for r in df.collect())


def test_postings_of_documents_that_share_a_path(spark):
    k = small(spark)
    docs = documents.strings(spark, {}).unionByName(spark.createDataFrame([("same", "cat dog"), ("same", "bat dog"), ("same", None)], documents.DOCUMENT))
    plain = index.entries(docs, k)
    assert _direct(plain.where("relation_url = ''")) == [("A", "", 1, 0), ("A", "", 5, -1), ("A", "", 5, -1), ("B", "", 1, 0), ("B", "", 5, -1), ("B", "", 5, -1)]
    got = index.entries(docs, k, resolvers=resolve.steps(["ruled"]))
    assert _direct(got) == [("A", "", 1, 0), ("A", "", 5, 0), ("B", "", 1, 0), ("B", "", 5, 0), ("T", "p", 1, 0), ("T", "p", 5, 0), ("U", "p", 1, 0), ("U", "p", 5, 0)]
    assert index.entries(docs.limit(0), k, resolvers=resolve.steps(["simple"])).count() == 0
    # each span has its own text around it
    near = match.match(docs, k.dictionary, context=4).where("token = 'dog'").collect()
    assert sorted((bytes(r.before), bytes(r.after)) for r in near) == [(b"bat ", b" "), (b"cat ", b" ")]
    parts = match.match(docs, k.dictionary, most=1, context=4)
    assert sorted(map(str, parts.drop("doc").collect())) == sorted(map(str, match.match(docs, k.dictionary, context=4).drop("doc").collect()))


def test_single_ambiguous_label(spark):
    k = small(spark)
    docs = documents.strings(spark, {"d": "hen"})
    assert _direct(index.entries(docs, k)) == [("C", "", 1, -1), ("V", "p", 1, -1)]
    assert _direct(index.entries(docs, k, resolvers=resolve.steps(["simple"]))) == [("C", "", 1, 0), ("V", "p", 1, 0)]


def test_nested_ambiguity(spark):
    """A split concept among the candidates of a fuzzy match is posted itself, its parts by their split edges; a resolver chooses among the parts."""
    k = small(spark)
    docs = documents.strings(spark, {"d": "the bat dogs"})
    got = _direct(index.entries(docs, k, (1,)).where("begin > 1"))
    assert got == [("A", kb.SPLIT, 9, 1), ("A-B", "", 9, 1), ("B", kb.SPLIT, 9, 1)]
    assert _direct(index.entries(docs, k, (1,), resolve.steps(["simple"])).where("begin > 1")) == [("B", "", 9, 0), ("U", "p", 9, 0)]


def test_names_in_rules(spark):
    k = small(spark)
    assert search.compiled_rules(k)["A"](Memory(2, [("A", ())])) == 1.0
    assert rules.names('c("x") + len({"y", "z"}) * len("no")') == ["x", "y", "z"]
    bad = kb.Kb(k.concept, k.edge, k.dictionary, spark.createDataFrame([("A", 'c("unknown") > 0')], "url string, expr string"))
    for f in (lambda: search.compiled_rules(bad), lambda: index.entries(documents.strings(spark, {"d": "cat"}), bad, resolvers=resolve.steps(["ruled"]))):
        with pytest.raises(RuleError, match="unknown"):
            f()


@pytest.mark.parametrize(
    "rule,code",
    [
        ("-2", "PUSH 2.00;NEG;"), ("-true*false", "PUSH true;NOT;PUSH false;AND;"), ("false+true", "PUSH false;PUSH true;OR;"), ("8<3*3", "PUSH 8.00;PUSH 3.00;PUSH 3.00;MUL;LT;"), ("8=3/1", "PUSH 8.00;PUSH 3.00;PUSH 1.00;DIV;EQ;"),
        ("min(1)", "PUSH 1.00;PUSH 1;MIN;"), ("max({})", "PUSH 0;MAX;"), ("min(1+2,3-4)", "PUSH 1.00;PUSH 2.00;ADD;PUSH 3.00;PUSH 4.00;SUB;PUSH 2;MIN;"), ("n()<len()", "MN;MLEN;LT;"), ('{"a"}={"b"}', "PUSH 1;PUSH 1;PUSH 2;PUSH 1;SEQ;"),
        ('log(len({"c"}))', "PUSH 3;PUSH 1;LEN;LOG;"), ("pow(1,2)", "PUSH 1.00;PUSH 2.00;POW;"), ('min({"a","b","c"})', "PUSH 1;PUSH 2;PUSH 3;PUSH 3;MIN;"), ('{"a"}+es()', "PUSH 1;PUSH 1;ES;SU;"), ('e()-{"a"}', "E;PUSH 1;PUSH 1;SSUB;"),
        ('c("a")+cs("b")', "PUSH 1;SC;PUSH 2;SCS;ADD;"), ('c({"a","b"})', "PUSH 1;PUSH 2;PUSH 2;C;"),
    ],
)
def test_disassembly(rule, code):
    assert rules.disassembled(rule, lambda url: "abc".index(url) + 1) == code


def test_queries_by_name(spark):
    k = small(spark)
    assert search.urls_of(k, ["dog", "the bat", "A", "nothing"]) == {"dog": ["A", "B"], "the bat": ["B"], "A": ["A"]}
    assert str(query.compiled('?("dog")', k)) == "?(A,B)" and str(query.compiled('?("dog")', k, strict=True)) == "?(dog)"
    with pytest.raises(query.QueryError):
        query.compiled('?("nothing at all")', k)
    e = index.entries(documents.strings(spark, {"d": "cat dog bat"}), k)
    assert query.get(e, k, '?("dog")').count() == 4 and query.get(e, k, '?("dog")', most=1, skip=1).first().begin == 5
    assert query.written("a, b", "p,!q") == '?("p",!"q"("a","b"))' and query.written("*x", "*", True) == '?*(*("*x"))'
    assert collections.Counter(r.q for r in search.lookup(k, ["A", "cat", "at", "zzz"]).collect()) == {"A": 1, "cat": 1, "at": 2}
    assert [len(f(k, q, n).collect()) for f, q, n in ((search.concepts, "at", 1), (search.parents, "T", 1), (search.predicates, "p", 1), (search.concepts, "at", 0))] == [1, 1, 1, 0]
    numbers = index.register(k.concept.select("url"))
    number = numbers.where("url = 'B'").first().id
    assert search.find(k, number=number, numbers=numbers).first().url == search.find(k, number=-number, numbers=numbers).first().url == search.find(k, "B", 999, numbers).first().url == "B"


def test_index_is_read_by_concept(spark, tmp_path):
    """A query over a stored index hands its concepts to the scan, and files without them are not opened."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index.write(queries.entries(spark, "/root/testdata/sf0.001"), str(tmp_path / "i"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    got = query.parse(f'?("{queries.THE}")').run(index.read(spark, str(tmp_path / "i")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(concept_url," in pushed or "In(concept_url," in pushed
    assert got.count() > 0 and len({r[0] for r in got.select("_metadata.file_name").collect()}) < len(list((tmp_path / "i").glob("*.parquet")))


def test_registers(spark):
    urls = lambda xs: spark.createDataFrame([(x,) for x in xs], "url string")
    first = index.register(urls(["b", "a", "b", None]))
    assert {r.url: r.id for r in first.collect()} == {"a": 1, "b": 2}
    more = index.register(urls(["0", "b", "z"]), first)
    assert {r.url: r.id for r in more.collect()} == {"a": 1, "b": 2, "0": 3, "z": 4}
    assert index.register(urls([]).limit(0)).count() == 0


def test_stream_with_resolvers(spark, tmp_path):
    documents.strings(spark, {"d": "cat dog bat"}).write.parquet(str(tmp_path / "in"))
    put(spark.readStream.schema(documents.DOCUMENT).parquet(str(tmp_path / "in")), small(spark), str(tmp_path / "i"), str(tmp_path / "c"), (), resolve.steps(["ruled"])).awaitTermination()
    assert _direct(index.read(spark, str(tmp_path / "i"))) == _direct(index.entries(documents.strings(spark, {"d": "cat dog bat"}), small(spark), (), resolve.steps(["ruled"])))


def test_documents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("one <b>two</b>")
    (tmp_path / "a" / "b" / "y.txt").write_text("<r>three\n</r>")
    plain, xml = documents.files(spark, str(tmp_path / "a")), documents.files(spark, str(tmp_path / "a"), documents.XML)
    assert sorted(r.text for r in plain.collect()) == ["<r>three\n</r>", "one <b>two</b>"] and sorted(r.text for r in xml.collect()) == ["one two ", "three "]
    with pytest.raises(ValueError):
        documents.files(spark, str(tmp_path / "a"), "image/png")
    rows = spark.createDataFrame([("p", "<b>x</b>", "text/plain"), ("q", "<b>x</b>", "text/html"), ("n", None, "text/html")], "path string, text string, sort string")
    assert {r.path: r.text for r in documents.typed(rows, "sort").collect()} == {"p": "<b>x</b>", "q": "x ", "n": None}
    with pytest.raises(Exception, match="unknown content type"):
        documents.typed(rows.selectExpr("path", "text", "'ALTO' AS sort"), "sort").collect()
    pages = spark.createDataFrame([("u", "<p>x</p>", "text/html; charset=utf-8"), ("v", "<p>x</p>", "text/plain"), ("w", "<p>x</p>", None)], "url string, html string, sort string")
    assert {r.path: r.text for r in documents.fetched(pages, pages["sort"]).collect()} == {"u": " x", "v": "<p>x</p>", "w": "<p>x</p>"}
    given = documents.store(spark, str(tmp_path / "store"), "My  Doc/1", "the text")
    path = given.first().path
    assert path.startswith("stored-my-doc-1-") and path.endswith("-text-plain") and documents.stored(spark, str(tmp_path / "store"), path).first().text == "the text"
    with pytest.raises(ValueError):
        documents.store(spark, str(tmp_path / "store"), "x", "y", "text/html")


def test_context_of_a_place(spark):
    docs = documents.strings(spark, {"d": "one two, three"})
    got = search.in_context(docs, 5, 8, 4).first()
    assert tuple(got) == ("d", "one ", "two", " thr")
    for a, b in ((5, 15), (-1, 2), (3, 2)):
        with pytest.raises(Exception, match="no place"):
            search.in_context(docs, a, b, 4).collect()


def test_patterns(spark):
    docs = documents.strings(spark, {"d": "é 12, 345 x", "e": ""})
    assert sorted(map(tuple, match.match_pattern(docs, "[0-9]+|x*", "N").collect())) == [("d", 4, 6, "12", "N"), ("d", 7, 10, "345", "N"), ("d", 11, 12, "x", "N")]


def test_shared_folder(spark):
    assert folder(spark, "x").startswith(root(spark))

    class Cluster:
        class sparkContext:
            master = "yarn"
            getConf = staticmethod(dict)

        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        root(Cluster)
