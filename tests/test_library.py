"""Golden cases of the library's operators, and registered queries against their SQL on the smallest tables."""

import glob
import math
import os
import random

import duckdb
import pytest

from glossa import queries
from glossa.functions.text import combine_urls, expand_braces
from glossa.operators import match, resolve
from glossa.plans import query
from glossa.plans.rules import Memory, RuleError, compile_rule
from glossa.sources import markup, rdfxml, turtle
from glossa.sources.config import read_config, triples

SF = "/root/testdata/sf0.001"
LABELS = ["match", "match bbb", "mitch match", "hot hot", "hit hit"]


@pytest.mark.parametrize("label,out", [("a{,b}c", ["ac", "abc"]), ("a{b{c,d},e}{f,g}", ["abcf", "abcg", "abdf", "abdg", "aef", "aeg"]), (r"a{b\,\\,c}", ["ab,\\", "ac"]), (r"\{a\,b\}", ["{a,b}"]), ("", [""])])
def test_braces(label, out):
    assert expand_braces(label) == out


@pytest.mark.parametrize("label", ["a{b,}}", "a{{b,}"])
def test_unbalanced_braces(label):
    with pytest.raises(ValueError):
        expand_braces(label)


def test_combined_urls():
    assert combine_urls(["http://a/b/x", "http://a/c/y", "http://a/d/z w"]) == "http://a/b/x-y-z%20w"


@pytest.mark.parametrize("text,out", [("A B C; D E.", [("A", "B", "C"), ("A", "D", "E")]), ("A B C, D.", [("A", "B", "C"), ("A", "B", "D")]), ("PREFIX x: abc x:A x:B x:C.", [("abcA", "abcB", "abcC")]), ("@base <xyz>. A B C.", [("xyzA", "xyzB", "xyzC")]), ("A a B.", [("A", turtle.RDF_TYPE, "B")])])
def test_turtle(text, out):
    assert list(turtle.parse(text)) == out


@pytest.mark.parametrize("text", ["#comment", "A B .", "p:A B C.", "BASE <xyz> . A B C."])
def test_turtle_errors(text):
    with pytest.raises(ValueError):
        list(turtle.parse(text))


def test_rdfxml():
    assert list(rdfxml.parse(queries.RDFXML)) == queries.RDFXML_ROWS


def test_config_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("KB", str(tmp_path))
    (tmp_path / "kb.ttl").write_text("A a B. A p C.")
    (tmp_path / "c.toml").write_text('[file]\npath = "$KB/kb.ttl"\ntype = "Turtle"\n[predicates]\ntransitive = ["p"]\nrules = ["r"]\n')
    c = read_config(str(tmp_path / "c.toml"))
    assert c.traits.transitive == {"p"} and c.traits.rule == {"r"} and c.ambigs == "split"
    assert [(r.s, r.p, r.o) for r in triples(spark, c.path, c.type).orderBy("ord").collect()] == [("A", turtle.RDF_TYPE, "B"), ("A", "p", "C")]


def test_markup():
    page = "<html><head><title>t</title></head><body><p> one </p><div>two</div><li>three</li></body></html>"
    assert markup.element_text(page) == "  one  three"
    assert markup.node_text(page) == "one two three "
    assert markup.node_text(None) == ""


@pytest.mark.parametrize(
    "text,k,out",
    [
        (" nothing to find ", 0, []), (" here is the match ", 0, [(13, 18, "match")]), (" mitch mitch match ", 0, [(7, 18, "mitch match")]), (" match ", 3, [(1, 6, [("match", 0)])]),
        (" mxtch ", 3, [(1, 6, [("match", 1)])]), (" mxtch bbb ", 3, [(1, 10, [("match bbb", 1)])]), (" mxtch bbxxx ", 3, [(1, 6, [("match", 1)])]), (" mxtch mxtch ", 3, [(1, 12, [("mitch match", 2)])]),
        (" hxt hot ", 3, [(1, 8, [("hit hit", 2), ("hot hot", 1)])]), ("  ", 0, []),
    ],
)
def test_match(text, k, out):
    words = match._words(text)
    taken = match._chain(words, [match.Fuzzy(LABELS, k)] if k else [match.Exact(LABELS)])
    rows = match._rows("p", text, words, taken, False)
    assert [(r["begin"], r["end"], c if k else c[0][0]) for r, (_, _, c) in zip(rows, taken, strict=True)] == out


@pytest.mark.parametrize("errors", [(), (1,), (3, 1)])
@pytest.mark.parametrize("gaps", [False, True])
def test_match_in_parts(spark, errors, gaps):
    """A dictionary over the bound gives what one under it gives; texts that share a path, empty and null texts and null labels are among them."""
    rng = random.Random(len(errors))
    words = ["mitch", "mxtch", "match", "bbb", "hot", "hxt", "hit", "caf\u00e9", "of"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(40)]
    docs = spark.createDataFrame([("same", t) for t in texts] + [(f"p{i}", t) for i, t in enumerate([*texts[:5], "", None, "!?"])] + [(None, "match")], "path string, text string")
    labels = spark.createDataFrame([(x,) for x in [*LABELS, *LABELS, "caf\u00e9 of", "of", "of match", "bbb of match", None]], "label string")
    rows = lambda most: sorted(match.match(docs, labels, errors, gaps, most).collect(), key=str)
    few, many = rows(100), rows(2)
    assert few and many == few


def test_match_without_documents(spark):
    docs, labels = spark.createDataFrame([], "path string, text string"), spark.createDataFrame([(x,) for x in LABELS], "label string")
    assert match.match(docs, labels, (1,), True).count() == match.match(docs, labels, (1,), True, 2).count() == 0


@pytest.mark.parametrize("text,out", [("?10*(*(C, D))", "?*10(*(C,D))"), ('?("A B"("C D","E F"))', "?(A B(C D,E F))"), ("?(!S(A))", "?(!S(A))"), ("?(A)", "?(A)")])
def test_query_text(text, out):
    assert str(query.parse(text)) == out


@pytest.mark.parametrize("text", ["", "?(", "?(!*({C, D}))", "?{}({})", "?(A,B}(C,D))", "?(A) more", "?x(A)"])
def test_query_errors(text):
    with pytest.raises(query.QueryError):
        query.parse(text)


@pytest.mark.parametrize("text,l,amb,n", [("?(A)", 0, False, 1), ("?(S(A))", 0, False, 2), ("?(!S(A))", 0, False, 2), ("?(*(A,B))", 0, False, 6), ("?1(R,S(A,B))", 2, False, 0), ("?2(R,S(A,B))", 2, False, 6), ("?(R(A))", 0, True, 0), ("?*(R(A))", 0, True, 2)])
def test_query_rows(spark, text, l, amb, n):  # noqa: E741
    rows = [(c, r, l, amb) for c in "AB" for r in ("", "R", "S")]
    e = spark.createDataFrame(rows, "concept_url string, relation_url string, l long, ambiguous boolean")
    assert query.parse(text).run(e).count() == n


def _memory():
    return Memory(5, [("a", ()), ("b", ()), ("a", ())])


@pytest.mark.parametrize("rule,value", list(zip(queries.RULES, queries.RULE_VALUES, strict=True)))
def test_rules(rule, value):
    assert max(-9e99, min(9e99, compile_rule(rule)(_memory()))) == value


@pytest.mark.parametrize("rule", ["-{}", '"x"', "1 = true", "!true", 'foo("a")', "1 +", "(1", '"a" + "b"', "1 2"])
def test_rule_errors(rule):
    with pytest.raises(RuleError):
        compile_rule(rule)


def test_rule_numbers():
    assert compile_rule("log(0)")(_memory()) == -math.inf and math.isnan(compile_rule("0 / 0")(_memory()))
    with pytest.raises(ValueError):
        Memory(0, [])


@pytest.mark.parametrize("held,out", [([], None), (["A"], "A"), (["A", "B"], None), (["A", "B", "B"], "B")])
def test_simple(held, out):
    assert resolve.simple({})(Memory(3, [(u, ()) for u in held]), ["A", "B"]) == out


@pytest.mark.parametrize("held,out", [([], None), ("p", "A"), ("pA", None), ("pAq", None), ("Aqq", None), ("qqq", "B")])
def test_thematic(held, out):
    assert resolve.thematic({"A": ("p",), "B": ("q",)}, 0.5)(Memory(3, [(u, ()) for u in held]), ["A", "B"]) == out


def test_resolve_feeds_back(spark):
    rows = spark.createDataFrame([("d", 1, ["A"]), ("d", 2, ["A", "B"]), ("d", 3, ["B"])], "path string, begin long, urls array<string>")
    assert [r.url for r in resolve.resolve(rows, lambda: resolve.simple({})).orderBy("begin").collect()] == ["A", "A", "B"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted((tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == rows


def test_entry(spark):
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
