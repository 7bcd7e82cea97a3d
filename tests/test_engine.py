"""The engine, its server and client, and the command line, on a small knowledge base."""

import json
import threading

import pytest

from glossa import __main__ as command
from glossa.engine import Engine, NotFound, pretty_concept, pretty_entry, pretty_info
from glossa.operators.resolve import steps
from glossa.plans.rules import RuleError
from glossa.server import Client, serve

TURTLE = """@prefix x: <http://x/> .
x:cat x:lives x:house ; x:label "cat" ; x:name "Cat" .
x:bat x:lives x:cave ; x:label "bat" .
x:cat x:label "pet" . x:bat x:label "pet" .
"""
CONFIG = '[file]\npath = "{0}/kb.ttl"\ntype = "Turtle"\nambigs = "split"\ncache = "{0}/cache"\n[predicates]\ndistinct = ["http://x/label"]\nname = ["http://x/name"]\nrules = ["http://x/rule"]\n'


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    (base / "kb.ttl").write_text(TURTLE)
    (base / "kb.toml").write_text(CONFIG.format(base))
    (base / "in" / "deep").mkdir(parents=True)
    (base / "in" / "a.txt").write_text("The cat, a pet!")
    (base / "in" / "deep" / "b.txt").write_text("bat")
    e = Engine(spark, str(base / "kb.toml"), str(base / "data"))
    e.base = base
    return e


def test_engine(engine, spark):
    assert (engine.base / "cache" / "edge").is_dir()
    again = Engine(spark, engine.config, engine.folder)  # from the cache
    assert sorted(map(tuple, again.kb.edge.collect())) == sorted(map(tuple, engine.kb.edge.collect()))
    assert engine.get('?("cat")') == [] and engine._stored("x").count() == 0
    cat = engine.concept("http://x/cat")
    assert cat["Name"] == "Cat" and cat["Edges"] == [{"P": {"URL": "http://x/lives", "Name": ""}, "O": {"URL": "http://x/house", "Name": ""}, "L": 0}] and not cat["Ambiguous"]
    assert engine.concept(number=cat["ID"]) == cat
    with pytest.raises(NotFound):
        engine.concept("http://x/dog")
    assert [c["URL"] for c in engine.search("bat")] == ["http://x/bat"] and engine.parents("http://x/dog") == []
    assert [c["URL"] for c in engine.predicates("lives")] == ["http://x/bat", "http://x/cat"] and [c["URL"] for c in engine.parents("http://x/cave")] == ["http://x/bat"]
    info = engine.info("http://x/cat")
    assert info["Entries"] == ["cat"] and info["Predicates"] == {"http://x/lives": ["http://x/house"]}
    assert pretty_info(info) == f'{cat["ID"]} http://x/cat "Cat"\nlabel "cat"\nhttp://x/lives http://x/house' and pretty_concept(cat) in pretty_info(info)
    assert '"http://x/cat" -> "http://x/house" [label="lives"]' in engine.graph("http://x/cat")
    tokens = engine.put_files(str(engine.base / "in"), resolvers=steps(["simple"]))
    assert [(t["token"], t["concept_url"], t["begin"]) for t in tokens] == [("cat", "http://x/cat", 5), ("pet", "http://x/cat", 11), ("bat", "http://x/bat", 1)]
    found = engine.get('?("cat")')
    assert [(e["begin"], e["l"]) for e in sorted(found, key=lambda e: e["begin"])] == [(5, 0), (11, 0)] and "http://x/cat" in pretty_entry(found[0])
    assert len(engine.get('?(*("http://x/house"))', most=1, skip=1)) == 1
    kept = engine.put_text("My doc", "one bat")
    path = kept[0]["path"]
    assert engine.dump(path)["Content"] == "one bat" and engine.context(path, 5, 8, 4)["Before"] == "one " and engine.context(str(engine.base / "in" / "a.txt"), 5, 8, 4)["Match"] == "cat"
    for f in (lambda: engine.dump("no"), lambda: engine.context("/no/such/file", 0, 1, 1)):
        with pytest.raises(NotFound):
            f()
    engine.flush()
    (engine.base / "bad.ttl").write_text(TURTLE + 'x:cat x:rule "c(1)" .')
    (engine.base / "bad.toml").write_text(CONFIG.format(engine.base).replace("kb.ttl", "bad.ttl"))
    with pytest.raises(RuleError):
        Engine(spark, str(engine.base / "bad.toml"), engine.folder, use_cache=False)


def test_server(engine):
    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = Client(f"http://127.0.0.1:{server.server_port}", [1], [{"Name": "simple", "MemorySize": 3}])
        assert client.ask("concept", url="http://x/bat")["URL"] == "http://x/bat" and client.ask("flush") == {}
        put = client.put("given", "the batt and a pet")
        assert {t["concept_url"] for t in put} >= {"http://x/bat"}
        assert client.ask("dump", url=put[0]["path"])["Content"] == "the batt and a pet" and client.ask("ctx", url=put[0]["path"], b=1, e=4, n=2)["Match"] == "the"
        with pytest.raises(NotFound):
            client.ask("concept", url="http://x/none")
        with pytest.raises(NotFound):
            client.ask("nothing")
        for bad in (lambda: client.ask("search"), lambda: client.ask("put"), lambda: client.put(""), lambda: client.ask("get", q="?("), lambda: client.ask("ctx", url=put[0]["path"], b=1, e=400), lambda: client.put("x", "y", "text/html")):
            with pytest.raises(ValueError):
                bad()
    finally:
        server.shutdown()


def test_command_line(engine, capsys):
    run = lambda *words: command.run(engine, command.arguments().parse_args(words))
    found, lines = run("put", "-r", "simple", "-m", "3", str(engine.base / "in" / "deep"))
    assert [e["concept_url"] for e in found] == ["http://x/bat"] and found[0]["path"].startswith("stored-") and len(lines) == 1
    assert run("search", "-p", "lives")[1] and run("get", '?("bat")', "-n", "1")[0][0]["concept_url"] == "http://x/bat"
    assert run("context", found[0]["path"], "1", "4", "1")[1] == [" [bat] "]
    assert command.main(["version"]) == 0 and capsys.readouterr().out.strip() == command.VERSION
    assert command.main(["search", "x"]) == 2 and json.dumps(found)
