"""Registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalise, pack_relation, unpack_relation
from .operators import index, kb, match, resolve, search
from .plans import query as query_language
from .plans.rules import Memory, compile_rule
from .shared import folder, write_text, written
from .sources import turtle
from .sources.config import Traits, read_config
from .sources.config import triples as read_triples
from .sources.markup import element_text, node_text
from .streaming.put import put

NS = "http://kb.test/"
#: Labels of the test knowledge base: frequent words of four languages.
WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "of the", "in the"],
    "de": ["der", "die", "und", "den", "von", "in"],
    "fr": ["de", "la", "en", "que", "de la"],
    "es": ["de", "la", "en", "que", "de la"],
}
FAMILY = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}
TRAITS = Traits(**{k: frozenset({NS + v}) for k, v in {"transitive": "broader", "symmetric": "see-also", "inverted": "part-of", "distinct": "label", "name": "name", "ignore": "note", "rule": "rule"}.items()})


def _url(lang: str, word: str) -> str:
    return f"{NS}word/{lang}/{word.replace(' ', '_')}"


def _triples() -> list[tuple[str, str, str]]:
    out = []
    for lang, words in WORDS.items():
        for w in words:
            out += [(_url(lang, w), NS + "lang-of", f"{NS}lang/{lang}"), (_url(lang, w), NS + "label", w)]
        out += [(f"{NS}lang/{lang}", NS + "broader", f"{NS}family/{FAMILY[lang]}"), (f"{NS}lang/{lang}", NS + "name", lang.upper()), (f"{NS}lang/{lang}", NS + "note", "ignored")]
    for f in ("germanic", "romance"):
        out += [(f"{NS}family/{f}", NS + "broader", NS + "top"), (f"{NS}family/{f}", NS + "part-of", NS + "tree")]
    return [*out, (NS + "lang/en", NS + "see-also", NS + "lang/de"), (NS + "lang/en", NS + "rule", f'c("{NS}lang/en") > 0')]


TRIPLES = _triples()


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_T = f"t(s, p, o) AS ({_values(TRIPLES)})"
_DICT = f"""lab AS (SELECT o AS label, s AS url FROM t WHERE p = '{NS}label'),
amb AS (SELECT label, list(url ORDER BY url) AS urls FROM lab GROUP BY label HAVING count(*) > 1)"""
_COMBINED = "urls[1] || list_reduce(list_transform(urls[2:], lambda u: '-' || regexp_extract(u, '[^/]*$')), lambda x, y: x || y)"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)


def triples(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(*t, k) for k, t in enumerate(TRIPLES)], "s string, p string, o string, ord long")


def word_kb(spark: SparkSession, how: str | float = "split") -> kb.Kb:
    return kb.build(triples(spark), TRAITS, how)


_stored: dict[tuple, str] = {}


def _once(spark: SparkSession, what: str, make) -> str:
    """The folder of what is stored once for each application."""
    key = (spark.sparkContext.applicationId, what)
    if key not in _stored:
        path = folder(spark, "stored")
        make(path)
        _stored[key] = path
    return _stored[key]


def stored_kb(spark: SparkSession, how: str = "split") -> kb.Kb:
    return kb.load(spark, _once(spark, f"kb {how}", lambda path: kb.save(word_kb(spark, how), path)))


def stored_index(spark: SparkSession, d: str, mark_ambiguous: bool = False) -> DataFrame:
    """The index of all documents, which the queries read: it is written by the first of them."""
    make = lambda path: index.write(index.entries(documents(spark, d), stored_kb(spark), mark_ambiguous=mark_ambiguous), path)
    return index.read(spark, _once(spark, f"index {mark_ambiguous} {d}", make))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")


def spans(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return match.match(documents(spark, sf_dir), stored_kb(spark).dictionary, **settings)


def entries(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return index.entries(documents(spark, sf_dir), stored_kb(spark), **settings)


def asked(text: str):
    return lambda spark, d: query_language.parse(text).run(stored_index(spark, d))


def index_written(spark: SparkSession, d: str) -> DataFrame:
    """The postings of all documents, written to an index in two batches, made one, and read back by the ids of its relations and documents."""
    base, docs = folder(spark, "index"), documents(spark, d)
    half = F.pmod(F.xxhash64("path"), F.lit(2))
    for part in (0, 1):
        index.write(index.entries(docs.where(half == part), stored_kb(spark)), f"{base}/batches")
    index.compact(spark, f"{base}/batches", f"{base}/whole")
    own = index.read(spark, f"{base}/whole")
    relations = index.register(own.select(F.col("relation_url").alias("url")).where("url <> ''"))
    paths = index.register(documents(spark, d).select(F.col("path").alias("url")).where("url < 'doc/5'"))
    paths = index.register(documents(spark, d).select(F.col("path").alias("url")), paths)
    return index.decode(index.encode(own, relations, paths), relations, paths)


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """supplier to nation, nation to region, region to the world; without a cycle, which CYCLE has."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    e = lambda t, a, b, x, y: read(t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("s"), F.lit("up").alias("p"), F.concat(F.lit(b), F.col(y).cast("string")).alias("o"))
    world = read("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("up").alias("p"), F.lit("world").alias("o"))
    return e("supplier", "s", "n", "s_suppkey", "s_nationkey").unionByName(e("nation", "n", "r", "n_nationkey", "n_regionkey")).unionByName(world)


def whole_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """hierarchy() and customer to nation."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.lit("up").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("o"))
    return hierarchy(spark, d).unionByName(customers)


_H = """h AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS o FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"""
_WHOLE_H = _H.removesuffix(")") + " UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
CYCLE = [("a", "up", "b"), ("b", "up", "c"), ("c", "up", "a"), ("c", "up", "d")]
_NATION = "e AS (SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation)"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("o"))


BRACES = ["a{,b}c", "a{b{c,d},e}{f,g}", "a{b,c},", "plain"]
RULES = ["len() = 3", "n() = 5", 'c("a") = 2', 'cs("c") = 0', 'es() = {"a","b"}', 'max(c({"a","b"})) = 2', '{"a","b","c"}', "2 + 3 * 2 = 8", "-true", "min()", "max()", "1 / 0", 'len("abc") + len({"a"} + {"b"})', 'c({"a","b"}) * c({"a"})']
RULE_VALUES = [1, 1, 1, 1, 1, 1, 3, 1, 0, -9e99, 9e99, 9e99, 5, 1]
TURTLE = '@prefix x: <http://x/> . x:A a x:B ; x:p "l1" , "l2" . @base <http://base/> . C x:q <http://y/D> .'
TURTLE_ROWS = [("http://x/A", turtle.RDF_TYPE, "http://x/B"), ("http://x/A", "http://x/p", "l1"), ("http://x/A", "http://x/p", "l2"), ("http://base/C", "http://x/q", "http://y/D")]
RDFXML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:skos="http://skos/"><rdf:Other/><skos:Concept rdf:about="http://c/1"><skos:prefLabel>one</skos:prefLabel>
<skos:altLabel>uno</skos:altLabel><skos:broader rdf:resource="http://c/2"/></skos:Concept></rdf:RDF>"""
RDFXML_ROWS = [("http://c/1", "http://skos/prefLabel", "one"), ("http://c/1", "http://skos/altLabel", "uno"), ("http://c/1", "http://skos/broader", "http://c/2")]


def clashing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels of several concepts, which share some edges: regions as labels of their nations, and nations with edges to the hundreds of their customers'
    balances."""
    url = lambda c: F.concat(F.lit(NS + "nation/"), F.col(c).cast("string"))
    nations = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    labelled = nations.select(F.col("r_name").alias("label"), url("n_nationkey").alias("url"))
    hundreds = F.floor(F.col("c_acctbal").cast("double") / 100).cast("string")
    edge = spark.read.parquet(f"{d}/customer.parquet").select(url("c_nationkey").alias("s"), F.lit(NS + "holds").alias("p"), F.concat(F.lit(NS + "hundreds/"), hundreds).alias("o"), F.lit(0).alias("l")).distinct()
    return written(kb.collisions(labelled), "clashes"), written(edge, "edges")


def ambig_merge(spark: SparkSession, d: str) -> DataFrame:
    found, edge = kb.merge(*clashing(spark, d))
    return found.join(edge, F.col("url") == F.col("s"), "left").select("label", "url", "p", "o")


def ambig_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The edges that labels' concepts get at several thresholds."""
    clashes, edge = clashing(spark, d)
    out = None
    for t in THRESHOLDS:
        got = kb.threshold(clashes, edge, t)[1].select(F.lit(t).alias("t"), "s", "p", "o")
        out = got if out is None else out.unionByName(got)
    return out


THRESHOLDS = [0.0, 0.02, 0.04, 0.06, 0.2, 1.0]
_CLASH = f"""cl AS (SELECT r_name AS label, '{NS}nation/' || n_nationkey AS url FROM nation JOIN region ON r_regionkey = n_regionkey),
ce AS (SELECT DISTINCT '{NS}nation/' || c_nationkey AS s, '{NS}holds' AS p, '{NS}hundreds/' || floor(c_acctbal::DOUBLE / 100)::BIGINT AS o FROM customer),
cm AS (SELECT label, list(url ORDER BY url) AS urls, len(list(url)) AS n FROM cl GROUP BY label HAVING count(*) > 1),
cu AS (SELECT label, urls, n, {_COMBINED} AS url FROM cm),
cs AS (SELECT cl.label, p, o FROM cl JOIN cm ON cm.label = cl.label JOIN ce ON s = cl.url GROUP BY cl.label, p, o HAVING count(*) = max(n)),
cd AS (SELECT cl.label, cl.url, count(s) AS degree FROM cl LEFT JOIN ce ON s = cl.url GROUP BY cl.label, cl.url),
co AS (SELECT label, min(degree) AS fewest, (SELECT count(*) FROM cs WHERE cs.label = cd.label) AS common FROM cd GROUP BY label)"""


def kb_from_config(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the test knowledge base, read from files by a configuration, through its cache."""
    base = folder(spark, "config")
    name = lambda u: f"<{u}>"
    lines = [f'{name(s)} {name(p)} {name(o) if o.startswith(NS) else chr(34) + o.replace(chr(34), "&quot;") + chr(34)} .' for s, p, o in TRIPLES]
    write_text(spark, f"{base}/kb.ttl", "\n".join(lines) + "\n")
    traits = "\n".join(f"{k} = {sorted(getattr(TRAITS, k))}".replace("'", '"') for k in ("transitive", "symmetric", "inverted", "distinct", "name", "ignore", "rule"))
    write_text(spark, f"{base}/kb.toml", f'[file]\npath = "{base}/kb.ttl"\ntype = "Turtle"\nambigs = "Discard"\ncache = "{base}/cache"\n[predicates]\n{traits}\n')
    config = read_config(f"{base}/kb.toml", spark)
    kb.from_config(spark, config)
    return kb.from_config(spark, config).edge.select("s", "p", "o")


def from_files(spark: SparkSession, text: str, kind: str) -> DataFrame:
    base = folder(spark, "triples")
    write_text(spark, f"{base}/in", text)
    return read_triples(spark, f"{base}/in", kind).select("s", "p", "o")


def rule_values(spark: SparkSession, d: str) -> DataFrame:
    m = Memory(5, [("a", ()), ("b", ()), ("a", ())])
    finite = lambda v: max(-9e99, min(9e99, v))
    return _frame(spark, [(r, finite(compile_rule(r)(m))) for r in RULES], "rule string, value double")


def _text(kind):
    def run(spark: SparkSession, d: str) -> DataFrame:
        def task(batches):
            for b in batches:
                yield pd.DataFrame({"page_id": b["page_id"], "text": [kind(x) for x in b["html"]]})

        return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").mapInPandas(task, "page_id long, text string")

    return run


def _resolved(make):
    """Spans of conversations in order of their turns; ambiguous labels have several candidates."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = spark.read.parquet(f"{d}/conversations.parquet").select(F.format_string("%d/%06d", "conv_id", "turn").alias("path"), "text")
        k = stored_kb(spark)
        urls = k.dictionary.join(k.edge.where(F.col("p") == kb.SPLIT), F.col("url") == F.col("s"), "left").groupBy("label").agg(F.array_sort(F.collect_set(F.coalesce("o", "url"))).alias("urls"))
        x = match.match(docs, k.dictionary).join(urls, "label")
        x = x.select(F.substring_index("path", "/", 1).alias("path"), (F.substring_index("path", "/", -1).cast("long") * 1_000_000 + F.col("begin")).alias("begin"), "urls")
        near = {s: tuple(sorted({o for a, p, o in TRIPLES if a == s and p == NS + "lang-of"})) for s, p, o in TRIPLES if p == NS + "lang-of"}
        return resolve.resolve(x, lambda: make(near), 10, near)

    return run


def stream_put(spark: SparkSession, d: str) -> DataFrame:
    """The postings of all documents, put through a stream of files, read back from the index."""
    base = folder(spark, "put")
    static = spark.read.parquet(f"{d}/documents.parquet")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parque[t]")
    docs = source.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    put(docs, stored_kb(spark), f"{base}/index", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/index").select(index.ENTRY)


_SPANS = f"""w0 AS (SELECT 'doc/' || doc_id AS path, unnest(string_split(trim(regexp_replace(coalesce(text, ''), '[\\s\\pP\\pS\\pZ]+', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split(trim(regexp_replace(coalesce(text, ''), '[\\s\\pP\\pS\\pZ]+', ' ', 'g')), ' '), 1) AS i FROM documents),
w1 AS (SELECT path, i, w, lead(w) OVER p AS nx, lag(w) OVER p AS pv, 1 + coalesce(sum(strlen(w) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w0 WINDOW p AS (PARTITION BY path ORDER BY i)),
w2 AS (SELECT *, w || ' ' || nx IN ('of the', 'in the', 'de la') AS two, pv || ' ' || w IN ('of the', 'in the', 'de la') AS second FROM w1),
sp AS (SELECT path, b::BIGINT AS "begin", (b + strlen(tok))::BIGINT AS "end", tok AS token FROM (SELECT path, b, CASE WHEN two THEN w || ' ' || nx ELSE w END AS tok FROM w2 WHERE NOT coalesce(second, false))
  WHERE tok IN (SELECT label FROM lab))"""
_ENTRIES = f"""{_T}, {_DICT}, {_SPANS},
d AS (SELECT l.url AS concept_url, path, token, "begin", "end", CASE WHEN a.label IS NULL THEN 0 ELSE -1 END::BIGINT AS l FROM sp JOIN lab l ON l.label = token LEFT JOIN amb a ON a.label = token),
en AS (SELECT concept_url, path, '' AS relation_url, token, "begin", "end", l, false AS ambiguous FROM d
  UNION ALL SELECT t.o, path, t.p, token, "begin", "end", l, false FROM d JOIN t ON t.s = concept_url AND t.p = '{NS}lang-of')"""
_ALL = 'concept_url, path, relation_url, token, "begin", "end", l, ambiguous'


def _sql(where: str, columns: str = _ALL) -> str:
    return f"WITH {_ENTRIES} SELECT {columns} FROM en WHERE {where}"


THE, EN, FR = f"{NS}word/en/the", f"{NS}lang/en", f"{NS}lang/fr"
_EDGES = f"""e0(s, p, o) AS (SELECT s, p, o FROM t WHERE p NOT IN ('{NS}label', '{NS}name', '{NS}note', '{NS}rule')),
e AS (SELECT * FROM e0 WHERE p <> '{NS}part-of' UNION SELECT o, p, s FROM e0 WHERE p IN ('{NS}see-also', '{NS}part-of') UNION
  SELECT a.s, a.p, b.o FROM e0 a JOIN e0 b ON a.o = b.s AND a.p = b.p WHERE a.p = '{NS}broader')"""

QUERIES = {
    "normalize_documents": lambda s, d: documents(s, d).select("path", normalise(F.col("text")).alias("norm")),
    "kb_classify": lambda s, d: kb.classify(triples(s), TRAITS).select("s", "p", "o", "kind"),
    "kb_edges": lambda s, d: stored_kb(s, "discard").edge.select("s", "p", "o"),
    "kb_from_config": kb_from_config,
    "kb_names": lambda s, d: stored_kb(s).concept.where("name is not null").select("url", "name"),
    "kb_dictionary": lambda s, d: stored_kb(s).dictionary.select("label", "url"),
    "closure_inverse": lambda s, d: kb.inverse(_nations(s, d)),
    "closure_symmetric": lambda s, d: kb.symmetric_closure(_nations(s, d)),
    "closure_transitive": lambda s, d: kb.transitive_closure(hierarchy(s, d)),
    "closure_transitive_cycle": lambda s, d: kb.transitive_closure(_frame(s, CYCLE, "s string, p string, o string")),
    "reachability": lambda s, d: kb.reach(hierarchy(s, d), _frame(s, [("s1",), ("n3",)], "url string")),
    "transitive_reduction": lambda s, d: kb.reduce_transitive(kb.transitive_closure(hierarchy(s, d))),
    "closure_transitive_customers": lambda s, d: kb.transitive_closure(whole_hierarchy(s, d)),
    "transitive_reduction_customers": lambda s, d: kb.reduce_transitive(kb.transitive_closure(whole_hierarchy(s, d))),
    "ambig_split": lambda s, d: kb.split(kb.collisions(kb.labels(kb.classify(triples(s), TRAITS))))[1].select("s", "o"),
    "ambig_merge": ambig_merge,
    "ambig_overlap": lambda s, d: kb.overlap(*clashing(s, d)).select("label", F.col("fewest").cast("long").alias("fewest"), F.col("common").cast("long").alias("common")),
    "ambig_threshold": ambig_threshold,
    "ambig_discard": lambda s, d: stored_kb(s, "discard").dictionary.select("label", "url"),
    "brace_expand": lambda s, d: _frame(s, [(b,) for b in BRACES], "label string").select("label", F.explode(kb.expanded("label")).alias("expanded")),
    "match_exact": lambda s, d: spans(s, d).select("path", "begin", "end", "token"),
    "match_tokens_with_gaps": lambda s, d: spans(s, d, gaps=True).groupBy("path").agg(F.count("*").alias("n_tokens"), F.sum(F.octet_length("token")).cast("long").alias("n_bytes")),
    "match_fuzzy_chain": lambda s, d: spans(s, d, errors=(1,)).select("path", "begin", "end", "token", "label", "l"),
    "match_pattern": lambda s, d: match.match_pattern(documents(s, d), "[0-9]+", NS + "number"),
    "index_postings": entries,
    "index_written": index_written,
    "index_ambiguous_postings": lambda s, d: entries(s, d, mark_ambiguous=True),
    "put_resolved": lambda s, d: entries(s, d, resolvers=[resolve.Step("thematic", 1, 0.4)]),
    "query_direct": asked(f'?("{THE}")'),
    "query_relation": asked(f'?("{NS}lang-of"("{EN}"))'),
    "query_not_relation": asked(f'?(!"{NS}lang-of"("{EN}","{THE}"))'),
    "query_all": asked(f'?(*("{EN}","{THE}"))'),
    "query_ambiguous": lambda s, d: query_language.parse(f'?*(*("{FR}"))').run(stored_index(s, d, True)),
    "query_by_names": lambda s, d: query_language.get(stored_index(s, d), stored_kb(s), '?(*("de la", "the"))'),
    "query_error_limit": lambda s, d: query_language.parse(f'?2(*("{EN}","{THE}"))').run(stored_index(s, d).withColumn("l", F.pmod("begin", F.lit(5)))),
    "query_page": lambda s, d: query_language.page(asked(f'?(*("{EN}"))')(s, d), 20, 50),
    "search_concepts": lambda s, d: search.concepts(stored_kb(s), "lang"),
    "search_predicates": lambda s, d: search.predicates(stored_kb(s), "lang-"),
    "search_parents": lambda s, d: search.parents(stored_kb(s), f"{NS}top"),
    "dictionary_entries": lambda s, d: search.dictionary_entries(stored_kb(s, "discard"), THE),
    "concept_json": lambda s, d: kb.concept_json(stored_kb(s, "discard")),
    "neighbourhood": lambda s, d: kb.neighbourhood(stored_kb(s, "discard").edge, _frame(s, [(THE,)], "url string")),
    "graph_lines": lambda s, d: kb.graph_lines(stored_kb(s, "discard"), THE),
    "concept_info": lambda s, d: search.info(stored_kb(s, "discard"), THE),
    "context_kwic": lambda s, d: spans(s, d, context=12).where("token = 'the'").select("path", "begin", F.hex("before").alias("before"), "token", F.hex("after").alias("after")),
    "context_windows": lambda s, d: spans(s, d, context=12).select("path", "begin", F.hex("before").alias("before"), "token", F.hex("after").alias("after")),
    "resolve_simple": _resolved(resolve.simple),
    "resolve_thematic": _resolved(resolve.thematic),
    "resolve_ruled": _resolved(lambda near: resolve.ruled({u: f'cs("{t[0]}") > 2' for u, t in near.items()})),
    "rule_values": rule_values,
    "turtle_triples": lambda s, d: from_files(s, TURTLE, "turtle"),
    "rdfxml_triples": lambda s, d: from_files(s, RDFXML, "RDFXML"),
    "html_text": _text(element_text),
    "markup_text": _text(node_text),
    "dot_lines": lambda s, d: kb.dot_lines(_frame(s, [(f"r/{k}", None) for k in range(5)], "url string, name string"), _nations(s, d)),
    "pack_relation_id": lambda s, d: s.range(0, 1 << 24, 99991).select(F.col("id").cast("int").alias("rid"), (F.col("id") % 64).cast("int").alias("l")).select(pack_relation(F.col("rid"), F.col("l"), F.lit(True), F.lit(False)).alias("packed")).select("packed", *unpack_relation(F.col("packed"))),
    "stream_put": stream_put,
    **{f"profile_{p}": (lambda p: lambda s, d: index.profile(entries(s, d), p))(p) for p in index.PROFILES},
}

_WINDOWS = f"""WITH {_T}, {_DICT}, {_SPANS},
    t8 AS (SELECT 'doc/' || doc_id AS path, hex(' ' || trim(regexp_replace(coalesce(text, ''), '[\\s\\pP\\pS\\pZ]+', ' ', 'g')) || ' ') AS x FROM documents)
    SELECT sp.path, "begin", substr(x, 2 * greatest(0, "begin" - 12) + 1, 2 * ("begin" - greatest(0, "begin" - 12))) AS before, token, substr(x, 2 * "end" + 1, 24) AS after FROM sp JOIN t8 ON t8.path = sp.path"""
_GROWN = "WITH RECURSIVE {h}, c(s, o) AS (SELECT s, o FROM h UNION SELECT c.s, h.o FROM c JOIN h ON c.o = h.s) "
ORACLE_SQL = {
    "normalize_documents": "SELECT 'doc/' || doc_id AS path, ' ' || trim(regexp_replace(coalesce(text, ''), '[\\s\\pP\\pS\\pZ]+', ' ', 'g')) || ' ' AS norm FROM documents",
    "kb_classify": f"WITH {_T} SELECT s, p, o, CASE regexp_extract(p, '[^/]*$') WHEN 'label' THEN 'label' WHEN 'name' THEN 'name' WHEN 'rule' THEN 'rule' ELSE 'plain' END AS kind FROM t WHERE p <> '{NS}note'",
    "kb_edges": f"WITH {_T}, {_EDGES} SELECT s, p, o FROM e",
    "kb_from_config": f"WITH {_T}, {_EDGES} SELECT s, p, o FROM e",
    "kb_names": f"WITH {_T}, {_DICT} SELECT s AS url, o AS name FROM t WHERE p = '{NS}name' UNION ALL SELECT {_COMBINED}, label FROM amb",
    "kb_dictionary": f"WITH {_T}, {_DICT} SELECT label, url FROM lab WHERE label NOT IN (SELECT label FROM amb) UNION ALL SELECT label, {_COMBINED} FROM amb",
    "closure_inverse": f"WITH {_NATION} SELECT o AS s, p, s AS o FROM e",
    "closure_symmetric": f"WITH {_NATION} SELECT s, p, o FROM e UNION SELECT o, p, s FROM e",
    "closure_transitive": _GROWN.format(h=_H) + "SELECT s, 'up' AS p, o FROM c",
    "closure_transitive_cycle": _GROWN.format(h=f"h AS (SELECT s, o FROM ({_values(CYCLE)}) v(s, p, o))") + "SELECT s, 'up' AS p, o FROM c",
    "reachability": _GROWN.format(h=_H) + "SELECT DISTINCT o AS url FROM c WHERE s IN ('s1', 'n3') UNION SELECT 's1' UNION SELECT 'n3'",
    "transitive_reduction": f"WITH {_H} SELECT s, 'up' AS p, o FROM h",
    "closure_transitive_customers": _GROWN.format(h=_WHOLE_H) + "SELECT s, 'up' AS p, o FROM c",
    "transitive_reduction_customers": f"WITH {_WHOLE_H} SELECT s, 'up' AS p, o FROM h",
    "ambig_split": f"WITH {_T}, {_DICT} SELECT {_COMBINED} AS s, unnest(urls) AS o FROM amb",
    "ambig_merge": f"WITH {_CLASH} SELECT cu.label, url, p, o FROM cu LEFT JOIN cs ON cs.label = cu.label",
    "ambig_overlap": f"WITH {_CLASH} SELECT label, fewest::BIGINT AS fewest, common::BIGINT AS common FROM co",
    "ambig_threshold": f"""WITH {_CLASH}, th AS (SELECT unnest({THRESHOLDS})::DOUBLE AS t), tc AS (SELECT t, co.label, url, urls, fewest > 0 AND common > 0 AND common >= t * fewest AS close FROM co JOIN cu ON cu.label = co.label, th)
        SELECT t, tc.url AS s, p, o FROM tc JOIN cs ON cs.label = tc.label WHERE close UNION ALL SELECT t, tc.url, '{kb.SPLIT}', unnest(urls) FROM tc WHERE NOT close""",
    "ambig_discard": f"WITH {_T}, {_DICT} SELECT label, url FROM lab WHERE label NOT IN (SELECT label FROM amb)",
    "brace_expand": _values([(b, x) for b in BRACES for x in {"a{,b}c": ["ac", "abc"], "a{b{c,d},e}{f,g}": ["abcf", "abcg", "abdf", "abdg", "aef", "aeg"], "a{b,c},": ["ab,", "ac,"], "plain": ["plain"]}[b]]).join(("SELECT label, expanded FROM (", ") v(label, expanded)")),
    "match_exact": f'WITH {_T}, {_DICT}, {_SPANS} SELECT path, "begin", "end", token FROM sp',
    "match_tokens_with_gaps": f"""WITH {_T}, {_DICT}, {_SPANS},
        n AS (SELECT 'doc/' || doc_id AS path, strlen(' ' || trim(regexp_replace(coalesce(text, ''), '[\\s\\pP\\pS\\pZ]+', ' ', 'g')) || ' ') AS size FROM documents),
        g AS (SELECT path, "begin" - coalesce(lag("end") OVER (PARTITION BY path ORDER BY "begin"), 0) AS gap FROM sp), m AS (SELECT path, max("end") AS last, count(*) AS k FROM sp GROUP BY path)
        SELECT n.path, (coalesce(k, 0) + 1 + coalesce((SELECT count(*) FROM g WHERE g.path = n.path AND gap > 0), 0))::BIGINT AS n_tokens, size::BIGINT AS n_bytes FROM n LEFT JOIN m ON m.path = n.path""",
    "index_postings": _sql("true"),
    "index_written": _sql("true"),
    "index_ambiguous_postings": _sql("true", _ALL.replace("ambiguous", "l <> 0 AS ambiguous")),
    "put_resolved": f"""WITH {_T}, {_DICT}, {_SPANS},
        cn AS (SELECT path, token, "begin", "end", url, regexp_extract(url, '/word/([a-z]+)/', 1) AS lang, EXISTS (SELECT 1 FROM amb WHERE label = token) AS unsure FROM sp JOIN lab ON lab.label = token),
        tk AS (SELECT path, "begin", max(CASE WHEN unsure THEN NULL ELSE lang END) AS known, list(lang) AS langs FROM cn GROUP BY path, "begin"),
        st AS (SELECT path, "begin", langs, last_value(known IGNORE NULLS) OVER (PARTITION BY path ORDER BY "begin" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tk),
        d AS (SELECT cn.path, token, cn."begin", "end", url, CASE WHEN unsure AND NOT coalesce(list_contains(langs, before), false) THEN -1 ELSE 0 END::BIGINT AS l
          FROM cn JOIN st ON st.path = cn.path AND st."begin" = cn."begin" WHERE NOT unsure OR lang = before OR NOT coalesce(list_contains(langs, before), false))
        SELECT url AS concept_url, path, '' AS relation_url, token, "begin", "end", l, false AS ambiguous FROM d
        UNION ALL SELECT t.o, path, t.p, token, "begin", "end", l, false FROM d JOIN t ON t.s = url AND t.p = '{NS}lang-of'""",
    "query_direct": _sql(f"concept_url = '{THE}' AND l <= 0 AND relation_url = ''"),
    "query_relation": _sql(f"concept_url = '{EN}' AND l <= 0"),
    "query_not_relation": _sql(f"concept_url IN ('{EN}', '{THE}') AND l <= 0 AND relation_url <> '{NS}lang-of'"),
    "query_all": _sql(f"concept_url IN ('{EN}', '{THE}') AND l <= 0"),
    "query_ambiguous": _sql(f"concept_url = '{FR}' AND l <> 0 AND l <= 0", _ALL.replace("ambiguous", "true AS ambiguous")),
    "query_by_names": _sql(f"concept_url IN ('{_url('es', 'de la')}', '{_url('fr', 'de la')}', '{THE}') AND l <= 0"),
    "query_error_limit": _sql(f"concept_url IN ('{EN}', '{THE}') AND l <= 2").replace("SELECT concept_url, path, relation_url, token, \"begin\", \"end\", l, ambiguous FROM en", "SELECT * FROM (SELECT concept_url, path, relation_url, token, \"begin\", \"end\", \"begin\" % 5 AS l, ambiguous FROM en)"),
    "query_page": _sql(f"concept_url = '{EN}' AND l <= 0") + ' ORDER BY path, "begin", "end", concept_url, relation_url, l LIMIT 50 OFFSET 20',
    "search_concepts": f"WITH {_T}, {_EDGES} SELECT DISTINCT url, 3::BIGINT AS how FROM (SELECT s AS url FROM e UNION SELECT o FROM e) WHERE contains(url, 'lang')",
    "search_predicates": f"WITH {_T} SELECT DISTINCT s AS url FROM t WHERE contains(p, 'lang-')",
    "search_parents": f"WITH {_T}, {_EDGES} SELECT DISTINCT s AS url FROM e WHERE o = '{NS}top'",
    "dictionary_entries": f"WITH {_T} SELECT o AS label FROM t WHERE s = '{THE}' AND p = '{NS}label'",
    "concept_json": f"""WITH {_T}, {_EDGES}, nm AS (SELECT s AS url, o AS name FROM t WHERE p = '{NS}name'), u AS (SELECT s AS url FROM e UNION SELECT o FROM e),
        ed AS (SELECT s, '{{"P":{{"URL":"' || p || '","Name":"' || coalesce(n1.name, '') || '"}},"O":{{"URL":"' || o || '","Name":"' || coalesce(n2.name, '') || '"}},"L":0}}' AS x, p, o
          FROM e LEFT JOIN nm n1 ON n1.url = p LEFT JOIN nm n2 ON n2.url = o)
        SELECT u.url, '{{"URL":"' || u.url || '","Name":"' || coalesce(max(nm.name), '') || '","Edges":[' || coalesce(string_agg(x, ',' ORDER BY p, o), '') || '],"Ambiguous":false}}' AS json
        FROM u LEFT JOIN nm ON nm.url = u.url LEFT JOIN ed ON ed.s = u.url GROUP BY u.url""",
    "neighbourhood": f"""WITH RECURSIVE {_T}, {_EDGES}, w AS (SELECT s, o FROM e UNION SELECT s, p FROM e), c(url) AS (SELECT '{THE}' UNION SELECT w.o FROM c JOIN w ON w.s = c.url) SELECT url FROM c""",
    "graph_lines": f"""WITH RECURSIVE {_T}, {_EDGES}, nm AS (SELECT s AS url, o AS name FROM t WHERE p = '{NS}name'), c(url) AS (SELECT '{THE}' UNION SELECT e.o FROM c JOIN e ON e.s = c.url),
        re AS (SELECT e.* FROM e JOIN c ON c.url = e.s WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.o = b.s AND a.p = b.p AND a.o <> b.o WHERE a.s = e.s AND a.p = e.p AND b.o = e.o))
        SELECT '"' || c.url || '" [label="' || coalesce(name, regexp_extract(c.url, '[^/]*$')) || '" shape="box" style="' || CASE WHEN c.url = '{THE}' THEN 'filled' ELSE '' END || '"]' AS line FROM c LEFT JOIN nm ON nm.url = c.url
        UNION ALL SELECT '"' || s || '" -> "' || o || '" [label="' || regexp_extract(p, '[^/]*$') || '"]' FROM re""",
    "concept_info": f"WITH {_T} SELECT CASE WHEN p = '{NS}label' THEN '' ELSE p END AS p, o FROM t WHERE s = '{THE}'",
    "context_kwic": _WINDOWS + " WHERE token = 'the'",
    "context_windows": _WINDOWS,
    "rule_values": f"SELECT rule, value::DOUBLE AS value FROM ({_values(list(zip(RULES, RULE_VALUES, strict=True)))}) v(rule, value)",
    "turtle_triples": f"SELECT * FROM ({_values(TURTLE_ROWS)}) v(s, p, o)",
    "rdfxml_triples": f"SELECT * FROM ({_values(RDFXML_ROWS)}) v(s, p, o)",
    "dot_lines": "SELECT '\"r/' || i || '\" [label=\"' || i || '\"]' AS line FROM range(5) r(i) UNION ALL SELECT '\"n' || n_nationkey || '\" -> \"r' || n_regionkey || '\" [label=\"in\"]' FROM nation",
    "pack_relation_id": "SELECT (CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END)::INT AS packed, rid::INT AS rid, (rid % 64)::INT AS l, true AS ambiguous, false AS flag FROM (SELECT rid, rid * 256 + (rid % 64) * 4 + 2 AS v FROM range(0, 16777216, 99991) r(rid))",
    "stream_put": _sql("true"),
    **{f"profile_{p}": _sql("true", ", ".join((f"CASE WHEN relation_url <> '' THEN '{index.INDIRECT}' ELSE '' END AS relation_url" if c == "relation_url" and p in index.COLLAPSED else f'"{c}"') for c in index.ENTRY if c not in gone)) for p, gone in index.PROFILES.items()},
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of English and of the word "the", by any relation."""
    return QUERIES["query_all"](spark, sf_dir)
