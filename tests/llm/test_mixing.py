"""Mixing: the schedule in the output, repeated rows and ids, empty tables, and the query against its SQL on odd rows."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.llm import mixing, quality

SCHEMA = "doc_id long, text string, source string, slot string, taken long"


def _words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(50)}" for _ in range(n))


def against_sql(spark, query, sql, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    df = query(spark, folder)
    assert sorted(names) == sorted(df.columns)
    rows = sorted((tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == rows
    return rows


def test_query_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, a hot source, null sources, long, empty and null texts, and columns named as the result's are."""
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2, k]), r.choice([None, "", " \n", _words(r.choice([1, 3, 40, 3000]), k % 30)]), r.choice(["hot", "hot", "hot", "a", "é", "Z", None]), "x", 9) for k in range(300)]
    rows += [(None, _words(20, 7), "hot", "x", 9)] * 150
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = against_sql(spark, mixing.op10, mixing.OP10_SQL, str(tmp_path))
    assert len(got) == 450
    against_sql(spark, quality.op8, quality.OP8_SQL, str(tmp_path))
    rows = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, mixing.mix(rows.repartition(3)).collect())) == sorted(map(str, mixing.mix(rows).collect()))


def test_stretches_of_the_output_hold_the_sources_near_their_shares(spark):
    docs = spark.createDataFrame([(k, _words(100, k), "abc"[k % 3], "x", 9) for k in range(900)], SCHEMA)
    made = mixing.mixed(docs, block=200).collect()
    assert [f.name for f in docs.schema] == list(made[0].asDict())
    total = collections.Counter()
    for x in made:
        total[x.source] += len(x.text.split())
    whole = sum(total.values())
    for a in range(0, len(made) - 150, 50):
        part = collections.Counter()
        for x in made[a : a + 150]:
            part[x.source] += len(x.text.split())
        for s in total:
            assert abs(part[s] / sum(part.values()) - total[s] / whole) < 0.06
    # a document's two uses are far from each other, and texts are whole or cut at their end
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[x.doc_id].startswith(x.text) for x in made)
    assert max(collections.Counter(x.doc_id for x in made).values()) == 2


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op10(spark, str(tmp_path)).count() == mixing.mixed(none).count() == quality.op8(spark, str(tmp_path)).count() == 0
    only_empty = spark.createDataFrame([(1, None, "a", "x", 9), (1, "", None, "x", 9)], SCHEMA)
    assert sorted((r.size, r.taken, r.slot) for r in mixing.mix(only_empty).collect()) == [(0, 0, None)] * 2 and mixing.mixed(only_empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(none, epochs=3)


def test_costs_tell_dear_rules_from_cheap_ones(spark):
    """A rule that looks at every window costs more a row than one that counts words."""
    docs = spark.createDataFrame([(k, _words(3000, k)) for k in range(60)], "doc_id long, text string")
    for _ in range(2):
        stats = quality.measure(docs, {k: quality.RULES[k] for k in ("few_words", "repeated_windows")})
        assert stats["repeated_windows"][0] > 3 * stats["few_words"][0]
    assert quality.ordered({"dear": (10.0, 0.5), "cheap": (1.0, 0.1), "idle": (1.0, 0.0)}) == ["cheap", "dear", "idle"]
    slow = {"never": lambda x: x("n_repeat_words") < 0, "often": lambda x: x("n_words") > 10}
    assert quality.ordered(quality.measure(docs, slow)) == ["often", "never"] and quality.keep(docs, rules=slow).count() == 0
    assert quality.keep(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
