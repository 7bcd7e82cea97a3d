"""Quality rules as a short-circuit cascade.

On a bounded sample each rule's cost (seconds a row, beyond what reading the rows takes) and selectivity (share rejected) are measured; rules run in order of
rejections per second, and a row that one rule rejects never reaches the next. The order decides what is computed, never the verdict: a row is kept if no
rule rejects it. The words of a text are split once and shared by all features that look at them.

A null text has no words, lines or symbols. Words are [^\\x20\\x09-\\x0D]+, lengths are code points. Texts are whole, of any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, done, n_words, words

WINDOW = 5
#: Rows on which costs and selectivities are measured, how often a rule is evaluated on each, at first and if it is cheap, and the seconds that the latter may take.
SAMPLE_ROWS, REPEATS, PATIENCE = 500, (2, 32), 2.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, BLANKS, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def n_lines(text: Column) -> Column:
    return F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return F.coalesce(let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def n_upper(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"\P{Lu}+", "")), F.lit(0)).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Of an array of words: those in windows of `window` words that the text holds twice or more, the first included.

    Hashes tell the texts without repeats, in time proportional to their length. In others the windows themselves are sorted, so that equal
    ones are neighbours, and the words they cover are counted from their places in order.
    """

    def covered(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - window + 1)
        windows = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k: (F.get(s, k)["g"] == F.get(s, k - 1)["g"]) | (F.get(s, k)["g"] == F.get(s, k + 1)["g"])
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.get(s, k)["g"] == F.get(s, k + 1)["g"], F.get(s, k)["g"] == F.get(s, k - 1)["g"], F.lit(False)))
            return F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(let(windows, places), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))
        return F.when(F.size(w) <= window, F.lit(0).cast("long")).when(F.size(F.array_distinct(hashes)) == F.size(w) - window + 1, F.lit(0).cast("long")).otherwise(covered(w))

    return F.coalesce(let(words, count), F.lit(0).cast("long"))


#: What rules look at, from a text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.coalesce(F.size(w), F.lit(0)).cast("long"),
    "word_chars": lambda t, w: word_chars(t),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_lines": lambda t, w: n_lines(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_upper": lambda t, w: n_upper(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}
#: name -> whether a row is rejected, from its features. A rule computes none but those it asks for.
Rule = Callable[[Callable[[str], Column]], Column]
RULES: dict[str, Rule] = {
    "few_words": lambda x: x("n_words") < 10,
    "repeated_windows": lambda x: 100 * x("n_repeat_words") > 20 * x("n_words"),
    "symbols": lambda x: 10 * x("n_symbols") > x("n_words"),
    "word_length": lambda x: ~x("word_chars").between(2 * x("n_words"), 15 * x("n_words")),
    "repeated_lines": lambda x: 2 * x("n_dup_lines") > x("n_lines"),
    "capitals": lambda x: 2 * x("n_upper") > x("word_chars"),
}
BASE = ("few_words", "repeated_windows")


def features(text: Column, words: Column, known: Collection[str] = ()) -> Callable[[str], Column]:
    """name -> the feature of a text: the column of that name where it is known, else the expression."""
    return lambda name: F.col(name) if name in known else FEATURES[name](text, words)


def measure(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """rule -> (seconds a row, share rejected) over a sample of at most `rows` rows.

    Each rule is evaluated on every sampled row a few times in one task; if that takes little more than the same job without a rule, many times, now that the job is
    compiled. What the job takes that only reads the rows as often is subtracted.
    """
    t = F.col(text).cast("string")
    table = cut(docs.select(t.alias("t"), words(t).alias("w")).limit(rows), "quality-sample")
    x = features(F.col("t"), F.col("w"))

    def took(value: Column, repeats: int) -> tuple[float, float, int]:
        """Seconds, share and evaluations. The copy's number is part of the sum, so that no copy is spared."""
        many = table.coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        began = time.perf_counter()
        hits, weight = many.agg(F.sum(F.when(value, F.col("again")).otherwise(0)), F.sum("again")).first()
        return time.perf_counter() - began, (hits or 0) / max(weight or 0, 1), max(1, (weight or 0) * 2 // (repeats + 1))

    few, more = REPEATS
    nothing = F.octet_length("t") + F.size("w") < 0
    idle = {few: took(nothing, few)[0], more: took(nothing, more)[0]}
    out = {}
    for name, f in rules.items():
        repeats = few
        seconds, share, n = took(f(x), few)
        if (seconds - idle[few]) * more / few < PATIENCE:
            repeats = more
            seconds, share, n = took(f(x), more)
        # of a difference that drowns in the job's own time, a hundredth of that is told
        out[name] = (max(seconds - idle[repeats], idle[repeats] / 100) / n, share)
    done(table)
    return out


def ordered(stats: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, ties by name."""
    return sorted(stats, key=lambda x: (-stats[x][1] / max(stats[x][0], 1e-9), x))


def rejected_by(x: Callable[[str], Column], order: list[str], rules: dict[str, Rule] = RULES) -> Column:
    """The first rule, in the given order, that rejects the row; null if none does. Later rules are not computed then."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name](x), F.lit(name)).otherwise(out)
    return out


def keep(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, all columns as they are. Repeated rows share their verdict; no rows give none."""
    order = ordered(measure(docs, rules, text))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.where(let(words(t), lambda w: rejected_by(features(t, w), order, rules).isNull()))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = [x for x in ordered(measure(docs)) if x not in BASE]
    t, w = F.col("t"), F.col("w")
    x = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("w", words(t))
    x = x.select("doc_id", "t", *(FEATURES[c](t, w).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    known = features(t, words(t), x.columns)
    failed = RULES["few_words"](known) | RULES["repeated_windows"](known)
    # the base counts are asked for in any case; the other rules run only where the base passes
    kept = F.when(failed, F.lit(False)).otherwise(rejected_by(known, order).isNull())
    return x.select(*(c for c in x.columns if c != "t"), failed.alias("base_failed"), kept.alias("kept"))


_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of documents (with all columns) that the cascade keeps and their counts.
QUALITY_CTE = rf"""
qd AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents),
qw AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS w FROM qd),
qg AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM qw)),
qr AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM qg) WHERE c > 1),
qc AS (SELECT rid, sum(least(5, i - coalesce(p, i - 5))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM qr) GROUP BY rid),
qf AS (SELECT qd.*, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '\P{{Lu}}', '', 'g'))::BIGINT AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(qc.n, 0)::BIGINT AS n_repeat_words
  FROM qd JOIN qw USING (rid) LEFT JOIN qc USING (rid)),
qb AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM qf),
quality AS (SELECT *, NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > len(lines) OR 2 * n_upper > word_chars) AS kept FROM qb)"""
OP8_SQL = f"WITH {QUALITY_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality"
