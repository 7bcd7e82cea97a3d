"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order and cut, as one run of words, into blocks of equal length. The schedule is a row of
slots; slot i has the van der Corput point of i, which falls into one source's share of the cumulative weights. A source's slots, ranked by
i, take its blocks in order, from the first again after the last. So any stretch of the schedule holds the sources near their shares, and
with a power of two of points every source gets exactly the slots of its share. The last slot of a source takes part of a block.

What a slot takes of its block is what the mix takes of the documents in it, and the slots of a document tell its places in the mix: mixed() gives its rows
in their order. Everything is DataFrame functions. Ranks and running sums go in two levels, over ranges of the order and within them, so that neither the rows of a
source with a third of all rows nor the sources themselves need to be in one task. Rows that are alike are one row with a count until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Weights of the sources in the order of their names, over and over; words of the mix for each word of input; most uses of a document.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Words in a block.
BLOCK = 1024


def _before(what: Column, over) -> Column:
    return F.coalesce(F.sum(what).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with columns for running sums, each over the rows before in an order of all: within ranges of the order, after the sums of the ranges before.
    One row for each range meets in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged.select("*", *(v.alias(f"_v_{k}") for k, v in sums.items())), name)
    parts = ranged.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums))
    parts = parts.select("_part", *(_before(F.col(f"_s_{k}"), Window.orderBy("_part")).alias(f"_b_{k}") for k in sums))
    within = Window.partitionBy("_part").orderBy(*order)
    out = ranged.join(F.broadcast(parts), "_part")
    return out.select(*rows.columns, *((F.col(f"_b_{k}") + _before(F.col(f"_v_{k}"), within)).alias(k) for k in sums))


def targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, weight, source_size) with target: share of all sizes by weight, at most `epochs` times the source's size.

    What goes beyond a limit is dealt among the others by weight until no target is above its limit. With sources in order of limit over
    weight, that is one level: each target is the smaller of its limit and level * weight.
    """
    x = sources.withColumn("_cap", (F.lit(epochs) * F.col("source_size")).cast("double"))
    total, weight = x.agg(F.sum("source_size"), F.sum("weight")).first()
    order = [F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    x = running(x, order, {"_caps": F.col("_cap"), "_before": F.col("weight")}, "mix-levels")
    x = x.withColumn("_level", (F.lit(float(share) * (total or 0)) - F.col("_caps")) / (F.lit(weight or 0) - F.col("_before")))
    # the level that the first source keeps below its limit settles it; without one, all take their limits
    level = x.agg(F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_level")))["_level"]).first()[0]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("weight"))
    return x.select(*sources.columns, target.alias("target"))


def weigh(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, sid, base, weight: one row for each source; sid counts sources by code point, null last; base: the sizes of those before."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    x = running(per, [F.col("source").isNull(), F.col("source")], {"sid": F.lit(1).cast("long"), "base": F.col("source_size")}, "mix-sources")
    return x.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))


def _reversed_bits(x: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, slot, rank, block, again, taken: the slots in the order of the mix, the block each takes of its source, whether for the second time, and how
    many of its words.

    plan: sid, source_size, target. Slots are numbered with gaps; their order is the mix's.
    """
    want = F.floor("target").cast("long")
    first = F.least(want, F.col("source_size"))
    x = plan.withColumn("_first", first).withColumn("_second", want - F.col("_first")).withColumn("_blocks", F.ceil(F.col("source_size") / block))
    x = x.withColumn("_slots", (F.ceil(F.col("_first") / block) + F.ceil(F.col("_second") / block)).cast("long"))
    x = cut(running(x, [F.col("sid")], {"_from": F.col("_slots")}, "mix-shares"), "mix-plan")
    n = x.agg(F.sum("_slots")).first()[0] or 0
    bits = max(0, int(n - 1).bit_length()) if n else 0
    # points of each source's share; a large share is split before it is unfolded
    step = 1 << 16
    parts = x.where("_slots > 0").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / step))))
    parts = parts.repartition("sid", "_part")
    low = F.col("_from") + F.col("_part") * step
    points = parts.withColumn("_point", F.explode(F.sequence(low, F.least(low + step, F.col("_from") + F.col("_slots")) - 1)))
    slots = points.select("sid", "_from", "_blocks", "_first", "_second", _reversed_bits(F.col("_point"), bits).alias("slot"))
    # ranks by place among all slots, less the slots of the sources before
    ranked = running(slots, [F.col("sid"), F.col("slot")], {"_place": F.lit(1).cast("long")}, "mix-slots").withColumn("rank", F.col("_place") - F.col("_from"))
    again = F.col("rank") >= F.col("_blocks")
    k = F.when(again, F.col("rank") - F.col("_blocks")).otherwise(F.col("rank")).cast("long")
    room = F.when(again, F.col("_second")).otherwise(F.col("_first"))
    return ranked.select("sid", "slot", F.col("rank").cast("long").alias("rank"), k.alias("block"), again.alias("again"), F.greatest(F.lit(0), F.least(F.lit(block), room - k * block)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, text_md5, size, source_size, target, taken, first, slot, second_slot: words that the mix takes of each row, repeats counted, of those how many in
    the first pass (the document's first words each time), and the slots of the schedule that begin its two passes (null without one).

    docs: doc_id, text, source; other columns are ignored. A null text has no words; a null source is a source of its own, the last. Rows with
    the same doc_id count each; those with the same text too have places one after the other. No rows give none. Documents without words take none. epochs may be 1 or 2.
    """
    if epochs not in (1, 2):
        raise ValueError("epochs may be 1 or 2")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), F.md5(text.cast("binary")).alias("text_md5"))
    # rows that are alike are one with a count, combined before they are dealt
    alike = cut(sizes.groupBy("source", "doc_id", "text_md5", "size").agg(F.count("*").alias("_copies")), "mix-sizes")
    plan = cut(targets(weigh(alike.select("source", (F.col("size") * F.col("_copies")).alias("size")), weights), share, epochs), "mix-targets")
    keyed = alike.join(plan.select(F.col("source").alias("_s"), "sid", "base", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("_hash", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5").cast("binary")))
    # places in the hashed order of each source: those among all rows, less the sizes of the sources before
    order = [F.col(c) for c in ("sid", "_hash", "doc_id", "size")]
    placed = running(keyed, order, {"_place": F.col("size") * F.col("_copies")}, "mix-places").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    own = ["doc_id", "source", "text_md5", "size", "source_size", "target"]
    placed = placed.select(*own, "sid", (F.col("_place") - F.col("base") + F.col("_copy") * F.col("size")).cast("long").alias("_at"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))))
    start = F.col("block") * block
    pieces = pieces.withColumn("_low", F.greatest(F.col("_at"), start) - start).withColumn("_high", F.least(F.col("_at") + F.col("size"), start + block) - start)
    turn = lambda x, second: F.when(F.col("again") == second, x)
    used = schedule(plan.select("sid", "source_size", "target"), block).groupBy("sid", "block")
    used = used.agg(*(F.max(turn(F.col(c), t)).alias(f"_{c}{int(t)}") for t in (False, True) for c in ("taken", "slot")))
    # of a block's part in a document, what lies within the words that a slot takes
    part = lambda t: F.greatest(F.lit(0), F.least(F.col("_high"), F.coalesce(F.col(f"_taken{t}"), F.lit(0))) - F.col("_low"))
    # slots compress so well that the size of their table tells little of what a broadcast would hold
    got = pieces.join(used.hint("merge"), ["sid", "block"], "left").groupBy(*own, "sid", "_at")
    got = got.agg(
        F.sum(part(0) + part(1)).cast("long").alias("taken"), F.sum(part(0)).cast("long").alias("first"),
        *(F.min(F.when(part(t) > 0, F.struct("block", f"_slot{t}")))[f"_slot{t}"].alias(name) for t, name in ((0, "slot"), (1, "second_slot"))),
    )
    nothing = {"taken": F.lit(0).cast("long"), "first": F.lit(0).cast("long"), "slot": F.lit(None).cast("long"), "second_slot": F.lit(None).cast("long")}
    return got.drop("sid", "_at").unionByName(placed.where("size = 0").select(*own).withColumns(nothing))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows that the mix takes, with the columns of docs, in the order of the schedule: each document once for every pass that takes words of it, and of its text the
    part up to the last word taken (all of it where all words are). A document has its place where its pass begins. Rows of one doc_id and text that differ in other columns
    should not be among docs: such rows take what any of them takes."""
    own = ["doc_id", "text_md5", "source"]
    got = mix(docs, **settings).where("taken > 0").groupBy(*own).agg(F.max("first").alias("_first"), F.max(F.col("taken") - F.col("first")).alias("_second"), F.min("slot").alias("_slot"), F.min("second_slot").alias("_slot2"))
    got = cut(got.select(*(F.col(c).alias(f"_{c}") for c in own), "_first", "_second", "_slot", "_slot2"), "mix-taken")
    md5 = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn("_md5", md5)
    rows = rows.join(got, rows["doc_id"].cast("long").eqNullSafe(got["_doc_id"]) & (rows["_md5"] == got["_text_md5"]) & rows["source"].cast("string").eqNullSafe(got["_source"]))
    turns = F.array(F.struct(F.col("_first").alias("n"), F.col("_slot").alias("at")), F.struct(F.col("_second").alias("n"), F.col("_slot2").alias("at")))
    rows = rows.withColumn("_turn", F.explode(F.filter(turns, lambda x: x["n"] > 0)))
    # words with the white space before them
    chunks = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.col("_turn")["n"]
    part = F.when(n_words(F.col("text")) == n, F.col("text")).otherwise(F.array_join(F.slice(chunks, F.lit(1), n.cast("int")), ""))
    rows = rows.select(*(part.alias("text") if c == "text" else F.col(c) for c in docs.columns), F.col("_turn")["at"].alias("_at"), F.col("_md5").alias("_tie"))
    return rows.repartitionByRange("_at", "_tie").sortWithinPartitions("_at", "_tie").select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "slot", "second_slot")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
lvl AS (
  SELECT source, source_size, weight, cap,
    (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, cap / weight) AS level FROM lvl WHERE level * weight <= cap),
t AS (SELECT w.source, sid, source_size, least(cap, coalesce(f.level * weight, cap))::DOUBLE AS target FROM w, f),
u AS (SELECT *, floor(target)::BIGINT AS want, least(floor(target)::BIGINT, source_size) AS one, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM t),
sh AS (SELECT sid, blocks, (one + {BLOCK - 1}) // {BLOCK} + (want - one + {BLOCK - 1}) // {BLOCK} AS slots FROM u),
fr AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low, greatest(0, ceil(log2(greatest(1, sum(slots) OVER ()))))::BIGINT AS bits FROM sh),
pt AS (SELECT sid, blocks, bits, unnest(range(low, low + slots::BIGINT)) AS i FROM fr),
sl AS (SELECT sid, blocks, coalesce(list_sum(list_transform(range(bits), lambda j: ((i >> j) & 1) << (bits - 1 - j))), 0)::BIGINT AS slot FROM pt),
rk AS (SELECT sid, blocks, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM sl),
p AS (SELECT d.doc_id, d.size, u.sid, u.blocks, u.source_size, u.target, want, one,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
q AS (SELECT *, greatest(0, least(a + size, one) - a) AS e1, greatest(0, least(a + size, want - one) - a) AS e2 FROM p)
SELECT doc_id, size, source_size, target, (e1 + e2)::BIGINT AS taken, r1.slot, r2.slot AS second_slot
FROM q LEFT JOIN rk r1 ON e1 > 0 AND r1.sid = q.sid AND r1.rank = a // {BLOCK} LEFT JOIN rk r2 ON e2 > 0 AND r2.sid = q.sid AND r2.rank = q.blocks + a // {BLOCK}"""
