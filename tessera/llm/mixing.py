"""Mixing sources to target weights: blocks, multinomial draws per shard, index permutations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, drawn, exclusive_sums, spread, stage, table

#: Modulus and multipliers of the arithmetic hash inside the index permutation.
PRIME, MULTIPLIERS, ROUNDS = 2_147_483_647, (48_271, 69_621, 16_807, 39_373), 8
CELLS = 4096


class Mix(NamedTuple):
    documents: DataFrame
    slots: DataFrame


def permuted(x: Column, n: Column, salt: Column) -> Column:
    """A pseudorandom permutation of [0, n): swap-or-not rounds, a bijection for every n."""
    a, b, c, d = MULTIPLIERS

    def turn(at: Column, r: Column) -> Column:
        key = ((salt + 1) * a + (r + 1) * b) % PRIME
        mate = F.pmod(key - at, n)
        top = F.greatest(at, mate)
        coin = F.shiftright(((top % PRIME) * c + (r + 1) * d + salt * b) % PRIME, 15) % 2
        return F.when(coin == 1, mate).otherwise(at)

    rounds = F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)])
    return F.aggregate(rounds, x.cast("long"), turn)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=1.5, cap=2, block=64) -> DataFrame:
    """One row per source: sid, source_size, target, n_blocks, n_slots, first ticket.

    Weights repeat over the sources by code point, null last. Targets share `share` times all
    sizes by weight; none is above `cap` times its source's size, the excess goes to the others
    by weight (water filling: sources by rising cap per weight, the level where the first stays
    below its cap holds for all).
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rows = rows.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    rows = rows.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    )
    rising = Window.orderBy(F.col("source_size") * float(cap) / F.col("weight"), "sid")
    full = F.col("source_size") * float(cap)
    budget = F.sum("source_size").over(everything) * float(share)
    filled = F.coalesce(F.sum(full).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (budget - filled) / rest).withColumn("pos", F.row_number().over(rising))
    open_ = F.when(F.col("level") * F.col("weight") <= full, F.struct("pos", "level"))
    rows = rows.withColumn("level", F.coalesce(F.min(open_).over(everything)["level"], F.lit(float("inf"))))
    rows = rows.withColumn("target", F.least(full, F.col("level") * F.col("weight")))
    rows = rows.withColumn("n_blocks", F.floor((F.col("source_size") + block - 1) / block))
    wanted = F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)
    rows = rows.withColumn(
        "n_slots", F.when(F.col("source_size") > 0, F.least(wanted, F.col("n_blocks") * int(cap))).otherwise(F.lit(0).cast("long"))
    )
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ticket", F.coalesce(F.sum("n_slots").over(ahead), F.lit(0)))
    return rows.select("sid", "source", "source_size", "target", "n_blocks", "n_slots", "ticket")


def draw_slots(spark: SparkSession, sources: DataFrame, total: int, per_shard: int, seed: str) -> DataFrame:
    """Counts of each source in each output shard: (shard, sid, start, n).

    Every slot of a shard draws its source with the targets' weights, so that the counts of a
    shard are multinomial. What a source has drawn beyond its slots is given, over all shards,
    to the sources that fell short, whose totals are then exact. start numbers a source's slots
    through the shards.
    """
    live = sources.where("n_slots > 0")
    cell = lambda t: F.floor(t * CELLS / F.lit(total))
    cells = live.select(
        "sid", "ticket", (F.col("ticket") + F.col("n_slots")).alias("beyond"),
        F.explode(F.sequence(cell(F.col("ticket")), cell(F.col("ticket") + F.col("n_slots") - 1))).alias("cell"),
    )
    draws = (
        spark.range(total)
        .select(F.floor(F.col("id") / per_shard).alias("shard"), F.pmod(drawn(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.lit(total)).alias("hit"))
        .withColumn("cell", cell(F.col("hit")))
        .join(cells, "cell")
        .where("hit >= ticket AND hit < beyond")
        .groupBy("shard", "sid")
        .agg(F.count("*").alias("drawn"))
    )
    by_shard = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    draws = stage(
        draws.join(live.select("sid", "n_slots"), "sid")
        .withColumn("before", F.coalesce(F.sum("drawn").over(by_shard), F.lit(0)))
        .withColumn("kept", F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("n_slots") - F.col("before"))))
        .select("shard", "sid", "drawn", "kept"),
        "draws",
    )
    freed = draws.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("free")).where("free > 0")
    freed = exclusive_sums(freed.withColumn("h", spread(F.col("shard"))), [], ["h", "shard"], F.col("free"), "at")
    freed = freed.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("free") - 1)).alias("i"))
    short = live.join(draws.groupBy("sid").agg(F.sum("kept").alias("has")), "sid", "left")
    short = short.select("sid", (F.col("n_slots") - F.coalesce("has", F.lit(0))).alias("lacks")).where("lacks > 0")
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("at", F.coalesce(F.sum("lacks").over(ahead), F.lit(0)))
    short = short.select("sid", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lacks") - 1)).alias("i"))
    given = freed.join(short, "i").groupBy("shard", "sid").agg(F.count("*").alias("kept"))
    counts = draws.select("shard", "sid", "kept").unionByName(given).groupBy("shard", "sid").agg(F.sum("kept").alias("n"))
    return counts.where("n > 0").withColumn("start", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))


def mix_sources(
    docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", row_col=None,
    weights=(3, 1, 2), share=1.5, cap=2, block=64, per_shard=8192, seed="mix",
) -> Mix:
    """Mix documents so that each source's words come near its target.

    A source's documents, in a pseudorandom order, form one stream of words, cut into blocks of
    `block` words. Output shards of `per_shard` slots draw their sources; the i-th slot of a
    source takes the block at i's place in a pseudorandom permutation of its blocks, over again
    once all are taken, `cap` times at most. Blocks and slots meet in a join by index.

    Returns documents (doc_id, size, source_size, target, taken, first_shard: the first output
    shard that holds a block of it) and slots (shard, sid, block).
    Null text has size 0, and documents of size 0 take 0; a null source is a source of its own,
    the last; rows that repeat are documents of their own; an empty table gives no rows. Other
    columns of `docs` are not looked at. With `row_col`, a column unique to each row, documents
    has it as `row`, and source besides.
    """
    spark = docs.sparkSession
    row = ["row", "source"] if row_col else []
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *([F.col(row_col).alias("row")] if row_col else []),
    )
    sizes = stage(sizes, "sizes")
    sources = stage(source_targets(sizes, weights, share, cap, block), "sources")
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    counts = draw_slots(spark, sources, max(1, total), per_shard, seed)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = (
        counts.join(sources.select("sid", "n_blocks"), "sid")
        .repartition(parts, "shard", "sid")  # the counts are few, the slots they stand for are not
        .withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
        .select("shard", "sid", permuted(F.col("i") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid")).alias("block"))
    )
    known = sizes.join(sources.select("sid", "source", "source_size", "target"), sizes.source.eqNullSafe(sources.source)).drop(sources.source)
    known = known.select(*row, "doc_id", "size", "sid", "source_size", "target", spread(F.col("doc_id")).alias("h"))
    placed = exclusive_sums(known.where("size > 0"), ["sid"], ["h", "doc_id", "size", *row[:1]], F.col("size"), "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    )
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    taken = (
        pieces.select(*row, "sid", "block", "start", "doc_id", "size", "words")
        .join(times, ["sid", "block"], "left")
        .groupBy("sid", "start", "doc_id", "size", *row)
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), F.min("first_shard").alias("first_shard"))
        .join(sources.select("sid", "source_size", "target"), "sid")
    )
    out = ["doc_id", "size", "source_size", "target", "taken", "first_shard", *row]
    empty = known.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
    return Mix(taken.select(*out).unionByName(empty.select(*out)), slots)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).documents


def oracle(block: int = 64) -> str:
    """The same mix in DuckDB's SQL, with the draws of the output shards."""
    a, b, c, d = MULTIPLIERS
    turns = []
    for r in range(ROUNDS):
        turns.append(
            f"m{r} AS (SELECT sid, n_blocks, i, x, ((((sid + 1) * {a} + {(r + 1) * b}) % {PRIME} - x) % n_blocks + n_blocks) % n_blocks AS mate FROM x{r}),\n"
            f"x{r + 1} AS (SELECT sid, n_blocks, i, CASE WHEN ((((greatest(x, mate) % {PRIME}) * {c} + {(r + 1) * d} + sid * {b}) % {PRIME}) >> 15) % 2 = 1 THEN mate ELSE x END AS x FROM m{r})"
        )
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, [3.0, 1.0, 2.0][(sid % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, sid) AS pos,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, (SELECT min_by(level, pos) FROM s3 WHERE level * weight <= cap) AS lam FROM s3),
s5 AS (SELECT sid, source, source_size, least(cap, coalesce(lam, 'inf'::DOUBLE) * weight) AS target, (source_size + {block - 1}) // {block} AS n_blocks FROM s4),
src AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * n_blocks / source_size + 0.5)::BIGINT, n_blocks * 2) ELSE 0 END AS n_slots FROM s5),
x0 AS (SELECT sid, n_blocks, i, i % n_blocks AS x FROM src, unnest(range(n_slots)) AS t(i) WHERE n_slots > 0),
{', '.join(turns)},
live AS (SELECT sid, n_slots, coalesce(sum(n_slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ticket FROM src WHERE n_slots > 0),
hits AS (SELECT i // 8192 AS shard, ('0x' || substr(md5('mix:' || i), 1, 15))::BIGINT % (SELECT sum(n_slots) FROM live) AS hit FROM unnest(range((SELECT sum(n_slots)::BIGINT FROM live))) AS t(i)),
dr AS (SELECT shard, sid, count(*) AS drawn FROM hits JOIN live ON hit >= ticket AND hit < ticket + n_slots GROUP BY ALL),
kp AS (SELECT dr.shard, dr.sid, drawn, greatest(0, least(drawn, n_slots - coalesce(sum(drawn) OVER (PARTITION BY dr.sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS kept FROM dr JOIN live USING (sid)),
fr AS (SELECT shard, row_number() OVER (ORDER BY h, shard, k) - 1 AS i FROM (SELECT shard, ('0x' || substr(md5(shard::VARCHAR), 1, 8))::BIGINT AS h, sum(drawn - kept)::BIGINT AS free FROM kp GROUP BY shard), unnest(range(free)) AS t(k)),
sh AS (SELECT sid, row_number() OVER (ORDER BY sid, k) - 1 AS i FROM (SELECT live.sid, (n_slots - coalesce((SELECT sum(kept) FROM kp WHERE kp.sid = live.sid), 0))::BIGINT AS lacks FROM live), unnest(range(lacks)) AS t(k)),
ct AS (SELECT shard, sid, sum(n)::BIGINT AS n FROM (SELECT shard, sid, kept AS n FROM kp UNION ALL SELECT shard, sid, 1 FROM fr JOIN sh USING (i)) GROUP BY ALL HAVING sum(n) > 0),
st AS (SELECT shard, sid, n, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ct),
times AS (SELECT x.sid, x.x AS block, count(*) AS times, min(st.shard) AS first_shard FROM x{ROUNDS} x JOIN st ON st.sid = x.sid AND x.i >= st.start AND x.i < st.start + st.n GROUP BY ALL),
placed AS (
  SELECT s.*, src.sid, src.source_size, src.target,
    coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN src ON s.source IS NOT DISTINCT FROM src.source WHERE size > 0),
pieces AS (SELECT *, least(start + size, (block + 1) * {block}) - greatest(start, block * {block}) AS words
  FROM placed, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS t(block)),
taken AS (SELECT p.doc_id, p.size, p.source_size, p.target, sum(p.words * coalesce(t.times, 0))::BIGINT AS taken, min(t.first_shard) AS first_shard
  FROM pieces p LEFT JOIN times t ON p.sid = t.sid AND p.block = t.block GROUP BY p.sid, p.start, p.doc_id, p.size, p.source_size, p.target)
SELECT doc_id, size, source_size, target, taken, first_shard FROM taken
UNION ALL
SELECT s.doc_id, s.size, src.source_size, src.target, 0, NULL FROM sizes s JOIN src ON s.source IS NOT DISTINCT FROM src.source WHERE s.size = 0
"""
