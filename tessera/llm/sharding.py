"""Sharding by balanced label propagation: linked documents move together, counts stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exclusive_sums, release, spread, stage, table


def _places(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within `key`."""
    return exclusive_sums(rows, [key], order, F.lit(1), out)


def _round(state: DataFrame) -> tuple[DataFrame, int]:
    """One round: each group names a shard, members ask to move there, quotas decide.

    A shard lets in as many documents as it has unlinked ones; unlinked documents then fill the
    places that the moved ones left, so that no shard's count changes.
    """
    linked, loose = state.where("node IS NOT NULL"), state.where("node IS NULL")
    room = loose.groupBy("shard").agg(F.count("*").alias("room"))
    here = linked.groupBy("node", "shard").agg(F.count("*").alias("here"))
    rank = F.struct("here", F.xxhash64("node", "shard").alias("tie"), "shard", "room")
    best = here.join(room, "shard").groupBy("node").agg(F.max(rank).alias("best"))
    best = best.select("node", F.col("best.shard").alias("to"), F.col("best.here").alias("there"), F.col("best.room").alias("room"))
    asks = (
        linked.join(here.withColumnRenamed("here", "own"), ["node", "shard"])
        .join(best, "node")
        .where("shard <> `to` AND own <= there")
        .withColumn("h", spread(F.col("node")))
    )
    asks = _places(asks, "to", ["h", "node", "row"], "place")
    moves = stage(asks.where("place < room").select("row", F.col("shard").alias("from"), "to"), "moves")
    n = moves.count()
    if not n:
        release(moves)
        return state, 0
    net = (
        moves.select(F.col("to").alias("shard"), F.lit(1).alias("n"))
        .unionByName(moves.select(F.col("from").alias("shard"), F.lit(-1).alias("n")))
        .groupBy("shard").agg(F.sum("n").alias("net"))
    )
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    give = net.where("net > 0").withColumn("at", F.coalesce(F.sum("net").over(ahead), F.lit(0)))
    take = net.where("net < 0").withColumn("at", F.coalesce(F.sum(-F.col("net")).over(ahead), F.lit(0)))
    take = take.select(F.col("shard").alias("new"), F.explode(F.sequence(F.col("at"), F.col("at") - F.col("net") - 1)).alias("i"))
    spare = _places(loose.withColumn("h", spread(F.col("row"))), "shard", ["h", "row"], "place").join(give, "shard")
    spare = spare.where("place < net").select("row", (F.col("at") + F.col("place")).alias("i")).join(take, "i")
    changed = moves.select("row", F.col("to").alias("new")).unionByName(spare.select("row", "new"))
    after = state.join(changed, "row", "left").withColumn("shard", F.coalesce("new", "shard")).drop("new")
    after = stage(after, "shards")
    release(moves, state)
    return after, n


def shard_by_links(docs: DataFrame, *, id_col="doc_id", text_col="text", shards=40, load=0.75) -> DataFrame:
    """Deal documents to `shards` shards, copies of a text together, counts at most one apart.

    Copies of a text are linked. A link node stands for each group of copies, so that links grow
    with the rows; a group larger than `load` of a shard is split by hash over several nodes.
    Documents start in shards by a pseudorandom order; in each round the nodes name the shard
    with room where most of their members are, members ask to move, and quotas decide. Rounds go
    on until nobody moves. They end: members only go where as many of their node or more already
    are, so each move raises the sum over nodes and shards of the squares of members there.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law ('rows'), shard, slot (gapless
    from 0 in each shard), grown_shard (null), cut (whether a copy of the text is elsewhere).
    Null text counts as the empty text; rows that repeat are documents of their own; null ids
    are kept; an empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
    ).withColumn("h", spread(F.concat_ws(":", F.col("doc_id"), F.col("digest"))))
    base = stage(base, "digests")
    base = stage(exclusive_sums(base, [], ["h", "doc_id", "digest"], F.lit(1), "row").drop("h"), "rows")
    total = base.count()
    quota = max(1, int(load * total / shards))
    groups = base.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("copies") / quota))
    state = base.join(groups, "digest", "left").select(
        "row", F.when(F.col("copies").isNotNull(), F.concat_ws(":", F.col("digest"), part)).alias("node"), (F.col("row") % shards).cast("int").alias("shard")
    )
    state = stage(state, "shards")
    moved = 1
    while moved:
        state, moved = _round(state)
    placed = base.join(state.select("row", "shard"), "row").withColumn("h", spread(F.col("row")))
    placed = _places(placed, "shard", ["h", "row"], "slot")
    homes = placed.groupBy("digest").agg((F.min("shard") < F.max("shard")).alias("cut"))
    return placed.join(homes, "digest").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "cut",
    )


def op4_shard_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_links(table(spark, sf_dir, "documents"))
