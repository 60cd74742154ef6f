"""Nearest neighbours: shifted Hilbert orderings, merged key windows, an exact check by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

DIMS, BITS = 6, 8


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid cells (n, d) along the Hilbert curve, by Skilling's transform of axes."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(hit, x[i], x[i] ^ swap) if i else x[0]
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[d - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, scale: float, dims: int = DIMS) -> np.ndarray:
    """Keys on one curve: a random projection of its own, a random shift, a grid of 2**BITS cells."""
    rng = np.random.Generator(np.random.PCG64([17, curve]))
    axes = np.linalg.qr(rng.standard_normal((vectors.shape[1], vectors.shape[1])))[0][:, :dims]
    shift = rng.uniform(-0.5, 0.5, axes.shape[1])
    grid = ((vectors @ axes / max(scale, 1e-300)) / 8 + 0.5 + shift / 8) * (1 << BITS)
    return hilbert_keys(np.clip(np.floor(grid), 0, (1 << BITS) - 1))


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added component by component in order."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += query[k] * rows[:, k]
    return total


def top_rows(query_id: int, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, k: int) -> list[tuple]:
    """The k best rows for a query but itself, ties to the smaller id; near: the products of a fast multiplication."""
    own = ids != query_id
    pick = np.flatnonzero(own)
    if len(pick) > k:
        scores = near[pick]
        cut = np.partition(scores, len(pick) - k)[len(pick) - k]
        pick = pick[scores >= cut - 1e-9 * max(1.0, abs(cut))]
    score = exact_scores(query, rows[pick])
    order = np.lexsort((ids[pick], -score))[:k]
    return [(query_id, int(ids[pick[o]]), float(score[o])) for o in order]


FOUND = "query_id long, vec_id long, score double"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.data, np.float64).reshape(len(ids), -1).astype(np.float64)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest_neighbours(rows: DataFrame, *, id_col="vec_id", vector_col="embedding", every=20, k=20, curves=4, block=1024) -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by `every`.

    Each curve orders the vectors by the Hilbert key of a random, shifted projection; Spark deals
    the keys out in ranges, numbers them, and packs blocks of `block` neighbours. A query is held
    against its own block and the two beside it on every curve, and the windows merge. In high
    dimensions windows alone miss too much, so an exact check follows: every block of the first
    curve whose bound, query * centre + |query| * radius, reaches the query's k-th score so far
    is searched as well. Results are exact.

    Returns query_id, rank, vec_id, score. Null, zero and non-finite vectors, null ids, and
    vectors of another length than most take no part; of repeated ids, one row is kept in each
    result with its best score; an empty table gives no rows; other columns don't matter.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    whole = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    valid = rows.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    stats = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("sq"))
    top = stats.orderBy(F.desc("n"), "d").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, scale, total = top.d, float(np.sqrt(top.sq / top.d)), top.n

    def keys(batches):
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, dims))
            for c in range(curves):
                yield pd.DataFrame({"curve": np.int32(c), "key": curve_keys(x, c, scale), "vec_id": batch["vec_id"].to_numpy(), "data": [r.tobytes() for r in x]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = valid.where(F.size("v") == dims).mapInPandas(keys, "curve int, key long, vec_id long, data binary")
    keyed = stage(keyed.repartitionByRange(parts, "curve", "key", "vec_id").withColumn("part", F.spark_partition_id()), "keys")
    counts = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("curve", "part").orderBy("key", "vec_id")
    ranked = keyed.join(counts, ["curve", "part"]).withColumn("at", F.col("base") + F.row_number().over(within) - 1)

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        x = np.frombuffer(b"".join(rows["data"]), np.float64).reshape(len(rows), dims).astype(np.float64)
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max()) * (1 + 1e-9) + 1e-12
        return pd.DataFrame({
            "curve": [key[0]], "block": [key[1]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "data": [b"".join(rows["data"])],
            "centre": [centre.tobytes()], "radius": [radius],
        })

    blocks = ranked.select("curve", F.floor(F.col("at") / block).alias("block"), "at", "vec_id", "data")
    blocks = stage(blocks.groupBy("curve", "block").applyInPandas(pack, "curve int, block long, ids binary, data binary, centre binary, radius double"), "blocks")

    def window(batches):
        for batch in batches:
            for row in batch.itertuples():
                ids, x = _unpack(row)
                own = np.frombuffer(row.own_ids, np.int64)
                pick = np.flatnonzero(own % every == 0)
                asked = np.frombuffer(row.own_data, np.float64).reshape(len(own), -1)[pick].astype(np.float64)
                near = asked @ x.T
                yield _frame([r for i, p in enumerate(pick) for r in top_rows(int(own[p]), asked[i], ids, x, near[i], k)])

    own = blocks.select("curve", F.col("ids").alias("own_ids"), F.col("data").alias("own_data"), F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"))
    windows = own.join(blocks.select("curve", "block", "ids", "data"), ["curve", "block"]).select("ids", "data", "own_ids", "own_data")
    found = stage(_best(windows.mapInPandas(window, FOUND), k), "windows")

    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    first = blocks.where("curve = 0")
    queries = ranked.where((F.col("curve") == 0) & (F.col("vec_id") % every == 0)).select("vec_id", "at", "data")
    queries = queries.join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "at", "data", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def gather(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        return pd.DataFrame({"q": [key[0]], "q_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "q_data": [b"".join(rows["data"])], "q_floor": [rows["floor"].to_numpy().tobytes()]})

    span = block * every
    asked = stage(queries.groupBy(F.floor(F.col("at") / span).alias("q")).applyInPandas(gather, "q long, q_ids binary, q_data binary, q_floor binary"), "queries")
    spans = -(-total // span)

    def bounded(batches):
        for batch in batches:
            keep = []
            for row in batch.itertuples():
                q = np.frombuffer(row.q_data, np.float64).reshape(-1, dims).astype(np.float64)
                bound = q @ np.frombuffer(row.centre) + np.sqrt((q * q).sum(1)) * row.radius
                keep.append(bool((bound >= np.frombuffer(row.q_floor)).any()))
            yield batch.loc[keep, ["q", "block"]]

    ask = first.select("block", "centre", "radius", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))).alias("q"))
    pairs = stage(ask.join(asked, "q").select("q", "block", "centre", "radius", "q_data", "q_floor").mapInPandas(bounded, "q long, block long"), "pairs")

    def search(batches):
        for batch in batches:
            for row in batch.itertuples():
                ids, x = _unpack(row)
                q_ids, floor = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_floor)
                q = np.frombuffer(row.q_data, np.float64).reshape(len(q_ids), -1).astype(np.float64)
                near = q @ x.T
                low = floor - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(floor), floor, 0)))
                out = []
                for i in np.flatnonzero((near >= low[:, None]).any(1)):
                    pick = np.flatnonzero(near[i] >= low[i])
                    out += top_rows(int(q_ids[i]), q[i], ids[pick], x[pick], near[i][pick], k)
                yield _frame(out)

    rest = pairs.join(first.select("block", "ids", "data"), "block").join(asked, "q").repartition(parts, "q", "block")
    exact = rest.select("ids", "data", "q_ids", "q_data", "q_floor").mapInPandas(search, FOUND)
    return _best(found.select("query_id", "vec_id", "score").unionByName(exact), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
