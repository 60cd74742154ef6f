"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Sets that can be similar share a partition key. Tasks send such keys to shards in sorted, packed
lists; what meets there makes clusters, a large one without what is too far apart by its sketch,
and each cluster has inverted lists of its shingles, in which every set looks for those with
enough of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import key_filter, maybe_in, release, stage, table
from .textgrams import give_back, mixed, packed, shingle_sets, unpacked

#: Each level of sizes reaches this much further than the one below it; classes of a level, to the differences it allows.
LEVEL, CLASSES = 1.3, 1.25
#: Shingles in one block of a candidate cluster; larger clusters are joined block by block.
BLOCK_SHINGLES = 2_000_000
#: Partition keys that a task gathers before it sends them, and bits that it leaves out: more sets may then meet.
GATHER, KEY_BITS = 1 << 20, np.uint64(20)
#: Bits of a set's sketch; sets with one key of up to so many are compared by pairs of sketches, more are taken as near.
SKETCH, COMPARED = 512, 1 << 15
#: The more of it, the fewer long lists are left out of the merge.
SKIP = 2.0
#: Columns of the rows that tasks make of documents.
FIELDS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("key", pa.binary()), ("hash", pa.int64()), ("rid", pa.int64()), ("other", pa.int64()), ("shard", pa.int32()), ("posts", pa.binary()), ("sketch", pa.binary())])


def needed(n: int, percent: int) -> int:
    """The least overlap with a set of n shingles that the similarity allows."""
    return -(-percent * n // 100)


def partition_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two sets of at least this similarity share one, by the pigeonhole principle.

    Sizes fall into levels that overlap, so that any two similar sets are in one of them. A level
    deals shingles to more classes than its pairs can have differences; some classes of a pair
    are then equal as a whole. The content of a class and its level make a key. Classes of few
    shingles, which unlike sets share by chance, are left out as far as the surplus allows: a set
    keeps those of `least` or more; of two sets, the greater `least` holds for both.
    """
    n, keys = len(grams), []
    ratio = (100 - percent) / (100 + percent)
    level = max(0, math.floor(math.log(max(1, n) * percent / 100, LEVEL)) - 1)
    while n and LEVEL**level <= n:
        high = math.floor(LEVEL ** (level + 1) * 100 / percent + 1e-6)
        if n <= high:
            classes = math.ceil(2 * high * ratio * CLASSES) + 1
            apart = math.floor((n + min(high, n * 100 / percent)) * ratio + 1e-6)
            at = (mixed(grams ^ np.uint64(level + 1)) % np.uint64(classes)).astype(np.int64)
            order, counts = np.argsort(at, kind="stable"), np.bincount(at, minlength=classes)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(grams[order]))))
            ends = np.cumsum(counts)
            content = sums[ends] - sums[ends - counts]
            fewer = np.concatenate(([0], np.cumsum(np.bincount(counts))))
            least = int(np.flatnonzero(fewer <= classes - apart - 1)[-1])
            kept = np.flatnonzero(counts >= least)
            keys.append(mixed(mixed(content[kept] + kept.astype(np.uint64)) + np.uint64(level)))
        level += 1
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


FOUND = "kind int, doc_id long, size long, key binary, hash long, rid long, other long, shard int, posts binary, sketch binary"
DOCUMENT, POSTS, LINK, SHARED = range(4)


def _shards(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def sketch(grams: np.ndarray) -> bytes:
    """For each of SKETCH classes whether it has an odd number of the set's shingles: two sets' sketches differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of four kinds: documents (doc_id, size, key of the set, hash of the text, rid, sketch of a
    set that is new to its task), posts of partition keys (rid of the task's first row, shard, keys
    and rows), links between rows (rid, other), and rows with a key that another row of the task has
    (rid, the key's number as other).

    Within a task only the first set of a key is sent on, and the others are linked to it, so that a
    key that many sets share reaches its shard once a task.
    """
    shards = _shards(docs.sparkSession)

    def rows(count: int, kind: int, **cols) -> pa.RecordBatch:
        arrays = []
        for field in FIELDS:
            arrays.append(pa.array(cols[field.name], field.type) if field.name in cols else pa.array(np.full(count, kind), field.type) if field.name == "kind" else pa.nulls(count, field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=FIELDS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, 0
        held, waiting, seen = [], 0, set()

        def sent() -> Iterator[pa.RecordBatch]:
            keys, row = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((row, keys))
            keys, row = keys[order], row[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            pairs = np.stack((row, row[new][np.cumsum(new) - 1]))[:, ~new]
            pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
            yield rows(pairs.shape[1], LINK, rid=base + pairs[0], other=base + pairs[1])
            shard = ((keys & np.uint64(0xFFFFF)) % np.uint64(shards)).astype(np.int64)
            both = _several(new)
            yield rows(int(both.sum()), SHARED, rid=base + row[both], other=_met(keys[both] >> KEY_BITS, shard[both], shards))
            keys, row, shard = keys[new], row[new], shard[new]
            order = np.argsort(shard, kind="stable")
            edges = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))
            own = [s for s in range(shards) if edges[s] < edges[s + 1]]
            posts = [packed(keys[p] >> KEY_BITS, row[p]) for s in own for p in [order[edges[s] : edges[s + 1]]]]
            yield rows(len(own), POSTS, rid=np.full(len(own), base), shard=own, posts=posts)

        for batch in batches:
            sizes, keys, sketches = [], [], []
            for grams in shingle_sets(batch.column(1), n):
                sketches.append(None)
                sizes.append(len(grams))
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                if len(grams) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    sketches[-1] = sketch(grams)
                    mine = partition_keys(grams, percent)
                    held.append((mine, np.full(len(mine), at)))
                    waiting += len(mine)
                at += 1
            yield rows(len(sizes), DOCUMENT, doc_id=batch.column(0), size=sizes, key=keys, hash=batch.column(2), rid=base + np.arange(at - len(sizes), at), sketch=sketches)
            if waiting > GATHER:
                yield from sent()
                held, waiting, seen = [], 0, set()
        if held:
            yield from sent()

    return docs.mapInArrow(sign, FOUND)


def _met(keys: np.ndarray, shard, shards: int) -> np.ndarray:
    """One number for the kept bits of a partition key and its shard."""
    return (keys * np.uint64(shards) + np.asarray(shard).astype(np.uint64)).astype(np.int64)


def _several(new: np.ndarray) -> np.ndarray:
    """Rows whose key another row has too, by where a new key begins."""
    return ~new | np.concatenate((~new[1:], [False]))


def _near(size: np.ndarray, bits: np.ndarray, x, y, percent: int) -> np.ndarray:
    """Whether sets may be similar: false only where their sketches differ in more bits than similar sets can in shingles."""
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(-1, dtype=np.int64)
    return apart * (100 + percent) <= (size[x] + size[y]) * (100 - percent)


def near_pairs(met: np.ndarray, rid: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (a, b) of rows that lead to all that may be similar among those with one key; `met`, the key's number, is in order.

    Few rows are compared by all pairs. Of more, each is compared with those that nothing has led to
    yet, so that many sets that are near each other take one comparison each.
    """
    begins = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1]))) if len(met) else np.zeros(0, np.int64)
    counts, out = np.diff(np.concatenate((begins, [len(met)]))), [np.zeros((2, 0), np.int64)]
    for m in range(2, 17):
        own = begins[counts == m]
        for i, j in combinations(range(m), 2):
            x, y = own + i, own + j
            good = _near(size, bits, x, y, percent)
            out.append(np.stack((rid[x[good]], rid[y[good]])))
    for begin, m in zip(begins[counts > 16].tolist(), counts[counts > 16].tolist()):
        rest = np.arange(begin + 1, begin + m)
        if m > COMPARED:
            out.append(np.stack((rid[rest], np.full(m - 1, rid[begin]))))
            continue
        first, waiting = begin, [begin]
        while len(rest):
            if not waiting:
                first, waiting, rest = rest[0], [rest[0]], rest[1:]
            good = _near(size, bits, rest, waiting.pop(), percent)
            out.append(np.stack((rid[rest[good]], np.full(int(good.sum()), rid[first]))))
            waiting += rest[good].tolist()
            rest = rest[~good]
    pairs = np.concatenate(out, axis=1)
    return np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)


def _gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a shard in order, their rows, and where a new key begins."""
    give_back()
    parts = [(unpacked(data.as_py()), base) for data, base in zip(rows.column("posts"), rows.column("rid").to_pylist())]
    keys, row = np.concatenate([x[0] for x, _ in parts]), np.concatenate([x[1].astype(np.int64) + base for x, base in parts])
    order = np.lexsort((row, keys))
    keys, row = keys[order], row[order]
    return keys, row, np.concatenate(([True], keys[1:] != keys[:-1]))


def meetings(signed: DataFrame) -> DataFrame:
    """(a, b): rows whose sets share a partition key, each linked to the first of the key."""

    def meet(rows: pa.Table) -> pa.Table:
        _, row, new = _gathered(rows)
        pairs = np.unique(np.stack((row, row[np.flatnonzero(new)][np.cumsum(new) - 1]))[:, ~new], axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    far = signed.where(F.col("kind") == POSTS).select("shard", "rid", "posts").groupBy("shard").applyInArrow(meet, "a long, b long")
    return far.unionByName(signed.where(F.col("kind") == LINK).select(F.col("rid").alias("a"), F.col("other").alias("b")))


def near_meetings(signed: DataFrame, among: DataFrame, percent: int) -> DataFrame:
    """(a, b): rows `among` (rid) whose sets share a partition key and may be similar by their sketches, linked in chains."""
    spark = signed.sparkSession
    shards, parts = _shards(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meet(rows: pa.Table) -> pa.Table:
        keys, row, new = _gathered(rows)
        both = _several(new)
        return pa.table({"met": _met(keys[both], rows.column("shard")[0].as_py(), shards), "rid": row[both]})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()

        def linked(met, rid, size, bits) -> pa.RecordBatch:
            pairs = near_pairs(met, rid, size, bits, percent)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in filter(len, batches):
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            held = tuple(np.concatenate(x) for x in zip(held, (*cols, bits))) if held else (*cols, bits)
            # the last key's rows may go on
            at = int(np.searchsorted(held[0], held[0][-1]))
            if at:
                yield linked(*[x[:at] for x in held])
                held = tuple(x[at:] for x in held)
        if held:
            yield linked(*held)

    far = signed.where(F.col("kind") == POSTS).select("shard", "rid", "posts").groupBy("shard").applyInArrow(meet, "met long, rid long")
    both = far.unionByName(signed.where(F.col("kind") == SHARED).select(F.col("other").alias("met"), "rid"))
    marked = signed.where((F.col("kind") == DOCUMENT) & F.col("sketch").isNotNull()).select("rid", "size", "sketch").join(among, "rid")
    rows = both.join(marked, "rid").select("met", "rid", "size", "sketch")
    return rows.repartition(parts, "met").sortWithinPartitions("met", "rid").mapInArrow(link, "a long, b long")


def probed(lists: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each value, how many of the sorted stretches of `lists` hold it, by binary search in all of them at once."""
    low, high = np.tile(begins, (len(values), 1)), np.tile(ends, (len(values), 1))
    while (going := low < high).any():
        mid = (low + high) >> 1
        less = lists[np.minimum(mid, len(lists) - 1)] < values[:, None]
        low, high = np.where(going & less, mid + 1, low), np.where(going & ~less, mid, high)
    return ((low < ends) & (lists[np.minimum(low, len(lists) - 1)] == values[:, None])).sum(1)


def divide_skip(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, and the smallest position that links lead to, among `sets` by rising size.

    sides: 0 joins all; 1 and 2 join only across. A set x asks the sets before it. Sets y with
    enough overlap have T = ceil(percent * |x|) of x's shingles at least. The short inverted lists,
    each in order, are merged (a stable sort merges sorted runs as a heap does); the L longest are
    left out: who occurs T - L times in the merge is a candidate, and is then looked for in each
    long list by binary search.
    """
    count = len(sets)
    links, root = np.zeros(count, np.int64), np.arange(count)
    sizes = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(count), sizes).astype(np.uint16 if count < 1 << 16 else np.int64)
    lists, ends = own[np.argsort(flat, kind="stable")], np.cumsum(np.bincount(flat, minlength=len(ids)))
    begins = np.concatenate(([0], ends[:-1]))
    edges = np.concatenate(([0], np.cumsum(sizes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for x in range(1, count):
        if not sizes[x]:
            continue
        tokens = flat[edges[x] : edges[x + 1]]
        t, low = needed(sizes[x], percent), int(np.searchsorted(sizes[:x], needed(sizes[x], percent)))
        if low >= x:
            continue
        tokens = tokens[np.argsort(ends[tokens] - begins[tokens], kind="stable")]
        longest = int(ends[tokens[-1]] - begins[tokens[-1]])
        far = min(t - 1, int(t / (SKIP * math.log2(max(2, longest)) + 1)))
        short, long = tokens[: len(tokens) - far], tokens[len(tokens) - far :]
        spans = ends[short] - begins[short]
        at = np.repeat(begins[short] - np.concatenate(([0], np.cumsum(spans[:-1]))), spans) + np.arange(spans.sum())
        hits = lists[at]
        hits = np.sort(hits[(hits >= low) & (hits < x)], kind="stable")
        new = np.flatnonzero(np.concatenate(([True], hits[1:] != hits[:-1]))) if len(hits) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((new, [len(hits)])))
        near, times = hits[new].astype(np.int64)[times >= t - far], times[times >= t - far]
        if sides[x]:
            across = sides[near] != sides[x]
            near, times = near[across], times[across]
        for i in range(0, len(near), 1024):
            y = near[i : i + 1024]
            both = times[i : i + 1024] + (probed(lists, begins[long], ends[long], y) if far else 0)
            y = y[100 * both >= percent * (sizes[x] + sizes[y] - both)]
            links[x] += len(y)
            links[y] += 1
            for z in np.unique(root[y]).tolist():
                a, b = find(x), find(z)
                root[max(a, b)] = min(a, b)
    return links, np.array([find(x) for x in range(count)])


def _clusters(signed: DataFrame, percent: int) -> DataFrame:
    """(rid, key, hash, task, side) of one row for each set that may have links.

    Clusters of sets that meet hold every link. In a large cluster only sets that may be similar by
    their sketches stay together; what is still large is cut into blocks, by size and, as each size's
    own shingles ask for, by hash, and blocks whose sizes allow links are joined in pairs.
    """
    rows = signed.where(F.col("kind") == DOCUMENT).where("size > 0").select("rid", "key", "size", "hash")
    band = F.floor(F.log(F.col("size").cast("double")) * (-1 / math.log(percent / 100 - 1e-9) if percent < 100 else 1e6))

    def sets(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = rows.join(roots.withColumnsRenamed({"node": "rid", "root": "cluster"}), "rid").groupBy("key").agg(F.min("cluster").alias("cluster"), F.min(F.struct("rid", "hash")).alias("of"), F.min("size").alias("size"))
        found = stage(found.select("key", "cluster", "of.*", "size", band.alias("band")), "clusters")
        return found, found.groupBy("cluster").agg(F.sum("size").alias("total"), F.count("*").alias("sets")).where("sets > 1")

    roots = components(meetings(signed))
    found, totals = sets(roots)
    large = totals.where(F.col("total") > BLOCK_SHINGLES).select(F.col("cluster").alias("root"))
    if not large.isEmpty():
        # keys that unlike sets share by chance tie ever more of a growing table to one cluster
        among = stage(roots.join(large, "root").select(F.col("node").alias("rid")), "among")
        near = components(near_meetings(signed, among, percent))
        wide = found
        found, totals = sets(roots.join(large, "root", "left_anti").select("node", "root").unionByName(near))
        release(wide, among)
    bands = found.groupBy("cluster", "band").agg(F.sum("size").alias("own")).join(totals, "cluster")
    block = F.when(F.col("total") > BLOCK_SHINGLES, F.col("band") * (1 << 24) + F.pmod(F.xxhash64("key"), F.ceil(F.col("own") / BLOCK_SHINGLES))).otherwise(F.lit(0)).cast("long")
    found = found.join(bands, ["cluster", "band"]).select("rid", "key", "hash", "size", "cluster", block.alias("block"))
    blocks = found.groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = blocks.select("cluster", F.col("block").alias("later"), F.col("low").alias("later_low"))
    pairs = blocks.join(other, "cluster").where("later >= block").where(F.col("later_low") * percent <= F.col("high") * 100)
    task = F.struct("cluster", F.col("block").alias("i"), F.col("later").alias("j"))
    pairs = pairs.select(task.alias("task"), "cluster", F.explode(F.array_distinct(F.array("block", "later"))).alias("block"))
    side = F.when(F.col("task.i") == F.col("task.j"), 0).when(F.col("block") == F.col("task.i"), 1).otherwise(2)
    return found.join(pairs, ["cluster", "block"]).select("rid", "key", "hash", "task", side.alias("side"))


def jaccard_components(docs: DataFrame, *, id_col="doc_id", text_col="text", words=4, percent=85) -> DataFrame:
    """Group documents whose word-shingle sets have a Jaccard similarity of percent / 100 or more.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; with fewer words than a shingle
    has, the whole sequence is one; a text without words, or null, has none and links to
    nothing. Documents with equal sets form one class, so that copies cost nothing; components
    of links between classes are exact up to collisions of 64-bit hashes.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable) and n_links (other
    classes linked to the document's own). Null ids are kept, and a component of them alone is
    null; repeated rows are copies; an empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    signed = stage(signatures(docs, words, percent), "signatures", "kind")
    members = stage(_clusters(signed, percent), "members")
    release(signed, part=f"kind={POSTS}")
    # texts of sets in clusters only, each once, however many copies it has
    texts = docs.where(maybe_in("hash", spark, key_filter(members.select("hash")))).groupBy("hash").agg(F.any_value("text").alias("text"))
    texts = texts.join(members.hint("merge"), "hash").select("task", "side", "rid", "key", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(parts, "task").sortWithinPartitions("task", "rid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: dict) -> pa.RecordBatch:
            picked = sorted(rows, key=lambda rid: (len(rows[rid][0]), rid))
            links, root = divide_skip([rows[r][0] for r in picked], np.array([rows[r][1] for r in picked]), percent)
            return pa.RecordBatch.from_arrays([pa.array(picked, pa.int64()), pa.array(links, pa.int64()), pa.array([picked[k] for k in root], pa.int64())], ["rid", "links", "root"])

        task, rows = None, {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:4]]
            for key, side, rid, mark, grams in zip(*cols, shingle_sets(batch.column(4), words)):
                if key != task:
                    if rows:
                        yield solved(rows)
                    task, rows = key, {}
                if hashlib.blake2b(grams.tobytes(), digest_size=16).digest() == mark:
                    rows[rid] = (grams, side)
        if rows:
            yield solved(rows)
        del rows
        give_back()

    found = stage(texts.mapInArrow(search, "rid long, links long, root long"), "links")
    totals = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    rows = signed.where(F.col("kind") == DOCUMENT)
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("low"))
    keys = members.select("key", "rid").distinct()
    linked = keys.join(roots.withColumnRenamed("node", "rid"), "rid").join(totals, "rid")
    linked = linked.join(classes, "key").select("key", "root", "low", "n_links")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_low"))
    linked = linked.join(lowest, "root").select("key", "component_low", "n_links")
    classes = classes.join(linked, "key", "left").select("key", F.when(F.col("n_links").isNull(), F.col("low")).otherwise(F.col("component_low")).alias("component_low"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    lone = F.col("size") == 0
    return rows.join(classes, "key").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(lone, F.col("doc_id")).otherwise(F.col("component_low")).alias("component_id"),
        F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
