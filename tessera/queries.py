"""Registered queries of the core library and their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, resolve, retrieval, snapshot
from tessera.operators.index import kept_index
from tessera.operators.lineage import Files, cut, shared_folder
from tessera.streaming import debounce, hints

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A query in the documents' own words, and its terms.
QUESTION = "worthless thand Idiot"
TERMS = ["worthless", "thand", "idiot"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Index terms of a column in DuckDB: the same rules with lambdas over lists.
def _tokens(column: str) -> str:
    broken = "w"
    for pattern, by in ((r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"(\p{Nd})([^\p{Nd} ])", r"\1 \2"), (r"([^\p{Nd} ])(\p{Nd})", r"\1 \2")):
        broken = f"regexp_replace({broken}, '{pattern}', '{by}', 'g')"
    words = rf"list_filter(regexp_split_to_array({column}, '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
    each = f"list_transform({words}, lambda w: list_concat([lower(w)], list_filter(list_distinct(list_transform(string_split({broken}, ' '), lambda x: lower(x))), lambda x: x <> lower(w))))"
    stops = ", ".join(f"'{s}'" for s in T.STOP_WORDS)
    return f"list_filter(flatten({each}), lambda t: length(t) >= 2 AND t NOT IN ({stops}))"


BM25 = rf"""ix AS (SELECT doc_id, {_tokens("text")} AS t FROM documents),
c AS (SELECT doc_id, len(t) AS len, list_transform({TERMS}, lambda q: len(list_filter(t, lambda x: x = q))) AS tf FROM ix),
s AS (SELECT count(*) AS n, greatest(avg(len), 1.0) AS a, {", ".join(f"count(*) FILTER (tf[{i}] > 0) AS df{i}" for i in (1, 2, 3))} FROM c),
r AS (SELECT doc_id AS id, {" + ".join(f"CASE WHEN tf[{i}] > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf[{i}] * 2.5 / (tf[{i}] + 1.5 * (0.25 + 0.75 * len / a)) ELSE 0 END" for i in (1, 2, 3))} AS score
  FROM c, s WHERE tf[1] + tf[2] + tf[3] > 0)"""


def _index(spark, sf_dir):
    """The kept index of the documents: made by the first query that asks, brought up to date by later ones."""
    docs = read(spark, sf_dir, "documents")
    return kept_index(docs, docs, f"{sf_dir.rstrip('/')}/documents", "doc_id", {"text": 1})


def _lexical(spark, sf_dir):
    return _index(spark, sf_dir).bm25(TERMS).withColumn("score", F.round("score", 6))


def _dense(spark, sf_dir, k):
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()
    return retrieval.dense_top(vectors.where("vec_id <> 0"), F.array(*[F.lit(x) for x in asked[0]]), k)


DENSE = """d AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS similarity FROM embeddings WHERE vec_id <> 0)"""


@query(f"WITH {BM25} SELECT id AS doc_id, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, id LIMIT 30")
def bm25_topk(spark, sf_dir):
    """Lexical top 30."""
    return retrieval.top(_lexical(spark, sf_dir), 30).withColumnRenamed("id", "doc_id")


@query(f"WITH ix AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM ix GROUP BY term")
def term_statistics(spark, sf_dir):
    """Documents and occurrences of every term."""
    return _index(spark, sf_dir).term_statistics()


@query(f"WITH {DENSE} SELECT id AS vec_id, round(similarity, 6) AS similarity FROM d ORDER BY d.similarity DESC, id LIMIT 20")
def dense_topk(spark, sf_dir):
    """Cosine top 20."""
    return _dense(spark, sf_dir, 20).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {BM25}, {DENSE}, l AS (SELECT id, round(score, 6) AS score FROM r ORDER BY 2 DESC, 1 LIMIT 90), e AS (SELECT * FROM d ORDER BY similarity DESC, id LIMIT 90),
f AS (SELECT coalesce(l.id, e.id) AS id, round(0.68 * coalesce(l.score / (SELECT max(score) FROM l), 0) + 0.32 * (coalesce(e.similarity, 0) + 1) / 2, 6) AS score FROM l FULL JOIN e ON l.id = e.id)
SELECT id, score FROM f ORDER BY score DESC, id LIMIT 30""")
def hybrid_topk(spark, sf_dir):
    """Three times the limit from each arm, fused, cut to 30."""
    both = retrieval.fused(retrieval.top(_lexical(spark, sf_dir), 90), _dense(spark, sf_dir, 90))
    return retrieval.top(both.withColumn("score", F.round("score", 6)), 30)


@query(f"""WITH {BM25}, {DENSE}, l AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM r QUALIFY rank <= 90), e AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM d QUALIFY rank <= 90)
SELECT id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM e) GROUP BY id""")
def reciprocal_rank_fusion(spark, sf_dir):
    """Ranks of the two arms' heads, fused."""
    number = lambda df, by: df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")))  # noqa: E731  90 rows
    lexical, dense = number(retrieval.top(_lexical(spark, sf_dir), 90), "score"), number(_dense(spark, sf_dir, 90), "similarity")
    return retrieval.reciprocal_ranks(lexical, dense).withColumn("score", F.round("score", 9))


@query("SELECT doc_id, concat(CASE WHEN s > 1 THEN '...' ELSE '' END, substr(text, s, 360), CASE WHEN s + 360 <= length(text) THEN '...' ELSE '' END) AS snippet FROM (SELECT doc_id, text, greatest(least(p1, p2, p3) - 90, 1) AS s FROM (SELECT doc_id, text, " + ", ".join(f"CASE WHEN position('{t}' IN lower(text)) > 0 THEN position('{t}' IN lower(text)) ELSE 9e8::BIGINT END AS p{i}" for i, t in enumerate(TERMS, 1)) + " FROM documents) WHERE least(p1, p2, p3) < 9e8)")
def snippets(spark, sf_dir):
    """The window around the first term, with its ellipses."""
    docs = read(spark, sf_dir, "documents").where(" OR ".join(f"contains(lower(text), '{t}')" for t in TERMS))
    return docs.select("doc_id", T.snippet(F.col("text"), TERMS).alias("snippet"))


@query("SELECT concat(source, '/', doc_id, '.', lang) AS path, sha256(text) AS content_hash, strlen(text)::BIGINT AS size, (strlen(text) + 3) // 4 AS tokens FROM documents")
def file_table(spark, sf_dir):
    """Path, content hash, bytes and token estimate."""
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return d.select(path.alias("path"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), T.estimated_tokens(F.col("text")).alias("tokens"))


@query("""WITH cur AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents), old AS (SELECT doc_id::VARCHAR AS path, CASE WHEN toxic = 1 THEN sha256('') ELSE sha256(text) END AS h FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'item' || item_id, sha256(text) FROM benchmark)
SELECT coalesce(old.path, cur.path) AS path, CASE WHEN old.h IS NULL THEN 'added' WHEN cur.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old FULL JOIN cur ON old.path = cur.path WHERE old.h IS DISTINCT FROM cur.h""")
def change_detection(spark, sf_dir):
    """Labelled documents were known, the toxic ones in another version, and the benchmark is gone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    current = docs.select(F.col("doc_id").cast("string").alias("path"), "content_hash")
    known = docs.join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("toxic") == 1, F.sha2(F.lit(""), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    gone = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")), F.sha2("text", 256))
    return snapshot.changes(known.union(gone), current)


NAMES = """s AS (SELECT p_partkey AS id, regexp_extract(trim(p_type), '([^.:/\\s]*)$', 1) AS name, concat(p_brand, '/', p_size, '.go') AS path, p_brand AS dir, p_size = 1 AS is_file FROM part),
e AS (SELECT DISTINCT regexp_extract(trim(p_type), '([^.:/\\s]*)$', 1) AS name, concat(p_brand, '/', p_size + 25, '.go') AS path, p_brand AS dir, 0.5::DOUBLE AS confidence FROM part)"""


@query(rf"""WITH {NAMES}, c AS (SELECT e.name, e.path, s.id, 100 * (s.path = e.path)::INT + 25 * (s.dir = e.dir)::INT + 5 * (NOT is_file)::INT AS score, count(*) OVER (PARTITION BY e.name, e.path) AS n FROM e JOIN s USING (name)),
w AS (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY score DESC, id) AS r FROM c)
SELECT e.name, e.path, w.id AS target, CASE WHEN n = 1 THEN 0.95 WHEN n > 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM e LEFT JOIN w ON w.name = e.name AND w.path = e.path AND r = 1""")
def name_resolution(spark, sf_dir):
    """Names to the candidate of the best place."""
    part = read(spark, sf_dir, "part").withColumn("name", T.final_token(F.col("p_type")))
    at = lambda size: F.concat(F.col("p_brand"), F.lit("/"), size.cast("string"), F.lit(".go"))
    symbols = part.select(F.col("p_partkey").alias("id"), "name", at(F.col("p_size")).alias("path"), (F.col("p_size") == 1).alias("is_file"))
    edges = part.select("name", at(F.col("p_size") + 25).alias("path")).distinct().withColumn("confidence", F.lit(0.5))
    return resolve.resolve_names(edges, symbols)


URL_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(rf"""WITH f AS (SELECT page_id AS id, {URL_PATH} AS path FROM pages), p AS (SELECT id, path, string_split(path, '/') AS a FROM f),
x AS (SELECT DISTINCT array_to_string(list_slice(a, i, len(a)), '/') AS suffix, path, id FROM p, unnest(range(1, len(a) + 1)) AS t(i)),
y AS (SELECT suffix, path, id FROM x UNION SELECT regexp_replace(suffix, '\.[^./]+$', ''), path, id FROM x),
w AS (SELECT suffix, min({{'path': path, 'id': id}}) AS w FROM y GROUP BY suffix),
i AS (SELECT id AS page_id, array_to_string(list_slice(a, -2, -1), '/') AS target FROM p)
SELECT page_id, target, w.w.path AS path, w.w.id AS file_id, CASE WHEN w.w IS NOT NULL THEN 0.9::DOUBLE END AS confidence FROM i LEFT JOIN w ON w.suffix = regexp_replace(regexp_replace(target, '^[./]+', ''), '[./]+$', '') WHERE regexp_replace(regexp_replace(target, '^[./]+', ''), '[./]+$', '') <> ''""")
def import_resolution(spark, sf_dir):
    """Two-segment imports to the smallest path with that suffix, by an equi-join."""
    pages = read(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    files = pages.select(F.col("page_id").alias("id"), path.alias("path"))
    parts = F.split("path", "/")
    target = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    return resolve.resolve_imports(files.select(F.col("id").alias("page_id"), target.alias("target")), files)


@query("""WITH r AS (SELECT o_custkey AS path, o_orderkey AS first, o_orderkey + floor(o_totalprice / 100)::BIGINT AS last, o_orderkey AS id FROM orders), p AS (SELECT DISTINCT user_id AS path, event_id AS pos FROM events)
SELECT path, pos, id FROM (SELECT p.path, p.pos, r.id, row_number() OVER (PARTITION BY p.path, p.pos ORDER BY last - first, r.id) AS n FROM p JOIN r ON p.path = r.path AND pos BETWEEN first AND last) WHERE n = 1""")
def position_lookup(spark, sf_dir):
    """The tightest range around a position."""
    orders = read(spark, sf_dir, "orders")
    ranges = orders.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 100)).alias("last"), F.col("o_orderkey").alias("id"))
    points = read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("pos")).distinct()
    return resolve.at_position(points, ranges)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def primary_occurrence(spark, sf_dir):
    """The first occurrence of each symbol by position."""
    first = resolve.primary(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return first.select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM lineitem) AS evidences, (SELECT count(*) FROM embeddings) AS vectors")
def snapshot_counts(spark, sf_dir):
    """A1: scalar counts, one scan each."""
    names = {"files": "documents", "symbols": "part", "evidences": "lineitem", "vectors": "embeddings"}
    parts = [read(spark, sf_dir, t).select(F.lit(k).alias("k")) for k, t in names.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.agg(*[F.sum((F.col("k") == k).cast("long")).alias(k) for k in names])


@query("SELECT l_partkey, l_suppkey, l_returnflag, max(1 - l_discount) AS confidence, count(*) AS evidences FROM lineitem GROUP BY ALL")
def relation_fold(spark, sf_dir):
    """A2, M4: one relation for each key, the highest confidence."""
    rows = read(spark, sf_dir, "lineitem").withColumn("confidence", 1 - F.col("l_discount"))
    return snapshot.relations(rows, ["l_partkey", "l_suppkey", "l_returnflag"])


FACTS = """SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_orderkey AS {string}) WHEN l_orderkey % 8 = 0 THEN '' END AS fact_id, l_linestatus AS source, l_returnflag AS method, concat('f', l_suppkey % 7) AS path, l_linenumber % 2 AS line, 0 AS col, 1 - l_discount AS confidence, l_tax > 0.01 AS version_known, l_linenumber % 2 AS document_version, l_linenumber = 7 AND l_quantity > 40 AS conflict FROM {lineitem}"""


@query(f"""WITH f AS ({FACTS.replace('{lineitem}', 'lineitem').replace('{string}', 'VARCHAR')}), o AS (SELECT l_partkey, CASE WHEN coalesce(fact_id, '') <> '' THEN concat('id', fact_id) ELSE concat('at', source, chr(0), path, chr(0), line, chr(0), col) END AS key, arg_min({{'source': source, 'method': method, 'path': path, 'c': confidence, 'known': version_known, 'v': document_version, 'id': fact_id}}, seq) AS w, bool_or(conflict) AS conflict FROM f GROUP BY l_partkey, key),
k AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n, bool_or(conflict) OVER (PARTITION BY l_partkey) AS any_conflict, row_number() OVER (PARTITION BY l_partkey ORDER BY w.source, w.method, w.path, w.id NULLS FIRST, key) AS place FROM o),
g AS (SELECT l_partkey, count(*) AS support, max(w.c) AS best, bool_or(NOT w.known AND w.v <> 0) AS doubtful, bool_or(any_conflict) AS conflict, max(n) AS n FROM k WHERE place <= 12 GROUP BY l_partkey)
SELECT l_partkey, support, round(CASE WHEN doubtful THEN least(CASE WHEN conflict THEN best * 0.5 ELSE best END, 0.6) WHEN conflict THEN best * 0.5 ELSE best END, 6) AS ranking_confidence, conflict, n > 12 AS truncated FROM g""")
def fact_fusion(spark, sf_dir):
    """Facts of several sources, fused by key; the first 12 in order make the confidence."""
    rows = spark.sql(FACTS.replace("{string}", "STRING"), lineitem=read(spark, sf_dir, "lineitem"))
    return snapshot.fused_facts(rows, ["l_partkey"], most=12).withColumn("ranking_confidence", F.round("ranking_confidence", 6))


@query("""WITH r AS (SELECT l_suppkey AS subject, CASE WHEN l_linenumber > 2 THEN l_partkey END AS object, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, l_orderkey * 10 + l_linenumber AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT subject, lower(name) AS low, min(object) AS found FROM r WHERE object IS NOT NULL GROUP BY ALL)
SELECT r.subject, coalesce(object, found) AS object, CASE WHEN object IS NULL AND found IS NULL THEN name END AS external, evidence FROM r LEFT JOIN k ON k.subject = r.subject AND k.low = lower(r.name)""")
def correlated_calls(spark, sf_dir):
    """Calls known by name alone join the resolved call of the same subject and name."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return snapshot.correlated(lines.select(F.col("l_suppkey").alias("subject"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey")).alias("object"), name.alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence")))


EDGES = """SELECT n_nationkey AS idx, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS kind FROM nation
UNION ALL SELECT 1000 + c_custkey, 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
UNION ALL SELECT 100000000 + o_orderkey, 'c' || o_custkey, 'o' || o_orderkey, 'calls' FROM orders"""


def _edges(spark, sf_dir):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    e = lambda t, base, key, a, src, dst, kind: read(spark, sf_dir, t).select((F.col(key).cast("long") + base).alias("idx"), name(a, src).alias("src"), name(dst, key).alias("dst"), F.lit(kind).alias("kind"))
    return e("nation", 0, "n_nationkey", "r", "n_regionkey", "n", "contains").unionByName(e("customer", 1000, "c_custkey", "n", "c_nationkey", "c", "contains")).unionByName(e("orders", 100_000_000, "o_orderkey", "c", "o_custkey", "o", "calls"))


@query(f"""WITH e AS ({EDGES}), b AS (SELECT idx, src AS a, dst AS b FROM e UNION ALL SELECT idx, dst, src FROM e),
l1 AS (SELECT b AS node, row_number() OVER (ORDER BY min(idx)) AS p FROM b WHERE a = 'r1' AND b <> 'r1' GROUP BY b QUALIFY p <= 39),
l2 AS (SELECT b AS node, row_number() OVER (ORDER BY min((p, idx))) AS q FROM b JOIN l1 ON a = l1.node WHERE b <> 'r1' AND b NOT IN (SELECT node FROM l1) GROUP BY b QUALIFY q <= 39 - (SELECT count(*) FROM l1))
SELECT 'r1' AS node, 0 AS level UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def bounded_neighbourhood(spark, sf_dir):
    """Depth 2, 40 nodes, in edge order."""
    return graph.neighbourhood(_edges(spark, sf_dir), ["r1"])


@query(f"WITH e AS ({EDGES}), x AS (SELECT src AS node, kind FROM e UNION ALL SELECT dst, kind FROM e) SELECT node, count(*) AS degree, count(*) FILTER (kind = 'calls') AS calls FROM x GROUP BY node")
def node_degrees(spark, sf_dir):
    """Degree and call degree."""
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT src AS node FROM e WHERE kind = 'calls' AND src NOT IN (SELECT dst FROM e WHERE kind = 'calls')")
def call_roots(spark, sf_dir):
    """Callers that nothing calls."""
    return graph.roots(_edges(spark, sf_dir))


@query(f"WITH e AS ({EDGES}), s AS (SELECT 'n' || n_nationkey AS node FROM nation), l AS (SELECT idx, CASE WHEN src IN (FROM s) THEN dst ELSE src END AS node, CASE WHEN src IN (FROM s) THEN 'child' ELSE 'parent' END AS relation FROM e WHERE kind = 'contains' AND (src IN (FROM s)) <> (dst IN (FROM s))) SELECT node, max_by(relation, idx) AS relation FROM l GROUP BY node")
def seed_relations(spark, sf_dir):
    """How neighbours stand to the seeds."""
    seeds = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.seed_relations(_edges(spark, sf_dir), seeds)


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, strlen(text)::BIGINT AS size, turn = 0 AS is_target, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS taken, false AS accepted, 0::BIGINT AS size FROM (SELECT DISTINCT conv_id FROM r)
UNION ALL SELECT f.conv_id, r.rank, used + CASE WHEN is_target OR (taken < 4 AND used + r.size <= 600) THEN r.size ELSE 0 END, taken + (is_target OR (taken < 4 AND used + r.size <= 600))::INT, is_target OR (taken < 4 AND used + r.size <= 600), r.size FROM f JOIN r ON r.conv_id = f.conv_id AND r.rank = f.rank + 1)
SELECT conv_id, rank, size, accepted FROM f WHERE rank > 0""")
def evidence_budget(spark, sf_dir):
    """What a byte and count budget admits of each request's ranked evidence."""
    turns = read(spark, sf_dir, "conversations")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).cast("long")
    rows = turns.select("conv_id", rank.alias("rank"), F.octet_length("text").cast("long").alias("size"), (F.col("turn") == 0).alias("is_target"))
    return graph.within_budget(rows, "conv_id", 600, 4).select("conv_id", "rank", "size", "accepted")


@query("SELECT source AS module, count(*) AS files, sum(n_chars)::BIGINT AS symbols, min_by(lang, doc_id) AS language FROM documents GROUP BY source")
def module_rollup(spark, sf_dir):
    """A5: files, symbols and first language of each module."""
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("module")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("symbols"), F.min_by("lang", "doc_id").alias("language"))


@query("SELECT source AS module, lang AS kind, count(*) AS n FROM documents GROUP BY ALL")
def kind_histogram(spark, sf_dir):
    """Kinds in each module."""
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("module"), F.col("lang").alias("kind")).agg(F.count("*").alias("n"))


MERKLE = "l AS (SELECT substr(sha256(concat('files', chr(0), doc_id)), 1, 2) AS bucket, sha256(concat('files', chr(0), doc_id, chr(0), sha256(text))) AS leaf FROM documents), b AS (SELECT bucket, sha256(string_agg(leaf, '' ORDER BY leaf)) AS digest, count(*) AS leaves FROM l GROUP BY bucket)"


def _buckets(spark, sf_dir):
    return snapshot.bucket_digests(read(spark, sf_dir, "documents"), "files", F.col("doc_id").cast("string"), F.sha2("text", 256))


@query(f"WITH {MERKLE} SELECT * FROM b")
def snapshot_buckets(spark, sf_dir):
    """256 bucket digests."""
    return _buckets(spark, sf_dir)


@query(f"WITH {MERKLE} SELECT sha256(string_agg(bucket || ':' || digest, '' ORDER BY bucket)) AS root FROM b")
def snapshot_root(spark, sf_dir):
    """The snapshot's id, whatever the order of rows."""
    return snapshot.root_digest(_buckets(spark, sf_dir))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphan_identities(spark, sf_dir):
    """Identities without an occurrence."""
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return snapshot.orphans(read(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("SELECT conv_id, max(turn) AS turn, max_by(sha256(text), turn) AS content, max(turn) + 1 AS next_revision FROM conversations GROUP BY conv_id")
def artifact_heads(spark, sf_dir):
    """The latest revision of each artifact."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("content"))
    return snapshot.heads(rows, ["conv_id"], "turn")


@query("""WITH d AS (SELECT l_orderkey AS artifact, 'symbol' AS kind, l_partkey AS ref FROM lineitem UNION ALL SELECT l_orderkey, 'file', l_suppkey FROM lineitem), c AS (SELECT 'symbol' AS kind, p_partkey AS ref FROM part WHERE p_size > 40 UNION ALL SELECT 'file', s_suppkey FROM supplier WHERE s_acctbal < 0)
SELECT artifact, string_agg(DISTINCT kind, ',' ORDER BY kind) AS reasons FROM d SEMI JOIN c USING (kind, ref) GROUP BY artifact""")
def artifact_invalidation(spark, sf_dir):
    """Artifacts whose dependencies changed."""
    lines = read(spark, sf_dir, "lineitem")
    deps = lines.select(F.col("l_orderkey").alias("artifact"), F.lit("symbol").alias("kind"), F.col("l_partkey").alias("ref")).union(lines.select("l_orderkey", F.lit("file"), "l_suppkey"))
    changed = read(spark, sf_dir, "part").where("p_size > 40").select(F.lit("symbol").alias("kind"), F.col("p_partkey").alias("ref"))
    return snapshot.stale(deps, changed.union(read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.lit("file"), "s_suppkey")))


@query("""WITH m AS (SELECT user_id AS root, ts, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 8 WHEN 'error' THEN 32 ELSE 16 END AS op FROM events),
k AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM m WHERE op <> 16 WINDOW w AS (PARTITION BY root ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY root ORDER BY ts, event_id) AS sid FROM k)
SELECT root, min(ts) AS started, count(*) AS hints, bit_or(op)::BIGINT AS operations, min(event_id) AS min_sequence, max(event_id) AS max_sequence, CASE WHEN bit_or(op) & 32 <> 0 THEN 'full' WHEN bit_or(op) & 8 <> 0 THEN 'subtree' ELSE 'paths' END AS mode FROM s GROUP BY root, sid""")
def debounced_requests(spark, sf_dir):
    """Sessions of change hints, their operations and scope."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "click", hints.CREATE).when(F.col("event_type") == "purchase", hints.WRITE).when(F.col("event_type") == "signup", hints.RENAME).when(F.col("event_type") == "error", hints.RESCAN).otherwise(hints.CHMOD)
    rows = e.select(F.col("user_id").alias("root"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"), op.cast("long").alias("operations"))
    found = hints.coalesced(hints.meaningful(rows))
    return found.withColumn("mode", hints.scope(F.col("operations"))).withColumn("started", F.col("started").cast("timestamp_ntz"))


HINTS = """SELECT user_id % 4 AS root, ts, event_id AS sequence, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 8 ELSE 2 END WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 32 ELSE 4 END ELSE 16 END AS operations,
CASE WHEN event_id % 97 = 0 THEN 'src/.gitignore' ELSE concat(CASE WHEN event_id % 5 = 0 THEN 'lib' ELSE 'src' END, '/', user_id % 3, '/', event_id % 4, '.go') END AS path, CASE WHEN event_id % 11 = 0 THEN 'file' ELSE 'unknown' END AS kind, CASE WHEN event_id % 7 = 0 THEN 'editor' ELSE '' END AS reason FROM {events}"""
#: Requests in DuckDB: row after row of each root, with the times of its first and last hint.
NUMBERED_HINTS = f"""h AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts, sequence) AS n FROM ({HINTS.replace('{events}', 'events')}) WHERE operations <> 16),
d AS (SELECT root, n, ts AS first, ts AS last, 1::BIGINT AS request FROM h WHERE n = 1 UNION ALL
SELECT h.root, h.n, CASE WHEN h.ts >= last + INTERVAL 10 MINUTE OR h.ts >= first + INTERVAL 30 MINUTE THEN h.ts ELSE first END, h.ts, request + CASE WHEN h.ts >= last + INTERVAL 10 MINUTE OR h.ts >= first + INTERVAL 30 MINUTE THEN 1 ELSE 0 END FROM d JOIN h ON h.root = d.root AND h.n = d.n + 1),
p AS (SELECT h.root, request, path, bit_or(operations) AS operations, coalesce(arg_min(kind, sequence) FILTER (kind <> 'unknown'), 'unknown') AS kind, coalesce(arg_min(reason, sequence) FILTER (reason <> ''), '') AS reason, min(sequence) AS sequence FROM h JOIN d USING (root, n) GROUP BY h.root, request, path)"""


def _requests(spark, sf_dir):
    rows = spark.sql(HINTS, events=read(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return hints.coalesced_paths(hints.requests(hints.meaningful(rows), 600, 1800))


@query(f"WITH RECURSIVE {NUMBERED_HINTS} SELECT root, request, path, operations::BIGINT AS operations, kind, reason, sequence FROM p")
def coalesced_hints(spark, sf_dir):
    """Hints by path in requests that a quiet time or the longest delay ends."""
    return _requests(spark, sf_dir).withColumn("operations", F.col("operations").cast("long"))


@query(f"""WITH RECURSIVE {NUMBERED_HINTS}, q AS (SELECT root, request, bool_or(operations & 32 <> 0 OR path = '.gitignore') AS f, bool_or(operations & 8 <> 0 OR kind = 'directory' OR path LIKE '%/.gitignore') AS w, count(DISTINCT split_part(path, '/', 1)) AS tops, min(split_part(path, '/', 1)) AS top,
count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs, min(regexp_replace(path, '/[^/]*$', '')) AS dir, min(sequence) AS min_sequence, max(sequence) AS max_sequence, count(*) AS paths FROM p GROUP BY root, request),
m AS (SELECT *, CASE WHEN f OR (w AND tops > 1) THEN 'full' WHEN w THEN 'subtree' ELSE 'paths' END AS mode FROM q)
SELECT root, request, min_sequence, max_sequence, paths, mode, CASE WHEN mode = 'subtree' THEN CASE WHEN dirs = 1 THEN dir ELSE top END ELSE '' END AS common FROM m""")
def reconcile_scopes(spark, sf_dir):
    """Whether a request takes paths, a subtree below their common directory, or everything."""
    return hints.scopes(_requests(spark, sf_dir))


@query(f"""WITH RECURSIVE {NUMBERED_HINTS}, q AS (SELECT root, request, least(max(last) + INTERVAL 10 MINUTE, min(first) + INTERVAL 30 MINUTE) AS close FROM d GROUP BY root, request)
SELECT root, request, path, operations::INT AS operations, kind, reason, sequence FROM p SEMI JOIN (SELECT root, request FROM q WHERE close <= (SELECT max(ts) FROM h)) USING (root, request)""")
def streamed_requests(spark, sf_dir):
    """The requests that a stream of hints has given out once it has read the table."""
    folder = f"{shared_folder(spark)}/tessera-runs/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    # a pattern, as a stream takes a single file by one only; a folder of files matches too
    events = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    rows = spark.sql(HINTS, events=events).withColumn("ts", F.col("ts").cast("timestamp"))
    found = debounce.stream_requests(rows, 600, 1800, settle=0, late=3600, buffer=100_000)
    writer = found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    out = cut(spark.read.schema(found.schema).parquet(f"{folder}/out"))
    Files(spark).remove(folder)
    return out
