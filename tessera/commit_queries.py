"""Registered queries over commits: change sets, versions of tables, and an index that follows them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.code_queries import EDG, FIL, SYM, _edges, _files, _symbols, duck, sql
from tessera.operators import retrieval
from tessera.operators import overlay, resolve
from tessera.operators.commits import Change, Conflict, Store, diagnostics
from tessera.operators.index import Index
from tessera.operators.lineage import cut, shared_folder
from tessera.queries import TERMS, _tokens, query, read

TABLES = {"files": "path string, language string, hash string", "symbols": "path string, id long, occurrence string, name string", "edges": "path string, src long, dst long, kind string, line int"}


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-runs/{name}-{uuid.uuid4().hex}"


def _bm25(documents: str) -> str:
    """BM25 over a table of (doc_id, text) in DuckDB."""
    return rf"""ix AS (SELECT doc_id, {_tokens("text")} AS t FROM {documents}),
c AS (SELECT doc_id, len(t) AS len, list_transform({TERMS}, lambda q: len(list_filter(t, lambda x: x = q))) AS tf FROM ix),
s AS (SELECT count(*) AS n, greatest(avg(len), 1.0) AS a, {", ".join(f"count(*) FILTER (tf[{i}] > 0) AS df{i}" for i in (1, 2, 3))} FROM c),
r AS (SELECT doc_id, {" + ".join(f"CASE WHEN tf[{i}] > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf[{i}] * 2.5 / (tf[{i}] + 1.5 * (0.25 + 0.75 * len / a)) ELSE 0 END" for i in (1, 2, 3))} AS score
  FROM c, s WHERE tf[1] + tf[2] + tf[3] > 0)"""


@query(f"""WITH one AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN concat('Idiot ', doc_id % 7, ' worthlessThand ', substr(text, 1, 200)) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
two AS (SELECT doc_id, CASE WHEN doc_id % 15 = 1 THEN 'gone quiet' ELSE text END AS text FROM one WHERE doc_id % 15 <> 2 UNION ALL SELECT 1000000000 + item_id, concat(text, CASE WHEN item_id % 4 = 0 THEN ' thand' ELSE '' END) FROM benchmark),
{_bm25("two")} SELECT doc_id, round(score, 6) AS score FROM r""")
def index_after_commits(spark, sf_dir):
    """M5: scores from a kept index that two commits changed, equal to those of one made anew."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = Index(spark, _folder(spark, "index"), {"text": 1}, "doc_id")
    index.apply(docs)
    changed = docs.where("doc_id % 5 = 1").withColumn("text", F.expr("concat('Idiot ', doc_id % 7, ' worthlessThand ', substr(text, 1, 200))"))
    index.apply(changed, docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id")))
    items = read(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.expr("concat(text, CASE WHEN item_id % 4 = 0 THEN ' thand' ELSE '' END)").alias("text"))
    quiet = docs.where("doc_id % 15 = 1").withColumn("text", F.lit("gone quiet"))
    index.apply(quiet.unionByName(items), docs.where("doc_id % 15 = 2").select(F.col("doc_id").alias("id")))
    found = cut(index.bm25(TERMS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")))
    index.remove()
    return found


FAULTY = {
    "files": f"SELECT path FROM ({{FILES}}) WHERE path NOT LIKE 'vendor%' UNION ALL SELECT path FROM ({{FILES}}) WHERE path LIKE 'web/1%' UNION ALL SELECT concat('./', path) FROM ({{FILES}}) WHERE path LIKE 'cmd/api/1%' UNION ALL SELECT concat('a/../../', path) FROM ({{FILES}}) WHERE path LIKE 'cmd/api/2%'",
    "deleted": "SELECT path FROM ({FILES}) WHERE path LIKE 'web/tests/2%' UNION ALL SELECT concat('/', path) FROM ({FILES}) WHERE path LIKE 'web/3%'",
    "symbols": "SELECT CASE WHEN id % 97 = 0 THEN 'nowhere.go' ELSE path END AS path, CASE WHEN id % 31 = 0 THEN id - 2 WHEN id % 37 = 0 THEN id - 1 ELSE id END AS id, CASE WHEN id % 2 = 0 THEN concat('o', CASE WHEN id % 12 = 0 THEN id - 2 ELSE id END) END AS occurrence FROM ({SYMBOLS}) WHERE path NOT LIKE 'vendor%'",
}


def _faulty(name: str) -> str:
    from tessera.code_queries import FILES, SYMBOLS

    return FAULTY[name].replace("{FILES}", FILES).replace("{SYMBOLS}", SYMBOLS)


@query(f"""WITH f AS ({duck(_faulty("files"))}), d AS ({duck(_faulty("deleted"))}), s AS ({duck(_faulty("symbols"))}),
v AS (SELECT vec_id * 2 AS id, CASE WHEN vec_id % 50 = 0 THEN NULL WHEN vec_id % 51 = 0 THEN embedding[1:3] ELSE embedding END AS vector FROM embeddings),
bad AS (SELECT path FROM f UNION ALL SELECT path FROM d)
SELECT 'path_invalid' AS code, path, '' AS ref FROM bad WHERE path LIKE './%' OR path LIKE '/%' OR path LIKE '%..%'
UNION ALL SELECT 'duplicate_upsert', path, '' FROM f GROUP BY path HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'upsert_delete_conflict', path, '' FROM d SEMI JOIN f USING (path)
UNION ALL SELECT 'symbol_path_mismatch', path, id::VARCHAR FROM s ANTI JOIN f USING (path)
UNION ALL SELECT 'duplicate_symbol_id', min(path), id::VARCHAR FROM s GROUP BY id HAVING count(*) FILTER (occurrence IS NULL) > 1 OR (count(*) FILTER (occurrence IS NULL) > 0 AND count(occurrence) > 0)
UNION ALL SELECT 'duplicate_occurrence', min(path), occurrence FROM s WHERE occurrence IS NOT NULL GROUP BY occurrence HAVING count(*) > 1
UNION ALL SELECT 'embedding_unknown_symbol', '', id::VARCHAR FROM v ANTI JOIN s USING (id)
UNION ALL SELECT 'embedding_invalid_vector', '', id::VARCHAR FROM v WHERE vector IS NULL
UNION ALL SELECT 'embedding_dimension_mismatch', '', '' FROM v HAVING min(len(vector)) <> max(len(vector))""")
def changeset_diagnostics(spark, sf_dir):
    """Every fault that forbids a change set."""
    frames = {n: sql(spark, sf_dir, _faulty(n), "part") for n in FAULTY}
    vectors = read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("id"), F.expr("CASE WHEN vec_id % 50 = 0 THEN NULL WHEN vec_id % 51 = 0 THEN slice(embedding, 1, 3) ELSE embedding END").alias("vector"))
    return diagnostics(Change({"files": frames["files"], "symbols": frames["symbols"], "embeddings": vectors}, frames["deleted"]))


def _committed(spark, sf_dir) -> Store:
    """Four commits, one of which loses a race: everything; half of web replaced and vendor gone; and a part of cmd gone."""
    files, symbols = _files(spark, sf_dir).select("path", "language", "hash"), _symbols(spark, sf_dir).select("path", "id", F.concat(F.lit("o"), F.col("id").cast("string")).alias("occurrence"), "name")
    edges = _edges(spark, sf_dir).select("path", "src", "dst", "kind", "line").join(files.select("path"), "path", "left_semi")
    store = Store(spark, _folder(spark, "store"), TABLES, digits=1)
    first = store.commit(Change({"files": files, "symbols": symbols, "edges": edges}), 0)
    web = "path LIKE 'web/%'"
    half = symbols.where(f"{web} AND id % 2 = 0").withColumn("name", F.upper("name"))
    change = Change({"files": files.where(web), "symbols": half}, files.where("path LIKE 'vendor/%'").select("path"))
    loser = Change({}, files.where("path LIKE 'cmd/api/1%'").select("path"))
    second = store.commit(change, first["revision"])
    try:
        store.commit(loser, first["revision"])
        raise AssertionError("a commit on an old revision went through")
    except Conflict:
        store.commit(loser, second["revision"])
    return store


AFTER = f"""SELECT 'symbol' AS part, path, id, CASE WHEN path LIKE 'web/%' THEN upper(name) ELSE name END AS label FROM {SYM} WHERE path NOT LIKE 'vendor/%' AND path NOT LIKE 'cmd/api/1%' AND (path NOT LIKE 'web/%' OR id % 2 = 0)
UNION ALL SELECT 'edge', path, src, concat(kind, ':', line) FROM {EDG} WHERE path IN (SELECT path FROM {FIL}) AND path NOT LIKE 'cmd/api/1%'
UNION ALL SELECT 'file', path, NULL, language FROM {FIL} WHERE path NOT LIKE 'vendor/%' AND path NOT LIKE 'cmd/api/1%'"""


def _rows(store: Store, revision: int | None = None) -> DataFrame:
    symbols = store.table("symbols", revision).select(F.lit("symbol").alias("part"), "path", "id", F.col("name").alias("label"))
    edges = store.table("edges", revision).select(F.lit("edge"), "path", "src", F.concat("kind", F.lit(":"), F.col("line").cast("string")))
    return symbols.union(edges).union(store.table("files", revision).select(F.lit("file"), "path", F.lit(None), "language"))


@query(AFTER)
def committed_rows(spark, sf_dir):
    """The rows of the newest revision after commits of which one met a conflict and was made again."""
    store = _committed(spark, sf_dir)
    found = cut(_rows(store))
    store.remove()
    return found


@query(f"""WITH before AS (SELECT path, hash, language FROM {FIL}), after AS (SELECT path, hash, language FROM {FIL} WHERE path NOT LIKE 'vendor/%' AND path NOT LIKE 'cmd/api/1%'),
s AS (SELECT path, count(*) AS n, sum(CASE WHEN path NOT LIKE 'web/%' OR id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS m FROM {SYM} GROUP BY path)
SELECT b.path, s.n AS symbols_before, CASE WHEN a.path IS NULL THEN NULL WHEN s.m > 0 THEN s.m END AS symbols_after, a.path IS NULL AS gone FROM before b LEFT JOIN after a USING (path) LEFT JOIN s ON s.path = b.path""")
def revision_changes(spark, sf_dir):
    """What lies between two revisions that are both still readable."""
    store = _committed(spark, sf_dir)
    count = lambda revision, name: store.table("symbols", revision).groupBy("path").agg(F.count("*").alias(name))
    head = store.head()["revision"]
    now = store.table("files", head).select("path", F.lit(False).alias("here"))
    out = store.table("files", 1).select("path").join(count(1, "symbols_before"), "path", "left").join(count(head, "symbols_after"), "path", "left").join(now, "path", "left")
    found = cut(out.select("path", "symbols_before", "symbols_after", F.coalesce("here", F.lit(True)).alias("gone")))
    store.remove()
    return found


#: Symbols by name, edges to names, and three open buffers: one drops its symbols, one renames them, one adds new ones.
OPEN = ("cmd/api/3.go", "web/7.go", "internal/store/1.go")
VIEW_SYMBOLS = "SELECT id, concat(name, id % 37) AS name, path, kind = 'file' AS is_file FROM ({SYMBOLS})"
VIEW_EDGES = "SELECT DISTINCT concat(name, id % 41) AS name, concat(CASE id % 3 WHEN 0 THEN 'cmd/api' WHEN 1 THEN 'web' ELSE 'internal/store' END, '/', id % 40, '.go') AS path, round(0.5 + id % 4 * 0.1, 1) AS given FROM ({SYMBOLS})"
BUFFERS = "SELECT CASE WHEN path = 'web/7.go' THEN id ELSE id + 900000 END AS id, CASE WHEN path = 'web/7.go' AND id % 2 = 0 THEN concat(name, 'x') ELSE concat(name, id % 37) END AS name, path, kind = 'file' AS is_file FROM ({SYMBOLS}) WHERE path IN ('web/7.go', 'internal/store/1.go')"


def _view(name: str) -> str:
    from tessera.code_queries import SYMBOLS

    return name.replace("{SYMBOLS}", SYMBOLS)


@query(f"""WITH s AS ({duck(_view(VIEW_SYMBOLS))}), b AS ({duck(_view(BUFFERS))}), v AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM s WHERE path NOT IN {OPEN} UNION ALL SELECT *, regexp_replace(path, '/[^/]*$', '') FROM b),
e AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM ({duck(_view(VIEW_EDGES))}) WHERE path NOT IN {OPEN} UNION ALL SELECT 'call1', 'web/7.go', 0.6, 'web' UNION ALL SELECT 'ring5x', 'web/7.go', 0.6, 'web'),
c AS (SELECT e.name, e.path, e.given, v.id, 100 * (v.path = e.path)::INT + 25 * (v.dir = e.dir)::INT + 5 * (NOT is_file)::INT AS score, count(*) OVER (PARTITION BY e.name, e.path, e.given) AS n FROM e JOIN v USING (name)),
w AS (SELECT *, row_number() OVER (PARTITION BY name, path, given ORDER BY score DESC, id) AS r FROM c)
SELECT e.name, e.path, e.given::DOUBLE AS given, w.id AS target, CASE WHEN n = 1 THEN 0.95 WHEN n > 1 THEN greatest(e.given, 0.7) ELSE e.given END::DOUBLE AS confidence FROM e LEFT JOIN w ON w.name = e.name AND w.path = e.path AND w.given = e.given AND r = 1""")
def overlay_edges(spark, sf_dir):
    """Edges of a view with open buffers, of which only those are resolved again whose names change."""
    symbols, edges, buffers = (sql(spark, sf_dir, _view(x), "part") for x in (VIEW_SYMBOLS, VIEW_EDGES, BUFFERS))
    edges = edges.withColumn("given", F.col("given").cast("double"))
    resolved = cut(resolve.resolve_names(edges.withColumn("confidence", F.col("given")), symbols))
    paths = spark.createDataFrame([(p,) for p in OPEN], "path string")
    own = spark.createDataFrame([("call1", "web/7.go", 0.6), ("ring5x", "web/7.go", 0.6)], "name string, path string, given double")
    return overlay.resolved_view(resolved, symbols, paths, buffers, own)[1].select("name", "path", "given", "target", "confidence")


OVERLAYS = "SELECT concat('doc', l_orderkey) AS document, concat(CASE l_linenumber % 2 WHEN 0 THEN 'web' ELSE 'gone' END, '/', l_partkey % 50, '.go') AS path, l_linenumber AS version, l_returnflag AS content_hash, CASE l_suppkey % 3 WHEN 0 THEN 'snap:now' WHEN 1 THEN 'snap:old' ELSE '' END AS base_snapshot, CASE WHEN l_suppkey % 2 = 0 THEN 'other' ELSE '' END AS base_hash FROM {lineitem}"


@query(f"""WITH o AS ({duck(OVERLAYS)}), j AS (SELECT o.*, CASE WHEN base_snapshot NOT IN ('', 'snap:now') THEN CASE WHEN coalesce(f.hash, '') <> '' AND base_hash <> '' AND f.hash <> base_hash THEN 'stale' ELSE 'rebased' END ELSE 'current' END AS state FROM o LEFT JOIN {FIL} f USING (path))
SELECT *, CASE WHEN state <> 'stale' THEN concat('view:', sha256(concat('snap:now', chr(0), document, chr(0), path, chr(0), version, chr(0), content_hash))) END AS view FROM j""")
def composite_views(spark, sf_dir):
    """M8: whether buffers still fit the newest snapshot, and the hash of each view."""
    return overlay.composite_states(sql(spark, sf_dir, OVERLAYS, "lineitem"), _files(spark, sf_dir), "snap:now")
