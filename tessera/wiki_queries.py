"""Registered queries over page manifests, canonical packs and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.code_queries import CANDIDATES, FIL, NUM, _files, _numbered, _symbols, duck, sql
from tessera.operators import canonical, wiki
from tessera.queries import query, read
from tessera.sources import reconcile

#: Symbols spread over more modules than a manifest has pages, with layers in their names.
SPREAD = """SELECT p_partkey AS id, concat(CASE p_partkey % 15 WHEN 0 THEN 'cmd/api' WHEN 1 THEN 'internal/Store X' WHEN 2 THEN 'web/app' WHEN 3 THEN 'apps/shop' ELSE concat('lib', p_partkey % 15) END, '/', CASE p_size % 9 WHEN 0 THEN 'order_model' WHEN 1 THEN 'UserService' WHEN 2 THEN 'store_repository' WHEN 3 THEN 'http_route' WHEN 4 THEN 'entity_types_test' ELSE 'main' END, '.', CASE WHEN p_partkey % 15 = 4 THEN 'js' ELSE 'go' END) AS path,
CASE p_partkey % 15 WHEN 0 THEN 'cmd/api' WHEN 1 THEN 'internal/Store X' WHEN 2 THEN 'web' WHEN 3 THEN 'apps/shop' ELSE concat('lib', p_partkey % 15) END AS module, CASE WHEN p_partkey % 15 = 4 THEN 'javascript' ELSE 'go' END AS language FROM {part} WHERE p_partkey % 15 < {below}"""
SLUG = "concat('module-', regexp_replace(regexp_replace(lower(module), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))"
FRONT = "(contains(language, 'script') OR starts_with(module, 'web') OR starts_with(module, 'frontend') OR starts_with(module, 'apps/'))"


def _layer_sql() -> str:
    return " UNION ALL ".join(f"SELECT module, {i} AS layer, path FROM fl WHERE NOT regexp_matches(lower(path), '(^|/)(test|tests|__tests__)/') AND NOT lower(path) LIKE '%\\_test.go' ESCAPE '\\' AND ({' OR '.join(f'contains(b, {k!r})' for k in keys)})" for i, (_, _, keys) in enumerate(wiki.LAYERS, 1))


def _case(at: int) -> str:
    return "CASE layer " + " ".join(f"WHEN {i} THEN '{x[at]}'" for i, x in enumerate(wiki.LAYERS, 1)) + " END"


def _manifest_sql(below: int) -> str:
    return f"""s AS ({duck(SPREAD).replace('{below}', str(below))}), fl AS (SELECT DISTINCT module, path, lower(regexp_extract(path, '([^/]*)$', 1)) AS b FROM s), t AS (SELECT DISTINCT path FROM s WHERE contains(lower(path), '_test.')),
m AS (SELECT module, min(language) AS language FROM s GROUP BY module), ly AS ({_layer_sql()}),
o AS (SELECT *, {SLUG} AS mod, row_number() OVER (ORDER BY {SLUG}, module) + 2 AS section, CASE WHEN {FRONT} THEN 'frontend' ELSE 'backend' END AS side FROM m), n AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) > 0 FROM t) AS tested),
e AS (SELECT 0 AS section, 0 AS layer, 'overview' AS slug, 'Overview' AS title, 'overview' AS kind, '' AS parent, '' AS module UNION ALL SELECT 1, 0, '1-getting-started', 'Getting started', 'getting-started', 'overview', '' UNION ALL SELECT 2, 0, '2-architecture-overview', 'Architecture overview', 'architecture-overview', 'overview', ''
UNION ALL SELECT section, 0, concat(section, '-', side, '-', substr(mod, 8)), concat(CASE side WHEN 'frontend' THEN 'Frontend' ELSE 'Backend' END, ': ', module), CASE side WHEN 'frontend' THEN 'frontend' ELSE 'module' END, 'overview', mod FROM o
UNION ALL SELECT section, layer, concat(section, '.', layer, '-', {_case(0)}), {_case(1)}, 'layer', concat(section, '-', side, '-', substr(mod, 8)), mod FROM (SELECT DISTINCT module, layer FROM ly) JOIN o USING (module) WHERE side = 'backend'
UNION ALL SELECT n + 3, 0, concat(n + 3, '-testing'), 'Testing', 'testing', 'overview', '' FROM n WHERE tested UNION ALL SELECT n + 3 + tested::INT, 0, concat(n + 3 + tested::INT, '-glossary'), 'Glossary', 'glossary', 'overview', '' FROM n),
pages AS (SELECT row_number() OVER (ORDER BY section, layer, slug) - 1 AS place, layer, slug, title, kind, parent, module FROM e QUALIFY place < 25)"""


def _tables(spark, sf_dir, below: int):
    symbols = sql(spark, sf_dir, SPREAD.replace("{below}", str(below)), "part")
    modules = symbols.groupBy("module").agg(F.min("language").alias("language"), (F.col("module") == "cmd/api").alias("entrypoint"))
    return modules, symbols.select("module", "path").distinct(), symbols.where(F.contains(F.lower("path"), F.lit("_test."))).select("path").distinct()


@query(f"WITH {_manifest_sql(15)} SELECT place, slug, title, kind, parent, module FROM pages")
def wiki_manifest(spark, sf_dir):
    """The pages of a collection with more modules than there may be pages."""
    modules, files, tests = _tables(spark, sf_dir, 15)
    return wiki.manifest(modules, files, tests)


@query(f"""WITH {_manifest_sql(5)}, every AS (SELECT DISTINCT path FROM fl) SELECT slug, path FROM pages, every WHERE kind IN ('overview', 'architecture-overview', 'glossary')
UNION ALL SELECT DISTINCT slug, path FROM pages p JOIN fl ON {SLUG.replace('module)', 'fl.module)')} = p.module WHERE kind IN ('module', 'frontend') UNION ALL SELECT DISTINCT slug, path FROM pages p JOIN ly ON {SLUG.replace('module)', 'ly.module)')} = p.module AND ly.layer = p.layer WHERE kind = 'layer'
UNION ALL SELECT slug, path FROM pages, (SELECT DISTINCT path FROM fl WHERE module = 'cmd/api') WHERE kind = 'getting-started' UNION ALL SELECT slug, path FROM pages, t WHERE kind = 'testing'""")
def wiki_scopes(spark, sf_dir):
    """The files that each page of a collection covers."""
    modules, files, tests = _tables(spark, sf_dir, 5)
    return wiki.manifest_scopes(wiki.manifest(modules, files, tests), modules, files, tests, files.select("path").limit(0))


EVIDENCE_ID = "concat('ev:', substr(sha256(concat(kind, chr(0), path, chr(0), line, ':0-', line, ':9', chr(0), symbol_id, chr(0), '', chr(0), sha256(content))), 1, 20))"


def _evidence(spark, sf_dir):
    rows = sql(spark, sf_dir, CANDIDATES, "lineitem")
    place = F.concat(F.col("line").cast("string"), F.lit(":0-"), F.col("line").cast("string"), F.lit(":9"))
    found = rows.withColumn("hash", F.sha2("content", 256)).withColumn("id", canonical.evidence_id(F.col("kind"), F.col("path"), place, F.col("symbol_id"), F.lit(None), F.col("hash")))
    return found.groupBy("request", "id").agg(F.max("confidence").alias("relevance"), F.min("hash").alias("hash"))


@query(f"SELECT request, {EVIDENCE_ID} AS id, max(confidence) AS relevance FROM ({duck(CANDIDATES)}) GROUP BY ALL")
def evidence_ids(spark, sf_dir):
    """Ids of evidence by what it refers to."""
    return _evidence(spark, sf_dir).select("request", "id", "relevance")


FALLING = "printf('%012d', (1000000000 - round(relevance * 1000000000))::BIGINT)"


@query(f"""WITH c AS (SELECT request, {EVIDENCE_ID} AS id, max(confidence) AS relevance, min(sha256(content)) AS hash FROM ({duck(CANDIDATES)}) GROUP BY ALL), g AS (SELECT DISTINCT src % 60 AS request, src::VARCHAR AS src, dst::VARCHAR AS dst, kind FROM {NUM} WHERE dst IS NOT NULL AND seq % 9 = 0),
l AS (SELECT DISTINCT request, 0 AS part, '' AS o, concat('0:1', chr(0), 'hover', chr(0), chr(0), 'v1') AS line FROM c UNION ALL SELECT request, 1, concat({FALLING}, chr(0), id), concat('1:', id, chr(0), {FALLING}, chr(0), hash) FROM c
UNION ALL SELECT g.request, 2, concat(src, chr(0), dst, chr(0), kind), concat('2:', src, chr(0), dst, chr(0), kind) FROM g SEMI JOIN c ON c.request = g.request UNION ALL SELECT DISTINCT request, 3, concat('budget', chr(0), request), concat('3:budget', chr(0), request) FROM c),
h AS (SELECT request AS pack, sha256(string_agg(line, chr(10) ORDER BY part, o, line)) AS d FROM l GROUP BY request) SELECT pack, concat('sha256:', d) AS hash, concat('ctxpack:', substr(d, 1, 16)) AS id FROM h""")
def pack_hashes(spark, sf_dir):
    """The hash and id of each pack, whatever the order of its evidence, edges and omissions."""
    evidence = _evidence(spark, sf_dir).select(F.col("request").alias("pack"), F.col("id").alias("evidence_id"), "relevance", F.col("hash").alias("content_hash"))
    packs = evidence.select("pack").distinct().select("pack", F.lit("hover").alias("feature"), F.lit("").alias("target"), F.lit("v1").alias("policy"))
    edges = _numbered(spark, sf_dir).where("dst IS NOT NULL AND seq % 9 = 0").select((F.col("src") % 60).alias("pack"), "src", "dst", "kind").distinct().join(packs.select("pack"), "pack", "left_semi")
    return canonical.pack_hashes(packs, evidence, edges, packs.select("pack", F.lit("budget").alias("reason"), F.col("pack").cast("string").alias("ref")))


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey AS artifact, CASE WHEN l_linenumber % 2 = 0 THEN 'symbol' ELSE 'file' END AS kind, l_partkey % 9 AS symbol, concat('f', l_suppkey % 5) AS path, sha256(l_returnflag) AS content_hash FROM lineitem)
SELECT artifact, concat('ctx:', substr(sha256(string_agg(concat(kind, chr(0), symbol, chr(0), content_hash, chr(0)), '' ORDER BY kind, symbol, content_hash, path)), 1, 32)) AS hash FROM d GROUP BY artifact""")
def context_hashes(spark, sf_dir):
    """The hash of an artifact's dependencies in order."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("artifact"), F.when(F.col("l_linenumber") % 2 == 0, "symbol").otherwise("file").alias("kind"), (F.col("l_partkey") % 9).alias("symbol"), F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("path"), F.sha2("l_returnflag", 256).alias("content_hash"))
    return canonical.dependency_hashes(rows, "artifact")


MERGED = "SELECT l_orderkey AS request, l_linenumber AS seq, CASE WHEN l_partkey % 7 = 0 THEN 'type' WHEN l_partkey % 7 = 1 THEN 'calls' ELSE '' END AS relation, round(1 - l_discount / 3, 4) AS relevance, l_suppkey % 3 = 0 AS semantic FROM {lineitem}"


@query(f"""WITH r AS ({duck(MERGED)}), p AS (SELECT DISTINCT request FROM r WHERE semantic AND relation = 'type')
SELECT request, seq, relation, semantic, CASE WHEN semantic THEN CASE WHEN relation = 'type' THEN 1.0 ELSE least(relevance, 0.7) END WHEN request IN (SELECT request FROM p) THEN least(relevance, 0.99) ELSE relevance END::DOUBLE AS relevance FROM r""")
def semantic_merge(spark, sf_dir):
    """Semantic evidence among ranked candidates, types first."""
    rows = sql(spark, sf_dir, MERGED, "lineitem")
    return canonical.with_semantic(rows.where("NOT semantic").drop("semantic"), rows.where("semantic").drop("semantic"))


#: What was known, and what lies on disk: files changed, gone, new, unreadable, too large, ignored or of no known kind.
KNOWN = f"SELECT path, hash AS content_hash FROM {FIL} UNION ALL SELECT unnest(['docs/notes.txt', 'web/node_modules/a.go', 'web/gen/x.go', 'cmd/api/tree/a.go', 'cmd/api/tree/b.go', 'README.md']), 'old'"
OBSERVED = f"""SELECT path, CASE WHEN path LIKE '%/7.go' OR path LIKE '%/17.go' THEN NULL WHEN path LIKE '%2%' THEN sha256(concat(path, 'x')) ELSE hash END AS content_hash, CASE WHEN path LIKE '%/9.go' THEN 3000000 ELSE 10 END AS size FROM {FIL} WHERE path NOT LIKE '%3.go'
UNION ALL SELECT unnest(['docs/notes.txt', 'web/node_modules/a.go', 'web/gen/x.go', 'cmd/api/tree', 'README.md', 'web/fresh.py', 'web/gen/new.go', 'web/fresh.bin']), 'new', 10"""


def _scanned(spark, sf_dir):
    files = _files(spark, sf_dir)
    extra = lambda names, mark: spark.createDataFrame([(n, mark) for n in names], "path string, content_hash string")
    known = files.select("path", F.col("hash").alias("content_hash")).unionByName(extra(["docs/notes.txt", "web/node_modules/a.go", "web/gen/x.go", "cmd/api/tree/a.go", "cmd/api/tree/b.go", "README.md"], "old"))
    p = F.col("path")
    there = files.where(~p.like("%3.go")).select("path", F.when(p.like("%/7.go") | p.like("%/17.go"), None).when(p.like("%2%"), F.sha2(F.concat("path", F.lit("x")), 256)).otherwise(F.col("hash")).alias("content_hash"), F.when(p.like("%/9.go"), 3_000_000).otherwise(10).alias("size"))
    new = extra(["docs/notes.txt", "web/node_modules/a.go", "web/gen/x.go", "cmd/api/tree", "README.md", "web/fresh.py", "web/gen/new.go", "web/fresh.bin"], "new").withColumn("size", F.lit(10))
    return known, there.unionByName(new)


def _scan_sql(scope: str = "true") -> str:
    ignored = "(list_has_any(string_split({p}, '/'), ['vendor', 'node_modules']) OR regexp_matches({p}, '(^|/)gen(/|$)'))"
    kind = "(regexp_matches({p}, '\\.(go|py)$') OR lower({p}) = 'readme.md' OR lower({p}) LIKE '%/readme.md')"
    return f"""k AS (SELECT * FROM ({KNOWN}) WHERE {scope}), o AS (SELECT *, true AS here FROM ({OBSERVED}) WHERE {scope} AND NOT {ignored.format(p='path')} AND {kind.format(p='path')} AND size <= 2097152),
j AS (SELECT coalesce(k.path, o.path) AS path, k.path IS NOT NULL AS had, o.here, k.content_hash AS old, o.content_hash AS new FROM k FULL JOIN o ON k.path = o.path),
c AS (SELECT path, CASE WHEN here IS NULL THEN 'deleted' WHEN new IS NULL THEN NULL WHEN NOT had THEN 'added' WHEN old IS DISTINCT FROM new THEN 'changed' END AS change, CASE WHEN here IS NULL THEN CASE WHEN {ignored.format(p='path')} THEN 'became_ignored' WHEN NOT {kind.format(p='path')} THEN 'became_unsupported' ELSE 'removed' END ELSE '' END AS reason FROM j)"""


@query(f"WITH {_scan_sql()} SELECT * FROM c WHERE change IS NOT NULL")
def scan_changes(spark, sf_dir):
    """What a full scan changes, and why files go."""
    return reconcile.reconcile(*_scanned(spark, sf_dir), ["gen"])


ASKED = ("web/2.go", "web/3.go", "cmd/api/20.go", "docs/notes.txt", "web/fresh.py", "web/nothing.go")


@query(f"WITH {_scan_sql(f'path IN {ASKED}')} SELECT * FROM c WHERE change IS NOT NULL")
def list_scan(spark, sf_dir):
    """What a scan of listed paths changes."""
    return reconcile.reconcile(*_scanned(spark, sf_dir), ["gen"], paths=spark.createDataFrame([(p,) for p in ASKED], "path string"))


SUBTREE = "(path = 'cmd/api' OR path LIKE 'cmd/api/%')"


@query(f"WITH {_scan_sql(SUBTREE)} SELECT path, CASE WHEN bad THEN 'quarantined' ELSE change END AS change, CASE WHEN bad THEN 'odd' ELSE reason END AS reason FROM (SELECT *, change <> 'deleted' AND path LIKE '%/2_.go' AS bad FROM c WHERE change IS NOT NULL)")
def subtree_scan(spark, sf_dir):
    """What a scan of a subtree changes, a directory that became a file, and files that can't be parsed."""
    changes = reconcile.reconcile(*_scanned(spark, sf_dir), ["gen"], subtree="cmd/api")
    failed = _symbols(spark, sf_dir).where("path LIKE '%/2_.go'").select("path", F.lit("odd").alias("error"))
    return reconcile.quarantined(changes, failed)
