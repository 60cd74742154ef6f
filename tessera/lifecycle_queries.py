"""Registered queries over what follows a commit: own writes, artifacts, evaluation, pages, diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.code_queries import CANDIDATES, SYM, _symbols, sql
from tessera.operators import lifecycle as L
from tessera.queries import query, read


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


#: When the registry is asked.
NOW = "2001-01-19 00:00:00"
MUTATIONS = """SELECT o_orderkey AS id, concat('web/', o_custkey % 400, '.go') AS path, CASE o_orderstatus WHEN 'P' THEN 'staged' ELSE 'published' END AS state, o_orderkey % 97 AS revision, o_orderdate AS published_at,
concat('h', o_orderkey % 3) AS hash, o_orderdate + INTERVAL 1000 DAY AS expires_at FROM {orders}"""
SEEN = "SELECT c_custkey AS seen, concat('web/', c_custkey % 450, '.go') AS path, c_custkey % 7 <> 0 AS present, concat('h', c_custkey % 3) AS content_hash, concat('h', c_custkey % 3) AS store_hash, 70 + c_custkey % 30 AS store_revision FROM {customer}"
EXPIRED = f"SELECT * REPLACE (CASE WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE state END AS state) FROM ({duck(MUTATIONS)})"


@query(f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY revision DESC, published_at DESC, id DESC) AS n FROM ({EXPIRED}) WHERE state = 'published') WHERE n = 1),
j AS (SELECT s.*, l.id AS mutation_id, coalesce(present AND content_hash = l.hash AND store_hash = l.hash AND store_revision >= l.revision, false) AS matched FROM ({duck(SEEN)}) s LEFT JOIN l ON s.path = l.path)
SELECT *, CASE WHEN matched THEN 'self_write_confirmed' WHEN NOT present THEN 'removed' WHEN mutation_id IS NULL THEN 'unchanged' ELSE 'external_change' END AS classification FROM j""")
def self_writes(spark, sf_dir):
    """Whether a file seen on disk is our own latest write."""
    return L.classified(sql(spark, sf_dir, SEEN, "customer"), sql(spark, sf_dir, MUTATIONS, "orders"), NOW)


@query(f"SELECT state, count(*) AS n FROM ({EXPIRED}) GROUP BY state")
def mutation_states(spark, sf_dir):
    """Entries of the registry by state."""
    return L.unexpired(sql(spark, sf_dir, MUTATIONS, "orders"), NOW).groupBy("state").agg(F.count("*").alias("n"))


EVENTS = """SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 4 = 0 THEN 'failure' ELSE 'publish' END AS kind, concat('a', o_orderkey) AS id,
CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'now' END AS input_snapshot, repeat('x', CAST(o_orderkey % 30 AS INT)) AS payload, o_orderpriority AS error FROM {orders}"""


@query(f"""WITH e AS ({duck(EVENTS)}), p AS (SELECT key, count(*) AS n, max(seq) AS at FROM e WHERE kind = 'publish' AND input_snapshot = 'now' AND length(payload) BETWEEN 1 AND 25 GROUP BY key),
f AS (SELECT key, max(seq) AS at, arg_max(error, seq) AS error FROM e WHERE kind = 'failure' GROUP BY key)
SELECT coalesce(p.key, f.key) AS key, coalesce(n, 0) AS latest_revision, CASE WHEN n > 0 THEN concat('a', p.at) END AS current, CASE WHEN n > 0 THEN 'current' ELSE 'failed' END AS status,
CASE WHEN f.at > coalesce(p.at, -1) THEN error ELSE '' END AS last_error FROM p FULL JOIN f ON p.key = f.key""")
def artifact_publication(spark, sf_dir):
    """Heads after publications and failures in order."""
    return L.heads(sql(spark, sf_dir, EVENTS, "orders"), "now", 25)


ARTIFACTS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN 'generating' WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'current' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'v1' ELSE 'v2' END AS prompt,
CASE WHEN o_custkey % 11 = 0 THEN 'a' ELSE 'b' END AS provider, CASE WHEN o_custkey % 13 = 0 THEN 'small' ELSE 'large' END AS model FROM {orders}"""
DEPENDENCIES = """SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS seq, CASE WHEN l_linenumber = 3 THEN 'snapshot' ELSE 'symbol' END AS kind, CAST(l_partkey + 15 AS STRING) AS ref,
CASE WHEN l_linenumber = 3 THEN CASE WHEN l_partkey % 6 = 0 THEN 'old' ELSE 'now' END WHEN l_partkey % 9 = 0 THEN 'old' ELSE concat('h', l_partkey + 15) END AS hash FROM {lineitem}"""
STATED = "SELECT CAST(p_partkey AS STRING) AS ref, concat('h', p_partkey) AS current FROM {part}"


@query(f"""WITH a AS ({duck(ARTIFACTS)}), d AS ({duck(DEPENDENCIES)}), s AS ({duck(STATED)}),
r AS (SELECT id, seq, CASE WHEN kind = 'snapshot' THEN CASE WHEN hash <> 'now' THEN 'structural snapshot changed' END WHEN s.ref IS NULL THEN concat('dependency no longer exists: ', d.ref) WHEN s.current <> hash THEN concat('dependency content changed: ', d.ref) END AS reason FROM d LEFT JOIN s ON s.ref = d.ref),
b AS (SELECT id, string_agg(reason, '; ' ORDER BY seq, reason) AS broken FROM r WHERE reason IS NOT NULL GROUP BY id),
j AS (SELECT a.id, status IN ('generating', 'failed') AS kept, status, concat_ws('; ', CASE WHEN prompt <> 'v2' THEN 'prompt version changed' END, CASE WHEN provider <> 'b' OR model <> 'large' THEN 'provider or model changed' END, broken) AS reasons FROM a LEFT JOIN b ON a.id = b.id)
SELECT id, CASE WHEN kept THEN status WHEN reasons = '' THEN 'current' ELSE 'stale' END AS status, CASE WHEN kept THEN '' ELSE reasons END AS reasons FROM j""")
def artifact_evaluation(spark, sf_dir):
    """Artifacts that no longer hold, and why."""
    tables = sql(spark, sf_dir, ARTIFACTS, "orders"), sql(spark, sf_dir, DEPENDENCIES, "lineitem"), sql(spark, sf_dir, STATED, "part")
    now = {"prompt": "v2", "provider": "b", "model": "large", "snapshot": "now"}
    return L.evaluated(*tables, now).withColumn("reasons", F.array_join("reasons", "; "))


RUNS = "SELECT c_custkey AS key, c_custkey % 17 = 0 AS generating, CASE WHEN c_custkey % 13 = 0 THEN 'timeout' ELSE '' END AS error, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 's1' ELSE 's2' END AS published, 's1' AS snapshot FROM {customer}"
WRITTEN = "SELECT o_custkey AS key, o_orderkey AS slug, o_orderstatus AS hash FROM {orders}"
EXPECTED = "SELECT o_custkey AS key, o_orderkey AS slug, CASE WHEN o_orderkey % 40 = 0 THEN 'x' ELSE o_orderstatus END AS hash FROM {orders} WHERE o_orderkey % 50 <> 0"


@query(f"""WITH p AS (SELECT w.key, count(*) AS pages, count(*) FILTER (w.hash IS DISTINCT FROM e.hash) AS changed FROM ({duck(WRITTEN)}) w LEFT JOIN ({duck(EXPECTED)}) e ON e.key = w.key AND e.slug = w.slug GROUP BY w.key)
SELECT r.key, CASE WHEN generating THEN 'generating' WHEN error <> '' THEN 'failed' WHEN pages IS NULL THEN 'not_generated' WHEN CASE WHEN published <> '' THEN published <> snapshot ELSE changed > 0 END THEN 'stale' ELSE 'ready' END AS status FROM ({duck(RUNS)}) r LEFT JOIN p ON p.key = r.key""")
def wiki_status(spark, sf_dir):
    """What a collection of pages is worth now."""
    return L.collection_status(sql(spark, sf_dir, RUNS, "customer"), sql(spark, sf_dir, WRITTEN, "orders"), sql(spark, sf_dir, EXPECTED, "orders"))


PAGES = """SELECT CASE WHEN p_partkey = 1 THEN 'overview' ELSE concat('p', p_partkey) END AS slug, CASE WHEN p_partkey = 1 THEN '' WHEN p_partkey % 10 = 3 THEN concat('p', p_partkey) WHEN p_partkey % 10 = 4 THEN 'gone'
WHEN p_partkey < 8 THEN 'overview' WHEN p_partkey < 500 THEN concat('p', p_partkey % 8) WHEN p_partkey < 600 THEN concat('p', CAST(p_partkey - 490 AS INT)) WHEN p_partkey < 700 THEN concat('p', p_partkey - p_partkey % 5 + (p_partkey + 1) % 5) WHEN p_partkey < 800 THEN concat('p', p_partkey - 95) WHEN p_partkey < 1500 THEN concat('p', p_partkey - 1) ELSE '' END AS parent FROM {part}"""


@query(f"""WITH RECURSIVE p AS ({duck(PAGES)}), l AS (SELECT slug, parent FROM p WHERE parent <> slug AND parent IN (SELECT slug FROM p)),
u AS (SELECT slug AS q, slug AS a, [slug] AS seen, false AS circles FROM p WHERE slug IN (SELECT concat('p', p_partkey) FROM part WHERE p_partkey BETWEEN 600 AND 799) UNION ALL SELECT u.q, l.parent, list_append(seen, l.parent), list_contains(seen, l.parent) FROM u JOIN l ON l.slug = u.a WHERE NOT circles),
z AS (SELECT q, list_min(arg_max(seen, len(seen))) AS start, bool_or(circles) AS circles FROM u GROUP BY q), k AS (SELECT l.* FROM l LEFT JOIN z ON z.q = l.slug WHERE NOT coalesce(circles AND start = slug, false)),
r AS (SELECT slug, slug AS path, CASE WHEN slug = 'overview' THEN 0 WHEN z.circles THEN 2 ELSE 1 END AS top FROM p LEFT JOIN z ON z.q = p.slug WHERE slug NOT IN (SELECT slug FROM k) UNION ALL SELECT k.slug, concat(r.path, '/', k.slug), r.top FROM k JOIN r ON k.parent = r.slug)
SELECT slug, concat(CASE WHEN z.circles THEN 2 ELSE top END, '/', path) AS path FROM r LEFT JOIN z ON z.q = r.slug""")
def wiki_page_paths(spark, sf_dir):
    """Where each page stands in depth-first order, the overview first."""
    return L.page_paths(sql(spark, sf_dir, PAGES, "part")).select("slug", F.array_join("at", "/").alias("path"))


FACTS = """SELECT concat('d', l_orderkey, '-', l_linenumber) AS id, CASE WHEN l_linenumber = 7 THEN 'reference' ELSE 'diagnostic' END AS kind, l_suppkey % 3 AS document, CASE WHEN l_tax > 0.05 THEN 2 ELSE 1 END AS version, l_returnflag AS content_hash,
CASE WHEN l_quantity < 5 THEN 'old' ELSE 'live' END AS session, concat('web/', l_suppkey % 3, '.go') AS path, CASE l_partkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'hint' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' ELSE 'odd' END AS severity,
l_partkey % 50 AS line, CAST(l_quantity AS INT) AS col FROM {lineitem}"""
DOCUMENT = {"document": 1, "version": 2, "content_hash": "A", "session": "live", "path": "web/1.go"}
ACCEPTED = "kind = 'diagnostic' AND document = 1 AND version = 2 AND content_hash = 'A' AND session = 'live' AND path = 'web/1.go'"


@query(f"SELECT id, severity, path, line, col FROM ({duck(FACTS)}) WHERE {ACCEPTED} ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'hint' THEN 3 ELSE 4 END, path, line, col, id LIMIT 100")
def editor_diagnostics(spark, sf_dir):
    """Diagnostics of an open document, the worst first."""
    rows = L.accepted_diagnostics(sql(spark, sf_dir, FACTS, "lineitem"), DOCUMENT).where("accepted")
    return rows.orderBy(L.severity_rank(F.col("severity")), "path", "line", "col", "id").limit(100).select("id", "severity", "path", "line", "col")


@query(f"SELECT count(*) FILTER ({ACCEPTED}) AS accepted, count(*) FILTER (NOT ({ACCEPTED})) AS skipped FROM ({duck(FACTS)})")
def editor_diagnostic_counts(spark, sf_dir):
    """Diagnostics of exactly the open document, and facts passed over."""
    rows = L.accepted_diagnostics(sql(spark, sf_dir, FACTS, "lineitem"), DOCUMENT)
    return rows.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("skipped"))


LOOKED = f"SELECT seq, symbol_id, path, CASE WHEN line = 6 THEN 'test' ELSE kind END AS kind, CASE WHEN line = 5 THEN 'usage_site' ELSE relation END AS relation, confidence AS relevance FROM ({CANDIDATES})"


@query(f"""WITH f AS (SELECT symbol_id, arg_min(path, seq) AS path, arg_min(relevance, seq) AS relevance FROM ({duck(LOOKED)}) WHERE symbol_id <> 7 AND kind <> 'test' AND relation <> 'usage_site' AND path <> '' GROUP BY symbol_id)
SELECT symbol_id, s.name, f.path, CASE WHEN s.kind = 'interface' THEN 0 WHEN s.kind IN ('type', 'class') THEN 1 WHEN s.kind = 'function' AND s.name LIKE 'New%' THEN 2 WHEN s.kind = 'method' THEN 3 ELSE 4 END AS priority, relevance
FROM f JOIN {SYM} s ON s.id = f.symbol_id WHERE s.kind NOT IN ('file', 'import', 'test') ORDER BY priority, relevance DESC, s.name, f.path, symbol_id LIMIT 12""")
def see_also(spark, sf_dir):
    """Other symbols of a pack worth a look."""
    symbols = _symbols(spark, sf_dir).select(F.col("id").alias("symbol_id"), "name", F.col("kind").alias("symbol_kind"))
    return L.see_also(sql(spark, sf_dir, LOOKED, "lineitem"), symbols, 7, 12)


PROJECT = """SELECT DISTINCT concat(CASE p_size % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/c/' ELSE '' END, CASE p_partkey % 9 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'package.json' WHEN 2 THEN 'README.md' WHEN 3 THEN 'tsconfig.json' WHEN 4 THEN 'Makefile'
WHEN 5 THEN 'Dockerfile.dev' WHEN 6 THEN '.env.example' WHEN 7 THEN 'readmes' ELSE 'go.sum' END) AS path, p_size % 4 AS line FROM {part}"""


@query(f"""SELECT path, line, CASE WHEN b = 'go.mod' THEN 0 WHEN b = 'package.json' THEN 10 WHEN b LIKE 'readme.%' THEN 20 WHEN b = 'tsconfig.json' THEN 30 WHEN b = 'makefile' THEN 40 WHEN b LIKE 'dockerfile.%' THEN 50 WHEN b = '.env.example' THEN 60 ELSE 100 END AS priority
FROM (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS b FROM ({duck(PROJECT)})) ORDER BY priority, path, line LIMIT 90""")
def project_file_order(spark, sf_dir):
    """Evidence of project files in order of priority."""
    return sql(spark, sf_dir, PROJECT, "part").withColumn("priority", L.project_priority(F.col("path"))).orderBy("priority", "path", "line").limit(90)


CHANGES = "SELECT concat('web/', p_partkey, '.go') AS path, CASE p_size % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'changed' ELSE 'removed' END AS change FROM {part}"


@query(f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed, count(*) AS total, count(*) > 200 AS truncated FROM ({duck(CHANGES)})")
def change_counts(spark, sf_dir):
    """Counts of an index event."""
    return L.change_counts(sql(spark, sf_dir, CHANGES, "part"))


@query(f"SELECT path FROM ({duck(CHANGES)}) ORDER BY path LIMIT 200")
def changed_paths(spark, sf_dir):
    """The first paths of an index event."""
    return L.changed_paths(sql(spark, sf_dir, CHANGES, "part"))


@query(f"SELECT id, kind FROM {SYM} WHERE kind <> 'file' AND id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    """Symbols that an incremental refresh embeds."""
    return L.missing_vectors(_symbols(spark, sf_dir).select("id", "kind"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


CASES = """SELECT case_id, CASE WHEN k % 3 = 0 THEN '' ELSE concat('s', k % 40) END AS symbol, k % 40 AS target, 2000 AS requested, k % 40 * 100 AS used FROM (SELECT o_custkey % 70 AS case_id, max(o_orderkey) AS k FROM {orders} GROUP BY o_custkey % 70)"""
SHOWN = f"SELECT request AS case_id, evidence_id AS id, symbol_id, concat('pkg/sub.', CASE WHEN line = 2 THEN 'Type::' ELSE '' END, 's', symbol_id, ' — ', relation) AS title, path, CASE WHEN line = 6 THEN '' ELSE kind END AS kind FROM ({CANDIDATES})"
RELEVANT = "SELECT DISTINCT o_custkey % 70 AS case_id, concat('s', o_orderkey % 60) AS name FROM {orders} WHERE o_custkey % 7 <> 0"
METRICS = f"""c AS ({duck(CASES)}), v AS (SELECT *, regexp_replace(string_split(title, ' — ')[1], '^.*(::|[./])', '') AS name FROM ({duck(SHOWN)})),
w AS (SELECT v.case_id, count(*) AS n, count(DISTINCT id) AS d, count(*) FILTER (kind = '') AS u, sum((path LIKE 'web/3%')::INT + (path LIKE 'web/8%')::INT)::BIGINT AS f, bool_or(symbol_id = target AND name = symbol) AS hit FROM v JOIN c ON c.case_id = v.case_id GROUP BY v.case_id),
k AS (SELECT r.case_id, count(p.name) / count(*) AS recall FROM ({duck(RELEVANT)}) r LEFT JOIN (SELECT DISTINCT case_id, name FROM v) p ON p.case_id = r.case_id AND p.name = r.name GROUP BY r.case_id),
m AS (SELECT c.case_id, coalesce(n, 0) AS evidence, coalesce(hit, false) OR symbol = '' AS target_resolved, round(coalesce(recall, 1), 9) AS recall, coalesce(f, 0) AS forbidden_hits, round(coalesce((n - d) / n, 0), 9) AS duplicate_rate, round(coalesce(u / n, 0), 9) AS unsourced_rate, (used > requested)::BIGINT AS over_budget
FROM c LEFT JOIN w ON w.case_id = c.case_id LEFT JOIN k ON k.case_id = c.case_id)"""


def _metrics(spark, sf_dir):
    got = L.case_metrics(sql(spark, sf_dir, CASES, "orders"), sql(spark, sf_dir, SHOWN, "lineitem"), sql(spark, sf_dir, RELEVANT, "orders"), ["web/3/*", "web/8"])
    return got.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in got.dtypes])


@query(f"WITH {METRICS} SELECT * FROM m")
def pack_evaluation(spark, sf_dir):
    """Metrics of each evaluation case."""
    return _metrics(spark, sf_dir)


@query(f"WITH {METRICS} SELECT count(*) AS cases, round(avg(target_resolved::INT), 6) AS resolution_rate, round(avg(recall), 6) AS mean_recall, sum(forbidden_hits)::BIGINT AS forbidden_hits, sum(over_budget)::BIGINT AS over_budget FROM m")
def evaluation_summary(spark, sf_dir):
    """All cases in one row."""
    return L.summary(_metrics(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("resolution_rate", "mean_recall")})


MARKDOWN = """SELECT doc_id AS id, concat('# ', coalesce(source, ''), chr(10), '- [a](b)', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('* plain', chr(10), '  - other') ELSE '- [c](d)' END, chr(10), CASE WHEN doc_id % 2 = 0 THEN '## Usage' ELSE '' END, chr(10),
CASE WHEN doc_id % 5 = 0 THEN concat('```', chr(10), 'x', chr(10), '```') ELSE '' END, chr(10), coalesce(text, ''), CASE WHEN doc_id % 7 = 0 THEN ' Possibly.' ELSE '' END) AS markdown FROM {documents}"""
SECTIONS = {"title": "# ", "usage": "## Usage", "links": "]("}
BLANK = L.BLANK


@query(f"""WITH p AS (SELECT *, list_filter(list_transform(string_split(markdown, chr(10)), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: starts_with(x, '-') OR starts_with(x, '*')) AS claims FROM ({duck(MARKDOWN)})),
s AS (SELECT id, CASE WHEN len(claims) > 0 THEN len(list_filter(claims, lambda x: contains(x, ']('))) / len(claims) ELSE 0 END::DOUBLE AS citation_density, ({" + ".join(f"contains(markdown, '{m}')::INT" for m in SECTIONS.values())}) / 3 AS structure,
((len(string_split(markdown, '```')) - 1) // 2)::BIGINT AS code_blocks, ({" + ".join(f"contains(lower(markdown), '{p}')::INT" for p in L.SPECULATION)})::BIGINT AS speculation FROM p)
SELECT id, round(citation_density, 9) AS citation_density, round(structure, 9) AS structure, code_blocks, speculation, round(100 * (0.3::DOUBLE * citation_density + 0.5::DOUBLE * structure + 0.1::DOUBLE * (code_blocks > 0)::INT + 0.1::DOUBLE * (speculation = 0)::INT), 2) AS score FROM s""")
def surface_quality(spark, sf_dir):
    """Quality of generated pages."""
    got = L.surface_scores(sql(spark, sf_dir, MARKDOWN, "documents"), SECTIONS, True)
    return got.withColumns({c: F.round(c, 9) for c in ("citation_density", "structure")})
