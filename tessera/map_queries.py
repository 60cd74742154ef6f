"""Registered queries over code maps, navigation subjects and what packs begin with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.code_queries import IMPORTS, NUM, SYM, _numbered, _symbols, duck, sql
from tessera.functions import positions
from tessera.operators import codemap, navigation, resolve, seeds
from tessera.operators.lineage import cut
from tessera.queries import query, read

#: Nodes and calls of the map in DuckDB, the roots of flow_roots, and a walk: a queue for each root, one node taken off at a time.
FLOWS = f"""s AS {SYM}, e AS (SELECT * FROM {NUM} WHERE kind = 'calls' AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)),
a AS (SELECT s.id, s.name AS label, (SELECT count(*) FROM e WHERE e.dst = s.id) = 0 AND s.kind NOT IN ('file', 'import') AS root FROM s WHERE s.kind <> 'test' AND id IN (SELECT src FROM e)),
roots AS (SELECT id FROM a WHERE root OR NOT (SELECT bool_or(root) FROM a) ORDER BY id % 10 DESC, label, id LIMIT 4),
pairs AS (SELECT src, dst, min({{'line': line, 'label': name, 'seq': seq}}) AS first_at FROM e JOIN s ON s.id = e.dst GROUP BY src, dst), adj AS (SELECT src, list(dst ORDER BY first_at) AS targets FROM pairs GROUP BY src),
w AS (SELECT id AS flow, [id] AS q, 1 AS i FROM roots UNION ALL SELECT flow, list_concat(q, list_filter(coalesce(targets, []), lambda x: NOT list_contains(q, x))), i + 1 FROM w LEFT JOIN adj ON adj.src = q[i] WHERE i <= least(8, len(q))),
f AS (SELECT flow, unnest(range(least(8, len(q)))) AS step, unnest(q[1:8]) AS id FROM (SELECT flow, arg_max(q, i) AS q FROM w GROUP BY flow))"""


def _nodes(spark, sf_dir):
    return _symbols(spark, sf_dir).select("id", F.col("name").alias("label"), "kind", "path", "start_line", (F.col("id") % 10).alias("relevance"))


def _flows(spark, sf_dir):
    nodes, edges = _nodes(spark, sf_dir), _numbered(spark, sf_dir)
    roots = cut(codemap.flow_roots(nodes, edges).select("id"))
    return codemap.call_flows(roots.select(F.col("id").alias("flow"), "id"), nodes, edges), nodes, edges


@query(f"WITH RECURSIVE {FLOWS} SELECT flow, step, id FROM f")
def call_flows(spark, sf_dir):
    """Walks of at most eight nodes from the roots over calls."""
    return _flows(spark, sf_dir)[0].withColumn("step", F.col("step").cast("long"))


@query(f"""WITH RECURSIVE {FLOWS}, best AS (SELECT src, dst, min({{'d': -confidence, 'line': line, 'path': path}}) AS c FROM e WHERE src <> dst GROUP BY src, dst),
v AS (SELECT b.flow, b.step, max({{'before': x.step, 'c': c}}) AS via FROM f x JOIN f b ON x.flow = b.flow AND x.step < b.step JOIN best ON best.src = x.id AND best.dst = b.id GROUP BY b.flow, b.step)
SELECT f.flow, f.step, f.id, s.name AS label, via.before AS caller_step, coalesce(via.c.path, s.path) AS path, coalesce(via.c.line, s.start_line) AS line FROM f JOIN s USING (id) LEFT JOIN v ON v.flow = f.flow AND v.step = f.step""")
def flow_steps(spark, sf_dir):
    """Where each step of a walk is called, by the nearest step before it."""
    flows, nodes, edges = _flows(spark, sf_dir)
    out = codemap.flow_steps(flows, nodes, edges)
    return out.withColumn("step", F.col("step").cast("long")).withColumn("caller_step", F.col("caller_step").cast("long"))


#: A map of 20 nodes around two symbols: 17 inside, three outside.
SEEDS, ASKED = [(7, 0.9), (12, 0.5)], 20
MAP = f"""i AS ({duck(IMPORTS)}), s AS {SYM}, e AS (SELECT * FROM {NUM} WHERE dst IS NULL OR dst IN (SELECT id FROM s)), b AS (SELECT seq, src AS a, dst AS b FROM e WHERE dst IS NOT NULL UNION ALL SELECT seq, dst, src FROM e WHERE dst IS NOT NULL),
l0 AS (SELECT * FROM (VALUES (7::BIGINT, 0), (12, 1)) t(node, place)),
l1 AS (SELECT b AS node, row_number() OVER (ORDER BY min({{'p': place, 's': seq}})) AS place FROM b JOIN l0 ON a = node WHERE b NOT IN (7, 12) GROUP BY b QUALIFY row_number() OVER (ORDER BY min({{'p': place, 's': seq}})) <= 15),
l2 AS (SELECT b AS node, row_number() OVER (ORDER BY min({{'p': place, 's': seq}})) AS place FROM b JOIN l1 ON a = node WHERE b NOT IN (7, 12) AND b NOT IN (SELECT node FROM l1) GROUP BY b QUALIFY row_number() OVER (ORDER BY min({{'p': place, 's': seq}})) <= 15 - (SELECT count(*) FROM l1)),
n AS (SELECT node FROM l0 UNION ALL SELECT node FROM l1 UNION ALL SELECT node FROM l2), own AS (SELECT * FROM e WHERE src IN (SELECT node FROM n) AND (dst IS NULL OR dst IN (SELECT node FROM n))),
o AS (SELECT o.*, s.language, i.import_path FROM own o JOIN s ON s.id = o.src LEFT JOIN i ON i.path = o.path AND contains(o.to_name, '.') AND i.alias = split_part(o.to_name, '.', 1) WHERE dst IS NULL),
x AS (SELECT seq, src, kind, path, line, CASE WHEN language <> 'go' OR kind = 'imports' THEN to_name ELSE import_path END AS label, CASE WHEN language <> 'go' THEN 'external' WHEN to_name = 'len' THEN NULL WHEN kind = 'imports' THEN CASE WHEN contains(split_part(to_name, '/', 1), '.') THEN 'external' ELSE 'stdlib' END WHEN import_path IS NOT NULL THEN CASE WHEN contains(split_part(import_path, '/', 1), '.') THEN 'external' ELSE 'stdlib' END END AS node_kind FROM o),
y AS (SELECT *, concat('external-', substr(sha256(concat(node_kind, ':', label)), 1, 16)) AS target FROM x WHERE node_kind IS NOT NULL AND label <> ''),
z AS (SELECT target, min(label) AS label, min(node_kind) AS node_kind, row_number() OVER (ORDER BY min(seq)) AS r FROM y GROUP BY target QUALIFY r + (SELECT count(*) FROM n) <= 20)"""


def _map(spark, sf_dir):
    symbols = _symbols(spark, sf_dir).select("id", "name", "kind", "path", "language")
    return codemap.code_map(symbols, _numbered(spark, sf_dir), sql(spark, sf_dir, IMPORTS, "part"), SEEDS, ASKED)


@query(f"""WITH {MAP}, k AS (SELECT s.id::VARCHAR AS id, name AS label, kind, path, CASE id WHEN 7 THEN 0.9 WHEN 12 THEN 0.5 ELSE 0 END::DOUBLE AS relevance FROM n JOIN s ON s.id = n.node UNION ALL SELECT target, label, node_kind, '', CASE WHEN node_kind = 'stdlib' THEN 0.15 ELSE 0.2 END FROM z)
SELECT *, row_number() OVER (ORDER BY relevance DESC, label, id) AS place FROM k""")
def code_map_nodes(spark, sf_dir):
    """Nodes of a map inside and outside the workspace, by relevance and label."""
    return _map(spark, sf_dir)[0]


@query(f"WITH {MAP} SELECT seq, src::VARCHAR AS source, dst::VARCHAR AS target, kind, path, line FROM own WHERE dst IS NOT NULL UNION ALL SELECT seq, src::VARCHAR, target, kind, path, line FROM y SEMI JOIN z USING (target)")
def code_map_edges(spark, sf_dir):
    """Edges among a map's nodes, and to what lies outside."""
    return _map(spark, sf_dir)[1]


#: Symbols with names that one or several share, occurrences, and ranges that begin and end within lines.
NAMED = """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN concat('only', p_partkey) ELSE split_part(p_name, ' ', 2) END AS name, concat('pkg', p_size % 3, CASE WHEN p_partkey % 2 = 0 THEN '::' ELSE '.' END, CASE WHEN p_partkey % 5 = 0 THEN concat('deep', p_partkey % 50) ELSE split_part(p_name, ' ', 1) END) AS qualified,
concat('d', p_partkey % 7, '/', p_size % 5, '.go') AS path, CASE p_size % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'import' ELSE 'function' END AS kind, CASE WHEN p_partkey % 3 <> 0 THEN concat('o', p_partkey) END AS occurrence,
p_size AS start_line, p_partkey % 30 AS start_col, p_size + p_partkey % 4 AS end_line, p_partkey % 30 + p_partkey % 41 - CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 20 END AS end_col FROM {part}"""
ASKED_FOR = """SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS request, CASE WHEN l_linenumber = 1 THEN l_partkey + l_suppkey % 3 * 100000 END AS symbol_id, CASE WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey AS {string}) ELSE concat('o', l_partkey) END END AS occurrence_id,
CASE WHEN l_linenumber IN (3, 4) THEN CASE l_suppkey % 5 WHEN 0 THEN 'ring' WHEN 1 THEN concat('only', l_partkey) WHEN 2 THEN concat('deep', l_suppkey % 60) WHEN 3 THEN 'nothing' ELSE 'red' END WHEN l_linenumber = 5 THEN '' END AS identifier,
concat('d', l_suppkey % 7, '/', l_partkey % 5, '.go') AS path, CASE WHEN l_linenumber BETWEEN 4 AND 6 THEN l_partkey % 55 END AS line, CASE WHEN l_linenumber BETWEEN 4 AND 6 THEN l_suppkey % 60 END AS col FROM {lineitem} WHERE l_returnflag = 'A'"""
PLAIN_AT = "{p}.path = r.path AND ({p}.line > r.start_line OR ({p}.line = r.start_line AND {p}.col >= r.start_col)) AND ({p}.line < r.end_line OR ({p}.line = r.end_line AND {p}.col <= r.end_col))"
TIGHTEST = "arg_min(r.id, {'span': (r.end_line - r.start_line) * 100000::BIGINT + r.end_col - r.start_col, 'id': r.id})"
NAMED_SQL = f"s AS ({duck(NAMED)}), k AS (SELECT DISTINCT id, path, kind, unnest([name, regexp_extract(qualified, '(?:\\.|::)([^.:]+)$', 1)]) AS key FROM s)"
ASKED_SQL = f"q AS (SELECT DISTINCT * FROM ({duck(ASKED_FOR).replace('{string}', 'VARCHAR')}))"


def _named(spark, sf_dir):
    symbols = sql(spark, sf_dir, NAMED, "part")
    return symbols, symbols.select("path", "start_line", "start_col", "end_line", "end_col", "id")


def _asked(spark, sf_dir):
    return sql(spark, sf_dir, ASKED_FOR.replace("{string}", "STRING"), "lineitem").distinct()


def _score(symbol: str, asked: str) -> str:
    cut_off = "regexp_replace({}.path, '/[^/]*$', '')"
    return f"100 * ({symbol}.path = {asked}.path)::INT + 25 * ({cut_off.format(symbol)} = {cut_off.format(asked)})::INT + 5 * ({symbol}.kind <> 'file')::INT"


@query(f"""WITH {NAMED_SQL}, {ASKED_SQL}, c AS (SELECT q.request, k.id, {_score("k", "q")} AS score FROM q JOIN k ON k.key = q.identifier WHERE identifier <> '')
SELECT request, arg_min(id, {{'s': -score, 'id': id}}) AS target, count(DISTINCT id) AS n FROM c GROUP BY request""")
def scoped_names(spark, sf_dir):
    """Names to symbols by their own name or the last part of the qualified one, best for the path they are seen in."""
    wanted = _asked(spark, sf_dir).where("identifier <> ''").select("request", F.col("identifier").alias("name"), "path")
    return resolve.resolve_scoped(wanted, _named(spark, sf_dir)[0])


@query(f"WITH {NAMED_SQL}, {ASKED_SQL} SELECT request, {TIGHTEST} AS id FROM q JOIN s r ON {PLAIN_AT.format(p='q')} WHERE q.line IS NOT NULL GROUP BY request")
def position_ranges(spark, sf_dir):
    """The tightest range by line and column around each point."""
    points = _asked(spark, sf_dir).where("line IS NOT NULL").select("request", "path", "line", "col")
    return resolve.at_line_column(points, _named(spark, sf_dir)[1], ["request"])


@query(f"""WITH {NAMED_SQL}, {ASKED_SQL},
a AS (SELECT request, s.id, 1 AS n FROM q JOIN s ON s.id = q.symbol_id), h AS (SELECT occurrence AS ref, id, 0 AS way FROM s WHERE occurrence IS NOT NULL UNION ALL SELECT id::VARCHAR, id, 1 FROM s),
b AS (SELECT request, arg_min(id, way) AS id, 1 AS n FROM q JOIN h ON h.ref = q.occurrence_id WHERE symbol_id IS NULL GROUP BY request),
c AS (SELECT request, arg_min(id, {{'s': -score, 'id': id}}) AS id, count(DISTINCT id) AS n FROM (SELECT q.request, k.id, {_score("k", "q")} AS score FROM q JOIN k ON k.key = q.identifier WHERE identifier <> '' AND symbol_id IS NULL AND occurrence_id IS NULL) GROUP BY request),
d AS (SELECT request, {TIGHTEST} AS id, 1 AS n FROM q JOIN s r ON {PLAIN_AT.format(p='q')} WHERE symbol_id IS NULL AND occurrence_id IS NULL AND coalesce(identifier, '') = '' AND q.line IS NOT NULL GROUP BY request),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d),
p AS (SELECT request, CASE WHEN symbol_id IS NOT NULL THEN 'symbol' WHEN occurrence_id IS NOT NULL THEN 'occurrence' WHEN identifier <> '' THEN 'identifier' WHEN line IS NOT NULL THEN 'position' ELSE 'missing' END AS step FROM q)
SELECT request, CASE WHEN u.id IS NULL AND step <> 'identifier' THEN 'missing' ELSE step END AS step, u.id, coalesce(u.n, 0) AS candidates FROM p LEFT JOIN u USING (request)""")
def navigation_subjects(spark, sf_dir):
    """What requests are about, by symbol, occurrence, identifier or position."""
    symbols, ranges = _named(spark, sf_dir)
    return navigation.subjects(_asked(spark, sf_dir), symbols, ranges)


FACTS = """SELECT l_orderkey AS request, CASE l_orderkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' WHEN 2 THEN 'widget' ELSE 'gear' END AS identifier, CASE WHEN l_suppkey % 17 = 0 THEN 'jar://x' ELSE concat('d', l_suppkey % 7, '/', l_partkey % 5, '.go') END AS path, l_partkey % 55 AS line, l_suppkey % 60 AS col FROM {lineitem}"""


@query(f"""WITH {NAMED_SQL}, f AS (SELECT DISTINCT * FROM ({duck(FACTS)})), m AS (SELECT f.request, f.identifier, f.path, f.line, f.col, {TIGHTEST} AS id FROM f JOIN s r ON {PLAIN_AT.format(p='f')} WHERE f.line >= 1 AND f.path NOT LIKE '%://%' GROUP BY ALL),
t AS (SELECT m.request, count(DISTINCT m.id) AS n, min(m.id) AS target FROM m JOIN s ON s.id = m.id WHERE s.kind NOT IN ('file', 'import') AND s.name = m.identifier GROUP BY m.request)
SELECT request, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS outcome FROM (SELECT DISTINCT request FROM f) LEFT JOIN t USING (request)""")
def exact_targets(spark, sf_dir):
    """The one symbol that all of a request's facts lead to."""
    symbols, ranges = _named(spark, sf_dir)
    return navigation.exact_targets(sql(spark, sf_dir, FACTS, "lineitem"), symbols, ranges)


#: Modules of the workspace: lines of go.mod files, some of which say the same module.
MODULES = "SELECT concat('m', s_suppkey % 9, CASE WHEN s_suppkey % 2 = 0 THEN '/sub' ELSE '' END, '/go.mod') AS path, concat('// module of', chr(10), '  module  example.com/m', s_suppkey % 6, CASE WHEN s_suppkey % 4 = 0 THEN '/inner/' ELSE '' END, CASE WHEN s_suppkey % 5 = 0 THEN ' extra' ELSE '' END, chr(13), chr(10), 'go 1.22') AS content FROM {supplier} UNION ALL SELECT 'go.mod', concat('module example.com', chr(10))"
PACKAGES = "SELECT DISTINCT concat('example.com/m', p_partkey % 7, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '/inner' WHEN 2 THEN '/inner/x' ELSE '/y' END) AS import_path FROM {part} UNION ALL SELECT DISTINCT concat('other.org/', p_size % 3) FROM {part}"
MODULE_SQL = f"""g AS (SELECT DISTINCT * FROM ({MODULES.replace('{supplier}', 'supplier')})), gl AS (SELECT path, unnest(range(len(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))))) AS place, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM g),
gm AS (SELECT path, place, regexp_replace(f[2], '/$', '') AS module, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM (SELECT *, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS f FROM gl) WHERE len(f) = 2 AND f[1] = 'module'),
im AS (SELECT import_path, arg_min({{'module': module, 'dir': dir}}, {{'path': path, 'place': place}}) AS m FROM ({duck(PACKAGES)}) JOIN gm ON import_path = module OR starts_with(import_path, module || '/') GROUP BY import_path),
pd AS (SELECT import_path, CASE WHEN length(import_path) = length(m.module) THEN m.dir WHEN m.dir = '.' THEN substr(import_path, length(m.module) + 2) ELSE concat(m.dir, '/', substr(import_path, length(m.module) + 2)) END AS dir FROM im)"""


def _packages(spark, sf_dir):
    modules = spark.sql(MODULES, supplier=read(spark, sf_dir, "supplier")).distinct()
    return seeds.package_directories(sql(spark, sf_dir, PACKAGES, "part"), modules)


@query(f"WITH {MODULE_SQL} SELECT import_path, dir FROM pd")
def package_directories(spark, sf_dir):
    """Import paths to directories of the workspace, by the module lines of its project files."""
    return _packages(spark, sf_dir).select("import_path", "dir")


#: Symbols in the directories that the modules give, several files in each.
PLACED = """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN concat('New', split_part(p_name, ' ', 2)) WHEN p_size % 3 = 1 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS name,
concat('Store', p_partkey % 6, '.', split_part(p_name, ' ', 2)) AS qualified, CASE p_size % 8 WHEN 0 THEN 'file' WHEN 1 THEN 'import' WHEN 2 THEN 'test' WHEN 3 THEN 'interface' WHEN 4 THEN 'type' WHEN 5 THEN 'method' ELSE 'function' END AS kind,
concat('m', p_partkey % 9, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '/sub' WHEN 2 THEN '/sub/y' WHEN 3 THEN '/inner' ELSE '/y' END, '/', p_partkey % 4, '.go') AS path FROM {part}"""
PRIORITY = "CASE WHEN kind IN ('test', 'interface') THEN 0 WHEN kind IN ('type', 'class') THEN 1 WHEN kind = 'function' AND starts_with(name, 'New') THEN 2 WHEN kind = 'method' THEN 3 ELSE 4 END"
PUBLIC = "(regexp_matches(name, '^\\p{Lu}') AND kind NOT IN ('file', 'import', 'test'))"


@query(f"""WITH {MODULE_SQL}, s AS (SELECT id, name, path, regexp_replace(path, '/[^/]*$', '') AS dir, (kind = 'test' OR {PUBLIC}) AS exported, {PRIORITY} + CASE WHEN kind = 'test' OR {PUBLIC} THEN 0 ELSE 10 END AS priority FROM ({duck(PLACED)}) WHERE kind NOT IN ('file', 'import') AND name <> ''),
j AS (SELECT import_path AS target, s.*, row_number() OVER (PARTITION BY import_path, path ORDER BY priority, path, name, id) AS r FROM pd JOIN s USING (dir)),
k AS (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY r > 1, CASE WHEN r = 1 THEN 0 ELSE priority END, path, name, id) AS place FROM j WHERE r = 1 OR exported) SELECT target, place, id FROM k WHERE place <= 19""")
def package_seeds(spark, sf_dir):
    """A package's definitions, the first of each file, then public ones by priority."""
    targets = _packages(spark, sf_dir).select(F.col("import_path").alias("target"), "dir")
    return seeds.package_seeds(targets, sql(spark, sf_dir, PLACED, "part"))


@query(f"""WITH s AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, {PRIORITY} + CASE WHEN {PUBLIC} THEN 0 ELSE 10 END AS priority FROM ({duck(PLACED)})), t AS (SELECT id AS target, concat('Store', id % 6) AS type, concat('pkg.Store', id % 6) AS owner, dir FROM s WHERE kind = 'type' AND id % 5 = 0),
k AS (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY priority, path, name, id) AS place FROM t JOIN s USING (dir) WHERE id <> target AND (contains(qualified, owner || '.') OR contains(qualified, type || '.'))) SELECT target, place, id FROM k WHERE place <= 19""")
def member_seeds(spark, sf_dir):
    """What belongs to a type, by qualified names in its directory."""
    symbols = sql(spark, sf_dir, PLACED, "part")
    types = symbols.where("kind = 'type' AND id % 5 = 0").select(F.col("id").alias("target"), F.expr("concat('Store', id % 6)").alias("name"), F.expr("concat('pkg.Store', id % 6)").alias("qualified"), "path")
    return seeds.member_seeds(types, symbols)


@query(r"""WITH f AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM documents WHERE text <> ''), s AS (SELECT doc_id, greatest(1 + doc_id % 7 - 2, 1) AS first, least(1 + doc_id % 7 + 2, len(lines)) AS last, lines FROM f WHERE 1 + doc_id % 7 <= len(lines)),
w AS (SELECT doc_id AS site, first, last, regexp_replace(array_to_string(lines[first:last], chr(10)), '^\s+|\s+$', '', 'g') AS content FROM s) SELECT site, first, last, substr(sha256(content), 1, 24) AS hash FROM w WHERE content <> ''""")
def usage_windows(spark, sf_dir):
    """The lines around a place of use."""
    docs = read(spark, sf_dir, "documents")
    sites = docs.select(F.col("doc_id").alias("site"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 7 + 1).alias("line"))
    return seeds.usage_windows(sites, docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("code"))).select("site", "first", "last", "hash")


#: A point in each text, by its line and byte, and how an editor counts there.
POINTS = "SELECT doc_id AS id, doc_id % 4 AS point, 1 + doc_id % 4 AS line, 1 + doc_id % 60 AS col FROM {documents}"
UNITS = r"CASE doc_id % 3 WHEN 0 THEN strlen(h) WHEN 1 THEN length(h) ELSE length(h) + length(regexp_replace(h, '[^\x{10000}-\x{10FFFF}]', '', 'g')) END"


@query(rf"""WITH d AS (SELECT doc_id, 1 + doc_id % 4 AS n, 1 + doc_id % 60 AS col, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (SELECT *, CASE WHEN n <= len(lines) THEN rtrim(lines[n], chr(13)) END AS line FROM d),
p AS (SELECT *, least(col - 1, strlen(line)) AS within FROM l), q AS (SELECT *, left(line, list_filter(range(0, 61), lambda k: strlen(left(line, k)) = within)[1]) AS h, len(list_filter(range(0, 61), lambda k: strlen(left(line, k)) = within)) > 0 AS whole FROM p)
SELECT doc_id AS id, n - 1 AS point, CASE WHEN line IS NULL OR NOT whole THEN -1 ELSE n - 1 END AS line, CASE WHEN line IS NULL OR NOT whole THEN -1 ELSE {UNITS} END AS unit FROM q""")
def editor_positions(spark, sf_dir):
    """F Position: byte columns as editors count them, in three encodings."""
    docs = read(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.expr("CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-32' ELSE 'utf-16' END").alias("encoding"))
    return positions.to_editor(texts, spark.sql(POINTS, documents=docs))
