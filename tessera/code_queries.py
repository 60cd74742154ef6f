"""Registered queries over a code index that the tables stand for: symbols of `part`, edges of `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as T
from tessera.operators import codemap, evidence, integrity, navigation, retrieval
from tessera.operators.index import kept_index
from tessera.queries import _tokens, query, read

#: The index in SQL that Spark and DuckDB read alike; {t} is where a table's name goes.
SYMBOLS = """SELECT id, name, concat(split_part(p_name, ' ', 1), '.', name) AS qualified, kind, concat(dir, '/', id % 40, CASE WHEN id % 11 = 0 THEN '_test' ELSE '' END, '.go') AS path, language,
p_type AS signature, p_name AS summary, concat('func ', name, '() return ', replace(p_brand, '#', 'No')) AS code, p_size AS start_line, p_size + 8 AS end_line, id % 50 AS parent, p_brand AS brand FROM (
SELECT p_partkey AS id, p_name, p_type, p_size, p_brand, CASE WHEN p_size % 3 = 0 THEN concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) ELSE split_part(p_name, ' ', 2) END AS name,
CASE p_size % 7 WHEN 0 THEN 'file' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'type' WHEN 4 THEN 'class' WHEN 5 THEN 'interface' ELSE 'import' END AS kind,
CASE p_partkey % 5 WHEN 0 THEN 'cmd/api' WHEN 1 THEN 'internal/store' WHEN 2 THEN 'web' WHEN 3 THEN 'web/tests' ELSE 'vendor/lib' END AS dir, CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'go' END AS language FROM {part})"""
FILES = f"SELECT path, min(language) AS language, min(start_line) * 10 - 15 AS size, sha256(path) AS hash FROM ({SYMBOLS}) GROUP BY path"
EDGES = """SELECT DISTINCT l_partkey AS src, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber = 5 THEN -l_suppkey - 1 ELSE l_suppkey END AS dst,
CASE WHEN l_linenumber % 3 <> 0 THEN '' WHEN l_quantity < 10 THEN '' WHEN l_quantity < 20 THEN 'len' WHEN l_returnflag = 'A' THEN concat('fmt.P', l_suppkey % 7) ELSE concat('web.', l_suppkey % 7) END AS to_name,
CASE l_linenumber % 5 WHEN 0 THEN 'contains' WHEN 1 THEN 'calls' WHEN 2 THEN 'imports' WHEN 3 THEN 'calls' ELSE 'reads' END AS kind,
concat('cmd/api/', l_partkey % 50, '.go') AS path, l_linenumber AS line, 1 - l_discount * 12 AS confidence FROM {lineitem}"""
NUMBERED = f"SELECT *, row_number() OVER (ORDER BY src, dst NULLS FIRST, to_name, kind, path, line, confidence) AS seq FROM ({EDGES})"


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text.replace("sha256(path)", "sha2(path, 256)"), **{t: read(spark, sf_dir, t) for t in tables})


def duck(text: str) -> str:
    for t in ("part", "lineitem"):
        text = text.replace("{" + t + "}", t)
    return text


def _symbols(spark, sf_dir):
    return sql(spark, sf_dir, SYMBOLS, "part")


def _files(spark, sf_dir):
    return sql(spark, sf_dir, FILES, "part")


def _edges(spark, sf_dir):
    return sql(spark, sf_dir, EDGES, "lineitem")


def _numbered(spark, sf_dir):
    """Edges with their place in a fixed order."""
    return integrity.ranked_ids(_edges(spark, sf_dir), ["src", "dst", "to_name", "kind", "path", "line", "confidence"], "seq")


SYM, FIL, EDG, NUM = (f"({duck(x)})" for x in (SYMBOLS, FILES, EDGES, NUMBERED))


@query(f"""SELECT id, regexp_matches(name, '^[A-Z]') AS exported, (lower(name) IN ('main', 'app', 'server') OR lower(name) LIKE 'new%' OR lower(name) LIKE '%handler' OR kind = 'file' OR (kind IN ('function', 'type', 'class', 'interface') AND regexp_matches(name, '^[A-Z]'))) AS overview,
(kind NOT IN ('file', 'import') AND CASE WHEN language = 'go' THEN regexp_matches(name, '^[A-Z]') ELSE kind IN ('class', 'interface', 'type', 'function') END) AS glossary,
(path LIKE '%/tests/%' OR path LIKE '%\\_test.go' ESCAPE '\\') AS test_path, CASE WHEN language = 'python' THEN false ELSE kind = 'function' AND path LIKE '%\\_test.go' ESCAPE '\\' END AS test_symbol FROM {SYM}""")
def symbol_flags(spark, sf_dir):
    """P10 to P13, S8g: what a symbol counts as."""
    n, k, g, p = (F.col(c) for c in ("name", "kind", "language", "path"))
    return _symbols(spark, sf_dir).select("id", S.is_exported(n).alias("exported"), S.is_overview_seed(n, k).alias("overview"), S.is_glossary_entry(n, k, g).alias("glossary"), S.is_test_path(p).alias("test_path"), S.is_test_symbol(n, k, g, p).alias("test_symbol"))


@query(f"SELECT id, path FROM {SYM} WHERE path IN ('web/2.go', 'web/7.go') OR path LIKE 'internal/store/%'")
def module_scope(spark, sf_dir):
    """Symbols of listed files and below a directory."""
    return _symbols(spark, sf_dir).where(S.in_scope(F.col("path"), ["web/2.go", "web/7.go"], ["internal/store/"])).select("id", "path")


@query(f"SELECT id, name, qualified FROM {SYM} WHERE name = 'ring' OR qualified LIKE '%.ring' OR qualified LIKE '%::ring'")
def symbols_by_name(spark, sf_dir):
    """By name or the last segment of the qualified name."""
    return navigation.by_name(_symbols(spark, sf_dir), "ring").select("id", "name", "qualified")


@query(f"SELECT DISTINCT id, name, start_line FROM {SYM} WHERE path = 'web/2.go'")
def symbols_by_path(spark, sf_dir):
    """P5: the symbols of a file, each once; the filter reaches the scan."""
    return _symbols(spark, sf_dir).where("path = 'web/2.go'").select("id", "name", "start_line").distinct()


@query(f"SELECT * FROM {EDG} WHERE src = 7 OR dst = 7")
def edges_of_symbol(spark, sf_dir):
    """Edges from or to a symbol."""
    return navigation.incident(_edges(spark, sf_dir), 7).select("src", "dst", "to_name", "kind", "path", "line", "confidence")


@query(f"SELECT seq, src, dst, kind FROM {NUM} WHERE kind IN ('calls', 'imports') ORDER BY seq LIMIT 60")
def allowed_edges(spark, sf_dir):
    """The first edges of listed kinds, as many as a policy lets in."""
    return _numbered(spark, sf_dir).where(F.col("kind").isin("calls", "imports")).orderBy("seq").limit(evidence.POLICIES["base"].edges).select("seq", "src", "dst", "kind")


@query(f"SELECT id, name FROM {SYM} WHERE " + " OR ".join(f"contains(lower({f}), '{t}')" for f in ("name", "qualified", "kind", "path", "signature", "summary", "code") for t in ("ring", "brandno1")))
def any_token_match(spark, sf_dir):
    """Symbols with any of the query's words in any field."""
    fields = ("name", "qualified", "kind", "path", "signature", "summary", "code")
    return _symbols(spark, sf_dir).where(" OR ".join(f"contains(lower({f}), '{t}')" for f in fields for t in ("ring", "brandno1"))).select("id", "name")


@query(f"""SELECT path, CASE WHEN lower(b) = 'go.mod' THEN 'gomod' WHEN lower(b) = 'go.sum' THEN 'text' WHEN lower(b) = 'package.json' THEN 'json' WHEN lower(b) = 'makefile' THEN 'makefile' WHEN lower(b) LIKE 'dockerfile.%' THEN 'dockerfile' WHEN lower(b) LIKE 'readme.%' THEN 'markdown' END AS language, bytes FROM (
SELECT path, split_part(path, '/', 2) AS b, CASE WHEN path LIKE '%/GO.SUM' THEN 0 WHEN strlen(text) <= 8192 THEN strlen(text) WHEN strlen(regexp_extract(head, '(?s)^(.*\\n)', 1)) > 4097 THEN strlen(regexp_extract(head, '(?s)^(.*\\n)', 1)) WHEN strlen(head) < 8192 THEN strlen(head) + 3 ELSE 8192 END AS bytes FROM (SELECT path, text, CASE WHEN strlen(text) > 8192 THEN substr(text, 1, list_max(list_filter(range(2700, 8193), lambda k: strlen(substr(text, 1, k)) <= 8192))) ELSE text END AS head FROM (
SELECT text, concat(source, '/', CASE doc_id % 8 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'GO.SUM' WHEN 2 THEN 'package.json' WHEN 3 THEN 'Makefile' WHEN 4 THEN 'Dockerfile.dev' WHEN 5 THEN 'README.md' WHEN 6 THEN '.env' ELSE 'a.txt' END) AS path FROM documents WHERE text IS NOT NULL))) WHERE language IS NOT NULL""")
def project_files(spark, sf_dir):
    """Allow-listed project files, and how much of each the preview keeps."""
    names = "CASE doc_id % 8 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'GO.SUM' WHEN 2 THEN 'package.json' WHEN 3 THEN 'Makefile' WHEN 4 THEN 'Dockerfile.dev' WHEN 5 THEN 'README.md' WHEN 6 THEN '.env' ELSE 'a.txt' END"
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat("source", F.lit("/"), F.expr(names)).alias("path"), "text")
    return docs.select("path", S.project_language(F.col("path")).alias("language"), F.when(S.keeps_content(F.col("path")), F.octet_length(S.preview(F.col("text")))).otherwise(0).cast("long").alias("bytes")).where("language IS NOT NULL")


@query(f"SELECT e.seq, e.kind, e.line, s.name, s.path AS subject_path FROM {NUM} e JOIN {SYM} s ON e.src = s.id WHERE e.kind <> 'reads'")
def relation_evidence(spark, sf_dir):
    """Relations with the symbol that they start from."""
    own = _symbols(spark, sf_dir).select(F.col("id").alias("src"), "name", F.col("path").alias("subject_path"))
    return _numbered(spark, sf_dir).where("kind <> 'reads'").join(own, "src").select("seq", "kind", "line", "name", "subject_path")


@query(f"SELECT p.id, o.path, o.line FROM {SYM} p LEFT JOIN (SELECT src, path, line, row_number() OVER (PARTITION BY src ORDER BY path, line, seq) AS n FROM {NUM} WHERE kind = 'calls') o ON o.src = p.id AND n = 1")
def ranked_occurrence(spark, sf_dir):
    """Every identity with its first occurrence, or none."""
    first = _edges(spark, sf_dir).where("kind = 'calls'").groupBy("src").agg(F.min(F.struct("path", "line")).alias("at"))
    return _symbols(spark, sf_dir).join(first, F.col("id") == F.col("src"), "left").select("id", "at.path", "at.line")


@query(f"SELECT e.seq, CASE WHEN s.id IS NOT NULL THEN e.dst END AS dst FROM {NUM} e LEFT JOIN {SYM} s ON e.dst = s.id")
def kept_targets(spark, sf_dir):
    """Valid targets stay, dangling ones are cleared."""
    return integrity.valid_targets(_numbered(spark, sf_dir), _symbols(spark, sf_dir)).select("seq", "dst")


@query(f"""WITH f AS {EDG}, s AS {SYM}, k AS (SELECT f.kind, f.src, t.id AS object, CASE WHEN t.id IS NULL THEN f.to_name END AS external, f.to_name, f.path, f.line, greatest(0.0, least(1.0, f.confidence)) AS confidence FROM f JOIN s ON f.src = s.id LEFT JOIN s t ON f.dst = t.id)
SELECT kind, src, object, external, round(max(confidence), 6) AS confidence, count(DISTINCT (to_name, path, line)) AS evidences, CASE WHEN object IS NOT NULL THEN 'resolved' ELSE 'external' END AS resolution FROM k WHERE object IS NOT NULL OR external <> '' GROUP BY kind, src, object, external""")
def edge_fold(spark, sf_dir):
    """M4, A2: relations of edges, confidences clamped, evidences told apart by name, path and line."""
    return integrity.folded_edges(_edges(spark, sf_dir), _symbols(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH e AS {EDG}, own AS (SELECT id FROM {SYM} WHERE path IN ('cmd/api/5.go', 'web/7.go'))
SELECT DISTINCT kind, src, dst, to_name FROM e WHERE path IN ('cmd/api/5.go', 'web/7.go') OR src IN (SELECT id FROM own) OR dst IN (SELECT id FROM own)""")
def impact_set(spark, sf_dir):
    """Relations that a commit of two files touches."""
    return integrity.touched_relations(_edges(spark, sf_dir), _symbols(spark, sf_dir), ["cmd/api/5.go", "web/7.go"])


@query("WITH RECURSIVE d AS (SELECT 3::BIGINT AS id UNION SELECT p_partkey FROM part JOIN d ON p_partkey // 3 = d.id AND p_partkey > 0) SELECT id FROM d")
def descendant_closure(spark, sf_dir):
    """All descendants over parent ids."""
    parents = read(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("parent"))
    return integrity.descendants(parents, spark.createDataFrame([(3,)], "id long"))


RULES = f"""WITH f AS {FIL}, s AS {SYM}, e AS {NUM}, v AS (SELECT vec_id * 7 AS id, embedding AS vector FROM embeddings),
x AS (SELECT 'file' AS entity, 'file_size_negative' AS code, path AS ref FROM f WHERE size < 0
UNION ALL SELECT 'symbol', 'symbol_language', s.id::VARCHAR FROM s JOIN f USING (path) WHERE s.language <> f.language
UNION ALL SELECT 'edge', 'edge_from_missing', seq::VARCHAR FROM e WHERE src NOT IN (SELECT id FROM s)
UNION ALL SELECT 'edge', 'edge_to_missing', seq::VARCHAR FROM e WHERE dst IS NOT NULL AND dst NOT IN (SELECT id FROM s)
UNION ALL SELECT 'edge', 'edge_unresolved', seq::VARCHAR FROM e WHERE dst IS NULL AND to_name = ''
UNION ALL SELECT 'edge', 'edge_path_missing', seq::VARCHAR FROM e WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT 'edge', 'edge_type', seq::VARCHAR FROM e WHERE kind NOT IN ('contains', 'calls', 'imports', 'inherits', 'implements')
UNION ALL SELECT 'edge', 'edge_confidence', seq::VARCHAR FROM e WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'embedding', 'embedding_orphan', id::VARCHAR FROM v WHERE id NOT IN (SELECT id FROM s))"""


def _violations(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 7).alias("id"), F.col("embedding").alias("vector"))
    return integrity.violations(_files(spark, sf_dir), _symbols(spark, sf_dir), _numbered(spark, sf_dir), vectors)


@query(f"{RULES} SELECT * FROM x")
def state_violations(spark, sf_dir):
    """Every broken invariant of files, symbols, edges and embeddings."""
    return _violations(spark, sf_dir)


@query(f"{RULES}, h AS (SELECT * FROM x ORDER BY entity, code, ref LIMIT 1000) SELECT * FROM h UNION ALL SELECT 'state', 'truncated', concat(1000, ' of ', count(*)) FROM x HAVING count(*) > 1000")
def reported_violations(spark, sf_dir):
    """The first thousand, and a marker of what was left out."""
    return integrity.capped(_violations(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY path, line, kind, src, dst NULLS FIRST, to_name) AS id, path, line, kind, src, dst, to_name FROM (SELECT DISTINCT path, line, kind, src, dst, to_name FROM {EDG})")
def repaired_edge_ids(spark, sf_dir):
    """Ids anew by structure, as the given ones repeat."""
    edges = _edges(spark, sf_dir).select("path", "line", "kind", "src", "dst", "to_name").distinct().withColumn("id", F.col("line").cast("long"))
    return integrity.repaired_ids(edges, integrity.ranked_ids)


@query(f"""WITH s AS {SYM}, n AS (SELECT 900000 + p_partkey AS id, p_name AS name, 'web/2.go' AS path FROM part WHERE p_size = 5), v AS (SELECT id, name, path FROM s WHERE path <> 'web/2.go' UNION ALL SELECT * FROM n)
SELECT id, name, path FROM v WHERE contains(lower(name), 'ring')""")
def overlay_search(spark, sf_dir):
    """Search in a view where an open buffer stands for its file."""
    new = read(spark, sf_dir, "part").where("p_size = 5").select((F.col("p_partkey") + 900_000).alias("id"), F.col("p_name").alias("name"), F.lit("web/2.go").alias("path"))
    return integrity.overlaid(_symbols(spark, sf_dir).select("id", "name", "path"), new, "web/2.go").where("contains(lower(name), 'ring')")


@query(f"""WITH f AS {FIL}, s AS {SYM}, d AS (SELECT DISTINCT l_orderkey AS artifact, 'file' AS kind, concat('web/', l_partkey % 60, '.go') AS ref, CASE WHEN l_linenumber = 1 THEN sha256(concat('web/', l_partkey % 60, '.go')) WHEN l_linenumber = 2 THEN 'old' ELSE '' END AS hash FROM lineitem UNION SELECT l_orderkey, 'symbol', (l_partkey + 20)::VARCHAR, '' FROM lineitem)
SELECT d.artifact, d.kind, d.ref, d.hash, CASE WHEN d.kind = 'file' THEN f.path IS NOT NULL AND (d.hash = '' OR d.hash = f.hash) ELSE s.id IS NOT NULL END AS fresh FROM d LEFT JOIN f ON d.kind = 'file' AND f.path = d.ref LEFT JOIN s ON d.kind = 'symbol' AND s.id::VARCHAR = d.ref""")
def dependency_check(spark, sf_dir):
    """Whether what an artifact was made of is still there."""
    lines = read(spark, sf_dir, "lineitem")
    ref = F.concat(F.lit("web/"), (F.col("l_partkey") % 60).cast("string"), F.lit(".go"))
    file = lines.select(F.col("l_orderkey").alias("artifact"), F.lit("file").alias("kind"), ref.alias("ref"), F.when(F.col("l_linenumber") == 1, F.sha2(ref, 256)).when(F.col("l_linenumber") == 2, "old").otherwise("").alias("hash"))
    symbol = lines.select(F.col("l_orderkey").alias("artifact"), F.lit("symbol").alias("kind"), (F.col("l_partkey") + 20).cast("string").alias("ref"), F.lit("").alias("hash"))
    return integrity.revalidated(file.unionByName(symbol).distinct(), _files(spark, sf_dir), _symbols(spark, sf_dir)).select("artifact", "kind", "ref", "hash", "fresh")


TARGETS = """SELECT l_orderkey * 10 + l_linenumber AS target_id, CASE l_linenumber % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'references' ELSE 'calls' END AS relationship, CASE WHEN l_tax = 0 THEN '' ELSE concat('web/', l_suppkey % 4, '.go') END AS path,
CAST(l_quantity AS BIGINT) AS first, CAST(l_quantity AS BIGINT) + l_linenumber % 2 AS last, l_returnflag = 'R' AS external, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_suppkey % 5 END AS symbol_id, l_linestatus AS label, round(1 - l_discount, 2) AS confidence, l_returnflag AS provenance FROM {lineitem} WHERE l_partkey < 60"""
MERGED = f"""t AS ({duck(TARGETS)}), o AS (SELECT *, max(last) OVER (PARTITION BY path, symbol_id ORDER BY first, last, target_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM t WHERE relationship = 'definition' AND symbol_id IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN prior IS NULL OR first > prior THEN 1 ELSE 0 END) OVER (PARTITION BY path, symbol_id ORDER BY first, last, target_id) AS grp FROM o),
m AS (SELECT relationship, path, external, arg_min({{'f': first, 'l': last, 't': target_id, 's': symbol_id, 'b': label, 'c': confidence}}, (-confidence, target_id)) AS w, string_agg(DISTINCT provenance, ',' ORDER BY provenance) AS provenance FROM g GROUP BY relationship, path, external, symbol_id, grp
UNION ALL SELECT relationship, path, external, arg_min({{'f': first, 'l': last, 't': target_id, 's': symbol_id, 'b': label, 'c': confidence}}, (-confidence, target_id)), string_agg(DISTINCT provenance, ',' ORDER BY provenance) FROM t WHERE NOT (relationship = 'definition' AND symbol_id IS NOT NULL) GROUP BY relationship, path, external, first, last, CASE WHEN path = '' THEN label END),
r AS (SELECT relationship, path, external, w.f AS first, w.l AS last, w.t AS target_id, w.s AS symbol_id, w.b AS label, w.c AS confidence, provenance FROM m)"""


def _targets(spark, sf_dir):
    return navigation.merged_targets(sql(spark, sf_dir, TARGETS, "lineitem")).withColumn("provenance", F.array_join("provenance", ","))


@query(f"WITH {MERGED} SELECT * FROM r")
def navigation_merge(spark, sf_dir):
    """One target for each place, definitions merged where ranges overlap."""
    return _targets(spark, sf_dir)


@query(f"WITH {MERGED} SELECT relationship, path, first, target_id, symbol_id, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 500 AS truncated FROM r ORDER BY relationship, external, path, first, symbol_id NULLS FIRST, target_id LIMIT 500")
def navigation_page(spark, sf_dir):
    """The order of targets, the limit of references, the total before it."""
    return navigation.limited(_targets(spark, sf_dir), "references").select("relationship", "path", "first", "target_id", "symbol_id", "total", "truncated")


@query(f"WITH t AS ({duck(TARGETS)}), s AS (SELECT * FROM t WHERE relationship = 'calls' AND target_id % 7 = 0) SELECT DISTINCT target_id, path, first, last FROM t f WHERE relationship = 'definition' AND (symbol_id IN (SELECT symbol_id FROM s WHERE symbol_id = 1) OR EXISTS (FROM s WHERE s.path = f.path AND s.first = f.first AND s.last = f.last))")
def confirmed_fallbacks(spark, sf_dir):
    """Fallbacks that a semantic target confirms by symbol or place."""
    rows = sql(spark, sf_dir, TARGETS, "lineitem")
    semantic = rows.where("relationship = 'calls' AND target_id % 7 = 0").withColumn("symbol_id", F.when(F.col("symbol_id") == 1, F.col("symbol_id")))
    return navigation.confirmed(rows.where("relationship = 'definition'").select("target_id", "symbol_id", "path", "first", "last"), semantic).select("target_id", "path", "first", "last").distinct()


CANDIDATES = """SELECT l_orderkey % 60 AS request, l_orderkey * 10000 + l_linenumber * 1000 + l_partkey AS seq, concat('e', l_suppkey % 40) AS evidence_id, l_suppkey % 40 AS symbol_id, concat('web/', l_suppkey % 9, '.go') AS path, l_linenumber AS line,
l_linenumber = 7 AND l_quantity > 48 AS is_target, CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'called_by' WHEN 2 THEN 'imports' ELSE '' END AS relation, l_linenumber % 3 AS distance, round(1 - l_discount * 9, 2) AS confidence,
'ast_observation' AS kind, CASE WHEN l_tax > 0.06 THEN 'file' ELSE 'function' END AS symbol_kind, CASE WHEN l_tax = 0 THEN 'semantic_candidate' ELSE 'lexical' END AS source, CAST(l_quantity AS INT) % 21 AS lexical_rank, l_suppkey % 11 AS dense_rank, 0 AS package_rank, l_returnflag AS provenance,
repeat('x', CAST(l_quantity AS INT) * 40) AS content, l_linestatus AS title FROM {lineitem} WHERE l_partkey < 300"""


def _score_sql(surface: str) -> str:
    p = evidence.POLICIES[surface]
    boost = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in p.relations.items())
    total = f"CASE WHEN is_target THEN {p.target}::DOUBLE ELSE 0 END + " + (f"CASE relation {boost} ELSE 0 END" if boost else "0") + f" + CASE WHEN distance > 0 THEN {p.near}::DOUBLE / distance ELSE 0 END - CASE WHEN confidence < 0.3 THEN {p.weak}::DOUBLE ELSE 0 END"
    total += {"base": " - CASE WHEN symbol_kind IN ('file', 'import') THEN 0.15::DOUBLE ELSE 0 END", "see_more": " - CASE WHEN source = 'semantic_candidate' AND relation = '' THEN 0.4::DOUBLE ELSE 0 END", "deepwiki": " + 1.0::DOUBLE - CASE WHEN distance > 0 THEN 0.3::DOUBLE ELSE 0 END"}.get(surface, "")
    return f"({total})"


@query(f"SELECT seq, evidence_id, " + ", ".join(f"round({_score_sql(s)}, 9) AS {s}" for s in evidence.POLICIES) + f" FROM ({duck(CANDIDATES)})")
def policy_scores(spark, sf_dir):
    """What each surface's policy gives a candidate."""
    return sql(spark, sf_dir, CANDIDATES, "lineitem").select("seq", "evidence_id", *[F.round(evidence.score(s), 9).alias(s) for s in evidence.POLICIES])


PACK = f"""c AS ({duck(CANDIDATES)}), q AS (SELECT *, greatest(0, least(1, CASE WHEN is_target THEN 1 ELSE 0 END + CASE WHEN lexical_rank > 0 THEN 1 / (60.0::DOUBLE + lexical_rank) ELSE 0 END + CASE WHEN dense_rank > 0 THEN 1 / (60.0::DOUBLE + dense_rank) ELSE 0 END + {_score_sql('hover')})) AS relevance FROM c),
m AS (SELECT request, evidence_id, arg_min({{'symbol_id': symbol_id, 'path': path, 'line': line, 'is_target': is_target, 'relevance': round(relevance, 9), 'size': least(length(content), 1400) + length(title)}}, seq) AS w, min(distance) AS distance, string_agg(DISTINCT provenance, ',' ORDER BY provenance) AS provenance FROM q GROUP BY request, evidence_id),
r AS (SELECT evidence_id, request, w.symbol_id AS symbol_id, w.path AS path, w.line AS line, w.is_target AS is_target, w.relevance AS relevance, w.size AS size, distance, provenance, row_number() OVER (PARTITION BY request ORDER BY w.relevance DESC, distance, w.path, w.line, w.symbol_id, evidence_id) AS rank FROM m)"""


def _pack(spark, sf_dir):
    rows = evidence.merged(sql(spark, sf_dir, CANDIDATES, "lineitem"), "hover").withColumn("relevance", F.round("relevance", 9)).withColumn("provenance", F.array_join("provenance", ","))
    return evidence.admitted(rows, "hover")


@query(f"""WITH RECURSIVE {PACK}, f AS (SELECT request, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS taken, false AS accepted FROM (SELECT DISTINCT request FROM r)
UNION ALL SELECT f.request, r.rank, used + CASE WHEN is_target OR (taken < 9 AND used + r.size <= 4000) THEN r.size ELSE 0 END, taken + (is_target OR (taken < 9 AND used + r.size <= 4000))::INT, is_target OR (taken < 9 AND used + r.size <= 4000) FROM f JOIN r ON r.request = f.request AND r.rank = f.rank + 1)
SELECT r.request, r.evidence_id, r.rank, r.distance, r.provenance, r.relevance, f.accepted FROM r JOIN f USING (request, rank)""")
def evidence_pack(spark, sf_dir):
    """Candidates merged, ordered, and let in by the budget."""
    return _pack(spark, sf_dir).select("request", "evidence_id", "rank", "distance", "provenance", "relevance", "accepted")


@query(f"""WITH RECURSIVE {PACK}, f AS (SELECT request, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS taken, false AS accepted FROM (SELECT DISTINCT request FROM r)
UNION ALL SELECT f.request, r.rank, used + CASE WHEN is_target OR (taken < 9 AND used + r.size <= 4000) THEN r.size ELSE 0 END, taken + (is_target OR (taken < 9 AND used + r.size <= 4000))::INT, is_target OR (taken < 9 AND used + r.size <= 4000) FROM f JOIN r ON r.request = f.request AND r.rank = f.rank + 1)
SELECT request, count(*) FILTER (accepted) AS kept, count(*) FILTER (NOT accepted) AS omitted, sum(CASE WHEN accepted THEN size ELSE 0 END)::BIGINT AS used, (sum(CASE WHEN accepted THEN size ELSE 0 END)::BIGINT + 3) // 4 AS tokens FROM r JOIN f USING (request, rank) GROUP BY request""")
def pack_report(spark, sf_dir):
    """What each pack used and left out."""
    used = F.sum(F.when(F.col("accepted"), F.col("size")).otherwise(0))
    return _pack(spark, sf_dir).groupBy("request").agg(F.count_if("accepted").alias("kept"), F.count_if(~F.col("accepted")).alias("omitted"), used.alias("used")).withColumn("tokens", F.expr("(used + 3) div 4"))


@query(f"""WITH RECURSIVE {PACK}, f AS (SELECT request, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS taken, false AS accepted FROM (SELECT DISTINCT request FROM r)
UNION ALL SELECT f.request, r.rank, used + CASE WHEN is_target OR (taken < 9 AND used + r.size <= 4000) THEN r.size ELSE 0 END, taken + (is_target OR (taken < 9 AND used + r.size <= 4000))::INT, is_target OR (taken < 9 AND used + r.size <= 4000) FROM f JOIN r ON r.request = f.request AND r.rank = f.rank + 1),
n AS (SELECT DISTINCT request, symbol_id FROM r JOIN f USING (request, rank) WHERE accepted), e AS (SELECT n.request, e.seq, e.src, e.dst, e.kind, row_number() OVER (PARTITION BY n.request ORDER BY seq) AS place FROM {NUM} e JOIN n ON n.symbol_id = e.src JOIN n m ON m.symbol_id = e.dst AND m.request = n.request)
SELECT request, seq, src, dst, kind FROM e WHERE place <= {evidence.POLICIES["hover"].edges}""")
def pack_graph(spark, sf_dir):
    """The edges of each pack, between admitted symbols only."""
    return evidence.compact_graph(_pack(spark, sf_dir), _numbered(spark, sf_dir), "hover")


@query("""SELECT DISTINCT source, kind, resolved, CASE WHEN source = 'gopls' THEN CASE WHEN kind = 'diagnostic' THEN 1.0 ELSE 0.95 END WHEN source = 'runtime' THEN 1.0 WHEN source = 'tree-sitter' AND kind = 'definition' THEN 1.0 WHEN source = 'tree-sitter' AND kind = 'call_outgoing' THEN CASE WHEN resolved THEN 1.0 ELSE 0.6 END WHEN source = 'tree-sitter' AND kind = 'reference' THEN 0.65 WHEN resolved THEN 0.95 ELSE 0.65 END::DOUBLE AS confidence FROM (
SELECT CASE l_linenumber % 4 WHEN 0 THEN 'gopls' WHEN 1 THEN 'runtime' WHEN 2 THEN 'tree-sitter' ELSE 'other' END AS source, CASE l_suppkey % 4 WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'definition' WHEN 2 THEN 'call_outgoing' ELSE 'reference' END AS kind, l_linestatus = 'F' AS resolved FROM lineitem)""")
def confidence_policy(spark, sf_dir):
    """Confidence by source, kind and resolution."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("CASE l_linenumber % 4 WHEN 0 THEN 'gopls' WHEN 1 THEN 'runtime' WHEN 2 THEN 'tree-sitter' ELSE 'other' END AS source", "CASE l_suppkey % 4 WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'definition' WHEN 2 THEN 'call_outgoing' ELSE 'reference' END AS kind", "l_linestatus = 'F' AS resolved").distinct()
    return rows.withColumn("confidence", S.fact_confidence(F.col("source"), F.col("kind"), F.col("resolved")))


IMPORTS = "SELECT DISTINCT concat('cmd/api/', p_partkey % 50, '.go') AS path, CASE WHEN p_partkey % 2 = 0 THEN 'fmt' ELSE 'web' END AS alias, CASE WHEN p_partkey % 2 = 0 THEN 'fmt' ELSE 'example.com/web' END AS import_path FROM {part}"


@query(f"""WITH i AS ({duck(IMPORTS)}), e AS (SELECT e.seq, e.kind, e.to_name, e.path, s.language FROM {NUM} e JOIN {SYM} s ON e.src = s.id WHERE e.dst IS NULL), j AS (SELECT e.*, i.import_path FROM e LEFT JOIN i ON i.path = e.path AND contains(e.to_name, '.') AND i.alias = split_part(e.to_name, '.', 1))
SELECT seq, import_path, CASE WHEN language <> 'go' THEN CASE WHEN to_name <> '' THEN 'external' END WHEN to_name = 'len' THEN 'builtin' WHEN kind = 'imports' THEN CASE WHEN to_name = '' THEN NULL WHEN contains(to_name, '.') THEN 'external' ELSE 'stdlib' END WHEN contains(to_name, '.') AND import_path IS NOT NULL THEN CASE WHEN contains(split_part(import_path, '/', 1), '.') THEN 'external' ELSE 'stdlib' END END AS external FROM j""")
def external_nodes(spark, sf_dir):
    """What unresolved edges point at, by the imports of their file."""
    own = _symbols(spark, sf_dir).select(F.col("id").alias("src"), "language")
    edges = _numbered(spark, sf_dir).where("dst IS NULL").join(own, "src")
    return codemap.with_imports(edges, sql(spark, sf_dir, IMPORTS, "part")).select("seq", "import_path", "external")


@query(f"""WITH s AS {SYM}, c AS (SELECT * FROM {NUM} WHERE kind = 'calls' AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)), a AS (SELECT s.id, s.name AS label, s.kind, (SELECT count(*) FROM c WHERE c.dst = s.id) AS incoming FROM s WHERE kind <> 'test' AND id IN (SELECT src FROM c)),
r AS (SELECT *, incoming = 0 AND kind NOT IN ('file', 'import') AS root FROM a) SELECT id, label, incoming, 50 AS points FROM r WHERE root OR NOT (SELECT bool_or(root) FROM r) ORDER BY id % 10 DESC, label, id LIMIT 4""")
def flow_roots(spark, sf_dir):
    """Where call flows begin."""
    nodes = _symbols(spark, sf_dir).select("id", F.col("name").alias("label"), "kind", "path", (F.col("id") % 10).alias("relevance"))
    return codemap.flow_roots(nodes, _edges(spark, sf_dir)).select("id", "label", "incoming", "points")


@query(f"""WITH t AS (SELECT concat(coalesce(a.name, ''), ' —', e.kind, '→ ', coalesce(b.name, '')) AS step, CASE e.kind WHEN 'contains' THEN 1 WHEN 'imports' THEN 2 ELSE 0 END AS priority, seq FROM {NUM} e LEFT JOIN {SYM} a ON a.id = e.src LEFT JOIN {SYM} b ON b.id = e.dst)
SELECT w.priority AS priority, w.seq AS seq, step FROM (SELECT step, min({{'priority': priority, 'seq': seq}}) AS w FROM t GROUP BY step) ORDER BY w LIMIT 12""")
def map_trace(spark, sf_dir):
    """The first distinct steps of a map."""
    return codemap.trace(_numbered(spark, sf_dir), _symbols(spark, sf_dir).select("id", F.col("name").alias("label")))


MODULE = "CASE WHEN path LIKE 'vendor/%' THEN 'vendor' WHEN path LIKE 'web/%' THEN 'web' ELSE concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) END"


@query(f"SELECT module, count(DISTINCT path) AS paths, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind <> 'file') AS symbols, arg_min(language, id) AS language FROM (SELECT *, {MODULE} AS module FROM {SYM}) GROUP BY module")
def code_modules(spark, sf_dir):
    """A5: modules by path, with files, symbols and first language."""
    return codemap.modules(_symbols(spark, sf_dir), T.module_key(F.col("path")))


@query(f"""WITH m AS (SELECT *, {MODULE} AS module FROM {SYM}), n AS (SELECT module, kind, count(*) AS n FROM m GROUP BY ALL), f AS (SELECT module, kind, id, row_number() OVER (PARTITION BY module ORDER BY id) AS r FROM m)
SELECT n.module, n.kind, n.n, count(f.id) AS among_first FROM n LEFT JOIN f ON f.module = n.module AND f.kind = n.kind AND r <= 40 GROUP BY n.module, n.kind, n.n""")
def module_kinds(spark, sf_dir):
    """Kinds in each module, and how many are among its first 40 symbols."""
    rows = _symbols(spark, sf_dir).withColumn("module", T.module_key(F.col("path")))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy("id"))).where("r <= 40")
    shown = first.groupBy("module", "kind").agg(F.count("*").alias("among_first"))
    return rows.groupBy("module", "kind").agg(F.count("*").alias("n")).join(shown, ["module", "kind"], "left").withColumn("among_first", F.coalesce("among_first", F.lit(0)))


@query(f"""WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS a FROM {SYM}), n AS (SELECT DISTINCT array_to_string(list_slice(a, 1, i - 1), '/') AS parent, a[i] AS name, CASE WHEN i < len(a) THEN 'directory' ELSE 'file' END AS type FROM p, unnest(range(1, len(a) + 1)) AS t(i))
SELECT parent, name, type, row_number() OVER (PARTITION BY parent ORDER BY type, name) AS seq FROM n""")
def file_tree(spark, sf_dir):
    """Directories, then files, by name."""
    return codemap.tree(_symbols(spark, sf_dir).select("path").distinct())


@query(f"WITH p AS (SELECT {MODULE} AS module, concat(id, signature) AS part FROM {SYM} UNION ALL SELECT {MODULE}, concat('file:', path, ':', hash) FROM {FIL} UNION ALL SELECT module, part FROM (SELECT DISTINCT module, seq, concat(e.src, ':', e.kind, ':', e.to_name) AS part FROM {NUM} e JOIN (SELECT *, {MODULE} AS module FROM {SYM}) m ON m.id = e.src OR m.id = e.dst) UNION ALL SELECT DISTINCT {MODULE}, unnest(['manifest=1', 'prompt=1']) FROM {SYM}) SELECT module, substr(sha256(string_agg(part, chr(10) ORDER BY part)), 1, 24) AS hash FROM p GROUP BY module")
def page_hashes(spark, sf_dir):
    """The source hash of each page from its files, symbols and edges."""
    key = T.module_key(F.col("path")).alias("module")
    symbols, files = _symbols(spark, sf_dir).select(key, "id", "signature"), _files(spark, sf_dir).select(key, "path", "hash")
    return codemap.source_hashes(codemap.page_parts(symbols, files, _numbered(spark, sf_dir), "module", ["manifest=1", "prompt=1"]), "module")


@query(f"""WITH g AS (SELECT * FROM {SYM} WHERE kind NOT IN ('file', 'import') AND CASE WHEN language = 'go' THEN regexp_matches(name, '^[A-Z]') ELSE kind IN ('class', 'interface', 'type', 'function') END)
SELECT name, path, id, greatest((SELECT count(*) FROM g) - 200, 0) AS omitted FROM g ORDER BY name, path, id LIMIT 200""")
def glossary(spark, sf_dir):
    """The first 200 public symbols, and how many are left out."""
    entries = _symbols(spark, sf_dir).where(S.is_glossary_entry(F.col("name"), F.col("kind"), F.col("language")))
    total = entries.agg(F.greatest(F.count("*") - 200, F.lit(0)).alias("omitted"))
    return entries.orderBy("name", "path", "id").limit(200).crossJoin(F.broadcast(total)).select("name", "path", "id", "omitted")  # total is one row


@query(f"""SELECT id, name, CASE WHEN contains(lower(name), 'main') THEN 0 WHEN contains(lower(name), 'server') OR contains(lower(name), 'app') THEN 1 ELSE 2 END AS rank FROM {SYM} WHERE kind = 'file' OR (kind IN ('function', 'type', 'class', 'interface') AND regexp_matches(name, '^[A-Z]')) OR lower(name) LIKE 'new%' ORDER BY rank, id LIMIT 40""")
def overview_seeds(spark, sf_dir):
    """What an overview begins with."""
    seeds = _symbols(spark, sf_dir).where(S.is_overview_seed(F.col("name"), F.col("kind"))).withColumn("rank", S.overview_rank(F.col("name")))
    return seeds.orderBy("rank", "id").limit(40).select("id", "name", "rank")


@query(f"SELECT id, name, path FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY CASE kind WHEN 'interface' THEN 0 WHEN 'type' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, name, id) AS r FROM {SYM} WHERE regexp_matches(name, '^[A-Z]')) WHERE r <= 5")
def package_api(spark, sf_dir):
    """The first five public symbols of each package."""
    kind = F.when(F.col("kind") == "interface", 0).when(F.col("kind") == "type", 1).when(F.col("kind") == "function", 2).otherwise(3)
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(kind, "name", "id"))
    return _symbols(spark, sf_dir).where(S.is_exported(F.col("name"))).withColumn("r", rank).where("r <= 5").select("id", "name", "path")


@query(f"SELECT id, size, CASE WHEN size > 1 THEN sha256(signature) END AS discriminator FROM (SELECT id, signature, count(DISTINCT signature) OVER (PARTITION BY qualified, kind, brand) AS size FROM {SYM} WHERE kind NOT IN ('file', 'import'))")
def overloads(spark, sf_dir):
    """Symbols whose key has several signatures take one as their discriminator."""
    rows = _symbols(spark, sf_dir).where(~F.col("kind").isin("file", "import"))
    sizes = rows.groupBy("qualified", "kind", "brand").agg(F.count_distinct("signature").alias("size"))
    return rows.join(sizes, ["qualified", "kind", "brand"]).select("id", "size", F.when(F.col("size") > 1, F.sha2("signature", 256)).alias("discriminator"))


@query(f"SELECT e.seq, e.line, trim(string_split(code, ' ')[1 + e.line - 1]) AS snippet FROM {NUM} e JOIN (SELECT id, concat(signature, ' ', summary) AS code FROM {SYM}) s ON s.id = e.src")
def edge_snippets(spark, sf_dir):
    """The line of code on which an edge lies."""
    code = _symbols(spark, sf_dir).select("id", F.replace(F.concat("signature", F.lit(" "), "summary"), F.lit(" "), F.lit("\n")).alias("code"), F.lit(1).alias("start_line"))
    return codemap.snippets(_numbered(spark, sf_dir), code).select("seq", "line", "snippet")


def _weighted() -> str:
    """Each field's terms in DuckDB, as often as its weight."""
    return ", ".join(f"flatten(list_transform(range({w}), lambda i: {_tokens(c)}))" for c, w in retrieval.FIELD_WEIGHTS.items())


FOUND = f"""ix AS (SELECT id, name, qualified, flatten([{_weighted()}]) AS t FROM {SYM}), c AS (SELECT *, len(t) AS len, len(list_filter(t, lambda x: x = 'red')) AS a, len(list_filter(t, lambda x: x = 'ring')) AS b FROM ix),
s AS (SELECT count(*) AS n, greatest(avg(len), 1.0) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
r AS (SELECT id, name, qualified, round(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * len / m)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * len / m)) ELSE 0 END, 9) AS score FROM c, s WHERE a + b > 0 ORDER BY score DESC, id LIMIT 80)"""


@query(f"""WITH {FOUND} SELECT id, name, round(score + CASE WHEN lower(name) = 'red.ring' THEN 8 WHEN contains(lower(name), 'red.ring') THEN 3 ELSE 0 END + CASE WHEN contains(lower(qualified), 'red.ring') THEN 1.5 ELSE 0 END, 6) AS score FROM r ORDER BY score DESC, id LIMIT 20""")
def fielded_search(spark, sf_dir):
    """Weighted fields, four times the limit, boosts by name, hydrated."""
    question = "red.Ring"
    terms = [r.t for r in spark.range(1).select(F.explode(T.query_tokens(F.lit(question))).alias("t")).collect()]  # a query's few words
    symbols = _symbols(spark, sf_dir)
    index = kept_index(symbols, read(spark, sf_dir, "part"), f"{sf_dir.rstrip('/')}/symbols", "id", retrieval.FIELD_WEIGHTS)
    return retrieval.searched(index.bm25(terms), symbols, question, 20).select("id", "name", F.round("score", 6).alias("score"))
