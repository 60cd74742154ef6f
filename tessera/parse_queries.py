"""Registered queries over what follows parsing: texts of symbols, local targets, summaries, vectors in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.code_queries import NUM, SYM, _numbered, _symbols
from tessera.functions import text as T
from tessera.operators import parsed
from tessera.queries import _tokens, query, read

CODE = "CASE doc_id % 4 WHEN 0 THEN concat(' ', chr(10), 'func é', doc_id, '(x int) { ', text) WHEN 1 THEN concat(repeat('é', 150), text) WHEN 2 THEN text ELSE concat(chr(13), chr(10), ' type X  {}', chr(10), text) END"
BLANK = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$"
LINE = rf"regexp_replace(regexp_extract(regexp_replace(code, '{BLANK}', '', 'g'), '^([^\n\r]*)', 1), '{BLANK}', '', 'g')"


def _cut(text: str, most: int, low: int) -> str:
    """DuckDB's form of truncated: as many characters as fit."""
    return f"CASE WHEN strlen({text}) <= {most} THEN {text} ELSE concat(left({text}, list_max(list_filter(range({low}, {most - 3}), lambda k: strlen(left({text}, k)) <= {most - 4}))), chr(10), '…') END"


@query(rf"""WITH c AS (SELECT doc_id, {CODE} AS code FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, code, {LINE} AS line FROM c), s AS (SELECT doc_id, code, CASE WHEN contains(line, '{{') THEN regexp_replace(split_part(line, '{{', 1), '{BLANK}', '', 'g') ELSE line END AS sig FROM l)
SELECT doc_id, {_cut("sig", 280, 60)} AS signature, sha256({_cut("code", 2000, 600)}) AS code FROM s""")
def symbol_texts(spark, sf_dir):
    """S8d: signatures and cut code; code is cut at 2,000 bytes instead of 16,000, so that many texts reach it."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(CODE).alias("code"))
    return docs.select("doc_id", parsed.signature(F.col("code")).alias("signature"), F.sha2(parsed.truncated(F.col("code"), 2000), 256).alias("code"))


LOCAL = "SELECT seq, path, CASE WHEN seq % 3 = 0 THEN dst END AS dst, CASE seq % 5 WHEN 0 THEN 'pkg.ring7' WHEN 1 THEN 'bolt3' WHEN 2 THEN 'x.y->widget1()' WHEN 3 THEN concat('gear', seq % 11) ELSE '' END AS to_name, confidence FROM {edges}"


@query(rf"""WITH e AS ({LOCAL.replace("{edges}", NUM)}), s AS (SELECT id, concat(name, id % 13) AS name, concat('cmd/api/', id % 50, '.go') AS path FROM {SYM}), n AS (SELECT path, name, count(DISTINCT id) AS n, min(id) AS found FROM s GROUP BY ALL)
SELECT e.seq, CASE WHEN e.dst IS NULL AND coalesce(w.n, l.n) = 1 THEN coalesce(w.found, l.found) ELSE e.dst END AS dst, CASE WHEN e.dst IS NULL AND coalesce(w.n, l.n) = 1 THEN 1.0 ELSE e.confidence END::DOUBLE AS confidence
FROM e LEFT JOIN n w ON w.path = e.path AND w.name = e.to_name LEFT JOIN n l ON w.n IS NULL AND l.path = e.path AND l.name = regexp_extract(e.to_name, '([\p{{L}}_$][\p{{L}}\p{{N}}_$]*)[^\p{{L}}\p{{N}}_$]*$', 1)""")
def local_targets(spark, sf_dir):
    """S8e: targets that an edge's own file settles."""
    edges = spark.sql(LOCAL, edges=_numbered(spark, sf_dir))
    symbols = _symbols(spark, sf_dir).select("id", F.expr("concat(name, id % 13)").alias("name"), F.expr("concat('cmd/api/', id % 50, '.go')").alias("path"))
    return parsed.local_targets(edges, symbols).select("seq", "dst", "confidence")


CALLED = "SELECT src, kind, concat(CASE WHEN kind = 'calls' AND seq % 4 > 0 THEN concat('f', seq % 23) ELSE '' END) AS to_name FROM {edges}"


@query(f"""WITH e AS ({CALLED.replace("{edges}", NUM)}), c AS (SELECT src, string_agg(to_name, ', ' ORDER BY to_name) AS calls FROM (SELECT DISTINCT src, to_name FROM e WHERE kind = 'calls' AND to_name <> '' QUALIFY dense_rank() OVER (PARTITION BY src ORDER BY to_name) <= 5) GROUP BY src), h AS (SELECT src, count(*) AS held FROM e WHERE kind = 'contains' GROUP BY src)
SELECT id, concat(CASE WHEN kind = 'file' THEN concat('File ', path, ' with ', coalesce(held, 0), ' indexed symbols') ELSE concat(kind, ' ', name, ' em ', path) END, coalesce('; calls ' || calls, ''), '.') AS summary FROM {SYM} s LEFT JOIN c ON c.src = s.id LEFT JOIN h ON h.src = s.id""")
def symbol_summaries(spark, sf_dir):
    """S8f: what each symbol is, where, and what it calls first."""
    return parsed.summaries(_symbols(spark, sf_dir).select("id", "name", "kind", "path"), spark.sql(CALLED, edges=_numbered(spark, sf_dir)))


def letters(texts: list[str]) -> list[list[float]]:
    """A provider for tests: how often a few letters stand in a text."""
    return [[float(t.count(c)) for c in "aeiou"] + [1.0] for t in texts]


@query("SELECT doc_id AS id, " + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS {c}" for c in "aeiou") + " FROM documents WHERE text IS NOT NULL")
def embedded_batches(spark, sf_dir):
    """Vectors from a provider that gets sixteen texts at once."""
    found = parsed.embedded(read(spark, sf_dir, "documents").where("text IS NOT NULL"), letters, id_col="doc_id")
    return found.select("id", *[F.col("vector")[i].alias(c) for i, c in enumerate("aeiou")])


SCOPED = "SELECT l_orderkey * 10 + l_linenumber AS fact, CASE l_suppkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN '' ELSE 'old' END AS snapshot_id, CASE l_partkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN NULL ELSE 'other' END AS document_id, l_linenumber AS document_version FROM {lineitem}"


@query(f"SELECT fact, snapshot_id, document_id, document_version FROM ({SCOPED.replace('{lineitem}', 'lineitem')}) WHERE snapshot_id IN ('', 'now') AND (document_id IS NULL OR (document_id = 'doc' AND document_version = 2))")
def scoped_facts(spark, sf_dir):
    """Facts of a snapshot and of one version of a document."""
    return parsed.in_scope(spark.sql(SCOPED, lineitem=read(spark, sf_dir, "lineitem")), "now", "doc", 2)


@query(f"SELECT item_id, array_to_string(list_transform(list_filter(t, lambda x, i: list_position(t, x) = i), lambda x: concat('\"', x, '\"')), ' OR ') AS expression FROM (SELECT item_id, {_tokens('text')} AS t FROM benchmark)")
def match_expressions(spark, sf_dir):
    """Questions as quoted words."""
    return read(spark, sf_dir, "benchmark").select("item_id", parsed.match_expression(T.tokens(F.col("text"))).alias("expression"))
