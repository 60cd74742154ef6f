"""Workspace files as a table: scan, language, hash, size cap, ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import language
from tessera.operators.lineage import Files

#: Directories that are never scanned (fixed values).
IGNORED = (
    ".git", "node_modules", "vendor", "dist", "build", ".venv", "venv", ".tox", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "coverage", ".next", ".idea", ".vscode", "target", "bin", "obj",
)


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression: * and ? stay within a segment, brackets hold classes, a backslash quotes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inside = pattern[i + 1 : close]
            out += "[" + ("^/" + inside[1:] if inside[0] == "^" else inside).replace("[", r"\[") + "]"
            i = close
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def ignored(path: Column, patterns: list[str] = ()) -> Column:
    """Whether a default directory or a pattern covers a path.

    A pattern fits the whole path from the root, or what lies below a folder of just that name; one
    without a slash fits any segment too. Comments and lines that begin with '!' say nothing.
    """
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED]))
    for line in patterns:
        p = line.strip()
        if not p or p.startswith(("#", "!")):
            continue
        p = p.removeprefix("/").removesuffix("/")
        if p:
            ends = ("^", "$") if "/" in p else ("(^|/)", "(/|$)")
            hit = hit | path.rlike(f"{ends[0]}{_glob(p)}{ends[1]}") | path.startswith(f"{p}/")
    return hit


def listed(spark: SparkSession, root: str, patterns: list[str] = ()) -> list[str]:
    """Files under `root` of a known kind that nothing ignores, level by level; ignored folders are never opened.

    Names only, as a listing of Spark's own would hold.
    """
    files, base, level, found = Files(spark), _plain(root), [root], []
    while level:
        each = [(path, folder, _plain(path)[len(base) + 1 :]) for d in level for path, folder in files.children(d)]
        rows = spark.createDataFrame(each, "at string, folder boolean, path string").where(~ignored(F.col("path"), patterns)).where(F.col("folder") | language(F.col("path")).isNotNull())
        kept = [(r.at, r.folder) for r in rows.select("at", "folder").collect()]
        level = sorted(at for at, folder in kept if folder)
        found += [at for at, folder in kept if not folder]
    return sorted(found)


def _plain(path: str) -> str:
    return re.sub("^file:/*", "/", path).rstrip("/")


def scan(spark: SparkSession, root: str, patterns: list[str] = (), most_bytes: int = 2 << 20) -> DataFrame:
    """(path, language, content_hash, size, modified_at, content) of indexable files under `root`.

    Only these are opened. Length is a column of the listing, so that the size cap holds before a file is read.
    """
    found = listed(spark, root, patterns)
    if not found:
        return spark.createDataFrame([], "path string, language string, content_hash string, size long, modified_at timestamp, content binary")
    files = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?^])", r"\\\1", f) for f in found]).where(F.col("length") <= most_bytes)
    base = _plain(root)
    path = F.substring("path", F.instr("path", f"{base}/") + len(base) + 1, F.length("path"))
    rows = files.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    return rows.select("path", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), "size", "modified_at", "content")
