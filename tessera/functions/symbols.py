"""Predicates and labels of symbols, paths, edges and facts; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Project files by lower-case name (fixed values): language, and whether only their metadata is kept.
PROJECT_FILES = {"go.mod": "gomod", "go.sum": "text", "package.json": "json", "tsconfig.json": "json", "makefile": "makefile", ".env.example": "dotenv"}
PROJECT_PREFIXES = {"dockerfile": "dockerfile", "readme": "markdown"}
#: Functions of the language itself, which no node stands for (fixed values).
BUILTINS = ("append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover")
LANGUAGE_SERVERS = ("gopls", "typescript-lsp", "sourcekit-lsp", "pyright-langserver", "rust-analyzer")
#: Bytes of a project file's preview.
#: Project files of which nothing but size and hash is kept (fixed values).
METADATA_ONLY = ("go.sum",)
PREVIEW = 8192


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def project_language(path: Column) -> Column:
    """Language of a project file by its name; null for all others."""
    name = F.lower(base_name(path))
    found = reduce(lambda w, x: w.when(name == x[0], x[1]), PROJECT_FILES.items(), F.when(F.lit(False), ""))
    for prefix, language in PROJECT_PREFIXES.items():
        found = found.when((name == prefix) | name.startswith(prefix + "."), language)
    return found


def preview(text: Column, limit: int = PREVIEW) -> Column:
    """The first `limit` bytes, cut after the last line break if that leaves more than half.

    A character that the cut breaks is one replacement character.
    """
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string"))
    lines = F.regexp_extract(head, r"(?s)^(.*\n)", 1)
    return F.when(F.octet_length(text) <= limit, text).when(F.octet_length(lines) > limit // 2 + 1, lines).otherwise(head)


def keeps_content(path: Column) -> Column:
    """Whether a project file's preview is kept; of some only the metadata is."""
    return ~F.lower(base_name(path)).isin(*METADATA_ONLY)


def is_exported(name: Column) -> Column:
    """Whether the first letter is upper case."""
    return name.rlike(r"^\p{Lu}")


def is_overview_seed(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    entry = low.isin("main", "app", "server") | low.startswith("new") | low.endswith("handler")
    return entry | (kind == "file") | (kind.isin("function", "type", "class", "interface") & name.rlike("^[A-Z]"))


def overview_rank(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("main"), 0).when(low.contains("server") | low.contains("app"), 1).otherwise(2)


def is_glossary_entry(name: Column, kind: Column, language: Column) -> Column:
    other = kind.isin("class", "interface", "type", "function")
    return (name != "") & ~kind.isin("file", "import") & F.when(language == "go", is_exported(name)).otherwise(other)


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = base_name(low)
    return low.rlike(r"(^|/)(test|tests|__tests__)/") | name.endswith("_test.go") | name.contains(".test.") | name.contains(".spec.")


def is_test_symbol(name: Column, kind: Column, language: Column, path: Column) -> Column:
    """By language: functions and classes with a test's name, in Python and Swift in test files only."""
    low = F.lower(path)
    base, in_tests = base_name(low), low.contains("/tests/") | low.startswith("tests/")
    callable_ = kind.isin("function", "method")
    python = (in_tests | base.startswith("test_") | base.endswith("_test.py")) & (
        (callable_ & F.lower(name).startswith("test_")) | ((kind == "class") & (name.startswith("Test") | name.endswith("Tests") | name.endswith("TestCase")))
    )
    swift = in_tests & ((callable_ & name.startswith("test")) | ((kind == "class") & name.endswith("Tests")))
    other = (kind == "function") & (name.startswith("Test") | low.endswith("_test.go") | low.contains(".test.") | low.contains(".spec."))
    return F.when(language == "rust", False).when(language == "python", python).when(language == "swift", swift).otherwise(other)


def in_scope(path: Column, paths: list[str], prefixes: list[str]) -> Column:
    """Whether a path is one of `paths` or below one of the directories."""
    return reduce(lambda c, p: c | path.startswith(p.rstrip("/") + "/"), prefixes, path.isin(*paths) if paths else F.lit(False))


def fact_confidence(source: Column, kind: Column, resolved: Column) -> Column:
    """Confidence of a fact by its source, kind and whether its target is resolved."""
    return (
        F.when(source.isin(*LANGUAGE_SERVERS), F.when(kind == "diagnostic", 1.0).otherwise(0.95))
        .when(source == "runtime", 1.0)
        .when((source == "tree-sitter") & kind.isin("definition", "hover_type"), 1.0)
        .when((source == "tree-sitter") & kind.isin("syntactic_call", "call_outgoing", "call_incoming"), F.when(resolved, 1.0).otherwise(0.6))
        .when((source == "tree-sitter") & (kind == "reference"), 0.65)
        .otherwise(F.when(resolved, 0.95).otherwise(0.65))
    )


def external_kind(edge_kind: Column, to_name: Column, language: Column, imported: Column) -> Column:
    """builtin, stdlib or external of an unresolved edge; null where no node stands for it.

    imported: the import path that the receiver of a call stands for in its file, or null.
    """
    package = lambda p: F.when((F.trim(p) != "") & ~F.split(F.trim(p), "/")[0].contains(".") & (F.split(F.trim(p), "/")[0] != ""), "stdlib").otherwise("external")
    named = F.when(F.trim(to_name) != "", "external")
    go = F.when(F.trim(to_name).isin(*BUILTINS), "builtin").when(edge_kind == "imports", F.when(to_name != "", package(to_name))).when(to_name.contains(".") & imported.isNotNull(), package(imported))
    return F.when(language == "go", go).otherwise(named)


def sanitized_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
