"""Column functions on text, identifiers, paths and hashes; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never indexed (fixed values).
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "of", "to", "in", "on", "is", "as", "by")
#: File extension to language (fixed values).
LANGUAGES = {
    ".go": "go", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascriptreact",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescriptreact",
    ".swift": "swift", ".py": "python", ".rs": "rust",
}
#: Where an identifier breaks: pattern and replacement, applied in this order.
BREAKS = (
    (r"(\p{Ll})(\p{Lu})", "$1 $2"),
    (r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"),
    (r"(\p{Nd})([^\p{Nd} ])", "$1 $2"),
    (r"([^\p{Nd} ])(\p{Nd})", "$1 $2"),
)
WORD_BREAK = r"[^\p{L}\p{Nd}]+"
BREAK = r"\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}|\p{Nd}[^\p{Nd}]|[^\p{Nd}]\p{Nd}"


def pieces(word: Column) -> Column:
    """A word in lower case, then its camel-case, acronym and digit pieces, each once."""
    broken = word
    for pattern, by in BREAKS:
        broken = F.regexp_replace(broken, pattern, by)
    parts = F.array_distinct(F.concat(F.array(F.lower(word)), F.transform(F.split(broken, " "), F.lower)))
    return F.when(word.rlike(BREAK), parts).otherwise(F.array(F.lower(word)))


def _kept(terms: Column) -> Column:
    return F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def tokens(text: Column) -> Column:
    """Index terms in order; repetitions across words stay and count as frequency."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
    return _kept(F.flatten(F.transform(words, pieces)))


def query_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def final_token(name: Column) -> Column:
    """What follows the last dot, double colon, slash or space of a name."""
    return F.regexp_extract(F.trim(name), r"([^.:/\s]*)$", 1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def language(path: Column) -> Column:
    """Language by extension; null for files that are not indexed."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, ext)


def module_key(path: Column, grouped=("cmd", "internal", "pkg", "packages", "apps", "src")) -> Column:
    """The module of a path: its first segment, or two where the first only groups; 'root' for bare files."""
    parts = F.split(path, "/")
    two = F.concat_ws("/", F.slice(parts, 1, 2))
    return F.when(F.size(parts) == 1, "root").when((F.size(parts) >= 3) & parts[0].isin(*grouped), two).otherwise(parts[0])


def normal_path(path: Column) -> Column:
    """Forward slashes, no '.' segments, '..' folded; null if it is absolute or leaves the root."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    up = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when((F.size(acc) == 0) | (F.element_at(acc, -1) == ".."), F.concat(acc, F.array(p))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    folded = F.aggregate(parts, none, up)
    bad = path.rlike(r"^([\\/]|[A-Za-z]:)") | (F.size(folded) == 0) | (F.get(folded, F.lit(0)) == "..")
    return F.when(~bad, F.array_join(folded, "/"))


def framed_hash(*fields: Column, digits: int = 64) -> Column:
    """SHA-256 over NUL-joined fields (null as ''), its first hexadecimal digits."""
    joined = F.concat_ws("\x00", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.substring(F.sha2(joined, 256), 1, digits)


def estimated_tokens(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4)


def snippet(text: Column, terms: list[str], before: int = 90, width: int = 360) -> Column:
    """A window that begins `before` characters ahead of the first term found, with ellipses."""
    places = F.filter(F.array(*[F.locate(t, F.lower(text)) for t in terms]), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - before, F.lit(1))
    head = F.when(start > 1, "...").otherwise("")
    tail = F.when(start + width <= F.length(text), "...").otherwise("")
    return F.concat(head, F.substring(text, start, F.lit(width)), tail)
