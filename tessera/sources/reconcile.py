"""What a scan of everything, of listed paths or of a subtree changes in the files that are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.symbols import project_language
from tessera.functions.text import language
from tessera.sources.files import ignored


def supported(path: Column) -> Column:
    """Source files of a known language and allow-listed project files."""
    return language(path).isNotNull() | project_language(path).isNotNull()


def under(path: Column, root: str) -> Column:
    root = root.strip("/")
    return F.lit(True) if root in ("", ".") else (path == root) | path.startswith(f"{root}/")


def reconcile(known: DataFrame, observed: DataFrame, patterns: list[str] = (), *, paths: DataFrame | None = None, subtree: str | None = None, most_bytes: int = 2 << 20) -> DataFrame:
    """(path, change, reason): files to read anew (`added`, `changed`) and to delete, with the reason.

    known: path, content_hash; observed: path, content_hash, size, what lies on disk, whatever its
    kind; a null hash is a file that couldn't be read, which keeps its known version. Only `paths`
    (path) or what lies below `subtree` is looked at, all by default. A known path goes if it
    isn't there, is ignored, or of no supported kind (became_ignored, became_unsupported, else
    removed); a subtree that has become a file drops everything below it. Files over `most_bytes` are as
    if they were not there. One join by path.
    """
    within = under(F.col("path"), subtree) if subtree is not None else F.lit(True)
    limit = (lambda df: df.join(paths.select("path").distinct(), "path", "left_semi")) if paths is not None else lambda df: df
    wanted = ~ignored(F.col("path"), patterns) & supported(F.col("path")) & (F.col("size") <= most_bytes)
    here = limit(observed.where(within & wanted)).select("path", F.struct("content_hash").alias("new"))
    both = limit(known.where(within)).select("path", F.struct("content_hash").alias("old")).join(here, "path", "full_outer")
    old, new = F.col("old.content_hash"), F.col("new.content_hash")
    change = (
        F.when(F.col("new").isNull(), "deleted").when(new.isNull(), None)
        .when(F.col("old").isNull(), "added").when(~old.eqNullSafe(new), "changed")
    )
    reason = F.when(F.col("new").isNull(), F.when(ignored(F.col("path"), patterns), "became_ignored").when(~supported(F.col("path")), "became_unsupported").otherwise("removed"))
    return both.select("path", change.alias("change"), F.coalesce(reason, F.lit("")).alias("reason")).where("change IS NOT NULL")


def quarantined(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """changes without the files that couldn't be parsed (path, error): these keep their known version; they come as `quarantined`, with the error as reason."""
    bad = failed.groupBy("path").agg(F.min("error").alias("error"))
    joined = changes.join(bad, "path", "left")
    hit = F.col("error").isNotNull() & (F.col("change") != "deleted")
    return joined.select("path", F.when(hit, "quarantined").otherwise(F.col("change")).alias("change"), F.when(hit, F.col("error")).otherwise(F.col("reason")).alias("reason"))
