"""Views in which open buffers stand for their files, kept right without resolving everything anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import resolve


def replaced(base: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of all other files, and the buffers' own; paths: the few that are open."""
    return base.join(F.broadcast(paths), "path", "left_anti").unionByName(new)


def changed_names(before: DataFrame, after: DataFrame, paths: DataFrame) -> DataFrame:
    """(name) of what buffers add to symbols (id, name, path, is_file) or take away; symbols that stay as they were change nothing."""
    old = before.join(F.broadcast(paths), "path", "left_semi").select("id", "name", "path", "is_file")
    new = after.select("id", "name", "path", "is_file")
    return old.exceptAll(new).select("name").unionByName(new.exceptAll(old).select("name")).distinct()


def resolved_view(resolved: DataFrame, symbols: DataFrame, paths: DataFrame, new_symbols: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of a view: buffers' files are replaced, and the edges that this may touch resolved again.

    symbols: id, name, path, is_file; resolved: name, path, given (its confidence before any
    resolution), target, confidence, as resolve_names gives them; new_edges: name, path, given.
    Of the other files' edges only those need it whose name a buffer adds or takes away: their
    candidates are the ones that changed. The rest keep their targets, all of which are still there.
    """
    view = replaced(symbols, new_symbols, paths)
    names = changed_names(symbols, new_symbols, paths)
    others = resolved.join(F.broadcast(paths), "path", "left_anti")
    kept = others.join(names, "name", "left_anti")
    again = others.join(names, "name", "left_semi").select("name", "path", "given").unionByName(new_edges)
    asked = again.withColumn("confidence", F.col("given"))
    wanted = asked.select("name").distinct()
    fresh = resolve.resolve_names(asked, view.join(wanted, "name", "left_semi"))
    return view, kept.unionByName(fresh.select(*kept.columns))


def view_hash(snapshot: Column, document: Column, path: Column, version: Column, content_hash: Column) -> Column:
    """What tells a view apart: the snapshot below it and the buffer over it."""
    return F.concat(F.lit("view:"), F.sha2(F.concat_ws("\x00", snapshot, document, path, version.cast("string"), content_hash), 256))


def composite_states(overlays: DataFrame, files: DataFrame, snapshot: str) -> DataFrame:
    """overlays with `state` and `view`: whether each still fits on the newest snapshot, and its view's hash if so.

    overlays: document, path, version, content_hash, base_snapshot, base_hash; files: path, hash.
    A buffer over the same snapshot is current; over another one it is rebased, unless its file
    was changed in between, which makes it stale. Hashes that nobody knows don't make it so.
    """
    known = files.select("path", F.col("hash").alias("persisted"))
    elsewhere = (F.coalesce("base_snapshot", F.lit("")) != "") & (F.col("base_snapshot") != snapshot)
    differs = (F.coalesce("persisted", F.lit("")) != "") & (F.coalesce("base_hash", F.lit("")) != "") & (F.col("persisted") != F.col("base_hash"))
    state = F.when(elsewhere & differs, "stale").when(elsewhere, "rebased").otherwise("current")
    joined = overlays.join(known, "path", "left").withColumn("state", state)
    view = view_hash(F.lit(snapshot), F.col("document"), F.col("path"), F.col("version"), F.col("content_hash"))
    return joined.withColumn("view", F.when(F.col("state") != "stale", view)).drop("persisted")
