"""Keeping an index up to date: change detection, scoped relinking, snapshots, event streams.

Tables are compared, never mutated: each function takes the old and the new
state as tables and returns what changed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as T


def outcomes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, outcome): unchanged, touched, rewrote, added or vanished.

    Both states have path, hash and mtime. Equal content with another time is
    only touched; a note without a former or present row is structural.
    """
    o = old.select("path", F.col("hash").alias("h1"), F.col("mtime").alias("m1"), F.lit(True).alias("was"))
    n = new.select("path", F.col("hash").alias("h2"), F.col("mtime").alias("m2"), F.lit(True).alias("now"))
    j = o.join(n, "path", "full")
    same = F.col("h1").eqNullSafe(F.col("h2"))
    said = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "vanished").when(~same, "rewrote").when(F.col("m1").eqNullSafe(F.col("m2")), "unchanged").otherwise("touched")
    return j.select("path", said.alias("outcome"))


def is_structural(changed: DataFrame, alias_paths: DataFrame) -> DataFrame:
    """One row structural: does any change add or remove a name others may link to?"""
    some = changed.filter("outcome IN ('added', 'vanished', 'rewrote')").join(alias_paths.select("path").distinct().withColumn("named", F.lit(True)), "path", "left")
    return some.agg(F.coalesce(F.max((F.col("outcome") != "rewrote") | F.coalesce("named", F.lit(False))), F.lit(False)).alias("structural"))


def relinked(changed: DataFrame, structural: bool, links: DataFrame, resolve: Callable[[DataFrame], DataFrame], before: DataFrame) -> DataFrame:
    """The resolved links after a change: all again if structural, else those of rewritten notes only."""
    if structural:
        return resolve(links)
    dirty = changed.filter("outcome = 'rewrote'").select(F.col("path").alias("src_key"))
    kept = before.join(dirty, "src_key", "left_anti")
    return kept.unionByName(resolve(links.join(dirty, "src_key", "left_semi")))


def replaced(rows: DataFrame, dirty: DataFrame, fresh: DataFrame, key: str = "note_key") -> DataFrame:
    """Child rows with those of the dirty notes replaced."""
    return rows.join(dirty.select(key), key, "left_anti").unionByName(fresh)


def missing(stored: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """Stored rows whose path was not seen; none after a listing that was broken off."""
    gone = stored.join(seen.select("path"), "path", "left_anti")
    return gone if complete else gone.limit(0)


def retired(gone: DataFrame, resolved: DataFrame) -> DataFrame:
    """(note_key, stem, inbound): vanished notes that live on as placeholders because links lead to them."""
    inbound = resolved.groupBy(F.col("dst_key").alias("note_key")).agg(F.count(F.lit(1)).alias("inbound"))
    ghost = gone.join(inbound, "note_key").filter(T.is_note_like(F.col("stem")))
    return ghost.select(F.concat(F.lit("phantom:"), T.fold(F.col("stem"))).alias("note_key"), "stem", "inbound")


def upserts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(note_key, path, action): what becomes of each incoming note: updated where its path is stored,
    else promoted where a placeholder of its folded stem is, else inserted.

    Both tables have note_key, path and stem_fold, ``stored`` also phantom.
    """
    new = incoming.select("note_key", "path", "stem_fold").distinct()
    paths = stored.filter("NOT phantom").select("path", F.lit(True).alias("__known")).distinct()
    ghosts = stored.filter("phantom").select("stem_fold", F.lit(True).alias("__ghost")).distinct()
    j = new.join(paths, "path", "left").join(ghosts, "stem_fold", "left")
    action = F.when(F.col("__known"), "updated").when(F.col("__ghost"), "promoted").otherwise("inserted")
    return j.select("note_key", "path", action.alias("action"))


def purged(ghosts: DataFrame, needed: DataFrame) -> DataFrame:
    """(stem): the stored placeholders no link needs any more, or whose stem cannot name a note.

    needed are the placeholders of the present links (stem_fold).
    """
    idle = ghosts.select("stem").withColumn("stem_fold", T.fold(F.col("stem")))
    left = idle.join(needed.select("stem_fold").distinct(), "stem_fold", "left_anti").select("stem")
    return left.unionByName(ghosts.select("stem").filter(~T.is_note_like(F.col("stem")))).distinct()


def same_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src_key, same): do the two states hold the same links of each source, counted with repeats?"""
    count = lambda e, name: e.groupBy("src_key", "dst_key").agg(F.count(F.lit(1)).alias(name))
    j = count(old, "n1").join(count(new, "n2"), ["src_key", "dst_key"], "full")
    return j.groupBy("src_key").agg(F.min(F.col("n1").eqNullSafe(F.col("n2"))).alias("same"))


def link_signatures(edges: DataFrame, hash_bits: int = 38) -> DataFrame:
    """(node, signature): the same for equal neighbour sets in any order.

    A sum of hashes, so neighbours of a hub are added up map-side and never
    gathered into one array.
    """
    sym = edges.select(F.col("src_key").alias("node"), F.col("dst_key").alias("other")).unionByName(edges.select(F.col("dst_key").alias("node"), F.col("src_key").alias("other"))).distinct()
    return sym.groupBy("node").agg(F.sum(F.xxhash64("other").cast(f"decimal({hash_bits},0)")).alias("signature"))


def with_overlay(mentions: DataFrame, overlay: DataFrame) -> DataFrame:
    """Mentions with those of unsaved texts in place of the stored ones of the same sources."""
    return mentions.join(overlay.select("src_key").distinct(), "src_key", "left_anti").unionByName(overlay)


#: Seconds between looks at open texts, and between sweeps unwatched, watched and on mounts.
OPEN_SECONDS, SWEEP_SECONDS = 2, {"unwatched": 15, "watched": 300, "mount": 1800}


def next_task(full: bool, waiting: int, sweep_due: bool) -> str | None:
    """What runs next: a full scan before pending paths before a sweep."""
    return "full" if full else "pending" if waiting else "sweep" if sweep_due else None


def dirty_notes(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of notes that a batch of changes touched."""
    return notes.join(changed.filter("outcome <> 'unchanged'").select("path"), "path", "left_semi")


# -- events


def routed(events: DataFrame) -> DataFrame:
    """(path, action) of file events (path, kind, old_path, truncated): read, sweep; renames give both paths."""
    sweep = F.coalesce("truncated", F.lit(False)) | (F.col("kind") == "dir")
    both = F.filter(F.array("path", F.when(F.col("kind") == "rename", F.col("old_path"))), lambda p: p.isNotNull())
    rows = events.select(F.explode(both).alias("path"), sweep.alias("sweep"))
    action = F.when(F.col("sweep") | T.is_media_file(F.col("path")), "sweep").when(T.is_note_file(F.col("path")), "read")
    return rows.select("path", action.alias("action")).filter("action IS NOT NULL")


def pending(actions: DataFrame) -> DataFrame:
    """(path, action): one entry per path; if anything asks for a sweep, the sweep alone after the reads."""
    return actions.groupBy("path").agg(F.min("action").alias("action"))


def follow(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run ``handle(pending paths, batch)`` for each micro-batch of an event stream.

    The checkpoint has to lie in a folder all executors share; a batch that
    failed half way is handed over again, so ``handle`` has to be idempotent.
    """

    def batch(df: DataFrame, number: int) -> None:
        handle(pending(routed(df)), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# -- snapshots


def publish(tables: dict[str, DataFrame], root: str, version: int, meta: dict | None = None) -> None:
    """Write the tables of a version, then the pointer to it; readers never see half a version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    spark: SparkSession = next(iter(tables.values())).sparkSession
    row = json.dumps({"version": version, "complete": True, **(meta or {})})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/pointer-{version}")


def current(spark: SparkSession, root: str) -> dict | None:
    """The meta row of the newest complete version, None if there is none."""
    try:
        rows = spark.read.text(f"{root}/pointer-*").collect()  # one row per version
    except AnalysisException:
        return None
    return max(map(json.loads, (r[0] for r in rows)), key=lambda m: m["version"], default=None)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    meta = current(spark, root)
    if meta is None:
        raise FileNotFoundError(f"no complete version in {root}")
    return spark.read.parquet(f"{root}/v{meta['version']}/{name}")
