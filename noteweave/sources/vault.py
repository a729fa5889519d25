"""A folder of notes as tables: listing, skip rules, contents, media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as T


# Both note extensions in any case.
_NOTES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in ("md", "markdown")) + "}"


def count_files(spark: SparkSession, root: str) -> int:
    """Files below a root, hidden ones left out; names alone are read."""
    return _listed(spark, root).count()


def listing(spark: SparkSession, root: str, most: int = 10_000_000) -> DataFrame:
    """(path, kind, size, mtime) of every file below a root but hidden ones; contents are not read.

    kind is note, media or other. Spark's own listing also hides names that
    begin with '_'; folders that need them have to be listed another way.
    ``most`` is the runaway guard of a scan: the files are counted first, and
    a root that holds more is an error; no file is left out in silence.
    """
    if (n := count_files(spark, root)) > most:
        raise ValueError(f"{root} holds {n} files, more than {most}")
    return _listed(spark, root)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if root.startswith("file:") else "file:" + root
    path = T.vault_relative(F.regexp_replace("path", "^file:/*", "file:/"), "file:/" + base.removeprefix("file:").lstrip("/"))
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter("path IS NOT NULL")
    kind = F.when(T.is_media_file(F.col("path")), "media").when(T.is_note_file(F.col("path")), "note").otherwise("other")
    return rows.filter(~F.col("path").rlike(r"(^|/)\.")).select("path", kind.alias("kind"), "size", "mtime")


def unread(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Notes of a listing that have to be read: not too large, and new or changed in time or size."""
    s = stored.select(F.col("path").alias("p2"), F.col("size").alias("s2"), F.col("mtime").alias("m2"))
    j = seen.filter((F.col("kind") == "note") & (F.col("size") <= T.MAX_FILE)).join(s, F.col("path") == F.col("p2"), "left")
    return j.filter("p2 IS NULL OR NOT size <=> s2 OR NOT mtime <=> m2").select("path", "kind", "size", "mtime")


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(note_key, text, hash) of the wanted paths; bytes are kept as they are, CR included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _NOTES).load(root)
    base = "file:/" + root.removeprefix("file:").lstrip("/")
    path = T.vault_relative(F.regexp_replace("path", "^file:/*", "file:/"), base)
    rows = files.filter(F.col("length") <= T.MAX_FILE).select(path.alias("path"), "content")
    return rows.join(wanted.select("path"), "path", "left_semi").select(F.col("path").alias("note_key"), F.decode("content", "UTF-8").alias("text"), F.xxhash64("content").alias("hash"))


def media(seen: DataFrame) -> DataFrame:
    """(path, stem, stem_fold, name_fold) of the media files of a listing."""
    name = T.base_name(F.col("path"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return seen.filter("kind = 'media'").select("path", stem.alias("stem"), T.fold(stem).alias("stem_fold"), T.fold(name).alias("name_fold"))


def scoped(seen: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the paths asked for, the files that are there and the paths that are gone."""
    return seen.join(paths, "path", "left_semi"), paths.join(seen, "path", "left_anti")
