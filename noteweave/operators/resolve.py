"""Link resolution: which note does a target mean, seen from a source folder?

Targets are percent-decoded, cut at the fragment and normalised. A target with
a separator is a path: looked up from the source folder, then (unless it is
explicitly relative) from the vault, exact case before folded case. A bare
name goes through four passes, exact stem, exact alias, folded stem, folded
alias; the first with a hit wins, several paths in it make the link ambiguous
and the nearest note is taken: same folder, fewer folders deep, more folders
shared, smaller path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.session import cut


def living(notes: DataFrame) -> DataFrame:
    """(note_key, path, stem): each note that has a file, once."""
    return notes.filter("alive AND NOT phantom").select("note_key", "path", "stem").distinct()


def candidates(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(note_key, path, name, is_alias): one row per note and name it answers to."""
    real = living(notes)
    own = real.select("note_key", "path", F.col("stem").alias("name"), F.lit(False).alias("is_alias"))
    other = aliases.select("note_key", F.col("alias").alias("name")).distinct().join(real.select("note_key", "path"), "note_key")
    return own.unionByName(other.select("note_key", "path", "name", F.lit(True).alias("is_alias"))).filter("name <> ''")


def media_candidates(media: DataFrame) -> DataFrame:
    """(path, name): a media file answers to its stem and to its full name."""
    name = T.base_name(F.col("path"))
    both = F.array(name, F.regexp_replace(name, r"\.[^.]*$", ""))
    return media.select("path", F.explode(F.array_distinct(both)).alias("name"))


def target_of(raw: Column) -> Column:
    return T.normalize(T.strip_fragment(T.percent_decoded(raw)))


def phantom_stem(raw: Column) -> Column:
    """Stem of the placeholder an unresolved target makes: neither decoded nor cut at a fragment."""
    return F.element_at(F.split(T.normalize(raw), "/"), -1)


def _above(folder: Column) -> Column:
    """The folders above a folder and itself, as (level, dir); the vault is level 0."""
    parts = F.split(folder, "/")
    root = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("dir")))
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    return F.when(folder == "", root).otherwise(F.concat(root, below))


def resolve_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(target, source_dir, dst_key, dst_path, ambiguous, pass) of distinct name targets that hit.

    Names are grouped once: by exact name for the first two passes, by folded
    name for the others, stems apart from aliases. A target takes the first
    group that exists. Of a group with one path nothing is left to choose. Of
    the others the nearest path is looked up in the folders above the source:
    each group keeps, for every folder above its shallowest notes, the
    smallest path below, and for every folder its own smallest path. So a name
    that stands in every folder costs rows in proportion to its notes and
    askers times their depth, never notes times askers.
    """
    folder = T.dir_of(F.col("path"))
    fold = T.fold(F.col("name"))
    kinds = F.array(F.struct(F.lit("=").alias("kind"), F.col("name").alias("key"), F.when(F.col("is_alias"), 2).otherwise(1).alias("pass")), F.struct(F.lit("~").alias("kind"), fold.alias("key"), F.when(F.col("is_alias"), 4).otherwise(3).alias("pass")))
    named = cut(names.select("path", "note_key", F.explode(kinds).alias("g")).select("g.*", F.struct("path", "note_key").alias("at"), folder.alias("dir"), T.depth_of(F.col("path")).alias("depth")))
    group = ["kind", "key", "pass"]
    groups = named.groupBy(*group).agg(F.min("at").alias("only"), (F.min("at.path") != F.max("at.path")).alias("ambiguous"), F.min("depth").alias("least"))
    wanted = F.array(F.struct(F.lit("=").alias("kind"), F.col("target").alias("key")), F.struct(F.lit("~").alias("kind"), T.fold(F.col("target")).alias("key")))
    hit = asked.select("target", "source_dir", F.explode(wanted).alias("k")).select("target", "source_dir", "k.*").join(groups, ["kind", "key"])
    first = cut(hit.groupBy("target", "source_dir").agg(F.min(F.struct("pass", "kind", "key", "only", "ambiguous")).alias("b")).select("target", "source_dir", "b.*"))

    many = named.join(groups.filter("ambiguous").select(*group, "least"), group)
    own = many.select(*group, F.lit(1 << 20).alias("level"), "dir", "at")
    above = many.filter(F.col("depth") == F.col("least")).select(*group, F.explode(_above(F.col("dir"))).alias("f"), "at").select(*group, "f.level", "f.dir", "at")
    places = own.unionByName(above).groupBy(*group, "level", "dir").agg(F.min("at").alias("at"))
    look = F.concat(F.array(F.struct(F.lit(1 << 20).alias("level"), F.col("source_dir").alias("dir"))), _above(F.col("source_dir")))
    seek = first.filter("ambiguous").select("target", "source_dir", *group, F.explode(look).alias("f")).select("target", "source_dir", *group, "f.level", "f.dir")
    near = seek.join(places, [*group, "level", "dir"]).groupBy("target", "source_dir", "pass").agg(F.max_by("at", "level").alias("at"))
    single = first.filter("NOT ambiguous").select("target", "source_dir", "pass", F.col("only").alias("at"), "ambiguous")
    best = single.unionByName(near.select("target", "source_dir", "pass", "at", F.lit(True).alias("ambiguous")))
    return best.select("target", "source_dir", F.col("at.note_key").alias("dst_key"), F.col("at.path").alias("dst_path"), "ambiguous", "pass")


def resolve_paths(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, source_dir, dst_key, dst_path, ambiguous, pass) of distinct path targets that hit.

    pass is 1 or 2 from the source folder, 3 or 4 from the vault, the odd ones
    in exact case. A path is never ambiguous.
    """
    real = living(notes).select("note_key", "path", T.without_extension(F.col("path")).alias("bare"))
    real = real.withColumn("__fold", T.fold(F.col("bare")))
    here = T.joined_path(F.col("source_dir"), F.col("target"))
    root = F.when(~T.is_relative(F.col("target")) & (F.col("source_dir") != ""), T.joined_path(F.lit(""), F.col("target")))
    ways = F.filter(F.array(F.struct(F.lit(0).alias("from_root"), here.alias("way")), F.struct(F.lit(2).alias("from_root"), root.alias("way"))), lambda w: w["way"].isNotNull())
    way = asked.select("target", "source_dir", F.explode(ways).alias("w")).select("target", "source_dir", "w.from_root", "w.way")
    hit = way.withColumn("__fold", T.fold(F.col("way"))).join(real, "__fold")
    rank = F.col("from_root") + F.when(F.col("bare") == F.col("way"), 1).otherwise(2)
    best = hit.groupBy("target", "source_dir").agg(F.min(F.struct(rank.alias("pass"), F.col("path"), F.col("note_key"))).alias("b"))
    return best.select("target", "source_dir", F.col("b.note_key").alias("dst_key"), F.col("b.path").alias("dst_path"), F.lit(False).alias("ambiguous"), F.col("b.pass").alias("pass"))


def asked_targets(links: DataFrame) -> DataFrame:
    """``links`` that can name a note, with target and source_dir."""
    some = links.filter(F.col("raw").isNotNull() & T.is_note_like(F.col("raw")))
    return some.withColumn("target", target_of(F.col("raw"))).withColumn("source_dir", T.dir_of(F.col("src_key"))).filter("target <> ''")


def resolved_links(links: DataFrame, notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every note-like link with dst_key, dst_path, ambiguous, pass and resolved.

    Distinct (target, folder) pairs are resolved once, however often they are
    used, and joined back. A link that hits nothing leads to a placeholder,
    'phantom:' and its folded stem, with path ''. Repeated rows stay repeated.
    """
    asked = asked_targets(links)
    pairs = cut(asked.select("target", "source_dir").distinct())
    by_path = T.is_path(F.col("target"))
    found = resolve_names(pairs.filter(~by_path), candidates(notes, aliases)).unionByName(resolve_paths(pairs.filter(by_path), notes))
    out = asked.join(found, ["target", "source_dir"], "left")
    resolved = F.col("dst_key").isNotNull()
    ghost = F.concat(F.lit("phantom:"), T.fold(phantom_stem(F.col("raw"))))
    return out.withColumns({"resolved": resolved, "dst_key": F.coalesce("dst_key", ghost), "dst_path": F.coalesce("dst_path", F.lit("")), "ambiguous": F.coalesce("ambiguous", F.lit(False))})


def phantoms(resolved: DataFrame) -> DataFrame:
    """(note_key, stem, stem_fold, inbound): one placeholder per folded stem still linked to."""
    ghost = resolved.filter(~F.col("resolved")).withColumn("stem", phantom_stem(F.col("raw")))
    kept = ghost.filter(T.is_note_like(F.col("stem")))
    return kept.groupBy(F.col("dst_key").alias("note_key")).agg(F.min("stem").alias("stem"), F.count(F.lit(1)).alias("inbound")).withColumn("stem_fold", T.fold(F.col("stem")))


def status(resolved: DataFrame, notes: DataFrame) -> DataFrame:
    """The resolve service: status and shown title of each link."""
    title = notes.filter("alive AND NOT phantom").groupBy(F.col("note_key").alias("dst_key")).agg(F.max_by(F.struct("title", "stem"), F.struct("landed_at", "title")).alias("t"))
    said = F.when(~F.col("resolved"), "unresolved").when(F.col("ambiguous"), "ambiguous").otherwise("resolved")
    return resolved.join(title, "dst_key", "left").select("link_id", said.alias("status"), "dst_key", F.coalesce(T.shown_title(F.col("t.title"), F.col("t.stem")), F.lit("")).alias("dst_title"))
