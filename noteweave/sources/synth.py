"""Synthetic link graphs of a given shape, from row numbers and hashes only.

A spec is 'synth:N[:shape[:degree]]'. Every shape is a plan over
``spark.range``, the same for the same seed, and of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators.graph import in_order
from noteweave.session import cut

SHAPES = ("orphans", "chain", "hub", "motifs", "islands", "bipartite", "scale_free", "communities")
#: Sizes of the motifs, in turn.
MOTIFS = (2, 3, 6, 4, 7)


def parse_spec(spec: str) -> tuple[int, str, float]:
    """(n, shape, mean degree) of a spec; the degree is held to 0 to 64. Raises ValueError otherwise."""
    parts = spec.split(":")
    if parts[0] != "synth" or not 2 <= len(parts) <= 4:
        raise ValueError(f"not a synthetic spec: {spec!r}")
    n, shape = int(parts[1]), parts[2] if len(parts) > 2 and parts[2] else "scale_free"
    if n < 0 or shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}")
    return n, shape, min(64.0, max(0.0, float(parts[3]) if len(parts) > 3 else 4.0))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def chain(spark: SparkSession, n: int, skip: int = 0) -> DataFrame:
    """(a, b): 0-1-2-...; with ``skip`` each skip-th node also links that far ahead."""
    e = spark.range(max(0, n - 1)).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    if skip > 1:
        e = e.unionByName(spark.range(max(0, n - skip)).filter(F.col("id") % skip == 0).select(F.col("id").alias("a"), (F.col("id") + skip).alias("b")))
    return e


def hub(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, max(1, n)).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))


def motifs(spark: SparkSession, n: int) -> DataFrame:
    """(a, b): rings of 2, 3, 6, 4, 7 nodes over and over; an unfinished ring stays a path."""
    turn = sum(MOTIFS)
    ends = [sum(MOTIFS[: i + 1]) for i in range(len(MOTIFS))]
    at = F.col("id") % turn
    start = F.lit(0)
    size = F.lit(MOTIFS[0])
    for i in range(1, len(MOTIFS)):
        start = F.when(at >= ends[i - 1], ends[i - 1]).otherwise(start)
        size = F.when(at >= ends[i - 1], MOTIFS[i]).otherwise(size)
    base = F.col("id") - at + start
    last = at == start + size - 1
    e = spark.range(n).select(F.col("id").alias("a"), F.when(last, base).otherwise(F.col("id") + 1).alias("b"), last.alias("last"), size.alias("size"))
    return e.filter((F.col("b") < n) & ~(F.col("last") & (F.col("size") == 2))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def islands(spark: SparkSession, n: int, degree: float, seed: int, size: int = 64) -> DataFrame:
    """(a, b): separate groups of up to ``size``, sizes drawn log-uniformly inside each stretch."""
    k = F.greatest(F.lit(2), F.floor(F.pow(F.lit(float(size)), uniform(seed, F.floor(F.col("id") / size))))).cast("long")
    node = spark.range(n).withColumn("k", k).withColumn("base", F.col("id") - F.col("id") % size)
    node = node.withColumn("start", F.col("base") + F.floor((F.col("id") - F.col("base")) / F.col("k")) * F.col("k"))
    tries = node.filter("id > start").withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.lit(int(degree / 2 + 0.5)) - 1))))
    to = F.when(F.col("j") == 0, F.col("id") - 1).otherwise(F.col("start") + F.floor(uniform(seed + 1, F.col("id"), F.col("j")) * (F.col("id") - F.col("start"))).cast("long"))
    return tries.select(to.alias("a"), F.col("id").alias("b")).filter("a < b").distinct()


def bipartite(spark: SparkSession, n: int, degree: float, seed: int) -> DataFrame:
    """(a, b): notes 0..n-1 and tags n..n+n/8, each note with about ``degree`` tags, low tags more often."""
    tags = max(1, n // 8)
    e = spark.range(n).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(max(1, round(degree))))))
    tag = F.floor(F.pow(uniform(seed, F.col("id"), F.col("j")), F.lit(2)) * tags).cast("long")
    return e.select(F.col("id").alias("a"), (F.lit(n) + tag).alias("b")).distinct()


def scale_free(spark: SparkSession, n: int, degree: float, seed: int) -> DataFrame:
    """(a, b): each node links to earlier ones drawn with a bias to the first, a power-law tail without a loop."""
    e = spark.range(1, max(1, n)).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(max(1, round(degree / 2))))))
    to = F.floor(F.pow(uniform(seed, F.col("id"), F.col("j")), F.lit(3)) * F.col("id")).cast("long")
    return e.select(to.alias("a"), F.col("id").alias("b")).distinct()


def communities(spark: SparkSession, n: int, degree: float, seed: int, mixing: float = 0.1, size: int = 256) -> DataFrame:
    """(a, b, community): groups of power-law sizes up to ``size``; a link leaves its group with probability ``mixing``."""
    node = spark.range(n).withColumn("base", F.col("id") - F.col("id") % size)
    k = F.greatest(F.lit(8), F.least(F.lit(size), F.floor(F.lit(8) * F.pow(1 - uniform(seed, F.col("base")), F.lit(-1.0))))).cast("long")
    node = node.withColumn("k", k).withColumn("community", F.col("base") + F.floor((F.col("id") - F.col("base")) / F.col("k")) * F.col("k"))
    e = node.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(max(1, round(degree / 2))))))
    span = F.least(F.col("k"), F.lit(n) - F.col("community"), F.col("base") + size - F.col("community"))
    near = F.col("community") + F.floor(uniform(seed + 1, F.col("id"), F.col("j")) * span).cast("long")
    far = F.floor(uniform(seed + 2, F.col("id"), F.col("j")) * n).cast("long")
    to = F.when(uniform(seed + 3, F.col("id"), F.col("j")) < mixing, far).otherwise(near)
    out = e.select(F.col("id"), to.alias("to"), "community").filter("id <> to")
    return out.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), "community").dropDuplicates(["a", "b"])


def graph(spark: SparkSession, spec: str, seed: int = 1) -> DataFrame:
    """(a, b): the undirected edges of a spec."""
    n, shape, degree = parse_spec(spec)
    if shape == "orphans":
        return spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    if shape == "chain":
        return chain(spark, n)
    if shape == "hub":
        return hub(spark, n)
    if shape == "motifs":
        return motifs(spark, n)
    make = {"islands": islands, "bipartite": bipartite, "scale_free": scale_free, "communities": communities}[shape]
    return make(spark, n, degree, seed).select("a", "b")


def bridges(components: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """(a, b): links from about ``share`` of the nodes to the first node of another component, each as likely."""
    first = cut(in_order(components.groupBy("component").agg(F.min("node").alias("b")), "component"))
    pick = components.filter(uniform(seed, F.col("node")) < share)
    slot = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, first.count())))
    return pick.select(F.col("node").alias("a"), slot.alias("seq")).join(first.select("seq", "b"), "seq").select("a", "b").filter("a <> b")


def folder_paths(components: DataFrame, leak: float = 0.1, seed: int = 1, folders: int = 997) -> DataFrame:
    """(node, path): one of ``folders`` folders for each component; a share ``leak`` of notes lies elsewhere."""
    own = F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(folders))
    other = F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(folders))
    folder = F.when(uniform(seed + 2, F.col("node")) < leak, other).otherwise(own)
    return components.select("node", F.concat(F.lit("area"), (folder % 31).cast("string"), F.lit("/topic"), folder.cast("string"), F.lit("/note-"), F.col("node").cast("string"), F.lit(".md")).alias("path"))


def documents(spark: SparkSession, n: int, edges: DataFrame) -> DataFrame:
    """(note_key, text): notes of a graph as markdown, one section and one link line for each neighbour."""
    links = edges.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias("to"))
    body = F.array_join(F.transform("to", lambda b: F.concat(F.lit("- [[note-"), b.cast("string"), F.lit("]]"))), "\n")
    text = F.concat(F.lit("# note-"), F.col("id").cast("string"), F.lit("\n\n"), F.coalesce(F.concat(F.lit("## Links\n\n"), body, F.lit("\n")), F.lit("")))
    return spark.range(n).join(links, "id", "left").select(F.concat(F.lit("note-"), F.col("id").cast("string"), F.lit(".md")).alias("note_key"), text.alias("text"))
