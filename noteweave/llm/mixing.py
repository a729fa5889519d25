"""Mixing sources to target weights: a low-discrepancy source schedule.

Each source is shuffled by hash and cut into blocks of equal tokens. Points of
the golden-ratio sequence fall through the cumulative weights of a mix and
name the source of each slot; the slots of a source are ranked, and the slot
of rank r takes block r of the source, beginning again when it is used up, at
most ``max_repeats`` times. Documents stay whole: each goes to the block its
middle token lies in, so the tokens of the first r blocks are right to within
half a document at either end. Every prefix of the schedule has about the
wanted shares.
"""

from __future__ import annotations

import base64
import importlib.util
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteweave.session import BROADCAST_ROWS, cut

#: The public vocabulary tokens are counted with; pass another path to change it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Least slots of a schedule: shares come out to about one part in so many.
N_SLOTS = 20_000
#: Most tokens of a block; a larger total gets more slots.
BLOCK_TOKENS = 1_000_000
#: Rows a window of the running totals is to hold.
BUCKET_ROWS = 50_000
GOLDEN = (math.sqrt(5) - 1) / 2

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(os.path.dirname(os.path.realpath(path)), "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens): tokens of each whole text; NULL and '' have 0."""
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, source string, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return docs.select(key, docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def running_total(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over earlier rows of the group.

    Rows of a group are ordered by bucket, then ``order``. Buckets are summed
    first and added up in one small table, so no window holds more than one
    bucket and a group of any size is spread out.
    """
    w = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    inside = df.withColumn("__w", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(sums, [group, bucket]).withColumn(out, F.col("__b") + F.col("__w")).drop("__b", "__w")


def _plan(weights: list[tuple[str, float, int]], tokens: dict[str, int], n_slots: int, block_tokens: int = BLOCK_TOKENS) -> tuple[list[tuple[str, float, int, int]], float, int]:
    """([(source, share of the schedule, max_repeats, tokens)], tokens of a block, slots) of one mix.

    The total is the largest at which every source that has tokens reaches its
    share within its repeats; the shares of sources without tokens go to the
    others in proportion.
    """
    there = [(s, share, r, tokens.get(s, 0)) for s, share, r in sorted(weights) if share > 0 and r > 0 and tokens.get(s, 0) > 0]
    whole = sum(share for _, share, _, _ in there)
    if not there:
        return [], 1.0, 0
    total = min(r * t * whole / share for _, share, r, t in there)
    n = max(n_slots, math.ceil(total / block_tokens))
    return [(s, share / whole, r, t) for s, share, r, t in there], max(1.0, total / n), min(n, int(total))


def schedule(docs: DataFrame, weights: DataFrame, n_slots: int = N_SLOTS, path: str = TOKENIZER, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix, slot, source, doc_id, repeat_no, n_tokens): the chosen documents in order.

    repeat_no counts from 0 and stays below max_repeats of the source in the
    mix. Documents without a listed source are not used; a listed source
    without tokens gets nothing. Rows of ``weights`` with a NULL mix, source
    or share are ignored, repeated rows count once. Documents are shuffled by
    a hash of their key, so the result is the same on every run. Of a block,
    at most ``block_tokens`` tokens, any order will do. ``weights`` is a table
    written by hand and is collected; slots, a number of their own that grows
    with the tokens, are only sent about while they are few.
    """
    rows = weights.select("mix", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().distinct().collect()
    listed = weights.select("source").dropna().distinct()
    counted = cut(count_tokens(docs.join(F.broadcast(listed) if len(rows) <= BROADCAST_ROWS else listed, "source", "left_semi"), path=path))
    totals = {r["source"]: (r["t"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    bits = max(0, math.ceil(math.log2(max(1, max((n for _, n in totals.values()), default=1) / BUCKET_ROWS))))
    mixed = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    placed = counted.withColumn("__h", mixed).withColumn("__k", F.shiftright("__h", 63 - bits) if bits else F.lit(0).cast("long"))
    placed = running_total(placed, "source", "__k", ["__h", "doc_id"], "n_tokens", "before").select("doc_id", "source", "n_tokens", "before")

    spark = docs.sparkSession
    uses, slots, n_used = None, None, 0
    for mix in sorted({r["mix"] for r in rows}):
        plan, block, used = _plan([(r["source"], r["target_share"], r["max_repeats"]) for r in rows if r["mix"] == mix], {s: t for s, (t, _) in totals.items()}, n_slots, block_tokens)
        if not plan:
            continue
        n_used += used
        point = (F.col("id") + 0.5) * F.lit(GOLDEN)
        edge, pick = 0.0, None
        for s, share, _, _ in plan:
            edge += share
            pick = F.when(F.col("__u") < edge, s) if pick is None else pick.when(F.col("__u") < edge, s)
        own = spark.range(used).withColumn("__u", point - F.floor(point)).select(F.lit(mix).alias("mix"), F.col("id").alias("slot"), pick.otherwise(plan[-1][0]).alias("source"))
        own = own.withColumn("__k", F.floor(F.col("slot") / BUCKET_ROWS)).withColumn("__one", F.lit(1))
        own = running_total(own, "source", "__k", ["slot"], "__one", "rank").select("mix", "slot", "source", F.col("rank").cast("long").alias("rank"))
        slots = own if slots is None else slots.unionByName(own)
        facts = spark.createDataFrame([(s, r, t) for s, _, r, t in plan], "source string, repeats int, total bigint")
        use = placed.join(F.broadcast(facts) if len(plan) <= BROADCAST_ROWS else facts, "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
        at = F.floor((F.col("repeat_no") * F.col("total") + F.col("before") + F.col("n_tokens") / 2) / F.lit(block))
        use = use.select(F.lit(mix).alias("mix"), "source", "doc_id", "repeat_no", "n_tokens", at.cast("long").alias("rank"))
        uses = use if uses is None else uses.unionByName(use)
    if uses is None:
        return counted.limit(0).select(F.lit("").alias("mix"), F.lit(0).cast("long").alias("slot"), "source", "doc_id", F.lit(0).alias("repeat_no"), "n_tokens")
    return uses.join(F.broadcast(slots) if n_used <= BROADCAST_ROWS else slots, ["mix", "source", "rank"]).select("mix", "slot", "source", "doc_id", "repeat_no", "n_tokens")


def shares(chosen: DataFrame, weights: DataFrame) -> DataFrame:
    """(mix, source, target_share, max_repeats, n_uses, n_tokens, actual_share) of every listed source."""
    per = chosen.groupBy("mix", "source").agg(F.count(F.lit(1)).alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    listed = weights.select("mix", "source", "target_share", "max_repeats").dropna().distinct().join(per, ["mix", "source"], "left")
    listed = listed.fillna(0, ["n_uses", "n_tokens"])
    whole = F.sum("n_tokens").over(Window.partitionBy("mix"))
    return listed.withColumn("actual_share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0))
