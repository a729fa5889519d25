"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

Input chunks of a fixed number of rows are combined where they are read, each
into one partial state per key. A key that fills a good part of a chunk is hot
there: its states meet in rounds of bounded fan-in, so no reducer ever gets
all partials of a hot key and the number of rounds grows with the logarithm of
the chunks. The many states of ordinary keys go to the last round at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noteweave.session import cut

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
#: Rows of a chunk.
CHUNK_ROWS = 262_144
#: A key is hot in a chunk if it holds more than one row in so many.
HOT_PART = 1_000


def tree_depth(n_chunks: int, fan_in: int) -> int:
    """Rounds of ``fan_in`` that bring ``n_chunks`` states down to one."""
    depth, left = 1, math.ceil(max(1, n_chunks) / fan_in)
    while left > 1:
        depth, left = depth + 1, math.ceil(left / fan_in)
    return depth


def _combined(keys: list[str], hows: dict[str, str], kinds: list[pa.DataType], chunk_rows: int):
    """Record batches to chunks, and each chunk to one row per key: keys, states, chunk number, hot."""
    names = [*keys, *hows, "__chunk", "__hot"]

    def close(batches: list[pa.RecordBatch], chunk: int) -> list[pa.Array]:
        table = pa.Table.from_batches(batches)
        table = table.append_column("__n", pa.array([1] * table.num_rows, pa.int64()))
        grouped = table.group_by(keys).aggregate([*((name, how) for name, how in hows.items()), ("__n", "sum")])
        states = [grouped[f"{name}_{how}"].cast(kind) for (name, how), kind in zip(hows.items(), kinds, strict=True)]
        hot = [n * HOT_PART > table.num_rows and n > 1 for n in grouped["__n_sum"].to_pylist()]
        columns = [*(grouped[k] for k in keys), *states, pa.array([chunk] * grouped.num_rows, pa.int64()), pa.array(hot, pa.bool_())]
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        waiting: list[pa.RecordBatch] = []
        n = done = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(chunk_rows - n, batch.num_rows - at)
                waiting.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == chunk_rows:
                    yield pa.RecordBatch.from_arrays(close(waiting, first + done), names)
                    waiting, n, done = [], 0, done + 1
        if waiting:
            yield pa.RecordBatch.from_arrays(close(waiting, first + done), names)

    return run


States = dict[str, tuple[str, Column]]


def chunk_states(df: DataFrame, keys: list[str], states: States, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """keys, states, __chunk, __hot: the states of every chunk, written once."""
    rows = df.select(*keys, *(expr.alias(name) for name, (_, expr) in states.items()))
    merged = rows.agg(*[MERGE[how](name).alias(name) for name, (how, _) in states.items()]).schema
    fields = [rows.schema[k] for k in keys] + [merged[name] for name in states]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", __chunk long, __hot boolean"
    kinds = [to_arrow_type(merged[name].dataType) for name in states]
    return cut(rows.mapInArrow(_combined(keys, {name: how for name, (how, _) in states.items()}, kinds, chunk_rows), schema))


def merged_states(level: DataFrame, keys: list[str], states: States, fan_in: int = 16) -> DataFrame:
    """One row per key from ``chunk_states``: hot states in rounds of ``fan_in``, then all together."""
    again = [MERGE[how](name).alias(name) for name, (how, _) in states.items()]
    columns = [*keys, *states]
    depth = tree_depth(level.select("__chunk").distinct().count(), fan_in)
    hot = level.filter("__hot").withColumn("__chunk", F.pmod(F.xxhash64("__chunk"), F.lit(fan_in**depth)))
    for _ in range(depth - 1):
        hot = hot.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in)).groupBy(*keys, "__chunk").agg(*again)
    return level.filter("NOT __hot").select(columns).unionByName(hot.select(columns)).groupBy(*keys).agg(*again)


def tree_aggregate(df: DataFrame, keys: list[str], states: States, chunk_rows: int = CHUNK_ROWS, fan_in: int = 16) -> DataFrame:
    """One row per key with the merged states.

    ``states`` maps an output name to (``sum`` | ``min`` | ``max``, input
    expression). NULL keys form a group as in ``groupBy``; NULL inputs are
    skipped as the built-in aggregates skip them; an empty table gives no rows.
    """
    return merged_states(chunk_states(df, keys, states, chunk_rows), keys, states, fan_in)


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    """(side, node, other, ...): both ends of every edge; side is 0 for a and 1 for b."""
    sides = F.array(
        F.struct(F.lit(0).cast("tinyint").alias("side"), F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.lit(1).cast("tinyint").alias("side"), F.col("b").alias("node"), F.col("a").alias("other")),
    )
    return edges.select(F.explode(sides).alias("e"), *more).select("e.*", *more)


def _side() -> Column:
    return F.when(F.col("side") == 0, "a").otherwise("b").alias("side")


def node_stats(edges: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = 16) -> DataFrame:
    """(side, node, n_rows, n_neighbours, sum_w) for every node of ``edges(a, b, w)``.

    side is 'a' or 'b', the column the node stands in; n_rows counts rows with
    repeats, n_neighbours distinct non-NULL values of the other column, sum_w
    adds w without NULLs (NULL if a node has no w at all). A NULL is no node,
    yet the row counts for the node on its other side. Equal pairs are
    combined first, so that distinct neighbours simply add up.
    """
    pairs = edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    ends = _ends(pairs, "n", "w").filter("node IS NOT NULL")
    states = {"n_rows": ("sum", F.col("n")), "n_neighbours": ("sum", F.col("other").isNotNull().cast("long")), "sum_w": ("sum", F.col("w"))}
    stats = tree_aggregate(ends, ["side", "node"], states, chunk_rows, fan_in)
    return stats.select(_side(), "node", "n_rows", "n_neighbours", "sum_w")


def frequent_nodes(edges: DataFrame, share: float = 0.01, chunk_rows: int = CHUNK_ROWS, fan_in: int = 16) -> DataFrame:
    """(side, node) of the nodes that stand in a column in at least ``share`` of all rows.

    The rows counted are all rows, those with NULLs and repeats included:
    their number is the sum of the states of one side, the NULL node's among
    them. An empty table gives no rows.
    """
    keys, states = ["side", "node"], {"n_rows": ("sum", F.lit(1).cast("long"))}
    level = chunk_states(_ends(edges), keys, states, chunk_rows)
    total = level.filter("side = 0").agg(F.sum("n_rows")).first()[0] or 0
    per_cent = round(1 / share)
    counted = merged_states(level, keys, states, fan_in)
    return counted.filter(F.col("node").isNotNull() & (F.col("n_rows") * per_cent >= total)).select(_side(), "node")
