"""The shop vault asked as a whole."""

import os

from pyspark.sql import functions as F

from noteweave.plans import text_queries as Q
from tests.conftest import DATA


def test_every_note_has_its_items_and_heading_lines(spark):
    keys = {r.note_key for r in Q.scan_notes(spark, DATA).collect()}
    items = Q.outline_items(spark, DATA).cache()
    assert {r.note_key for r in items.collect()} == keys
    kinds = {r.kind: r["count"] for r in items.groupBy("kind").count().collect()}
    assert kinds.pop("root") == len(keys) and kinds == {r.kind: r.n for r in Q.outline_edges(spark, DATA).collect()}
    lines = Q.heading_lines(spark, DATA).collect()
    assert len(lines) == 3 * len(keys) and {r.note_key for r in lines} == keys


def test_backlinks_of_parts(spark, tmp_path):
    for t in ("region", "nation", "supplier", "customer"):
        os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    part = spark.read.parquet(f"{DATA}/part.parquet").limit(5)
    part.withColumn("p_name", F.concat(F.lit("Missing "), F.col("p_size").cast("string"))).write.parquet(f"{tmp_path}/part.parquet")
    found = {r.dst_key: r.n_links for r in Q.shop_backlinks(spark, str(tmp_path)).collect()}
    assert sum(n for k, n in found.items() if k.startswith("part/")) == 5
