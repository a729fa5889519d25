"""Items that appear together: basket collapsing.

The distinct items of a record form its basket. Equal baskets are collapsed
into one with a weight, pairs are enumerated once per distinct basket, and the
weights of a pair add up to the number of records that hold both items. Small
baskets are compared as arrays, large ones, which no task holds whole, by
their size and two hashes over their items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.session import BROADCAST_ROWS, cut

#: A basket of more items is spread over blocks and never held as one array.
MAX_BASKET = 64


def item_pairs(
    rows: DataFrame,
    record: str,
    item: str,
    min_together: int = 1,
    min_lift: float = 0.0,
    max_basket: int = MAX_BASKET,
    distinct_sides: bool = True,
) -> DataFrame:
    """(item_lo, item_hi, n_together, n_lo, n_hi, n_records, expected, lift, conviction_lo_hi, conviction_hi_lo).

    Rows with a NULL record or item are ignored, with ``distinct_sides`` also
    rows whose record equals their item; repeated rows count once. n_records
    is the number of different records left, expected = n_lo * n_hi /
    n_records, lift = n_together / expected. conviction_lo_hi is
    (1 - n_hi / N) / (1 - n_together / n_lo), NULL where every record with lo
    has hi too. An empty table gives no rows.

    Two bounds, exact for every input, thin the baskets before pairs are made:
    an item of fewer than ``min_together`` records is in no pair kept, and as
    n_together <= min(n_lo, n_hi), lift <= N / max(n_lo, n_hi), so an item of
    more than N / ``min_lift`` records is in none either. Baskets above
    ``max_basket`` items are collapsed by 128 bits of hashes beside their size,
    least and largest item (two different baskets agree in these with a chance
    of about 2^-128), then cut into blocks of about that size and joined block
    by block, so no task holds a whole large basket. Kept items are sent about
    while they are few; then an item most records hold is dropped before any
    shuffle.
    """
    both = rows.select(F.col(record).alias("r"), F.col(item).alias("i")).filter("r IS NOT NULL AND i IS NOT NULL")
    if distinct_sides:
        both = both.filter("r <> i")
    both = cut(both.distinct())
    n_records = both.select("r").distinct().count()
    items = both.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_together)
    if min_lift > 0:
        items = items.filter(F.col("n") * F.lit(float(min_lift)) <= n_records)
    items = cut(items)
    kept = both.join(F.broadcast(items) if items.count() <= BROADCAST_ROWS else items, "i").select("r", F.struct("i", "n").alias("x"))
    sizes = kept.groupBy("r").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    large = sizes.filter(F.col("k") > max_basket)
    sized = kept.join(large, "r", "left")
    signed = sized.filter("k IS NOT NULL").groupBy("r", "k").agg(
        *[F.bit_xor(F.xxhash64("x.i", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)], F.min("x.i").alias("least"), F.max("x.i").alias("most")
    )
    once = signed.groupBy("k", "h1", "h2", "least", "most").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("weight")).select("r", "weight")

    small = sized.filter("k IS NULL").groupBy("r").agg(F.sort_array(F.collect_list("x")).alias("basket")).filter(F.size("basket") > 1)
    baskets = small.groupBy("basket").agg(F.count(F.lit(1)).alias("weight"))
    first = baskets.select("basket", "weight", F.posexplode("basket").alias("at", "lo"))
    rest = F.slice("basket", F.col("at") + 2, F.greatest(F.size("basket"), F.lit(1)))
    pairs = first.select("weight", "lo", F.explode(rest).alias("hi"))

    n_blocks = F.ceil(F.col("k") / F.lit(max_basket / 2))
    blocks = (
        sized.filter("k IS NOT NULL")
        .join(once, "r")
        .withColumn("nb", n_blocks)
        .withColumn("blk", F.pmod(F.xxhash64("x.i"), F.col("nb")))
        .groupBy("r", "weight", "nb", "blk")
        .agg(F.collect_list("x").alias("part"))
    )
    meets = blocks.select("r", "weight", "blk", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    meets = meets.groupBy("r", "weight", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q")).agg(F.collect_list(F.struct("blk", "part")).alias("m"))
    side = lambda which: F.flatten(F.transform(F.filter("m", lambda e: e["blk"] == F.col(which)), lambda e: e["part"]))
    far = meets.select("weight", "p", "q", side("p").alias("ps"), side("q").alias("qs"))
    far = far.select("weight", "p", "q", F.explode("ps").alias("u"), "qs").select("weight", "p", "q", "u", F.explode("qs").alias("v"))
    far = far.filter("p <> q OR u < v").select("weight", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))

    n = F.lit(float(n_records))
    together = pairs.unionByName(far).groupBy("lo", "hi").agg(F.sum("weight").alias("n_together")).filter(F.col("n_together") >= min_together)
    lo, hi, t = F.col("lo.n").cast("double"), F.col("hi.n").cast("double"), F.col("n_together").cast("double")
    out = together.select(
        F.col("lo.i").alias("item_lo"),
        F.col("hi.i").alias("item_hi"),
        "n_together",
        F.col("lo.n").alias("n_lo"),
        F.col("hi.n").alias("n_hi"),
        F.lit(n_records).alias("n_records"),
        (lo * hi / n).alias("expected"),
        (t * n / (lo * hi)).alias("lift"),
        ((1 - hi / n) / F.when(t < lo, 1 - t / lo)).alias("conviction_lo_hi"),
        ((1 - lo / n) / F.when(t < hi, 1 - t / hi)).alias("conviction_hi_lo"),
    )
    if min_lift > 0:
        out = out.filter(F.col("n_together") * n >= F.lit(float(min_lift)) * F.col("n_lo") * F.col("n_hi"))
    return out
