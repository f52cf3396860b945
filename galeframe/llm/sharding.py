"""Weighted rendezvous sharding with gapless slots, in built-in functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots are numbered in chunks of a shard, by the first hex digits of the key's hash.
CHUNK_DIGITS = 3
#: Rows alike in every column are unrolled in blocks of this many.
BLOCK = 1 << 16


def _score(key: Column, shard: int, weight: float) -> Column:
    """``-weight / ln(u)``, u uniform in (0, 1) from 52 bits of md5 of key and shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that scores highest for a key.

    A shard of twice the weight gets twice the keys. Every shard scores on its own, so a new one
    only takes the keys for which it now scores highest, and a removed one only gives its own
    away. Keys are compared as text; a NULL key is the empty text. Shards without weight get
    nothing. Ties, which need equal 52-bit hashes, go to the larger shard number.
    """
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = [F.struct(_score(text, s, w).alias("v"), F.lit(s).alias("s")) for s, w in sorted(live.items())]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["s"].cast("int")


def numbered(rows: DataFrame, shard: str, key: str, slot: str = "slot") -> DataFrame:
    """Adds gapless numbers from 0 within each shard, ordered by md5 of the key, then all columns.

    Chunks of a shard are counted first and numbered on their own, so no task holds a shard.
    Rows alike in all columns are counted together and unrolled at the end, so a key that holds
    a large part of all rows is one row in its chunk. An empty input gives an empty result.
    """
    names = rows.columns
    mixed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    marked = rows.withColumn("_mix", mixed).withColumn("_chunk", F.substring("_mix", 1, CHUNK_DIGITS))
    counts = marked.groupBy(shard, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16 ** CHUNK_DIGITS rows a shard, whatever the input.
    starts = counts.select(shard, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    alike = marked.groupBy(*names, "_mix", "_chunk").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(shard, "_chunk").orderBy("_mix", *names).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        starts, [shard, "_chunk"]
    )
    blocks = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK))))
    last = F.least(F.col("_n"), (F.col("_block") + 1) * BLOCK) - 1
    each = blocks.withColumn("_k", F.explode(F.sequence(F.col("_block") * BLOCK, last)))
    return each.select(*names, (F.col("_start") + F.col("_first") + F.col("_k")).cast("long").alias(slot))
