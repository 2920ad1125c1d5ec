"""Mixing sources to target weights by Sainte-Lague apportionment.

The token mass is dealt out in equal blocks.  Sources get blocks by highest quotients
target / (2 k + 1); each source is split into bounded shards, which get the source's blocks by
the same rule.  A shard is a ring of its documents in a seeded order; its blocks are taken one
after another from a seeded place, round the ring again where the quota is larger than the shard.

Quotients are not listed from the start: at the divisor total / blocks a source's quota is
within a bounded distance of its final one, so only the quotients near it are ranked.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
sources without words have target 0; an empty table gives an empty result; rows that repeat an id
are told apart by size and locator; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, written

#: A source's tokens are used at most so many times.
REPEATS = 3
#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: Tokens in a block, at most; a small corpus has smaller blocks, so that it has at least MIN_BLOCKS.
BLOCK_TOKENS, MIN_BLOCKS = 16, 1 << 16
#: Rows in a shard: at least MIN_SHARD_ROWS, and so many that there are at most about MAX_SHARDS.
MIN_SHARD_ROWS, MAX_SHARDS = 256, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """32 hexadecimal digits that depend on the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def seeded_int(hexed: Column, at: int = 1) -> Column:
    """A number of 32 bits from 8 of the digits."""
    return F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")


def apportion(df: DataFrame, within: list[str], share: str, seats: str, order: list[Column]) -> DataFrame:
    """Sainte-Lague: `df` with column quota.  In each group of `within`, `seats` (the same in all
    its rows) are dealt out to the rows by highest quotients of `share`, ties by `order`."""
    group = Window.partitionBy(*within)
    total = F.sum(share).over(group)
    exact = F.col(share) * F.col(seats) / F.col("_total")
    first = F.greatest(F.lit(0), F.floor(exact + 0.5) - F.col("_reach")).cast("long")
    df = df.withColumns({"_total": total.cast("double"), "_n": F.count(F.lit(1)).over(group)})
    # Rounding moves the sum by n / 2 at most, and a row by its share of that, and one.
    df = df.withColumn("_reach", F.when(F.col("_total") > 0, F.ceil(F.col(share) / F.col("_total") * F.col("_n")) + 2).otherwise(0))
    df = df.withColumn("_first", F.when(F.col("_total") > 0, first).otherwise(0))
    df = df.withColumn("_left", F.col(seats) - F.sum("_first").over(group))
    ranked = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *order)
    listed = df.withColumn("_k", F.explode(F.sequence(F.lit(0), 2 * F.col("_reach").cast("int")))).withColumn(
        "_quotient", F.col(share) / (2 * (F.col("_first") + F.col("_k")) + 1)
    )
    won = (F.row_number().over(ranked) <= F.col("_left")) & (F.col(share) > 0)
    listed = listed.withColumn("_won", won.cast("long"))
    keep = [c for c in df.columns if not c.startswith("_")]
    return listed.groupBy(*keep, "_first").agg(F.sum("_won").alias("_more")).select(*keep, (F.col("_first") + F.col("_more")).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """`sources` (source, source_size, source_rows) with total and target: weights in the order of
    the sources share the total; no target is above `repeats` times its source, the excess goes
    to the others by weight.  In the order of limit / weight, the sources up to some place are
    at their limit and the others share what is left."""
    everything = Window.partitionBy()
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("_p", (F.row_number().over(place) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_p").cast("int") + 1).cast("long")
    )
    weighed = weighed.withColumns({
        "limit": repeats * F.col("source_size"), "total": F.sum("source_size").over(everything), "_all": F.sum("weight").over(everything),
    })
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumns({
        "_used": F.coalesce(F.sum("limit").over(before), F.lit(0)), "_weights": F.col("_all") - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    weighed = weighed.withColumn("_level", (F.col("total") - F.col("_used")) / F.col("_weights"))
    # The first source below its limit sets the level of all that follow.
    free = F.when(F.col("limit") >= F.col("_level") * F.col("weight"), F.col("_level"))
    at = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    level = F.first(free, ignorenulls=True).over(at)
    return weighed.withColumn("_at", level).select(
        "source", "source_size", "source_rows", "total",
        F.when(F.col("_at").isNull(), F.col("limit").cast("double")).otherwise(F.col("_at") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per row: id, source, size, source_size, target, taken.  taken counts the words of the row
    that the mix takes, repeats included: `repeats` times its size at most."""
    sizes = written(picked(
        docs, id=F.col(id_col).cast("long"), source=F.col(source_col).cast("string"), size=word_count(F.col(text_col)),
    ), "sizes")
    sources = targets(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), weights, repeats)
    everything = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(F.col("total") / MIN_BLOCKS)))
    sources = sources.withColumn("block", block.cast("long")).withColumns({
        "blocks": F.floor(F.col("total") / F.col("block")).cast("long"),
        "shard_rows": F.greatest(F.lit(MIN_SHARD_ROWS), F.ceil(F.sum("source_rows").over(everything) / MAX_SHARDS)),
    }).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.col("shard_rows"))).cast("long"))
    sources = written(apportion(sources, [], "target", "blocks", [F.col("source").asc_nulls_last()]), "sources")
    key = seeded(seed, F.col("id"))
    facts = sources.select(F.col("source").alias("_s"), "source_size", "target", "block", "quota", "shards")
    # One row for each source: broadcast where that is few.
    few = F.broadcast(facts) if sources.count() <= 10_000 else facts
    dealt = sizes.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("key", key).withColumn(
        "shard", seeded_int(F.col("key")) % F.col("shards"))
    parts = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("length"), F.first("quota").alias("blocks"), F.first("block").alias("block"))
    parts = apportion(parts, ["source"], "length", "blocks", [F.col("shard")])
    start = F.when(F.col("length") > 0, seeded_int(seeded(seed, F.col("source"), F.col("shard")), 9) % F.col("length")).otherwise(0)
    parts = parts.select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), "length", start.alias("start"),
        F.least(F.col("quota") * F.col("block"), repeats * F.col("length")).alias("take"),
    )
    ring = Window.partitionBy("source", "shard").orderBy("key", "id", "size", "rf_file", "rf_row").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("begin", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    laid = laid.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), high) - F.greatest(F.col("begin"), low))

    over = F.when(F.col("length") > 0, F.col("take") % F.col("length")).otherwise(0)
    whole = F.when(F.col("length") > 0, F.expr("take div length")).otherwise(0)
    laid = laid.withColumns({"whole": whole, "stop": F.col("start") + over})
    taken = F.col("whole") * F.col("size") + overlap(F.col("start"), F.least(F.col("stop"), F.col("length"))) + overlap(F.lit(0), F.col("stop") - F.col("length"))
    return laid.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
