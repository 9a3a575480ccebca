"""Mixing sources to target weights: blocks drawn per output shard, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethersense.session import materialise

#: Cells of the guide that finds the interval of a number with an equality join.
CELLS = 1024


@dataclass(frozen=True)
class Mix:
    """``documents``: doc_id, size, source_size, target, taken per row. ``plan``: one row per output block:
    shard, slot, source, the word block of that source, and in which pass over the source it is drawn."""

    documents: DataFrame
    plan: DataFrame
    sources: DataFrame


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _running(table: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over rows with a smaller ``order`` (a dense number from 0), in two levels."""
    table = table.withColumn("_level", F.floor(F.col(order) / 4096))
    sums = table.groupBy("_level").agg(F.sum(value).alias("_sum"))
    above = Window.orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_level", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return table.join(sums, "_level").withColumn(name, F.col("_above") + F.col("_inside")).drop("_level", "_above", "_inside")


def _numbered_sources(sizes: DataFrame) -> DataFrame:
    """Sources with their sizes and dense numbers by code point, null last."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    table = table.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    table = materialise(table, "sources")
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    counts = table.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return table.join(counts, "_part").select(
        "source", "source_size", "docs", (F.col("_before") + F.row_number().over(inside) - 1).alias("rank")
    )


def _targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], limit: int) -> DataFrame:
    """Water filling in whole numbers: a source above ``limit`` times its size stops there, the rest is
    dealt again by weight until none is above. Each round is one aggregate over the sources."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = sources.withColumn("weight", weight.cast("long")).withColumn("cap", limit * F.col("source_size"))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share[0]  # in units of 1 / share[1]
    rest, left, capped = total, table.agg(F.sum("weight")).first()[0] or 0, -1
    while True:
        # rest and left stay whole, so the comparison is exact
        over = F.col("weight").cast("decimal(20,0)") * F.lit(str(rest)).cast("decimal(18,0)") > (
            F.col("cap").cast("decimal(18,0)") * F.lit(str(share[1] * left)).cast("decimal(20,0)")
        )
        if left == 0:
            over = F.lit(True)
        row = table.agg(
            F.sum(over.cast("long")), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if (row[0] or 0) == capped:
            break
        capped, rest, left = row[0] or 0, total - share[1] * (row[1] or 0), row[2] or 0
    even = F.col("weight") * F.lit(float(rest)) / F.lit(float(share[1] * left or 1))
    return table.withColumn("target", F.when(over, F.col("cap").cast("double")).otherwise(even))


def _pick(points: DataFrame, at: str, bounds: DataFrame, total: int) -> DataFrame:
    """Join each number ``at`` to the interval ``[low, high)`` that holds it, by guide cells."""
    wide = max(1, -(-total // CELLS))
    cells = F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide)))
    bounds = bounds.where("high > low").withColumn("_cell", cells)
    points = points.withColumn("_cell", F.floor(F.col(at) / wide))
    return points.join(bounds, "_cell").where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("_cell", "low", "high")


def _permuted(blocks: DataFrame, seed: int) -> DataFrame:
    """Blocks with their place in the source's pseudorandom order (that of a hash), found bucket by bucket
    so that no source is sorted in one task."""
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_blocks") / 16.0))).cast("long")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "rank", "block"), 2)
    blocks = blocks.withColumn("_hash", hashed).withColumn("_part", F.pmod("_hash", parts))
    sums = blocks.groupBy("rank", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rank", "_part").orderBy("_hash", "block")
    return blocks.withColumn("_row", F.row_number().over(inside)).join(sums, ["rank", "_part"]).select(
        "rank", "block", (F.col("_before") + F.col("_row") - 1).alias("index")
    )


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the place of their first word in the stream of their source.

    The stream is ordered by (chunk, id, size), where the chunk is a hash of id and size; a source has about as
    many chunks as a chunk has documents, so a large source is numbered by many tasks.
    """
    chunks = F.greatest(F.lit(1), F.least(F.ceil(F.col("docs") / 256), F.ceil(F.sqrt("docs")) * 16)).cast("long")
    named = sources.select("source", "rank", "docs")
    docs = sizes.join(named, sizes["source"].eqNullSafe(named["source"])).select(
        "doc_id", "size", "rank", F.pmod(F.xxhash64("doc_id", "size"), chunks).alias("chunk")
    )
    sums = docs.groupBy("rank", "chunk").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(sums, ["rank", "chunk"]).select(
        "doc_id", "size", "rank", (F.col("_before") + F.col("_inside")).alias("start")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), limit: int = 2,
    block_words: int = 64, shard_blocks: int = 4096, seed: int = 11,
) -> Mix:
    """Mix the ``source`` streams of ``docs`` (``doc_id``, ``text``, ``source``; other columns are ignored).

    A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` words (null: 0). Sources by code point, null last,
    have ``weights`` in turn and share ``share`` times all words; a target stops at ``limit`` times its source's
    size and the excess is dealt again by weight.

    The documents of a source form one stream of words, cut into blocks of ``block_words`` (the last may be
    shorter). Each output shard draws ``shard_blocks`` times from all sources in proportion to their blocks
    due. Draws beyond a source's due go to sources that are still short, so totals are met to half a block.
    The ``i``-th draw of a source takes block ``i`` of its pseudorandom order, again from the start once all
    are used; with targets up to ``limit`` times the size no block is taken more often than that. Everything
    follows from hashes of ids and sizes: reruns agree, and rows equal in both are interchangeable.
    Empty tables and tables without words give targets and takings of 0.
    """
    spark: SparkSession = docs.sparkSession
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _word_count(F.col("text").cast("string")).alias("size"),
    )
    sizes = materialise(sizes, "sizes")
    sources = _targets(_numbered_sources(sizes), weights, share, limit)
    blocks_of = F.ceil(F.col("source_size") / block_words).cast("long")
    due = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * blocks_of)).otherwise(0)
    sources = sources.withColumn("n_blocks", blocks_of).withColumn("due", due.cast("long"))
    sources = materialise(_running(sources, "rank", "due", "low").withColumn("high", F.col("low") + F.col("due")), "sources")
    slots = sources.agg(F.sum("due")).first()[0] or 0

    docs_at = materialise(_placed(sizes, sources), "placed")
    ends = F.col("start") + F.col("size")
    block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((ends - 1) / block_words)))
    parts = docs_at.where("size > 0").withColumn("block", block).select(
        "rank", "start", "block",
        (F.least(ends, (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)).alias("words"),
    )
    counts = sources.select("rank", "n_blocks")
    order = _permuted(parts.select("rank", "block").distinct().join(counts, "rank"), seed)

    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "slot"), F.lit(max(1, slots)))
    drawn = spark.range(0, slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_blocks).alias("shard"))
    drawn = _pick(drawn.withColumn("draw", draw), "draw", sources.select("rank", "low", "high"), slots)
    drawn = materialise(drawn.select("slot", "shard", "rank"), "draws")
    per_shard = drawn.groupBy("rank", "shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.select("rank", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n")
    inside = Window.partitionBy("rank", "shard").orderBy("slot")
    numbered = drawn.withColumn("_row", F.row_number().over(inside)).join(per_shard.drop("_n"), ["rank", "shard"]).select(
        "slot", "shard", "rank", (F.col("_before") + F.col("_row") - 1).alias("nth")
    )
    taken_of = per_shard.groupBy("rank").agg(F.sum("_n").alias("_drawn"))
    balance = sources.select("rank", "due").join(taken_of, "rank", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    balance = balance.withColumn("spare", F.greatest(F.lit(0), F.col("_drawn") - F.col("due")))
    balance = balance.withColumn("short", F.greatest(F.lit(0), F.col("due") - F.col("_drawn")))
    balance = materialise(_running(_running(balance, "rank", "spare", "spare_at"), "rank", "short", "short_at"), "balance")
    spares = balance.agg(F.sum("spare")).first()[0] or 0
    numbered = materialise(numbered.join(balance.select("rank", "due", "spare_at"), "rank"), "numbered")
    settled = numbered.where("nth < due").select("slot", "shard", "rank", "nth")
    loose = numbered.where("nth >= due").select("slot", "shard", (F.col("spare_at") + F.col("nth") - F.col("due")).alias("at"))
    short = balance.select(
        "rank", "_drawn", "short_at", F.col("short_at").alias("low"), (F.col("short_at") + F.col("short")).alias("high")
    )
    moved = _pick(loose, "at", short, spares).select(
        "slot", "shard", "rank", (F.col("_drawn") + F.col("at") - F.col("short_at")).alias("nth")
    )
    plan = settled.union(moved).join(counts, "rank").select(
        "slot", "shard", "rank", (F.col("nth") % F.col("n_blocks")).alias("index"), F.floor(F.col("nth") / F.col("n_blocks")).alias("pass")
    ).join(order, ["rank", "index"])

    times = plan.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = parts.join(times, ["rank", "block"]).groupBy("rank", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.withColumn("size_kind", F.lit(True))
    result = docs_at.withColumn("size_kind", F.col("size") > 0).join(taken, ["rank", "start", "size_kind"], "left").join(
        sources.select("rank", "source_size", "target"), "rank"
    ).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(result, plan.join(sources.select("rank", "source"), "rank").select("shard", "slot", "source", "block", "pass"), sources)
