"""Mixing sources to target weights by a Pfair schedule of source blocks.

A source's documents, in hash order, are cut into blocks of equal bytes, at least
those of the longest document; a document belongs to the block that holds its middle.
Block j of a source with weight w is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); one block runs in each slot, of the released blocks the one
with the earliest deadline.  With weights that sum to 1 every block runs between
release and deadline, so after any number of slots each source has had its
weight's share to within less than one block, and in bytes to within a block and half
the longest document, by which the ends of blocks are off.

Weights are rounded to whole blocks a period (at least one for each source); a
schedule of such weights repeats, so one period is scheduled and block j of a
source with a blocks a period runs in period j div a, at the slot of its block
j mod a.  Every document is in the mix.  A source that has run out leaves its
slots empty and the others go on in the proportion of their weights, so what
over-represented sources have beyond the target comes last; ``on_target`` holds
for the slots in which sources with over 90 % of the weight can supply their
share.  Without given weights the target is the bytes of a source to the power
0.9, which lowers the share of the largest.

Edge cases: a null source is a source of its own and a null text has no bytes;
rows that repeat source, ``doc_id`` and text move together; sources without a
given weight get the least, one block a period; an empty table gives no rows.
Other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

PERIOD = 1000
RUNS_OUT = 0.1
BUCKET_ROWS = 200
MOST_BUCKETS = 1_000_000  # the prefix sums of a source run over its buckets; beyond, buckets grow instead
BROADCAST_SOURCES = 10_000


def _identity(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.col("source").cast("string").alias("m_source"),
        F.col("doc_id").cast("long").alias("m_doc"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("m_key"),
    ]


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``m_source, m_doc, m_key, m_bytes`` and ``m_block``: prefix sums in hash order, bucket by bucket."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("m_bytes")
    items = scratch.saved(docs.select(*_identity(docs), size).groupBy("m_source", "m_doc", "m_key").agg(F.sum("m_bytes").alias("m_bytes")), "mix-items")
    rows, longest = items.agg(F.count(F.lit(1)), F.max("m_bytes")).first()
    buckets, block_bytes = max(1, min(rows // BUCKET_ROWS, MOST_BUCKETS)), max(block_bytes, longest or 0)
    items = items.withColumn("m_bucket", F.pmod(F.xxhash64("m_key"), F.lit(buckets)))
    earlier = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        items.groupBy(F.col("m_source").alias("b_source"), F.col("m_bucket").alias("b_bucket")).agg(F.sum("m_bytes").alias("n"))
        .select("b_source", "b_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b_before"))
    )
    inside = Window.partitionBy("m_source", "m_bucket").orderBy("m_key", "m_doc").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m_bytes").over(inside), F.lit(0)) + F.col("b_before")
    joined = items.join(base, F.col("m_source").eqNullSafe(F.col("b_source")) & (F.col("m_bucket") == F.col("b_bucket")))
    return joined.withColumn("before", before).select("m_source", "m_doc", "m_key", "m_bytes", F.expr(f"(2 * before + m_bytes) div {2 * block_bytes}").alias("m_block"))


def _sources(blocks: DataFrame, weights: dict[str, float] | None, exponent: float) -> DataFrame:
    """For each source: its number, blocks a period ``s_a``, the period ``s_w`` and the slot ``s_end`` at which the target ends."""
    supply = blocks.groupBy(F.col("m_source").alias("s_source")).agg(F.sum("m_bytes").alias("bytes"), (F.max("m_block") + 1).alias("s_blocks"))
    if weights is None:
        raw = F.pow(F.greatest(F.col("bytes"), F.lit(1)).cast("double"), F.lit(exponent))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        raw = F.coalesce(F.element_at(given, F.coalesce(F.col("s_source"), F.lit(""))), F.lit(0.0))
    every = Window.partitionBy()  # a row for each source
    supply = supply.withColumn("raw", raw)
    period = F.greatest(F.lit(PERIOD), 4 * F.count("*").over(every))
    share = F.coalesce(F.col("raw") / F.nullif(F.sum("raw").over(every), F.lit(0.0)), F.lit(0.0))
    supply = supply.withColumn("s_a", F.greatest(F.lit(1), F.round(period * share)).cast("long"))
    supply = supply.withColumn("s_w", F.sum("s_a").over(every)).withColumn("lasts", F.col("s_blocks") * F.col("s_w") / F.col("s_a"))
    by_end = Window.orderBy("lasts", F.col("s_source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    supply = supply.withColumn("spent", F.sum("s_a").over(by_end) / F.col("s_w")).withColumn("s_id", F.row_number().over(by_end) - 1)
    return supply.withColumn("s_end", F.min(F.when(F.col("spent") > RUNS_OUT, F.col("lasts"))).over(every)).select("s_source", "s_id", "s_blocks", "s_a", "s_w", "s_end")


def _period(sources: DataFrame) -> DataFrame:
    """One period of the schedule: ``p_id, p_nth, p_slot`` for each block of it."""
    one = sources.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("s_id", "s_a"))), lambda x: x["s_a"]).alias("a"), F.max("s_w").alias("w"))
    picks = one.where(F.size("a") > 0).select(F.expr("""
        aggregate(
          sequence(0L, w - 1),
          named_struct('done', array_repeat(0L, size(a)), 'picks', cast(array() as array<int>)),
          (s, t) -> aggregate(
            array(array_min(filter(
              transform(s.done, (k, i) -> if(k * w div a[i] <= t and k < a[i], named_struct('due', (k * w + w + a[i] - 1) div a[i], 'i', i), null)),
              c -> c is not null)).i),
            s,
            (u, pick) -> named_struct('done', transform(u.done, (k, i) -> if(i = pick, k + 1, k)), 'picks', array_append(u.picks, pick))),
          s -> s.picks) AS picks"""))
    nth = Window.partitionBy("p_id").orderBy("p_slot")
    return picks.select(F.posexplode("picks").alias("p_slot", "p_id")).withColumn("p_nth", F.row_number().over(nth) - 1)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = 1 << 16, exponent: float = 0.9) -> DataFrame:
    """A row for each distinct (source, doc_id, text): its block, ``release``, ``deadline``, ``slot`` and ``on_target``."""
    blocks = scratch.saved(_blocks(docs, block_bytes), "mix-blocks")
    sources = scratch.saved(_sources(blocks, weights, exponent), "mix-sources")
    period = _period(sources)
    if sources.count() <= BROADCAST_SOURCES:  # a period has a few thousand blocks then
        sources, period = F.broadcast(sources), F.broadcast(period)
    placed = blocks.join(sources, F.col("m_source").eqNullSafe(F.col("s_source"))).withColumn("nth", F.col("m_block") % F.col("s_a"))
    placed = placed.join(period, (F.col("s_id") == F.col("p_id")) & (F.col("nth") == F.col("p_nth")))
    slot = F.expr("m_block div s_a") * F.col("s_w") + F.col("p_slot")
    return placed.select(
        "m_source", "m_doc", "m_key", "m_bytes", F.col("m_block").alias("block"),
        F.expr("m_block * s_w div s_a").alias("release"), F.expr("((m_block + 1) * s_w + s_a - 1) div s_a").alias("deadline"),
        slot.alias("slot"), (slot < F.col("s_end")).alias("on_target"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = 1 << 16, exponent: float = 0.9, slot: str | None = None) -> DataFrame:
    """All documents, with their columns, ordered by the schedule across the files written from it;
    with ``slot`` their slot as a column of that name, for steps after which files have another order."""
    plan = schedule(docs, weights, block_bytes, exponent).select("m_source", "m_doc", "m_key", "slot")
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"), *[c.alias(n) for c, n in zip(_identity(docs), ("d_source", "d_doc", "d_key"))])
    same = F.col("d_source").eqNullSafe(F.col("m_source")) & F.col("d_doc").eqNullSafe(F.col("m_doc")) & (F.col("d_key") == F.col("m_key"))
    return mine.join(plan, same).repartitionByRange("slot", "m_key").sortWithinPartitions("slot", "m_source", "m_key").select("m_row.*", *([F.col("slot").alias(slot)] if slot else []))
