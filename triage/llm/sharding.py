"""Shards of near equal bytes: minimax contiguous partition over ordered atomic groups.

Groups are equal texts; they are ordered by the hash of their text, and a shard
is a run of groups.  A shard capacity is feasible if filling shards greedily up
to it needs no more than the given number of shards; binary search finds the
smallest, and the order is cut there.

The order of all groups never leaves the executors.  The search sees it as
segments: hash ranges with their summed size, counted by one aggregate of 2^16
ranges.  With ranges taken as indivisible the search gives a capacity that is
surely feasible, with ranges taken as divisible one that no partition can go
below; only ranges in which a cut can fall between the two are counted again in
2^8 finer ranges, until both agree or every such range is one group.  Ranges
that can hold a cut number at most about the square of the shards, so what the
driver holds does not grow with the documents.

Edge cases: null text counts as empty (size 8) and groups with empty texts;
null or repeated ``doc_id``s are rows like others; an empty table gives no rows;
a group larger than the mean is a shard's whole load, and shards may stay empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .numbering import number_within

#: A segment: (lowest hash, summed size, whether it is one group).
Segment = tuple[int, int, bool]


def _cuts(ends: list[int], segments: list[Segment], shards: int, capacity: int, whole: bool) -> list[int]:
    """Greedy ends (in summed size) of the shards; ``whole``: ranges are indivisible."""
    at, out = 0, []
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        reach = ends[k - 1] if k else 0
        if not whole and k < len(segments) and not segments[k][2]:
            reach = at + capacity
        at = max(at, reach)
        out.append(at)
    return out


def _smallest(ends: list[int], segments: list[Segment], shards: int, whole: bool) -> int:
    """The smallest capacity with which the greedy fill takes in everything."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _cuts(ends, segments, shards, mid, whole)[-1] >= ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _even(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Segment counts at which to cut: within the capacity, each as near to its even share as possible."""
    total, after = ends[-1], [0] * shards
    at = total
    for k in range(shards - 1, 0, -1):  # the least that the shards before must hold
        at = max(0, at - capacity)
        j = bisect_left(ends, at) + 1 if at > 0 else 0
        at = ends[j - 1] if j else 0
        after[k - 1] = at
    cuts, start = [], 0
    for k in range(shards - 1):
        most = bisect_right(ends, start + capacity)
        least = max(bisect_left(ends, after[k]) + 1 if after[k] else 0, cuts[-1] if cuts else 0)
        aim = total * (k + 1) // shards
        j = bisect_right(ends, aim)
        if j < len(ends) and ends[j] - aim < aim - (ends[j - 1] if j else 0):
            j += 1
        cuts.append(min(max(j, least), most))
        start = ends[cuts[-1] - 1] if cuts[-1] else 0
    return cuts


def _segments(sizes: DataFrame, bits: int, within: list[int] | None) -> dict[int, tuple[int, bool]]:
    """Summed size and oneness of the hash ranges of ``bits`` bits (of those ranges of eight bits less, if given)."""
    if within is not None:
        sizes = sizes.where(F.shiftright("hash", 64 - bits + 8).isin(within))
    found = (
        sizes.groupBy(F.shiftright("hash", 64 - bits).alias("range"))
        .agg(F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("one"))
    )
    return {r["range"]: (r["size"], r["one"]) for r in found.collect()}


def shard_bounds(sizes: DataFrame, shards: int) -> list[int]:
    """The hashes at which shards 1, 2, ... begin, for rows of ``hash`` and ``size``."""
    bits = 16
    segments = sorted((r << (64 - bits), s, one) for r, (s, one) in _segments(sizes, bits, None).items())
    while segments:
        ends = list(accumulate(s for _, s, _ in segments))
        high = _smallest(ends, segments, shards, True)
        low = _smallest(ends, segments, shards, False)
        coarse: list[int] = []
        if low < high:
            first, last = _cuts(ends, segments, shards, low, True), _cuts(ends, segments, shards, high, False)
            for a, b in zip(first, last):
                for k in range(bisect_right(ends, a), min(bisect_left(ends, b) + 1, len(ends))):
                    if not segments[k][2]:
                        coarse.append(k)
        if not coarse:
            cuts = _even(ends, shards, high)
            return [segments[c][0] if c < len(segments) else 1 << 63 for c in cuts]
        again = sorted(set(coarse))
        ranges = [segments[k][0] >> (64 - bits) for k in again]
        bits += 8
        finer = [(r << (64 - bits), s, one) for r, (s, one) in _segments(sizes, bits, ranges).items()]
        gone = set(again)
        segments = sorted([s for k, s in enumerate(segments) if k not in gone] + finer)
    return []


def _shard(hash_: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the hash."""
    if not bounds:
        return F.lit(0)
    return sum((F.when(hash_ >= F.lit(b), 1).otherwise(0) for b in bounds if b < 1 << 63), F.lit(0))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document's ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and ``grown_shard`` (null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    table = scratch.saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-sizes",
    )
    bounds = shard_bounds(table.select("hash", "size"), shards)
    placed = table.withColumn("shard", _shard(F.col("hash"), bounds).cast("int"))
    numbered = number_within(placed, "shard", ["doc_id", "row"], table.count(), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
