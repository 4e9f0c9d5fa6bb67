"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into pieces; the pieces are then
matched to gaps in rounds, longest first.  Lengths and gaps are small integers,
so range-sorting them leaves runs of equal values: a round takes the run of one
length, sweeps over the runs of gaps from its smallest successor (the tightest
gap that fits) upwards, resolves conflicts by rank within the runs (the k-th
piece goes to the k-th place), updates the gaps and opens new sequences for the
rest.  The result is that of sequential best-fit decreasing.  The pieces stay
distributed: rounds work on the counts by length (at most 2,048, from one
aggregate) and give intervals of ranks, to which every piece is matched by its
own rank.

With an order of the documents (such as the slots of a mix), the same sequences are filled
along it: of each length, the pieces go in their order to the places in the order of the
sequences, and a sequence's order is that of the piece that opened it.  Any part of the
sequences, taken in order, then has each length's share of that part of the documents.

Edge cases: a null or empty text is one piece, its end id; null or repeated
``doc_id``s are packed as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .encoding import encoder
from .numbering import number_within

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, place long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
MOVED = PLACED + ", rank long, place long"


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, spaces=False).encode
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64()), ("place", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            texts = (x.as_py() for x in batch["text"])
            for doc_id, row, place, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "place")), encode(texts)):
                ids = np.append(ids, np.int32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), row, place))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return cut


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over runs: rows (length, first rank, first sequence, pieces a sequence, offset).

    Pieces of ``length`` with ranks from ``first rank`` on fill the sequences
    from ``first sequence`` on, so many to each, from ``offset`` on.
    """
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, number of sequences)
    order: list[int] = []  # the gaps that have runs
    sequences = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = gap // length
            filled, rest = min(n, left // each), 0
            if filled:
                out.append((length, rank, first, each, capacity - gap))
                open_gap(gap - each * length, first, filled)
                rank, left = rank + filled * each, left - filled * each
            if filled < n and left:
                rest = left
                out.append((length, rank, first + filled, rest, capacity - gap))
                open_gap(gap - rest * length, first + filled, 1)
                rank, left, filled = rank + rest, 0, filled + 1
            open_gap(gap, first + filled, n - filled)
    return out


def _placed(rounds: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(rounds), np.int64).reshape(-1, 5)
    lengths, ranks = table[:, 0], table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            k = np.empty(len(length), np.int64)
            for value in np.unique(length):
                low, high = np.searchsorted(lengths, [value, value + 1])
                of = length == value
                k[of] = low + np.searchsorted(ranks[low:high], rank[of], side="right") - 1
            _, first_rank, first, each, offset = table[k].T
            nth = rank - first_rank
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            more = [pa.array(first + nth // each), pa.array(offset + nth % each * length)]
            more += [batch["rank"], batch["place"]] if "place" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays(columns + more, names=MOVED.replace(" long", "").replace(" int", "").split(", ")[: len(columns + more)])

    return place


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, order: str | None = None) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``order``: a column of numbers from 0 on along which the sequences run, by rising
    ``sequence_id`` (with gaps then) and in the files written from the result."""
    place = F.lit(0) if order is None else F.coalesce(F.col(order), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"), place.cast("long").alias("place"))
    pieces = scratch.saved(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rounds = best_fit_rounds(counts, capacity)
    ties, n = ["doc_id", "piece", "row"], sum(counts.values())
    if order is not None:
        ranked = number_within(pieces, "length", ties, n, "rank", along="place")
        ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"), "place")
        return _along(scratch.saved(ranked.mapInArrow(_placed(rounds), MOVED), "placed"), n)
    ranked = number_within(pieces, "length", ties, n, "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(_placed(rounds), PLACED)


def _along(placed: DataFrame, n: int) -> DataFrame:
    """The same sequences of ``n`` pieces, filled and numbered along ``place``."""
    opened = placed.where("offset = 0").select(F.col("sequence_id").alias("opened"), F.col("place").alias("begins"))
    spots = placed.select("length", "sequence_id", "offset").join(opened, F.col("sequence_id") == F.col("opened")).drop("opened")
    spots = number_within(scratch.saved(spots, "spots"), "length", ["sequence_id", "offset"], n, "nth", along="begins")
    numbered = (F.col("begins") * F.lit(n) + F.col("sequence_id")).alias("sequence_id")
    spots = spots.select(F.col("length").alias("of"), F.col("nth").cast("long").alias("nth"), numbered, "offset")
    pieces = placed.drop("sequence_id", "offset", "place")
    out = pieces.join(spots, (F.col("length") == F.col("of")) & (F.col("rank") == F.col("nth")))
    out = out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return out.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset")
