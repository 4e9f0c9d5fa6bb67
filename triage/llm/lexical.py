"""Ranked lexical search of many items at once, by common-subexpression evaluation.

An item's score of a document is the sum of its terms' contributions, so items
with common terms have common partial sums.

1. One pass reads every text: a row for each few documents holds their lengths and
   the counts of the terms that items can have (a bitmap of fixed size tells most
   of the others).  The corpus statistics are aggregates of these rows.
2. Items are dealt to blocks of about 512.  In each block the sets of terms that
   items share are mined: the pair of terms (or of sets found so far) that most
   items hold becomes a node of its own, in all of them, until no pair is shared.
   The result is a graph of additions: leaves are terms, every node is the sum of
   two others, and an item is the sum of the nodes left to it.
3. A task meets a block's graph with a part of the documents.  For some documents
   at a time the contributions of the leaves are computed, every node's
   accumulators (a sum a document) once, in the order of the graph, and from them
   the items' scores.  It keeps an item's best documents and drops the rest, which
   can't be among the best of all.

Which sets are mined changes the number of additions, never a score.  Mining looks
at the ``MINED`` terms of a block in most items and ends after twice as many sums;
all others are added directly.

Edge cases: null, empty and termless texts have no score; items without terms,
or whose terms no document has, have no rows; rows that repeat a ``doc_id`` are
documents each for itself; a null ``doc_id`` comes last among equal scores;
repeated rows of an item are one item, different texts of one ``item_id`` are
ranked each for itself; empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .words import slices

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of UTF-8: all bytes of other characters count
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE, FILTER_BITS, KNOWN = 1 << 20, 1 << 23, 1 << 18
BLOCK_ITEMS, MINED, CELLS = 512, 4_096, 1 << 21
PART_BYTES, LEAST_DOCS = 1 << 26, 2_048
NO_ID = (1 << 63) - 1


def term_counts(text: str) -> Counter[bytes]:
    """Occurrences of the terms of a whole text, in pieces that end between terms."""
    data, counts, low = text.encode("utf-8", "replace").translate(LOWER), Counter(), 0
    while low < len(data):
        cut = BREAK.search(data, low + PIECE) if low + PIECE < len(data) else None
        high = cut.start() if cut else len(data)
        counts.update(TERM.findall(data, low, high))
        low = high
    return counts


def _place(term: bytes) -> int:
    return zlib.crc32(term) % FILTER_BITS


ITEM_TERMS = "item_no long, item_id long, term binary, times long, place int"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = term_counts(row["text"] or "")
            terms, n = list(counts), len(counts)
            for low in range(0, n, 1 << 16):
                some = terms[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["item_no"]] * len(some), pa.int64()), pa.array([row["item_id"]] * len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([counts[t] for t in some], pa.int64()), pa.array([_place(t) for t in some], pa.int32())],
                    names=["item_no", "item_id", "term", "times", "place"])


COUNTED = "docs long, terms long, ids binary, lengths binary, vocabulary binary, doc binary, term binary, tf binary, df binary"


def _counted(bitmap: np.ndarray):
    """Rows of some documents each: all their lengths, and the counts of the terms that the bitmap has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[bytes, bool] = {}
        for batch in slices(batches, most_bytes=1 << 21):
            found = [term_counts(text) if text else Counter() for text in batch["text"].to_pylist()]
            place: dict[bytes, int] = {}
            doc, term, tf = [], [], []
            for k, counts in enumerate(found):
                for t, n in counts.items():
                    ok = passed.get(t)
                    if ok is None:
                        at = _place(t)
                        if len(passed) >= KNOWN:
                            passed.clear()
                        ok = passed[t] = bool(bitmap[at >> 6] >> np.uint64(at & 63) & np.uint64(1))
                    if ok:
                        doc.append(k)
                        term.append(place.setdefault(t, len(place)))
                        tf.append(n)
            lengths = np.array([c.total() for c in found], np.int64)
            ids = pc.fill_null(batch["doc_id"], NO_ID).to_numpy(zero_copy_only=False)
            df = np.bincount(np.array(term, np.int64), minlength=len(place))
            data = [ids.tobytes(), lengths.tobytes(), b" ".join(place), np.array(doc, np.int32).tobytes(), np.array(term, np.int32).tobytes(), np.array(tf, np.int32).tobytes(), df.astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())] + [pa.array([x], pa.binary()) for x in data],
                                             names=["docs", "terms", "ids", "lengths", "vocabulary", "doc", "term", "tf", "df"])

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents holding a term, summed over a batch's rows."""
    for batch in batches:
        total: Counter[bytes] = Counter()
        for vocabulary, df in zip(batch["vocabulary"].to_pylist(), batch["df"].to_pylist()):
            if df:
                total.update(dict(zip(vocabulary.split(b" "), np.frombuffer(df, np.int64).tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["t_term", "df"])


def mine(items: list[dict[bytes, int]], mined: int = MINED) -> tuple[list[tuple[bytes, int]], list[tuple[int, int]], list[list[int]]]:
    """The sharing graph of items given as term -> times.

    Leaves are (term, power of two), so that repeats are sums too; then sums, each
    of two earlier places; then the places whose sum is an item's score.
    """
    holders: dict[tuple[bytes, int], list[int]] = defaultdict(list)
    for k, item in enumerate(items):
        for term, times in item.items():
            for bit in range(times.bit_length()):
                if times >> bit & 1:
                    holders[term, 1 << bit].append(k)
    leaves = sorted(holders, key=lambda leaf: (-len(holders[leaf]), leaf))
    shared = sum(len(holders[leaf]) > 1 for leaf in leaves[:mined])
    held = np.zeros((2 * shared, len(items)), np.float32)
    names, sums, queue = list(range(shared)), [], []
    for k in range(shared):
        held[k, holders[leaves[k]]] = 1
        queue.append((-len(holders[leaves[k]]), k))  # as many items at most share a pair with it
    heapq.heapify(queue)
    while queue and len(sums) < 2 * mined:
        _, a = heapq.heappop(queue)
        common = held[: len(names)] @ held[a]
        common[a] = 0
        b = int(common.argmax())
        n = int(common[b])
        if n < 2:
            continue
        if queue and n < -queue[0][0]:
            heapq.heappush(queue, (-n, a))
            continue
        if len(names) == len(held):
            held = np.concatenate([held, np.zeros_like(held)])
        together = held[a] * held[b]
        held[a] -= together
        held[b] -= together
        held[len(names)] = together
        heapq.heappush(queue, (-n, a))
        heapq.heappush(queue, (-n, len(names)))
        names.append(len(leaves) + len(sums))
        sums.append((names[a], names[b]))
    totals: list[list[int]] = [[] for _ in items]
    for k, name in enumerate(names):
        for item in np.flatnonzero(held[k]).tolist():
            totals[item].append(name)
    for k in range(shared, len(leaves)):
        for item in holders[leaves[k]]:
            totals[item].append(k)
    return leaves, sums, totals


GRAPH = "block int, item_nos binary, item_ids binary, vocabulary binary, weights binary, leaf_term binary, leaf_times binary, sums binary, first binary, places binary"


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of items, which come sorted by block and item."""

    def graph(block: int, items: dict[int, dict[bytes, int]], ids: dict[int, int | None], weights: dict[bytes, int]) -> pa.RecordBatch:
        leaves, sums, totals = mine(list(items.values()))
        place = {t: k for k, t in enumerate(weights)}
        first = np.cumsum([0] + [len(x) for x in totals])
        data = [np.array(list(items), np.int64), np.array([NO_ID if ids[k] is None else ids[k] for k in items], np.int64), b" ".join(weights), np.array(list(weights.values()), np.int64),
                np.array([place[t] for t, _ in leaves], np.int32), np.array([n for _, n in leaves], np.int64), np.array(sums, np.int32), first.astype(np.int64), np.array([x for t in totals for x in t], np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32())] + [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in data], names=[c.split()[0] for c in GRAPH.split(", ")])

    block, items, ids, weights = None, {}, {}, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                if items:
                    yield graph(block, items, ids, weights)
                block, items, ids, weights = row["block"], {}, {}, {}
            items.setdefault(row["item_no"], {})[row["term"]] = row["times"]
            ids[row["item_no"]], weights[row["term"]] = row["item_id"], row["w"]
    if items:
        yield graph(block, items, ids, weights)


class Plan:
    """A block's graph as it is evaluated: its sums by level, and the best documents so far."""

    def __init__(self, row: dict, k: int):
        def array(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        self.k, self.item_nos, self.item_ids = k, array("item_nos", np.int64), array("item_ids", np.int64)
        self.place = {t: n for n, t in enumerate(row["vocabulary"].split(b" "))}
        self.weights, self.leaf_term, self.leaf_times = array("weights", np.int64), array("leaf_term", np.int32), array("leaf_times", np.int64)
        self.first, self.places = array("first", np.int64), array("places", np.int32)
        sums, leaves = array("sums", np.int32).reshape(-1, 2), len(self.leaf_term)
        depth = np.zeros(leaves + len(sums), np.int64)
        for n, (a, b) in enumerate(sums.tolist()):
            depth[leaves + n] = 1 + max(depth[a], depth[b])
        self.size = len(depth)
        self.levels = [(at, *sums[at - leaves].T) for at in (np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1))]
        self.best = [np.zeros(0, np.int64)] * 3  # item, document, score

    def scores(self, contributions: np.ndarray) -> np.ndarray:
        """Items x documents, from terms x documents; every sum of the graph is added once."""
        at = np.empty((self.size, contributions.shape[1]), np.int64)
        at[: len(self.leaf_term)] = contributions[self.leaf_term] * self.leaf_times[:, None]
        for out, a, b in self.levels:
            at[out] = at[a] + at[b]
        return np.add.reduceat(at[self.places], self.first[:-1], axis=0)

    def meet(self, row: dict, n_docs: int, n_terms: int) -> None:
        """Score a row of counted documents and keep each item's k best."""
        ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        doc, term, tf = (np.frombuffer(row[c], np.int32) for c in ("doc", "term", "tf"))
        if not len(doc):
            return
        to = np.array([self.place.get(t, -1) for t in row["vocabulary"].split(b" ")])[term]
        doc, to, tf = doc[to >= 0], to[to >= 0], tf[to >= 0].astype(np.int64)
        m = 75 + 25 * lengths * n_docs // n_terms
        value = self.weights[to] * (1_000_000_000 * tf // (1_000 * tf + 12 * m[doc]))
        step = max(1, CELLS // self.size)
        for low in range(0, len(ids), step):
            a, b = np.searchsorted(doc, [low, low + step])
            if a == b:
                continue
            own, column = np.unique(doc[a:b], return_inverse=True)
            contributions = np.zeros((len(self.weights), len(own)), np.int64)
            contributions[to[a:b], column] = value[a:b]
            self.add(ids[own], self.scores(contributions))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        item, _, best = self.best
        least = np.ones(len(self.item_nos), np.int64)
        full = np.flatnonzero(np.bincount(item, minlength=len(least)) >= self.k)
        low = np.full(len(least), NO_ID)
        np.minimum.at(low, item, best)
        least[full] = np.maximum(low[full], 1)
        q, at = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        item, doc, score = (np.concatenate(x) for x in zip(self.best, (q, ids[at], scores[q, at])))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        self.best = [item[kept], doc[kept], score[kept]]

    def found(self) -> pa.RecordBatch:
        item, doc, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.item_nos[item]), pa.array(self.item_ids[item]), pa.array(doc), pa.array(score)], names=["item_no", "item_id", "doc_id", "score"])


def _ranked(k: int, n_docs: int, n_terms: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, plan = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["block"], row["part"]) != key:
                    if plan:
                        yield plan.found()
                    key, plan = (row["block"], row["part"]), None
                if row["kind"] == 0:
                    plan = Plan(row, k)
                elif plan:
                    plan.meet(row, n_docs, n_terms)
        if plan:
            yield plan.found()

    return rank


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_items: int = BLOCK_ITEMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item (``item_id, text``)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item_no", F.monotonically_increasing_id())
    terms = scratch.saved(asked.mapInArrow(_item_terms, ITEM_TERMS), "lexical-items")
    words = terms.select((F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, place % 64)").alias("bit"))
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)  # its size is fixed, whatever the number of terms
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():
        bitmap[word] = np.uint64(bits & 0xFFFF_FFFF_FFFF_FFFF)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = scratch.saved(texts.mapInArrow(_counted(bitmap), COUNTED), "lexical-counts").withColumn("row", F.monotonically_increasing_id())
    totals = counted.agg(F.sum("docs"), F.sum("terms"), F.count("*"), F.sum(sum(F.length(c) for c in ("doc", "term", "tf", "ids", "lengths")))).first()
    n_docs, n_terms, n_rows, n_bytes = (x or 0 for x in totals)
    none = "item_id long, rank int, doc_id long, score long"
    if not n_terms:
        return spark.createDataFrame([], none)

    df = counted.select("vocabulary", "df").mapInArrow(_frequencies, "t_term binary, df long").groupBy("t_term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    n_items = terms.agg(F.count_distinct("item_no")).first()[0]
    blocks = max(1, -(-n_items // block_items))
    weighed = terms.join(df, F.col("term") == F.col("t_term")).select(F.pmod(F.xxhash64("item_no"), F.lit(blocks)).cast("int").alias("block"), "item_no", "item_id", "term", "times", weight.alias("w"))
    graphs = scratch.saved(weighed.repartition(blocks, "block").sortWithinPartitions("block", "item_no", "term").mapInArrow(_graphs, GRAPH), "lexical-graphs")

    parts = max(1, min(n_rows, max(-(-n_bytes // part_bytes), min(64, n_docs // LEAST_DOCS))))
    graph_columns, count_columns = [c.split()[0] for c in GRAPH.split(", ")][1:], ["ids", "lengths", "doc", "term", "tf"]
    empty = [F.lit(None).cast("binary").alias(c) for c in (*graph_columns, *count_columns)]
    by_name = dict(zip((*graph_columns, *count_columns), empty))
    planned = graphs.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), *graph_columns, *[by_name[c] for c in count_columns])
    read = counted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
                          *[F.col(c) if c == "vocabulary" else by_name[c] for c in graph_columns], *count_columns)
    met = planned.union(read).repartition(2 * blocks * parts, "block", "part").sortWithinPartitions("block", "part", "kind")
    best = met.mapInArrow(_ranked(k, n_docs, n_terms), "item_no long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.col("score").desc(), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(*[F.when(F.col(c) != NO_ID, F.col(c)).alias(c) if c.endswith("_id") else c for c in ("item_id", "rank", "doc_id", "score")])
