"""Katz backoff language model: Good-Turing discounts, exact backoff weights, partitioned tables.

With c the count of a pair in training texts, d the discount of c and p the
unigram model, a token w after v has the probability d(c) c(v,w) / c(v) if the
pair was met, else weight(v) p(w), and p(w) alone if v was never met.  The
weight is what the discounts leave of v's mass over what p leaves to the words
never met after v, so that every context sums to exactly 1.  The unigram model
is discounted likewise; what is left is the probability of the unknown word.
Counts over ``MOST_DISCOUNTED`` are not discounted; a context in which nothing is
discounted leaves one part in c(v) + 1.  Where counts of counts give no
discount between 0 and 1, it is (c - 1/2) / c.

The order is 2: pairs are counted and evaluated in blocks.  A block holds a few
million tokens as numbers of its own words.
1. Blocks send their words (64-bit hashes) and counts to vocabulary partitions by
   hash range, which sum them, number the words, and reply in the same order.
2. Blocks send their distinct pairs and counts to pair partitions by context
   (contexts with over an eighth of a partition's tokens are spread by pair, though
   no more than the 100,000 most frequent ones), which sum
   them, write the tables of the model and reply with counts and with the context's
   sums where a pair was never met.
3. Blocks put the replies to their tokens and add up each document.
All statistics cover all training documents and grow with them; only totals,
counts of counts and the sums of the spread contexts pass the driver.

Edge cases: null and empty texts have one token, the end; an empty training set
gives the unknown word probability 1; null ``doc_id``s hash as empty text and
rows that repeat a ``doc_id`` are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .quality_model import fold
from .token_store import pack, unpack
from .words import mix, slices, words_of

MOST_DISCOUNTED = 5
BLOCK_TOKENS = 2_500_000
WORD_PART_BYTES, PAIR_PART_TOKENS = 16 << 20, 2_000_000
MOST_SPREAD = 100_000
END = np.uint64(1)
UNKNOWN, START, FIRST_WORD = 0, 1, 2

ROWS = "kind int, block long, part int, payload binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _pack(values: np.ndarray) -> tuple:
    """Unsigned numbers of any size, mostly small ones in few bytes."""
    values = np.asarray(values, np.uint64)
    low = pack((values & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    high = pack((values >> np.uint64(32)).astype(np.uint32)) if len(values) and int(values.max()) >> 32 else None
    return len(values), low, high


def _unpack(packed: tuple) -> np.ndarray:
    n, low, high = packed
    values = unpack(*low, n).astype(np.int64)
    return values if high is None else values | (unpack(*high, n).astype(np.int64) << 32)


def _row(kind: int, block: int, part: int, *payload) -> pa.RecordBatch:
    names = ["kind", "block", "part", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([pickle.dumps(payload)], pa.binary())], names=names)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (kind, block, part, payload) of each run of one key."""
    now, held = None, []
    for batch in batches:
        for kind, block, part, payload in zip(*(batch[c].to_pylist() for c in ("kind", "block", "part", "payload"))):
            k = block if key == "block" else part
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append((kind, block, part, pickle.loads(payload)))
    if held:
        yield now, held


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Vocabulary partition: equal ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blocks(parts: int):
    """Kind 0: a block's documents; kind 1: its words for each vocabulary partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, out, sizes = (sum((h[k] for h in held), []) for k in (0, 1, 2))
            words, local, counts = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            trained = np.bincount(local[np.repeat(~np.array(out, bool), sizes)], minlength=len(words))
            by_count = np.argsort(-counts, kind="stable")  # frequent words get the small numbers
            rank = np.empty(len(words), np.int64)
            rank[by_count] = np.arange(len(words))
            yield _row(0, block, 0, ids, out, sizes, _pack(rank[local]), _pack(by_count))
            bounds = np.searchsorted(_part_of(words, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                some = slice(bounds[p], bounds[p + 1])
                yield _row(1, block, p, words[some], _pack(trained[some]))

        for batch in slices(batches):
            found = words_of(batch["text"], lower=True)
            sizes = np.diff(found.first) + 1
            tokens = np.insert(found.hashes, found.first[1:], END)
            held.append((batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), sizes.tolist(), tokens))
            n += len(tokens)
            if n >= BLOCK_TOKENS:
                yield from flush()
                block, held, n = block + 1, [], 0
        if held:
            yield from flush()

    return cut


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: replies to blocks (number, count of each word); kind 1: the partition's words; kind 2: its totals."""
    for part, rows in _groups(batches, "part"):
        sizes = [len(payload[0]) for *_, payload in rows]
        words, at = np.unique(np.concatenate([payload[0] for *_, payload in rows]), return_inverse=True)
        totals = np.bincount(at, np.concatenate([_unpack(payload[1]) for *_, payload in rows]), len(words)).astype(np.int64)
        order = np.argsort(-totals, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        for (_, block, _, _), a in zip(rows, np.split(at, np.cumsum(sizes)[:-1])):
            yield _row(0, block, part, _pack(rank[a]), _pack(totals[a]))
        known = int((totals > 0).sum())
        yield _row(1, 0, part, words[order[:known]], _pack(totals[order[:known]]))
        yield _row(2, 0, part, known, int(totals.sum()), np.bincount(np.minimum(totals, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3))


def discounts(met: np.ndarray) -> np.ndarray:
    """Katz's discounts of the counts 1 to k (then 1), from the numbers met[r] of things with count r."""
    k, out = MOST_DISCOUNTED, np.ones(MOST_DISCOUNTED + 2)
    rest = (k + 1) * met[k + 1] / met[1] if met[1] else 1.0
    for r in range(1, k + 1):
        good = (r + 1) * met[r + 1] / (r * met[r]) if met[r] else 1.0
        d = (good - rest) / (1 - rest) if rest < 1 else 1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """The unigram model: totals, discounts and the unknown word's probability."""

    def __init__(self, tokens: int, words: int, met: np.ndarray):
        self.tokens, self.words, self.discount = tokens, words, discounts(met)
        low = np.arange(MOST_DISCOUNTED + 1)
        left = float((met[: len(low)] * low * (1 - self.discount[: len(low)])).sum())
        self.scale = 1.0 / max(tokens, 1) if left > 0 or not tokens else 1.0 / (tokens + 1)
        self.unknown = left / tokens if left > 0 else 1.0 / (tokens + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        p = self.discount[np.minimum(counts, MOST_DISCOUNTED + 1)] * counts * self.scale
        return np.where(counts > 0, p, self.unknown)


class Block:
    """A block's tokens, words and distinct pairs, the same whenever it is put together."""

    def __init__(self, rows: list[tuple], base: np.ndarray, unigrams: Unigrams, pair_parts: int):
        (self.ids, self.out, self.sizes, tokens, by_count), = (payload for kind, *_, payload in rows if kind == 0)
        replies = sorted((part, payload) for kind, _, part, payload in rows if kind == 1)
        rank = [_unpack(payload[0]) for _, payload in replies]
        number = np.concatenate([r + base[part] for r, (part, _) in zip(rank, replies)])
        count = np.concatenate([_unpack(payload[1]) for _, payload in replies])
        by_count = _unpack(by_count)
        self.count = np.append(count[by_count], 0)  # of each word by its local number; last: the start
        self.number = np.append(np.where(count > 0, number, UNKNOWN)[by_count], START)
        self.tokens = _unpack(tokens)
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        start = len(self.count) - 1
        self.count[start] = self.count[self.tokens[ends[0] - 1]]  # as many starts as ends
        before = np.concatenate([[start], self.tokens[:-1]])
        before[self.first] = start
        code, self.pair_of = np.unique(before * np.int64(len(self.count)) + self.tokens, return_inverse=True)
        self.v, self.w = code // len(self.count), code % len(self.count)
        asked = np.flatnonzero(self.number[self.v] != UNKNOWN)
        v, w = self.v[asked], self.w[asked]
        self.spread = self.count > max(PAIR_PART_TOKENS // 8, unigrams.tokens // MOST_SPREAD)
        key = mix(self.number[v].astype(np.uint64)) + np.where(self.spread[v], self.number[w], 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (mix(key) % np.uint64(pair_parts)).astype(np.int64)
        order = np.argsort(part * len(self.count) + v, kind="stable")
        self.asked, self.part = asked[order], part[order]  # the pairs sent, in the order sent

    def messages(self, pair_parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each pair partition: the places of its pairs among those asked, and where a context begins."""
        bounds = np.searchsorted(self.part, np.arange(pair_parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            some = self.asked[bounds[p] : bounds[p + 1]]
            v = self.v[some]
            yield int(p), some, np.flatnonzero(np.diff(v, prepend=-1))


def _requests(base: np.ndarray, unigrams: Unigrams, pair_parts: int):
    """Each block's distinct pairs with their counts in its training documents, for each pair partition."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches, "block"):
            b = Block(rows, base, unigrams, pair_parts)
            trained = np.bincount(b.pair_of[np.repeat(~np.array(b.out, bool), b.sizes)], minlength=len(b.v))
            for p, some, runs in b.messages(pair_parts):
                v, w = b.v[some][runs], b.w[some]
                yield _row(0, block, p, _pack(b.number[v]), np.packbits(b.spread[v]), _pack(np.diff(np.append(runs, len(some)))), _pack(b.number[w]), _pack(trained[some]), _pack(b.count[w]))

    return ask


MODEL = ROWS + ", v array<long>, w array<long>, n array<long>, mass array<double>"


def _model_row(kind: int, part: int, v, w, n, mass) -> pa.RecordBatch:
    values = [pa.array([kind], pa.int32()), pa.array([0], pa.int64()), pa.array([part], pa.int32()), pa.array([b""], pa.binary())]
    values += [pa.array([x], pa.list_(pa.int64())) for x in (v, w, n)] + [pa.array([mass], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(values, names=["kind", "block", "part", "payload", "v", "w", "n", "mass"])


def _pairs(unigrams: Unigrams):
    """Kind 0: replies; 1: pair counts; 2: contexts with their sums; 3: sums of spread contexts; 4: counts of counts."""
    kinds = MOST_DISCOUNTED + 2  # c(v), numbers of words with count 1 .. k, sum of larger counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches, "part"):
            runs = [_unpack(p[2]) for *_, p in rows]
            sizes = [int(r.sum()) for r in runs]
            v = np.concatenate([np.repeat(_unpack(p[0]), r) for (*_, p), r in zip(rows, runs)])
            spread = np.concatenate([np.repeat(np.unpackbits(p[1], count=len(r)).astype(bool), r) for (*_, p), r in zip(rows, runs)])
            w, c, c_w = (np.concatenate([_unpack(p[k]) for *_, p in rows]) for k in (3, 4, 5))
            order = np.lexsort((w, v))
            new = np.ones(len(order), bool)
            new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
            first = np.flatnonzero(new)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            of = order[first]
            total = np.add.reduceat(c[order], first)
            v_new = np.diff(v[of], prepend=-1) != 0
            context = np.cumsum(v_new) - 1
            seen = total > 0
            sums = np.zeros((context[-1] + 1, kinds), np.int64)
            np.add.at(sums[:, 0], context, total)
            small = np.minimum(total, MOST_DISCOUNTED + 1)
            for r in range(1, MOST_DISCOUNTED + 1):
                sums[:, r] = np.bincount(context[small == r], minlength=len(sums))
            large = total > MOST_DISCOUNTED
            sums[:, -1] = np.bincount(context[large], total[large], len(sums))
            mass = np.bincount(context[seen], unigrams(c_w[of][seen]), len(sums))
            flat = sums[:, 1:-1].sum(axis=1) == 0
            low = 0
            for (_, block, _, _), run, size in zip(rows, runs, sizes):
                mine = group[low : low + size]
                starts = np.cumsum(run) - run
                ctx = context[mine[starts]]
                need = (np.add.reduceat((total[mine] == 0).astype(np.int64), starts) > 0) & ~spread[low : low + size][starts]
                yield pa.RecordBatch.from_arrays(_row(0, block, part, _pack(total[mine]), np.packbits(flat[ctx]), np.packbits(need), [_pack(sums[ctx[need], k]) for k in range(kinds)], mass[ctx[need]]).columns + _model_row(0, part, [], [], [], []).columns[4:], names=["kind", "block", "part", "payload", "v", "w", "n", "mass"])
                low += size
            at = np.flatnonzero(seen)
            for k in range(0, len(at), 1 << 18):
                some = at[k : k + (1 << 18)]
                yield _model_row(1, part, v[of[some]], w[of[some]], total[some], [])
            v_of, wide = v[of[v_new]], spread[of[v_new]]
            yield _model_row(2, part, v_of[~wide], [], sums[~wide].ravel(), mass[~wide])
            for k in np.flatnonzero(wide):
                yield _model_row(3, part, [v_of[k]], [], sums[k], [mass[k]])
            yield _model_row(4, part, [], [], np.bincount(np.minimum(total, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3), [])

    return count


def _backoff(sums: np.ndarray, mass: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """The weights of contexts: mass left by the discounts over mass of the words never met."""
    k = MOST_DISCOUNTED
    kept = sums[:, 1 : k + 1] @ (discount[1 : k + 1] * np.arange(1, k + 1)) + sums[:, -1]
    flat = sums[:, 1 : k + 1].sum(axis=1) == 0
    total = np.maximum(sums[:, 0], 1)
    left = np.where(flat, 1 / (total + 1), 1 - kept / total)
    return left / (1 - mass)


def _scores(base: np.ndarray, unigrams: Unigrams, pair_parts: int, discount: np.ndarray, wide: dict[int, tuple[float, bool]]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            b = Block(rows, base, unigrams, pair_parts)
            replies = {part: payload for kind, _, part, payload in rows if kind == 2}
            c = np.zeros(len(b.v), np.int64)
            weight, flat = np.ones(len(b.v)), np.zeros(len(b.v), bool)  # a context never met has weight 1
            for p, some, runs in b.messages(pair_parts):
                totals, flats, need, sums, mass = replies[p]
                c[some] = _unpack(totals)
                n, sizes = len(runs), np.diff(np.append(runs, len(some)))
                own_flat = np.unpackbits(flats, count=n).astype(bool)
                own = np.zeros(n)
                need = np.unpackbits(need, count=n).astype(bool)
                own[need] = _backoff(np.stack([_unpack(s) for s in sums], axis=1).astype(float), mass, discount)
                v = b.v[some][runs]
                for k in np.flatnonzero(b.spread[v]):
                    own[k], own_flat[k] = wide[int(b.number[v[k]])]
                weight[some], flat[some] = np.repeat(own, sizes), np.repeat(own_flat, sizes)
            c_v, p_w = b.count[b.v], unigrams(b.count[b.w])
            met = discount[np.minimum(c, MOST_DISCOUNTED + 1)] * c / np.maximum(c_v + flat, 1)
            log = np.log10(np.where(c > 0, met, weight * p_w))
            count = b.count[b.tokens]
            plain = np.log10((count + 1) / (unigrams.tokens + unigrams.words + 1))
            sums = [np.add.reduceat(x, b.first) for x in ((count > 0).astype(np.int64), plain, log[b.pair_of])]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.out, pa.bool_()), pa.array(b.sizes, pa.int64()), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def katz_scores(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "text")
    total_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total_bytes // WORD_PART_BYTES))
    blocks = spark.read.schema(ROWS).parquet(scratch.save(rows.mapInArrow(_blocks(parts), ROWS), "katz-blocks", "kind"))

    words = blocks.where("kind = 1").repartition(parts, "part").sortWithinPartitions("part", "block")
    vocabulary = spark.read.schema(ROWS).parquet(scratch.save(words.mapInArrow(_vocabulary, ROWS), "katz-words", "kind"))
    stats = {r["part"]: pickle.loads(r["payload"]) for r in vocabulary.where("kind = 2").select("part", "payload").collect()}
    known = [stats[p][0] if p in stats else 0 for p in range(parts)]
    base = FIRST_WORD + np.concatenate([[0], np.cumsum(known)[:-1]]).astype(np.int64)
    met = sum((s[2] for s in stats.values()), np.zeros(MOST_DISCOUNTED + 3, np.int64))
    tokens = sum(s[1] for s in stats.values())
    unigrams = Unigrams(tokens, sum(known), met)

    pair_parts = max(1, -(-total_bytes // 6 // PAIR_PART_TOKENS))
    pieces = blocks.where("kind = 0").select("kind", "block", "part", "payload").union(vocabulary.where("kind = 0").select(F.lit(1).alias("kind"), "block", "part", "payload"))
    asked = pieces.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(_requests(base, unigrams, pair_parts), ROWS)
    counted = asked.repartition(pair_parts, "part").sortWithinPartitions("part", "block").mapInArrow(_pairs(unigrams), MODEL)
    model = spark.read.schema(MODEL).parquet(scratch.save(counted, "katz-pairs", "kind"))
    pair_met = np.zeros(MOST_DISCOUNTED + 3, np.int64)
    for r in model.where("kind = 4").groupBy().agg(*[F.sum(F.get("n", F.lit(k))).alias(str(k)) for k in range(MOST_DISCOUNTED + 3)]).collect():
        pair_met += np.array([x or 0 for x in r])
    discount = discounts(pair_met)
    sums = [F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(MOST_DISCOUNTED + 2)]
    spread = model.where("kind = 3").groupBy(F.get("v", F.lit(0)).alias("v")).agg(*sums, F.sum(F.get("mass", F.lit(0))).alias("mass")).collect()
    wide = {}
    for r in spread:
        own = np.array([[r[f"n{k}"] for k in range(MOST_DISCOUNTED + 2)]], float)
        wide[r["v"]] = (float(_backoff(own, np.array([r["mass"]]), discount)[0]), bool(own[0, 1:-1].sum() == 0))

    replies = model.where("kind = 0").select(F.lit(2).alias("kind"), "block", "part", "payload")
    met_again = pieces.union(replies).repartition("block").sortWithinPartitions("block", "kind", "part")
    scored = met_again.mapInArrow(_scores(base, unigrams, pair_parts, discount, wide), OUT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
