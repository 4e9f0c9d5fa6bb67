"""Near copies by MinHash bands with sequential Bayesian verification.

1. A document's set are its distinct word shingles; equal sets are one class,
   named by its smallest ``doc_id``, and only classes are compared.
2. Signatures of 80 minima are cut into bands, as long as a pair at the threshold
   is missed with probability below 1e-4 (16 of 5 at 0.85, 20 of 4 at 0.8);
   classes that agree on a band share a bucket.
3. In each bucket every class is first paired with a few hubs: the class that meets
   most others in its buckets, and the first ones of fixed random orders, so a
   bucket of m classes gives at most 5 (m - 1) candidates.  Buckets whose classes are not
   all linked after that, nor all paired, are compared in full, in blocks of about
   256 classes by 256, except for classes already in one component; a block of
   classes gives a spanning forest of its links, not all pairs.
4. Candidates are verified in batches of 16 signature values: with m of n equal,
   the posterior probability (uniform prior) that the similarity is at least the
   threshold is P(Bin(n + 1, threshold) <= m); a pair is dropped when it falls
   below the chosen miss probability.  Survivors are compared on their full sets.
5. Links are united to connected components.

Nothing is capped: a bucket of any size is covered.

Edge cases: with fewer words than a shingle has the whole sequence is the one
shingle; null, empty and wordless texts have no set and are alone; rows that
repeat a ``doc_id`` are one document with several texts, linked by any of them
(``without_copies`` decides on each of its texts for itself); rows with null ``doc_id`` are not compared (null component, kept); an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import Forest, components
from .words import Words, mix, slices, words_of

VALUES, BATCH = 80, 16
BAND_MISS, MISS = 1e-4, 1e-5
BLOCK, HUBS = 256, 5
COLUMNS = 8192
BROADCAST_IDS = 1_000_000

MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin."""
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    text = np.repeat(np.arange(len(n)), count)
    start = words.first[:-1][text] + np.arange(ends[-1] if len(ends) else 0) - (ends - count)[text]
    keys = np.zeros(len(text), np.uint64)
    for k in range(size):
        inside = start + k < words.first[1:][text]
        keys[inside] = mix(keys[inside] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[start[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((keys, text))
    keys = keys[order]  # the texts keep their places
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(n)))])


def _signed(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 21):
            keys, first = shingles(words_of(batch["text"], lower=True), size)
            full = np.flatnonzero(np.diff(first))
            starts = first[:-1][full]
            values = np.zeros((batch.num_rows, VALUES), np.uint32)
            one, two = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            if len(full):
                for k, a in enumerate(MULTIPLIERS):
                    values[full, k] = np.minimum.reduceat((keys * a) >> np.uint64(32), starts)
                one[full], two[full] = np.add.reduceat(keys, starts), np.add.reduceat(mix(keys ^ np.uint64(0xABCDEF)), starts)
            signature = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(first)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), signature], names=["doc_id", "n_shingles", "one", "two", "signature"])

    return sign


def band_rows(threshold: float) -> int:
    """Signature values a band: the most with which pairs at the threshold are found."""
    fits = [r for r in range(1, 11) if (1 - threshold**r) ** (VALUES // r) <= BAND_MISS]
    return max(fits, default=1)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """The bucket of each band of each signature."""
    bands = VALUES // rows
    values = values[:, : bands * rows].reshape(-1, bands, rows)
    keys = np.zeros(values.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r].astype(np.uint64))
    return keys


def _banded(rows: int):
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_values(batch["signature"]), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["rep"].to_numpy(), keys.shape[1])), pa.array(keys.ravel().view(np.int64))], names=["rep", "bucket"])

    return band


def _values(column: pa.Array) -> np.ndarray:
    """Signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES) if len(column) else np.zeros((0, VALUES), np.uint32)


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For 16, 32, ... values compared: the fewest equal ones with which a pair goes on."""

    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return {n: next(m for m in range(n + 1) if posterior(m, n) >= miss) for n in range(BATCH, VALUES + 1, BATCH)}


def survivors(left: np.ndarray, right: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Places of the signature pairs that no batch prunes."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, least in needed.items():
        equal = equal + (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
        alive, equal = alive[equal >= least], equal[equal >= least]
    return alive


def _sieved(needed: dict[int, int]):
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = survivors(_values(batch["left"]), _values(batch["right"]), needed)
            yield batch.select(["a", "b"]).take(pa.array(kept))

    return sieve


BLOCK_KEY = ["bucket", "low", "high"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, block by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch[c].to_numpy() for c in BLOCK_KEY], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if held and any(held[-1][c][0].as_py() != batch[c][low].as_py() for c in BLOCK_KEY):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of a block, of different components."""
    part, side = rows["component"].to_numpy(), rows["chunk"].to_numpy()
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    x, y = (k.ravel() for k in np.meshgrid(np.flatnonzero(side == low), np.flatnonzero(side == high), indexing="ij"))
    ok = (part[x] != part[y]) & ((x < y) if low == high else True)
    return x[ok], y[ok]


def _likely(needed: dict[int, int], threshold: float, rows_a_band: int):
    """The rows of blocks that have a surviving pair; a pair counts only in the first bucket that it shares."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            size, values = rows["n_shingles"].to_numpy(), _values(rows["signature"].combine_chunks())
            x, y = _sides(rows)
            ok = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            x, y = x[ok], y[ok]
            kept = survivors(values[x], values[y], needed)
            x, y = x[kept], y[kept]
            if len(x):
                keys = band_keys(values, rows_a_band)
                own = (keys[x] == keys[y]).argmax(axis=1)
                here = keys[x, own].view(np.int64) == rows["bucket"][0].as_py()
                x, y = x[here], y[here]
            at = np.unique(np.concatenate([x, y]))
            yield from rows.select([*BLOCK_KEY, "chunk", "rep", "component"]).take(pa.array(at)).to_batches()

    return likely


def _linked(size: int, percent: int):
    """A spanning forest of the links within each block, by the full sets of its texts."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            x, y = _sides(rows)
            sets = []
            for piece in slices(rows.to_batches()):
                keys, first = shingles(words_of(piece["text"], lower=True), size)
                sets += np.split(keys, first[1:-1])
            n = np.array([len(k) for k in sets])
            distinct, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner, column = np.repeat(np.arange(len(sets)), n)[met[column] > 1], column[met[column] > 1]
            place = np.argsort(column, kind="stable")
            owner, column = owner[place], column[place]
            both = np.zeros((len(sets), len(sets)), np.float32)
            for low in range(0, len(distinct), COLUMNS):  # exact: counts are far below 2^24
                a, b = np.searchsorted(column, [low, low + COLUMNS])
                if a < b:
                    has = np.zeros((len(sets), COLUMNS), np.float32)
                    has[owner[a:b], column[a:b] - low] = 1
                    both += has @ has.T
            common = both[x, y].astype(np.int64)
            ok = (common > 0) & (100 * common >= percent * (n[x] + n[y] - common))
            rep, forest = rows["rep"].to_numpy(), Forest()
            for a, b in zip(rep[x[ok]].tolist(), rep[y[ok]].tolist()):
                forest.unite(a, b)
            ends = [k for k in forest.up if forest.root(k) != k]
            yield pa.RecordBatch.from_arrays([pa.array([forest.root(k) for k in ends], pa.int64()), pa.array(ends, pa.int64())], names=["a", "b"])

    return linked


def _verified(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a_text", "b_text"):
            x, xs = shingles(words_of(batch["a_text"], lower=True), size)
            y, ys = shingles(words_of(batch["b_text"], lower=True), size)
            linked = []
            for k in range(batch.num_rows):
                one, two = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return verify


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids, which are broadcast up to a million and joined by a shuffle beyond."""
    ids = scratch.saved(ids.toDF("id").distinct(), "dedup-ids")
    few = ids.count() <= BROADCAST_IDS
    return scratch.saved(docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi"), "dedup-texts")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, as a table."""
    pairs = scratch.saved(pairs.distinct(), "dedup-survivors")
    texts = _texts(docs, pairs.select("a").union(pairs.select("b")))
    a, b = (texts.select(F.col("doc_id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text")) for c in "ab")
    both = pairs.join(b, F.col("b") == F.col("b_id")).join(a, F.col("a") == F.col("a_id")).select("a", "b", "a_text", "b_text")
    return scratch.saved(both.mapInArrow(_verified(size, percent), "a long, b long").distinct(), "dedup-links")


def _several_texts(docs: DataFrame) -> DataFrame:
    """Ids of rows that repeat a ``doc_id`` with another text."""
    hashed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text", F.isnull("text")).alias("h"))
    return hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select(F.col("doc_id").alias("__several"))


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns) but for those whose group has one with a smaller ``doc_id``.

    A ``doc_id`` with several texts counts as so many documents, after all others: a
    unique text stays though another one of its id is a copy.
    """
    key = F.col("doc_id").cast("long")
    several = scratch.saved(_several_texts(docs.select(key.alias("doc_id"), "text")), "dedup-several")
    n = several.limit(BROADCAST_IDS + 1).count()
    if n:
        several = F.broadcast(several) if n <= BROADCAST_IDS else several
        own = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
        noted = docs.withColumn("__id", key).join(several, F.col("__id") == F.col("__several"), "left")
        named = noted.withColumn("__id", F.when(F.col("__several").isNull(), F.col("__id")).otherwise(own)).drop("__several")
    else:
        named = docs.withColumn("__id", key)
    found = near_copies(named.select(F.col("__id").alias("doc_id"), "text"), size, percent)
    gone = scratch.saved(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "dedup-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return named.join(gone, F.col("__id") == F.col("__gone"), "left_anti").drop("__id")


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; links have 100 x intersection >= percent x union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    needed = least_matches(percent / 100, MISS)
    signed = scratch.saved(docs.mapInArrow(_signed(size), "doc_id long, n_shingles long, one long, two long, signature binary"), "dedup-signatures")
    key = ["n_shingles", "one", "two"]
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = scratch.saved(named.groupBy(*key).agg(F.min("doc_id").alias("rep")), "dedup-classes")
    same = [F.col(f"s.{c}") == F.col(f"c.{c}") for c in key]
    reps = scratch.saved(named.alias("s").join(classes.alias("c"), [F.col("s.doc_id") == F.col("c.rep"), *same]).select("c.rep", "s.n_shingles", "s.signature").dropDuplicates(["rep", "n_shingles", "signature"]), "dedup-reps")

    bands = scratch.saved(reps.select("rep", "signature").mapInArrow(_banded(band_rows(percent / 100)), "rep long, bucket long"), "dedup-bands")
    sizes = bands.groupBy(F.col("bucket").alias("h_bucket")).agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.saved(bands.join(sizes, F.col("bucket") == F.col("h_bucket")).select("bucket", "rep", "n"), "dedup-shared")
    met = shared.groupBy(F.col("rep").alias("m_rep")).agg(F.sum("n").alias("met"))
    central = F.max_by("rep", F.struct("met", "rep"))
    firsts = [F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(HUBS - 1)]
    hubs = shared.join(met, F.col("rep") == F.col("m_rep")).groupBy(F.col("bucket").alias("h_bucket")).agg(F.array_distinct(F.array(central, *firsts)).alias("hubs"))
    shared = scratch.saved(shared.join(hubs, F.col("bucket") == F.col("h_bucket")).select("bucket", "rep", "n", "hubs"), "dedup-hubs")
    candidates = shared.select("rep", F.explode("hubs").alias("hub")).where(F.col("rep") != F.col("hub")).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    a, b = (reps.select(F.col("rep").alias(f"{s}_rep"), F.col("n_shingles").alias(f"{s}_n"), F.col("signature").alias(s)) for s in ("left", "right"))
    paired = candidates.join(b, F.col("b") == F.col("right_rep")).join(a, F.col("a") == F.col("left_rep"))
    paired = paired.where(100 * F.least("left_n", "right_n") >= percent * F.greatest("left_n", "right_n")).select("a", "b", "left", "right")
    links = _confirm(paired.mapInArrow(_sieved(needed), "a long, b long"), docs, size, percent)
    classed = named.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low != high").select(F.col("doc_id").alias("several"))
    again = named.join(classed, F.col("doc_id") == F.col("several")).join(classes.select("rep", *[F.col(c).alias(f"c_{c}") for c in key]), [F.col(c) == F.col(f"c_{c}") for c in key])
    links = links.union(scratch.saved(again.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct(), "dedup-repeated"))
    label = components(links)

    open_buckets = shared.where(F.size("hubs") < F.col("n") - 1).select("bucket", "rep")  # not all pairs have been candidates
    parts = open_buckets.join(label, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("label", "rep").alias("component"))
    spread = parts.groupBy(F.col("bucket").alias("o_bucket")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where(F.col("low") != F.col("high"))
    rest = parts.join(spread.select("o_bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), F.col("bucket") == F.col("o_bucket"))
    rest = rest.join(reps.select(F.col("rep").alias("r_rep"), "n_shingles", "signature"), F.col("rep") == F.col("r_rep"))
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("rep", "bucket"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = rest.select("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "rep", "component", "n_shingles", "signature")
    blocks = rest.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    likely = "bucket long, low int, high int, chunk int, rep long, component long"
    members = scratch.saved(blocks.mapInArrow(_likely(needed, percent / 100, band_rows(percent / 100)), likely), "dedup-likely")
    if not members.isEmpty():
        texts = _texts(docs, members.select("rep"))
        whole = members.join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id").repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
        more = scratch.saved(whole.mapInArrow(_linked(size, percent), "a long, b long").distinct(), "dedup-links")
        label = components(links.union(more))

    labelled = classes.join(label, F.col("rep") == F.col("node"), "left").select(*[F.col(c).alias(f"c_{c}") for c in key], F.coalesce("label", "rep").alias("found"))
    joined = signed.join(labelled, [F.col(c) == F.col(f"c_{c}") for c in key], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
