"""F1–F9 — n-gram statistics over a text corpus, and generation over a prompt table.

* N-grams are cut and counted per batch of texts (Arrow), so a frequent n-gram collapses
  before the shuffle and no table of a task's n-grams is held, or spilled.
* Counts can be dealt by buckets of contexts: what is grouped by context after that
  (totals, best successors, ranges of draws) needs no other shuffle.  Other counts are
  divided by per-context totals from a second aggregate and an equi-join (AQE splits a
  hot context).
* Generation joins the live prompts, step by step, with a successor table written once in
  the shared checkpoint folder, in buckets by context.  There are as many buckets as the
  corpus has quarters of a megabyte, and a step reads only those in which live prompts are.
  Live prompts measured as small are broadcast.  Each step is written as a table there,
  which cuts lineage and resets statistics (``checkpoint()`` would carry the estimated
  ones forward, compounding).
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder
from ..sources.sizes import input_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

SEP = " "  # tokens are split on a single space, so they never contain it
SMALL_ROWS = 1_000_000  # live prompts up to this number and size are broadcast
SMALL_BYTES = 64 << 20
SLICE_BYTES = 16 << 20  # of text, counted at once
SLICE_GRAMS = 4 << 20
PART_BYTES = 4 << 20  # of the corpus's files, a partition of counts
HASH_BY, HASH_MASK = 31, (1 << 31) - 1
BUCKET_BYTES, MOST_BUCKETS = 256 << 10, 1 << 14  # of the corpus, a bucket of contexts


def read_corpus(spark: SparkSession, path: str, col: str = "text", fmt: str = "parquet") -> DataFrame:
    """one text column (``text``) from a JSON or parquet corpus."""
    reader = spark.read.format(fmt)
    return reader.load(path).select(F.col(col).alias("text"))


def tokenize(text: Column) -> Column:
    """split on a single space (empty tokens kept, as ``str.split(' ')``)."""
    return F.split(text, SEP, -1)


def _positions(corpus: DataFrame, n: int, text: str) -> tuple[DataFrame, list[Column]]:
    """A row for each n-gram, and its ``n`` tokens.  The tokens of a text stay one array,
    which the rows share, so an n-gram is put together only where it is used."""
    tokens = corpus.select(tokenize(F.col(text)).alias("k"))
    first = F.sequence(F.lit(0), F.size("k") - n)
    at = tokens.where(F.size("k") >= n).select("k", F.explode(first).alias("i"))
    return at, [F.get("k", F.col("i") + j) for j in range(n)]


def ngram_rows(corpus: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """Every n-gram occurrence as ``context, token`` (one split per text, inside
    whole-stage codegen; no per-position lambda)."""
    at, tokens = _positions(corpus, n, text)
    return at.select(F.concat_ws(SEP, *tokens[:-1]).alias("context"), tokens[-1].alias("token"))


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts in runs of about ``SLICE_BYTES`` each, at least one text, whatever the batches."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(0).cast(pa.large_string()).drop_null()
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, side="right")))
            held.append(texts.slice(low, high - low))
            size, low = size + ends[high - 1] - before, high
            if low < len(texts) or size >= SLICE_BYTES:
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _distinct(buckets: np.ndarray, most: int, places: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct n-gram is first, ordered by bucket and tokens, and how often it is there."""
    code, bound = buckets.astype(np.int64), most  # one number an n-gram, below ``bound``
    for ids in places:
        if bound * words >= 1 << 63:
            found, code = np.unique(code, return_inverse=True)
            bound = len(found)
        code, bound = code * words + ids, bound * words
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return first, counts


def _packer(n: int, by: int, buckets: int):
    """Counts of the n-grams of each slice, a row for each bucket: ``t0``, ``t1``, … hold the tokens at
    that place of its n-grams, joined, and ``n`` the counts.  The first ``by`` tokens tell the bucket."""
    joint = pa.scalar(SEP, pa.large_string())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _slices(batches):
            split = pc.split_pattern(texts, SEP)
            tokens, ends = split.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
            ids, words = tokens.indices.to_numpy(), tokens.dictionary
            crcs = np.array([zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()], np.int64)
            ends = np.repeat(ends, np.diff(ends, prepend=0))  # of the text of each token
            starts = np.flatnonzero(np.arange(len(ids)) + n <= ends)
            for low in range(0, len(starts), SLICE_GRAMS):
                at = starts[low : low + SLICE_GRAMS]
                places = [ids[at + j] for j in range(n)]
                hashed = np.zeros(len(at), np.int64)
                for p in places[:by]:
                    hashed = hashed * HASH_BY + crcs[p] & HASH_MASK
                bucket = hashed % buckets
                first, counts = _distinct(bucket, buckets, places, len(words))
                bucket = bucket[first]
                begins = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = pa.array(np.append(begins, len(bucket)), pa.int32())
                joined = [pc.binary_join(pa.ListArray.from_arrays(rows, words.take(pa.array(p[first]))), joint).cast(pa.string()) for p in places]
                counted = pa.ListArray.from_arrays(rows, pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins], pa.int32()), *joined, counted], names=["bucket", *(f"t{j}" for j in range(n)), "n"])

    return pack


def ngram_counts(corpus: DataFrame, n: int = 3, text: str = "text", buckets: int | None = None) -> DataFrame:
    """``context, token, n`` over the whole corpus; with ``buckets`` also ``bucket``, by
    which the rows are dealt then (see :func:`context_buckets`).

    A slice of texts is counted at once and only its counts are shuffled, once: most n-grams
    of a large corpus are rare, and a table of all those of a task would spill without getting
    smaller.  They are shuffled as a row of joined tokens for each bucket, ordered, which is
    half the size of a row for each n-gram, and taken apart where they are added up, in
    as many partitions as the corpus has ``PART_BYTES``, so that none has to spill."""
    parts, places = _parts(corpus), [f"t{j}" for j in range(n)]
    by, most = (n, parts * 16) if buckets is None else (n - 1, buckets)
    schema = ", ".join(["bucket int", *(f"{t} string" for t in places), "n array<int>"])
    packed = corpus.select(F.col(text).cast("string")).mapInArrow(_packer(n, by, most), schema)
    dealt = packed.withMetadata("bucket", {"buckets": most}).repartition(parts, "bucket")
    split = dealt.select("bucket", *[tokenize(F.col(t)).alias(t) for t in places], "n")
    each = split.select("bucket", *places, F.posexplode("n").alias("i", "n"))
    tokens = [F.get(t, F.col("i")) for t in places]
    rows = each.select("bucket", F.concat_ws(SEP, *tokens[:-1]).alias("context"), tokens[-1].alias("token"), "n")
    counts = rows.groupBy("bucket", "context", "token").agg(F.sum("n").alias("n"))
    return counts.drop("bucket") if buckets is None else counts


def ngram_model(counts: DataFrame) -> DataFrame:
    """``context, token, n, prob`` with prob = n(ctx, tok) / n(ctx)."""
    if "bucket" in counts.columns:  # a context's rows are in one task already; sorted by context, they are written in less space
        totals = F.sum("n").over(Window.partitionBy("context", "bucket"))
        return counts.select("context", "token", "n", (F.col("n") / totals).alias("prob"))
    totals = counts.groupBy("context").agg(F.sum("n").alias("ctx_n"))
    return counts.join(totals, "context").select("context", "token", "n", (F.col("n") / F.col("ctx_n")).alias("prob"))


def context_model(corpus: DataFrame, contexts: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """F4 restricted to the contexts in ``contexts`` (column ``context``).

    N-gram occurrences are semi-joined with the wanted contexts *before*
    counting, so only those are shuffled; a context's probabilities depend on
    its own counts only, so the result equals the full model's rows for it.
    The context table is broadcast only if its files prove it to be small.
    """
    from .repair import auto_join

    wanted = contexts.select("context").where(F.col("context").isNotNull()).distinct()
    rows = auto_join(ngram_rows(corpus, n, text), wanted, "context", "left_semi")
    return ngram_model(count_rows(rows))


def prompt_context(tokens: Column, n: int) -> Column:
    """The last n−1 tokens joined; NULL for a shorter prompt (it has no context)."""
    size = F.size(tokens)
    return F.when(size >= n - 1, F.array_join(F.slice(tokens, size - (n - 1) + 1, n - 1), SEP))


def with_context(prompts: DataFrame, n: int, text: str = "text") -> DataFrame:
    return prompts.withColumn("context", prompt_context(tokenize(F.col(text)), n))


def next_tokens(prompts: DataFrame, model: DataFrame, n: int = 3, k: int = 30, key: str = "prompt_id") -> DataFrame:
    """the ``k`` most probable next tokens per prompt (ties: token ascending).

    ``row_number() <= k`` lets Spark insert a per-partition group limit before
    the window's shuffle.
    """
    p = with_context(prompts, n).select(key, "context")
    j = p.join(model.select("context", "token", "prob"), "context")
    w = Window.partitionBy(key).orderBy(F.col("prob").desc(), F.col("token").asc())
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        key, "context", F.col("rank").cast("bigint").alias("rank"), "token", "prob"
    )


def unseen(prompts: DataFrame, model: DataFrame, n: int = 3, key: str = "prompt_id") -> DataFrame:
    """prompts whose context the model never saw (no prediction)."""
    p = with_context(prompts, n).select(key, "context")
    return p.join(model.select("context").distinct(), "context", "left_anti")


def best_successors(counts: DataFrame) -> DataFrame:
    """Argmax successor per context (ties: smallest token), a partial aggregate."""
    return counts.groupBy(*_keys(counts)).agg(
        F.min_by("token", F.struct(F.negative(F.col("n")), F.col("token"))).alias("token")
    )


def _keys(counts: DataFrame) -> list[str]:
    return ["bucket", "context"] if "bucket" in counts.columns else ["context"]


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def context_buckets(corpus: DataFrame) -> int:
    """Buckets of contexts for a corpus: by the size of its files, so that those a step of
    a generation reads don't grow with it, and at least the session's shuffle partitions."""
    return max(_shuffle_partitions(corpus), min(input_bytes(corpus) // BUCKET_BYTES, MOST_BUCKETS))


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _parts(corpus: DataFrame) -> int:
    """Partitions in which n-grams are added up, by the size of the corpus's files: their
    tables stay as large when the corpus grows."""
    return max(_shuffle_partitions(corpus), input_bytes(corpus) // PART_BYTES)


def _bucket(context: str | Column, buckets: int) -> Column:
    """The bucket of a context, as :func:`_packer` finds it from the tokens."""
    tokens = tokenize(F.col(context) if isinstance(context, str) else context)
    hashed = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda h, t: (h * HASH_BY + F.crc32(t)).bitwiseAND(F.lit(HASH_MASK)))
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def _dealt(counts: DataFrame, buckets: int | None) -> tuple[DataFrame, int]:
    """Counts dealt by the bucket of their contexts, and the number of buckets."""
    if "bucket" in counts.columns:
        return counts, counts.schema["bucket"].metadata["buckets"]
    buckets = buckets or context_buckets(counts)
    return counts.withColumn("bucket", _bucket("context", buckets)).repartition("bucket"), buckets


def _bucketed(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """``df`` written once, one folder per hash bucket of its contexts, and read back:
    a step reads the buckets its live prompts are in and no others."""
    rows, _ = _dealt(df, buckets) if "bucket" not in df.columns else (df, buckets)
    rows.sortWithinPartitions("bucket", "context").write.mode("overwrite").partitionBy("bucket").parquet(path, compression="zstd")
    fields = [f for f in df.schema.fields if f.name != "bucket"]
    schema = T.StructType([*fields, T.StructField("bucket", T.IntegerType())])
    return df.sparkSession.read.schema(schema).parquet(path)


def _seen() -> list[Column]:
    """Number and size of the live prompts, and the buckets of their contexts."""
    size = F.coalesce(F.sum(F.octet_length("context")), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), size.alias("bytes"), F.collect_set("bucket").alias("wanted")]


def _placed(live: DataFrame, buckets: int) -> DataFrame:
    """``live`` with the context and its bucket."""
    return live.withColumn("context", F.array_join("ctx_tokens", SEP)).withColumn("bucket", _bucket("context", buckets))


def _generate(prompts, steps, n, key, text, buckets, successors, store):
    """Shared loop: each step looks up one successor per live prompt.

    ``successors(live, wanted, spread, step)`` returns ``key, ctx_tokens, next``
    for the prompts that go on; ``wanted`` are the buckets of their contexts (at most
    ``buckets`` numbers) and ``spread`` broadcasts a probe whose size was measured as small.
    A step writes the prompts that went on, measured by the same job, so a prompt without
    a successor is absent from the next one, and the loop ends with the first empty step.  The
    written steps are the log from which the texts are put together at the end.
    """
    spark = prompts.sparkSession
    toks = tokenize(F.col(text))
    size = F.size(toks)
    keyed = prompts.select(F.col(key), F.when(size >= n - 1, F.slice(toks, size - (n - 1) + 1, n - 1)).alias("ctx_tokens"))
    live = _placed(keyed.where(F.col("ctx_tokens").isNotNull()), buckets)
    fields = [T.StructField("ctx_tokens", T.ArrayType(T.StringType())), T.StructField("next", T.StringType())]
    fields += [T.StructField("context", T.StringType()), T.StructField("bucket", T.IntegerType())]
    log_schema = T.StructType([prompts.schema[key], *fields])
    seen = live.agg(*_seen()).first().asDict()
    for step in range(steps):
        if seen["rows"] == 0:
            break
        small = seen["rows"] <= SMALL_ROWS and seen["bytes"] <= SMALL_BYTES
        hits = successors(live, seen["wanted"], F.broadcast if small else (lambda df: df), step)
        moved = F.slice(F.concat("ctx_tokens", F.array("next")), 2, n - 1) if n > 1 else F.col("ctx_tokens")
        hits, counted = _placed(hits.select(key, moved.alias("ctx_tokens"), "next"), buckets), Observation()
        hits.observe(counted, *_seen()).write.mode("overwrite").parquet(f"{store}/log/step={step}")
        seen = counted.get
        live = spark.read.schema(log_schema).parquet(f"{store}/log/step={step}").drop("next")
    else:
        step = steps
    if step == 0:
        return prompts.select(key, F.lit("").alias("generated"), F.lit(0).cast("bigint").alias("n_generated"))
    log = spark.read.schema(T.StructType([*log_schema.fields, T.StructField("step", T.IntegerType())])).parquet(f"{store}/log")
    texts = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "next"))).alias("_out"))
    return _texts(prompts, texts, key)


def generate_greedy(
    prompts: DataFrame,
    counts: DataFrame,
    steps: int,
    n: int = 3,
    key: str = "prompt_id",
    text: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """append the most probable next token ``steps`` times; a prompt stops
    at the first context the model has not seen.  ``key`` is unique in ``prompts``.

    The successors are written once, a row for each context; a step reads only the buckets
    that hold live prompts' contexts.  ``buckets`` is their number (None: that of ``counts``,
    or else :func:`context_buckets`)."""
    spark, store = prompts.sparkSession, new_folder(prompts.sparkSession, "generation")
    counts, buckets = _dealt(counts, buckets)
    best = _bucketed(best_successors(counts).withColumnRenamed("token", "next"), f"{store}/best", buckets)

    def successors(live, wanted, spread, step):
        return best.where(F.col("bucket").isin(wanted)).join(spread(live), ["bucket", "context"])

    out = _generate(prompts, steps, n, key, text, buckets, successors, store)
    _remove(spark, f"{store}/best")
    return out


generate_greedy_by_steps = generate_greedy


def _texts(prompts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each prompt's tokens (``_out``, in order) as text, with their number."""
    return prompts.select(key).join(found, key, "left").select(
        key,
        F.coalesce(F.array_join("_out.next", SEP), F.lit("")).alias("generated"),
        F.coalesce(F.size("_out"), F.lit(0)).cast("bigint").alias("n_generated"),
    )


def _chunk(token: str) -> Column:
    """0 to 255 by the token's hash; a context's successors are ordered by ``(chunk, token)``."""
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int")


def successor_chunks(counts: DataFrame) -> DataFrame:
    """Integer ranges ``[lo, hi)`` of the draws, by chunk, with the chunk's ``tokens``.

    A context's successors, ordered by ``(chunk, token)``, share ``[0, total)`` by
    their counts, exactly and without floating-point drift.  A row per ``context, chunk`` (at
    most 256 a context) holds the tokens of the chunk and their counts in order, so a value
    holds a chunk's tokens and a window a context's chunks, never all successors of a
    frequent context.
    """
    keys, n = _keys(counts), F.sum("n").alias("n")
    rows = counts.withColumn("chunk", _chunk("token"))
    per_chunk = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("tokens"), n)
    upto = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    chunks = per_chunk.withColumns({"hi": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    return chunks.select(*keys, "chunk", (F.col("hi") - F.col("n")).alias("lo"), "hi", "total", "tokens")


def successor_ranges(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`successor_chunks` without their tokens, and a row per token with
    its range within the chunk."""
    chunks = successor_chunks(counts)
    each = chunks.select("context", "chunk", "tokens", F.posexplode("tokens").alias("i", "t"))
    upto = F.aggregate(F.slice("tokens", 1, F.col("i") + 1), F.lit(0).cast("bigint"), lambda s, t: s + t["n"])
    tokens = each.select("context", "chunk", "t.token", (upto - F.col("t.n")).alias("lo"), upto.alias("hi"))
    return chunks.drop("tokens"), tokens


def _drawn(tokens: Column, at: Column) -> Column:
    """The token of a chunk in whose range ``at``, counted from the chunk's start, falls."""
    start = F.struct(at.cast("bigint").alias("left"), F.lit(None).cast("string").alias("token"))
    found = F.aggregate(tokens, start, lambda s, t: F.struct(
        (s["left"] - t["n"]).alias("left"), F.when((s["left"] >= 0) & (s["left"] < t["n"]), t["token"]).otherwise(s["token"]).alias("token")))
    return found["token"]


def draw(seed: int, key: Column, step: int) -> Column:
    """A number in ``[0, 2^60)`` from the leading 15 hex digits of the MD5 of ``seed|key|step``."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(str(step))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def generate_random(
    prompts: DataFrame,
    counts: DataFrame,
    steps: int,
    seed: int = 0,
    n: int = 3,
    key: str = "prompt_id",
    text: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """F8: sample each next token from the model's distribution.

    :func:`draw` modulo the context's total falls into the range of one chunk of successors
    (:func:`successor_chunks`) and of one token in it; it depends on seed, prompt and step
    alone, so reruns and retried tasks agree.
    """
    spark, store = prompts.sparkSession, new_folder(prompts.sparkSession, "generation")
    counts, buckets = _dealt(counts, buckets)
    chunks = _bucketed(successor_chunks(counts), f"{store}/chunks", buckets)

    def successors(live, wanted, spread, step):
        at = F.pmod(draw(seed, F.col(key), step), F.col("total"))
        found = chunks.where(F.col("bucket").isin(wanted)).join(spread(live), ["bucket", "context"])
        hits = found.where((F.col("lo") <= at) & (at < F.col("hi")))
        return hits.select(key, "ctx_tokens", _drawn(F.col("tokens"), at - F.col("lo")).alias("next"))

    out = _generate(prompts, steps, n, key, text, buckets, successors, store)
    _remove(spark, f"{store}/chunks")
    return out


def compare_prompts(pairs: DataFrame, model: DataFrame, n: int = 3) -> DataFrame:
    """for each ``(pair_id, text_a, text_b)``, compare the two next-token
    distributions by a full outer join on token: sizes, overlap, largest
    probability difference and whether they are identical."""
    a = pairs.select("pair_id", prompt_context(tokenize(F.col("text_a")), n).alias("context"))
    b = pairs.select("pair_id", prompt_context(tokenize(F.col("text_b")), n).alias("context"))
    m = model.select("context", "token", "prob")
    da = a.join(m, "context").select("pair_id", "token", F.col("prob").alias("pa"))
    db = b.join(m, "context").select("pair_id", "token", F.col("prob").alias("pb"))
    j = da.join(db, ["pair_id", "token"], "full_outer")
    per_pair = j.groupBy("pair_id").agg(
        F.count("pa").alias("n_a"),
        F.count("pb").alias("n_b"),
        F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("n_common"),
        F.max(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))).alias("max_diff"),
    )
    out = pairs.select("pair_id").join(per_pair, "pair_id", "left")
    return out.select(
        "pair_id",
        F.coalesce("n_a", F.lit(0)).cast("bigint").alias("n_a"),
        F.coalesce("n_b", F.lit(0)).cast("bigint").alias("n_b"),
        F.coalesce("n_common", F.lit(0)).cast("bigint").alias("n_common"),
        F.coalesce("max_diff", F.lit(0.0)).alias("max_diff"),
        (F.coalesce("max_diff", F.lit(0.0)) == 0).alias("same_distribution"),
    )
