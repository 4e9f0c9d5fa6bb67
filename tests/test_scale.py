"""What grows with the input: shuffles of n-grams, buckets of generation, files of event logs."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triage.operators import ngram as G

TEXTS = ["a b c a b d a b c a c b", "a b e", "", None, " a  b ", "a\nb c\td e", "日 本 日 本 日"]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Exchange") for line in plan.split("\n"))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def _want(n):
    return Counter((" ".join(k[i : i + n - 1]), k[i + n - 1]) for k in (t.split(" ") for t in TEXTS if t is not None) for i in range(len(k) - n + 1))


def test_generation_deals_contexts_once_into_buckets_by_input(spark, corpus, tmp_path):
    """one shuffle for the ranges of draws, and more buckets for a larger corpus."""
    counts = G.ngram_counts(corpus, 2, buckets=16)
    assert _exchanges(G.successor_chunks(counts)) == 1
    spark.range(400_000).select(F.md5(F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "big"))
    big = spark.read.parquet(str(tmp_path / "big"))
    assert G.context_buckets(big) >= 12_000_000 // G.BUCKET_BYTES > G.context_buckets(big.limit(1).localCheckpoint())
    prompts = spark.createDataFrame([(k, "a") for k in range(20)] + [(99, "b")], "prompt_id int, text string")
    assert sorted(G.generate_random(prompts, counts, 5, n=2).collect()) == sorted(G.generate_random(prompts, counts.drop("bucket"), 5, n=2).collect())


def test_one_shuffle_from_ngrams_to_best_successors(spark, corpus):
    """best successors need no other shuffle, and a step-by-step generation ends with the same texts."""
    counts = G.ngram_counts(corpus, 3, buckets=16)
    best = G.best_successors(counts)
    assert _exchanges(best) == 1
    plain = G.best_successors(G.ngram_counts(corpus, 3))
    assert sorted(best.select("context", "token").collect()) == sorted(plain.select("context", "token").collect())
    assert all(r.bucket == r.want for r in best.withColumn("want", G._bucket("context", 16)).collect())


def test_one_shuffle_from_ngrams_to_model(spark, corpus):
    """counts and probabilities from one shuffle, equal to those by aggregate and join."""
    for n in (1, 2, 3):
        model = G.ngram_model(G.ngram_counts(corpus, n, buckets=16))
        assert _exchanges(model) == 1
        assert sorted(model.collect()) == sorted(G.ngram_model(G.ngram_counts(corpus, n)).collect())


def test_ngrams_counted_in_slices(spark, corpus, monkeypatch):
    """F8: counts are made a slice at a time, with no table of a task's n-grams before the shuffle."""
    monkeypatch.setattr(G, "SLICE_BYTES", 10)
    monkeypatch.setattr(G, "SLICE_GRAMS", 2)
    for n in (1, 2, 3, 5):
        counts = G.ngram_counts(corpus, n)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert {(r.context, r.token): r.n for r in counts.collect()} == _want(n)
        assert "HashAggregate" not in plan[plan.index("Exchange") :]


def _packed(texts, n, by, buckets, step=2):
    """The packed rows of batches of ``step`` texts."""
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + step], pa.string())], names=["text"]) for i in range(0, len(texts), step)]
    return [r for b in G._packer(n, by, buckets)(iter(batches)) for r in b.to_pylist()]


def _unpacked(rows, n):
    got = Counter()
    for r in rows:
        for i, count in enumerate(r["n"]):
            k = [r[f"t{j}"].split(" ")[i] for j in range(n)]
            got[" ".join(k[:-1]), k[-1]] += count
    return got


def test_a_slice_is_a_row_a_bucket(monkeypatch):
    """F8: n-grams are shuffled as a row for each bucket of a slice, which may span batches, not a row each."""
    for n in (1, 2, 3):
        rows = _packed(TEXTS, n, n, 3)
        assert len(rows) == len({r["bucket"] for r in rows}) <= 3
        assert _unpacked(rows, n) == _want(n)
        monkeypatch.setattr(G, "SLICE_BYTES", 10)
        assert len(_packed(TEXTS, n, n, 3)) > len(rows) and _unpacked(_packed(TEXTS, n, n, 3), n) == _want(n)
        monkeypatch.undo()
    many = [i % 7 for i in range(50)], [i % 5 for i in range(50)]
    places, buckets = [np.array(p, np.int32) for p in many], np.arange(50) % 2
    small, large = G._distinct(buckets, 2, places, 7), G._distinct(buckets, 2, places, 1 << 40)  # too many words for one number
    assert small[0].tolist() == large[0].tolist() and small[1].tolist() == large[1].tolist() and sum(small[1]) == 50


def test_counts_in_partitions_by_input(spark, tmp_path, monkeypatch):
    """F8: as many partitions as the corpus has parts, each written in order."""
    from triage.plans import ngram_queries as Q

    spark.range(3_000).select(F.concat_ws(" ", *[F.md5((F.col("id") % m).cast("string")) for m in (7, 50, 1000, 3000)]).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(G, "PART_BYTES", 4096)
    corpus = spark.read.parquet(str(tmp_path / "documents.parquet"))
    parts = G._parts(corpus)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = Q.q_ngram_counts(spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).collect()
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < len({r.p for r in out}) <= parts
    rows = [(r.p, r.context, r.token) for r in out]
    assert rows == sorted(rows) and sum(r.n for r in out) == 6_000


def test_model_in_order_of_contexts(spark, corpus):
    """a partition of the model is ordered by context, whatever its buckets."""
    rows = G.ngram_model(G.ngram_counts(corpus, 2, buckets=64)).withColumn("p", F.spark_partition_id()).collect()
    contexts = [(r.p, r.context) for r in rows]
    assert len({r.p for r in rows}) > 1 and contexts == sorted(contexts)


def test_successors_are_written_compressed(spark, corpus, tmp_path):
    """the table of successors takes less space, in the folders where live prompts look for them."""
    counts = G.ngram_counts(corpus, 3, buckets=16)
    best = G._bucketed(G.best_successors(counts), str(tmp_path / "best"), 16)
    assert all(f.endswith(".zstd.parquet") for f in best.inputFiles())
    rows = best.withColumn("want", G._bucket("context", 16)).collect()
    assert {r.context for r in rows} == {c for c, _ in _want(3)} and all(r.bucket == r.want for r in rows)
    live = G._placed(best.select(F.split("context", " ").alias("ctx_tokens")), 16).collect()
    assert {(r.context, r.bucket) for r in live} == {(r.context, r.bucket) for r in rows}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The event logs of 12,000 order lines of five suppliers, and the order lines' folder."""
    from triage.plans import runmetric_queries as Q

    top = str(tmp_path_factory.mktemp("lines"))
    ids = spark.range(12_000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 5).alias("l_suppkey"), (F.col("id") % 200).alias("l_partkey"))
    ids.write.parquet(f"{top}/lineitem.parquet")
    return Q._event_log(spark, top), top


def _files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.startswith(".")]


def test_event_log_files_hold_whole_rolls(spark, written):
    """about a thousand events a file whatever the number of applications, and every task comes back."""
    from triage.operators import runmetrics as E

    folder, top = written
    assert len(_files(folder)) <= 5 * 3  # 2,400 events an application; it was a file for each of 12 rolls of each
    got = E.read_run_log(spark, folder)
    assert got.select("task_id").distinct().count() == got.count() == 12_000


def test_stage_log_from_the_same_files(spark, written):
    """the stage attempts come back from the same few files; a line is parsed once."""
    from triage.operators import runmetrics as E

    stages = E.read_stage_log(spark, written[0])
    assert stages.agg(F.sum("n_tasks")).first()[0] == 12_000
    assert stages._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
    assert stages.count() == stages.select("app_id", "stage_id", "stage_attempt").distinct().count()


def test_event_logs_take_little_disk(spark, written):
    """rolls are compressed, as Spark writes them; it was 400 bytes an event."""
    files = _files(written[0])
    assert all(f.endswith(".zstd") for f in files)
    assert sum(map(os.path.getsize, files)) < 40 * 12_000


def _lines_of(spark, folder):
    rows = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_path").alias("file")).collect()
    return Counter((r.file.split("eventlog_v2_")[1].split("/")[0], r.value) for r in rows), Counter(r.file for r in rows)


def test_only_unfilled_rolls_are_shuffled(spark, tmp_path):
    """a task writes the rolls it can fill; what is left of each application is packed for the shuffle."""
    from triage.sources import log_source as L

    lines = spark.range(2_513).select(F.when(F.col("id") < 2_500, "a").when(F.col("id") < 2_510, "b").alias("app_id"), F.col("id").cast("string").alias("line"))
    left = lines.coalesce(1).mapInArrow(L._rolls(L._options(spark, str(tmp_path)), 1_000, 4), "bucket int, frame binary")
    rest = Counter(r.app_id for r in left.mapInArrow(L._unpacked, "app_id string, line string").collect())
    assert rest == {"a": 500, "b": 10, "None": 3}
    assert [*_lines_of(spark, str(tmp_path))[1].values()] == [1_000, 1_000]


@pytest.mark.parametrize("held", [1 << 26, 2_000])
def test_rolls_hold_every_line(spark, tmp_path, monkeypatch, held):
    """every line comes back once, repeated and empty ones too, even if tasks can hold few unfilled rolls."""
    from triage.sources import log_source as L

    monkeypatch.setattr(L, "HELD_BYTES", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        lines = spark.range(0, 5_000, 1, 6).select(
            F.when(F.col("id") % 3 > 0, "busy").otherwise(F.concat(F.lit("app-"), F.col("id") % 40)).alias("app_id"),
            F.when(F.col("id") % 7 > 0, F.concat(F.lit("é "), F.col("id") % 900)).otherwise("").alias("line"))
        L.write_rolls(lines, str(tmp_path), 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found, files = _lines_of(spark, str(tmp_path))
    assert found == Counter(map(tuple, lines.collect()))
    assert max(files.values()) == 100
    if held > 2_000:
        assert len(files) == 34 + 40


def test_streamed_logs_are_written_in_all_tasks(spark, monkeypatch):
    """log files, small as they are, are written by as many tasks as the session has shuffle partitions."""
    from triage.plans import store_queries as Q

    seen = []
    monkeypatch.setattr(Q, "write_logs", lambda logs, root: seen.append(logs.rdd.getNumPartitions()))
    Q._written_logs(spark, "/root/testdata/sf0.001")
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
