"""Plans: filters and pruning through the record, buckets of generation, distinct counts."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from triage.operators import ngram as G
from triage.operators import repair as R
from triage.operators.rootcause import RECORD_FIELDS, analyze
from triage.plans.triage_queries import root_causes
from triage.sources.synth import synth_logs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_on_a_carried_column_reaches_the_scan(spark):
    plan = _plan(root_causes(spark, SF_SMALL).where("event_id = 3"))
    assert "EqualTo(event_id,3)" in plan


def test_wanted_fields_alone_are_extracted(spark):
    logs = synth_logs(spark, SF_SMALL)
    whole, part = (_plan(analyze(logs, fields=f)) for f in (None, ["confidence"]))
    assert part.count("regexp_extract(") < whole.count("regexp_extract")
    assert analyze(logs).columns == RECORD_FIELDS


def test_plans_extract_what_they_read(spark):
    import __spark_entry__ as E

    def regexes(name):
        return _plan(E.queries()[name](spark, SF_SMALL)).count("regexp_extract(")

    whole = regexes("root_causes")
    for name, most in (("rule_matches", 8), ("normalized_actions", 8), ("routes", 12), ("fix_plans_review", 12), ("recommendations", 12)):
        assert regexes(name) <= most < whole, (name, regexes(name), whole)
    rc = root_causes(spark, SF_SMALL, ["diagnostics.missing_path"])
    assert rc.columns[-1] == "diagnostics" and rc.select("diagnostics.*").columns == ["missing_path"]


def test_kinds_are_the_filtered_records(spark):
    logs = synth_logs(spark, SF_SMALL)
    some = analyze(logs, kinds=["OOM", "Skew"]).drop("detected_at")
    every = analyze(logs).drop("detected_at").where(F.col("classification.error_type").isin("OOM", "Skew"))
    assert some.exceptAll(every).isEmpty() and every.exceptAll(some).isEmpty() and not some.isEmpty()


def test_distinct_counts_of_a_hot_key(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 37).alias("v")).union(
        spark.createDataFrame([(2, None), (2, 5)], "k int, v long"))
    got = {r.k: (r.n, r.d) for r in R.salted_agg(rows, "k", [("count", "*", "n"), ("count_distinct", "v", "d")], 8).collect()}
    assert got == {1: (1000, 37), 2: (2, 1)}
    with pytest.raises(ValueError):
        R.salted_agg(rows, "k", [("count_distinct", "k", "a"), ("count_distinct", "v", "b")])


def test_ranges_share_the_whole_total(spark):
    """Chunks tile a context's total and tokens tile their chunk."""
    counts = G.ngram_counts(spark.createDataFrame([("a b c a b d a b c a c b",), ("a b e",)], "text string"), 2)
    chunks, tokens = (df.collect() for df in G.successor_ranges(counts))
    n = {(r.context, r.token): r.n for r in counts.collect()}
    for context in {c for c, _ in n}:
        mine = sorted((r.lo, r.hi, r.total, r.chunk) for r in chunks if r.context == context)
        total = sum(v for (c, _), v in n.items() if c == context)
        assert [m[0] for m in mine] == [0] + [m[1] for m in mine[:-1]] and mine[-1][1] == total == mine[0][2]
        for lo, hi, _, chunk in mine:
            inside = sorted((r.lo, r.hi, r.token) for r in tokens if (r.context, r.chunk) == (context, chunk))
            assert [i[0] for i in inside] == [0] + [i[1] for i in inside[:-1]] and inside[-1][1] == hi - lo
            assert all(h - l == n[context, t] for l, h, t in inside)


@pytest.mark.parametrize("generate", [G.generate_greedy, G.generate_greedy_by_steps, G.generate_random])
def test_generation_ends_and_keeps_every_prompt(spark, generate):
    counts = G.ngram_counts(spark.createDataFrame([("x y z w",)], "text string"), 3)
    prompts = spark.createDataFrame([(1, "x y"), (2, "q q"), (3, "x"), (4, None), (5, "y z")], "prompt_id int, text string")
    got = {r.prompt_id: (r.generated, r.n_generated) for r in generate(prompts, counts, 9).collect()}
    assert got == {1: ("z w", 2), 2: ("", 0), 3: ("", 0), 4: ("", 0), 5: ("w", 1)}
    unseen = generate(prompts.where("prompt_id = 2"), counts, 9).collect()
    assert [(r.generated, r.n_generated) for r in unseen] == [("", 0)]


def test_shuffled_generation_equals_the_broadcast_one(spark, monkeypatch):
    counts = G.ngram_counts(spark.createDataFrame([("a b a c a b c b a",)], "text string"), 2)
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "prompt_id int, text string")
    small = sorted(G.generate_random(prompts, counts, 4, n=2).collect())
    monkeypatch.setattr(G, "SMALL_ROWS", 0)
    assert sorted(G.generate_random(prompts, counts, 4, n=2).collect()) == small


def test_steps_read_only_wanted_buckets(spark):
    counts = G.ngram_counts(spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),)], "text string"), 2)
    table = G._bucketed(counts, G.new_folder(spark, "test"), 16)
    assert len(table.where(F.col("bucket").isin([3])).inputFiles()) <= len(table.inputFiles())
    assert "PartitionFilters: [isnotnull(bucket" in _plan(table.where(F.col("bucket").isin([3])))


def test_jumps_equal_single_steps(spark):
    """Composed successors give the text that single steps give, whatever the number of steps, and in few jobs."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "b a  c", "zz", None, "x  y", " "])], "prompt_id long, text string")
    prompts = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").selectExpr("item_id + 10 AS prompt_id", "text").union(texts)
    sc = spark.sparkContext
    for n, steps in ((3, 50), (2, 7), (3, 1), (3, 0), (1, 4), (4, 3)):
        corpus = docs.union(spark.createDataFrame([("a b a  c a b a  d x  y  z",)], "text string"))
        counts = G.ngram_counts(corpus, n)
        assert sorted(G.generate_greedy(prompts, counts, steps, n).collect()) == sorted(G.generate_greedy_by_steps(prompts, counts, steps, n).collect()), (n, steps)
    sc.setJobGroup("jumps", "jumps")
    G.generate_greedy(prompts, G.ngram_counts(docs, 3), 50)
    sc._jsc.clearJobGroup()
    written = {sc.statusTracker().getStageInfo(s).name.split(" at ")[0] for j in sc.statusTracker().getJobIdsForGroup("jumps") for s in sc.statusTracker().getJobInfo(j).stageIds if sc.statusTracker().getStageInfo(s)}
    assert "collect" not in written


def test_ngrams_of_odd_texts(spark):
    texts = ["", " ", "a", "a b", " a  b ", "a b c a b c", None, "a\nb c\td e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (1, 2, 3, 5):
        want = {}
        for t in texts:
            k = t.split(" ") if t is not None else []
            for i in range(len(k) - n + 1):
                key = (" ".join(k[i : i + n - 1]), k[i + n - 1])
                want[key] = want.get(key, 0) + 1
        assert {(r.context, r.token): r.n for r in G.ngram_counts(df, n).collect()} == want
        assert {(r.context, r.token): r.n for r in G.count_rows(G.ngram_rows(df, n)).collect()} == want
