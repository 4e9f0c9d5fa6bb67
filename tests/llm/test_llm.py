"""The training-data operators against brute force on small tables, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triage.llm import katz, langid, mixing, near_dedup, packing, quality_model, quality_rules, sharding, token_store, vector_dedup
from triage.llm.encoding import Encoder
from triage.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, shard string, start string, row string, score string, bucket string, label string"
LONG = " ".join(f"word{k % 977}" for k in range(20_000))
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (None, "no id at all", "en", "a"), (3, " \n\t ", "en", None), (4, "one two", "de", "b"),
    (5, "same text for two rows", "en", "a"), (5, "same text for two rows", "en", "a"), (6, "same text for two rows", "en", "b"),
    (7, LONG, "en", "b"), (8, "ÀÉ日本 <|endoftext|> it's  x", "fr", "a"), (9, "12 34 ...", "es", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", None, "y", "z", "b", "l") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "tokens": lambda d: token_store.read_tokens(d.sparkSession, token_store.write_tokens(d, BYTES)),
        "shards": lambda d: sharding.shard_documents(d, 3),
        "schedule": mixing.schedule,
        "mix": mixing.mix,
        "rules": lambda d: quality_rules.judge(d, labels, d.columns),
        "copies": near_dedup.near_copies,
        "without": near_dedup.without_copies,
        "quality": lambda d: quality_model.score(d, labels, d.columns),
        "language": langid.identify,
        "katz": katz.katz_scores,
        "packed": lambda d: packing.pack_documents(d, WORDS),
    }


NAMES = ["tokens", "shards", "schedule", "mix", "rules", "copies", "without", "quality", "language", "katz", "packed"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, empty, labels):
    assert operators(labels)[name](empty).collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("schedule", "mix", "without", "packed")])
def test_odd_rows_keep_every_document(name, odd, labels):
    got = operators(labels)[name](odd)
    ids = [r[0] for r in got.select("row.doc_id" if name in ("rules", "quality") else "doc_id").collect()]
    assert Counter(ids) == Counter(r[0] for r in ODD)


def test_odd_rows_results(odd, labels):
    tokens = {r.doc_id: r for r in operators(labels)["tokens"](odd).collect()}
    assert tokens[1].n_tokens == tokens[2].n_tokens == 1 and tokens[None].start == 0
    copies = {r.doc_id: r for r in near_dedup.near_copies(odd).collect()}
    assert copies[6].component_id == 5 and not copies[6].kept and copies[1].n_shingles == 0 and copies[4].n_shingles == 1 and copies[None].kept
    assert sorted(r.doc_id or 0 for r in near_dedup.without_copies(odd).collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    langs = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(langs[k].lang_pred == "und" and langs[k].score == 0 for k in (1, 2, 3, 9))
    assert {r.n_words for r in quality_rules.judge(odd, labels, ["doc_id"]).where("row.doc_id = 7").collect()} == {20_000}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns


def test_encoder_equals_whole_texts():
    random.seed(1)
    texts = ["", " ", "a\n \n b", "don't WE'LL  ", "Σας ΣΑΣ", "x" * 9000] + ["".join(random.choice(" \t\n\x1c\x85ab1.!é's<|>A") for _ in range(80)) for _ in range(300)]
    for path, spaces in ((BYTES, True), (WORDS, False)):
        encoder, whole = Encoder(path, spaces), Tokenizer.from_file(path)
        for text, ids in zip(texts, encoder.encode(texts)):
            assert list(ids) == whole.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    assert (token_store.unpack(*token_store.pack(values), len(values)) == values).all()
    docs, whole, start = read_table(spark, SMALL, "documents"), Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: r for r in token_store.read_tokens(spark, token_store.write_tokens(docs, BYTES, block_ids=5000)).collect()}
    for doc_id, text in sorted(docs.select("doc_id", "text").collect()):
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        assert tuple(got[doc_id])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_smallest_capacity_is_the_minimax():
    random.seed(2)
    for _ in range(200):
        sizes = [random.randrange(1, 30) for _ in range(random.randrange(1, 12))]
        shards, n = random.randrange(1, 6), len(sizes)
        ends = list(np.cumsum(sizes))
        best = [[math.inf] * (n + 1) for _ in range(shards + 1)]
        best[0][0] = 0
        for k in range(1, shards + 1):
            for j in range(n + 1):
                best[k][j] = min(max(best[k - 1][i], sum(sizes[i:j])) for i in range(j + 1))
        segments = [(k, s, True) for k, s in enumerate(sizes)]
        capacity = sharding._smallest(ends, segments, shards, True)
        assert capacity == best[shards][n]
        cuts = [0, *sharding._even(ends, shards, capacity), n]
        assert cuts == sorted(cuts) and all(sum(sizes[a:b]) <= capacity for a, b in zip(cuts, cuts[1:]))


def test_shards(spark):
    rows = sharding.shard_documents(read_table(spark, SMALL, "documents"), 5).collect()
    by, of = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in of.values())


def test_pfair_windows_and_deviation(spark):
    rows = mixing.schedule(read_table(spark, SMALL, "documents"), {"src0": 0.5, "src1": 0.3, "src2": 0.2}, block_bytes=512).collect()
    slots = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.m_source, r.block)) == (r.m_source, r.block)


def test_shares_in_bytes_after_every_slot(spark):
    random.seed(8)
    rows = [(k, "x" * random.choice([3, 40, 400, 900]), "hot" if k % 3 else f"s{k % 4}") for k in range(1500)]
    rows += [(5000, "y" * 4000, "hot"), (5001, "z" * 3000, "s0"), (5002, None, "s1")]  # longer than the block asked for
    weights = {"hot": 0.5, "s0": 0.3, "s1": 0.1, "s3": 0.1}
    found = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_bytes=512).where("on_target").collect()
    total, by_slot = Counter(), defaultdict(list)
    for r in found:
        by_slot[r.slot].append(r)
    for slot in range(max(by_slot) + 1):
        for r in by_slot[slot]:
            total[r.m_source] += r.m_bytes
        for source, w in weights.items():
            if any(r.m_source == source and r.slot > slot for r in found):
                assert abs(total[source] - w * (slot + 1) * 4000) < 4000 + 4000 / 2, (slot, source)


def test_mix_keeps_every_row_of_a_hot_source(spark, odd):
    text = "some words of a text " * 10
    rows = [(k, f"{k} {text}", "hot" if k % 3 else None if k % 2 else f"s{k % 20}") for k in range(600)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"hot": 0.1, "s0": 0.5, "s6": 0.4}):
        slots = {(r.m_source, r.m_doc): r.slot for r in mixing.schedule(docs, weights, block_bytes=512).collect()}
        mixed = [tuple(r) for r in mixing.mix(docs, weights, block_bytes=512).collect()]
        assert Counter(mixed) == Counter(rows)
        order = [slots[s, k] for k, _, s in mixed]
        assert order == sorted(order)
    assert Counter(map(tuple, mixing.mix(odd).collect())) == Counter(map(tuple, odd.collect()))


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (500, 3), (5000, 40), (100, 90)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for n, k, p in df.collect():
        exact = 1.0 if k > n * 0.01 else sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(exact, rel=1e-9)


def test_certified_cutoffs_equal_plain_python(spark):
    random.seed(9)
    cut, rules, bands = quality_rules.CUTOFFS, quality_rules.RULES, quality_rules.BANDS
    docs, marks = [], []
    for k in range(3000):
        good = random.random() < 0.8
        shares = [round(random.choice([0.0, 0.01, 0.045] if good else [0.0, 0.11, 0.35, 0.6]), 3) for _ in rules]
        docs.append((k, k % 2, k % 2600, *shares, False))  # some texts occur twice
        marks.append((k, int(good)))
    by_text = {}
    for d, (_, q) in zip(docs, marks):
        key = d[1], d[2]
        by_text[key] = (min(q, by_text[key][0]), by_text[key][1]) if key in by_text else (q, d[3:7])
    docs = [(d[0], d[1], d[2], *by_text[d[1], d[2]][1], d[-1]) for d in docs]  # equal texts have equal shares
    measured = spark.createDataFrame(docs, "doc_id long, band int, text_key long, " + ", ".join(f"{r} double" for r in rules) + ", base_failed boolean")
    measured = measured.withColumn("row", F.struct("doc_id"))
    got = {r.band: r for r in quality_rules.certified_cutoffs(measured, spark.createDataFrame(marks, "doc_id long, quality int"), 0.04, 0.05).collect()}
    for band in (0, 1):
        for k, rule in enumerate(rules):
            texts = [(q, s[k]) for (b, _), (q, s) in by_text.items() if b == band]
            n, bad = sum(q for q, _ in texts), sum(1 - q for q, _ in texts)
            best, worst = None, 0.0
            for c in cut:
                rejected, caught = sum(q for q, s in texts if s > c), sum(1 - q for q, s in texts if s > c)
                rate = 0.04 / len(rules)
                p = 1.0 if rejected > n * rate else sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(rejected + 1))
                worst = max(worst, p)
                gain = caught / bad - rejected / n
                if worst <= 0.05 / (len(rules) * len(bands)) and gain > 0 and (best is None or gain > best[0]):
                    best = gain, c
            assert (got[band][f"max_{rule}"] if band in got else None) == (best[1] if best else None), (band, rule)
    assert any(got[b][f"max_{r}"] is not None for b in got for r in rules)


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    lengths, labels = np.array([5, 1, 3]), 3
    scores, transitions = rng.normal(size=(3, 5, labels)), rng.normal(size=(labels, labels))
    mask = np.arange(5) < lengths[:, None]
    marginal, expected = langid.forward_backward(scores, mask, transitions)
    pairs = np.zeros((labels, labels))
    for k, n in enumerate(lengths):
        ways = list(itertools.product(range(labels), repeat=int(n)))
        weight = np.exp([sum(scores[k, t, w[t]] for t in range(n)) + sum(transitions[w[t - 1], w[t]] for t in range(1, n)) for w in ways])
        weight /= weight.sum()
        for t in range(n):
            assert marginal[k, t] == pytest.approx([sum(p for p, w in zip(weight, ways) if w[t] == y) for y in range(labels)])
        for p, w in zip(weight, ways):
            for t in range(1, n):
                pairs[w[t - 1], w[t]] += p
    assert expected == pytest.approx(pairs)
    for stretch in (1, 2, 3, 5, 9):  # the same whatever the stretches
        for low, rows, on, found in langid.chain_marginals(lambda r, a, b: scores[r, a:b], lengths, transitions, stretch):
            assert found[on] == pytest.approx(marginal[rows, low : low + on.shape[1]][on])


def test_few_labels_still_fit_a_network_and_scores_are_calibrated():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 12)).astype(np.float32)
    chance = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    y = rng.random(4000) < chance
    p = quality_model.Network(x[:3000], y[:3000])(x[3000:])
    bins = np.digitize(p, [0.2, 0.4, 0.6, 0.8])
    for b in range(5):
        assert abs(p[bins == b].mean() - y[3000:][bins == b].mean()) < 0.12
    few = quality_model.Network(x[:9], np.array([True] * 8 + [False]))
    assert few.temperature >= 1 and np.isfinite(few(x[:50])).all() and np.ptp(few(x[:50])) > 0


def test_rule_base_counts(spark):
    docs = read_table(spark, SMALL, "documents")
    got = {r.doc_id: r for r in quality_rules.judge(docs, read_table(spark, SMALL, "labels"), ["doc_id"]).select("row.doc_id", *quality_rules.BASE, "base_failed", "kept").collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = WORD.findall(text)
        c, met = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                met |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert tuple(got[doc_id])[1:6] == (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(met))
        assert got[doc_id].base_failed == (len(w) < 50 or 100 * len(met) > 50 * len(w)) and not (got[doc_id].base_failed and got[doc_id].kept)


def test_near_copies_equal_brute_force(spark):
    random.seed(4)
    base = [[f"w{random.randrange(4000)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for k in range(160):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
            words[random.randrange(len(words))] = f"v{random.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    got = {r.doc_id: r for r in near_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    sets, up = {}, {k: k for k, _ in docs}
    for k, text in docs:
        w = text.split()
        sets[k] = set(zip(w, w[1:], w[2:]))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {k: (r.component_id, r.n_shingles) for k, r in got.items()} == {k: (root(k), len(sets[k])) for k in sets}


def test_each_text_of_a_repeated_id_counts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "y"), (7, c, "x"), (8, c + " end", "x"), (9, None, "x"), (9, c, "z"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_copies(docs).collect()}
    assert got == {(3, 3), (5, 3), (7, 7), (8, 7), (9, 7), (9, 9), (None, None)}  # the null text of 9 has no set
    left = Counter(map(tuple, near_dedup.without_copies(docs).collect()))
    assert left == Counter([(3, a, "x"), (5, b, "y"), (5, b, "y"), (7, c, "x"), (9, None, "x"), (None, a, "x")])


@pytest.mark.parametrize("block, word_part, pair_part", [(katz.BLOCK_TOKENS, katz.WORD_PART_BYTES, katz.PAIR_PART_TOKENS), (4_000, 40_000, 3_000)])
def test_katz_equals_brute_force_and_sums_to_one(spark, monkeypatch, block, word_part, pair_part):
    for name, value in (("BLOCK_TOKENS", block), ("WORD_PART_BYTES", word_part), ("PAIR_PART_TOKENS", pair_part)):
        monkeypatch.setattr(katz, name, value)  # the second time several blocks, parts and spread contexts
    docs = read_table(spark, SMALL, "documents")
    got = {r.doc_id: r for r in katz.katz_scores(docs).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {i: WORD.findall(t.translate(lower)) + ["\n"] for i, t in docs.select("doc_id", "text").collect()}
    uni, pairs = Counter(), defaultdict(Counter)
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            uni.update(w)
            for a, b in zip(["\0", *w], w):
                pairs[a][b] += 1

    def discount(counts):
        met = np.bincount(np.minimum(list(counts), 7), minlength=8)
        return katz.discounts(met)

    one, two, n = discount(uni.values()), discount(c for x in pairs.values() for c in x.values()), sum(uni.values())
    p = {w: one[min(c, 6)] * c / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())

    def model(a, b):
        if a not in pairs:
            return p.get(b, unknown)
        seen, total = pairs[a], sum(pairs[a].values())
        flat = all(c > 5 for c in seen.values())
        if b in seen:
            return two[min(seen[b], 6)] * seen[b] / (total + flat)
        left = 1 / (total + 1) if flat else 1 - sum(two[min(c, 6)] * c for c in seen.values()) / total
        return left / (1 - sum(p[w] for w in seen)) * p.get(b, unknown)

    for a in ["\0", "the", "of"]:
        assert sum(model(a, b) for b in p) + model(a, None) == pytest.approx(1)
    for i, w in list(texts.items())[:60]:
        assert got[i].score == pytest.approx(sum(math.log10(model(a, b)) for a, b in zip(["\0", *w], w)), rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((uni[b] + 1) / (n + len(uni) + 1)) for b in w), rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(b in uni for b in w), n)


def test_vector_copies_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = [(k, (centres[k % 40] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5])).tolist()) for k in range(900)]
    vectors += [(k, vectors[k - 900][1]) for k in range(900, 950)] + [(950, None), (951, [0.0] * 16), (952, [float("nan")] * 16), (953, [None] * 16), (954, []), (None, [1.0] * 16)]
    table = spark.createDataFrame([(*v, 1, "x", 2) for v in vectors], "vec_id long, embedding array<double>, shard int, dims string, rep int")
    found = [{r.vec_id: r for r in vector_dedup.vector_copies(table, shard_rows=300, block_rows=400, exact=e).collect()} for e in (False, True)]
    x = np.array([v for k, v in vectors[:950]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(950, dtype=bool)
    label = np.arange(950)
    while True:
        new = np.array([min(label[k], label[near[k]].min(initial=label[k])) for k in range(950)])
        if (new == label).all():
            break
        label = new
    for got in found:
        assert [got[k].n_links for k in range(950)] == near.sum(axis=1).tolist()
        assert [got[k].component_id for k in range(950)] == label.tolist()
        assert all(got[k].n_links == 0 and got[k].kept for k in (950, 951, 952, 953, 954)) and got[None].component_id is None
    assert found[0][0].recall >= 0.999 and found[1][0].recall is None
    assert vector_dedup.vector_copies(table.where("false")).collect() == []


def test_sparse_links_are_found_by_the_audited_graph(monkeypatch):
    """Few queries have a link; all answers come from the graph."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.93 * x[:500] + np.sqrt((1 - 0.93**2) / 64) * rng.normal(size=(500, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    asked = np.concatenate([x[500:], y])
    no = lambda n, value=0, kind=pa.int32(): pa.array(np.full(n, value), kind)
    rows = pa.RecordBatch.from_arrays([no(2000, 64), no(2000), pa.array(range(2000), pa.int64()), no(2000, 1, pa.int64()), pa.array([v.tobytes() for v in x])], names=["dims", "shard", "rep", "copies", "unit"])
    graph = [b.add_column(2, "block", no(b.num_rows)) for b in vector_dedup._graphs(0.9)(iter([rows]))]
    layers = [b for b in graph if b["kind"][0].as_py() == 1]
    assert all(b["rep"][0].as_py() < 500 and b["copies"][0].as_py() >= 999_000 for b in layers)  # beam and recall
    monkeypatch.setattr(vector_dedup.Shard, "_compared", None)
    reps = pa.array([*range(500, 2000), *range(5000, 5500)], pa.int64())
    query = pa.RecordBatch.from_arrays([no(2000, 64), no(2000), no(2000), no(2000, 2), no(2000), no(2000, 0, pa.int64()), reps, no(2000, 1, pa.int64()), pa.array([v.tobytes() for v in asked])],
                                       names=["dims", "shard", "block", "kind", "layer", "first", "rep", "copies", "data"])
    answers = pa.Table.from_batches(vector_dedup._answers(0.9)(iter([*graph, query])))
    got = {a: b for kind, a, b in zip(*(answers[c].to_pylist() for c in ("kind", "a", "b"))) if kind == 0}
    near = (asked @ x.T >= 0.9).sum(axis=1) - (np.arange(2000) < 1500)
    assert near.sum() >= 300 and sum(min(got[r], n) for r, n in zip(reps.to_pylist(), near.tolist())) >= 0.99 * near.sum()
    assert all(got[r] <= n for r, n in zip(reps.to_pylist(), near.tolist()))


def test_quality_and_language_are_learned(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    scored = quality_model.score(docs, labels, ["doc_id"]).select("row.doc_id", "score").join(labels, "doc_id").where(quality_model.fold(F.col("doc_id"), 4) == 2)
    assert scored.where((F.col("score") >= 0.7) == (F.col("quality") == 1)).count() >= 0.9 * scored.count()
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_best_fit_rounds_equal_sequential_best_fit():
    random.seed(6)
    for _ in range(60):
        lengths = [random.randrange(1, 101) for _ in range(random.randrange(1, 200))]
        gaps = []
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(100 - n)
        used = defaultdict(list)
        counts = Counter(lengths)
        rounds = sorted(packing.best_fit_rounds(counts, 100))
        for k, (n, rank, first, each, offset) in enumerate(rounds):
            last = rounds[k + 1][1] if k + 1 < len(rounds) and rounds[k + 1][0] == n else counts[n]
            for nth in range(last - rank):
                used[first + nth // each].append((offset + nth % each * n, n))
        for pieces in used.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 100
        assert sum(map(len, used.values())) == len(lengths) and len(used) == len(gaps)


PIPELINE_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_rows():
    random.seed(12)
    vocabulary = [f"{a}{b}" for a in ("re", "the", "on", "in", "mo", "ta") for b in ("", "s", "nd", "ly", "tion", "er", "m", "ku")]
    rows = []
    for k in range(260):
        words = [random.choice(vocabulary) + random.choice(["", "", str(random.randrange(300))]) for _ in range(random.choice([60, 150, 400]))]
        if k % 9 == 0:
            words = words[:5] * 40  # repeated windows
        rows.append((k, " ".join(words), "en", "hot" if k % 3 else None if k % 2 else f"s{k % 5}"))
    for k in range(260, 330):  # exact and near copies
        words = rows[random.randrange(260)][1].split()
        if k % 2:
            words[random.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "en", "hot"))
    rows += [rows[7], rows[7], (11, rows[40][1], "en", "s1"), (13, " ".join(f"only{i}" for i in range(90)), "en", "s2"), (400, None, "en", "s2"), (401, "", None, None), (402, "few words here", "en", "hot"),
             (None, " ".join(f"nameless{i}" for i in range(70)), "en", "s1"), (403, " ".join(f"long{i % 977} {i}" for i in range(3000)), "en", "hot")]
    return [(*r, 5) for r in rows]


def base_passes(text):
    w = WORD.findall(text or "")
    c, met = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            met |= {k, k + 1, k + 2}
    return len(w) >= 50 and 100 * len(met) <= 50 * len(w)


def one_of_each_group(rows):
    """Rows of the smallest id of each group of texts; an id with several texts stands behind all others with each of them."""
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])

    def node(r):
        return (1, r[0], r[1]) if len(texts[r[0]]) > 1 else (0, r[0], "")

    named = [r for r in rows if r[0] is not None]
    sets, up = {}, {}
    for r in named:
        w = WORD.findall((r[1] or "").lower())
        sets[node(r)], up[node(r)] = (set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} - {()}), node(r)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = sorted(sets)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [r for r in rows if r[0] is None or root(node(r)) == node(r)]


def pieces_of(rows):
    whole, out = Tokenizer.from_file(WORDS), Counter()
    for doc_id, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for nth, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            out[(doc_id, nth, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def check_packed(packed, rows):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces_of(rows)
    used = defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    gaps = []
    for r in sorted(packed, key=lambda r: -r.length):  # best fit decreasing, one by one
        fits = [g for g in gaps if g >= r.length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - r.length)
    assert len(used) == len(gaps)


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near copies", "mixing", "packing"]
    rows = pipeline_rows()
    docs = spark.createDataFrame(rows, PIPELINE_DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(k, int(k % 9 != 0)) for k in range(0, 260, 2)]
    spark.createDataFrame([(*m, 0) for m in marks], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = str(tmp_path)
    docs = read_table(spark, folder, "documents")

    def bag(df):
        assert df.columns == docs.columns
        return Counter(map(tuple, df.collect()))

    scored = quality_model.score(docs, read_table(spark, folder, "labels"), docs.columns).collect()
    assert Counter(tuple(r.row) for r in scored) == Counter(rows)
    good = [tuple(r.row) for r in scored if r.score >= 0.7]
    assert 0 < len(good) < len(rows)
    assert bag(corpus_pipeline.classify_quality(spark, docs, folder)) == Counter(good)
    # too few labels to certify a cutoff: the base alone decides
    assert bag(corpus_pipeline.apply_rules(spark, docs, folder)) == Counter(r for r in rows if base_passes(r[1]))
    assert bag(corpus_pipeline.drop_copies(spark, docs, folder)) == Counter(one_of_each_group(rows))
    assert bag(corpus_pipeline.mix_sources(spark, docs, folder)) == Counter(rows)
    check_packed(corpus_pipeline.pack_sequences(spark, docs, folder).collect(), rows)

    left = one_of_each_group([r for r in good if base_passes(r[1])])
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packed(packed.collect(), left)
