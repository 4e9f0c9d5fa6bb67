"""Top-k search, lexical search and whitening against brute force on small tables, and on odd rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from triage.llm import lexical, top_k, whitening
from triage.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<double>, qno int, low string, n string, x int, component string"


def odd_vectors(dims=8, n=260):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dims))
    rows = [(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(x)]
    rows += [(k, rows[k % 7][1]) for k in range(n, n + 60)]  # equal scores
    rows += [(1300, None), (1301, [float("nan")] * dims), (1302, [None] * dims), (1303, []), (1304, [float("inf")] * dims), (None, [1.0] * dims), (1350, [0.0] * dims)]
    rows += [(50, rows[50][1]), (100, rows[3][1])]  # repeated ids
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", 2, "c") for r in rows], VECTORS)


def usable(rows):
    return [(i, v) for i, v in rows if v and not any(c is None or not math.isfinite(c) for c in v)]


def test_top_k_equals_brute_force(spark):
    rows = odd_vectors() + [(1400, [1e6] * 8), (1500, [1.0, 2.0]), (1501, [1.5, 2.5]), (1401, [3e38] * 8)]
    df = table(spark, rows)
    got = sorted(map(tuple, top_k.top_k(df, df.where("vec_id % 50 = 0"), part_bytes=15_000, group_queries=5).collect()))
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in usable(rows) if i is not None and i != 1401]
    expected = []
    for i, q in {w for w in whole if w[0] % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i and len(c) == len(q))[:5]
        expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert Counter(r[0] for r in got)[1500] == 1  # fewer candidates than k
    assert top_k.top_k(df.where("false"), df.where("false")).collect() == []


def test_a_task_reports_no_bin_below_its_own_kth_score():
    rows = [{"qno": 7, "vec_id": -1, "low": -1000, "span": 2001, "above": 0, "data": np.array([1, 0], np.int64).tobytes()}]
    group = top_k.Group(rows, 2, 3)
    scores = np.array([900, 900, 5, 4, -999, 700])
    group.count(np.arange(6), np.stack([scores, scores], axis=1))
    told = group.counted().to_pydict()
    assert sum(told["n"]) == 3 and min(told["bin"]) == (700 + 1000) // 4


def brute_search(docs, items, k=20):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total, df = sum(1 for _, c in held if c), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        best = []
        for i, c in held:
            if not c:
                continue
            m = 75 + 25 * c.total() * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(TERM.findall((text or "").translate(LOWER))).items() if t in c)
            if score > 0:
                best.append((-score, 1 << 63 if i is None else i))
        out += [(item, r + 1, None if i == 1 << 63 else i, -s) for r, (s, i) in enumerate(sorted(best)[:k])]
    return Counter(out)


def test_lexical_search_equals_brute_force(spark):
    docs = [tuple(r) for r in read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read_table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    docs += [(1, None), (2, ""), (None, docs[3][1]), (5, docs[3][1]), (5, docs[3][1]), (7777, " - "), (8000, "Ça ÇA é9_x the THE"), (8001, "the " * 300_000)]
    items += [(1, None), (2, " "), (3, "the THE the zzzqq"), (3, "the THE the zzzqq"), (None, "ça é9"), (4, "the in er " * 50)]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, term string, n_docs int, row int")
    i = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, block string, item_no int")
    got = Counter(map(tuple, lexical.search(d, i, block_items=15, part_bytes=30_000).collect()))
    assert got == brute_search(docs, items)
    for left, right in ((d.where("false"), i), (d, i.where("false")), (d.where("doc_id = 7777"), i)):
        assert lexical.search(left, right).collect() == []


def test_mined_graph_sums_each_item():
    random.seed(3)
    for mined in (4096, 7, 0):
        items = [{bytes([97 + random.randrange(20)]): random.choice([1, 1, 2, 5]) for _ in range(12)} for _ in range(30)]
        leaves, sums, totals = lexical.mine(items, mined)
        value = {bytes([97 + k]): random.randrange(1000) for k in range(26)}
        at = [value[t] * n for t, n in leaves]
        for a, b in sums:
            at.append(at[a] + at[b])
        assert [sum(at[x] for x in t) for t in totals] == [sum(value[t] * n for t, n in item.items()) for item in items]
        plain = sum(n.bit_count() for item in items for n in item.values())
        assert len(sums) + sum(map(len, totals)) < plain if mined > 7 else len(sums) <= 2 * mined


def test_terms_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Ab cDe-f " * 50 + "x" * 40 + " é日 9"
    assert lexical.term_counts(text) == Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))


def symmetric(d, values, rng):
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    v = (q * values) @ q.T
    return (v + v.T) / 2


def test_inertia_and_leading_pairs():
    rng = np.random.default_rng(2)
    spread = [rng.exponential(size=d) * 100 for d in (1, 2, 5, 16, 64)]
    cases = spread + [np.r_[[7.0] * 5, rng.random(20)], np.ones(30), np.r_[3.0, 2.0, 1.0, np.zeros(20)], np.r_[50 * (1 + 1e-9 * np.arange(6)), rng.random(10)]]
    for values in cases:
        v = symmetric(len(values), values, rng)
        exact = np.linalg.eigvalsh(v)
        for s in rng.normal(size=10) * 100:
            assert whitening.inertia(v, s) == (exact > s).sum()
        e, x = whitening.leading(v)
        assert e == pytest.approx(exact[::-1][: len(e)], rel=1e-11) and np.abs(x @ x.T - np.eye(len(e))).max() < 1e-13
        assert np.abs(v @ x.T - x.T * e).max() < 1e-12 * exact[-1]
    assert len(whitening.leading(symmetric(23, cases[7], rng))[0]) == 3
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_whitening_equals_dense_algebra(spark):
    rows = odd_vectors(dims=12, n=300) + [(2000, [1.0, 2.0])]
    left = [v for i, v in usable(rows) if len(v) == 12]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in left])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    deviations = Counter((i, sum((n * a - b) ** 2 for a, b in zip(map(int, row), map(int, s)))) for (i, v), row in zip([u for u in usable(rows) if len(u[1]) == 12], x))
    for c in range(1, 9):
        mine = [r for r in got if r.component == c]
        assert Counter((r.vec_id, r.deviation) for r in mine) == deviations
        assert mine[0].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        own = {i: float(z) for (i, v), z in zip([u for u in usable(rows) if len(u[1]) == 12], y @ q[:, c - 1] / math.sqrt(e[c - 1])) if i not in (50, 100)}
        sign = 1 if own[0] * next(r.whitened for r in mine if r.vec_id == 0) > 0 else -1
        assert all(sign * r.whitened == pytest.approx(own[r.vec_id], abs=1e-7) for r in mine if r.vec_id not in (50, 100))


def test_whitening_of_odd_tables(spark):
    flat = [(k, [1.0, 2.0, 3.0]) for k in range(5)]
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(5)]
    assert whitening.whiten(table(spark, flat)).collect() == []
    assert whitening.whiten(table(spark, flat).where("false")).collect() == []
    assert {r.component for r in whitening.whiten(table(spark, line)).collect()} == {1}
    wide = [(k, [1e9 * (k % 3), float(k)]) for k in range(6)] + [(9, [1e300, 0.0])]
    got = whitening.whiten(table(spark, wide)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in wide[:6]]
    s = [sum(c) for c in zip(*x)]
    exact = {k: sum((6 * a - b) ** 2 for a, b in zip(v, s)) for k, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {k: d if d < 1 << 63 else None for k, d in exact.items()}


def test_exact_products_of_large_entries():
    z = np.array([[1 << 40, 3], [-(1 << 41), 1 << 30]])
    assert whitening.exact_product(z).tolist() == [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(2)] for i in range(2)]
    assert Fraction(int(whitening.exact_sum(z)[0])) == (1 << 40) - (1 << 41)
