"""Whitening and ranked search against plain versions."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orbisweep.llm import search, whitening


def plain_whitening(rows, components=16):
    """x, n, S, V as fractions; eigenvectors by a float64 solver on a matrix rounded once."""
    used = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in used})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    cov = [[sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in distinct) / n for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    order = np.argsort(-values)[:components]
    return used, n, sums, np.array([[float(c) for c in r] for r in cov]), values[order], vectors[:, order]


def test_whitening_equals_a_plain_version_and_handles_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 5)) * [3.0, 2.0, 1.0, 0.5, 0.1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(500 + i, rows[7][1]) for i in range(200)]  # copies count once in the fit
    rows += [(7, rows[7][1]), (None, rows[3][1])]
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, [])]
    data = [(k, v, "x", 1) for k, v in rows + odd]
    rng.shuffle(data)
    frame = spark.createDataFrame([tuple(r) for r in data], "vec_id long, embedding array<float>, x string, n int").repartition(5)
    got = whitening.whiten(frame).collect()
    used, n, sums, cov, values, vectors = plain_whitening(rows)
    assert len(got) == len(used) * 5
    by_key = {}
    for r in got:
        by_key.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = None
    for k, x in used:
        want = (np.array(x) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
        mine = np.array([by_key[k, c][0]["whitened"] for c in range(1, 6)])
        signs = np.sign(want * mine) if signs is None else signs
        np.testing.assert_allclose(mine, want * signs, rtol=1e-9, atol=1e-9)
        assert by_key[k, 1][0]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
    assert {r["n"] for r in got} == {n} and n <= 150
    assert max(r["identity_error"] for r in got) < 1e-9
    np.testing.assert_allclose([by_key[0, c][0]["explained"] for c in range(1, 6)], values / np.trace(cov), rtol=1e-10)


def test_whitening_without_spread_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)  # one dimension never moves
    assert {(r["component"], round(abs(r["whitened"]), 12)) for r in whitening.whiten(flat).collect()} == {(1, 1.0)}
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [1.0]), (4, [0.0, 9.0])], schema)
    assert {r["vec_id"] for r in whitening.whiten(mixed).collect()} == {1, 2, 4}
    large = spark.createDataFrame([(i, [float(np.float32((i * 7919 % 101) * 2e14)), float(i)]) for i in range(40)] + [(99, [3e38, 0.0])], schema)
    found = whitening.whiten(large).collect()
    assert {r["vec_id"] for r in found} == set(range(40)) and {r["deviation"] for r in found} == {None}


@pytest.mark.parametrize("gaps", [[1, 1e-2, 1e-5, 1e-8], [1, 1 + 1e-7, 1 + 2e-7, 0.5], [1, 1 + 1e-10, 1e-3, 1e-3 + 1e-13], [2, 2, 2, 1]])
def test_refinement_separates_clusters(gaps):
    rng = np.random.default_rng(1)
    d = 24
    values = np.concatenate([gaps, np.linspace(0.1, 0.2, d - len(gaps))])
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal beyond float64
        q = q + q @ (np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.refined_eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(a @ x - x * e).max() < 1e-17 * 10
    np.testing.assert_allclose(np.float64(e), np.sort(values)[::-1], rtol=1e-14, atol=1e-17)
    apart = [i for i in range(d) if np.min(np.abs(np.delete(values, i) - values[i])) > 1e-9]
    for i in apart:  # eigenvectors themselves, to double precision
        assert 1 - np.abs(q[:, i] @ x).max() < 1e-15


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(v for _, c in counted for v in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in counted:
            if not c:
                continue
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[v] + 1))) * (10**9 * c[v] // (1000 * c[v] + 8 * m)) for v in set(terms(text)) if v in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "日本", "x9", "A1"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 30, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [docs[6], docs[6], (None, docs[5][1]), (None, "w1 w2"), (2000, None), (2001, "-- !!")]
    docs.append((2002, " ".join(["w7 w8 rare"] + ["filler"] * 200_000)))
    items = [(i, text(rng.choice([1, 5, 20]))) for i in range(25)] + [(3, "w1 w2"), (3, "w1 w2"), (50, None), (51, ""), (52, "unknownword"), (53, "RARE w7"), (None, "w3")]
    rng.shuffle(docs)
    d = spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id long, text string, n int, item_id string").repartition(6)
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, score int").repartition(3)
    want = plain_search(docs, items)
    got = lambda: sorted([tuple(r) for r in search.search(d, i).collect()], key=str)
    assert got() == want
    monkeypatch.setattr(search, "BLOCK_ITEMS", 7)  # several blocks
    monkeypatch.setattr(search, "CELLS", 50)
    assert got() == want


def test_search_of_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(d, i).count() == 0 and search.search(i.toDF("doc_id", "text"), i.limit(0)).count() == 0
