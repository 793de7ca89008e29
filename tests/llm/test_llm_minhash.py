"""MinHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from orbisweep.llm import minhash

SCHEMA = "doc_id long, text string, component string, list int"  # names that the operator uses inside


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)), not s or (d is not None and d == least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def collection(seed):
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(150)]
    for i in range(120):  # near copies of one text at all distances around the threshold
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(150)] = word()
        rows.append((i, " ".join(own)))
    drift = [word() for _ in range(80)]
    for i in range(120, 180):  # a chain
        drift = list(drift)
        drift[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(drift)))
    for i in range(180, 230):  # short texts
        rows.append((i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))))
    rows += [(230 + i, rows[3][1]) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "One two"), (304, "one  TWO"), (305, "É a b c d"), (306, "é a b c d"), (None, rows[3][1]),
             (None, "only null keys hold this text here"), (None, "only null keys hold this text here"), (None, None), rows[10], rows[10]]
    long_ = [word() for _ in range(60_000)]
    rows += [(400, " ".join(long_)), (401, " ".join(long_[:30_000] + ["other"] * 40 + long_[30_000:]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [minhash.PART, 7])
def test_links_are_exact_on_full_sets(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "PART", part)  # 7: lists are cut in many parts
    rows = collection(part)
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], SCHEMA).repartition(5)
    got = minhash.join(docs)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == brute(rows)
    if part == 7:
        left = minhash.without_near_duplicates(docs)
        assert left.columns == docs.columns
        want = {d for d, n, _, k in brute(rows) if k and n} | {300, 301, 302}
        ids = [r["doc_id"] for r in left.collect()]
        assert {i for i in ids if i is not None} == want and len(ids) == len(want) + 2  # one of the null keys' text, one without words


def test_empty_table(spark):
    assert minhash.join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert minhash.join(spark.createDataFrame([(1, None, "", 1)], SCHEMA)).collect()[0]["kept"]


def test_bounds_lose_links_with_the_chosen_probability():
    rng = np.random.default_rng(4)
    least = minhash.least_equal(minhash.LOOKS, 80, minhash.MISS)
    assert least == sorted(least) and least[-1] > 0.74 * minhash.HASHES
    runs = rng.random((20_000, minhash.HASHES)) < 0.8
    passed = np.all([runs[:, :h].sum(axis=1) >= m for h, m in zip(minhash.LOOKS, least)], axis=0)
    assert (~passed).mean() < 3e-4
    far = rng.random((5_000, minhash.HASHES)) < 0.6
    assert not np.any(np.all([far[:, :h].sum(axis=1) >= m for h, m in zip(minhash.LOOKS, least)], axis=0))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    s = minhash.signatures([np.sort(a), np.sort(b)], 512)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.07
