"""Mixing, sharding and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisweep.llm import jaccard, mixing, shards, toxicity


def brute_targets(sizes, cycle=(5, 2, 1), share=1.5, most=2):
    """Share by weight, stop at the cap, share again what is over, until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return stopped | target
        stopped |= {s: most * sizes[s] for s in over}


def mix_docs(n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "Z", "é", None, "tiny" if i % 50 == 0 else "b"])
        rows.append((i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 3, 40, 300, 2000]))), s))
    return rows + [(900, None, "a"), (901, "", "empty source"), (None, "no key at all", "b"), (5, rows[5][1], rows[5][2])]


def test_mix_meets_its_targets(spark):
    rows = mix_docs()
    frame = spark.createDataFrame([(d, t, s, "x", 0) for d, t, s in rows], "doc_id long, text string, source string, taken string, n_chars long")
    mixed = mixing.mix(frame, block_words=32, shard_blocks=64)
    got = mixed.documents.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        s = r["doc"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 64 + 0.01 * t
    uses = mixed.uses.collect()
    assert sum(u["words"] for u in uses) == sum(taken.values())
    per_shard = Counter((u["shard"], u["slot"]) for u in uses)
    assert {s for s, _ in per_shard} == set(range(max(s for s, _ in per_shard) + 1))
    again = mixing.mix(frame.repartition(9), block_words=32, shard_blocks=64).documents.collect()
    key = lambda r: (str(r["doc"]["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))

    texts = mixing.mixed_texts(mixed).collect()
    words = Counter()
    for r in texts:
        assert r["n_chars"] == len(r["text"] or "")
        words[r["source"]] += len((r["text"] or "").split())
        assert set((r["text"] or "").split()) <= set(w for d, t, _ in rows if d == r["doc_id"] for w in (t or "").split())
    assert words == +taken
    blank = lambda found: Counter(str((d, t)) for d, t in found if not (t or "").split())
    assert blank((r["doc_id"], r["text"]) for r in texts) == blank((d, t) for d, t, _ in rows)


def test_taken_stretches_keep_their_white_space(spark):
    from types import SimpleNamespace

    text = "one\ttwo\n\nthree  four\nfive six  "
    docs = spark.createDataFrame([((1, text), 6, 1), ((2, None), 0, 2), ((3, " \n"), 0, 3)], "doc struct<doc_id: long, text: string>, size long, mix_row long")
    uses = spark.createDataFrame(
        [(1, 0, 0, 2), (1, 0, 2, 1), (1, 0, 4, 1), (1, 1, 0, 3), (1, 1, 3, 3), (1, 2, 5, 1)], "mix_row long, epoch int, first_word long, words long")
    got = sorted(str(r["text"]) for r in mixing.mixed_texts(SimpleNamespace(documents=docs, uses=uses)).collect())
    assert got == sorted(["one\ttwo\n\nthree\nfive", text, "six", "None", " \n"])


def test_mix_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    mixed = mixing.mix(frame)
    assert mixed.documents.count() == 0 and mixed.uses.count() == 0 and mixing.mixed_texts(mixed).count() == 0
    wordless = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], frame.schema)).documents.collect()
    assert sorted((r["doc"]["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in wordless) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_permutations_and_counts():
    for n in (1, 2, 3, 17, 1000):
        image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(image) == list(range(n))
    counts = np.array([700, 0, 333, 67])
    whole = {s: (own, before) for s, own, before in mixing.shard_counts(counts, 64, 3, 0, 99)}
    assert len(whole) == 18 and (sum(o for o, _ in whole.values()) == counts).all() and all(o.sum() == 64 for s, (o, _) in whole.items() if s < 17)
    run = np.zeros(4, int)
    for s in range(18):
        assert (whole[s][1] == run).all()
        run += whole[s][0]
    part = {s: own for s, own, _ in mixing.shard_counts(counts, 64, 3, 5, 9)}
    assert sorted(part) == [5, 6, 7, 8] and all((part[s] == whole[s][0]).all() for s in part)
    big = mixing.split_counts(np.array([3 * 10**9, 10**9]), 2 * 10**9, np.random.default_rng(1))
    assert big.sum() == 2 * 10**9 and abs(big[0] - 1.5e9) < 1e6


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(50)) for i in range(3000)] + [(5000, None), (None, "x"), (None, "y"), (7, "é"), (8, "same"), (8, "same")]
    frame = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, slot int, source string").repartition(6)
    got = shards.shard(frame, shards.layout(40)).collect()
    assert len(got) == len(rows)
    where = {}
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["source"]) == (len(data) + 16, zlib.crc32(data), "key", "s")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert where.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 40 < len(slots) < 120
    assert 30 < sum(r["grown_shard"] == 40 for r in got) < 130
    assert shards.shard(frame.limit(0), shards.layout(40)).count() == 0


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    keys = spark.range(4000)
    tree = shards.layout(40)
    heavier = [shards.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 13 else 1.0) for x in tree]
    a, b = shards.place(F.col("id"), tree), shards.place(F.col("id"), heavier)
    rows = keys.select(*[c.alias(f"{n}{i}") for i, t in enumerate((a, b)) for n, c in zip(("region", "rack", "shard"), t)]).collect()
    moved = [r for r in rows if r["shard0"] != r["shard1"]]
    assert moved and all(r["region1"] == 0 for r in moved if r["region0"] != r["region1"])
    assert all(r["rack1"] == 3 for r in moved if r["region0"] == r["region1"] and r["rack0"] != r["rack1"])
    assert all(r["shard1"] == 13 for r in moved if r["rack0"] == r["rack1"])
    share = sum(r["shard1"] == 13 for r in rows) / len(rows)
    assert 0.04 < share < 0.11  # 3 of 42
    with pytest.raises(ValueError):
        shards.place(F.col("id"), [shards.Leaf(0, 0, 0, 0.0)])


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    fresh = lambda n: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}{rng.randrange(99)}" for _ in range(n)]
    item = " ".join(fresh(25))
    docs, labels = [], []
    for i in range(240):
        w = fresh(rng.randrange(8, 120))
        toxic = i % 6 == 0
        if toxic:
            w[1:1] = ["moron", "moron"]
        if i % 10 == 1:
            w[3:3] = item.split()
        docs.append((i, " ".join(w), "en", "hot" if i % 3 else f"s{i % 4}", 0))
        labels.append((i, 0, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "copy", 0) for i in range(2, 40)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "hot", 0), docs[9]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__part", F.lit("clash"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    ids = lambda df: [r["doc_id"] for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    bad = {d for d, t, *_ in docs if "moron" in (t or "")}
    one = stages["toxicity"](spark, left, sf)
    assert sorted(ids(one)) == sorted(d for d, *_ in docs if d not in bad) and one.columns == left.columns
    two = stages["jaccard"](spark, one, sf)
    first = {}
    for d, t, *_ in sorted(docs):
        if d not in bad:
            first.setdefault(t or d, d)
    assert sorted(ids(two)) == sorted(first.values()) and two.columns == left.columns
    three = stages["decontaminate"](spark, two, sf)
    assert sorted(ids(three)) == sorted(d for t, d in first.items() if item not in str(t)) and three.columns == left.columns
    four = stages["mix"](spark, three, sf)
    counts = Counter(ids(four))
    assert set(counts) <= set(ids(three)) and max(counts.values()) <= 2 and four.columns == left.columns
    five = stages["shard"](spark, four, sf)
    assert sorted(ids(five)) == sorted(ids(four)) and {"shard", "slot"} <= set(five.columns)
    whole = corpus_pipeline.run(spark, sf)
    view = lambda df: sorted((r["doc_id"], r["text"], r["shard"]) for r in df.collect())
    assert view(whole) == view(five)
    assert jaccard and toxicity
