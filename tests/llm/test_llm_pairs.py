"""Jaccard join, decontamination and license scan against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from orbisweep.llm import components, decontaminate, jaccard, licenses, seeds

SCHEMA = "doc_id long, text string, component string"  # `component` clashes with an inner name


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def collection():
    rng, rows = random.Random(5), []
    base = words(rng, 120)
    for i in range(60):  # a large group of near copies, chained by drifting edits
        base = list(base)
        base[rng.randrange(len(base))] = f"x{i}"
        rows.append((i, " ".join(base)))
    shared = words(rng, 60)
    for i in range(60, 110):  # a passage that many texts share, most of it boilerplate
        rows.append((i, " ".join(shared + words(rng, rng.choice([4, 12, 18, 25, 60])))))
    for i in range(110, 160):  # exact copies
        rows.append((i, " ".join(shared[:30])))
    for i in range(160, 200):  # near the threshold
        own = list(shared[:40])
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(40)] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "One  TWO"), (205, "ÉA b c d e f"), (206, "éa b c d e f"),
             (207, "a b c d e"), (208, "a b c d e a b c d e"), (None, "null key alone here now"), (None, " ".join(shared[:30])), (160, rows[160][1])]
    rng.shuffle(rows)
    return rows


def test_jaccard_is_exact_and_keeps_one_of_each(spark):
    rows = collection()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(7)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()]
    want = brute_components(rows)
    assert sorted(got, key=str) == want
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    least = {c for _, n, c in want if n and c is not None}
    assert sorted(i for i in ids if i is not None) == sorted(least | {200, 201, 202}) and ids.count(None) == 1


def test_jaccard_of_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    one = jaccard.join(spark.createDataFrame([(7, "a", "")], SCHEMA)).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in one] == [(7, 1, 7)]


def test_bitmaps_never_rule_out_a_shared_element():
    rng = np.random.default_rng(5)
    for n_a, n_b, common in ((1, 1, 1), (3, 70, 3), (40, 300, 20), (900, 1100, 0), (4500, 4700, 4000), (4500, 5000, 30)):
        found = rng.integers(0, 1 << 63, n_a + n_b - common, dtype=np.uint64)
        a, b = found[:n_a], found[n_a - common:]
        most = jaccard._most_shared(jaccard._bits(a), n_a, jaccard._bits(b), n_b)
        assert common <= most <= min(n_a, n_b)
        assert common * 5 > n_a or most < jaccard.need(n_a, n_b, 75)  # whatever the size


def test_long_texts_with_a_common_passage_are_not_fetched(spark, monkeypatch):
    rng, fetched, listed = random.Random(9), [], []
    texts = [words(rng, 3000, 9000) for _ in range(12)]
    for a in range(12):  # each two share a passage of their own
        for b in range(a):
            passage = words(rng, 40, 9000)
            texts[a], texts[b] = texts[a] + passage, texts[b] + passage
    near = texts[0][:2500] + words(rng, 60, 9000) + texts[0][2560:]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, near])], "doc_id long, text string")
    compare, materialize = jaccard.compare, jaccard.materialize

    def counted(pairs, *more):
        fetched.append(pairs.count())
        return compare(pairs, *more)

    def noted(df, label):
        if label == "centres-met":
            listed.extend(tuple(r) for r in df.collect())
        return materialize(df, label)

    monkeypatch.setattr(jaccard, "compare", counted)
    monkeypatch.setattr(jaccard, "materialize", noted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == {i: i for i in range(12)} | {12: 0}
    assert len(listed) > 10  # lists do hold them
    assert sum(fetched) <= 3


def test_near_copies_of_two_groups_meet_in_one_list(spark, monkeypatch):
    """Texts too far apart for a link share most lists: a pair of centres is met in the first and passed over in the others."""
    rng, rows = random.Random(4), []
    for n in range(18):  # six texts, each in three versions; a replaced word breaks five shingles
        base = words(rng, 400, 9000) if n % 3 == 0 else base
        at = rng.sample(range(0, 400, 5), 10)
        rows.append((n, " ".join(f"x{n}" if i in at else w for i, w in enumerate(base))))
    met = []
    distinct = DataFrame.distinct
    monkeypatch.setattr(DataFrame, "distinct", lambda df: (met.append(df.count()) if df.columns == ["centre_x", "centre_z"] else None) or distinct(df))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(rows)
    assert 0 < met[0] <= 3 * 18  # of 18 pairs, which share some 40 lists each


def test_a_set_whose_centre_has_a_centre_of_its_own_is_compared(spark):
    """x has centre y, y has centre w; z is like x only. The family of y is x alone, that of z is z alone."""
    rng = random.Random(8)
    w = words(rng, 204, 9000)
    edit = lambda base, mark, at: [f"{mark}{i}" if i in at else v for i, v in enumerate(base)]
    y = edit(w, "y", range(3, 20, 8))
    x = edit(y, "x", range(33, 64, 8))
    z = edit(x, "z", range(83, 114, 8))
    sets = [{hash(s) & (1 << 60) - 1 for s in shingles(" ".join(t))} for t in (w, y, x, z)]
    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert similar(sets[2], sets[3]) and not similar(sets[1], sets[3])
    order = lambda s: sorted(s)[: len(s) - -(-75 * len(s) // 100) + 1]
    listed = spark.createDataFrame([(t, len(s), i, n) for n, s in enumerate(sets) for i, t in enumerate(order(s))], "token long, size int, pos int, node long")
    beyond = lambda a, b: len(sets[a] - sets[b])
    groups = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, beyond(1, 0)), (2, 0, 1, beyond(2, 1))], "node long, component long, centre long, beyond long")
    answers = spark.createDataFrame([(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b in ((1, 0), (2, 1))],
                                    "a long, b long, size_a long, size_b long, common long")
    rows = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate((w, y, x, z))], "key long, text string")
    maps = spark.createDataFrame([(n, len(s), jaccard._bits(np.array(sorted(s), np.uint64))) for n, s in enumerate(sets)], "node long, n long, bits binary")
    found = jaccard.crossing(listed, groups, answers, rows.select(F.col("key").alias("node"), "key"), maps, rows, 5, 75).collect()
    assert (2, 3) in [tuple(r) for r in found]


def test_stars_do_not_depend_on_batches(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(6), 0, rng.choice([40, 42, 60]), rng.randrange(9), rng.randrange(50)) for _ in range(300))
    columns = ["token", "salt", "size", "pos", "node"]

    def run(size):
        batches = [pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows[lo:lo + size]], pa.int64() if c in ("token", "node") else pa.int32())
                                               for i, c in enumerate(columns)}) for lo in range(0, len(rows), size)]
        out = [r for b in jaccard._stars(75, False)(iter(batches)) for r in b.to_pylist()]
        return sorted({(r["kind"], r["token"], r["node"]) for r in out if r["kind"] != jaccard.CENTRE})

    whole = run(1000)
    assert all(run(n)[: len(whole)] and {x for x in run(n) if x[0] == 0} == {x for x in whole if x[0] == 0} for n in (1, 2, 7, 50))
    assert np.array(whole).size


@pytest.mark.parametrize("combine", [False, True])
def test_components_of_chains_and_rings(spark, monkeypatch, combine):
    rng = random.Random(3)
    monkeypatch.setattr(components, "EDGES", 16)  # so that combined edges lie in several tasks
    names = [rng.getrandbits(60) for _ in range(90)]
    edges = [(names[i], names[i + 1]) for i in range(59)] + [(names[i], names[60 + (i + 1 - 60) % 30]) for i in range(60, 90)] + [(names[0], names[0])]
    given = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(given, combine).collect()}
    assert len({got[n] for n in names[:60]}) == 1 and len({got[n] for n in names[60:]}) == 1 and len(set(got.values())) == 2
    assert components.components(given.where("a = b"), combine).count() == 0


def test_combined_edges_connect_what_the_edges_connect(monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]

    def labels(pairs):
        label = {n: n for e in edges for n in e}
        for _ in range(len(label)):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    for size, most in ((250, 1000), (40, 60), (1, 1)):
        monkeypatch.setattr(components, "EDGES", most)
        batches = (pa.RecordBatch.from_pydict({c: pa.array([e[i] for e in edges[lo:lo + size]], pa.int64()) for i, c in enumerate("ab")}) for lo in range(0, 250, size))
        stars = [(r["a"], r["b"]) for b in components._combined(batches) for r in b.to_pylist()]
        assert labels(stars) == labels(edges)


def norm(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_overlap(doc, item, least_score=7, least_matched=8):
    best = 0
    for shift in range(-len(item), len(doc)):
        run = matched = 0
        for j, w in enumerate(item):
            equal = 0 <= j + shift < len(doc) and doc[j + shift] == w
            if run == 0:
                matched = 0
            run = max(0, run + (1 if equal else -1))
            matched = matched + equal if run else 0
            if run >= least_score and matched >= least_matched:
                best = max(best, run)
    return best


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.choice([8, 15, 20, 40])))) for i in range(12)] + [(90, None), (91, ""), (92, "too short an item"), (93, None)]
    items.append((94, items[0][1]))
    docs = []
    for d in range(80):
        own = words(rng, rng.randrange(5, 90))
        if d % 2:
            taken = norm(items[d % 12][1])
            for _ in range(min(3, len(taken) // 6)):
                taken[rng.randrange(len(taken))] = "subst"
            at = rng.randrange(len(own) + 1)
            own[at:at] = taken
        docs.append((d, ", ".join(own).upper() if d % 3 else " ".join(own)))
    docs += [(100, None), (101, ""), (102, "..."), (None, items[3][1]), (7, docs[7][1])]
    want = {(d, i) for d, t in docs for i, s in items if brute_overlap(norm(t), norm(s))}
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, seed string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(frame, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert len([r for r in found if r["doc_id"] == 7]) == 2 * len([x for x in want if x[0] == 7])  # the repeated row counts on its own
    for r in found:
        if r["item_words"] == r["matched"]:
            text = norm(dict(docs)[r["doc_id"]])
            assert text[r["first_word"]: r["last_word"] + 1] == norm(dict(items)[r["item_id"]])
    hit = {d for d, _ in want}
    left = decontaminate.clean(frame, tests)
    assert left.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in hit)
    assert decontaminate.overlaps(frame.limit(0), tests).count() == 0
    assert decontaminate.clean(frame, tests.limit(0)).count() == len(docs)


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_test_sets_are_not_broadcast(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 1)
        monkeypatch.setattr(licenses, "BROADCAST_BANDS", 1)
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r[0], r[1]) for r in decontaminate.overlaps(docs, spark.createDataFrame([(5, text)], "item_id long, text string")).select("doc_id", "item_id").collect()] == [(1, 5)]
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(docs, licenses.templates(spark)).collect()] == [(2, "MIT line")]


def test_scripts_without_spaces(spark):
    zh, ja, th = "太阳系中最大的行星是哪一颗它有多少颗卫星", "光合成によって植物は何をつくりだしますか", "ดาวเคราะห์ดวงใดใหญ่ที่สุดในระบบสุริยะ"
    items = spark.createDataFrame([(1, zh), (2, ja), (3, th)], "item_id long, text string")
    docs = [(1, "前文很长。" + zh.replace("多少", "几多") + "后文也在这里。"), (2, "前の文" + ja + "後の文です。"), (3, "ก่อน" + th + "หลัง"), (4, "今天天气很好我们去公园散步"),
            (5, "plain words of a text that holds none of the items in it")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(frame, items).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame, items).collect()) == [4, 5]
    notice = licenses.templates(spark, {"zh": "版权所有"})
    assert [r["doc_id"] for r in licenses.scan(spark.createDataFrame([(1, "本站内容版权所有不得转载"), (2, "没有")], "doc_id long, text string"), notice).collect()] == [1]
    texts = spark.createDataFrame([("Latin wörter, 2 of 3 e\u0301t\u00e9", 6), ("ラーメン abc中文 x", 8), ("ที่นี่", 2)], "text string, n int")
    assert all(len(r["h"]) == r["n"] for r in texts.select("n", seeds.word_hashes(F.col("text")).alias("h")).collect())


def test_license_scan_finds_the_bare_notice_line(spark):
    docs = spark.createDataFrame(
        [(1, "some text\nAll rights reserved.\nmore text"), (2, "ALL RIGHTS RESERVED"), (3, "some rights reserved."), (4, "all rights are reserved")], "doc_id long, text string")
    got = [(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(docs, licenses.templates(spark)).collect()]
    assert sorted(got) == [(1, "All rights reserved line", 1.0), (2, "All rights reserved line", 1.0)]


def test_license_scan(spark):
    rng, docs, planted = random.Random(4), [], set()
    names = sorted(licenses.TEMPLATES)
    for d in range(60):
        own, name = words(rng, rng.randrange(0, 700)), names[d % len(names)]
        if d % 4:
            text = norm(licenses.TEMPLATES[name])
            if len(text) > 60:
                for _ in range(2):
                    text[rng.randrange(len(text))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = text
            planted.add((d, name))
        docs.append((d, "\n".join(" ".join(own[i:i + 9]) for i in range(0, len(own), 9))))
    docs += [(100, None), (101, ""), (102, "two words"), (103, "released UNDER the mit licence"), (None, "Licensed under CC BY-NC 4.0."), (104, "Licensed under CC BY-NC 4.0.\n" * 50)]
    planted |= {(None, "CC-BY-NC-4.0 line"), (104, "CC-BY-NC-4.0 line")}
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, width int")
    found = licenses.scan(frame, licenses.templates(spark)).collect()
    got = {(r["doc_id"], r["license"]) for r in found}
    assert planted <= got

    def three(text):
        w = norm(text)
        return [tuple(w[i:i + 3]) for i in range(len(w) - 2)]

    texts = dict(docs)
    for d, name in got - planted:  # what else was found is there: other templates contain it or share most of it
        own, want = set(three(texts[d])), set(three(licenses.TEMPLATES[name]))
        assert len(own & want) >= 0.75 * len(want)
    assert not any(d in (100, 101, 102, 103) for d, _ in got)
    assert {d for d, _ in got} == {d for d, _ in planted}
    assert licenses.scan(frame.limit(0), licenses.templates(spark)).count() == 0
    assert licenses.scan(frame, licenses.templates(spark).limit(0)).count() == 0
    assert found[0]["first_word"] <= found[0]["last_word"] and F is not None


def test_a_bare_line_is_found_wherever_it_stands(spark):
    rng = random.Random(12)
    other = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"All rights reserved. {other(60)}" for _ in range(700)] + [f"{other(30)} All rights reserved. {other(30)}" for _ in range(700)]
    texts += [f"{other(60)} All rights reserved." for _ in range(700)] + [other(60) for _ in range(50)] + ["All rights reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = licenses.scan(docs, licenses.templates(spark))
    assert {r["doc_id"] for r in found.collect()} == {i for i, t in enumerate(texts) if "rights" in t}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_short_items_are_found_word_for_word(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    rng = random.Random(6)
    items = [(n, " ".join(words(rng, n, 10**6))) for n in range(1, 8)] + [(1, "zz"), (None, "null id item"), (9, None), (10, "")]
    texts = [(n, " ".join(words(rng, 20, 10**6) + t.split() + words(rng, 5, 10**6) + t.split())) for n, t in items[:7]]
    changed = [(100 + n, " ".join(words(rng, 20, 10**6) + t.split()[:-1] + ["other"])) for n, t in items[1:7]]
    rows = texts + changed + [(200, "Null, id: ITEM"), (201, None), (202, "zz"), (202, "zz"), (203, " ".join(words(rng, 20_000, 10**6) + ["zz"]))]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, pos int, seed int").repartition(4)
    got = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    seen = sorted((r["doc_id"], r["item_id"], r["first_word"], r["last_word"], r["matched"], r["substituted"]) for r in got.where("item_id IS NOT NULL").collect())
    want = [(n, n, 20, 19 + n, n, 0) for n in range(1, 8)] + [(202, 1, 0, 0, 1, 0)] * 2 + [(203, 1, 20_000, 20_000, 1, 0)]
    assert seen == sorted(want)
    assert [(r["doc_id"], r["matched"]) for r in got.where("item_id IS NULL").collect()] == [(200, 3)]


def _passages(spark):
    rng = random.Random(31)
    items = [(i, " ".join(words(rng, rng.randrange(8, 30), 400))) for i in range(40)]
    items += [(100, items[3][1]), (100, items[3][1]), (None, items[3][1]), (101, items[5][1].upper()), (102, "zz yy"), (103, None)]
    docs = []
    for d in range(60):
        own = words(rng, rng.randrange(5, 60), 400)
        own[len(own) // 2: len(own) // 2] = items[d % 40][1].split()
        docs.append((d, " ".join(own), 1))
    docs += [(3, docs[3][1], 2), (None, docs[4][1], 3), (None, docs[4][1], 3), (70, None, 4), (71, " ".join(words(rng, 3000, 10**6)) + " " + items[7][1] + " zz yy", 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, shift int").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_large_and_small_test_sets_give_the_same_passages(spark, monkeypatch):
    docs, items = _passages(spark)
    rows = lambda: sorted((tuple(r) for r in decontaminate.overlaps(docs, items).collect()), key=repr)
    few = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert rows() == few and len(few) > 70
    monkeypatch.setattr(decontaminate, "BITMAP_WORDS", 1)  # a full bitmap
    assert rows() == few
    assert {r[1] for r in few if r[0] == 3} >= {3, 100, None}  # items of equal text each on their own


def test_no_words_of_a_text_are_shuffled_for_its_positions(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    docs, items = _passages(spark)
    frames, write = [], type(docs.write).parquet

    def parquet(self, *a, **k):
        frames.append(self._df)
        return write(self, *a, **k)

    monkeypatch.setattr(type(docs.write), "parquet", parquet)
    frames.append(decontaminate.overlaps(docs, items))
    dealt = []
    for frame in frames:
        steps = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted").split("\n\n")
        dealt += [x for x in steps if ") Exchange" in x]
    assert any("seed#" in x for x in dealt)
    assert not [x for x in dealt if "dw#" in x]
