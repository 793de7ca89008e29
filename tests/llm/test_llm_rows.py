"""Operators that look at one row or a neighbour: archives, pages, toxicity, fingerprints, lines."""

import base64
import hashlib
import random
import time
import zlib

import pyarrow as pa
import pytest

from orbisweep.llm import fingerprints, lines, pages, toxicity, warc
from orbisweep.session import work_path

PAGES = [(3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, "ünï"), (4, "x\r\ny", None), (9, "u", ""), (None, "n", "<p>same</p>"),
         (1, "http://a/1", "<p>same</p>"), (7, "big", "0123456789" * 30_000), (8, "warc", "WARC/1.1\r\nWARC-Type: x\r\n\r\n")]


def pages_frame(spark):
    return spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, compress):
    path = work_path(spark, "warc-test")
    warc.write(pages_frame(spark), path, compress=compress)
    rows = warc.read(spark, path, payloads=True).collect()
    assert {r["kind"] for r in rows} == {"record"} and len(rows) == len(PAGES) and not [r for r in rows if r["reason"]]
    first = {}
    for p, _, h in PAGES:
        data = (h or "").encode()
        first[data] = min((x for x in (first.get(data), p) if x is not None), default=None)
    want = []
    seen = set()
    for p, _, h in sorted(PAGES, key=lambda x: (x[0] is None, x[0])):
        data = (h or "").encode()
        response = p == first[data] and data not in seen
        seen |= {data} if response else set()
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[data]))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in rows:
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["payload_digest"]
    assert warc.round_trip(pages_frame(spark).limit(0)).count() == 0


def archive(compress, n=20):
    out = []
    for i in range(n):
        data = f"payload {i} ".encode() * (i + 1)
        body = warc.record(i, 0, f"http://h/{i}", data, warc.base32_sha1(data), len(data), None, False, "2026-01-01T00:00:00Z") + b"\r\n\r\n"
        if compress:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            body = z.compress(body) + z.flush()
        out.append(body)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_every_whole_record(compress):
    rng = random.Random(1)
    for _ in range(60):
        parts = archive(compress)
        hurt = set(rng.sample(range(20), 3))
        for i in hurt:
            kind, p = rng.randrange(3), parts[i]
            at = rng.randrange(1, len(p) - 1)
            parts[i] = p[:at] if kind == 0 else p[:at] + bytes([p[at] ^ (1 << rng.randrange(8))]) + p[at + 1:] if kind == 1 else b"\x00garbage" + p[:at]
        data = b"".join(parts)
        found = list(warc.parse(data))
        ids = [warc.describe(f, False)["page_id"] for f in found if f["kind"] == "record"]
        left = iter(ids)  # a header has no checksum: a damaged record may still read well under another name
        assert all(i in left for i in range(20) if i not in hurt) and len(ids) <= 20
        spans = [(f["start"], f["end"]) for f in found]
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [f["kind"] for f in warc.parse(b"nothing here")] == ["gap"] and list(warc.parse(b"")) == []


def test_salvage_through_spark(spark, tmp_path):
    parts = archive(True)
    parts[4] = parts[4][:30]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(b"".join(archive(False, 3)))
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read(spark, str(tmp_path))
    assert warc.records(found).count() == 22
    gap = warc.gaps(found).collect()
    assert len(gap) == 1 and gap[0]["end"] - gap[0]["start"] == 30 and gap[0]["reason"].startswith("gzip")


LONG = "This paragraph, as one can see, is long enough to count, and it has commas, too."
CASES = [
    (f"<nav><a href=1>Menu, one, two</a></nav><article><h1>Head</h1><p>{LONG}<p>Short.<p>A&amp;B &lt;tag&gt;\n  spaced&nbsp;out<br>next</article><footer>{LONG}</footer>",
     f"Head\n{LONG}\nShort.\nA&B <tag> spaced out next"),
    (f"<div class='sidebar'><p>{LONG}</p></div><div id=main-text><h2>T</h2><p>{LONG}</p><p>x</p></div><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>", f"T\n{LONG}\nx"),
    (f"<body><header><h1>Site</h1></header><main><p>{LONG}</p><form><p>{LONG}</p></form><ul><li><a href=2>more links here</a></li></ul><ul><li>kept item</li></ul></main>", f"{LONG}\nkept item"),
    (f"<article><p>{LONG}</p><script>var x = '<p>no, no, no, no, no, no, no</p>';</script><style>p{{}}</style><!-- <p>hidden</p> --><aside>{LONG}</aside><p>end</article>", f"{LONG}\nend"),
    (f"<p hidden>{LONG}</p><p style='display: none'>{LONG}</p><div role=navigation>{LONG}</div><div><p>{LONG}</p></div>", LONG),
    (f"<div class=content><section><p>{LONG}</p></section><section><p>{LONG} Two.</p></section><section><p>Three.</p></section></div>", f"{LONG}\n{LONG} Two.\nThree."),
    ("just text, no markup", "just text, no markup"), ("", ""), (None, ""), ("<script>only()", ""), ("<p>a<p>b", "a\nb"), ("<<<>><p", "<<<>>"), ("</div></p>x &", "x &"),
]


def test_main_text(spark):
    for source, want in CASES:
        assert pages.main_text(source) == want, source
    frame = spark.createDataFrame([(i, "u", s, "old") for i, (s, _) in enumerate(CASES)] + [(0, "u", CASES[0][0], "old")], "page_id long, url string, html string, text string")
    rows = pages.extract(frame).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows) == sorted([(i, w, len(w)) for i, (_, w) in enumerate(CASES)] + [(0, CASES[0][1], len(CASES[0][1]))])
    assert pages.extract(frame.limit(0)).count() == 0


def test_main_text_below_misleading_names():
    body = "".join(f"<p>{LONG} {i}.</p>" for i in range(6))
    want = "\n".join(f"{LONG} {i}." for i in range(6))
    aside = f"<div class=comments><p>{LONG} No.</p></div><div class='related'><p>{LONG} No.</p></div>"
    for name in ("elementor-widget elementor-widget-theme-post-content", "entry-content related-layout", "with-sidebar", "hasSidebar", "widget"):
        inner = f"<div class='{name}'><div class='{name.split()[-1]}-container'>{body}</div></div>"
        assert pages.main_text(inner + aside.replace("related", "promo")) == want, name
        assert pages.main_text(f"<div><p>A line that is left elsewhere on the page.</p></div>{inner}") == want, name
        assert pages.main_text(f"<article><h1>Head</h1></article><div>{inner}</div>") == want, name
        assert pages.main_text(f"<div class='{name}'><div class=banner><h1>Head</h1></div><div class='{name}'>{body}</div></div>{aside}").endswith(want), name
    # names keep out what they name, though it is longer
    assert pages.main_text(f"<div class=ad>{LONG}</div><article><h1>Head</h1><p>Short.</p></article>") == "Head\nShort."
    replies = "".join(f"<div class='comment-body'><p>{LONG} {i}.</p></div>" for i in range(30))
    assert pages.main_text(f"<div><p>{LONG}</p></div><div class=post-comments>{replies}</div>") == LONG
    assert pages.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"


def test_main_text_keeps_lists_of_sources():
    link = "<a href=1>A. Author and B. Author: The title of a paper that is cited, Journal of Things</a>"
    says = "A. Author and B. Author: The title of a paper that is cited, Journal of Things"
    sources = f"<ol><li>{link}</li><li><a href=2>A report of the office</a>, 2021</li></ol><table><tr><td><a href=3>North</a></td><td>17</td></tr></table>"
    want = f"{LONG}\n{LONG}\n{says}\nA report of the office, 2021\nNorth\n17"
    menu = "<ul><li><a href=4>Home</a> &middot; </li><li><a href=5>Contact</a> | </li></ul>"
    assert pages.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p>{menu}{sources}</div>") == want
    assert pages.main_text(f"<body><div><p>{LONG}</p><ul><li><a href=4>Home base</a> &#20013;</li></ul></div>") == f"{LONG}\nHome base 中"
    assert pages.main_text(f"<article><p>{LONG}</p><p>{LONG}</p>{sources}<ul><li><a href=4>Reuters</a></li></ul></article>") == f"{want}\nReuters"


def test_main_text_beside_long_attributes():
    value = "<p>no, no, no > no, no</p>" * 1000
    for quote in "\"'":
        assert pages.main_text(f"<article><p data-x={quote}{value}{quote} class=a>{LONG}</p><p>end</p></article>") == f"{LONG}\nend"
    # a quote that stays open ends at the bracket, and many of them take no long time
    assert pages.main_text(f"<article><p class='a>{LONG}</p><p>end</p></article>") == f"{LONG}\nend"
    start = time.process_time()
    pages.main_text("<a '>' " * 30_000 + '"')
    pages.main_text("<a \"" * 100_001)
    assert time.process_time() - start < 20


def test_main_text_of_hostile_pages():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>"
    assert pages.main_text(deep) == LONG
    assert pages.main_text("<a b='" * 3000) is not None
    long = " ".join(f"word{i}," for i in range(100_000))
    assert pages.main_text(f"<article><p>{long}</p></article>") == long


def corpus(n=600, seed=3):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}{rng.choice('pqtvz')}" for _ in range(rng.randrange(5, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + len(w) // 60):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["moron", "scumbag", "grackle" + rng.choice(["s", "d", ""])]))
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    return docs, labels


def test_toxicity_generalises_and_sees_through_disguise(spark):
    docs, labels = corpus()
    extra = [(9001, "dana M0R0N lasup"), (9002, "dana mоrоn lasup"), (9003, "dana clown moron lasup"), (9004, None), (9005, ""), (9006, "dana lasup"), (None, "moron"), (0, docs[0][1])]
    frame = spark.createDataFrame([(d, t, 5.0) for d, t in docs + extra], "doc_id long, text string, score double")
    labelled = spark.createDataFrame([*labels, (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(frame, labelled)
    assert {" moron", " scumbag", " grackle"} == {e[:8] for e in lexicon.weights} | {" moron"} - set()
    rows = toxicity.scored(frame, lexicon).collect()
    truth = {d: y for d, _, y in labels}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is None:
            assert r["held_out"]
        else:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert (by[9001], by[9002], by[9003], by[9004], by[9005], by[9006]) == (1, 1, 1, 0, 0, 0)
    # labels of held-out rows change nothing
    flipped = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, q, y in labels]
    assert toxicity.learn(frame, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")) == lexicon
    assert toxicity.learn(frame, labelled.limit(0)).weights == {}
    assert toxicity.scored(frame.limit(0), lexicon).count() == 0


def test_exception_phrases_spare_their_words():
    matcher = toxicity.Matcher(toxicity.Lexicon({" clown": 5.0, " trash": 4.0}, ("clown fish",), 1.0, 0.0))
    assert matcher.strength("a clown fish swims") == 0 and matcher.strength("a clown swims") > 0
    assert matcher.strength("tr4sh, CLOWN fish") == pytest.approx(4 / 13 ** 0.5)
    assert matcher.strength("xclown") == 0 and matcher.strength("") == 0 and matcher.strength(None) == 0


def levenshtein_like(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    run = max((k for k in range(8) for i in range(len(a) - k + 1) if a[i:i + k] in b), default=0)
    need = min(7, max(1, min(len(a), len(b)) // 4))
    return 2 * table[-1][-1] / (len(a) + len(b)) if a and b and run >= need else 0.0


def test_signature_likeness_is_edit_distance():
    rng = random.Random(6)
    left = ["".join(rng.choice("ABCDEFGH") for _ in range(rng.randrange(65))) for _ in range(150)]
    right = [x[: len(x) // 2] + "".join(rng.choice("ABCDEFGH") for _ in range(rng.randrange(33))) for x in left]
    got = fingerprints.signature_likeness(left, right)
    assert [round(float(g), 9) for g in got] == [round(levenshtein_like(a, b), 9) for a, b in zip(left, right)]


def test_fingerprints_with_next(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aé", "bcd", "ef", "ghij", "k𝄞"]) + str(rng.randrange(50)) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(70, None), (71, ""), (72, "x"), (73, texts[0]), (-5, texts[1]), (10, "tie"), (None, "no key")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = {}
    prints = fingerprints.fingerprints(pa.array([t or "" for _, t in order]))
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        new = fingerprints.edited(t or "", after)
        k = len(t or "") // 4
        assert new == (t or "")[: len(t or "") - k] + after[:k]
        mark = fingerprints.fingerprints(pa.array([new]))
        want.setdefault(d, []).append((len(t or ""), hashlib.sha256(new.encode()).hexdigest(), prints[i], mark[0], float(fingerprints.likeness([prints[i]], mark)[0]),
                                       float(fingerprints.likeness([prints[i]], [prints[(i + 1) % len(order)]])[0])))
    for size in (4096, 5):  # one bucket, many buckets
        got = {}
        for r in fingerprints.with_next(frame, rows_per_bucket=size).collect():
            got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    long_ones = [w for v in want.values() for w in v if w[0] > 300]
    assert sum(w[4] > 0.5 for w in long_ones) > 0.9 * len(long_ones) and sum(w[5] > 0.5 for w in long_ones) < 0.1 * len(long_ones)
    assert fingerprints.with_next(frame.limit(0)).count() == 0
    assert [r["near_next"] for r in fingerprints.with_next(frame.where("doc_id = 3")).collect()] == [1.0]


def test_fingerprints_do_not_depend_on_pieces():
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.choice([0, 5, 300, 5000]))) for _ in range(40)] + ["ab" * 700_000]
    assert fingerprints.fingerprints(pa.array(texts)) == [fingerprints.fingerprints(pa.array([t]))[0] for t in texts]


def test_line_dedup(spark):
    rng = random.Random(7)
    wide, edge, local = "subscribe to our newsletter", "seen on exactly five sites", "only in four places, though"
    docs = []
    for i in range(200):
        body = [f"  own line number {rng.randrange(10**9)}" for _ in range(rng.randrange(4))]
        s = f"site{i % 20}" if i % 20 else None
        if i % 2:
            body.insert(0, " " + wide + "\t")
        if i % 20 < 5:
            body.append(edge)
        if i % 20 < 4:
            body += [local, "", "short"]
        docs.append((i, "\n".join(body), s))
    docs += [(300, None, "a"), (301, "", "b"), (302, wide, "c"), (1, docs[1][1], docs[1][2]), (None, wide + "\nrest of the text here", None)]
    frame = spark.createDataFrame([(d, t, s, 0) for d, t, s in docs], "doc_id long, text string, source string, n_lines int").repartition(6)
    sites = {}
    for _, t, s in docs:
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(" \t"), set()).add(s)
    gone = {x for x, s in sites.items() if len(s) >= 5 and len(x) >= 15}
    assert gone == {wide, edge}
    want = []
    for d, t, s in docs:
        old = t.split("\n") if t else []
        new = [x for x in old if x.strip(" \t") not in gone]
        want.append((d, t if len(new) == len(old) else "\n".join(new), s, len(old), len(old) - len(new)))
    got = [(r["doc_id"], r["text"], r["source"], r["n_lines"], r["n_removed"]) for r in lines.without_boilerplate(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.without_boilerplate(frame.limit(0)).count() == 0
