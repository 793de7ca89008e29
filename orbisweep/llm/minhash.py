"""Near-duplicate detection by MinHash bands with sequential Bayesian verification.

Sets are distinct word shingles; equal sets are one node. 32 bands of five MinHashes bring sets together: two sets at the
threshold of 80 percent share no band once in 300,000. Whether candidates are links is then settled step by step. Their signatures
(1,024 MinHashes of 16 bits) are compared a batch at a time; with m of h equal and an even prior, the similarity reaches
the threshold with probability P(Binomial(h + 1, t) <= m), and a pair is dropped once that is below `MISS`. What is left
after the last batch is confirmed on the full sets. So a link in a common band is lost only with the chosen probability, and no
false link is made.

A band's list is never opened into all its pairs of rows:

1. *Stars.* Every set of a list is compared with the list's first one. That joins most of each group of copies.
2. *Best first.* Sets in one list and in different groups are compared inside the task that holds the list, in numpy; only the
   likeliest partner of each set is handed on and confirmed. Repeated while most of these are links.
3. *Rest.* All pairs that still cross groups are compared in the same way, each in the first band it shares; those that the posterior
   does not rule out are confirmed.

Long lists are cut in parts; a task gets two parts and compares one with the other, so none holds a whole list.
Signatures and sets of full length are made only for sets that share a band with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, packed, unpacked
from .components import components
from .jaccard import _among, _node
from .texts import mixed, shingle_sets

BANDS, ROWS = 32, 5
HASHES, LOOKS = 1024, (32, 64, 128, 256, 512, 1024)
#: A pair is dropped once it is a link with less than this probability.
MISS = 1e-5
#: Sets a part of a list holds on average; pairs a task compares at a time.
PART, PAIRS = 512, 1 << 16
_rng = np.random.Generator(np.random.PCG64(20_011))
_FACTORS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_JOIN = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """`hashes` MinHashes of 16 bits for each of the (non-empty) sets of 64-bit hashes."""
    x = (np.concatenate(sets) >> np.uint64(17)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), hashes), np.uint16)
    for k in range(hashes):
        least = np.minimum.reduceat(x * _FACTORS[k] + _TERMS[k], starts)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)  # leading bits of a minimum are all alike
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Band keys, one column a band."""
    rows = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = (rows * _JOIN).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    return mixed(mixed(keys) + np.arange(BANDS, dtype=np.uint64))


def least_equal(looks: tuple[int, ...], percent: int, miss: float) -> list[int]:
    """For each number h of hashes compared, the least m equal ones that leave a probability of `miss` for a link."""
    t, out = percent / 100, []
    for h in looks:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += exp(lgamma(h + 2) - lgamma(m + 1) - lgamma(h + 2 - m) + m * log(t) + (h + 1 - m) * log(1 - t))
        out.append(m)
    return out


def likely(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (rows a of `left`, b of `right`) the looks do not rule out, and how many hashes they have in common."""
    kept, equal, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for h, least in zip(LOOKS, least_equal(LOOKS, percent, MISS), strict=True):
        equal = equal + (left[a[kept], done:h] == right[b[kept], done:h]).sum(axis=1, dtype=np.int32)
        passed = equal >= least
        kept, equal, done = kept[passed], equal[passed], h
    return kept, equal


def _rows_of(column: pa.Array, kind) -> np.ndarray:
    """A matrix from equally long binary values."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


DIGEST = "doc_id long, key long, n long, node long, bands array<long>"


def _digests(shingle: int):
    """Size and node of every row; the bands of a node once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            keys: list = [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []
            held = 0

            def flush():
                if waiting:
                    for (row, _), found in zip(waiting, bands(signatures([s for _, s in waiting], BANDS * ROWS)), strict=True):
                        keys[row] = found.view(np.int64)

            for row, found in shingle_sets(batch["text"], shingle):
                n[row], node[row] = len(found), _node(found)
                if len(found) and int(node[row]) not in seen:
                    seen.add(int(node[row]))
                    waiting.append((row, found))
                    held += len(found)
                    if held > 1 << 16:
                        flush()
                        waiting, held = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(n), pa.array(node.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "node", "bands"])

    return run


def _details(shingle: int):
    """Full signature and set of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = dict(shingle_sets(part["text"], shingle))
                rows = [r for r in sets if len(sets[r])]
                if rows:
                    signed = signatures([sets[r] for r in rows], HASHES)
                    yield pa.RecordBatch.from_arrays(
                        [part["node"].take(pa.array(rows)), pa.array([s.tobytes() for s in signed], pa.binary()),
                         pa.array([sets[r].tobytes() for r in rows], pa.binary())], ["node", "signature", "members"])

    return run


def _pruned(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.arange(batch.num_rows)
                kept, _ = likely(_rows_of(batch["signature_a"], np.uint16), _rows_of(batch["signature_b"], np.uint16), rows, rows, percent)
                yield batch.select(["a", "b"]).take(pa.array(kept))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["members_a"], batch["members_b"], strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _with(pairs: DataFrame, details: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of both their nodes."""
    for side in "ab":
        pairs = pairs.join(details.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def confirmed(pairs: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """The links among written pairs (a, b), from their full sets."""
    return materialize(_with(pairs, details, "members").mapInArrow(_confirmed(percent), "a long, b long"), "links")


CANDIDATE = "a long, b long, equal int"


def _crossing(percent: int, best: bool):
    """Over parts of lists, sorted: pairs of sets in different groups that the looks do not rule out.

    With `best`, of all partners of a set in its list only the likeliest, and only if it is about as likely a link as not.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _keys(batch)
            if held and tuple(_keys(held[-1])[:, -1]) == tuple(key[:, -1]):
                held.append(batch)  # one list part and nothing else
                continue
            last = int(np.flatnonzero((key != key[:, -1:]).any(axis=0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
            yield from _compared(pa.Table.from_batches([*held, batch.slice(0, last)]), percent, best)
            held = [batch.slice(last)]
        if held:
            yield from _compared(pa.Table.from_batches(held), percent, best)

    return run


def _keys(table) -> np.ndarray:
    return np.stack([table[c].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy() for c in ("list", "low", "high")])


def _compared(table: pa.Table, percent: int, best: bool) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    key = _keys(table)
    part, group, node = (table[c].to_numpy() for c in ("part", "component", "node"))
    signature = _rows_of(table["signature"].combine_chunks(), np.uint16)
    begins = np.ones(table.num_rows, bool)
    begins[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    number = np.cumsum(begins) - 1
    end = np.append(np.flatnonzero(begins)[1:], table.num_rows)[number]
    # partners of a row: the rows after it; of two different parts, each row of the lower with all of the higher
    one = key[1] == key[2]
    higher = np.bincount(number, weights=~one & (part == key[2])).astype(np.int64)[number]
    first = np.where(one, np.arange(table.num_rows) + 1, np.where(part == key[1], end - higher, end))
    own = bands(signature)
    totals = np.cumsum(end - first)
    lo, found = 0, []
    while lo < table.num_rows:
        base = int(totals[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(totals, base + PAIRS, side="right")))
        many = (end - first)[lo:hi]
        a = np.repeat(np.arange(lo, hi), many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[lo:hi], many)
        apart = group[a] != group[b]
        a, b = a[apart], b[apart]
        kept, equal = likely(signature, signature, a, b, percent)
        a, b = a[kept], b[kept]
        same = own[a] == own[b]
        here = key[0][a].view(np.uint64)
        mine = own[a, same.argmax(axis=1)] == here if len(a) else np.zeros(0, bool)  # the first band they share is this list
        found.append((a[mine], b[mine], equal[mine]))
        lo = hi
    a, b, equal = (np.concatenate(p) for p in zip(*found, strict=True))
    if best:
        even = equal >= percent / 100 * HASHES - HASHES**0.5 / 2
        a, b, equal = a[even], b[even], equal[even]
        keep = np.zeros(len(a), bool)
        for x, y in ((a, b), (b, a)):  # from either side
            order = np.lexsort((node[y], -equal, node[x]))
            new = np.ones(len(a), bool)
            new[1:] = node[x][order][1:] != node[x][order][:-1]
            keep[order[new]] = True
        a, b, equal = a[keep], b[keep], equal[keep]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(equal.astype(np.int32))], ["a", "b", "equal"])


def still_open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Of `lists` (list, node) those with sets of more than one group, with component and parts; sets in no group are their own."""
    known = lists.select("list", "node").join(groups, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
    sizes = known.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).where("x <> y")
    parts = F.ceil(F.col("rows") / F.lit(PART)).cast("int")
    return materialize(known.join(sizes.select("list", parts.alias("parts")), "list"), "open-lists")


def crossing(open_: DataFrame, details: DataFrame, percent: int, best: bool) -> DataFrame:
    """Likely pairs between groups (a, b, equal) in `open_` lists."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = open_.select("list", "node", "component", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "list", "node", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    full = dealt.join(details.select("node", "signature"), "node")
    sorted_ = full.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "part", "node")
    return sorted_.mapInArrow(_crossing(percent, best), CANDIDATE)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, component (a hash of one of its sets, null for empty sets), row_key (a hash of key and
    text).

    A text with fewer words than a shingle has one shingle of all of them; null, empty and wordless texts have an
    empty set, are linked with nothing and kept. Equal texts and repeated rows are linked, and every row whose doc_id is its
    component's smallest is kept. component_id is the smallest key reachable, null keys aside; rows reached by null keys only have
    none and are not kept. Texts are read whole, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"))
    digests = materialize(rows.mapInArrow(_digests(shingle), DIGEST), "digests")
    filled = digests.where("n > 0")
    entries = filled.where("bands IS NOT NULL").select(F.explode("bands").alias("list"), "node").distinct()
    several = entries.groupBy("list").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    lists = materialize(entries.join(several.select("list", "first"), "list"), "lists")

    wanted = lists.select("node").distinct()
    one = materialize(filled.select("node", "key").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")), "wanted")
    texts = rows.select("key", "text").where(_among(one)).join(one, "key").dropDuplicates(["key"])
    details = materialize(texts.select("node", "text").mapInArrow(_details(shingle), "node long, signature binary, members binary"), "details")

    pairs = lists.where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()
    stars = materialize(_with(pairs, details, "signature").mapInArrow(_pruned(percent), "a long, b long"), "stars")
    links = confirmed(stars, details, percent)
    discard(stars)
    groups = components(links)
    open_ = still_open(lists, groups)
    while True:
        found = materialize(crossing(open_, details, percent, best=True), "likely")
        both = found.union(found.select("b", "a", "equal"))  # of all lists the likeliest partner, from either side
        top = both.groupBy("a").agg(F.max(F.struct("equal", "b")).alias("m"))
        tried = materialize(top.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct(), "best")
        fresh = confirmed(tried, details, percent)
        compared, linked = tried.count(), fresh.count()
        discard(tried, found)
        if linked:
            links = links.union(fresh)
            groups = components(links)
            before, open_ = open_, still_open(open_, groups)
            discard(before)
        if 4 * linked <= compared:  # a round saves work only while most of its pairs are links
            break
    rest = materialize(crossing(open_, details, percent, best=False).select("a", "b"), "rest")
    last = confirmed(rest, details, percent)
    if not last.isEmpty():
        groups = components(links.union(last))

    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("least")).join(groups, "node", "left").select(
        "node", "least", F.coalesce("component", "node").alias("component"))
    named = materialize(nodes, "nodes")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component", "component_id")
    discard(lists, open_, details, rest, one)
    some = filled.select("doc_id", "key", "n", "node").join(by_node, "node").select("doc_id", "n", "component_id", "component", "key")
    none = digests.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "key")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) | (F.col("n") == 0)
    return some.union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "component", F.col("key").alias("row_key"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component, that of the smallest key (null keys last); of repeated rows one. Rows without
    words all stay."""
    found = join(docs, key, text, **options).where("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("m")).select(F.col("m.row_key").alias("__row_key"))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(packed(docs).alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("__row_key"), wordless.alias("wordless"))
    kept = keyed.where("NOT wordless").join(first, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return kept.select(*unpacked(kept, "doc")).union(docs.where(wordless))
