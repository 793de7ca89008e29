"""Exact n-gram Jaccard self-join with set-relation skipping.

Sets are distinct word shingles as 64-bit hashes. Equal sets become one node. All shingles get one global order: by how
frequent their hash bucket is in the whole corpus (a fixed-size count sketch), then by hash. Two sets over the
threshold share one of the first floor(n/4)+1 shingles (at 75 percent) of each, so an index of these finds all pairs.

*Index level.* The list of a shingle is sorted by set size and position. Whether two entries can belong to similar
sets depends on their sizes and positions alone, so a whole block of equal (size, position) is taken or skipped
at once, and only entries whose position leaves room as the smaller set can open a block for others.

*Answer level.* No list produces all its pairs. First every entry is compared only with the first entry before
it that may be similar, its centre (`stars`). The exact answers give groups. A pair inside a group needs no answer: it is connected
already. For a pair across groups the answer follows from that of the centres: the overlap of x and z is
at most that of their centres plus what x and z have beyond them. So lists meet by centre, two centres in the first list they share
and not in the many that near copies share; bitmaps of the sets, as long as the sets ask for, rule out most pairs before texts are
fetched, the centres' answers rule out whole families, a set's answer for the other family's centre most of the rest. Only pairs that
all this leaves open are compared (`crossing`).

Components are exact: every pair over the threshold is either compared or within one group. Lists of frequent shingles are
salted, their centres meet in a second round; joins are by key and can be split where keys are hot. Sets are
never shipped, only texts of documents in a pair to compare; a bitmap of fixed size keeps most others from being shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialize, packed, unpacked
from .components import components
from .texts import mixed, shingle_sets

BUCKET_BITS, BLOCK = 20, 4096
LEVEL_BITS, UNSALTED = 4, 3
#: Bits of a set's bitmap for each element, at least: a long set fills none and a short one costs little.
BITS_EACH = 2
#: Entries of a centre before one of its own among which a list that two centres meet in earlier is looked for.
BEFORE = 3


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(found: np.ndarray) -> np.uint64:
    """A hash of a set of shingles; 0 for the empty set."""
    if not len(found):
        return np.uint64(0)
    both = np.array([found.sum(dtype=np.uint64), np.bitwise_xor.reduce(found)]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(len(found))
    return mixed(both ^ np.array([0, 1], np.uint64)).sum(dtype=np.uint64)


def _bits(found: np.ndarray) -> bytes:
    """A set as a bitmap: an element that another set's bitmap lacks is no element of that set. Lengths are powers of two, so that a
    longer bitmap folds onto a shorter one."""
    marks = np.zeros(max(64, 1 << (BITS_EACH * len(found) - 1).bit_length()), bool)
    marks[(found >> np.uint64(16)) % np.uint64(len(marks))] = True
    return np.packbits(marks).tobytes()


def _most_shared(bits_a: bytes, n_a: int, bits_b: bytes, n_b: int) -> int:
    """The most elements that two sets of n_a and n_b elements with these bitmaps can share."""
    if len(bits_a) < len(bits_b):
        bits_a, n_a, bits_b, n_b = bits_b, n_b, bits_a, n_a
    a, b = (np.frombuffer(x, np.uint64) for x in (bits_a, bits_b))
    a = a.reshape(-1, len(b))
    lacks_a, lacks_b = np.bitwise_count(a & ~b).sum(), np.bitwise_count(b & ~np.bitwise_or.reduce(a, axis=0)).sum()
    return int(min(n_a - lacks_a, n_b - lacks_b))


DIGEST = "doc_id long, key long, n long, node long, bits binary, block int, counts binary"


def _digests(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held, seen = np.zeros(1 << BUCKET_BITS, np.int64), [], 0, set()
        for batch in batches:
            sizes, nodes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            bits: list = [None] * batch.num_rows  # once a task for equal sets
            for row, found in shingle_sets(batch["text"], shingle):
                sizes[row], nodes[row] = len(found), _node(found)
                if len(found) and int(nodes[row]) not in seen:
                    seen.add(int(nodes[row]))
                    bits[row] = _bits(found)
                waiting.append(found >> np.uint64(64 - BUCKET_BITS))
                held += len(found)
                if held > 1 << 20:
                    counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts))
                    waiting, held = [], 0
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(sizes), pa.array(_signed(nodes)), pa.array(bits, pa.binary()), *none],
                ["doc_id", "key", "n", "node", "bits", "block", "counts"])
        if waiting:
            counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts))
        blocks = np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1))
        empty = pa.nulls(len(blocks), pa.int64())
        if len(blocks):
            packed = [zlib.compress(counts[b * BLOCK: (b + 1) * BLOCK].astype(np.int32).tobytes(), 1) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [empty, empty, empty, empty, pa.nulls(len(blocks), pa.binary()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())],
                ["doc_id", "key", "n", "node", "bits", "block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.int32)
            sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())})


def frequency_levels(digests: DataFrame) -> np.ndarray:
    """For each bucket of shingle hashes 0, or how far it is above the middle bucket: 1 from four standard deviations of a
    bucket of rare shingles, one more for each doubling.

    All counts are summed; what comes to the driver has a fixed size (2^20 counters).
    """
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in digests.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_summed, "block int, counts binary").collect():
        counts[r["block"] * BLOCK: (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    usual = max(1.0, float(np.median(counts)))
    above = (counts - usual) / (4 * usual ** 0.5)
    return np.clip(np.floor(np.log2(np.maximum(above, 0.5))) + 1, 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)


def need(a, b, percent: int):
    """The least overlap of sets of a and b elements whose Jaccard similarity reaches percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def _entries(levels: bytes, shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(levels), np.uint8).astype(np.uint64)
        seen: set[int] = set()
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for _, found in shingle_sets(batch["text"], shingle):
                if not len(found) or (node := int(_node(found))) in seen:
                    continue
                seen.add(node)
                n = len(found)
                order = (level[found >> np.uint64(64 - BUCKET_BITS)] << np.uint64(64 - LEVEL_BITS)) | (found >> np.uint64(LEVEL_BITS))
                order.sort()
                first = order[: n - -(-percent * n // 100) + 1]
                # a list of level 4, 5, ... has 2, 4, ... parts, chosen by the set
                parts_of = np.maximum(first >> np.uint64(64 - LEVEL_BITS), np.uint64(UNSALTED)) - np.uint64(UNSALTED)
                salt = np.uint64(node) & ((np.uint64(1) << parts_of) - np.uint64(1))
                parts.append((first, salt, node, n))
                held += len(first)
                if held > 200_000:
                    yield _entry_batch(parts)
                    parts, held = [], 0
        if parts:
            yield _entry_batch(parts)

    return run


def _entry_batch(parts: list[tuple]) -> pa.RecordBatch:
    lengths = np.array([len(p[0]) for p in parts])
    pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return pa.RecordBatch.from_pydict({
        "token": _signed(np.concatenate([p[0] for p in parts])), "salt": np.concatenate([p[1] for p in parts]).astype(np.int32),
        "size": np.repeat(np.array([p[3] for p in parts], np.int32), lengths), "pos": pos.astype(np.int32),
        "node": _signed(np.repeat(np.array([p[2] for p in parts], np.uint64), lengths)),
    })


ENTRY = "token long, salt int, size int, pos int, node long"
FOUND = "kind int, token long, size int, pos int, node long, centre long"
LISTED, LINK, CENTRE = 0, 1, 2


def _fits(size_a, pos_a, size_b, pos_b, percent: int):
    """Whether sets with their first common shingle at these positions can be similar."""
    return 1 + np.minimum(size_a - pos_a - 1, size_b - pos_b - 1) >= need(size_a, size_b, percent)


def _stars(percent: int, last: bool):
    """Over entries sorted by list, size and position: what to keep of the lists, and each entry's centre.

    Work goes batch by batch; of a list that goes on in the next batch only its centres and whether
    its first entry is kept are remembered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, centres, pending = None, [], None  # centres: (size, pos, node)
        for batch in batches:
            token, salt, size, pos, node = (batch[c].to_numpy(zero_copy_only=False) for c in ("token", "salt", "size", "pos", "node"))
            if not len(token):
                continue
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            again = np.zeros(len(token), bool)
            again[1:] = same[1:] & (node[1:] == node[:-1])
            if key_now == (token[0], salt[0]) and pending is not None and pending[4] == node[0]:
                again[0] = True
            keep = np.flatnonzero(~again)
            prior = pending
            key_now_next = (token[-1], salt[-1])
            if not len(keep):
                continue
            token, salt, size, pos, node = token[keep], salt[keep], size[keep], pos[keep], node[keep]
            goes_on = key_now == (token[0], salt[0])
            start = np.ones(len(token), bool)
            start[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(start) - 1
            members = np.bincount(group)
            if goes_on:
                members[0] += 1
            shared = members[group] > 1
            salted = (token.view(np.uint64) >> np.uint64(64 - LEVEL_BITS)) > UNSALTED
            open_group = len(members) - 1
            out = []
            if not last:
                listed = shared | salted
                # the last entry waits for the next batch if nothing before it shares its list
                listed[-1] |= bool(members[open_group] > 1)
                wait_last = not listed[-1]
                if goes_on and prior is not None and prior[5]:
                    out.append((LISTED, token[:1], np.array([prior[1]]), np.array([prior[2]]), np.array([prior[4]]), np.array([0])))
                out.append((LISTED, token[listed], size[listed], pos[listed], node[listed], np.zeros(listed.sum(), np.int64)))
            else:
                wait_last = False
            able = 1 + (size - pos - 1) >= need(size, size, percent)
            rest = np.flatnonzero(shared | salted | (group == open_group))
            if not goes_on:
                centres = []
            mine: list[tuple] = list(centres)
            for c in mine:  # a list that began in an earlier batch
                sel = rest[group[rest] == 0]
                ok = sel[_fits(c[0], c[1], size[sel], pos[sel], percent)]
                if len(ok):
                    out.append((LINK, token[ok], size[ok], pos[ok], node[ok], np.full(len(ok), c[2])))
                    rest = rest[~np.isin(rest, ok)]
            fresh: list[np.ndarray] = []
            while len(rest):
                choice = rest[able[rest]]
                if not len(choice):
                    break
                heads, at = np.unique(group[choice], return_index=True)
                head = choice[at]
                fresh.append(head)
                place = np.searchsorted(heads, group[rest])
                known = (place < len(heads)) & (heads[np.minimum(place, len(heads) - 1)] == group[rest])
                # entries before the head are no centres and have found none: nothing later can serve them better than as larger sets
                mate = head[np.minimum(place, len(heads) - 1)]
                ok = known & (rest != mate) & _fits(size[mate], pos[mate], size[rest], pos[rest], percent)
                if ok.any():
                    r, m = rest[ok], mate[ok]
                    out.append((LINK, token[r], size[r], pos[r], node[r], node[m]))
                rest = rest[known & ~ok & (rest != mate)]
            heads = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
            if not last:
                up = heads[salted[heads]]
                if len(up):
                    out.append((CENTRE, token[up], size[up], pos[up], node[up], np.zeros(len(up), np.int64)))
            tail = heads[group[heads] == open_group]
            carried = [(int(size[h]), int(pos[h]), int(node[h])) for h in tail]
            centres = (mine if goes_on and open_group == 0 else []) + carried
            key_now = key_now_next
            pending = (int(token[-1]), int(size[-1]), int(pos[-1]), int(salt[-1]), int(node[-1]), wait_last)
            for kind, *columns in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(columns[0]), kind, np.int32)), pa.array(columns[0]), pa.array(columns[1].astype(np.int32)),
                     pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int64)), pa.array(columns[4].astype(np.int64))],
                    ["kind", "token", "size", "pos", "node", "centre"])

    return run


def _compared(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, b = part["a"].to_pylist(), part["b"].to_pylist()
                known = {}
                for names, column in ((a, "text_a"), (b, "text_b")):
                    fresh = [i for i, x in enumerate(names) if x not in known and x not in held]
                    fresh = list({names[i]: i for i in fresh}.values())
                    texts = part[column].take(pa.array(fresh, pa.int64()))
                    for row, found in shingle_sets(texts, shingle):
                        known[names[fresh[row]]] = found
                sets = held | known
                common = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "size_a": pa.array([len(sets[x]) for x in a], pa.int64()),
                    "size_b": pa.array([len(sets[x]) for x in b], pa.int64()), "common": pa.array(common, pa.int64()),
                })
                held = {k: known[k] if k in known else held[k] for k in {*a[-8:], *b[-8:]}}

    return run


MAP_BITS = 24


def _among(keys: DataFrame) -> Column:
    """A filter that passes every one of `keys` (hashes) and few others: a bitmap of a fixed size (2 MB).

    Where keys are so many that all bits are set it passes everything; what follows is exact either way.
    """
    place = F.shiftrightunsigned("key", 64 - MAP_BITS)
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - MAP_BITS}) & 63 as int))").alias("bit"))
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas().itertuples():
        bitmap[r.word] = np.array(r.bits, np.int64).view(np.uint64)

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        at = key.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - MAP_BITS)
        return pd.Series((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0)

    return passes("key")


def compare(pairs: DataFrame, sets: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Exact overlap of every pair (a, b) of nodes, written down.

    Only the texts of these nodes are fetched, one per node: sets has (node, key), rows has (key, text).
    """
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    one = materialize(sets.groupBy("node").agg(F.min("key").alias("key")).join(nodes, "node", "left_semi"), "wanted")
    found = rows.select("key", "text").where(_among(one)).join(one, "key").dropDuplicates(["key"])  # repeated rows have equal keys
    texts = materialize(found.select("node", "text"), "texts")
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    answers = materialize(both.mapInArrow(_compared(shingle), "a long, b long, size_a long, size_b long, common long"), "answers")
    discard(texts, one, pairs)
    return answers


def possible(pairs: DataFrame, maps: DataFrame, percent: int, a: str = "a", b: str = "b") -> DataFrame:
    """Of pairs of nodes those that the bitmaps do not rule out; `maps` has (node, n, bits).

    `pairs` may say how small the sets of a pair are (size_a, size_b) and how much they have beyond the nodes' own (beyond).
    """
    @F.pandas_udf("long")
    def most_shared(bits_a: pd.Series, n_a: pd.Series, bits_b: pd.Series, n_b: pd.Series) -> pd.Series:
        return pd.Series([_most_shared(*row) for row in zip(bits_a, n_a, bits_b, n_b, strict=True)], dtype="int64")

    of = lambda node, s: maps.select(F.col("node").alias(node), F.col("n").alias(f"__n_{s}"), F.col("bits").alias(f"__bits_{s}"))
    beyond = F.col("beyond") if "beyond" in pairs.columns else F.lit(0)
    size_a, size_b = (F.col(f"size_{s}" if f"size_{s}" in pairs.columns else f"__n_{s}").cast("long") for s in ("a", "b"))
    known = pairs.join(of(a, "a"), a).join(of(b, "b"), b).withColumn("__most", most_shared("__bits_a", "__n_a", "__bits_b", "__n_b"))
    return known.where((F.col("__most") + beyond) * F.lit(100 + percent) >= F.lit(percent) * (size_a + size_b)).select(pairs.columns)


def linked(percent: int):
    return F.col("common") * 100 >= F.lit(percent) * (F.col("size_a") + F.col("size_b") - F.col("common"))


def _by_centre(stars: DataFrame) -> DataFrame:
    """Each node with the centre that it meets in most lists, as a pair (a, b)."""
    return (
        stars.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("lists")).groupBy(F.col("node").alias("a"))
        .agg(F.max(F.struct("lists", "centre")).alias("m")).select("a", F.col("m.centre").alias("b"))
    )


def _sorted_pairs(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)


def grouped(answers: DataFrame, percent: int) -> DataFrame:
    """node, component, centre, beyond (elements of the node that its centre lacks) of all sets with a link."""
    links = answers.where(linked(percent))
    best = links.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((F.col("size_a") - F.col("common")).alias("beyond"), F.col("b").alias("centre"))).alias("s"))
    return materialize(components(links, combine=True).join(best, "node", "left").select(
        "node", "component", F.coalesce("s.centre", "node").alias("centre"), F.coalesce("s.beyond", F.lit(0)).alias("beyond")), "groups")


def merged(listed: DataFrame, answers: DataFrame, sets: DataFrame, maps: DataFrame, rows: DataFrame, shingle: int, percent: int, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Groups and answers after comparing groups through one member a list, round by round, while that links any.

    A large family that the first round leaves in pieces becomes one group here, at a cost in proportion to its entries
    and not to their pairs. Rounds only save work, and one in which few pairs are links is the last: what is left is for
    `crossing`, which is exact without them.
    """
    groups = grouped(answers, percent)
    for _ in range(rounds):
        known = listed.join(groups.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        one = known.groupBy("token", "component").agg(F.min(F.struct("pos", "size", "node")).alias("m")).select(
            "token", F.lit(0).alias("salt"), "m.size", "m.pos", "m.node")
        stars = one.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "pos", "node").mapInArrow(_stars(percent, True), FOUND)
        pairs = _sorted_pairs(_by_centre(stars.where(F.col("kind") == LINK))).distinct().join(_sorted_pairs(answers), ["a", "b"], "left_anti")
        fresh = compare(possible(pairs, maps, percent), sets, rows, shingle)
        answers = answers.union(fresh)
        compared, links = fresh.agg(F.count("*"), F.count_if(linked(percent))).first()
        if links:
            groups = grouped(answers, percent)
        if 10 * links <= compared:
            break
    return groups, answers


def crossing(listed: DataFrame, groups: DataFrame, answers: DataFrame, sets: DataFrame, maps: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between sets of different groups that have not been compared; `groups` as from `grouped`, `maps` has (node, n, bits).

    Lists meet by centre first: a list has one entry for all sets of a centre, with the most room that one of them has after it or
    in a later list, and the smallest size. So whole families are skipped at once, and a family costs a list one entry, however large
    it is. Room only shrinks from list to list: two centres that meet in one meet in the first they share, and are passed over where
    the entries just before show an earlier one. What the centres' bitmaps tell of their overlap, with the most that a set has beyond its
    centre, rules out most of the pairs; the centres' answers then bound all pairs of their sets. Only sets of pairs of centres that
    this leaves open meet one by one, and only where the answers of both for the other's centre leave room.
    """
    about = listed.join(groups, "node", "left").select(
        "token", "size", "pos", "node", F.coalesce("component", "node").alias("component"), F.coalesce("centre", "node").alias("centre"),
        F.coalesce("beyond", F.lit(0)).alias("beyond"),
    )
    entries = about.groupBy("token", "centre").agg(
        F.min("component").alias("component"), F.max(F.col("size") - F.col("pos")).cast("int").alias("room"), F.min("size").cast("int").alias("size"))
    # only lists with sets of more than one group
    mixed_lists = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    list_centres = materialize(entries.join(mixed_lists, "token", "left_semi"), "list-centres")
    of_centre = Window.partitionBy("centre")
    backward = of_centre.orderBy(F.col("token").bitwiseXOR(F.lit(-1 << 63)).desc())  # tokens are unsigned in the global order
    entries = list_centres.select(
        "token", "centre", "component", F.max("room").over(backward.rowsBetween(Window.unboundedPreceding, 0)).alias("room"),
        F.min("size").over(of_centre).alias("size"), F.collect_list("token").over(backward.rowsBetween(1, BEFORE)).alias("before"))
    room = F.least(F.col("x.room"), F.col("z.room")).cast("long") * F.lit(100 + percent) >= F.lit(percent) * (F.col("x.size") + F.col("z.size")).cast("long")
    met = entries.alias("x").join(entries.alias("z"), (F.col("x.token") == F.col("z.token")) & (F.col("x.component") < F.col("z.component")) & room
                                  & ~F.arrays_overlap("x.before", "z.before"))
    met = materialize(met.select(F.col("x.centre").alias("centre_x"), F.col("z.centre").alias("centre_z")).distinct(), "centres-met")
    info = about.select("node", F.col("size").cast("long").alias("size"), "component", "centre", F.col("beyond").cast("long").alias("beyond")).distinct()
    info = materialize(info, "sets-met")  # of each family
    # what a centre's answer says of its sets at most
    family = info.groupBy("centre").agg(F.max("beyond").alias("beyond"), F.min("size").alias("size"), F.count_if(F.col("node") != F.col("centre")).alias("others"))
    of = lambda s: family.select(F.col("centre").alias(f"centre_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("beyond", "size", "others")])
    bounds = met.join(of("x"), "centre_x").join(of("z"), "centre_z").select(
        "centre_x", "centre_z", F.col("size_x").alias("size_a"), F.col("size_z").alias("size_b"), (F.col("beyond_x") + F.col("beyond_z")).alias("beyond"))
    of_centres = materialize(possible(bounds, maps, percent, "centre_x", "centre_z").select("centre_x", "centre_z"), "centre-pairs")
    done = _sorted_pairs(answers, "common")
    both = of_centres.select(F.least("centre_x", "centre_z").alias("a"), F.greatest("centre_x", "centre_z").alias("b"))
    fresh = compare(both.join(done, ["a", "b"], "left_anti"), sets, rows, shingle)
    overlap = done.select("a", "b", "common").union(fresh.select("a", "b", "common")).distinct()
    known = of_centres.withColumns({"a": F.least("centre_x", "centre_z"), "b": F.greatest("centre_x", "centre_z")}).join(overlap, ["a", "b"])
    open_ = (F.col("common") + F.col("beyond_x") + F.col("beyond_z")) * F.lit(100 + percent) >= F.lit(percent) * (F.col("size_x") + F.col("size_z"))
    families = known.join(of("x"), "centre_x").join(of("z"), "centre_z").where(open_ & (F.col("others_x") + F.col("others_z") > 0))
    left = materialize(_apart(families.select("centre_x", "centre_z", "common"), answers.union(fresh), percent), "open-centres")

    # each set with the other family's centre: as many comparisons as the families have sets, and closer bounds
    member = lambda s: info.where("node <> centre").select(
        F.col("centre").alias(f"centre_{s}"), F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("beyond").alias(f"beyond_{s}"))
    sizes = lambda s: maps.select(F.col("node").alias(f"centre_{s}"), F.col("n").alias(f"n_{s}"))
    reach = lambda overlap, n, m: overlap * F.lit(100 + percent) >= F.lit(percent) * (n + m)
    one = left.join(member("z"), "centre_z").join(sizes("x"), "centre_x").where(reach(F.col("common") + F.col("beyond_z"), F.col("n_x"), F.col("size_z"))).select("centre_x", "z")
    two = left.join(member("x"), "centre_x").join(sizes("z"), "centre_z").where(reach(F.col("common") + F.col("beyond_x"), F.col("n_z"), F.col("size_x"))).select("centre_z", "x")
    across = _sorted_pairs(one.toDF("a", "b").union(two.toDF("a", "b"))).distinct()
    so_far = answers.union(fresh)
    half = compare(across.join(_sorted_pairs(so_far), ["a", "b"], "left_anti"), sets, rows, shingle)
    so_far = so_far.union(half)
    last = materialize(_apart(left, so_far, percent), "still-open")

    # the sets of what is left: x and z share at most what x shares with the centre of z and what z has beyond it, and the other way round
    told = _sorted_pairs(so_far, F.col("common").alias("told")).distinct()

    def side(s: str, other: str) -> DataFrame:
        own = info.select(F.col("centre").alias(f"centre_{s}"), F.col("node").alias(f"node_{s}"), "size", "beyond")
        each = last.join(own, f"centre_{s}").withColumns({"a": F.least(f"node_{s}", f"centre_{other}"), "b": F.greatest(f"node_{s}", f"centre_{other}")})
        most = F.coalesce("told", F.col("common") + F.col("beyond"))
        less = lambda shared: shared * F.lit(100 + percent) - F.lit(percent) * F.col("size")
        return each.join(told, ["a", "b"], "left").select(
            "centre_x", "centre_z", f"node_{s}", less(most).alias(f"has_{s}"), less(F.col("beyond")).alias(f"lends_{s}"))

    pairs = side("x", "z").join(side("z", "x"), ["centre_x", "centre_z"]).where("has_x + lends_z >= 0 AND has_z + lends_x >= 0")
    pairs = _sorted_pairs(pairs.select(F.col("node_x").alias("a"), F.col("node_z").alias("b"))).distinct()
    rest = compare(possible(pairs.join(_sorted_pairs(so_far), ["a", "b"], "left_anti"), maps, percent), sets, rows, shingle)
    found = materialize(fresh.union(half).union(rest).where(linked(percent)).select("a", "b"), "crossing-links")
    discard(list_centres, met, of_centres, info, left, last, fresh, half, rest)
    return found


def _apart(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Of pairs (centre_x, centre_z) those whose sets no chain of links has joined yet."""
    known = components(answers.where(linked(percent)), combine=True)
    label = lambda s: known.select(F.col("node").alias(f"centre_{s}"), F.col("component").alias(f"component_{s}"))
    both = pairs.join(label("x"), "centre_x", "left").join(label("z"), "centre_z", "left")
    return both.where("component_x IS NULL OR component_z IS NULL OR component_x <> component_z").drop("component_x", "component_z")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, component (a node, null for empty sets), node (a hash of the set), row_key
    (a hash of key and text).

    A text with fewer words than a shingle has one shingle of all of them; null, empty and wordless texts have an
    empty set and are linked with nothing. Equal texts and repeated rows are linked. component_id is the smallest
    key reachable, null keys aside. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"))
    digests = materialize(rows.mapInArrow(_digests(shingle), DIGEST), "shingle-sets")
    sets = digests.where("block IS NULL").select("doc_id", "key", "n", "node")
    levels = zlib.compress(frequency_levels(digests).tobytes(), 1)

    entries = rows.select("text").mapInArrow(_entries(levels, shingle, percent), ENTRY)
    first = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "pos", "node").mapInArrow(_stars(percent, False), FOUND)
    found = materialize(first, "lists")
    heads = found.where(F.col("kind") == CENTRE).select("token", F.lit(0).alias("salt"), "size", "pos", "node")
    second = heads.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "pos", "node").mapInArrow(_stars(percent, True), FOUND)
    stars = found.where(F.col("kind") == LINK).select("node", "centre").union(second.where(F.col("kind") == LINK).select("node", "centre"))
    pairs = _by_centre(stars)
    listed = found.where(F.col("kind") == LISTED).select("token", "size", "pos", "node")

    filled = sets.where("n > 0")
    maps = digests.where("bits IS NOT NULL").select("node", "n", "bits").dropDuplicates(["node"])
    answers = compare(possible(pairs, maps, percent), filled, rows, shingle)
    groups, answers = merged(listed, answers, filled, maps, rows, shingle, percent)
    more = crossing(listed, groups, answers, filled, maps, rows, shingle, percent)
    discard(found)
    links = answers.where(linked(percent)).select("a", "b").union(more)
    final = groups.select("node", "component") if more.isEmpty() else components(links, combine=True)

    placed = materialize(
        sets.where("n > 0").join(final, "node", "left").select("doc_id", "key", "n", "node", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    some = placed.join(least, "component").select("doc_id", "n", "component_id", "component", "node", "key")
    none = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "node", "key")
    return some.union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "node", F.col("key").alias("row_key"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component: that of the smallest key, null keys last; of repeated rows one. Rows without words stay."""
    found = join(docs, key, text, **options).where(F.col("component").isNotNull())
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("m")).select(F.col("m.row_key").alias("__row_key"))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(packed(docs).alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("__row_key"), wordless.alias("wordless"))
    kept = keyed.where("NOT wordless").join(first, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return kept.select(*unpacked(kept, "doc")).union(docs.where(wordless))
