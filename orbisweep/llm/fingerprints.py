"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over windows of seven bytes; where it hits -1 modulo the block size, a chunk ends.
Each chunk gives one of 64 letters. Block sizes are 3 * 2^k; a text takes the smallest that asks for at most
64 chunks, and a smaller one while it gets under 32. A fingerprint is `size:letters:letters at twice the size`,
so that texts of up to twice the length can be compared. Boundaries depend on nearby bytes only: an
edit changes the letters near it and no others.

Likeness of two fingerprints: 2 * LCS / (sum of lengths) of the letters at a common block size, which is
1 - edit distance / (sum of lengths) with insertions and deletions of cost 1; 0 without a common block size or
without a common run of letters (seven, fewer for short signatures); 1 for equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .texts import EXACT, Prefix, mixed, pieces

WINDOW, LEAST, LONG, SHORT, RUN = 7, 3, 64, 32, 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _letters(prefix: Prefix, cuts: np.ndarray, lo: int, hi: int, most: int) -> str:
    starts, ends = np.concatenate(([lo], cuts)), np.concatenate((cuts, [hi]))
    if starts[-1] == hi:
        starts, ends = starts[:-1], ends[:-1]
    if len(starts) > most:  # the last letter stands for all that is left
        starts, ends = starts[:most], np.append(ends[: most - 1], hi)
    return LETTERS[prefix.of(starts, ends) & np.uint64(63)].tobytes().decode()


def fingerprints(texts: pa.Array) -> list[str]:
    """The fingerprint of every text (UTF-8 strings; null reads as empty)."""
    out = []
    for lo, hi, data, offsets in pieces(texts):
        prefix = Prefix(data, EXACT)
        at = np.arange(len(data))
        begin = np.maximum(at + 1 - WINDOW, np.repeat(offsets[:-1], np.diff(offsets)))
        # aligned to the window's end, so that the value is the same wherever the window stands
        rolled = (prefix.sums[1:] - prefix.sums[begin]) * prefix.inverse[: len(data)]
        value = (mixed(rolled) >> np.uint64(33)) + np.uint64(1)
        hit = np.flatnonzero(value % np.uint64(LEAST) == 0)
        own = value[hit]
        # how often two divides the value: the largest block size for which this is a boundary
        level = np.log2((own & (~own + np.uint64(1))).astype(np.float64)).astype(np.int64)
        bounds = np.searchsorted(hit, offsets)
        for row in range(hi - lo):
            a, b = int(offsets[row]), int(offsets[row + 1])
            if a == b:
                out.append(f"{LEAST}::")
                continue
            cuts, levels = hit[bounds[row]: bounds[row + 1]] + 1, level[bounds[row]: bounds[row + 1]]
            k = max(0, int(np.ceil(np.log2((b - a) / (LEAST * LONG)))))
            while k and np.count_nonzero(levels >= k) + 1 < SHORT:
                k -= 1
            out.append(f"{LEAST << k}:{_letters(prefix, cuts[levels >= k], a, b, LONG)}:{_letters(prefix, cuts[levels > k], a, b, SHORT)}")
    return out


def _padded(texts: list[str], filler: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.encode().ljust(LONG, bytes([filler])) for t in texts), np.uint8).reshape(len(texts), LONG)


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of pairs of letter strings of at most 64, all pairs at once: a bit per position of the left one."""
    n = len(left)
    if not n:
        return np.zeros(0)
    a, b = _padded(left, 0), _padded(right, 1)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    free = np.full(n, np.uint64(2**64 - 1))
    runs, seen = [np.zeros(n, np.uint64) for _ in range(RUN)], np.zeros((RUN + 1, n), bool)
    seen[0] = True
    for j in range(int(lb.max())):
        match = np.packbits(a == b[:, j: j + 1], axis=1, bitorder="little").view("<u8").reshape(n)
        both = free & match
        free = (free + both) | (free - both)
        for t in range(RUN - 1, 0, -1):
            runs[t] = (runs[t - 1] << np.uint64(1)) & match
        runs[0] = match
        for t in range(RUN):
            seen[t + 1] |= runs[t] != 0
    lcs = np.bitwise_count(~free).astype(np.float64)
    need = np.clip(np.minimum(la, lb) // 4, 1, RUN)
    return np.where(seen[need, np.arange(n)], 2 * lcs / np.maximum(la + lb, 1), 0.0)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    a, b = [x.split(":") for x in left], [x.split(":") for x in right]
    out = np.array([float(x == y) for x, y in zip(left, right, strict=True)])
    rows, one, two = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if out[i] == 1.0:
            continue
        p, q = int(x[0]), int(y[0])
        for s, t in ([(x[1], y[1]), (x[2], y[2])] if p == q else [(x[1], y[2])] if p == 2 * q else [(x[2], y[1])] if q == 2 * p else []):
            rows.append(i)
            one.append(s)
            two.append(t)
    np.maximum.at(out, np.array(rows, np.int64), signature_likeness(one, two))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _report(ids: list, texts: list[str], after: list[str], ready: list[str]) -> pa.RecordBatch:
    changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
    own, new, following = ready[:-1], fingerprints(pa.array(changed, pa.large_string())), ready[1:]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(own, pa.string()), "edited_fingerprint": pa.array(new, pa.string()),
        "near_edited": pa.array(likeness(own, new), pa.float64()), "near_next": pa.array(likeness(own, following), pa.float64()),
    })


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is reported when its follower is known. The follower of a bucket's last row is marked."""
    held: tuple[int, int | None, str] | None = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows = list(zip(part["bucket"].to_pylist(), part["kind"].to_pylist(), part["doc_id"].to_pylist(),
                            [t or "" for t in part["text"].to_pylist()], strict=True))
            if held:
                rows.insert(0, held)
            own = [i for i in range(len(rows) - 1) if rows[i][1] == 0]
            held = rows[-1] if rows and rows[-1][1] == 0 else None
            if own:
                prints = fingerprints(pa.array([r[3] for r in rows], pa.large_string()))
                # runs of consecutive rows share their fingerprints
                for run in np.split(np.array(own), np.flatnonzero(np.diff(own) != 1) + 1):
                    a, b = int(run[0]), int(run[-1]) + 1
                    yield _report([r[2] for r in rows[a:b]], [r[3] for r in rows[a:b]], [r[3] for r in rows[a + 1: b + 1]], prints[a: b + 1])


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 4096) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to it and to the next document.

    Next: by ascending key (null first), ties by text; after the last comes the first, a lone document
    follows itself. Null text reads as empty. Other columns are ignored. An empty table gives an empty result.

    The key range is cut into buckets at approximate quantiles; a bucket is sorted by Spark and streamed, and the first
    document of the bucket after it is sent to it as one extra row. So texts are shuffled once.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = rows.count()
    buckets = min(10_000, max(1, n // rows_per_bucket))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).head()[0] if buckets > 1 else []
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        return pd.Series(np.where(known, np.searchsorted(edges, ids.fillna(0).astype("int64").to_numpy(), side="right") + 1, 0).astype(np.int32))

    laid = rows.withColumn("bucket", bucket_of("doc_id"))
    in_order = Window.orderBy("bucket")  # one row per bucket, at most 10,001
    everyone = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = laid.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    follow = firsts.select(
        F.coalesce(F.lag("bucket").over(in_order), F.last("bucket").over(everyone)).alias("bucket"), F.col("first")
    )
    ahead = (
        rows.join(F.broadcast(follow), rows["doc_id"].eqNullSafe(follow["first"]))
        .groupBy("bucket", "doc_id").agg(F.min("text").alias("text"), F.count(F.when(F.col("text").isNull(), 1)).alias("nulls"))
        .select("doc_id", F.when(F.col("nulls") > 0, F.lit(None)).otherwise(F.col("text")).alias("text"), "bucket", F.lit(1).alias("kind"))
    )
    return (
        laid.withColumn("kind", F.lit(0)).select("doc_id", "text", "bucket", "kind").unionByName(ahead)
        .repartition("bucket").sortWithinPartitions("bucket", "kind", "doc_id", "text")
        .mapInArrow(_neighbours, SCHEMA)
    )
