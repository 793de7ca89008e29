"""Mixing sources to target weights by sampled blocks.

1. Pack: the documents of a source, in a fixed pseudorandom order, form one stream of words, cut into
   blocks of `block_words`. A document is a list of fragments (block, first word, words).
2. Targets: the wanted total is shared by weight; a source stops at `max_epochs` times its size and
   what it cannot take is shared among the others.
3. Draw: the mix is a row of output shards with `shard_blocks` slots each. Each shard gets multinomial
   source counts, drawn so that the counts of all shards add up to the targets: the shard range is
   halved again and again, and each half draws its counts from its parent's (a multivariate
   hypergeometric draw, seeded by the range). Any task can so compute the shards it was given.
4. Map: the j-th draw of a source takes block perm_e(j mod n) of epoch e = j div n, where perm_e is
   a pseudorandom permutation of the source's n blocks (a Feistel network with cycle walking).
   A block is used once per epoch, so never more than `max_epochs` times.
5. Join slots and fragments on (source, block): the blocks spread the largest source evenly.

Everything depends on the rows and the seed alone, not on partitions: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, numbered, packed

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
ROWS_PER_PART = 4096


@dataclass(frozen=True)
class Mix:
    """sources: source, rank, source_size, target. documents: doc (the given columns), size, source_size, target, taken,
    mix_row. uses: mix_row, shard, slot, epoch, first_word, words: what each slot holds."""

    sources: DataFrame
    documents: DataFrame
    uses: DataFrame


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> rank, weight and target per source; one row per source throughout.

    A level x with sum(min(max_epochs * size, x * weight)) = wanted total exists; the sources that
    stop early are those with the smallest max_epochs * size / weight, so running sums in that order give x.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod("rank", F.lit(len(cycle))) + 1)
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    fill = (
        ranked.withColumn("weight", weight)
        .withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
        # the level of the first source that is not stopped holds for all after it
        .withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every))
    )
    target = F.least("most", F.coalesce(F.col("free.level") * F.col("weight"), F.col("most")))
    return fill.select("source", "rank", "source_size", "weight", target.alias("target"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the image of `index` under the pseudorandom permutation of range(n) named by `key`."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.astype(np.uint64), np.ones(len(index), bool)
    limit, key = n.astype(np.uint64), key.astype(np.uint64)
    while left.any():  # walk the cycle until the image is below n
        x, h, m, k = out[left], half[left], mask[left], key[left]
        a, b = x >> h, x & m
        for turn in range(4):
            a, b = b, a ^ (_mixed(b + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[left] = (a << h) | b
        left &= out >= limit
    return out.astype(np.int64)


def split_counts(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw of `take` from `counts`, one source after the other."""
    out, rest, want = np.zeros_like(counts), int(counts.sum()), int(take)
    for i, c in enumerate(counts.tolist()):
        rest -= c
        if c == 0 or want == 0:
            continue
        if rest == 0:
            got = want
        elif c + rest < 900_000_000:
            got = int(rng.hypergeometric(c, rest, want))
        else:  # beyond the generator's range the normal form is exact to rounding
            p = c / (c + rest)
            spread = (want * p * (1 - p) * (c + rest - want) / max(1, c + rest - 1)) ** 0.5
            got = int(min(c, want, max(0, want - rest, round(want * p + spread * rng.standard_normal()))))
        out[i], want = got, want - got
    return out


def shard_counts(counts: np.ndarray, shard_blocks: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its source counts, counts of all shards before) for the shards first..last-1."""
    total = int(counts.sum())
    shards = -(-total // shard_blocks)
    open_ranges = [(0, shards, counts, np.zeros_like(counts))] if shards else []
    while open_ranges:
        lo, hi, own, before = open_ranges.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, own, before
            continue
        mid = (lo + hi) // 2
        left = split_counts(own, (mid - lo) * shard_blocks, np.random.default_rng([seed, lo, hi]))
        open_ranges += [(mid, hi, own - left, before + left), (lo, mid, left, before)]


def _slots(counts: np.ndarray, blocks: np.ndarray, shard_blocks: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = np.sort(frame["id"].to_numpy())
            for piece in np.split(ids, np.flatnonzero(np.diff(ids) != 1) + 1) if len(ids) else []:
                for shard, own, before in shard_counts(counts, shard_blocks, seed, int(piece[0]), int(piece[-1]) + 1):
                    rank = np.repeat(np.arange(len(own)), own)
                    draw = np.arange(len(rank)) - np.repeat(np.cumsum(own) - own, own) + before[rank]
                    n = blocks[rank]
                    epoch = draw // n
                    key = _mixed((np.uint64(seed) << np.uint64(40)) + (rank.astype(np.uint64) << np.uint64(8)) + epoch.astype(np.uint64))
                    yield pd.DataFrame({
                        "rank": rank.astype(np.int32), "block": permuted(draw % n, n, key), "epoch": epoch.astype(np.int32),
                        "shard": np.int64(shard), "slot": np.random.default_rng([seed, shard]).permutation(len(rank)),
                    })

    return run


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
        share: float = 1.5, max_epochs: int = 2, block_words: int = 256, shard_blocks: int = 512, seed: int = 7,
        keep: list[str] | None = None) -> Mix:
    """Mixes `docs`; see the module's text.

    Null or wordless texts have size 0: they are in no block and taken 0 times. A null source is a
    source, last in order. Repeated rows and equal keys count each on their own. An empty table
    gives an empty mix.

    One row per source comes to the driver: a mixture names its sources, and the weights are given per source.
    """
    spark = docs.sparkSession
    parts = max(1, -(-docs.count() // ROWS_PER_PART))
    content = F.xxhash64(F.col(key), F.col(text))
    laid = materialize(
        docs.select(packed(docs, (), keep).alias("doc"), F.col(source).alias("__source"), F.col(key).alias("__key"), words_in(text).alias("size"), content.alias("__content"),
                    F.pmod(content, F.lit(parts)).alias("__part"), F.monotonically_increasing_id().alias("mix_row")),
        "mix",
    )
    sources = materialize(
        targets(laid.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size")), cycle, share, max_epochs)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
        # as many draws as give the target at the mean block length, the short last block included
        .withColumn("draws", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("bigint")),
        "mix-sources",
    )
    plan = sources.select("rank", "blocks", "draws").orderBy("rank").toPandas()
    counts, blocks = plan["draws"].to_numpy(np.int64), plan["blocks"].to_numpy(np.int64)
    shards = -(-int(counts.sum()) // shard_blocks)
    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    slots = spark.range(0, shards, 1, tasks).mapInPandas(
        _slots(counts, blocks, shard_blocks, seed), "rank int, block long, epoch int, shard long, slot long"
    )

    code = F.coalesce(F.concat(F.lit("="), F.col("__source").cast("string")), F.lit("")).alias("__code")  # a null source is one, too
    narrow = laid.select("__source", code, "__key", "__content", "__part", "mix_row", "size").where("size > 0")
    placed = numbered(narrow, ["__code"], "__part", [F.col("__key"), F.col("__content"), F.col("mix_row")], "start", F.col("size"))
    ranks = sources.select("source", "rank")
    width = F.lit(block_words)
    fragments = (
        placed.join(ranks, placed["__source"].eqNullSafe(ranks["source"]))
        .select("rank", "mix_row", "start", "size",
                F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))).alias("block"))
        .select("rank", "block", "mix_row", (F.greatest("start", F.col("block") * width) - F.col("start")).alias("first_word"),
                (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width) - F.greatest("start", F.col("block") * width)).alias("words"))
    )
    # the planner takes a few shard numbers for a few slots and would broadcast them
    uses = fragments.join(slots.hint("merge"), ["rank", "block"]).select("mix_row", "shard", "slot", "epoch", "first_word", "words")
    # for the sums, a block's uses are counted before the join: one row per block
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = fragments.join(times.hint("merge"), ["rank", "block"]).groupBy("mix_row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    about = sources.select("source", "source_size", "target")
    documents = (
        laid.join(about, laid["__source"].eqNullSafe(about["source"])).drop(about["source"])
        .join(taken, "mix_row", "left")
        .select("doc", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "mix_row")
    )
    return Mix(sources, documents, uses)


def mixed_texts(mixed: Mix, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The mix as documents: one row per document and epoch in which any of its words are taken.

    A document whose words are all taken keeps its text as it was. Of others the taken words remain, in order and with the white
    space between them; a line break stands for words left out in between. Rows without words (null, blank) cost the mix nothing and
    stay once, as they are.
    """
    spans = mixed.uses.groupBy("mix_row", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("first_word", "words"))).alias("__spans"), F.sum("words").alias("__words")
    )
    own = F.col(f"doc.`{text}`")
    tokens = F.regexp_extract_all(own, F.lit(f"{GAP}*{WORD}"), F.lit(0))  # each word with the white space before it

    def stretch(span, i):
        taken = F.array_join(F.slice(tokens, (span["first_word"] + 1).cast("int"), span["words"].cast("int")), "")
        before = F.get("__spans", i - 1)
        goes_on = (i > 0) & (before["first_word"] + before["words"] == span["first_word"])
        return F.when(goes_on, taken).otherwise(F.concat(F.lit("\n"), F.regexp_replace(taken, f"^{GAP}+", "")))

    pieces = F.array_join(F.transform("__spans", stretch), "")
    cut = F.when(F.col("__words") == F.col("size"), own).otherwise(F.substring(pieces, F.lit(2), F.char_length(pieces)))
    some = mixed.documents.select("doc", "size", "mix_row").join(spans, "mix_row").select("doc", cut.alias("__text"))
    wordless = mixed.documents.where("size = 0").select("doc", own.alias("__text"))
    out = some.union(wordless)
    changed = {text: F.col("__text"), n_chars: F.coalesce(F.char_length("__text").cast("bigint"), F.lit(0).cast("bigint"))}
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in out.schema["doc"].dataType.names])
