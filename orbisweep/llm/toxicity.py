"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding: lower case, letters that look alike to one letter, digits and signs that stand for letters to these
letters, everything that is no letter to a space. Entries are word beginnings (`lexicon`) with weights;
phrases in `exceptions` cancel the entries inside them. A text's strength is its sum of weights
divided by the square root of its length in words; a logistic curve turns it into a score from 0 to 1.

The lexicon is learned: word beginnings of 4 to 8 letters (whole words if shorter) whose documents are labelled toxic
far more often than the rest, by a log-likelihood ratio whose threshold grows with the number of beginnings tried.
Of beginnings that occur in the same documents the longest is kept. Learning reads at most `per_label` labelled
documents of each label, chosen by a hash of the key; scoring reads every text whole. Copies and near copies count once: else
every rare word of a text that was copied often enough would look like its label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .texts import mixed, shingle_sets

# Letters of other alphabets and signs that read as Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ո": "n", "һ": "h",
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "ı": "i", "ɩ": "i", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e",
}
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash collection", "idiot proof", "clown car")
LENGTHS = range(4, 9)


class _Folds(dict):
    """Code point -> folded text, filled in as letters turn up."""

    def __missing__(self, code: int) -> str:
        letter = chr(code).lower()
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms
            letter = chr(code - 0xFEE0).lower()
        out = HOMOGLYPHS.get(letter, letter if letter.isalpha() else " ")
        self[code] = out
        return out


_FOLDS = _Folds()


#: Signs between spaces separate; inside a word they stand for letters.
_ALONE = re.compile(r"(?<!\S)[0-9@$!|€]+(?!\S)|[!|]+(?!\S)")


def fold(text: str | None) -> str:
    """The folded text between two spaces."""
    return f" {_ALONE.sub(' ', text or '').translate(_FOLDS)} "


def beginnings(word: str) -> list[str]:
    return [f" {word} "] if len(word) < LENGTHS[0] else [f" {word[:k]}" for k in LENGTHS if k <= len(word)]


@dataclass(frozen=True)
class Lexicon:
    """Entries begin with a space; those that also end with one are whole words."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 0.0
    offset: float = -20.0


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            entry = " ".join(fold(phrase).split())
            if f" {entry}" not in lexicon.weights:
                self.automaton.add_word(f" {entry}", (len(entry) + 1, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def strength(self, text: str | None) -> float:
        folded = fold(text)
        if not len(self.automaton):
            return 0.0
        best: dict[int, tuple[int, float]] = {}  # per word start the longest entry
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][0] < length:
                best[start] = (length, weight)
        if not best:
            return 0.0
        total = sum(w for s, (_, w) in best.items() if not any(a <= s <= b for a, b in spared))
        return max(0.0, total) / math.sqrt(len(folded.split()) + 10)


def _scores(lexicon: Lexicon, strengths: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(lexicon.slope * np.log1p(strengths) + lexicon.offset, -30, 30)))


def score(lexicon: Lexicon, text: Column) -> Column:
    """Score of every whole text; null reads as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pd.Series(_scores(lexicon, np.array([matcher.strength(t) for t in batch], float)))

    return scored(text)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key's text divisible by 5; null keys too."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


_DRAWS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHashes of each sampled text: near copies share most of them."""
    for batch in batches:
        marks = np.zeros((len(_DRAWS), batch.num_rows), np.uint64)
        for row, found in shingle_sets(batch["text"], 3):
            if len(found):
                marks[:, row] = mixed(found[None, :] ^ _DRAWS[:, None]).min(axis=1)
        yield pa.RecordBatch.from_arrays([batch["__key"], batch["label"], *[pa.array(m.view(np.int64)) for m in marks]],
                                         ["key", "label", *[f"m{k}" for k in range(len(_DRAWS))]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word beginning and label; partial sums of a task."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            for entry in {b for w in set(fold(text).split()) for b in beginnings(w)}:
                counts.setdefault(entry, [0, 0])[label] += 1
        if len(counts) > 500_000:
            yield from _flush(counts)
            counts = {}
    yield from _flush(counts)


def _flush(counts: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    items = list(counts.items())
    for lo in range(0, len(items), 20_000):
        part = items[lo: lo + 20_000]
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array([k for k, _ in part], pa.string()), "clean": pa.array([v[0] for _, v in part], pa.int64()),
            "toxic": pa.array([v[1] for _, v in part], pa.int64()),
        })


def _ratio(p: np.ndarray, n: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of a beginning's share of toxic documents against the overall share."""
    base = toxic / (toxic + clean)
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1) / e), 0.0)
    return 2 * (part(p, (p + n) * base) + part(n, (p + n) * (1 - base)))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a small ridge for separable data."""
    design, w = np.column_stack([np.log1p(x), np.ones_like(x)]), np.zeros(2)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 20_000,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon and curve from at most `per_label` documents of each label, none of them held out.

    Of several labels of a key the largest counts; null labels and keys are left out. Without toxic or without
    clean documents the lexicon is empty and every score nearly 0.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).cast("long").alias("__key")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    )
    order = F.xxhash64("__key")
    chosen = known.where("label = 1").orderBy(order).limit(per_label).union(known.where("label = 0").orderBy(order).limit(per_label))
    # at most 2 * per_label keys are broadcast
    sample = materialize(docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key"), "labelled")
    names = [f"m{k}" for k in range(len(_DRAWS))]
    marks = sample.mapInArrow(_marks, "key long, label int, " + ", ".join(f"{m} long" for m in names)).toPandas().sort_values("key")
    for three in combinations(names, len(names) - 1):  # one of each run of near copies: all marks but one are equal
        marks = marks.drop_duplicates(["label", *three])
    single = docs.sparkSession.createDataFrame(marks[["key"]].drop_duplicates().rename(columns={"key": "__key"}), "__key long")
    rows = sample.dropDuplicates(["__key"]).join(F.broadcast(single), "__key", "left_semi").select("text", "label")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon(exceptions=exceptions)
    counts = rows.mapInArrow(_counted, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where("toxic > 0"), "beginnings")
    tried = counts.count()
    least = 2 * math.log(max(2, tried))
    # only these can reach the threshold; their number is bounded by the sample
    found = counts.where(F.col("toxic") * F.lit(2 * math.log((toxic + clean) / toxic)) >= least).where(
        F.col("toxic") * F.lit(clean) > F.col("clean") * F.lit(3.0 * toxic)).toPandas()
    p, n = found["toxic"].to_numpy(float), found["clean"].to_numpy(float)
    weight = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
    good = (_ratio(p, n, toxic, clean) >= least) & (weight > 1)
    entries = {e: (w, c) for e, w, c in zip(found["entry"][good], weight[good], p[good], strict=True)}
    kept: dict[str, float] = {}
    for entry in sorted(entries, key=len):
        w, c = entries[entry]
        parent = next((entry[:k] for k in range(len(entry) - 1, 1, -1) if entry[:k] in kept), None)
        if parent is None or c >= 0.95 * entries[parent][1] or w > kept[parent] + 1:
            if parent is not None and c >= 0.95 * entries[parent][1]:
                del kept[parent]
            kept[entry] = w
    lexicon = Lexicon(kept, exceptions)
    matcher = F.pandas_udf(_strengths(lexicon), "double")
    # one pair of numbers per sampled document
    fit = rows.select(matcher("text").alias("x"), "label").toPandas()
    slope, offset = _curve(fit["x"].to_numpy(float), fit["label"].to_numpy(float))
    return Lexicon(kept, exceptions, max(slope, 0.0), offset)


def _strengths(lexicon: Lexicon):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pd.Series([matcher.strength(t) for t in batch], dtype=float)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def scored(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with held_out, score and predicted (1 from a score of 0.5), in place of columns of these names.

    Null and empty texts get the score of a text without entries. Rows are scored one by one: repeated rows get
    equal scores.
    """
    return docs.withColumns({"held_out": held_out(F.col(key)), "score": score(lexicon, F.col(text))}).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
