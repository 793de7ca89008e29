"""Word arrays and their hashes as column expressions, for the operators that stay with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Scripts written without spaces between words; each of their letters, with its marks, is a word.
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
#: Between words: what is no letter, mark or digit, and the places before and after a letter of these scripts.
SPACED = r"[^\p{L}\p{M}\p{N}]+"
BREAK = rf"{SPACED}|(?=[{UNSPACED}])(?!\p{{M}})|(?<=[{UNSPACED}])(?!\p{{M}})"
#: All of these scripts lie here; a text without such characters is split the quick way.
BEYOND = r"[\x{E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a lower-cased text: runs of letters, marks and digits, single letters in scripts without spaces; null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_remove(F.when(low.rlike(BEYOND), F.split(low, BREAK)).otherwise(F.split(low, SPACED)), "")
    return F.transform(words, lambda w: F.xxhash64(w))
