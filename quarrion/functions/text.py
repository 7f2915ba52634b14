"""Tokens, stems, edit distance and phonetic codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for retrieval.
STOP_WORDS = ["the", "is", "are", "at", "which", "on", "and", "a", "an", "in", "to", "for", "of", "with"]


def stem(word: Column) -> Column:
    """First step of suffix stripping; guards on length keep short words whole."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(word.endswith("sses") | word.endswith("ies"), cut(2))
        .when(word.endswith("ing") & (n > 5), cut(3))
        .when(word.endswith("ed") & (n > 4), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), cut(1))
        .otherwise(word)
    )


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stems(text: Column) -> Column:
    """Stemmed words without stop words, in text order."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS)), stem)


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of characters, white space left out; a single character stands alone."""
    bare = F.regexp_replace(text, r"\s+", "")
    n = F.length(bare)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(bare, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(bare)).otherwise(pairs)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance without regard to case."""
    return F.levenshtein(F.lower(a), F.lower(b))


def within_edits(a: Column, b: Column, most: int) -> Column:
    return edit_distance(a, b) <= most


def soundex_variant(word: Column) -> Column:
    """Soundex in which every letter without a digit, H and W included, ends a run of equal digits."""
    clean = F.regexp_replace(F.upper(word), r"[^\p{L}]", "")
    coded = F.translate(clean, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    digits = F.regexp_replace(coded, "[^1-6]", "0")
    # equal neighbours collapse; then letters without a digit fall out, and the first letter's own digit
    kept = F.regexp_replace(digits, r"([1-6])\1+", "$1")
    tail = F.translate(F.substring(kept, F.lit(2), F.length(kept)), "0", "")
    return F.when(clean == "", F.lit("")).otherwise(F.substring(F.concat(F.substring(clean, 1, 1), tail, F.lit("000")), 1, 4))
