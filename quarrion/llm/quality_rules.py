"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were which with "
    "als auf aus bei das dem den der des die ein eine er es für ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= 100 * measure <= high (either may be None); measure is a name in `measures`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "mean_word_chars", 200, 2000),
    Rule("symbols", "symbols_per_word", None, 20),
    Rule("stop_words", "stop_word_share", 2, None),
    Rule("repeated_lines", "dup_line_share", None, 50),
    Rule("repeated_words", "repeat_word_share", None, 40),
)


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
}


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean expression for all rules."""
    out = F.lit(True)
    for rule in rules:
        value = F.lit(100.0) * _share(*MEASURES[rule.measure])
        if rule.low is not None:
            out = out & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            out = out & (value <= F.lit(float(rule.high)))
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words) of each whole text."""
    given = id_text(docs, id_col, text_col)
    spaced = F.filter(F.split("text", r"[ \x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    step = given.select(
        "doc_id",
        spaced.alias("words"),
        lines.alias("lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:")))
    step = step.select(
        "doc_id",
        "n_symbols",
        "word_chars",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: bare(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n = F.size("hashes")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)).alias("h"), i.alias("i"))))
    step = step.withColumn("windows", F.sort_array(windows)).drop("hashes")
    # after sorting equal windows are neighbours
    again = F.filter("windows", lambda x, j: (x["h"] == F.get("windows", j - 1)["h"]) | (x["h"] == F.get("windows", j + 1)["h"]))
    step = step.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("windows")
    # each repeated window covers the words up to the next one, three at most
    covered = F.aggregate(F.transform(F.col("again"), lambda p, j: F.least(F.lit(3), F.coalesce(F.get("again", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("again")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures() with base_failed and kept.

    Null and empty texts have no words: all counts 0, base_failed, not kept. Repeated rows are judged each by itself.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS tri FROM w),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(rtrim(x, '.,;:')) IN ({_STOPS})))::BIGINT AS n_stop
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND 100.0::DOUBLE * word_chars / n_words BETWEEN 200 AND 2000 AND 100.0::DOUBLE * n_symbols / n_words <= 20
   AND 100.0::DOUBLE * n_stop / n_words >= 2 AND 100.0::DOUBLE * n_dup_lines / greatest(n_lines, 1) <= 50 AND 100.0::DOUBLE * n_repeat_words / n_words <= 40) AS kept
FROM f
"""
