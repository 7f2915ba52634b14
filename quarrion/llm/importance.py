"""Quality classifier by importance resampling.

Two bag models over hashed word n-grams, one of target text (documents labelled good), one of raw text (all
documents), give each document an importance weight, the ratio of its likelihoods. Documents are then sampled without
replacement by Gumbel top-k: the k greatest of log weight + Gumbel noise stay. Unless given, k is the number of documents
that weigh at least as much as nearly all target documents do when each is weighed by a target model without itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACES, chunks, discard, id_text, mix, rolling, table, tidied, words_of, written

BUCKETS = 10_000
#: Labelled documents that the target model is fitted on, at most; those with the least hashes of their ids.
MAX_TARGET = 20_000
SMOOTHING = 1.0
#: Share of documents like the target that k may leave out, and the part of the target's weights that it is carried on from:
#: below this quantile weights count as falling off exponentially.
LOSS, TAIL = 0.001, 0.05
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words, case folded."""
    w = words_of(data, offsets, SPACES, LOWER)
    pairs = rolling(w.hash, 2)
    inside = np.flatnonzero(w.doc[:-1] == w.doc[1:]) if len(w.doc) > 1 else np.empty(0, np.int64)
    doc = np.concatenate([w.doc, w.doc[inside]])
    return doc, (np.concatenate([mix(w.hash), pairs[inside]]) % _U(buckets)).astype(np.int64)


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """docs with `t`: whether the document is in target (doc_id), which is bounded."""
    return docs.join(F.broadcast(target.select("doc_id", F.lit(True).alias("t"))), "doc_id", "left").withColumn("t", F.coalesce("t", F.lit(False)))


def model_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in each bucket, of all documents and of the target documents. docs: marked (text, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            flag = batch.column(1).to_numpy(zero_copy_only=False)
            for row, stop, data, offsets in chunks(batch.column(0)):
                doc, bucket = features(data, offsets, buckets)
                counts[0] += np.bincount(bucket, minlength=buckets)
                counts[1] += np.bincount(bucket[flag[row:stop][doc]], minlength=buckets)
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "target"])

    sums = docs.select("text", "t").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, buckets))
    for r in sums.collect():  # `buckets` rows
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out[0], out[1]


class Models:
    """Counts of raw and target text as two smoothed models.

    The raw model is smoothed evenly, by `smoothing` a bucket, the target model by as much in proportion to the raw one:
    a bucket that target text hasn't shown yet counts as in raw text.
    """

    def __init__(self, raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING):
        n = len(raw)
        self.target, self.total, self.added = target, target.sum(), smoothing * n
        self.p_raw = (raw + smoothing) / (raw.sum() + self.added)
        #: log of the importance ratio of each bucket, target model over raw model
        self.log_ratio = np.log((target + self.added * self.p_raw) / (self.total + self.added) / self.p_raw) if self.total else np.zeros(n)

    def log_weights(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Sums of log ratios of n texts' n-grams."""
        return np.bincount(doc, self.log_ratio[bucket], n).astype(np.float64)  # of nothing it gives whole numbers

    def without_themselves(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """log_weights() of target documents, each by the target model without its own n-grams."""
        pair, count = np.unique(doc * len(self.target) + bucket, return_counts=True)
        owner, at = np.divmod(pair, len(self.target))
        rest = self.total - np.bincount(doc, minlength=n)[owner]
        return np.bincount(owner, count * np.log((self.target[at] - count + self.added * self.p_raw[at]) / (rest + self.added) / self.p_raw[at]), n).astype(np.float64)


def log_weights(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_features, log_weight, alone) of each whole text; alone: without_themselves() of target documents with n-grams, else null."""
    known_models = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_models.value
        for batch in batches:
            flag = batch.column(2).to_numpy(zero_copy_only=False)
            for row, stop, data, offsets in chunks(batch.column(1)):
                doc, bucket = features(data, offsets, len(known.target))
                n = stop - row
                size = np.bincount(doc, minlength=n)
                mine = flag[row:stop][doc]
                alone = known.without_themselves(doc[mine], bucket[mine], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(size), pa.array(known.log_weights(doc, bucket, n)), pa.array(alone, mask=~(flag[row:stop] & (size > 0)))], ["doc_id", "n_features", "log_weight", "alone"])

    return docs.select("doc_id", "text", "t").mapInArrow(run, "doc_id long, n_features long, log_weight double, alone double")


def gumbel(seed: int, *keys: str) -> Column:
    """Gumbel noise that depends on the row alone, so that recomputed tasks agree."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(scored: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value, by histograms: each round counts `bins` bins of the interval that holds it, and is
    followed by one of that bin's values alone, until so few neighbouring doubles are left that they can be counted singly."""
    lo, hi = scored.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return float("inf")
    above = 0
    while hi > lo:
        width = (hi - lo) / bins
        inside = scored.where((F.col(column) >= lo) & (F.col(column) <= hi))
        if lo + width == lo or hi - width == hi:  # no more than 2 * bins doubles lie between them
            rest = inside.groupBy(column).count().orderBy(F.desc(column)).collect()
            for value, n in rest:
                above += n
                if above >= k:
                    return value
            return lo
        which = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
        counts = sorted(inside.groupBy(which.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for r in counts:
            if above + r["n"] >= k or r is counts[-1]:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def _target_ids(target: DataFrame, seed: int, max_target: int) -> DataFrame:
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_target)


def _scored(given: DataFrame, target: DataFrame, buckets: int, seed: int, max_target: int) -> tuple[DataFrame, Models]:
    docs = marked(given, _target_ids(target, seed, max_target))
    models = Models(*model_counts(docs, buckets))
    return log_weights(docs, models).withColumn("gumbel_score", F.col("log_weight") + gumbel(seed, "doc_id", "n_features")), models


def _threshold(scored: DataFrame, k: int | None, loss: float) -> float:
    """The k-th largest score; infinite if nothing is to stay. scored: a written table."""
    if k is None:
        targets = scored.where("alone is not null")
        n = targets.count()
        if not n:
            return float("-inf")
        least = kth_largest(targets, "alone", n - math.floor(TAIL * n))
        below = targets.where(F.col("alone") < least).agg(F.avg(least - F.col("alone"))).first()[0] or 0.0
        least -= below * math.log(max(1.0, TAIL / loss))
        k = scored.where((F.col("log_weight") >= least) | (F.col("n_features") == 0)).count()
    return kth_largest(scored, "gumbel_score", k) if k > 0 else float("inf")


@tidied
def resample(docs: DataFrame, target: DataFrame, k: int | None = None, loss: float = LOSS, buckets: int = BUCKETS, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_score, kept).

    target: (doc_id) of documents known to be good, at most `max_target` of which are used (those with the least
    hashes); raw counts and weights cover all documents. k defaults to the number of documents without words and
    of those that weigh at least as much as a share of 1 - `loss` of the target documents should, each weighed without itself. Documents that tie
    with the k-th stay as well. Null and empty texts have weight 1 (log 0). Repeated rows get equal scores; null ids are scored, but
    are never target documents. Without any target document all weights are 1 and, unless k is given, all documents stay.
    """
    scored, _ = _scored(id_text(docs, id_col, text_col), target, buckets, seed, max_target)
    scored = written(scored, "scored")
    return scored.withColumn("kept", F.col("gumbel_score") >= F.lit(_threshold(scored, k, loss)))


@tidied
def keep_sampled(docs: DataFrame, target: DataFrame, k: int | None = None, loss: float = LOSS, buckets: int = BUCKETS, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> DataFrame:
    """The rows of docs, all their columns, that resample() keeps: scored anew in place, so that no text is shuffled."""
    scored, models = _scored(id_text(docs, id_col, text_col), target, buckets, seed, max_target)
    scored = written(scored, "scored")
    least = _threshold(scored, k, loss)
    discard(scored)
    known_models = docs.sparkSession.sparkContext.broadcast(models)
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    at = docs.columns.index(text_col) if text_col in docs.columns else [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_models.value
        for batch in batches:
            rows = batch.column(0)
            for row, stop, data, offsets in chunks(pc.fill_null(pc.struct_field(rows, [at]), "")):
                doc, bucket = features(data, offsets, len(known.target))
                n = stop - row
                yield pa.RecordBatch.from_arrays([rows.slice(row, n), pa.array(np.bincount(doc, minlength=n)), pa.array(known.log_weights(doc, bucket, n))], ["row", "n_features", "log_weight"])

    schema = T.StructType([packed.schema["row"], T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    found = packed.mapInArrow(run, schema).withColumn("doc_id", F.col("row").getField(id_col).cast("long"))
    found = found.where(F.col("log_weight") + gumbel(seed, "doc_id", "n_features") >= F.lit(least))
    return found.select("row.*")


def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), good_documents(spark, sf_dir)).drop("alone")
