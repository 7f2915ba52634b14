"""Substring dedup: word windows that begin in an earlier document as well are removed.

Rabin-Karp hashes stand for all windows of `width` words. A window can only repeat if its minimiser (the least hash
of its runs of width // 2 words) does, and minimisers are a few hundredths of the positions. So Spark first counts
minimisers, then the hashes of those windows whose minimiser occurs in two documents. What is known to be shared
reaches the second reading as a bitmap of bounded size: its false hits cost rows to count, never results.
Repeated windows of a document merge into maximal intervals of words, which are removed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, id_text, joined_by_key, mix, rolling, table, tidied, words_of, written

WIDTH = 50
#: Bits of the bitmap: 16 for each shared minimiser, within these bounds (64 MB at most).
MIN_BITS, MAX_BITS = 20, 29
#: Stands for a null id, which counts as larger than all others.
NO_ID = (1 << 63) - 1
_U = np.uint64


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


def windows(word_hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, minimiser) of each window that lies in one document."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    short = max(1, width // 2)
    least = _sliding_min(rolling(word_hashes, short), width - short + 1)
    start = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return start, mix(least[start])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def minimisers(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0))
            for row, stop, data, offsets in chunks(batch.column(1)):
                w = words_of(data, offsets)
                start, least = windows(w.hash, w.doc, width)
                if len(start):
                    doc = w.doc[start]
                    new = np.ones(len(start), bool)
                    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[row:stop][doc[new]])], ["m", "doc_id"])

    return docs.mapInArrow(run, "m long, doc_id long")


def shared_bitmap(mins: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap, its number of bits as a power of 2) of the minimisers that two documents have."""
    shared = written(mins.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"), "shared")
    power = min(MAX_BITS, max(MIN_BITS, (16 * shared.count()).bit_length()))
    marks = (
        shared.select((F.shiftrightunsigned("m", 64 - power) + 1).alias("x"))
        .groupBy(F.expr("bitmap_bucket_number(x)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    )
    bits = np.zeros(1 << (power - 3), np.uint8)
    for r in marks.toLocalIterator():  # 4 KB for each 32768 bits
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    discard(shared)
    return bits, power


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, found array<long>): hashes of the windows of each document that begin in a smaller doc_id too."""
    spark = docs.sparkSession
    bits, power = shared_bitmap(minimisers(docs, width))
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = _ids(batch.column(0))
            for row, stop, data, offsets in chunks(batch.column(1)):
                w = words_of(data, offsets)
                start, least = windows(w.hash, w.doc, width)
                bit = (least >> _U(64 - power)).astype(np.int64)
                start = start[(known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                if len(start):
                    found = rolling(w.hash, width)[start]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids[row:stop][w.doc[start]])], ["h", "doc_id"])

    seen = docs.mapInArrow(run, "h long, doc_id long")
    least = seen.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).where("lo < hi").drop("hi")
    later = joined_by_key(seen, written(least, "repeated"), ["h"], "doc_id").where("doc_id > lo")
    return later.groupBy("doc_id").agg(F.collect_set("h").alias("found"))


def kept_words(text: bytes, found: np.ndarray | None, width: int) -> tuple[list[bytes], np.ndarray]:
    """(words, whether each is kept)."""
    words = text.split()  # at the same six bytes as SPACE_BYTES
    keep = np.ones(len(words), bool)
    if found is not None and len(found) and len(words) >= width:
        w = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        hit = np.flatnonzero(np.isin(rolling(w.hash, width).view(np.int64), found))
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + width, -1)
        keep = np.cumsum(change[:-1]) == 0
    return words, keep


def intervals(keep: np.ndarray) -> list[dict]:
    """Maximal runs of removed words as {begin, end} (word numbers, end exclusive)."""
    edge = np.diff(np.concatenate([[0], (~keep).astype(np.int8), [0]]))
    return [{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


@tidied
def _applied(docs: DataFrame, width: int, schema: str, row_of) -> DataFrame:
    found = repeated_windows(docs, width)
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID)))
    joined = keyed.join(found.withColumnRenamed("doc_id", "_key"), "_key", "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts, hits = (part.column(i) for i in range(3))
                rows = []
                for i in range(part.num_rows):
                    hit = hits[i].values.to_numpy(zero_copy_only=False) if hits[i].is_valid else None
                    rows.append((ids[i].as_py(), *row_of(*kept_words(texts[i].as_buffer().to_pybytes(), hit, width))))
                names = [c.split()[0] for c in schema.split(", ")]
                kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return joined.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, kept string, removed array<struct<begin, end>>): kept words joined by one space.

    Windows are judged on the input. The document with the smallest id keeps its words. Rows with the same id count
    as one document; null ids count as larger than all others; null and empty texts have no words.
    """
    found = _applied(id_text(docs, id_col, text_col), width, "doc_id long, n_words long, kept string, removed string", lambda words, keep: (len(words), b" ".join([w for w, k in zip(words, keep, strict=True) if k]).decode(), json.dumps(intervals(keep))))
    return found.withColumn("removed", F.from_json("removed", "array<struct<begin:int,end:int>>"))


def _digest(words: list[bytes], keep: np.ndarray) -> tuple:
    kept = words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(id_text(table(spark, sf_dir, "documents")), WIDTH, "doc_id long, n_words long, n_removed long, kept_sha256 string", _digest)


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) AS h FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM g) WHERE lo < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s FROM a ANTI JOIN p USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
