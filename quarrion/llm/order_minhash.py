"""Order MinHash: fingerprints whose likeness follows edit distance.

A text's k-mers of code points get occurrence numbers, so that repeats count. For each of `rows` hash functions the
`PICK` least numbered k-mers are selected, put back in text order and hashed as a tuple. Two texts agree in a
row if they share the selected k-mers in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, mix, rolling, table
from .neighbours import bucket_of, cuts, dealt, ends, partitions_for

K = 8
ROWS = 32
PICK = 2
_BLOCK = 8192
_U = np.uint64
_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * _U(2) + _U(1)
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit values of the k-mers with their occurrence numbers, in text order; a shorter text is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points)
    if not n:
        return np.empty(0, np.uint64)
    hashes = rolling(points + _U(1), k) if n >= k else rolling(points + _U(1), n)
    n = len(hashes)
    bits = _U(n.bit_length())
    order = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    value = order >> bits
    same = np.flatnonzero(value[1:] == value[:-1])
    if not len(same):
        return hashes
    run = np.arange(n)
    first = np.ones(n, bool)
    first[same + 1] = False
    occurrence = run - np.maximum.accumulate(np.where(first, run, 0))
    out = hashes.copy()
    again = occurrence > 0
    at = (order[again] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    with np.errstate(over="ignore"):
        out[at] = mix(hashes[at] + occurrence[again].astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return out


def signature(text: str, rows: int = ROWS, k: int = K) -> np.ndarray:
    """`rows` 32-bit values; all zero for an empty text."""
    kmers = numbered_kmers(text, k)
    n = len(kmers)
    if not n:
        return np.zeros(rows, np.uint32)
    xor, odd = _XOR[:rows, None], _ODD[:rows, None]
    at = np.arange(rows)
    values, places = [], []
    for begin in range(0, n, _BLOCK):
        with np.errstate(over="ignore"):
            h = (kmers[None, begin : begin + _BLOCK] ^ xor) * odd
        for _ in range(min(PICK, h.shape[1])):
            least = h.argmin(1)
            values.append(h[at, least])
            places.append(least + begin)
            h[at, least] = _TOP
    value, place = np.array(values), np.array(places)
    if len(value) > PICK:
        chosen = np.argsort(value, axis=0, kind="stable")[:PICK]
        place = np.take_along_axis(place, chosen, 0)
    place.sort(axis=0)
    out = np.full(rows, _U(n if n < PICK else PICK), np.uint64)
    with np.errstate(over="ignore"):
        for row in place:
            out = mix(out * _U(0x9E3779B97F4A7C15) + kmers[row])
    return (out >> _U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, rows: int = ROWS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint): fingerprint is 8 hex digits a row. Null texts count as empty; rows that repeat each give a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([signature(t, rows, k).astype(">u4").tobytes().hex() for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_probe(docs: DataFrame, rows: int = ROWS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited form of itself and against the next document.

    Documents stand in descending order of doc_id (null ids last, repeated ids by text), the first behind the last. The
    edited text has its last third replaced by the beginning of the next document.
    """
    spark = docs.sparkSession
    given = id_text(docs, id_col, text_col)
    partitions = partitions_for(spark)
    # descending ids as ascending keys: ~id = -id - 1 has no overflow
    given = given.select(F.expr("~doc_id").alias("key"), "doc_id", "text")
    keys = docs.select(F.expr(f"~cast(`{id_col}` as bigint)").alias("key"))
    nulls = docs.where(F.col(id_col).isNull()).limit(1).count() > 0
    if nulls:  # null ids stand behind all others
        given = given.withColumn("key", F.coalesce("key", F.lit((1 << 63) - 1)))
        keys = keys.select(F.coalesce("key", F.lit((1 << 63) - 1)).alias("key"))
    bounds = cuts(keys, "key", 8 * partitions)
    spans = ends(keys, "key", bucket_of(F.col("key"), bounds, "bigint"))
    copies: dict[int, list[int]] = {}
    for i, (_, lo, _) in enumerate(spans):
        copies.setdefault(lo, []).append(spans[i - 1][0])
    rows_of = dealt(given, "key", "bigint", bounds, copies, partitions).sortWithinPartitions("bucket", "copy", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, bucket, done = None, None, False  # held: the row that waits for the next one

        def pair(row, nxt):
            text, mark = row[1], row[2]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + nxt[1][:cut] if cut else text
            other = signature(edited, rows, k) if cut else mark
            show = lambda s: s.astype(">u4").tobytes().hex()
            out.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(mark), show(other), likeness(mark, other), likeness(mark, nxt[2])))

        def flush():
            names = [c.split()[0] for c in _OUT.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return got

        for batch in batches:
            ids, texts, buckets, copy = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "bucket", "copy"))
            for i in range(batch.num_rows):
                b, is_copy = buckets[i].as_py(), copy[i].as_py()
                if b != bucket:
                    held, bucket, done = None, b, False
                if done:
                    continue
                text = texts[i].as_py()
                row = (ids[i].as_py(), text, signature(text, rows, k))
                if held is not None:
                    pair(held, row)
                held, done = row, bool(is_copy)
                if len(out) >= 512:
                    yield flush()
        if out:
            yield flush()

    return rows_of.select("doc_id", "text", "bucket", "copy").mapInArrow(run, _OUT)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))
