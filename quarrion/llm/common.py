"""Shared helpers: inputs, the shared folder, byte-level tokenisation in NumPy."""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder

#: White space as the contracts define it: space and 0x09-0x0D, all single bytes in UTF-8.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_CLASS = r"[ \x09-\x0D]+"
#: Bytes of text handled at once in NumPy (each byte takes about 40 bytes of working memory).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only on one machine whose session names none."""
    return shared_folder(spark).rstrip("/")


#: Tables written by the operator that runs.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, so that a lost executor costs no recomputation.

    Once the table is there nothing needs the shuffles that made it; Spark deletes their files at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrion-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() once nothing reads it any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/quarrion-" in path:
            _delete(df.sparkSession, path)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, whose written() tables are deleted at its end but for those that its result reads."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        token = _made.set([])
        try:
            out = operator(*args, **kwargs)
            made = _made.get()
        finally:
            _made.reset(token)
        needed = {p.rsplit("/", 1)[0].rpartition("quarrion-")[2] for p in out.inputFiles()}
        for path in made:
            if path.rpartition("quarrion-")[2] not in needed:
                _delete(out.sparkSession, path)
        return out

    return run


#: Bytes of an Arrow batch between the JVM and Python (Spark's default is 64 MB). A task has several batches in hand on both
#: sides, and memory that large ones took stays with the process.
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most about BATCH_BYTES from now on; no result depends on it, smaller limits stay.

    The limit isn't put back: results are lazy, and the plan reads it when they are written."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Rows of a key for it to be joined where its rows are, and such keys at most (16 to 40 bytes each); with more of them, the bar rises.
HOT_ROWS, MAX_HOT_KEYS = 128, 1 << 19


def joined_by_key(rows: DataFrame, groups: DataFrame, on: list[str], spread: str) -> DataFrame:
    """rows joined with groups, a written table with one row a key and `c`, the number of its rows.

    Keys with many rows are broadcast: their rows stay in their tasks, or are dealt out by the column `spread`, so that no
    task gets a key's rows all together. The result has groups' columns but for c.
    """
    values = [x for x in groups.columns if x not in (*on, "c")]
    least = HOT_ROWS
    while (n := groups.where(F.col("c") >= least).count()) > MAX_HOT_KEYS:
        least *= 2
    if not n:
        return rows.join(groups.drop("c"), on).select(*rows.columns, *values)
    hot = groups.where(F.col("c") >= least).select(*on, F.struct(*values).alias("_hot"))
    rest = groups.where(F.col("c") < least).select(*on, F.lit(0).alias("_salt"), F.struct(*values).alias("_rest"))
    both = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")))
    both = both.join(rest, [*on, "_salt"], "left").where(F.coalesce("_hot", "_rest").isNotNull())
    return both.select(*rows.columns, *[F.coalesce(F.col("_hot"), F.col("_rest"))[x].alias(x) for x in values])


def is_separator(separators: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(separators)] = True
    return lut


SPACES = is_separator(SPACE_BYTES)
#: Everything in ASCII but letters parts words; bytes of other scripts belong to them.
NON_LETTERS = is_separator(bytes(b for b in range(128) if not chr(b).isalpha()))
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32

_U = np.uint64
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: each input bit changes each output bit with chance 1/2."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(up, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` values: sum of value * base**offset modulo 2**64, then mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        if width <= 8:
            for j in range(width):
                out += values[j : j + n] * _U(pow(_BASE, j, 1 << 64))
        else:
            size = 1 << 18
            for at in range(0, n, size):
                stop = min(n, at + size)
                up, down = powers(stop - at + width)
                sums = np.zeros(stop - at + width, np.uint64)
                np.cumsum(values[at : stop + width - 1] * up[: stop - at + width - 1], out=sums[1:])
                out[at:stop] = (sums[width:] - sums[:-width]) * down[: stop - at]
    return mix(out)


class Words:
    """Words of several texts: text of each word, its byte span in the chunk, its 64-bit hash."""

    __slots__ = ("doc", "start", "end", "hash", "first")

    def __init__(self, doc, start, end, hashes, n_docs):
        self.doc, self.start, self.end, self.hash = doc, start, end, hashes
        #: first[i]:first[i + 1] are the words of text i.
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray = AS_IS) -> Words:
    """data: bytes of texts one after another; offsets: where each begins, and the end."""
    n_docs, total = len(offsets) - 1, int(offsets[-1])
    starts, ends, hashes = [], [], []
    table_of = _RANDOM[fold]
    breaks = np.zeros(total + 1, bool)
    breaks[offsets] = True
    at = 0
    while at < total:
        stop = min(total, at + CHUNK_BYTES)
        while stop < total:  # never cut a word
            gap = np.flatnonzero(separators[data[at:stop]] | breaks[at + 1 : stop + 1])
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(total, stop + CHUNK_BYTES)
        piece = data[at:stop]
        inside = ~separators[piece]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | breaks[at + 1 : stop]
        finishes[:-1] &= ~inside[1:] | breaks[at + 1 : stop]
        s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        up, down = powers(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(table_of[piece] * up[:-1], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    start = join(starts, np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, join(ends, np.int64), join(hashes, np.uint64), n_docs)


def chunks(column: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of texts; one text may exceed the budget."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string())
    n = len(wide)
    if not n:
        return
    _, offset_buffer, data_buffer = wide.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[wide.offset : wide.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + budget, side="right")) - 1)
        stop = min(stop, n)
        base = int(offsets[row])
        yield row, stop, data[base : int(offsets[stop])], offsets[row : stop + 1] - base
        row = stop
