"""Exact vector search: filter first, score, keep the best k (score down, id up)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import METRICS
from . import tiles


def literal_vector(values) -> Column:
    """A query vector as one folded constant."""
    return F.expr("array(" + ",".join(f"float('{float(v)!r}')" for v in values) + ")")


_REAL = {"inner", "cosine", "euclidean"}


def _scores(q: np.ndarray, column: pa.Array, metric: str) -> np.ndarray:
    """Scores of queries (rows) with vectors (columns), greater for nearer: metrics over the shorter length, null elements left out."""
    width = q.shape[1]
    lengths = np.asarray(pc.list_value_length(column))
    first = np.concatenate([[0], np.cumsum(lengths)])
    values = column.flatten()
    whole = lengths == width
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()).astype(np.int64))])
        whole &= gaps[first[1:]] == gaps[first[:-1]]
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls as NaN
    m = (flat if whole.all() else flat[np.repeat(whole, lengths)]).reshape(-1, width)
    s = q @ m.T
    if metric == "cosine":
        d = np.sqrt(np.outer((q * q).sum(1), (m * m).sum(1)))
        s = np.where(d <= 1e-12, 0.0, np.clip(s / np.where(d <= 1e-12, 1, d), -1, 1))
    elif metric == "euclidean":
        s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (m * m).sum(1)[None] - 2 * s))
    if whole.all():
        return s
    out = np.empty((len(q), len(lengths)))
    out[:, whole] = s
    for i in np.flatnonzero(~whole):
        v = flat[first[i] : first[i + 1]]
        there = ~np.isnan(v[:width])
        a, b = q[:, : len(there)][:, there], v[:width][there]
        if metric == "euclidean":
            out[:, i] = -np.sqrt(((a - b) ** 2).sum(1))
            continue
        out[:, i] = a @ b
        if metric == "cosine":
            d = np.sqrt((q * q).sum(1) * np.nansum(v * v))
            out[:, i] = np.where(d <= 1e-12, 0.0, np.clip(out[:, i] / np.where(d <= 1e-12, 1, d), -1, 1))
    return out


def _best_of(scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of each query's k best, by score down, then id up."""
    n = scores.shape[1]
    if n > k:
        bar = np.partition(scores, n - k, axis=1)[:, n - k]
        query, place = np.nonzero(scores >= bar[:, None])
    else:
        query, place = np.repeat(np.arange(len(scores)), n), np.tile(np.arange(n), len(scores))
    rank = np.empty(n, np.int64)
    rank[np.asarray(pc.sort_indices(ids))] = np.arange(n)
    score = scores[query, place]
    order = np.lexsort((rank[place], -score, query))
    query, place, score = query[order], place[order], score[order]
    inside = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[inside], place[inside], score[inside]


def top_k(vectors: DataFrame, query, k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k best. Nothing for k = 0; null vectors are left out. Plan: filtered scan, one top-k per task, one merge.

    Inner products, cosines and distances are taken from whole Arrow batches at once; a batch passes on its k best.
    """
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where(F.col(vector_col).isNotNull())
    if metric in _REAL and k > 0:
        q = np.array([query], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, place, score = _best_of(_scores(q, batch.column(1), metric), batch.column(0), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(score)], [id_col, "score"])

        schema = T.StructType([vectors.select(id_col).schema[0], T.StructField("score", T.DoubleType())])
        found = rows.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, schema)
        return found.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    score = METRICS[metric](literal_vector(query), F.col(vector_col))
    return rows.select(F.col(id_col), score.alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, id, score, rank) for a stated set of queries (query_id, embedding), in blocks.

    Up to `block` queries travel to the vectors' tasks as one matrix; a task keeps its k best for each query, so the
    shuffle carries k rows a query and task, whatever the number of vectors. More are dealt out in groups that meet slices
    of the vectors, and neither passes through the driver.
    """
    if metric not in _REAL:
        raise ValueError(f"metric must be one of {sorted(_REAL)}")
    asked = queries.select("query_id", "embedding")
    if queries.limit(block + 1).count() > block:
        return _ranked(_tiled(vectors, asked, k, metric, id_col, vector_col), k, id_col)
    frame = asked.toPandas()
    if not len(frame):
        return vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return _ranked(_one_block(vectors, frame, k, metric, id_col, vector_col), k, id_col)


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that a task holds at most, and tasks that share all pairs at least.
HELD, TASKS = 1 << 15, 64


def _tiled(vectors: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, id, score): the k best of each slice of the vectors. Groups of queries meet slices of vectors; the driver holds neither."""
    n, asked = vectors.count(), queries.count()
    groups = -(-asked // HELD)
    slices = max(1, min(-(-TASKS // groups), -(-n // 1024)))
    count = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    zero = F.lit(0).cast("long").alias("_k2")
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    q = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    small = "array<float>" if dict(vectors.dtypes)[vector_col] == dict(queries.dtypes)["embedding"] == "array<float>" else "array<double>"
    q, v = (x.withColumn("v", F.col("v").cast(small)) for x in (q, v))
    held = q.select("id", "v", part("id", groups).alias("_k0"), count(slices).alias("_k1"), zero)
    streamed = v.select("id", "v", count(groups).alias("_k0"), part("id", slices).alias("_k1"), zero)
    return tiles.met(held, streamed, groups * slices, lambda table: _Best(table, k, metric, id_col).both(), f"query_id long, {id_col} long, score double")


class _Best:
    """The k best of streamed vectors for each held query, by score down, then id up.

    Products in single precision find what can reach a query's k-th score, with room for their rounding; scores are then summed in
    double precision in the order of places, so that equal vectors score alike. Odd vectors are scored in full."""

    def __init__(self, table: pa.Table, k: int, metric: str, id_col: str):
        self.ids = table["id"].to_numpy()
        self.q, whole = tiles.matrix(table["v"].combine_chunks())
        if len(whole) < len(self.ids):
            raise ValueError("queries must have equal lengths and no null elements")
        self.k, self.metric, self.id_col = k, metric, id_col
        self.square = _in_order(self.q, self.q)
        self.norm = np.sqrt(self.square)
        self.fast = metric != "euclidean" and bool((self.norm > 1e-6).all() and (self.norm < 1e15).all())
        self.unit = (self.q / np.where(self.norm > 0, self.norm, 1)[:, None]).astype(np.float32) if self.fast else None
        self.room = (self.q.shape[1] + 8) * 2.4e-7
        self.bar = np.full(len(self.ids), -np.inf)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def both(self):
        return self.step, self.end

    def step(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, column = batch.column("id").to_numpy(), batch.column("v")
        rest = np.ones(len(ids), bool)
        m, whole = tiles.matrix(column)
        if self.fast and m.shape[1] == self.q.shape[1]:
            square = _in_order(m, m)
            norm = np.sqrt(square)
            plain = (norm > 1e-6) & (norm < 1e15)
            m, square, norm, whole = m[plain], square[plain], norm[plain], whole[plain]
            rest[whole] = False
            for x in range(0, len(m), 1024):
                self._products(m[x : x + 1024], square[x : x + 1024], norm[x : x + 1024], ids[whole[x : x + 1024]])
        odd = np.flatnonzero(rest)
        for x in range(0, len(odd), 256):
            at = odd[x : x + 256]
            for y in range(0, len(self.q), 2048):
                query, place, score = _best_of(_scores(self.q[y : y + 2048], column.take(pa.array(at)), self.metric), pa.array(ids[at]), self.k)
                self.found.append((query + y, ids[at][place], score))
            self._settle()
        return iter(())

    def _products(self, m: np.ndarray, square: np.ndarray, norm: np.ndarray, ids: np.ndarray) -> None:
        scale = norm if self.metric == "cosine" else np.full(len(m), norm.max())
        unit = (m / scale[:, None]).astype(np.float32).T.copy()
        for y in range(0, len(self.q), 1024):
            s = self.unit[y : y + 1024] @ unit
            bar = self.bar[y : y + 1024] / (1 if self.metric == "cosine" else self.norm[y : y + 1024] * scale[0]) - self.room
            open_ = np.flatnonzero(np.isneginf(bar))
            if len(open_) and s.shape[1] > self.k:
                bar[open_] = np.partition(s[open_], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * self.room
            i, j = np.nonzero(s >= bar[:, None].astype(np.float64).astype(np.float32) - np.float32(1e-7))
            if len(i):
                score = _in_order(self.q[y + i], m[j])
                if self.metric == "cosine":
                    score = np.clip(score / np.sqrt(self.square[y + i] * square[j]), -1, 1)
                self.found.append((y + i, ids[j], score))
        if sum(len(x[0]) for x in self.found[1:]) > len(self.q) // 2:
            self._settle()

    def _settle(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.bar[query[last]] = score[last]
        inside = place < self.k
        self.found = [(query[inside], ids[inside], score[inside])]

    def end(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        query, ids, score = self.found[0]
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(ids), pa.array(score)], ["query_id", self.id_col, "score"])


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first place to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _one_block(vectors: DataFrame, frame: pd.DataFrame, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    ids = frame["query_id"].to_numpy()
    q = np.array(frame["embedding"].tolist(), dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            a, place, s = _best_of(_scores(q, batch.column(1), metric), batch.column(0), k)
            query, found, score = np.append(query, a), np.append(found, batch.column(0).to_numpy()[place]), np.append(score, s)
            order = np.lexsort((found, -score, query))
            query, found, score = query[order], found[order], score[order]
            inside = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, found, score = query[inside], found[inside], score[inside]
        yield pa.RecordBatch.from_arrays([pa.array(ids[query].astype(np.int64)), pa.array(found), pa.array(score)], ["query_id", id_col, "score"])

    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"query_id long, {id_col} long, score double")
