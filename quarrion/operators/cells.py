"""Vector search over cells, lattice addresses and one-byte codes: partitions that bounds rule out aren't scored.

Centres are fitted on a bounded sample; every row is indexed. A search reads the cells' sizes and radii (one row a cell), then
the cells that may hold a better hit. Without a limit of cells the result is that of the full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import top_k

#: Vectors that centres are fitted on: those with the least hashes of their ids.
MAX_SAMPLE = 20_000
#: Room for rounding in bounds, as a share of the greatest value.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; all must be as long as the first and without nulls."""
    lengths = np.asarray(pc.list_value_length(column))
    if len(lengths) and ((lengths != lengths[0]).any() or column.flatten().null_count):
        raise ValueError("indexed vectors must have the same length and no null elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(-1, keepdims=True))
    return np.where(n > 1e-12, m / np.where(n > 1e-12, n, 1), 0)


def fit_cells(vectors: DataFrame, cells: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = 8, most: int = MAX_SAMPLE) -> np.ndarray:
    """Centres of at most `cells` cells, by k-means from evenly spaced rows of a sample of at most `most` vectors."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"))
    m = np.array([r["v"] for r in rows.orderBy("h", "i").limit(most).collect()], np.float64)  # a bounded sample
    if not len(m):
        return np.empty((0, 0))
    m = _unit(m) if metric == "cosine" else m
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(rounds):
        nearest = _nearest(m, centres)[0]
        for c in np.unique(nearest):
            centres[c] = m[nearest == c].mean(0)
    return centres


def _nearest(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum(0, (m * m).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * m @ centres.T)
    at = d.argmin(1)
    return at, np.sqrt(((m - centres[at]) ** 2).sum(1))


def assign(vectors: DataFrame, centres: np.ndarray, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, cell, distance): each vector with its nearest centre. Write it partitioned by cell to let searches prune files."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                cell, distance = _nearest(_unit(m) if metric == "cosine" else m, centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], [id_col, vector_col, "cell", "distance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cell int, distance double")


def cell_sizes(assigned: DataFrame) -> DataFrame:
    """(cell, n, radius): one row a cell."""
    return assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))


def _bounds(query: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """What no vector of a cell can beat."""
    if metric == "euclidean":
        best = -np.maximum(0, np.sqrt(((centres - query) ** 2).sum(1)) - radius)
    else:
        q = _unit(query) if metric == "cosine" else query
        best = centres @ q + np.sqrt(q @ q) * radius
        if metric == "cosine":
            best = np.minimum(1.0, best)
    return best + SLACK * (1 + np.abs(best))


def cell_top_k(assigned: DataFrame, sizes: DataFrame, centres: np.ndarray, query, k: int, metric: str = "cosine", most_cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score, bound, certified): the k best, the bound of the cells left out, and whether none of them can hold a better one.

    The cells with the greatest bounds that hold k vectors together come first; then those whose bounds reach the k-th score
    found there. With most_cells the search stops early, and hits that aren't proven say so. metric: inner, cosine or euclidean.
    """
    table = sizes.orderBy("cell").collect()  # one row a cell, as many as there are centres
    columns = [F.col(id_col), F.col("score")]
    if not table or k <= 0:
        return top_k(assigned.limit(0), [0.0], max(k, 0), metric, None, id_col, vector_col).select(*columns, F.lit(None).cast("double").alias("bound"), F.lit(True).alias("certified"))
    cell = np.array([r["cell"] for r in table])
    n = np.array([r["n"] for r in table])
    bound = _bounds(np.array(query, np.float64), centres[cell], np.array([r["radius"] for r in table]), metric)
    order = np.lexsort((cell, -bound))
    limit = len(order) if most_cells is None else max(1, most_cells)
    first = order[: min(limit, int(np.searchsorted(np.cumsum(n[order]), k)) + 1)]
    among = lambda at: F.col("cell").isin([int(c) for c in cell[at]])
    hits = top_k(assigned, query, k, metric, among(first), id_col, vector_col)
    rest = order[len(first) : limit]
    if len(rest):
        found = hits.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if found["n"] == k:
            rest = rest[bound[rest] >= found["s"]]
        if len(rest):
            hits = top_k(assigned, query, k, metric, among(np.concatenate([first, rest])), id_col, vector_col)
    left = np.setdiff1d(np.arange(len(order)), np.concatenate([first, rest]))
    out = float(bound[left].max()) if len(left) else None
    certified = F.lit(True) if out is None else F.col("score") > out
    return hits.select(*columns, F.lit(out).cast("double").alias("bound"), certified.alias("certified"))


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8) -> DataFrame:
    """(id, code, scale, error): one byte an element, a scale for each block of eight, and the distance of the decoded vector."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            wide = np.pad(m, ((0, 0), (0, -m.shape[1] % block))).reshape(len(m), -1, block)
            scale = (np.abs(wide).max(2) / 127).astype(np.float32).astype(np.float64)
            code = np.clip(np.rint(wide / np.where(scale > 0, scale, 1)[:, :, None]), -127, 127)
            error = np.sqrt(((wide - code * scale[:, :, None]) ** 2).sum((1, 2)))
            codes = pa.array([c.tobytes() for c in code.astype(np.int8).reshape(len(m), -1)], pa.binary())
            scales = pa.array(scale.astype(np.float32).tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, scales, pa.array(error)], [id_col, "code", "scale", "error"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, code binary, scale array<float>, error double")


def coded_top_k(codes: DataFrame, vectors: DataFrame, query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8) -> DataFrame:
    """(id, score): the k greatest inner products, exactly. Codes bound each product from below and above; vectors whose upper
    bound reaches the k-th lower bound are scored in full."""
    q = np.array(query, np.float64)
    wide = np.pad(q, (0, -len(q) % block)).reshape(-1, block)
    size = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1, block)
            scale = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            about = (np.einsum("nbi,bi->nb", code.astype(np.float64), wide) * scale).sum(1)
            room = size * batch.column(3).to_numpy() + SLACK * (1 + np.abs(about))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(about - room), pa.array(about + room)], [id_col, "low", "high"])

    bounds = codes.select(id_col, "code", "scale", "error").mapInArrow(run, f"`{id_col}` {codes.schema[id_col].dataType.simpleString()}, low double, high double")
    lows = [r["low"] for r in bounds.select("low").orderBy(F.desc("low")).limit(max(k, 0)).collect()]  # k numbers
    near = bounds.where(F.col("high") >= lows[-1]) if lows else bounds.limit(0)
    return top_k(vectors.join(near.select(id_col), id_col, "left_semi"), query, k, "inner", None, id_col, vector_col)


def _lattice(x: np.ndarray) -> np.ndarray:
    """The nearest point of the E8 lattice to each row of eight, doubled; the integer coset wins ties."""
    best, least = None, None
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.sign(y) * np.floor(np.abs(y) + 0.5)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        worst = np.abs(y - r)[odd].argmax(1)
        r[odd, worst] += np.where(y[odd, worst] >= r[odd, worst], 1, -1)
        point = r + shift
        distance = ((x - point) ** 2).sum(1)
        if best is None:
            best, least = point, distance
        else:
            best = np.where((distance < least)[:, None], point, best)
    return (best * 2).astype(np.int64)


def addressed(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, address): the nearest lattice point of each block of eight elements times `scale`, doubled to whole bytes. Points beyond
    a byte are cut to it."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1)) * scale
                wide = np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))
                points = np.clip(_lattice(wide.reshape(-1, 8)), -128, 127).astype(np.int8).reshape(wide.shape)
                address = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, wide.shape[1], dtype=np.int32)), pa.array(points.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), address], [id_col, "address"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, address array<tinyint>")


def address_top_k(addresses: DataFrame, vectors: DataFrame, query, address: list[int], k: int, candidates: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): candidates are the rows whose lattice points lie nearest to the query's; they are scored in full.

    Not exact: measure recall with retrieval's recall_at_k against top_k. More candidates, more recall.
    """
    there = F.expr("array(" + ",".join(str(int(x)) for x in address) + ")")
    far = F.aggregate(F.zip_with("address", there, lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, x: s + x)
    near = addresses.select(id_col, far.alias("_far")).orderBy("_far", id_col).limit(candidates).select(id_col)
    return top_k(vectors.join(F.broadcast(near), id_col, "left_semi"), query, k, metric, None, id_col, vector_col)  # `candidates` ids
