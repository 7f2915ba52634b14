"""Toxicity by the nearest labelled examples.

Labelled examples and documents become TF-IDF vectors over all terms of the examples; terms that tell the labels apart weigh
more. Terms of few examples have posting lists, which give each query's products with all examples at once. Frequent
terms are columns of dense blocks of examples, with the greatest weight of each term in each block: a
query's products with these maxima, beside the best product from posting lists in the block, bound its cosine with every
example of the block, so blocks are visited only where the bound reaches the k-th best cosine so far: the k nearest are exact.
Their votes, weighted by cosine and by how rare their class is in the index, give the score, and they are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_LETTERS, chunks, id_text, table, words_of

#: Labelled rows that the index is fitted on, at most (half of them of each label).
MAX_EXAMPLES = 8192
#: Weight of terms whose presence differs between the labels; the others weigh 1.
SELECTIVE_WEIGHT = 10.0
#: Terms in more than this share of the examples are columns of the blocks; the others have posting lists.
FREQUENT = 1 / 16
#: Queries, and products from posting lists, that are handled at once.
QUERIES, PRODUCTS = 256, 1 << 21
#: Examples in a block.
BLOCK = 64
NEIGHBOURS = 32
#: Weight of the prior against votes of cosine 1.
PRIOR_WEIGHT = 0.5


def term_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, occurrences) of the distinct terms of each text: runs of letters, case folded."""
    w = words_of(data, offsets, NON_LETTERS, LOWER)
    if not len(w.hash):
        return w.doc, w.hash, np.empty(0, np.int64)
    order = np.lexsort((w.hash, w.doc))
    doc, term = w.doc[order], w.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _selectivity(column: np.ndarray, label: np.ndarray, shown: np.ndarray, n_terms: int) -> np.ndarray:
    """Weights of terms by the likelihood ratio of their presence. column, label: of each (example, term); shown: examples of each label."""
    n, pos = float(shown.sum()), float(shown[1])
    if not pos or pos == n:
        return np.ones(n_terms)
    d, a = np.bincount(column, minlength=n_terms).astype(np.float64), np.bincount(column, weights=label, minlength=n_terms)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.divide(seen, expected, out=np.ones(n_terms), where=seen > 0))

    share = pos / n
    ratio = 2 * (part(a, d * share) + part(d - a, d * (1 - share)) + part(pos - a, (n - d) * share) + part(n - pos - (d - a), (n - d) * (1 - share)))
    # 10.8: chance 0.001 for one term
    return np.where((d >= 5) & (ratio > 10.8), SELECTIVE_WEIGHT, 1.0)


def _document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term: over all documents."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        counts, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in chunks(batch.column(0)):
                _, column, _ = _in_vocabulary(*term_rows(data, offsets), vocabulary)
                counts += np.bincount(column, minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(counts), -1)), pa.array(np.append(counts[counts > 0], n))], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()  # -1 is the last place
    return int(out[-1]), out[:-1]


def _in_vocabulary(doc, term, count, terms):
    if not len(terms):
        return doc[:0], np.empty(0, np.int64), count[:0]
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    hit = terms[at] == term
    return doc[hit], at[hit], count[hit]


@dataclass
class Vectors:
    """Sparse rows: (row, column, value) by row, then column."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def part(self, start: int, stop: int) -> Vectors:
        lo, hi = np.searchsorted(self.row, [start, stop])
        return Vectors(stop - start, self.row[lo:hi] - start, self.column[lo:hi], self.value[lo:hi])


def vectors(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Vectors:
    """TF-IDF vectors of length 1 (or 0), one row a text."""
    n = len(offsets) - 1
    row, column, count = _in_vocabulary(*term_rows(data, offsets), terms)
    value = (1 + np.log(count)) * weights[column]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    return Vectors(n, row, column, (value / norm[row]).astype(np.float32))


class Index:
    def __init__(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, examples: Vectors, prior: float, weight: np.ndarray):
        """examples: one row for each of ids; weights: of the terms (IDF and selectivity); weight: of the labels' votes."""
        self.terms, self.weights, self.ids, self.labels, self.prior, self.weight = terms, weights, ids, labels, prior, weight
        n, frequent = len(ids), np.bincount(examples.column, minlength=len(terms)) > FREQUENT * len(ids)
        self.blocks = -(-n // BLOCK)
        #: place of a frequent term among the columns of the blocks, or -1
        self.place = np.where(frequent, np.cumsum(frequent) - 1, -1)
        often = frequent[examples.column]
        self.dense = np.zeros((self.blocks * BLOCK, int(frequent.sum())), np.float32)
        self.dense[examples.row[often], self.place[examples.column[often]]] = examples.value[often]
        self.maxima = self.dense.reshape(self.blocks, BLOCK, -1).max(1).T.copy() if n else np.zeros((0, 0), np.float32)
        order = np.argsort(examples.column[~often], kind="stable")
        #: posting list of term t: lists[t]:lists[t + 1] of the examples and their weights
        self.lists = np.searchsorted(examples.column[~often][order], np.arange(len(terms) + 1))
        self.posted, self.posted_value = examples.row[~often][order].astype(np.int32), examples.value[~often][order]

    @property
    def rows(self) -> np.ndarray:
        """All vectors of the examples as a dense array: for small indexes."""
        out = np.zeros((len(self.ids), len(self.terms)), np.float32)
        often = np.flatnonzero(self.place >= 0)
        out[:, often] = self.dense[: len(self.ids), self.place[often]]
        out[self.posted, np.repeat(np.arange(len(self.terms)), np.diff(self.lists))] = self.posted_value
        return out

    def _from_lists(self, queries: Vectors) -> np.ndarray:
        """Products of queries with all examples over the terms that have posting lists."""
        width = self.blocks * BLOCK
        length = np.diff(self.lists)[queries.column]
        out = np.zeros(queries.n * width)
        ends = np.cumsum(length)
        at = 0
        while at < len(length):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, side="right")))
            n = length[at:stop]
            entry = np.arange(n.sum()) + np.repeat(self.lists[queries.column[at:stop]] - np.cumsum(n) + n, n)
            first, last = int(queries.row[at]), int(queries.row[stop - 1]) + 1
            target = np.repeat((queries.row[at:stop] - first) * width, n) + self.posted[entry]
            out[first * width : last * width] += np.bincount(target, weights=np.repeat(queries.value[at:stop], n) * self.posted_value[entry], minlength=(last - first) * width)
            at = stop
        return out.reshape(queries.n, width).astype(np.float32)

    def nearest(self, queries: Vectors | np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the index, cosines) of the k nearest of each query, cosine down, place up; exact."""
        if isinstance(queries, np.ndarray):
            row, column = np.nonzero(queries)
            queries = Vectors(len(queries), row, column, queries[row, column])
        k = min(k, len(self.ids))
        parts = [self._nearest(queries.part(at, min(at + QUERIES, queries.n)), k) for at in range(0, queries.n, QUERIES)]
        if not parts:
            return np.zeros((0, k), np.int64), np.zeros((0, k), np.float32)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def _nearest(self, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        listed = self._from_lists(queries)
        dense = np.zeros((queries.n, self.dense.shape[1]), np.float32)
        often = self.place[queries.column] >= 0
        dense[queries.row[often], self.place[queries.column[often]]] = queries.value[often]
        bound = listed.reshape(queries.n, self.blocks, BLOCK).max(2) + dense @ self.maxima
        # cosine (the bits of positive floats stand in order), then place from the end; 0: none
        best = np.zeros((queries.n, k), np.int64)
        least = np.zeros(queries.n, np.float32)
        for b in np.argsort(-bound.sum(0), kind="stable"):
            # rounding may lift a cosine above its bound by a little
            ask = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] + 1e-5 >= least))
            if not len(ask):
                continue
            at = np.arange(b * BLOCK, (b + 1) * BLOCK)
            got = listed[ask, b * BLOCK : (b + 1) * BLOCK] + dense[ask] @ self.dense[at].T
            marked = np.where(got > 0, got.view(np.int32).astype(np.int64) << 32 | (0x7FFFFFFF - at), 0)
            merged = np.concatenate([best[ask], marked], axis=1)
            merged.partition(merged.shape[1] - k, axis=1)
            best[ask] = merged[:, -k:]
            least[ask] = (merged[:, -k] >> 32).astype(np.int32).view(np.float32)
        best = -np.sort(-best, axis=1)
        return np.where(best > 0, 0x7FFFFFFF - (best & 0x7FFFFFFF), -1), np.where(best > 0, (best >> 32).astype(np.int32).view(np.float32), np.float32(-1))

    def score(self, queries: Vectors, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, places, cosines). Without a neighbour the score is the prior."""
        if not len(self.ids) or not len(self.terms):
            return np.full(queries.n, self.prior), np.full((queries.n, 0), -1), np.zeros((queries.n, 0), np.float32)
        place, cosine = self.nearest(queries, k)
        found = place >= 0
        vote = np.where(found, cosine, 0) * np.where(found, self.weight[self.labels[place]], 0)
        positive = (vote * (self.labels[place] == 1)).sum(1)
        return (positive + PRIOR_WEIGHT * self.prior) / (vote.sum(1) + PRIOR_WEIGHT), place, cosine


def _counted(train: DataFrame) -> DataFrame:
    """(doc_id, label, terms, counts) of (doc_id, text, label): distinct terms and their counts as bytes, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in chunks(batch.column(1)):
                doc, term, count = term_rows(data, offsets)
                first = np.searchsorted(doc, np.arange(stop - row + 1))
                cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), batch.column(2).slice(row, stop - row), cut(term), cut(count.astype(np.int64))], ["doc_id", "label", "terms", "counts"])

    return train.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, terms binary, counts binary")


def fit(docs: DataFrame, labelled: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """docs: (doc_id, text) and columns that don't matter; labelled: (doc_id, label 0/1). At most max_examples labelled rows are used, those with
    the least hashes of their ids; document counts cover all of docs. Rows with several labels count as 1 if any is.
    Labels without a document and null labels are left out; without any label every score is 0."""
    docs = id_text(docs)
    rows = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = rows.agg(F.avg("label")).first()[0]
    prior = float(share or 0.0)
    half = max_examples // 2
    pick = lambda v: rows.where(F.col("label") == v).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(half)
    chosen = pick(0).unionByName(pick(1))
    # at most max_examples ids; of rows with the same id the least text
    train = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    held = sorted(_counted(train).toLocalIterator(), key=lambda r: r["doc_id"])
    ids, labels = np.array([r["doc_id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64)
    flat = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in held]) if held else np.empty(0, kind)
    term, count = flat("terms", np.uint64), flat("counts", np.int64)
    row = np.repeat(np.arange(len(held)), [len(r["terms"]) // 8 for r in held])
    terms, column = np.unique(term, return_inverse=True)
    n, counts = _document_counts(docs, terms)
    shown = np.bincount(labels, minlength=2).astype(np.float64)
    weights = (np.log((1 + n) / (1 + counts)) + 1) * _selectivity(column, labels[row], shown, len(terms))
    value = (1 + np.log(count)) * weights[column]
    value = (value / np.sqrt(np.bincount(row, weights=value * value, minlength=len(ids)))[row]).astype(np.float32)
    # like vectors side by side make block maxima tight: by the heaviest term
    heaviest = np.full(len(ids), -1)
    by = np.lexsort((-column, value, row))
    heaviest[row[by]] = column[by]  # the last of each row stays
    order = np.lexsort((ids, heaviest))
    new = np.empty(len(ids), np.int64)
    new[order] = np.arange(len(ids))
    by = np.lexsort((column, new[row]))
    weight = np.array([(1 - prior) / max(shown[0], 1), prior / max(shown[1], 1)])
    return Index(terms, weights, ids[order], labels[order], Vectors(len(ids), new[row][by], column[by], value[by]), prior, weight / weight.max() if weight.max() > 0 else weight)


def score(docs: DataFrame, index: Index, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, neighbours, evidence): evidence holds the ids of the nearest examples with label and cosine.

    Null and empty texts, and texts without any term of the examples, have no neighbours and score the prior. Equal
    texts score alike. Examples at equal cosine come in the order of the index.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for row, stop, data, offsets in chunks(batch.column(1), 1 << 20):
                for at in range(0, stop - row, 1024):
                    part = offsets[at : at + 1025]
                    q = vectors(data[part[0] : part[-1]], part - part[0], found.terms, found.weights)
                    scores, place, cosine = found.score(q, neighbours)
                    evidence = [[{"doc_id": found.ids[p], "label": found.labels[p], "cosine": c} for p, c in zip(ps[:3], cs[:3], strict=True) if p >= 0] for ps, cs in zip(place, cosine, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row + at, len(part) - 1), pa.array(scores.astype(np.float64)), pa.array((place >= 0).sum(1).astype(np.int64)), pa.array(evidence, kind)], ["doc_id", "score", "neighbours", "evidence"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, neighbours long, evidence array<struct<doc_id:long,label:int,cosine:float>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    labelled = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    scored = score(docs, fit(docs, labelled))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "neighbours", "evidence")
