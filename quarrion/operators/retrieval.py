"""Sparse, lexical, late-interaction and hybrid retrieval over long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stems
from ..functions.vectors import dot
from .graph import written

K1, B = 1.2, 0.75
RRF_K = 60


def term_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, weight): term counts of stemmed texts."""
    return docs.select(F.col(id_col).alias("id"), F.explode(stems(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), F.asc("id")).limit(k)


def sparse_dot(postings: DataFrame, query: dict, k: int) -> DataFrame:
    """(id, score): sum of products over shared terms; weights of 1e-7 or less count as absent."""
    if not query:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))])
    hits = postings.where(F.col("term").isin(list(query)) & (F.abs("weight") > 1e-7))
    return _best(hits.groupBy("id").agg(F.sum(F.col("weight") * weight[F.col("term")]).alias("score")), k)


def bm25_scores(postings: DataFrame, terms: list) -> DataFrame:
    """(id, score) of every document with a query term. The filter on terms reaches the scan of the postings; only
    lengths and document counts look at all of them."""
    lengths = postings.groupBy("id").agg(F.sum(F.greatest(F.lit(1.0), F.round("weight"))).alias("dl"))
    corpus = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    hits = postings.where(F.col("term").isin(list(terms)))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, "id").crossJoin(F.broadcast(corpus))  # one row for each query term; one row
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    tf = F.col("weight") * (K1 + 1) / (F.col("weight") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(idf * tf).alias("score"))


def bm25(postings: DataFrame, terms: list, k: int) -> DataFrame:
    return _best(bm25_scores(postings, terms), k)


def term_counts(docs: DataFrame, terms: list, tokens: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, f0, f1, ...): tokens of each document and how many of them are each of the terms, counted inside each text's row.

    Texts of one id are one document; those without tokens are left out."""
    own = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_w"))
    own = own.select("id", F.size("_w").cast("double").alias("dl"), F.filter("_w", lambda w: w.isin(list(terms))).alias("_h")).where("dl > 0")
    counts = [_count("_h", t).alias(f"f{i}") for i, t in enumerate(terms)]
    return own.select("id", "dl", *counts).groupBy("id").agg(F.sum("dl").alias("dl"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(terms))])


def _count(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda w: w == F.lit(term))).cast("double")


def bm25_text_scores(docs: DataFrame, terms: list, tokens: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bm25_scores() of the tokens of texts, without a row for each token: texts are read once, a row a document is written."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    counts = written(term_counts(docs, terms, tokens, id_col, text_col))
    corpus = counts.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))])
    rows = counts.where("id is not null").where(" or ".join(f"f{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(corpus))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        weight, df = F.col(f"f{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(0.0), F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1))
        total = total + F.when(weight > 0, idf * (weight * (K1 + 1) / (weight + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))).otherwise(0.0)
    return rows.select("id", total.alias("score"))


def bm25_texts(docs: DataFrame, terms: list, k: int, tokens: Callable[[Column], Column]) -> DataFrame:
    return _best(bm25_text_scores(docs, terms, tokens), k)


def max_sim(tokens: DataFrame, query: list[list[float]], k: int, doc_col: str = "doc", vector_col: str = "vector") -> DataFrame:
    """(id, score): for each query token its best product in the document, summed. tokens: one row a token vector."""
    if not query:
        return tokens.select(F.col(doc_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    parts = [F.max(dot(F.array(*[F.lit(float(x)) for x in q]), F.col(vector_col))).alias(f"s{i}") for i, q in enumerate(query)]
    best = tokens.groupBy(F.col(doc_col).alias("id")).agg(*parts)
    total: Column = sum((F.col(f"s{i}") for i in range(1, len(query))), F.col("s0"))
    return _best(best.select("id", total.alias("score")), k)


def ranked_fusion(lists: list[tuple[DataFrame, float]], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of top lists (id, score) with weights."""
    out = None
    for results, weight in lists:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id")))  # a top list: bounded by its k
        part = results.withColumn("r", rank).select("id", (F.lit(max(0.0, weight)) / (rrf_k + F.col("r"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return _best(out.groupBy("id").agg(F.sum("s").alias("score")), k)


def linear_fusion(lists: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Weighted sum of scores scaled to [0, 1] in each list."""
    out = None
    for results, weight in lists:
        ends = results.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        scaled = (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
        part = results.crossJoin(F.broadcast(ends)).select("id", (F.lit(max(0.0, weight)) * scaled).alias("s"))  # one row
        out = part if out is None else out.unionByName(part)
    return _best(out.groupBy("id").agg(F.sum("s").alias("score")), k)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.0), how: str = "rrf") -> DataFrame:
    """Fuses the best 2k of each of two (id, score) tables."""
    lists = [(_best(x, 2 * k), w) for x, w in zip((dense, lexical), weights, strict=True)]
    return ranked_fusion(lists, k) if how == "rrf" else linear_fusion(lists, k)


#: Places of a hashed embedding that a stem adds to.
PLACES = 4


def hashed_embeddings(docs: DataFrame, dimensions: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, embedding): signed feature hashing. Each stem adds +1 or -1 to PLACES places taken from its SHA-256; length 1.

    Stems add up inside each text's row, different ones of a batch are hashed once; texts of one id are one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 2048):
                part = batch.slice(x, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), _hashed(part.column(1), dimensions)], ["id", "v"])

    texts = docs.select(F.col(id_col).alias("id"), F.array_join(stems(F.col(text_col)), " ").alias("stems")).where("stems <> ''")
    sums = texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, v array<double>").groupBy("id").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(dimensions)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return sums.select("id", "v", norm.alias("norm")).select("id", F.transform("v", lambda x: x / F.greatest(F.col("norm"), F.lit(1e-12))).alias("embedding"))


def _hashed(texts: pa.Array, dimensions: int) -> pa.Array:
    """Sums of the places and signs of each text's stems, which spaces part."""
    lists = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    coded = lists.flatten().dictionary_encode()
    heads = np.frombuffer(b"".join(sha256(w.encode()).digest()[: 4 * PLACES] for w in coded.dictionary.to_pylist()), ">u4").reshape(-1, PLACES).astype(np.int64)
    stem = coded.indices.to_numpy()
    at, sign = heads % dimensions, 1.0 - 2.0 * (heads // dimensions % 2)
    out = np.zeros(len(texts) * dimensions)
    for i in range(PLACES):
        out += np.bincount(row * dimensions + at[stem, i], sign[stem, i], len(out))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, dimensions, dtype=np.int32)), pa.array(out))


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, recall) of (query_id, id) tables."""
    hits = expected.join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
