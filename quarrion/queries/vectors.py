"""Queries over `embeddings`: metrics, exact search, fusion inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evidence, olap
from ..operators.filters import And, Eq, In, Not, Or, Range
from ..operators.search import batch_top_k, literal_vector, top_k


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _query(vectors: DataFrame, vec_id: int = 0) -> list[float]:
    return vectors.where(F.col("vec_id") == vec_id).first()["embedding"]


def _top(metric: str):
    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        return top_k(v, _query(v), 10, metric).select("vec_id", (F.round("score", 5) + 0.0).alias("score"))

    return run


def vec_topk_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return top_k(v, _query(v), 10, "cosine", F.col("label").isin(1, 3, 5, 7)).select("vec_id", (F.round("score", 5) + 0.0).alias("score"))


def vec_batch_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return batch_top_k(v, queries, 5).select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def vec_rerank_recency(spark, sf_dir):
    """Intent rerank: 3k by cosine, then recency and phase alignment count as well."""
    v = _vectors(spark, sf_dir)
    q = _query(v)
    base = top_k(v, q, 30, "cosine")
    back = base.join(v.select("vec_id", "embedding"), "vec_id")
    age = F.lit(1000.0) - F.col("vec_id")
    total = F.col("score") + F.exp(-0.1 * age) * 0.25 + V.phase_alignment(literal_vector(q), F.col("embedding")) * 0.15
    return back.select("vec_id", total.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 5).alias("score"))


def vec_metrics(spark, sf_dir):
    """All metrics of each vector against vector 0."""
    v = _vectors(spark, sf_dir)
    q, e = literal_vector(_query(v)), F.col("embedding")
    cols = {"inner": V.dot(q, e), "cosine": V.cosine(q, e), "cosine_distance": V.cosine_distance(q, e), "euclidean": V.euclidean(q, e), "overlap": V.overlap(q, e), "norm": V.norm(e), "phase": V.phase_alignment(q, e)}
    return v.select("vec_id", *[(F.round(c, 4) + 0.0).alias(n) for n, c in cols.items()])


def vec_polar(spark, sf_dir):
    """Amplitude and phase of the first complex component, and the largest element of the normalised vector."""
    e = F.col("embedding")
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.get(V.amplitudes(e), F.lit(0)), 4).alias("amplitude"), F.round(F.get(V.phases(e), F.lit(0)), 4).alias("phase"), F.round(F.array_max(V.normalize(e)), 4).alias("largest"))


def vec_from_polar(spark, sf_dir):
    """The sum of each vector's elements after a way to amplitudes and phases and back."""
    e = F.col("embedding")
    back = V.from_polar(V.amplitudes(e), V.phases(e))
    return _vectors(spark, sf_dir).select("vec_id", (F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


def vec_folds(spark, sf_dir):
    """First complex component of the split fold, and the last element of a fold of 63 elements undone."""
    e = F.col("embedding")
    split, odd = V.split_fold(e), F.slice(e, 1, 63)
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.get(split, F.lit(1)).cast("double"), 5).alias("imaginary"), F.size(V.fold(odd)).cast("long").alias("folded"), F.round(F.element_at(V.unfold(V.fold(odd), F.lit(63)), -1).cast("double"), 5).alias("last"))


def filter_bool_tree(spark, sf_dir):
    tree = And(Or(Eq("label", 1), In("label", [2, 4, 6])), Range("vec_id", 50, 400), Not(Or(Eq("vec_id", 100), Range("vec_id", 200, 220))))
    return _vectors(spark, sf_dir).where(tree.column()).select("vec_id", F.col("label").cast("long").alias("label"))


def olap_agg_all(spark, sf_dir):
    return _shown(olap.aggregate(_vectors(spark, sf_dir), "vec_id"))


def olap_vector_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _shown(olap.aggregate(v, "vec_id", V.dot(literal_vector(_query(v)), F.col("embedding")) >= 0.1))


def _shown(df):
    return df.select("n", *[F.round(c, 4).alias(c) for c in ("total", "mean", "least", "greatest", "variance")])


def olap_by_label(spark, sf_dir):
    out = olap.running_moments(_vectors(spark, sf_dir).withColumn("x", F.get("embedding", F.lit(0))), "label", "x")
    return out.select(F.col("label").cast("long").alias("label"), "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("mean", "m2", "stddev")])


def _beliefs(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("belief_id"), F.col("label").alias("agent"), F.slice("embedding", 1, 8).alias("coords"), (1.0 / (1 + F.col("vec_id") % 7)).alias("confidence"))


def consensus_centroid(spark, sf_dir):
    out = evidence.consensus(_beliefs(spark, sf_dir), [0.0] * 8, 0.35)
    return out.select("beliefs", "agents", F.round("merged_confidence", 5).alias("merged_confidence"), F.round(F.get("centroid", F.lit(0)), 4).alias("c0"), F.round(F.get("centroid", F.lit(7)), 4).alias("c7"))


def belief_conflicts(spark, sf_dir):
    out = evidence.conflicts(_beliefs(spark, sf_dir), 0.2)
    return out.select("belief_a", "belief_b", F.col("agent_a").cast("long").alias("agent_a"), F.col("agent_b").cast("long").alias("agent_b"), F.round("distance", 4).alias("distance"))


def effective_confidence(spark, sf_dir):
    c = evidence.effective_confidence(F.col("confidence"), F.lit(0.01), F.col("belief_id") % 4, F.col("belief_id").cast("double"))
    return _beliefs(spark, sf_dir).select("belief_id", F.round(c, 5).alias("confidence"))


QUERIES = {
    **{f"vec_topk_{m}": _top(m) for m in V.METRICS},
    "vec_topk_filtered": vec_topk_filtered,
    "vec_batch_topk": vec_batch_topk,
    "vec_rerank_recency": vec_rerank_recency,
    "vec_metrics": vec_metrics,
    "vec_polar": vec_polar,
    "vec_from_polar": vec_from_polar,
    "vec_folds": vec_folds,
    "filter_bool_tree": filter_bool_tree,
    "olap_agg_all": olap_agg_all,
    "olap_vector_filtered": olap_vector_filtered,
    "olap_by_label": olap_by_label,
    "consensus_centroid": consensus_centroid,
    "belief_conflicts": belief_conflicts,
    "effective_confidence": effective_confidence,
}


def _sum(expr: str, n: str = "range(1, 65)") -> str:
    return f"list_sum(list_transform({n}, lambda i: {expr}))"


DOT = _sum("q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE")
_NQ, _NE = _sum("q.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE"), _sum("e.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE")
COSINE = f"greatest(-1.0, least(1.0, {DOT} / sqrt({_NQ} * {_NE})))"
_EUCLID = f"sqrt({_sum('(q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)')})"
_RE = _sum("q.embedding[2*i-1]::DOUBLE * e.embedding[2*i-1]::DOUBLE + q.embedding[2*i]::DOUBLE * e.embedding[2*i]::DOUBLE", "range(1, 33)")
_IM = _sum("q.embedding[2*i-1]::DOUBLE * e.embedding[2*i]::DOUBLE - q.embedding[2*i]::DOUBLE * e.embedding[2*i-1]::DOUBLE", "range(1, 33)")
_OVERLAP = f"greatest(0.0, least(1.0, (({_RE}) * ({_RE}) + ({_IM}) * ({_IM})) / ({_NQ} * {_NE})))"
_SCORES = {"inner": DOT, "cosine": COSINE, "euclidean": f"-{_EUCLID}", "overlap": _OVERLAP, "sine": f"1 - sqrt(1 - {_OVERLAP})", "chordal": f"2 - sqrt(2 * (1 - sqrt({_OVERLAP})))"}
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _topk_sql(score: str, where: str = "true") -> str:
    return f"SELECT vec_id, round(s, 5) + 0.0 AS score FROM (SELECT e.vec_id, {score} AS s FROM embeddings e, {_Q} WHERE {where}) ORDER BY s DESC, vec_id LIMIT 10"


def _agg_sql(where: str) -> str:
    x = "vec_id::DOUBLE"
    return f"SELECT count(*) AS n, round(sum({x}), 4) AS total, round(avg({x}), 4) AS mean, round(min({x}), 4) AS least, round(max({x}), 4) AS greatest, round(coalesce(var_samp({x}), 0), 4) AS variance FROM embeddings e, {_Q} WHERE {where}"


_PHASE = f"CASE WHEN sqrt(({_RE}) ** 2 + ({_IM}) ** 2) < 1e-9 THEN 0.0 ELSE ({_RE}) / sqrt(({_RE}) ** 2 + ({_IM}) ** 2) END"
_BELIEFS = "b AS (SELECT vec_id AS belief_id, label AS agent, embedding[1:8] AS coords, 1.0::DOUBLE / (1 + vec_id % 7) AS confidence FROM embeddings)"
_D8 = "sqrt(list_sum(list_transform(range(1, 9), lambda i: (x.coords[i]::DOUBLE - y.coords[i]::DOUBLE) ** 2)))"
ORACLE_SQL = {
    **{f"vec_topk_{m}": _topk_sql(s) for m, s in _SCORES.items()},
    "vec_topk_filtered": _topk_sql(COSINE, "e.label IN (1, 3, 5, 7)"),
    "vec_batch_topk": f"SELECT query_id, vec_id, round(s, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5",
    "vec_rerank_recency": f"WITH b AS (SELECT e.vec_id, {COSINE} AS s, {_PHASE} AS p FROM embeddings e, {_Q} ORDER BY s DESC, e.vec_id LIMIT 30) SELECT vec_id, round(t, 5) AS score FROM (SELECT vec_id, s + exp(-0.1 * (1000.0 - vec_id)) * 0.25 + p * 0.15 AS t FROM b) ORDER BY t DESC, vec_id LIMIT 10",
    "vec_metrics": f"SELECT e.vec_id, round({DOT}, 4) + 0.0 AS inner, round({COSINE}, 4) + 0.0 AS cosine, round(1 - {COSINE}, 4) + 0.0 AS cosine_distance, round({_EUCLID}, 4) + 0.0 AS euclidean, round({_OVERLAP}, 4) + 0.0 AS overlap, round(sqrt({_NE}), 4) + 0.0 AS norm, round({_PHASE}, 4) + 0.0 AS phase FROM embeddings e, {_Q}",
    "vec_from_polar": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 AS total FROM embeddings",
    "vec_folds": "SELECT vec_id, round(embedding[33]::DOUBLE, 5) AS imaginary, 64::BIGINT AS folded, round(embedding[63]::DOUBLE, 5) AS last FROM embeddings",
    "vec_polar": f"SELECT e.vec_id, round(sqrt(e.embedding[1]::DOUBLE ** 2 + e.embedding[2]::DOUBLE ** 2), 4) AS amplitude, round(atan2(e.embedding[2]::DOUBLE, e.embedding[1]::DOUBLE), 4) AS phase, round(list_max(e.embedding)::DOUBLE / sqrt({_NE}), 4) AS largest FROM embeddings e",
    "filter_bool_tree": "SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE (label = 1 OR label IN (2, 4, 6)) AND vec_id BETWEEN 50 AND 400 AND NOT (vec_id = 100 OR vec_id BETWEEN 200 AND 220)",
    "olap_agg_all": _agg_sql("true"),
    "olap_vector_filtered": _agg_sql(f"{DOT} >= 0.1"),
    "olap_by_label": "SELECT label::BIGINT AS label, count(*) AS n, round(avg(x), 5) + 0.0 AS mean, round(var_pop(x) * count(*), 5) + 0.0 AS m2, round(stddev_samp(x), 5) + 0.0 AS stddev FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label",
    "consensus_centroid": f"WITH {_BELIEFS}, n AS (SELECT x.* FROM b x WHERE sqrt(list_sum(list_transform(x.coords, lambda c: c::DOUBLE ** 2))) <= 0.35), s AS (SELECT count(*) AS beliefs, count(DISTINCT agent) AS agents, avg(confidence) AS m, sum(confidence) AS w, " + ", ".join(f"sum(coords[{i}]::DOUBLE * confidence) / sum(confidence) AS r{i}" for i in range(1, 9)) + " FROM n) SELECT beliefs, agents, round(m, 5) AS merged_confidence, round(r1 / sqrt(" + " + ".join(f"r{i} ** 2" for i in range(1, 9)) + "), 4) AS c0, round(r8 / sqrt(" + " + ".join(f"r{i} ** 2" for i in range(1, 9)) + "), 4) AS c7 FROM s",
    "belief_conflicts": f"WITH {_BELIEFS} SELECT x.belief_id AS belief_a, y.belief_id AS belief_b, x.agent::BIGINT AS agent_a, y.agent::BIGINT AS agent_b, round({_D8}, 4) AS distance FROM b x JOIN b y ON x.belief_id < y.belief_id AND x.agent <> y.agent WHERE {_D8} <= 0.2",
    "effective_confidence": f"WITH {_BELIEFS} SELECT belief_id, round(least(1.0, greatest(0.0, confidence * exp(-0.01 / greatest(1, belief_id % 4) * belief_id))), 5) AS confidence FROM b",
}
