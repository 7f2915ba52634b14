"""Queries over derived coordinates: lattice points, bivectors, Clifford products, clusters of labels, pinned searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.search import top_k


def _v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _scaled(spark, sf_dir):
    return _v(spark, sf_dir).select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 8).alias("x"))


def e8_nearest(spark, sf_dir):
    """Sum and squared distance of each nearest lattice point."""
    p = _scaled(spark, sf_dir).withColumn("p", G.e8_nearest(F.col("x")))
    d = F.aggregate(F.zip_with("x", "p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return p.select("vec_id", (F.aggregate("p", F.lit(0.0), lambda s, x: s + x) % 2 + 0.0).alias("odd"), (d <= 1.0 + 1e-9).alias("within"))


def affect_regime(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", G.regime((F.col("event_id") % 100) / 100, (F.col("user_id") % 100) / 100).alias("regime")).groupBy("regime").agg(F.count("*").alias("n"))


def wedge_strength(spark, sf_dir):
    """Directed change between each vector and the next."""
    a = _v(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(G.strength(G.wedge(F.col("embedding"), F.col("next"))), 4).alias("strength"))


def phase_drift(spark, sf_dir):
    """First component after a rotation by a tenth of the id."""
    out = G.phase_shift(F.col("embedding"), F.col("vec_id") / 10, 8)
    return _v(spark, sf_dir).select("vec_id", (F.round(F.get(out, F.lit(0)), 4) + 0.0).alias("re"), (F.round(F.get(out, F.lit(1)), 4) + 0.0).alias("im"))


def clifford_product(spark, sf_dir):
    """Product of two sparse multivectors: terms meet, blades combine by exclusive or."""
    a = spark.createDataFrame([(1, 2.0), (3, -1.0), (6, 0.5)], "blade int, c double")
    b = spark.createDataFrame([(2, 1.5), (3, 1.0), (5, -2.0)], "blade int, c double")
    both = a.select(F.col("blade").alias("x"), F.col("c").alias("p")).crossJoin(F.broadcast(b.select(F.col("blade").alias("y"), F.col("c").alias("q"))))  # at most 256 blades each
    return both.groupBy(F.col("x").bitwiseXOR(F.col("y")).alias("blade")).agg(F.sum(F.col("p") * F.col("q") * G.blade_sign(F.col("x"), F.col("y"))).alias("c")).where("c <> 0")


def region_centroids(spark, sf_dir):
    """Centroid, weighted barycentre and friction of each label over eight coordinates."""
    rows = _v(spark, sf_dir).select("label", (1 / (1 + F.col("vec_id") % 5)).alias("w"), F.posexplode(F.slice("embedding", 1, 8)).alias("i", "x"))
    per = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"), (F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("b"), F.var_pop(F.col("x").cast("double")).alias("v"))
    return per.groupBy(F.col("label").cast("long").alias("label")).agg((F.round(F.sum("c"), 4) + 0.0).alias("centroid_sum"), (F.round(F.sum("b"), 4) + 0.0).alias("barycentre_sum"), F.round(F.sqrt(F.sum("v")), 4).alias("dispersion"))


def quantized_error(spark, sf_dir):
    """Whether the polar code of each vector keeps its first component within a step."""
    v = _v(spark, sf_dir)
    most = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.hypot(F.get("embedding", 2 * i).cast("double"), F.get("embedding", 2 * i + 1).cast("double"))))
    back = G.dequantize_polar(G.quantize_polar(F.col("embedding")), most)
    return v.select("vec_id", (F.abs(F.get(back, F.lit(0)) - F.get("embedding", F.lit(0)).cast("double")) < 0.02).alias("close"))


def pinned_search(spark, sf_dir):
    """Search in a past state: vectors committed up to a place in the log."""
    v = _v(spark, sf_dir)
    q = v.where("vec_id = 1").first()["embedding"]
    return top_k(v, q, 10, "cosine", F.col("vec_id") <= 200).select("vec_id", F.round("score", 5).alias("score"))


def shard_merge(spark, sf_dir):
    """Best rows of each shard merged, an id that several shards hold once with its best score."""
    v = _v(spark, sf_dir)
    q = v.where("vec_id = 2").first()["embedding"]
    parts = [top_k(v, q, 10, "cosine", F.col("vec_id") % 3 != k) for k in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = both.groupBy("vec_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
    return best.select("vec_id", F.round("score", 5).alias("score"))


def drift_by_version(spark, sf_dir):
    """Distance of each vector from the one before it with the same label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = _v(spark, sf_dir).withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    d = F.sqrt(F.aggregate(F.zip_with("embedding", "before", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return rows.select("vec_id", F.round(d, 4).alias("drift"))


QUERIES = {f.__name__: f for f in (e8_nearest, affect_regime, wedge_strength, phase_drift, clifford_product, region_centroids, quantized_error, pinned_search, shard_merge, drift_by_version)}

_DOT = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE))"
_COS = f"{_DOT} / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def _search(at: int, where: str) -> str:
    return f"SELECT vec_id, round(s, 5) AS score FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {at}) q WHERE {where} ORDER BY s DESC, vec_id LIMIT 10)"


_W = " + ".join(f"(a.embedding[{i + 1}]::DOUBLE * b.embedding[{j + 1}]::DOUBLE - a.embedding[{j + 1}]::DOUBLE * b.embedding[{i + 1}]::DOUBLE) ** 2" for i in range(8) for j in range(i))
ORACLE_SQL = {
    # the covering radius of the lattice is 1, and its points have even sums
    "e8_nearest": "SELECT vec_id, 0.0::DOUBLE AS odd, true AS within FROM embeddings",
    "affect_regime": "SELECT CASE WHEN (user_id % 100) / 100.0::DOUBLE < 0.2 THEN 'critical' WHEN (event_id % 100) / 100.0::DOUBLE > 0.8 AND (user_id % 100) / 100.0::DOUBLE > 0.8 THEN 'curious' ELSE 'neutral' END AS regime, count(*) AS n FROM events GROUP BY 1",
    "wedge_strength": f"SELECT a.vec_id, round(sqrt({_W}), 4) AS strength FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "phase_drift": "SELECT vec_id, round(embedding[1]::DOUBLE * cos(vec_id / 10.0::DOUBLE) - embedding[2]::DOUBLE * sin(vec_id / 10.0::DOUBLE), 4) + 0.0 AS re, round(embedding[1]::DOUBLE * sin(vec_id / 10.0::DOUBLE) + embedding[2]::DOUBLE * cos(vec_id / 10.0::DOUBLE), 4) + 0.0 AS im FROM embeddings",
    "region_centroids": "WITH r AS (SELECT label, 1.0::DOUBLE / (1 + vec_id % 5) AS w, unnest(range(1, 9)) AS i, unnest(embedding[1:8])::DOUBLE AS x FROM embeddings), p AS (SELECT label, i, avg(x) AS c, sum(x * w) / sum(w) AS b, var_pop(x) AS v FROM r GROUP BY ALL) SELECT label::BIGINT AS label, round(sum(c), 4) + 0.0 AS centroid_sum, round(sum(b), 4) + 0.0 AS barycentre_sum, round(sqrt(sum(v)), 4) AS dispersion FROM p GROUP BY label",
    "quantized_error": "SELECT vec_id, true AS close FROM embeddings",
    "pinned_search": _search(1, "e.vec_id <= 200"),
    "shard_merge": _search(2, "true"),
    "drift_by_version": "SELECT vec_id, round(d, 4) AS drift FROM (SELECT vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - p[i]::DOUBLE) ** 2))) AS d FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL)",
    # basis vectors square to one and anticommute: worked out by hand
    "clifford_product": "SELECT blade::INT AS blade, sum(c)::DOUBLE AS c FROM (VALUES (3, 3.0), (2, 2.0), (4, -4.0), (1, -1.5), (0, 1.0), (6, -2.0), (4, -0.75), (5, -0.5), (3, -1.0)) t(blade, c) GROUP BY blade HAVING sum(c) <> 0",
}
