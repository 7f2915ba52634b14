"""Queries over attempts made from events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, experience


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def experience_trace(spark, sf_dir):
    """An order is an attempt, its customer the problem, the customer's nation the context, its lines the actions."""
    o, c, n, li = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "lineitem"))
    attempts = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("problem_id"), F.col("c_nationkey").alias("context_id"))
    problems = c.select(F.col("c_custkey").alias("problem_id"), F.col("c_mktsegment").alias("problem"))
    contexts = n.select(F.col("n_nationkey").alias("context_id"), F.col("n_name").alias("context"))
    outcomes = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("attempt_id"), F.lit("done").alias("outcome"))
    actions = li.select(F.col("l_orderkey").alias("attempt_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.concat_ws(":", "l_linenumber", "l_partkey").alias("action"))
    out = experience.trace(attempts, problems, contexts, outcomes, actions)
    return out.select("attempt_id", "problem", "context", F.coalesce("outcome", F.lit("-")).alias("outcome"), F.array_join("actions", "|").alias("actions"))


def experience_query(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("problem_id"), (F.col("event_id") % 3).alias("context_id"), F.array("event_type").alias("actions"), F.when(F.col("value") > 50, "Completed").otherwise("Open").alias("state"), F.col("event_id").alias("commit_lsn"))
    return experience.query(e, 7, None, "click", "Completed", 8000).select("attempt_id")


def experience_cases(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), F.when(F.col("event_type") == "view", "Open").otherwise("Completed").alias("state"), (F.col("event_type") != "click").alias("has_outcome"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("utility"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("domain"), F.col("event_id").alias("commit_lsn"))
    return experience.to_cases(e, 40.0, 6000).groupBy("reason", F.coalesce("partition", F.lit("-")).alias("part"), F.coalesce(F.col("success").cast("string"), F.lit("-")).alias("success")).agg(F.count("*").alias("n"))


def eligible_topk(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 5").first()["embedding"]
    best, counts = experience.eligible_top_k(v, v.where("vec_id % 20 = 5").select("vec_id"), q, 5)
    return experience.certified(best.select("vec_id", F.round("score", 5).alias("score"))).crossJoin(F.broadcast(counts))  # one row


def usage_report(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return experience.usage(e, "user_id", "ts", "value").select("user_id", "month", "operations", F.round("units", 3).alias("units"))


def quota_breaches(spark, sf_dir):
    used = experience.usage(_t(spark, sf_dir, "events"), "user_id", "ts", "value")
    quotas = used.select("user_id").distinct().withColumn("quota", 40 + F.col("user_id") % 50)
    return experience.over_quota(used, quotas, "user_id").select("user_id", "operations", F.col("quota").cast("long").alias("quota"))


def capacity_plan(spark, sf_dir):
    r = _t(spark, sf_dir, "region").select(((F.col("r_regionkey") + 1) * 7_000_000).cast("long").alias("vectors"), F.lit(64).alias("dimensions"))
    plan = experience.capacity(F.col("vectors"), F.col("dimensions"))
    return r.select("vectors", *[c.alias(n) for n, c in plan.items() if n != "p99_ms"], F.round(plan["p99_ms"], 4).alias("p99_ms"))


def posting_choice(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    one = p.agg(F.countDistinct("p_brand").alias("brand"), F.countDistinct("p_name").alias("name"), F.count("*").alias("n"))
    return one.select(experience.posting_choice(F.col("brand"), F.lit(0.5)).alias("brand"), experience.posting_choice(F.lit(1000), F.lit(0.05)).alias("middle"), experience.posting_choice(F.lit(1000), F.lit(0.001)).alias("thin"), experience.posting_choice(F.lit(1000), F.lit(0.9)).alias("thick"))


def replica_check(spark, sf_dir):
    """Replicas that agree have no differing shard; after one change exactly one has."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    other = c.withColumn("c_name", F.when(F.col("c_custkey") == 3, "changed").otherwise(F.col("c_name")))
    same = experience.differing_shards(c, c, "c_custkey", ["c_name"]).agg(F.count("*").alias("same"))
    return same.crossJoin(experience.differing_shards(c, other, "c_custkey", ["c_name"]).agg(F.count("*").alias("changed")))  # one row each


def lineage(spark, sf_dir):
    """Records derive from their half; the roots are those that derive from nothing."""
    links = spark.range(1, 64).select(F.col("id"), (F.col("id") / 2).cast("long").alias("parent")).where("id > 3")
    out = experience.lineage_roots(links)
    return out.select("id", F.get("roots", F.lit(0)).alias("root"), F.size("roots").cast("long").alias("n"))


def precedent_synthesis(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("precedent_id"), ((F.col("p_size") % 10) / 10).alias("residual"), F.col("p_brand").alias("context"), ((F.col("p_partkey") % 7) / 7).alias("utility"), (F.col("p_partkey") % 2).alias("contradicting"), (F.col("p_partkey") % 5).alias("supporting"), (F.col("p_partkey") % 11 == 0).alias("contradicted"))
    return discovery.synthesise(p, "Brand#11").limit(20).select("precedent_id", F.round("score", 5).alias("score"))


def experiment_gain(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("experiment"), F.col("event_type").alias("resolution"))
    return discovery.experiment_gain(e).select("experiment", F.round("gain", 5).alias("gain"))


QUERIES = {f.__name__: f for f in (experience_trace, experience_query, experience_cases, eligible_topk, usage_report, quota_breaches, capacity_plan, posting_choice, replica_check, lineage, precedent_synthesis, experiment_gain)}

_DOT = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE))"
_COS = f"{_DOT} / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_U = "u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS operations, sum(value) AS units FROM events GROUP BY ALL)"
ORACLE_SQL = {
    "experience_trace": "SELECT o_orderkey AS attempt_id, c_mktsegment AS problem, n_name AS context, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '-' END AS outcome, coalesce((SELECT string_agg(l_linenumber || ':' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS actions FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    "experience_query": "SELECT event_id AS attempt_id FROM events WHERE user_id = 7 AND event_type = 'click' AND value > 50 AND event_id <= 8000",
    "experience_cases": "WITH r AS (SELECT event_id, value, CASE WHEN event_type = 'view' THEN 'not completed' WHEN event_type = 'click' THEN 'no outcome' WHEN event_id % 7 = 0 THEN 'no metrics' WHEN user_id % 5 = 0 THEN 'no domain' ELSE 'kept' END AS reason FROM events) SELECT reason, CASE WHEN reason <> 'kept' THEN '-' WHEN event_id <= 6000 THEN 'discovery' ELSE 'validation' END AS part, CASE WHEN reason <> 'kept' THEN '-' WHEN value >= 40 THEN 'true' ELSE 'false' END AS success, count(*) AS n FROM r GROUP BY ALL",
    "eligible_topk": f"SELECT vec_id, round(s, 5) AS score, true AS certified, 'Certified' AS contract, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 5) AS eligible, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 5) AS scored FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.vec_id % 20 = 5 ORDER BY s DESC, vec_id LIMIT 5)",
    "usage_report": f"WITH {_U} SELECT user_id, month, operations, round(units, 3) AS units FROM u",
    "quota_breaches": f"WITH {_U} SELECT user_id, sum(operations)::BIGINT AS operations, (40 + user_id % 50)::BIGINT AS quota FROM u GROUP BY user_id HAVING sum(operations) > 40 + user_id % 50",
    "capacity_plan": "SELECT v AS vectors, 512 * v AS bytes, 96 * v AS index_bytes, floor(96 * v * 1.3 + 2147483648)::BIGINT AS memory_bytes, ceil(v / 10000000.0)::BIGINT AS shards, 2.09::DOUBLE AS p99_ms FROM (SELECT ((r_regionkey + 1) * 7000000)::BIGINT AS v FROM region)",
    "posting_choice": "SELECT 'dictionary' AS brand, 'compressed' AS middle, 'sparse' AS thin, 'dense' AS thick",
    "replica_check": "SELECT 0::BIGINT AS same, 1::BIGINT AS changed",
    "lineage": "WITH RECURSIVE l AS (SELECT i AS id, i // 2 AS parent FROM range(4, 64) t(i)), r AS (SELECT id, parent AS p FROM l UNION SELECT r.id, l.parent FROM r JOIN l ON l.id = r.p) SELECT id, min(p)::BIGINT AS root, count(*) AS n FROM r WHERE p <= 3 GROUP BY id",
    "precedent_synthesis": "WITH s AS (SELECT p_partkey, 1 - (p_size % 10) / 10.0::DOUBLE + CASE WHEN p_brand = 'Brand#11' THEN 1.0 ELSE 0.5 END + (p_partkey % 7) / 7.0::DOUBLE * 2 - (p_partkey % 2) * 4.0 - CASE WHEN p_partkey % 11 = 0 THEN 4.0 ELSE 0 END AS score, p_partkey % 5 AS k FROM part) SELECT p_partkey AS precedent_id, round(score, 5) AS score FROM (SELECT * FROM s ORDER BY round(score, 9) DESC, k, p_partkey LIMIT 20)",
    "experiment_gain": "SELECT user_id AS experiment, round(count(DISTINCT event_type) / (count(DISTINCT event_type) + 1)::DOUBLE, 5) AS gain FROM events GROUP BY user_id",
}
