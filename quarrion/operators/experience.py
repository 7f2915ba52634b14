"""Experience records: attempts with problems, contexts, actions and outcomes; planning and metering around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from .search import literal_vector


def trace(attempts: DataFrame, problems: DataFrame, contexts: DataFrame, outcomes: DataFrame, actions: DataFrame) -> DataFrame:
    """Attempts with problem and context, their outcome if any, and their actions in order (array of names).

    Tables share attempt_id, problem_id and context_id; actions (attempt_id, position, action).
    """
    ordered = actions.groupBy("attempt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "action"))), lambda x: x["action"]).alias("actions"))
    out = attempts.join(problems, "problem_id").join(contexts, "context_id").join(outcomes, "attempt_id", "left").join(ordered, "attempt_id", "left")
    return out.withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))


def query(attempts: DataFrame, problem=None, context=None, action: str | None = None, state: str | None = None, lsn: int | None = None) -> DataFrame:
    """Attempts by problem, context, an action among theirs, state and visibility, in order of id."""
    rows = attempts
    for column, value in (("problem_id", problem), ("context_id", context), ("state", state)):
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    if action is not None:
        rows = rows.where(F.array_contains("actions", action))
    if lsn:
        rows = rows.where(F.col("commit_lsn") <= lsn)
    return rows.orderBy("attempt_id")


def to_cases(attempts: DataFrame, least_utility: float, cut: int) -> DataFrame:
    """(attempt_id, reason, success, partition): completed attempts become cases, others say why they don't.

    attempts (attempt_id, state, has_outcome, utility, domain, commit_lsn); up to `cut` a case serves discovery, behind it validation.
    """
    reason = F.when(F.col("state") != "Completed", "not completed").when(~F.col("has_outcome"), "no outcome").when(F.col("utility").isNull(), "no metrics").when(F.col("domain").isNull(), "no domain")
    kept = F.col("reason").isNull()
    return attempts.withColumn("reason", reason).select("attempt_id", F.coalesce("reason", F.lit("kept")).alias("reason"), F.when(kept, F.col("utility") >= least_utility).alias("success"), F.when(kept, F.when(F.col("commit_lsn") <= cut, "discovery").otherwise("validation")).alias("partition"))


def eligible_top_k(vectors: DataFrame, eligible: DataFrame, query_vector, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(top k among eligible ids, one row with the counts of eligible and scored vectors). Catalyst picks the semi join."""
    rows = vectors.join(eligible.select(id_col).distinct(), id_col, "left_semi").where(F.col(vector_col).isNotNull())
    best = rows.select(id_col, METRICS[metric](literal_vector(query_vector), F.col(vector_col)).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    counts = eligible.agg(F.countDistinct(id_col).alias("eligible")).crossJoin(rows.agg(F.count("*").alias("scored")))  # one row each
    return best, counts


#: The answers a caller may ask for; all of them get the exact plan.
CONTRACTS = ("Exact", "Certified", "PacRelaxed", "HighRecall", "Budget", "MultiVectorMaxSim", "Auto")


def certified(results: DataFrame, contract: str = "Certified") -> DataFrame:
    if contract not in CONTRACTS:
        raise ValueError(f"contract must be one of {CONTRACTS}")
    return results.withColumn("certified", F.lit(True)).withColumn("contract", F.lit(contract))


def usage(events: DataFrame, tenant: str, time_col: str, value: str) -> DataFrame:
    """(tenant, month, operations, units)."""
    return events.groupBy(tenant, F.date_format(time_col, "yyyy-MM").alias("month")).agg(F.count("*").alias("operations"), F.sum(value).alias("units"))


def over_quota(used: DataFrame, quotas: DataFrame, tenant: str) -> DataFrame:
    """Tenants whose operations exceed their quota; those without one may do anything."""
    return used.groupBy(tenant).agg(F.sum("operations").alias("operations")).join(quotas, tenant).where("operations > quota")


def posting_choice(distinct: Column, density: Column) -> Column:
    """How a field would be indexed: up to 256 values as a dictionary, then by density."""
    return F.when(distinct <= 256, "dictionary").when(density < 0.01, "sparse").when(density < 0.3, "compressed").otherwise("dense")


def capacity(vectors: Column, dimensions: Column, fsync_ms: float = 1.2, rtt_ms: float = 0.35) -> dict[str, Column]:
    """Sizing by closed forms: bytes, index bytes, memory, shards, p99."""
    index = vectors * (dimensions / 2 + 64)
    return {
        "bytes": (dimensions * 8 * vectors).cast("bigint"),
        "index_bytes": index.cast("bigint"),
        "memory_bytes": (index * 1.3 + 2 * (1 << 30)).cast("bigint"),
        "shards": F.ceil(vectors / 10_000_000).cast("bigint"),
        "p99_ms": F.lit(1.5 + 0.2 * fsync_ms + rtt_ms),
    }


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def differing_shards(left: DataFrame, right: DataFrame, key: str, fields: list[str], shards: int = 16) -> DataFrame:
    """(shard): shards whose order-free digests differ between two replicas; one row a shard crosses the network."""

    def digests(df: DataFrame, name: str) -> DataFrame:
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [key, *fields]]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        return df.groupBy(shard_of(F.col(key), shards).alias("shard")).agg(F.sum(h).alias(name))

    both = digests(left, "l").join(digests(right, "r"), "shard", "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("shard")


def lineage_roots(links: DataFrame) -> DataFrame:
    """(id, roots): parents without parents that each record derives from. links (id, parent)."""
    from .graph import reach

    edges = links.select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    tops = links.select(F.col("parent").alias("node")).join(links.select(F.col("id").alias("node")), "node", "left_anti").distinct()
    far = reach(edges, links.select(F.col("id").alias("start")).distinct(), None)
    return far.join(tops, "node").groupBy(F.col("start").alias("id")).agg(F.sort_array(F.collect_set("node")).alias("roots"))
