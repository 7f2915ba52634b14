"""Evidence: de-duplication, summaries, metric utilities, adjudication, belief and consensus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import tiles

KEYS = ["relation_id", "attempt_id", "policy_id", "context"]


def deduplicated(evidence: DataFrame, keys: list[str] = KEYS, id_col: str = "evidence_id") -> DataFrame:
    """First record (least id) of each combination of keys."""
    others = [c for c in evidence.columns if c not in keys]
    return evidence.groupBy(*keys).agg(F.min_by(F.struct(*others), id_col).alias("_r")).select(*keys, "_r.*").select(*evidence.columns)


def summary(evidence: DataFrame, by: str | list[str]) -> DataFrame:
    """Counts by direction (what is neither support nor contradiction is neutral), saturating utility sum, LSN range."""
    n = lambda d: F.count_if(F.col("direction") == d)
    total = F.sum(F.col("utility").cast("decimal(38,0)"))
    saturated = F.least(F.greatest(total, F.lit(fixed.LOW).cast("decimal(38,0)")), F.lit(fixed.HIGH).cast("decimal(38,0)")).cast("bigint")
    neutral = F.count_if(F.coalesce(~F.col("direction").isin("Supports", "Contradicts"), F.lit(True)))
    keys = [by] if isinstance(by, str) else by
    return evidence.groupBy(*keys).agg(F.count("*").alias("observations"), n("Supports").alias("supports"), n("Contradicts").alias("contradictions"), neutral.alias("neutral"), saturated.alias("utility_sum"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def digest(evidence: DataFrame, by: str, fields: list[str], id_col: str = "evidence_id") -> DataFrame:
    """(by, digest): SHA-256 over the records of each group in order of their ids."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("i"), line.alias("x")))), lambda r: r["x"]), "\n")
    return evidence.groupBy(by).agg(F.sha2(ordered, 256).alias("digest"))


@dataclass(frozen=True)
class Policy:
    min_observations: int = 10
    min_support: int = 5
    max_contradictions: int = 0
    promote_utility: int = fixed.ONE
    falsify_utility: int = 0


def adjudicate(summaries: DataFrame, policy: Policy = Policy(), status: str | Column = "Provisional") -> DataFrame:
    """summaries with decision and next_status; only what is provisional can become inferred."""
    now = F.lit(status) if isinstance(status, str) else status
    few = F.col("observations") < policy.min_observations
    against = (F.col("contradictions") > policy.max_contradictions) & (F.col("utility_sum") <= policy.falsify_utility)
    fine = (F.col("supports") >= policy.min_support) & (F.col("contradictions") <= policy.max_contradictions) & (F.col("utility_sum") >= policy.promote_utility)
    both = (F.col("supports") > 0) & (F.col("contradictions") > 0)
    decision = F.when(few, "InsufficientEvidence").when(against, "ContradictionThresholdReached").when(fine, "SupportThresholdReached").when(both, "ContextDependent").otherwise("MixedEvidence")
    following = F.when(F.col("decision") == "ContradictionThresholdReached", "Contradicted").when((F.col("decision") == "SupportThresholdReached") & (now == "Provisional"), "Inferred").otherwise(now)
    return summaries.withColumn("decision", decision).withColumn("next_status", following)


def metric_utility(baseline: Column, observed: Column, higher_is_better: bool = True, how: str = "absolute", floor: float = -1.0, ceiling: float = 1.0) -> Column:
    """Improvement as a double: absolute, relative to the baseline, or relative within bounds; null for a baseline near 0."""
    delta = observed - baseline if higher_is_better else baseline - observed
    if how == "absolute":
        return delta
    ratio = F.when(F.abs(baseline) >= 1e-12, delta / F.abs(baseline))
    return ratio if how == "relative" else F.when(ratio.isNotNull(), F.greatest(F.lit(floor), F.least(F.lit(ceiling), ratio)))


def effective_confidence(confidence: Column, decay: Column, reinforcements: Column, seconds: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence * F.exp(-decay / F.greatest(F.lit(1), reinforcements) * seconds)))


def _distance(a: str, b: list[float] | str) -> Column:
    other = F.col(b) if isinstance(b, str) else F.array(*[F.lit(float(x)) for x in b])
    return F.sqrt(F.aggregate(F.zip_with(F.col(a), other, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def consensus(beliefs: DataFrame, region: list[float], radius: float) -> DataFrame:
    """One row: beliefs and agents within the radius, confidence-weighted centroid (length 1), mean confidence."""
    n = len(region)
    near = beliefs.where(_distance("coords", region) <= radius)
    sums = [F.sum(F.get("coords", F.lit(i)).cast("double") * F.col("confidence")).alias(f"c{i}") for i in range(n)]
    one = near.agg(F.count("*").alias("beliefs"), F.countDistinct("agent").alias("agents"), F.sum("confidence").alias("w"), F.avg("confidence").alias("merged_confidence"), *sums)
    raw = F.array(*[F.col(f"c{i}") / F.col("w") for i in range(n)])
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    centroid = F.when(F.col("w") > 1e-9, F.transform(raw, lambda x: x / F.greatest(norm, F.lit(1e-12)))).otherwise(F.array(*[F.lit(float(x)) for x in region]))
    return one.select("beliefs", "agents", F.coalesce("merged_confidence", F.lit(1.0)).alias("merged_confidence"), centroid.alias("centroid"))


#: Rows of a cell that a task holds at least, while the others stream past them.
HELD = 1024


def conflicts(beliefs: DataFrame, epsilon: float, cell: str | None = None) -> DataFrame:
    """Pairs (belief_a < belief_b) of different agents no further apart than epsilon.

    Beliefs are dealt to cells of side epsilon over their first two coordinates, each met with its neighbours, so that only
    near beliefs are compared. Full cells are parted among tasks, and pairs compared in matrices; only those found become rows.
    """
    side = F.lit(max(float(epsilon), 1e-300))
    far = float(1 << 52)
    place = lambda i: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), F.coalesce(F.get("coords", F.lit(i)).cast("double"), F.lit(0.0)) / side)))
    whole = F.col("belief_id").isNotNull() & F.col("agent").isNotNull() & (F.size("coords") > 0) & ~F.exists("coords", lambda x: x.isNull())
    rows = beliefs.where(whole).select(F.col("belief_id").alias("id"), "agent", "coords", place(0).alias("_k0"), place(1).alias("_k1"))
    sizes = rows.groupBy("_k0", "_k1").agg(F.count("*").alias("n"))
    total = beliefs.count()
    parts = sizes.select("_k0", "_k1", F.ceil(F.col("n") / max(HELD, min(total // 64, 16 * HELD))).alias("parts"))
    held = rows.join(parts, ["_k0", "_k1"]).select("id", "agent", "coords", "_k0", "_k1", F.pmod(F.xxhash64("id"), F.col("parts")).alias("_k2"))
    # a pair of cells meets in one of the two
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = rows.withColumn("s", F.explode(steps)).select("id", "agent", "coords", (F.col("_k0") + F.col("s.i")).alias("_k0"), (F.col("_k1") + F.col("s.j")).alias("_k1"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    near = near.join(parts, ["_k0", "_k1"]).select("id", "agent", "coords", "_k0", "_k1", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_k2"))
    kinds = dict(rows.dtypes)
    schema = f"a {kinds['id']}, agent_1 {kinds['agent']}, b {kinds['id']}, agent_2 {kinds['agent']}, distance double, own boolean"
    tasks = max(int(beliefs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64, total // 20_000)
    found = tiles.met(held.withColumn("own", F.lit(True)), near, tasks, lambda table: _near(table, float(epsilon)), schema)
    found = found.where((F.col("agent_1") != F.col("agent_2")) & F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select(pick("a", "b").alias("belief_a"), pick("agent_1", "agent_2").alias("agent_a"), pick("b", "a").alias("belief_b"), pick("agent_2", "agent_1").alias("agent_b"), "distance")


def _near(table: pa.Table, epsilon: float):
    """For tiles.met: pairs of a held and a streamed row no further apart than epsilon, distances summed in the order of coordinates."""
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    widths = np.asarray(pc.list_value_length(table["coords"].combine_chunks()))
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        by_width[int(w)] = tiles.matrix(table["coords"].combine_chunks().take(pa.array(at)))[0], at
    ids, agents = table["id"].combine_chunks(), table["agent"].combine_chunks()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("coords")
        lengths = np.asarray(pc.list_value_length(column))
        for w in np.unique(lengths):
            if int(w) not in by_width:
                continue
            m, at = by_width[int(w)]
            here = np.flatnonzero(lengths == w)
            v = tiles.matrix(column.take(pa.array(here)))[0]
            wide = max(1, tiles.ELEMENTS // len(m))
            for x in range(0, len(v), wide):
                i, j, d = _close(m, v[x : x + wide], epsilon)
                if len(i):
                    mine, theirs = pa.array(at[i]), pa.array(here[x + j])
                    yield pa.RecordBatch.from_arrays([ids.take(mine), agents.take(mine), batch.column("id").take(theirs), batch.column("agent").take(theirs), pa.array(d), batch.column("own").take(theirs)], ["a", "agent_1", "b", "agent_2", "distance", "own"])

    return step, lambda: iter(())


def _close(m: np.ndarray, v: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of m, row of v, distance) up to epsilon: products find candidates with room for their rounding, differences decide."""
    with np.errstate(all="ignore"):
        a, b = (m * m).sum(1), (v * v).sum(1)
        square = a[:, None] + b[None] - 2 * (m @ v.T)
        i, j = np.nonzero(~(square > epsilon * epsilon + 1e-12 * (epsilon * epsilon + a.max() + b.max())))
        s = np.zeros(len(i))
        for k in range(m.shape[1]):
            d = m[i, k] - v[j, k]
            s += d * d
        s = np.sqrt(s)
    keep = s <= epsilon
    return i[keep], j[keep], s[keep]


def independence(assertions: DataFrame, by: str) -> DataFrame:
    return assertions.groupBy(by).agg(F.count("*").alias("assertions"), F.countDistinct("agent").alias("agents"), F.countDistinct("root").alias("roots"))


def resolution_confidence(score: Column, verification: Column, success_rate: Column, measured_share: Column, age: Column) -> Column:
    """Null rates stand for no outcomes: success 1/2, reproducibility 1/4."""
    # Weights of the states of verification.
    weight = F.when(verification == "Verified", 1.0).when(verification == "ReportedUnverified", 0.65).when(verification == "PendingEvidence", 0.5).when(verification == "Unverified", 0.4).otherwise(0.0)
    raw = score * weight * (0.5 + 0.5 * F.coalesce(success_rate, F.lit(0.5))) * (0.75 + 0.25 * F.coalesce(measured_share, F.lit(0.25))) / (1 + age / 1000)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def chained_hashes(log: DataFrame, chain: str, order: str, fields: list[str]) -> DataFrame:
    """(chain, order, fields, hash): each hash covers the previous one and the entry.

    A chain is folded in order in one row; chains (a tenant, an actor) run side by side.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [order, *fields]])
    entries = log.groupBy(chain).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("e"))
    start = F.array().cast("array<string>")
    folded = F.aggregate("e", start, lambda acc, r: F.array_append(acc, F.sha2(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), F.lit("|"), r["x"]), 256)))
    return entries.select(chain, F.explode(F.arrays_zip(F.col("e.o").alias("o"), folded.alias("h"))).alias("z")).select(chain, F.col("z.o").alias(order), F.col("z.h").alias("hash"))


def slo(events: DataFrame, failed: Column, target: float = 0.9999) -> DataFrame:
    """Availability, burn rate (failure rate over what the target allows) and its severity."""
    one = events.agg(F.count("*").alias("requests"), F.count_if(failed).alias("failures"))
    burn = F.when(F.col("requests") > 0, F.col("failures") / F.col("requests")).otherwise(0.0) / (1 - target)
    return one.withColumn("availability", 1 - F.when(F.col("requests") > 0, F.col("failures") / F.col("requests")).otherwise(0.0)).withColumn("burn", burn).withColumn("severity", F.when(burn >= 14.4, "page").when(burn >= 6.0, "ticket").otherwise("ok"))
