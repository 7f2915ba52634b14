"""Operator chains, rotor alignment of regions, monitoring actions and records of outcomes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blades that a product keeps.
MAX_BLADES = 32


def _sign(a: int, b: int) -> float:
    """Sign of a product of basis blades: parity of the swaps that sort it."""
    swaps, a = 0, a >> 1
    while a:
        swaps += (a & b).bit_count()
        a >>= 1
    return -1.0 if swaps % 2 else 1.0


def chain_product(transforms: list[dict[int, float]], keep: int = MAX_BLADES, longest: int = 8) -> tuple[dict[int, float], int, float]:
    """(product, depth, greatest energy loss): geometric products from left to right, each cut to its strongest blades.

    Empty transforms are passed over. Blades are bit masks; ties in strength go to the smaller blade."""
    todo = [t for t in transforms if t][:longest]
    if not todo:
        return {}, 0, 0.0
    now, loss = todo[0], 0.0
    for other in todo[1:]:
        out: dict[int, float] = {}
        for a, x in sorted(now.items()):
            for b, y in sorted(other.items()):
                out[a ^ b] = out.get(a ^ b, 0.0) + _sign(a, b) * x * y
        strongest = sorted((b for b in out if out[b]), key=lambda b: (-abs(out[b]), b))[:keep]
        whole = sum(v * v for v in out.values())
        now = {b: out[b] for b in sorted(strongest)}
        if whole > 1e-12:
            loss = max(loss, min(1.0, max(0.0, 1 - sum(v * v for v in now.values()) / whole)))
    return now, len(todo), loss


def composed_chains(operators: DataFrame, keep: int = MAX_BLADES, longest: int = 8) -> DataFrame:
    """(chain_id, blade, coefficient, depth, loss) from (chain_id, position, blade, coefficient). The first `longest` operators count,
    so a task holds a chain's operators of at most 2**24 blades each."""
    first = operators.groupBy("chain_id", "position", "blade").agg(F.sum("coefficient").alias("coefficient"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [dict(zip(p["blade"], p["coefficient"], strict=True)) for _, p in frame.sort_values(["position", "blade"]).groupby("position")]
        product, depth, loss = chain_product(parts, keep, longest)
        return pd.DataFrame({"chain_id": key[0], "blade": list(product), "coefficient": list(product.values()), "depth": depth, "loss": loss})

    return first.groupBy("chain_id").applyInPandas(run, f"chain_id {operators.schema['chain_id'].dataType.simpleString()}, blade int, coefficient double, depth int, loss double")


#: Points that a region may have: alignment compares all of two regions' points in a task.
MAX_REGION = 4096


def _residual(points: np.ndarray, target: np.ndarray) -> float:
    total = 0.0
    for part in np.array_split(points, max(1, len(points) // 256)):
        total += np.sqrt(((part[:, None] - target[None]) ** 2).sum(2).min(1)).sum()
    return total / len(points) / math.sqrt(2)


def aligned(a: np.ndarray, b: np.ndarray, passes: int = 2, steps: int = 12) -> tuple[np.ndarray, float]:
    """(rotation, residual): coordinate descent over plane rotations, each angle by a golden section of [-pi/4, pi/4].

    The residual is the mean distance of rotated points to their nearest target, over the square root of 2."""
    size = a.shape[1]
    rotation = np.eye(size)
    ratio = (math.sqrt(5) - 1) / 2

    def turned(i: int, j: int, angle: float) -> np.ndarray:
        g = np.eye(size)
        g[i, i] = g[j, j] = math.cos(angle)
        g[i, j], g[j, i] = -math.sin(angle), math.sin(angle)
        return g @ rotation

    best = _residual(a, b)
    for _ in range(passes):
        for i in range(size):
            for j in range(i + 1, size):
                low, high = -math.pi / 4, math.pi / 4
                for _ in range(steps):
                    x, y = high - ratio * (high - low), low + ratio * (high - low)
                    if _residual(a @ turned(i, j, x).T, b) < _residual(a @ turned(i, j, y).T, b):
                        high = y
                    else:
                        low = x
                trial = turned(i, j, (low + high) / 2)
                value = _residual(a @ trial.T, b)
                if value < best:
                    rotation, best = trial, value
    return rotation, best


def region_alignment(points: DataFrame, pairs: DataFrame, passes: int = 1, most: int = MAX_REGION) -> DataFrame:
    """(a, b, before, residual) for pairs (a, b) of regions; points (region, coords). A pair with an empty region has a residual of 1.

    Regions larger than `most` points are an error: cluster them first."""
    sizes = points.groupBy("region").agg(F.count("*").alias("n"))
    if sizes.where(F.col("n") > most).limit(1).count():
        raise ValueError(f"a region has more than {most} points")
    regions = points.groupBy("region").agg(F.sort_array(F.collect_list(F.transform("coords", lambda x: x.cast("double")))).alias("p"))
    both = pairs.join(regions.select(F.col("region").alias("a"), F.col("p").alias("pa")), "a", "left").join(regions.select(F.col("region").alias("b"), F.col("p").alias("pb")), "b", "left").select("a", "b", "pa", "pb")

    def run(frames):
        for frame in frames:
            out = []
            for a, b, pa_, pb in frame.itertuples(index=False):
                if pa_ is None or pb is None:
                    out.append((a, b, 1.0, 1.0))
                    continue
                x, y = np.stack(pa_).astype(float), np.stack(pb).astype(float)
                out.append((a, b, _residual(x, y), aligned(x, y, passes)[1]))
            yield pd.DataFrame(out, columns=["a", "b", "before", "residual"])

    kind = points.schema["region"].dataType.simpleString()
    return both.mapInPandas(run, f"a {kind}, b {kind}, before double, residual double")


def monitored(observations: DataFrame, least: int = 20, accuracy: float = 0.75, calibration: float = 0.25, failures: float = 0.25) -> DataFrame:
    """(operator_id, n, accuracy, calibration_error, failure_ratio, action) from (operator_id, predicted, correct, failed).

    Too few observations: wait. A low accuracy or too many failures: roll back; a calibration error: revise; else keep."""
    right = F.col("correct").cast("double")
    per = observations.groupBy("operator_id").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.abs(F.avg("predicted") - F.avg(right)).alias("calibration_error"), F.avg(F.col("failed").cast("double")).alias("failure_ratio"))
    action = F.when(F.col("n") < least, "wait").when((F.col("accuracy") < accuracy) | (F.col("failure_ratio") > failures), "roll_back").when(F.col("calibration_error") > calibration, "revise").otherwise("keep")
    return per.withColumn("action", action)


def action_stream(actions: DataFrame, kinds: list[str]) -> DataFrame:
    """actions (kind, operator_id, ...) with place: their order in the log, by the kinds' order, then by operator. Actions of a cycle are few."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return actions.where(rank > 0).withColumn("place", (F.row_number().over(Window.orderBy(rank, "operator_id")) - 1).cast("long"))


def outcome_classes(measured: Column, metrics: Column) -> tuple[Column, Column]:
    """(evidence class, verification state) of a recorded outcome: a measurement artifact verifies it, asserted metrics are claims."""
    evidence = F.when(measured, "measurement").when(metrics, "reported_claim").otherwise("observation")
    state = F.when(measured, "verified").when(metrics, "reported_unverified").otherwise("unverified")
    return evidence, state


def resolutions(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(case_id, status, outcomes): cases with the best of their outcomes (case_id, success, state).

    A verified success promotes a case to a verified resolution; a success that isn't verified makes a candidate; without one a
    case has failed, or is open if nothing was recorded."""
    per = outcomes.groupBy("case_id").agg(F.count("*").alias("outcomes"), F.coalesce(F.bool_or(F.col("success") & (F.col("state") == "verified")), F.lit(False)).alias("proven"), F.coalesce(F.bool_or("success"), F.lit(False)).alias("told"))
    status = F.when(F.col("outcomes").isNull(), "open").when(F.col("proven"), "verified_resolution").when(F.col("told"), "candidate").otherwise("failed")
    return cases.select("case_id").join(per, "case_id", "left").select("case_id", status.alias("status"), F.coalesce("outcomes", F.lit(0)).cast("long").alias("outcomes"))
