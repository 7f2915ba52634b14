"""Long-term memory: facts that newer ones replace, retention that decays, keys that expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0


def strength(recalls: Column, salience: Column) -> Column:
    """Days over which retention falls to 1/e."""
    return (recalls + 1) * (1 + 2 * salience)


def retention(seconds: Column, recalls: Column, salience: Column) -> Column:
    return F.exp(-seconds / (strength(recalls, salience) * DAY))


def expiry(last: Column, recalls: Column, salience: Column, least: float) -> Column:
    """Second at which retention falls to `least`."""
    return last + (-F.log(F.lit(least))) * strength(recalls, salience) * DAY


def latest_facts(facts: DataFrame, keys: tuple[str, ...] = ("user", "subject", "predicate"), order: tuple[str, ...] = ("ts", "fact_id")) -> DataFrame:
    """Newest fact of each key, with how many different objects it replaced."""
    others = [c for c in facts.columns if c not in keys]
    out = facts.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"), (F.countDistinct("object") - 1).alias("conflicts"))
    return out.select(*keys, "_r.*", "conflicts")


def active(facts: DataFrame, now: float, least: float) -> DataFrame:
    return facts.withColumn("retention", retention(F.lit(float(now)) - F.col("last"), F.col("recalls"), F.col("salience"))).where(F.col("retention") >= least)


def pruned(facts: DataFrame, now: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(facts that stay, preferences rebuilt from them as (user, predicate, object))."""
    stay = active(facts, now, least)
    return stay, stay.select("user", "predicate", "object")


def live_keys(log: DataFrame, now: int) -> DataFrame:
    """(key, value): newest write of each key, deletions (null values) and expired ones left out. log (key, value, ts, ttl)."""
    new = log.groupBy("key").agg(F.max_by(F.struct("value", "ts", "ttl"), "ts").alias("r"))
    return new.where(F.col("r.value").isNotNull() & (F.col("r.ttl").isNull() | (F.col("r.ts") + F.col("r.ttl") > now))).select("key", F.col("r.value").alias("value"))


def counters(log: DataFrame) -> DataFrame:
    """(key, value): increments since the last set. log (key, op 'set' | 'incr' | 'delete', amount, ts)."""
    base = log.where("op <> 'incr'").groupBy("key").agg(F.max("ts").alias("t"), F.max_by(F.struct("op", "amount"), "ts").alias("b"))
    after = log.join(base, "key", "left").where(F.col("t").isNull() | (F.col("ts") >= F.col("t")))
    part = F.when(F.col("op") != "delete", F.col("amount"))
    return after.groupBy("key").agg(F.sum(part).alias("value")).where("value is not null")


def sink_and_recent(rows: DataFrame, by: str, position: str, sink: int, recent: int) -> DataFrame:
    """First `sink` and last `recent` rows of each group by position."""
    up = F.row_number().over(Window.partitionBy(by).orderBy(position))
    down = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(position)))
    return rows.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= sink) | (F.col("_d") <= recent)).drop("_u", "_d")
