"""Rows beside their neighbours in a total order, in one shuffle and without a global window.

Keys are cut into buckets at boundaries drawn from a bounded sample; the cuts only balance the work, never change a
result. The first (last) row of each bucket is copied to the bucket before (behind) it, so every bucket can walk its rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries drawn at most; so many keys go to the driver.
MAX_BUCKETS = 4096
_FINE = 64


def cuts(keys: DataFrame, key: str, n: int) -> list:
    """At most n - 1 boundaries between buckets, from the keys with the smallest hashes."""
    n = max(1, min(n, MAX_BUCKETS))
    rows = keys.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(n - 1).collect() if n > 1 else []
    return sorted({r[0] for r in rows})


def bucket_of(key: Column, bounds: list, kind: str) -> Column:
    """Number of boundaries that are not above the key, found in two steps; null keys go to bucket 0."""
    if not bounds:
        return F.lit(0)
    values = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{kind}>")
    coarse = F.array(*[F.lit(b) for b in bounds[::_FINE]]).cast(f"array<{kind}>")
    group = F.size(F.filter(coarse, lambda b: b <= key))
    inside = F.size(F.filter(F.slice(values, (F.greatest(group, F.lit(1)) - 1) * _FINE + 1, _FINE), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * _FINE + inside).cast("int")


def ends(keys: DataFrame, key: str, bucket: Column) -> list[tuple[int, object, object]]:
    """(bucket, least key, greatest key) of each bucket that has rows: at most MAX_BUCKETS of them."""
    found = keys.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    return sorted((r.b, r.lo, r.hi) for r in found)


def dealt(rows: DataFrame, key: str, kind: str, bounds: list, copies: dict, partitions: int) -> DataFrame:
    """rows with `bucket` and `copy` (0: a row of the bucket itself), dealt out by bucket.

    copies: key -> buckets that get a copy of that key's rows as well.
    """
    spark = rows.sparkSession
    bucket = bucket_of(F.col(key), bounds, kind)
    own = F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("copy")))
    if copies:
        extra = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in copies.items()], f"`{key}` {kind}, _to array<int>")
        rows = rows.join(F.broadcast(extra), key, "left")  # at most two keys a bucket
        own = F.concat(own, F.coalesce(F.transform("_to", lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("copy"))), F.array().cast("array<struct<bucket:int,copy:int>>")))
    names = [c for c in rows.columns if c != "_to"]
    return rows.select(*names, F.explode(own).alias("_at")).select(*names, "_at.bucket", "_at.copy").repartition(partitions, "bucket")


def partitions_for(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
