"""Tables under mutation logs: latest-wins folds, keyed writes, foreign keys, row-level security, snapshots."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import row_security


#: Rows of a table dealt out by key that a task takes.
DEALT = 500_000


def dealt(rows: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """rows shuffled by keys into as many partitions as keep a task's share bounded; most: how many rows there are, if it is known."""
    n = rows.count() if most is None else most
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // DEALT)), *keys)


def fold_log(log: DataFrame, key: str, order: str, deleted: str | None = None, upto: int | None = None) -> DataFrame:
    """Newest row of each key, keys whose newest row is a deletion left out; upto reads the state at that order.

    One aggregation with partial results before the shuffle, so that a hot key costs a row per task.
    """
    rows = log if upto is None else log.where(F.col(order) <= upto)
    others = [c for c in log.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("_r")).select(key, "_r.*")
    return newest if deleted is None else newest.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def rejected_inserts(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is there already."""
    return new.join(existing.select(key), key, "left_semi")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes (one a key) in place of its own."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(*base.columns))


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is given but not in the parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def select(table: DataFrame, predicate: Column | None = None, tenant: tuple[str, str] | None = None) -> DataFrame:
    """Rows that satisfy the predicate and, if given, belong to (tenant column, tenant)."""
    wanted = [c for c in (predicate, row_security(*tenant) if tenant else None) if c is not None]
    return table.where(reduce(and_, wanted)) if wanted else table


class Transaction:
    """Writes that wait for commit(); rollback() forgets them. One table write publishes all of them."""

    def __init__(self, path: str, key: str):
        self.path, self.key, self.staged = path, key, []

    def insert(self, rows: DataFrame) -> None:
        self.staged.append(rows)

    def rollback(self) -> None:
        self.staged.clear()

    def commit(self) -> int:
        """Appends the staged rows at once; an existing or repeated key is an error that leaves the table as it was."""
        if not self.staged:
            return 0
        rows = reduce(DataFrame.unionByName, self.staged)
        if rows.groupBy(self.key).count().where("count > 1").limit(1).count():
            raise ValueError("a key is written twice")
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and rejected_inserts(rows, spark.read.parquet(self.path), self.key).limit(1).count():
            raise ValueError("a key exists already")
        n = rows.count()
        rows.write.mode("append").parquet(self.path)
        self.staged.clear()
        return n
