"""State machines over logs: entities, relation types, experiments and clients whose next step depends on the last accepted one.

Rows are dealt out by key, sorted, and folded batch by batch with one state in hand, so that a key's history is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(log: DataFrame, key: str, order: list[str], step: Callable, start, outputs: str) -> DataFrame:
    """log with the columns `outputs` ("a string, b boolean"): step(state, row) gives the next state and their values.

    row is a dict of the log's columns. A null key is a key. Rows come by `order` inside a key.
    """
    schema = T.StructType([*log.schema.fields, *T._parse_datatype_string(outputs).fields])
    kinds = [(f.name, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema.fields[len(log.columns) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = object(), start
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != held:
                    held, state = row[key], start
                state, values = step(state, row)
                out.append(values)
            columns = [pa.array([v[i] for v in out], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[n for n, _ in kinds]])

    return log.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def machine(log: DataFrame, key: str, order: list[str], op: str, moves: dict[tuple[str, str], str], start: str = "none") -> DataFrame:
    """log with before, after and accepted: moves maps (state, op) to the next state; other steps are rejected and change nothing."""

    def step(state: str, row: dict):
        after = moves.get((state, row[op]))
        return after or state, (state, after or state, after is not None)

    return folded(log, key, order, step, start, "before string, after string, accepted boolean")


# Which steps each kind of record may take.
ENTITY = {("none", "create"): "live", ("live", "version"): "live", ("live", "transition"): "live", ("live", "tombstone"): "dead"}
RELATION_TYPE = {("none", "propose"): "proposed", ("proposed", "admit"): "admitted", ("admitted", "use"): "admitted", ("admitted", "deprecate"): "deprecated"}
ATTEMPT = {("none", "open"): "open", ("open", "act"): "open", ("open", "complete"): "completed", ("open", "fail"): "failed", ("completed", "outcome"): "measured"}
EXPERIMENT = {("none", "propose"): "proposed", ("proposed", "approve"): "approved", ("approved", "run"): "running", ("running", "finish"): "finished", ("proposed", "reject"): "rejected", ("approved", "reject"): "rejected"}


def sequenced(log: DataFrame, client: str, sequence: str, order: list[str], gap: int) -> DataFrame:
    """log with accepted: a client's number must lie behind its last accepted one, by no more than `gap`."""

    def step(last: int, row: dict):
        n = row[sequence]
        good = n is not None and last < n <= last + gap
        return (n if good else last), (good,)

    return folded(log, client, order, step, 0, "accepted boolean")


def versions(accepted: DataFrame, key: str, order: str, ends: tuple[str, ...] = ("tombstone",), op: str = "op") -> DataFrame:
    """accepted with version, valid_from and valid_until (null for the newest); rows that end an element close its interval only."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    rows = accepted.withColumn("version", F.row_number().over(w)).withColumn("valid_from", F.col(order)).withColumn("valid_until", F.lead(order).over(w))
    return rows.where(~F.col(op).isin(*ends))


def compacted(log: DataFrame, key: str, order: str, deleted: str, horizon: int) -> DataFrame:
    """The log with only the newest row of each key up to the horizon, deletions left out there, and all rows behind it."""
    from .tables import fold_log

    old = fold_log(log.where(F.col(order) <= horizon), key, order)
    return old.where(~F.coalesce(F.col(deleted), F.lit(False))).select(*log.columns).unionByName(log.where(F.col(order) > horizon))


def remembered(log: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """New rows of an idempotent append: the first of each key, unless the key is there already."""
    others = [c for c in log.columns if c != key]
    first = log.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order)).alias("_r")).select(key, "_r.*")
    return first.join(existing.select(key), key, "left_anti").select(*log.columns)
