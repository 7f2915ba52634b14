"""Graphs under a log of mutations.

A log has (lsn, op, id array<string>, labels array<string>, props map<string, string>): id is [node] or [src, type, dst]; a
null value in props removes a property. Folds keep the newest word on each node, edge, label and property, each an
aggregation with partial results, so that a node changed a million times costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "lsn long, op string, id array<string>, labels array<string>, props map<string, string>"
#: What makes and unmakes an element, and what changes one.
NODE = {"make": "create_node", "end": "delete_node", "change": ("set_labels", "remove_labels", "patch_node")}
EDGE = {"make": "create_edge", "end": "delete_edge", "change": ("patch_edge",)}


def row(rows: DataFrame, lsn: int, op: str, key: list[Column], labels: list[str], props: dict) -> DataFrame:
    """One mutation for each distinct key among rows."""
    values = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), F.lit(v).cast("string"))]) if props else F.create_map().cast("map<string,string>")
    ids = rows.select(F.array(*[k.cast("string") for k in key]).alias("id")).distinct()
    return ids.select(F.lit(lsn).cast("long").alias("lsn"), F.lit(op).alias("op"), "id", F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"), values.alias("props"))


def _state(log: DataFrame, kind: dict) -> DataFrame:
    """(id, born): elements whose newest creation or deletion is a creation."""
    turns = log.where(F.col("op").isin(kind["make"], kind["end"])).groupBy("id").agg(F.max_by("op", "lsn").alias("op"), F.max("lsn").alias("born"))
    return turns.where(F.col("op") == kind["make"]).drop("op")


def _newest(rows: DataFrame, name: str) -> DataFrame:
    """rows (id, name, value, lsn) with the newest value of each name."""
    return rows.groupBy("id", name).agg(F.max_by("value", "lsn").alias("value"))


def _properties(log: DataFrame, alive: DataFrame, ops: tuple) -> DataFrame:
    """(id, props) as the changes since an element's creation leave them."""
    said = log.where(F.col("op").isin(*ops)).select("id", "lsn", F.explode("props").alias("key", "value"))
    newest = _newest(said.join(alive, "id").where("lsn >= born"), "key").where("value is not null")
    return newest.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("props"))


def _filled(found: DataFrame) -> Column:
    return F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props")


def nodes(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(node_id, labels, props) after the log, or after its part up to an lsn."""
    log = log if upto is None else log.where(F.col("lsn") <= upto)
    alive = _state(log, NODE)
    said = log.where(F.col("op").isin("create_node", "set_labels", "remove_labels")).select("id", "lsn", F.explode("labels").alias("label"), (F.col("op") != "remove_labels").alias("value"))
    labels = _newest(said.join(alive, "id").where("lsn >= born"), "label").where("value").groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    out = alive.join(labels, "id", "left").join(_properties(log, alive, ("create_node", "patch_node")), "id", "left")
    return out.select(F.get("id", F.lit(0)).alias("node_id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), _filled(out))


def edges(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(src, type, dst, props): edges whose ends exist and haven't been made anew since."""
    log = log if upto is None else log.where(F.col("lsn") <= upto)
    alive = _state(log, EDGE)
    # a node that is deleted takes its edges along, also if one of its name comes back
    ends = log.where("op = 'delete_node'").groupBy(F.get("id", F.lit(0)).alias("node")).agg(F.max("lsn").alias("gone"))
    there = _state(log, NODE).select(F.get("id", F.lit(0)).alias("node")).join(ends, "node", "left")
    for i in (0, 2):
        alive = alive.withColumn("node", F.get("id", F.lit(i))).join(there, "node").where("gone is null or gone < born").drop("node", "gone")
    out = alive.join(_properties(log, alive, ("create_edge", "patch_edge")), "id", "left")
    return out.select(F.get("id", F.lit(0)).alias("src"), F.get("id", F.lit(1)).alias("type"), F.get("id", F.lit(2)).alias("dst"), _filled(out))


def rejected(log: DataFrame) -> DataFrame:
    """(lsn, op, id, reason): creations of what exists, changes and deletions of what doesn't."""
    kind = lambda w: F.col("op").isin(NODE[w], EDGE[w])
    before = F.last(F.when(kind("make"), True).when(kind("end"), False), True).over(Window.partitionBy("id").orderBy("lsn", "op").rowsBetween(Window.unboundedPreceding, -1))
    seen = log.withColumn("exists", F.coalesce(before, F.lit(False)))
    reason = F.when(kind("make") & F.col("exists"), "exists already").when(~kind("make") & ~F.col("exists"), "does not exist")
    return seen.select("lsn", "op", "id", reason.alias("reason")).where("reason is not null")


def applied(log: DataFrame) -> DataFrame:
    """The log without its rejected mutations."""
    return log.join(rejected(log).select("lsn", "op", "id"), ["lsn", "op", "id"], "left_anti").select(*log.columns)


def created(nodes: DataFrame, edges: DataFrame, lsn: int = 0) -> DataFrame:
    """Tables as the beginning of a log: columns other than keys and labels become properties."""

    def props(df: DataFrame, keys: tuple) -> Column:
        return F.map_filter(F.create_map(*[x for c in df.columns if c not in keys for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())

    at = F.lit(lsn).cast("long").alias("lsn")
    n = nodes.select(at, F.lit("create_node").alias("op"), F.array(F.col("node_id").cast("string")).alias("id"), "labels", props(nodes, ("node_id", "labels")).alias("props"))
    e = edges.select(at, F.lit("create_edge").alias("op"), F.array(*[F.col(c).cast("string") for c in ("src", "type", "dst")]).alias("id"), F.array().cast("array<string>").alias("labels"), props(edges, ("src", "type", "dst")).alias("props"))
    return n.unionByName(e)
