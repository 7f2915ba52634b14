"""Communities of undirected weighted graphs by modularity, in rounds over all nodes, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .tables import dealt


def _moved(nodes: DataFrame, both: DataFrame, degree: DataFrame, m2: float, rounds: int) -> DataFrame:
    """(node_id, community) after rounds in which alternate halves of the nodes move where modularity gains most.

    both (src, dst, w): each edge in both directions, no loops. degree (node_id, k), loops counted twice; m2 is their sum. A round's result is
    kept only while modularity rises; ties go to the smaller community.
    """
    labels = written(nodes.join(degree, "node_id", "left").select("node_id", F.col("node_id").alias("community"), F.coalesce("k", F.lit(0.0)).alias("k")))
    best, best_q, still = labels, None, 0
    for r in range(2 * rounds):
        named = labels.select(F.col("node_id").alias("dst"), F.col("community").alias("c"))
        near = both.join(named, "dst").select(F.col("src").alias("node_id"), "c", "w")
        links = near.unionByName(labels.select("node_id", F.col("community").alias("c"), F.lit(0.0).alias("w"))).groupBy("node_id", "c").agg(F.sum("w").alias("k_in"))
        total = labels.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("tot"))
        scored = labels.where(F.pmod(F.xxhash64("node_id"), F.lit(2)) == r % 2).join(links, "node_id").join(total, "c")
        away = F.col("c") != F.col("community")
        gain = F.round(F.col("k_in") - F.col("k") * (F.col("tot") - F.when(away, 0.0).otherwise(F.col("k"))) / m2, 9)
        moves = scored.groupBy("node_id").agg(F.min(F.struct((-gain).alias("loss"), away.alias("away"), "c")).alias("to")).select("node_id", "to.c")
        new = written(labels.join(moves, "node_id", "left").select("node_id", F.coalesce("c", "community").alias("community"), "k", (F.col("c") != F.col("community")).alias("moved")))
        still = 0 if new.where("moved").limit(1).count() else still + 1
        labels = new.drop("moved")
        if r % 2:
            q = _quality(labels, both, m2)
            if best_q is not None and q <= best_q + 1e-9:
                break
            best, best_q = labels, q
        if still > 1:
            break
    return best.select("node_id", "community")


def _quality(labels: DataFrame, both: DataFrame, m2: float) -> float:
    """Modularity but for the part that loops give, which is the same for all labels."""
    a, b = labels.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), labels.select(F.col("node_id").alias("dst"), F.col("community").alias("cd"))
    inside = both.join(a, "src").join(b, "dst").where("cs = cd").agg(F.sum("w").alias("w")).first()["w"] or 0.0
    around = labels.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / m2, 2)).alias("s")).first()["s"] or 0.0
    return inside / m2 - around


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 3, rounds: int = 20) -> DataFrame:
    """(node_id, community): communities by modularity, coarsened up to `levels` times; a community is named by its smallest node.

    Edges count as undirected, parallel ones add up, null weights count 1, ends without a node are left out. Nodes without edges stay alone.
    All nodes of a half move at once, so the partition may differ from that of moves one by one.
    """
    ids = written(nodes.select("node_id").distinct())
    w = edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))
    w = w.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    w = written(w.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w")))
    m2 = 2.0 * (w.agg(F.sum("w").alias("s")).first()["s"] or 0.0)
    result = ids.select("node_id", F.col("node_id").alias("community"))
    if m2 <= 0:
        return result
    level = ids
    for _ in range(levels):
        flat = w.where("src <> dst")
        both = written(flat.select("src", "dst", "w").unionByName(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
        ends = both.select(F.col("src").alias("node_id"), "w").unionByName(w.where("src = dst").select(F.col("src").alias("node_id"), (F.col("w") * 2).alias("w")))
        degree = written(ends.groupBy("node_id").agg(F.sum("w").alias("k")))
        labels = _moved(level, both, degree, m2, rounds)
        named = labels.groupBy("community").agg(F.min("node_id").alias("name"))
        labels = written(labels.join(named, "community").select("node_id", F.col("name").alias("community")))
        if not labels.where("node_id <> community").limit(1).count():
            break
        result = written(result.withColumnRenamed("community", "c").join(labels.select(F.col("node_id").alias("c"), "community"), "c").select("node_id", "community"))
        a, b = labels.select(F.col("node_id").alias("src"), F.col("community").alias("a")), labels.select(F.col("node_id").alias("dst"), F.col("community").alias("b"))
        w = written(w.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")))
        level = labels.select(F.col("community").alias("node_id")).distinct()
    return result


def pairs_of(bindings: DataFrame) -> DataFrame:
    """(src, dst, type, weight): entities (relation_id, entity) that relations bind together, weighted by how many do.

    A relation's roles are few; relations of unbounded size should be edges to a node of their own instead."""
    n = bindings.count()
    named = bindings.select("relation_id", "entity").where("relation_id is not null and entity is not null")
    sets = dealt(named, "relation_id", most=n).groupBy("relation_id").agg(F.array_sort(F.collect_set("entity")).alias("all")).where("size(all) > 1")
    first = sets.select("all", F.posexplode("all").alias("i", "src")).where("i < size(all) - 1")
    pairs = first.select("src", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("dst"))
    return dealt(pairs, "src", "dst", most=n).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).withColumn("type", F.lit("TOGETHER"))


def scopes(members: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """(scope_id, label, entity_count, top_entities): communities (node_id, community), largest first, then by smallest member.

    labels (node_id, label). The first `top` members by id stand for a scope; its label is the first one's."""
    rows = members.join(labels, "node_id", "left")
    rank = F.row_number().over(Window.partitionBy("community").orderBy("node_id"))
    first = rows.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]).alias("top_entities"))
    size = rows.groupBy("community").agg(F.count("*").alias("entity_count"), F.min("node_id").alias("_least"))
    out = size.join(first, "community")
    number = F.row_number().over(Window.orderBy(F.desc("entity_count"), "_least")) - 1  # one row a community
    return out.select(number.cast("long").alias("scope_id"), F.concat(F.lit("Scope: "), F.get("top_entities", F.lit(0))).alias("label"), "entity_count", "top_entities")
