"""Queries over the order graph: nodes C:, O:, P:, S:, N:, R: and typed edges weighted by quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..plans.graph_language import Graph


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def edges(spark, sf_dir) -> DataFrame:
    def e(df, a, b, kind, w=None):
        return df.select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(kind).alias("type"), (F.col(w) if w else F.lit(1.0)).cast("double").alias("weight"))

    li = _t(spark, sf_dir, "lineitem")
    parts = [
        e(_t(spark, sf_dir, "orders"), ("C", "o_custkey"), ("O", "o_orderkey"), "PLACED"),
        e(li, ("O", "l_orderkey"), ("P", "l_partkey"), "CONTAINS", "l_quantity"),
        e(li, ("P", "l_partkey"), ("S", "l_suppkey"), "SUPPLIED_BY", "l_quantity").groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight")),
        e(_t(spark, sf_dir, "supplier"), ("S", "s_suppkey"), ("N", "s_nationkey"), "LOCATED_IN"),
        e(_t(spark, sf_dir, "customer"), ("C", "c_custkey"), ("N", "c_nationkey"), "LOCATED_IN"),
        e(_t(spark, sf_dir, "nation"), ("N", "n_nationkey"), ("R", "n_regionkey"), "IN_REGION"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark, sf_dir) -> DataFrame:
    def n(table, prefix, key, label, name=None, score=None):
        d = _t(spark, sf_dir, table)
        return d.select(_id(prefix, key).alias("node_id"), F.array(F.lit(label)).alias("labels"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"), (F.col(score) if score else F.lit(None)).cast("double").alias("score"))

    parts = [
        n("customer", "C", "c_custkey", "Customer", "c_mktsegment", "c_acctbal"),
        n("orders", "O", "o_orderkey", "Order", "o_orderpriority", "o_totalprice"),
        n("part", "P", "p_partkey", "Part", "p_brand", "p_retailprice"),
        n("supplier", "S", "s_suppkey", "Supplier", "s_name", "s_acctbal"),
        n("nation", "N", "n_nationkey", "Nation", "n_name"),
        n("region", "R", "r_regionkey", "Region", "r_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _small(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nations, regions, suppliers and the customers of one segment: a graph for the iterative algorithms."""
    e = edges(spark, sf_dir).where("type in ('LOCATED_IN', 'IN_REGION')")
    return nodes(spark, sf_dir).where("labels[0] in ('Customer', 'Supplier', 'Nation', 'Region')"), e


def _parts_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers of a nation joined by parts that both deliver: undirected, src < dst."""
    li, s = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    ps = li.select("l_partkey", "l_suppkey").join(s, "l_suppkey").where("l_partkey is not null and s_nationkey is not null")
    # suppliers of a part and nation meet in their group's row, read once for all steps of an algorithm
    together = ps.groupBy("l_partkey", "s_nationkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("all")).where("size(all) > 1")
    first = together.select("all", F.posexplode("all").alias("i", "src")).where("i < size(all) - 1")
    e = first.select("src", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("dst")).distinct()
    e = graph.written(e.withColumn("type", F.lit("T")).withColumn("weight", F.lit(1.0)))
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id")), e


def graph_expand_1(spark, sf_dir):
    starts = spark.createDataFrame([("C:1",), ("C:2",), ("C:7",)], ["start"])
    return graph.expand(edges(spark, sf_dir), starts, "out", ["PLACED"]).select("start", "to")


def graph_expand_undirected(spark, sf_dir):
    starts = spark.createDataFrame([("N:3",)], ["start"])
    return graph.expand(edges(spark, sf_dir), starts, "both").select("start", "to")


def graph_expand_1_3(spark, sf_dir):
    starts = spark.createDataFrame([("C:1",), ("C:5",)], ["start"])
    return graph.reach(edges(spark, sf_dir), starts, 3).select("start", "node", F.col("depth").cast("long").alias("depth"))


def graph_query(spark, sf_dir):
    g = Graph(nodes(spark, sf_dir), edges(spark, sf_dir))
    return g.run("MATCH (c:Customer {name: 'BUILDING'})-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE c.score > 5000 AND (p.score < 950 OR o.name = $urgent) AND NOT o.score IS NULL RETURN c, o, p.name", urgent="1-URGENT")


def graph_optional(spark, sf_dir):
    g = Graph(nodes(spark, sf_dir), edges(spark, sf_dir))
    return g.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) OPTIONAL MATCH (s:Supplier)-[:LOCATED_IN]->(n) WHERE r.name = 'ASIA' RETURN n, r.name, s").select("n", "r_name", F.coalesce("s", F.lit("-")).alias("s"))


def graph_hops(spark, sf_dir):
    g = Graph(nodes(spark, sf_dir), edges(spark, sf_dir))
    return g.run("MATCH (s:Supplier)-[*1..2]->(r:Region) WHERE s.score > 0 RETURN s, r.name LIMIT 50")


def graph_vector_seed(spark, sf_dir):
    """The nearest vectors as start of an expansion to vectors of the same label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = v.select(F.col("vec_id").alias("node_id"), F.array(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("labels"), "embedding")
    e = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") + F.col("label") + 1) % v.count()).cast("long").alias("dst"), F.lit("NEXT").alias("type"))
    q = v.where("vec_id = 0").first()["embedding"]
    return Graph(n, e, "embedding").run("VECTOR MATCH (a) USING $q LIMIT 5 CONTRACT Exact MATCH (a)-[:NEXT]->(b) RETURN a, b", q=q)


def graph_degree(spark, sf_dir):
    n, e = _small(spark, sf_dir)
    return graph.degrees(n, e)


def graph_centrality(spark, sf_dir):
    n, e = _small(spark, sf_dir)
    return graph.degree_centrality(n, e).select("node_id", F.round("centrality", 6).alias("centrality"))


def graph_degree_stats(spark, sf_dir):
    out = graph.degree_stats(*_small(spark, sf_dir))
    return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns])


def graph_stats(spark, sf_dir):
    return graph.cardinality(nodes(spark, sf_dir), edges(spark, sf_dir)).select("type", "edges", F.round("share", 6).alias("share"), F.round("avg_out", 6).alias("avg_out"))


def graph_label_stats(spark, sf_dir):
    return graph.label_shares(nodes(spark, sf_dir), edges(spark, sf_dir)).select("label", "nodes", F.round("share", 6).alias("share"), "most_out")


def graph_hubs(spark, sf_dir):
    return graph.hubs(nodes(spark, sf_dir), edges(spark, sf_dir), 10)


def graph_orphans(spark, sf_dir):
    return graph.orphans(nodes(spark, sf_dir), edges(spark, sf_dir).where("type = 'PLACED'"))


def graph_bfs(spark, sf_dir):
    return graph.bfs(edges(spark, sf_dir).where("type in ('LOCATED_IN', 'IN_REGION')"), "C:1", "both", 6).select("node", F.col("distance").cast("long").alias("distance"))


def graph_sssp(spark, sf_dir):
    e = edges(spark, sf_dir).where("type in ('PLACED', 'CONTAINS')")
    return graph.shortest_costs(e, "C:1").select("node", F.round("cost", 4).alias("cost"))


def graph_path(spark, sf_dir):
    return graph.path(edges(spark, sf_dir).where("type in ('LOCATED_IN', 'IN_REGION')"), "C:1", "S:3", 8, "both").select(F.col("hops").cast("long").alias("hops"))


def graph_wcc(spark, sf_dir):
    e = edges(spark, sf_dir).where("type = 'IN_REGION' or (type = 'LOCATED_IN' and src like 'S:%')")
    return graph.components(nodes(spark, sf_dir).where("labels[0] in ('Supplier', 'Nation', 'Region')"), e)


def graph_kcore(spark, sf_dir):
    return graph.k_core(*_parts_graph(spark, sf_dir)).select("node_id", F.col("core").cast("long").alias("core"))


def graph_pagerank(spark, sf_dir):
    n, e = _parts_graph(spark, sf_dir)
    return graph.page_rank(n, e, rounds=5, tolerance=0.0).select("node_id", F.round("rank", 6).alias("rank"))


def graph_triangles(spark, sf_dir):
    return graph.triangles(*_parts_graph(spark, sf_dir)).select("node_id", F.col("triangles").cast("long").alias("triangles"), F.round("clustering", 5).alias("clustering"))


def graph_communities(spark, sf_dir):
    """Modularity of label communities; the rule-bound labels themselves have no SQL."""
    n, e = _small(spark, sf_dir)
    return graph.modularity(e, graph.label_communities(n, e, 6)).select(F.round("modularity", 5).alias("modularity"))


def graph_cycles(spark, sf_dir):
    """Cycles among vectors that point on by their label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + F.col("label")) % v.count()).cast("long").alias("dst"))
    return graph.cycles(e)


def graph_traverse(spark, sf_dir):
    e = edges(spark, sf_dir).where("type in ('LOCATED_IN', 'IN_REGION') and not (src like 'C:%')")
    return graph.traverse(e, "R:2", 2).select("node", F.col("depth").cast("long").alias("depth"))


def graph_impact(spark, sf_dir):
    e = edges(spark, sf_dir).where("type in ('LOCATED_IN', 'IN_REGION') and not (src like 'C:%')")
    return graph.impact(e, "R:1", 2).select("node", F.col("depth").cast("long").alias("depth"))


def graph_neighbourhood(spark, sf_dir):
    return graph.neighbourhood(edges(spark, sf_dir), "O:5")


QUERIES = {k: v for k, v in globals().items() if k.startswith("graph_") and callable(v)}

_E = """e AS (SELECT 'C:' || o_custkey AS src, 'O:' || o_orderkey AS dst, 'PLACED' AS type, 1.0::DOUBLE AS weight FROM orders
UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'CONTAINS', l_quantity FROM lineitem
UNION ALL SELECT 'P:' || l_partkey, 'S:' || l_suppkey, 'SUPPLIED_BY', sum(l_quantity) FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'LOCATED_IN', 1.0 FROM supplier
UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'LOCATED_IN', 1.0 FROM customer
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'IN_REGION', 1.0 FROM nation)"""
_N = """n AS (SELECT 'C:' || c_custkey AS node_id, 'Customer' AS label FROM customer UNION ALL SELECT 'O:' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'P:' || p_partkey, 'Part' FROM part
UNION ALL SELECT 'S:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'Region' FROM region)"""
_SMALL = f"{_E}, {_N}, se AS (SELECT * FROM e WHERE type IN ('LOCATED_IN', 'IN_REGION')), sn AS (SELECT * FROM n WHERE label IN ('Customer', 'Supplier', 'Nation', 'Region'))"
_DEG = f"{_SMALL}, d AS (SELECT node_id, (SELECT count(*) FROM se WHERE src = node_id) AS out_degree, (SELECT count(*) FROM se WHERE dst = node_id) AS in_degree FROM sn)"
_PG = "ps AS (SELECT DISTINCT l_partkey, l_suppkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), g AS (SELECT DISTINCT x.l_suppkey AS src, y.l_suppkey AS dst FROM ps x JOIN ps y ON x.l_partkey = y.l_partkey AND x.s_nationkey = y.s_nationkey AND x.l_suppkey < y.l_suppkey)"
_UND = "u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"


def _reach(start: str, edges_: str, most: int, inner: str) -> str:
    return f"{inner}, r AS (SELECT {start} AS start, {start} AS node, 0 AS depth UNION SELECT r.start, w.dst, r.depth + 1 FROM r JOIN {edges_} w ON w.src = r.node WHERE r.depth < {most})"


_RANKS = "".join(f", p{i} AS (SELECT node_id, 0.15::DOUBLE / (SELECT count(*) FROM supplier) + 0.85 * (coalesce((SELECT sum(rank / d) FROM p{i - 1} q JOIN g ON g.src = q.node_id JOIN od ON od.src = g.src WHERE g.dst = s.node_id), 0) + (SELECT coalesce(sum(rank), 0) FROM p{i - 1} WHERE node_id NOT IN (SELECT src FROM g)) / (SELECT count(*) FROM supplier)) AS rank FROM p0 s)" for i in range(1, 6))
ORACLE_SQL = {
    "graph_expand_1": f"WITH {_E} SELECT src AS start, dst AS to FROM e WHERE type = 'PLACED' AND src IN ('C:1', 'C:2', 'C:7')",
    "graph_expand_undirected": f"WITH {_E} SELECT 'N:3' AS start, dst AS to FROM e WHERE src = 'N:3' UNION ALL SELECT 'N:3', src FROM e WHERE dst = 'N:3'",
    "graph_expand_1_3": f"WITH RECURSIVE {_E}, r AS (SELECT s AS start, s AS node, 0 AS depth FROM (VALUES ('C:1'), ('C:5')) t(s) UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT start, node, min(depth)::BIGINT AS depth FROM r GROUP BY ALL HAVING min(depth) > 0",
    "graph_query": "SELECT 'C:' || c_custkey AS c, 'O:' || o_orderkey AS o, p_brand AS p_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND (p_retailprice < 950 OR o_orderpriority = '1-URGENT')",
    "graph_optional": "SELECT 'N:' || n_nationkey AS n, r_name, coalesce('S:' || s_suppkey, '-') AS s FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'",
    "graph_hops": "SELECT 'S:' || s_suppkey AS s, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 0 ORDER BY 1, 2 LIMIT 50",
    "graph_vector_seed": "SELECT vec_id AS a, (vec_id + label + 1) % (SELECT count(*) FROM embeddings) AS b FROM (SELECT e.vec_id, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) DESC, vec_id LIMIT 5)",
    "graph_degree": f"WITH {_DEG} SELECT node_id, out_degree, in_degree, out_degree + in_degree AS degree FROM d",
    "graph_centrality": f"WITH {_DEG} SELECT node_id, round((out_degree + in_degree)::DOUBLE / ((SELECT count(*) FROM sn) - 1), 6) AS centrality FROM d",
    "graph_degree_stats": f"WITH {_DEG} SELECT " + ", ".join(f"round({f}({c})::DOUBLE, 6) AS {f}_{c}" for c in ("out_degree", "in_degree") for f in ("min", "max", "avg")) + " FROM d",
    "graph_stats": f"WITH {_E} SELECT type, count(*) AS edges, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 6) AS share, round(count(*)::DOUBLE / count(DISTINCT src), 6) AS avg_out FROM e GROUP BY type",
    "graph_label_stats": f"WITH {_E}, {_N}, d AS (SELECT src, count(*) AS d FROM e GROUP BY src) SELECT label, count(*) AS nodes, round(count(*)::DOUBLE / (SELECT count(*) FROM n), 6) AS share, coalesce(max(d), 0)::BIGINT AS most_out FROM n LEFT JOIN d ON src = node_id GROUP BY label",
    "graph_hubs": f"WITH {_E} SELECT src AS node_id, count(*) AS out_degree FROM e GROUP BY src ORDER BY 2 DESC, 1 LIMIT 10",
    "graph_orphans": f"WITH {_N} SELECT node_id FROM n WHERE node_id NOT IN (SELECT 'C:' || o_custkey FROM orders UNION SELECT 'O:' || o_orderkey FROM orders)",
    "graph_bfs": f"WITH RECURSIVE {_SMALL}, w AS (SELECT src, dst FROM se UNION SELECT dst, src FROM se), {_reach(chr(39) + 'C:1' + chr(39), 'w', 6, '_x AS (SELECT 1)')} SELECT node, min(depth)::BIGINT AS distance FROM r GROUP BY node",
    "graph_sssp": "SELECT 'C:1' AS node, 0.0::DOUBLE AS cost UNION ALL SELECT 'O:' || o_orderkey, 1.0 FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'P:' || l_partkey, round(1 + min(l_quantity), 4) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 1 GROUP BY 1",
    "graph_path": f"WITH RECURSIVE {_SMALL}, w AS (SELECT src, dst FROM se UNION SELECT dst, src FROM se), {_reach(chr(39) + 'C:1' + chr(39), 'w', 6, '_x AS (SELECT 1)')} SELECT min(depth)::BIGINT AS hops FROM r WHERE node = 'S:3' HAVING min(depth) IS NOT NULL",
    "graph_wcc": "WITH x AS (SELECT 'N:' || n_nationkey AS node_id, n_regionkey AS r FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_regionkey FROM region UNION ALL SELECT 'S:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT node_id, min(node_id) OVER (PARTITION BY r) AS component FROM x",
    "graph_pagerank": f"WITH {_PG}, od AS (SELECT src, count(*) AS d FROM g GROUP BY src), p0 AS (SELECT s_suppkey AS node_id, 1.0::DOUBLE / (SELECT count(*) FROM supplier) AS rank FROM supplier){_RANKS} SELECT node_id, round(rank, 6) AS rank FROM p5",
    "graph_triangles": f"WITH {_PG}, {_UND}, t AS (SELECT a.src AS v, count(*) AS t FROM u a JOIN u b ON a.src = b.src AND a.dst < b.dst JOIN g ON g.src = a.dst AND g.dst = b.dst GROUP BY 1), k AS (SELECT src AS v, count(*) AS d FROM u GROUP BY 1) SELECT s_suppkey AS node_id, coalesce(t.t, 0)::BIGINT AS triangles, round(CASE WHEN coalesce(d, 0) > 1 THEN 2.0::DOUBLE * coalesce(t.t, 0) / (d * (d - 1)) ELSE 0 END, 5) AS clustering FROM supplier LEFT JOIN t ON t.v = s_suppkey LEFT JOIN k ON k.v = s_suppkey",
    "graph_cycles": "WITH RECURSIVE g AS (SELECT vec_id AS src, (vec_id * 7 + label) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings), r AS (SELECT src AS a, dst AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) SELECT a AS node, least(a, min(b)) AS component FROM m GROUP BY a",
    "graph_traverse": f"WITH RECURSIVE {_SMALL}, w AS (SELECT src, dst FROM se WHERE src NOT LIKE 'C:%' UNION SELECT dst, src FROM se WHERE src NOT LIKE 'C:%'), {_reach(chr(39) + 'R:2' + chr(39), 'w', 2, '_x AS (SELECT 1)')} SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node HAVING min(depth) > 0",
    "graph_impact": "SELECT 'N:' || n_nationkey AS node, 1::BIGINT AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'S:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1",
    "graph_neighbourhood": "SELECT DISTINCT 'P:' || l_partkey AS node_id, 'CONTAINS' AS type FROM lineitem WHERE l_orderkey = 5 UNION ALL SELECT 'C:' || o_custkey, 'PLACED' FROM orders WHERE o_orderkey = 5",
}
