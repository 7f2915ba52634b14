"""Queries over the star schema: filters, tables, versions, N-ary relations, cubes, plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_polygon, within_km
from ..operators import olap, tables, versions


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- geo ---------------------------------------------------------------------------------------------------------------

#: Supplier coordinates by a fixed formula.
LAT, LON = "((s_suppkey * 37) % 18000) / 100.0 - 90", "((s_suppkey * 91) % 36000) / 100.0 - 180"
RING = [(-88.0, -175.0), (-60.0, -160.0), (-55.0, -100.0), (-80.0, -90.0), (-72.0, -130.0)]


def _suppliers(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))


def geo_radius(spark, sf_dir):
    return _suppliers(spark, sf_dir).where(within_km(F.col("lat"), F.col("lon"), (-80.0, -120.0), 3000.0)).select("s_suppkey")


def geo_polygon(spark, sf_dir):
    return _suppliers(spark, sf_dir).where(in_polygon(F.col("lat"), F.col("lon"), RING)).select("s_suppkey")


# --- tables ------------------------------------------------------------------------------------------------------------


def sql_rls(spark, sf_dir):
    return tables.select(_t(spark, sf_dir, "customer"), F.col("c_acctbal") > 0, ("c_mktsegment", "BUILDING")).select("c_custkey", "c_name")


def sql_fk_violations(spark, sf_dir):
    """Customers that are gone leave orders behind."""
    parents = _t(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    return tables.foreign_key_violations(_t(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def log_fold_latest(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted"))
    return tables.fold_log(log, "user_id", "event_id", "deleted").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


def log_fold_asof(spark, sf_dir):
    """State at a past place of the log."""
    log = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tables.fold_log(log, "user_id", "event_id", upto=5000)


def sql_upsert(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changes = base.where("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal"))
    return tables.upsert(base, changes, "c_custkey").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def sql_delete(spark, sf_dir):
    base = _t(spark, sf_dir, "customer")
    return tables.delete(base.select("c_custkey"), base.where("c_acctbal < 0").select("c_custkey"), "c_custkey")


def insert_rejected(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return tables.rejected_inserts(c.select("c_custkey"), c.where("c_nationkey < 5").select("c_custkey"), "c_custkey")


# --- versions ----------------------------------------------------------------------------------------------------------


def _versions(spark, sf_dir):
    log = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return versions.closed_intervals(log, "o_custkey", ["o_orderdate", "o_orderkey"])


def entity_as_of(spark, sf_dir):
    return versions.as_of(_versions(spark, sf_dir), "o_custkey", 3).select("o_custkey", "o_orderkey", "valid_from")


def entity_current(spark, sf_dir):
    return versions.as_of(_versions(spark, sf_dir), "o_custkey", None).select("o_custkey", "o_orderkey", "valid_from")


def entity_history(spark, sf_dir):
    return _versions(spark, sf_dir).select("o_custkey", "o_orderkey", "valid_from", F.coalesce("valid_until", F.lit(versions.OPEN)).alias("valid_until"))


def status_violations(spark, sf_dir):
    """Moves from one order's state to the next that a small rule table forbids."""
    v = _versions(spark, sf_dir)
    moves = v.join(v.select("o_custkey", F.col("valid_from").alias("valid_until"), F.col("o_orderstatus").alias("after")), ["o_custkey", "valid_until"]).select("o_custkey", "valid_from", F.col("o_orderstatus").alias("before"), "after")
    return versions.illegal_moves(moves, "before", "after", [("O", "P"), ("P", "F")]).select("o_custkey", "valid_from", "before", "after")


# --- relations ---------------------------------------------------------------------------------------------------------


def _bindings(spark, sf_dir):
    """One relation for each line: roles order, part and supplier. Dealt by relation once, so that grouping by it needs no further shuffle."""
    li = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = tables.dealt(li, "relation_id").distinct()
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.concat(F.lit(p), F.col(c).cast("string")).alias("entity")) for r, p, c in (("order", "O:", "l_orderkey"), ("part", "P:", "l_partkey"), ("supplier", "S:", "l_suppkey"))])
    return li.select("relation_id", F.explode(roles).alias("x")).select("relation_id", "x.role", "x.entity")


def rel_role_query(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    relations = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"), F.lit("line").alias("type"), F.when(F.col("l_linestatus") == "F", "Observed").otherwise("Provisional").alias("epistemic"))
    return versions.relation_query(relations, _bindings(spark, sf_dir), [("supplier", "S:7")], ["line"], ["Observed"]).select("relation_id")


def rel_hyperpattern(spark, sf_dir):
    return versions.hyper_pattern(_bindings(spark, sf_dir), [("order", "?o"), ("part", "?p"), ("supplier", "S:5")])


def rel_projection(spark, sf_dir):
    return versions.binary_projection(_bindings(spark, sf_dir), ["supplier"], ["part"])


def rel_schema_check(spark, sf_dir):
    """A schema that wants a part, an order and no supplier of this name."""
    b = _bindings(spark, sf_dir).where("not (role = 'part' and entity like '%7')")
    return versions.schema_violations(b, [("order", 1, 1), ("part", 1, 1), ("supplier", 1, 2)])


def rel_signature(spark, sf_dir):
    return versions.structural_signature(_bindings(spark, sf_dir)).groupBy("arity", "signature").agg(F.count("*").alias("relations"))


def rel_fingerprint(spark, sf_dir):
    return versions.fingerprint(_bindings(spark, sf_dir))


# --- cubes -------------------------------------------------------------------------------------------------------------


def _cube(spark, sf_dir):
    li, part, supplier = (_t(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).join(supplier, li["l_suppkey"] == supplier["s_suppkey"])
    coords = F.array(F.month("l_shipdate") - 1, F.col("s_nationkey"), F.col("p_size"))
    return olap.Cube(rows.groupBy(coords.alias("coords")).agg(F.sum("l_quantity").alias("value")), [12, 25, 51])


def cube_slice(spark, sf_dir):
    out = _cube(spark, sf_dir).box([2, 5, 10], [4, 9, 20])
    return out.select(*[F.get("coords", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("month", "nation", "size"))], F.round("value", 2).alias("value"))


def cube_morton(spark, sf_dir):
    cells = _cube(spark, sf_dir).cells
    c = [F.get("coords", F.lit(i)) for i in range(3)]
    index = olap.morton(c, 6)
    back = olap.unmorton(index, 3, 6)
    return cells.select(index.alias("morton"), *[x.alias(f"d{i}") for i, x in enumerate(back)])


# --- SQL on registered views --------------------------------------------------------------------------------------------

SQL = {
    "sql_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "sql_join_revenue": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    "sql_rollup": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "sql_window": """
        SELECT o_custkey, o_orderkey, round(running, 2) AS running, rnk FROM (
          SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
                 CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rnk FROM orders) WHERE rnk <= 3""",
    "sql_set_ops": """
        SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000""",
    "sql_anti_join": """
        SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "sql_top_parts": """
        SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY qty DESC, p_brand LIMIT 10""",
}


def _sql(text: str, names: list[str]):
    def run(spark, sf_dir):
        for name in names:
            _t(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
QUERIES = {
    "geo_radius": geo_radius, "geo_polygon": geo_polygon, "sql_rls": sql_rls, "sql_fk_violations": sql_fk_violations, "log_fold_latest": log_fold_latest, "log_fold_asof": log_fold_asof,
    "sql_upsert": sql_upsert, "sql_delete": sql_delete, "insert_rejected": insert_rejected, "entity_as_of": entity_as_of, "entity_current": entity_current, "entity_history": entity_history,
    "status_violations": status_violations, "rel_role_query": rel_role_query, "rel_hyperpattern": rel_hyperpattern, "rel_projection": rel_projection, "rel_schema_check": rel_schema_check,
    "rel_signature": rel_signature, "rel_fingerprint": rel_fingerprint, "cube_slice": cube_slice, "cube_morton": cube_morton,
    **{k: _sql(v, [n for n in _NAMES if n in v]) for k, v in SQL.items()},
}

_HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, sin(radians(-80.0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(-80.0)) * sin(radians(-120.0 - lon) / 2) ** 2)))"
_S = f"s AS (SELECT s_suppkey, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon FROM supplier)"
_CROSS = " + ".join(f"CASE WHEN (({a}) > lat) <> (({c}) > lat) AND lon < ({d} - ({b})) * (lat - ({a})) / ({c} - ({a})) + ({b}) THEN 1 ELSE 0 END" for (a, b), (c, d) in zip(RING, RING[1:] + RING[:1], strict=True))
_V = "v AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w AS valid_from, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN NULL ELSE row_number() OVER w + 1 END AS valid_until FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_B = "b AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, unnest(['order', 'part', 'supplier']) AS role, unnest(['O:' || l_orderkey, 'P:' || l_partkey, 'S:' || l_suppkey]) AS entity FROM lineitem)"
_C = "c AS (SELECT month(l_shipdate) - 1 AS m, s_nationkey AS n, p_size AS z, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
ORACLE_SQL = {
    "geo_radius": f"WITH {_S} SELECT s_suppkey FROM s WHERE {_HAVERSINE} <= 3000",
    "geo_polygon": f"WITH {_S} SELECT s_suppkey FROM s WHERE ({_CROSS}) % 2 = 1",
    "sql_rls": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    "sql_fk_violations": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)",
    "log_fold_latest": "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    "log_fold_asof": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 5000) WHERE r = 1",
    "sql_upsert": "SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS c_acctbal FROM customer",
    "sql_delete": "SELECT c_custkey FROM customer WHERE c_acctbal >= 0",
    "insert_rejected": "SELECT c_custkey FROM customer WHERE c_nationkey < 5",
    "entity_as_of": f"WITH {_V} SELECT o_custkey, o_orderkey, valid_from FROM v WHERE valid_from <= 3 AND (valid_until IS NULL OR 3 < valid_until)",
    "entity_current": f"WITH {_V} SELECT o_custkey, o_orderkey, valid_from FROM v WHERE valid_until IS NULL",
    "entity_history": f"WITH {_V} SELECT o_custkey, o_orderkey, valid_from, coalesce(valid_until, 9223372036854775807) AS valid_until FROM v",
    "status_violations": f"WITH {_V} SELECT a.o_custkey, a.valid_from, a.o_orderstatus AS before, b.o_orderstatus AS after FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.valid_until = b.valid_from WHERE a.o_orderstatus <> b.o_orderstatus AND (a.o_orderstatus, b.o_orderstatus) NOT IN (('O', 'P'), ('P', 'F'))",
    "rel_role_query": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id FROM lineitem WHERE l_suppkey = 7 AND l_linestatus = 'F'",
    "rel_hyperpattern": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, 'O:' || l_orderkey AS o, 'P:' || l_partkey AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) WHERE l_suppkey = 5",
    "rel_projection": "SELECT DISTINCT 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst FROM lineitem",
    "rel_schema_check": "SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, 'part' AS role, 'missing role' AS problem FROM lineitem WHERE l_partkey % 10 = 7",
    "rel_signature": "SELECT 3::BIGINT AS arity, sha256('3|1,1,1') AS signature, count(*) AS relations FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)",
    "rel_fingerprint": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, sha256('order=O:' || l_orderkey || ';part=P:' || l_partkey || ';supplier=S:' || l_suppkey) AS fingerprint FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)",
    "cube_slice": f"WITH {_C} SELECT m AS month, n::BIGINT AS nation, z::BIGINT AS size, round(value, 2) AS value FROM c WHERE m BETWEEN 2 AND 4 AND n BETWEEN 5 AND 9 AND z BETWEEN 10 AND 20",
    "cube_morton": f"WITH {_C} SELECT (" + " + ".join(f"(((({x})::BIGINT >> {b}) & 1) << {3 * b + d})" for b in range(6) for d, x in enumerate("mnz")) + ")::BIGINT AS morton, m::BIGINT AS d0, n::BIGINT AS d1, z::BIGINT AS d2 FROM c",
    **SQL,
}
