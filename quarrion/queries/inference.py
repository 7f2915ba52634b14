"""Queries over cells and codes of vectors, communities, operator chains, seeded code search, outcomes, exports and framed logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, communities, context, reasoning
from ..operators.graph import modularity, shared_folder, written
from ..sources import stores
from .graphs import _id, _parts_graph
from .graphs import edges as graph_edges
from .vectors import COSINE, DOT


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors -----------------------------------------------------------------------------------------------------------


def _query(v: DataFrame, vec_id: int = 3):
    return v.where(F.col("vec_id") == vec_id).first()["embedding"]


def _cells(spark, sf_dir, metric: str):
    v = _t(spark, sf_dir, "embeddings")
    centres = cells.fit_cells(v, 32, metric)
    assigned = written(cells.assign(v, centres, metric))
    return v, centres, assigned, written(cells.cell_sizes(assigned))


def cell_topk(spark, sf_dir):
    """The nearest vectors, cells that can't hold one left out."""
    v, centres, assigned, sizes = _cells(spark, sf_dir, "cosine")
    return cells.cell_top_k(assigned, sizes, centres, _query(v), 10, "cosine").select("vec_id", F.round("score", 5).alias("score"), "certified")


def cell_probe(spark, sf_dir):
    """Few cells only: hits say whether they are proven."""
    v, centres, assigned, sizes = _cells(spark, sf_dir, "euclidean")
    return cells.cell_top_k(assigned, sizes, centres, _query(v), 10, "euclidean", 4)


def coded_topk(spark, sf_dir):
    """The greatest inner products by one-byte codes, then in full."""
    v = _t(spark, sf_dir, "embeddings")
    return cells.coded_top_k(written(cells.coded(v)), v, _query(v), 10).select("vec_id", F.round("score", 5).alias("score"))


def address_topk(spark, sf_dir):
    """The nearest vectors among those whose lattice points are nearest to the query's."""
    v = _t(spark, sf_dir, "embeddings")
    addresses = written(cells.addressed(v, 8.0))
    own = addresses.where("vec_id = 3").first()["address"]
    return cells.address_top_k(addresses, v, _query(v), own, 10, 200).select("vec_id", F.round("score", 5).alias("score"))


# --- communities -------------------------------------------------------------------------------------------------------


def graph_louvain(spark, sf_dir):
    """Communities of suppliers that deliver the same parts."""
    n, e = _parts_graph(spark, sf_dir)
    return communities.louvain(n, e)


def graph_louvain_quality(spark, sf_dir):
    n, e = _parts_graph(spark, sf_dir)
    e = written(e)
    return modularity(e, communities.louvain(n, e)).select(F.round("modularity", 5).alias("modularity"))


def scope_summaries(spark, sf_dir):
    """Nations by region as scopes, suppliers as their members."""
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    members = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("node_id"), F.col("n_regionkey").alias("community"))
    found = communities.scopes(members, s.select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("label")))
    return found.select("scope_id", "label", "entity_count", F.concat_ws("|", "top_entities").alias("top"))


def bound_pairs(spark, sf_dir):
    """Suppliers that orders bind together, by the number of orders."""
    b = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation_id"), F.col("l_suppkey").alias("entity"))
    return communities.pairs_of(b).select("src", "dst", F.col("weight").cast("long").alias("weight"))


# --- reasoning ---------------------------------------------------------------------------------------------------------


def operator_chains(spark, sf_dir):
    """The nations of each region as a chain of operators of two blades each."""
    n = _t(spark, sf_dir, "nation")
    blade = lambda k: F.expr(f"CAST(shiftleft(1, n_nationkey % {k}) AS INT)")
    rows = n.select(F.col("n_regionkey").alias("chain_id"), F.col("n_nationkey").alias("position"), F.explode(F.array(F.struct(F.lit(0).alias("b"), F.lit(1.0).alias("x")), F.struct(blade(8).bitwiseOR(blade(5)).alias("b"), (1 / (1.0 + F.col("n_nationkey"))).alias("x")))).alias("t"))
    return reasoning.composed_chains(rows.select("chain_id", "position", F.col("t.b").alias("blade"), F.col("t.x").alias("coefficient")), 8)


def region_alignment(spark, sf_dir):
    """Labels as regions of eight centroids, each aligned with the next label."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("region"), (F.col("vec_id") % 8).alias("part"), F.posexplode(F.slice("embedding", 1, 8)).alias("i", "x"))
    means = rows.groupBy("region", "part", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    points = written(means.groupBy("region", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("coords")))
    regions = points.select("region").distinct()
    pairs = regions.select(F.col("region").alias("a"), (F.col("region") + 1).alias("b"))
    return reasoning.region_alignment(points, pairs)


def operator_monitor(spark, sf_dir):
    """What is to be done with each user's operator after what was observed."""
    e = _t(spark, sf_dir, "events")
    seen = e.select((F.col("user_id") % 50).alias("operator_id"), ((F.col("event_id") % 10) / 10.0).alias("predicted"), ((F.col("event_id") % 4 != 0) | (F.col("user_id") % 3 == 0)).alias("correct"), (F.col("event_type") == "error").alias("failed"))
    found = reasoning.monitored(seen)
    return found.select("operator_id", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "calibration_error", "failure_ratio")], "action")


def operator_actions(spark, sf_dir):
    """The actions of a cycle in the order in which the log takes them."""
    found = operator_monitor(spark, sf_dir).select(F.col("action").alias("kind"), "operator_id")
    return reasoning.action_stream(found, ["roll_back", "revise"])


def outcome_states(spark, sf_dir):
    """Orders as cases, their lines as outcomes: a returned line fails, a shipped one with a receipt is measured."""
    li = _t(spark, sf_dir, "lineitem")
    evidence, state = reasoning.outcome_classes(F.col("l_returnflag") == "N", F.col("l_discount") > 0.05)
    told = li.select(F.col("l_orderkey").alias("case_id"), evidence.alias("evidence"), state.alias("state"))
    return told.groupBy("evidence", "state").agg(F.count("*").alias("n"))


def case_resolutions(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    _, state = reasoning.outcome_classes(F.col("l_returnflag") == "N", F.col("l_discount") > 0.05)
    told = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_linestatus") == "O").alias("success"), state.alias("state"))
    return reasoning.resolutions(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id")), told)


# --- code and exports --------------------------------------------------------------------------------------------------


def seeded_code(spark, sf_dir):
    """Nations and regions as symbols: the best for a query and what lies around them."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    row = lambda d, p, k, name: d.select(_id(p, k).alias("id"), F.col(name).alias("name"), F.concat(F.lit(f"{p}."), F.col(name)).alias("qualified"), F.lit(None).cast("string").alias("doc"))
    s = row(n, "N", "n_nationkey", "n_name").unionByName(row(r, "R", "r_regionkey", "r_name"))
    e = graph_edges(spark, sf_dir).where("type in ('LOCATED_IN', 'IN_REGION')").select("src", "dst", F.when(F.col("type") == "IN_REGION", "CALLS").otherwise("USES").alias("type"))
    return context.seeded_query(s, e, "united (asia)", 2)


def markdown_export(spark, sf_dir):
    return context.markdown_rows(_t(spark, sf_dir, "supplier"), ["s_suppkey", "s_name", "s_nationkey"])


def html_export(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return context.html_rows(d, ["doc_id", "lang", "source"])


def log_replay(spark, sf_dir):
    """Events written as a framed log and read back behind a truncation."""
    shared = shared_folder(spark)
    path = f"{shared}/frames-{uuid.uuid4().hex}"
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), "user_id", "event_type")
    stores.write_frames(e, path, per_segment=4000)
    return stores.replay_frames(spark, path, "lsn long, user_id long, event_type string", 100)


QUERIES = {f.__name__: f for f in (cell_topk, cell_probe, coded_topk, address_topk, graph_louvain, graph_louvain_quality, scope_summaries, bound_pairs, operator_chains, region_alignment, operator_monitor, operator_actions, outcome_states, case_resolutions, seeded_code, markdown_export, html_export, log_replay)}


def _near(score: str, more: str = "") -> str:
    return f"SELECT vec_id, round(s, 5) + 0.0 AS score{more} FROM (SELECT e.vec_id, {score} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q) ORDER BY s DESC, vec_id LIMIT 10"


_MONITOR = """p AS (SELECT user_id % 50 AS operator_id, count(*) AS n, avg((event_id % 4 <> 0 OR user_id % 3 = 0)::INT::DOUBLE) AS a, avg((event_id % 10) / 10.0) AS g, avg((event_type = 'error')::INT::DOUBLE) AS f FROM events GROUP BY 1),
m AS (SELECT operator_id, n, a, abs(g - a) AS c, f, CASE WHEN n < 20 THEN 'wait' WHEN a < 0.75 OR f > 0.25 THEN 'roll_back' WHEN abs(g - a) > 0.25 THEN 'revise' ELSE 'keep' END AS action FROM p)"""
_STATE = "CASE WHEN l_returnflag = 'N' THEN 'verified' WHEN l_discount > 0.05 THEN 'reported_unverified' ELSE 'unverified' END"
ORACLE_SQL = {
    "cell_topk": _near(COSINE, ", true AS certified"),
    "coded_topk": _near(DOT),
    "scope_summaries": "WITH m AS (SELECT s_suppkey, s_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), g AS (SELECT n_regionkey, count(*) AS entity_count, min(s_suppkey) AS least, array_to_string(list(s_name ORDER BY s_suppkey)[1:5], '|') AS top, first(s_name ORDER BY s_suppkey) AS label FROM m GROUP BY 1) SELECT row_number() OVER (ORDER BY entity_count DESC, least) - 1 AS scope_id, 'Scope: ' || label AS label, entity_count, top FROM g",
    "bound_pairs": "WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS src, y.l_suppkey AS dst, count(*) AS weight FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2",
    "operator_monitor": f"WITH {_MONITOR} SELECT operator_id, n, round(a, 6) AS accuracy, round(c, 6) AS calibration_error, round(f, 6) AS failure_ratio, action FROM m",
    "operator_actions": f"WITH {_MONITOR} SELECT action AS kind, operator_id, row_number() OVER (ORDER BY action = 'revise', operator_id) - 1 AS place FROM m WHERE action IN ('roll_back', 'revise')",
    "outcome_states": f"SELECT CASE WHEN l_returnflag = 'N' THEN 'measurement' WHEN l_discount > 0.05 THEN 'reported_claim' ELSE 'observation' END AS evidence, {_STATE} AS state, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "case_resolutions": f"WITH p AS (SELECT l_orderkey, count(*) AS n, bool_or(l_linestatus = 'O' AND {_STATE} = 'verified') AS proven, bool_or(l_linestatus = 'O') AS told FROM lineitem GROUP BY 1) SELECT o_orderkey AS case_id, CASE WHEN n IS NULL THEN 'open' WHEN proven THEN 'verified_resolution' WHEN told THEN 'candidate' ELSE 'failed' END AS status, coalesce(n, 0) AS outcomes FROM orders LEFT JOIN p ON o_orderkey = l_orderkey",
    "seeded_code": """WITH RECURSIVE s AS (SELECT 'N:' || n_nationkey AS id, n_name AS name, 'N.' || n_name AS q FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_name, 'R.' || r_name FROM region),
t AS (SELECT unnest(['united', 'asia']) AS term), b AS (SELECT id, sum((CASE WHEN lower(name) = term THEN 10 WHEN contains(lower(name), term) THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(q), term) THEN 2 ELSE 0 END)) AS score FROM s, t GROUP BY id),
best AS (SELECT id FROM b WHERE score > 0 ORDER BY score DESC, id LIMIT 5),
e AS (SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'R:' || n_regionkey, 'N:' || n_nationkey FROM nation UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer),
w AS (SELECT id, 0 AS depth FROM best UNION SELECT dst, depth + 1 FROM w JOIN e ON src = id WHERE depth < 2)
SELECT id, min(depth)::BIGINT AS depth FROM w GROUP BY id""",
    "markdown_export": "SELECT '| ' || s_suppkey || ' | ' || replace(s_name, '|', '\\|') || ' | ' || s_nationkey || ' |' AS line FROM supplier",
    "html_export": "SELECT '<tr><td>' || doc_id || '</td><td>' || coalesce(lang, '') || '</td><td>' || coalesce(source, '') || '</td></tr>' AS line FROM documents",
    "log_replay": "SELECT event_id AS lsn, user_id, event_type FROM events WHERE event_id > 100",
}
