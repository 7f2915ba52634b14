"""Queries over logs of mutations, lifecycles and governance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, governance, lifecycle, mutations
from ..operators.graph import written
from ..operators.search import batch_top_k
from ..plans.graph_language import Graph
from .graphs import edges as graph_edges
from .graphs import nodes as graph_nodes
from .records import _E, _SUM, _evidence


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- graph mutations ---------------------------------------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    """Events as mutations: users are nodes, signups and clicks make them, views patch them, errors delete them, purchases link them."""
    e = _t(spark, sf_dir, "events")
    node = F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))
    other = F.concat(F.lit("u"), (F.col("event_id") % 40).cast("string"))
    op = F.when(F.col("event_type").isin("signup", "click"), "create_node").when(F.col("event_type") == "view", "patch_node").when(F.col("event_type") == "error", "delete_node").otherwise("create_edge")
    key = F.when(F.col("event_type") == "purchase", F.array(node, F.lit("BOUGHT_WITH"), other)).otherwise(F.array(node))
    labels = F.when(op == "create_node", F.array(F.initcap("event_type"))).otherwise(F.array().cast("array<string>"))
    props = F.when(op == "patch_node", F.create_map(F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")), F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select(F.col("event_id").alias("lsn"), op.alias("op"), key.alias("id"), labels.alias("labels"), props.alias("props"))


def graph_mutation_nodes(spark, sf_dir):
    n = mutations.nodes(_log(spark, sf_dir))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")
    return n.select("node_id", F.array_join("labels", "|").alias("labels"), entries.alias("props"))


def graph_mutation_edges(spark, sf_dir):
    return mutations.edges(_log(spark, sf_dir), 9000).select("src", "type", "dst")


def graph_mutation_rejected(spark, sf_dir):
    return mutations.rejected(_log(spark, sf_dir)).select("lsn", "op", F.array_join("id", " ").alias("id"), "reason")


def graph_create_delete(spark, sf_dir):
    """Statements that change the order graph, and its suppliers' edges afterwards."""
    n = graph_nodes(spark, sf_dir).where("labels[0] in ('Supplier', 'Nation')")
    e = graph_edges(spark, sf_dir).where("type = 'LOCATED_IN' and src like 'S:%'")
    g = Graph(n, e)
    log = mutations.created(n, e)
    for lsn, text in enumerate(("CREATE (x:Supplier {node_id: 'S:new', score: 7})", "MATCH (s:Supplier) WHERE s.score < 0 DELETE s", "MATCH (s:Supplier)-[r:LOCATED_IN]->(n:Nation {node_id: 'N:3'}) SET r.moved = 1, s:Moved"), 1):
        log = log.unionByName(g.mutate(text, lsn))
    log = written(log)
    left = mutations.edges(mutations.applied(log))
    return left.select("src", "dst", F.coalesce(F.col("props")["moved"], F.lit("-")).alias("moved"))


def graph_edge_alias(spark, sf_dir):
    g = Graph(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))
    return g.run("MATCH (p:Part)-[r:SUPPLIED_BY]->(s:Supplier {node_id: 'S:3'}) WHERE r.weight >= 30 RETURN p, r.weight, r.type")


def graph_optional_bound(spark, sf_dir):
    """Parts of an order with the edge from the part to a supplier of the same line, where there is one to that supplier."""
    g = Graph(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))
    return g.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region), (s:Supplier)-[:LOCATED_IN]->(m:Nation) OPTIONAL MATCH (s)-[x:LOCATED_IN]->(n) WHERE r.name = 'ASIA' RETURN n, s, x.weight").select("n", "s", F.coalesce("x_weight", F.lit(0.0)).alias("w"))


# --- lifecycles --------------------------------------------------------------------------------------------------------

_ENTITY = {"signup": "create", "view": "version", "purchase": "transition", "click": "create", "error": "tombstone"}
_RELATION = {"signup": "propose", "purchase": "admit", "error": "deprecate", "view": "use", "click": "use"}
_ATTEMPT = {"signup": "open", "view": "act", "purchase": "complete", "error": "fail", "click": "outcome"}
_EXPERIMENT = {"signup": "propose", "view": "approve", "click": "run", "purchase": "finish", "error": "reject"}


def _steps(spark, sf_dir, names: dict) -> DataFrame:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return _t(spark, sf_dir, "events").select("user_id", "event_id", F.create_map(*pairs)[F.col("event_type")].alias("op"))


def _machine(names: dict, moves: dict):
    def run(spark, sf_dir):
        return lifecycle.machine(_steps(spark, sf_dir, names), "user_id", ["event_id"], "op", moves).select("user_id", "event_id", "before", "after", "accepted")

    return run


def entity_versions(spark, sf_dir):
    done = lifecycle.machine(_steps(spark, sf_dir, _ENTITY), "user_id", ["event_id"], "op", lifecycle.ENTITY).where("accepted")
    return lifecycle.versions(done, "user_id", "event_id").select("user_id", "version", "valid_from", F.coalesce("valid_until", F.lit(-1)).alias("valid_until"))


def client_sequence(spark, sf_dir):
    """A client's numbers run ahead of and behind its events."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 100 + F.col("event_id") % 5).cast("long").alias("n"))
    return lifecycle.sequenced(e, "user_id", "n", ["event_id"], 4).select("user_id", "event_id", "accepted")


def log_compaction(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("deleted"))
    return lifecycle.compacted(log, "user_id", "event_id", "deleted", 8000).select("user_id", "event_id", "event_type")


def idempotent_append(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("key"), "event_id", "event_type")
    there = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return lifecycle.remembered(log, there, "key", "event_id")


# --- reports -----------------------------------------------------------------------------------------------------------


def promotion(spark, sf_dir):
    s = evidence.summary(_evidence(spark, sf_dir), "relation_id")
    return s.where(governance.promoted(s, 60, 12, 1 << 32, 14)).select("relation_id")


def outcome_deltas(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") * governance.Q32).cast("long").alias("b"), ((F.floor("o_totalprice") + F.col("o_orderkey") % 7) * governance.Q32).cast("long").alias("a"))
    q, x = governance.outcome_delta(F.col("b"), F.col("a"))
    return o.select("o_orderkey", q.alias("delta_q32"), x.alias("delta"))


def attribution(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    plans = li.groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.collect_list(F.col("l_suppkey") % 10).alias("actions"))
    alone = spark.createDataFrame([(1,), (3,), (5,), (7,)], "action long")
    out = governance.plan_attribution(plans, alone)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)
    return out.select("attempt_id", "method", text("credited"), text("withheld"))


def proposal_staleness(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    x = o.select("o_orderkey", F.lit(1).alias("v0"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("v1"), F.col("o_orderstatus").alias("c0"), F.lit("F").alias("c1"), F.when(F.col("o_custkey") % 2 == 0, F.lit(1)).alias("p0"), F.lit(None).cast("int").alias("p1"))
    return x.select("o_orderkey", governance.staleness([("problem version", "v0", "v1"), ("context", "c0", "c1"), ("precedents", "p0", "p1")]).alias("state"))


def context_fingerprint(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    sha, crc = governance.fingerprint(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", sha.alias("sha"))


def semantic_dedup(spark, sf_dir):
    return governance.semantic_duplicates(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")


def explore_stats(spark, sf_dir):
    return governance.explore_stats(_t(spark, sf_dir, "events"), "event_type", "user_id", F.col("event_type").isin("purchase", "error"), "event_id", 8000)


def recent_cases(spark, sf_dir):
    return governance.recent(_t(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id"), "event_id", 500)


def adjudication_query(spark, sf_dir):
    policy = evidence.Policy(min_observations=60, min_support=12, max_contradictions=14)
    found = evidence.adjudicate(evidence.summary(_evidence(spark, sf_dir), "relation_id"), policy)
    return found.where("decision = 'ContextDependent'").select("relation_id").orderBy("relation_id")


def name_catalog(spark, sf_dir):
    return governance.catalog(_t(spark, sf_dir, "events"), "event_type", "event_id")


def metric_export(spark, sf_dir):
    n = _t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return governance.metric_lines(n.withColumnRenamed("c_mktsegment", "tenant"), "customers_total", "tenant", "n")


def provenance_weights(spark, sf_dir):
    r = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 9).alias("source_id"), (F.col("value") / 100).alias("confidence"))
    s = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("source_id"), F.col("r_name").alias("source"), (1 - F.col("r_regionkey") / 10).alias("trust"))
    return governance.provenance(r, s).select("event_id", F.coalesce("source", F.lit("-")).alias("source"), F.round("weighed", 5).alias("weighed"))


def baseline_gate(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("b"), F.avg("o_totalprice").alias("v"))
    return o.select("o_custkey", governance.gate(F.col("v"), F.col("b"), 0.5).alias("within"))


def stage_admission(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("passed"))
    return governance.admission(e, "event_id", "passed", "user_id").where("admitted").select("user_id", "event_id")


def mapping_classes(spark, sf_dir):
    """Customers of a nation are mapped on the next one; every third mapping isn't confirmed."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m = c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - F.col("c_custkey") % 10).alias("dst"), F.when(F.col("c_custkey") % 3 == 0, "proposed").otherwise("confirmed").alias("state"), F.lit("M").alias("type")).where("dst > 0")
    return governance.mapping_classes(m, c.select(F.col("c_custkey").alias("node_id")))


def hyper_match(spark, sf_dir):
    from .relational import _bindings

    return governance.bound_roles(_bindings(spark, sf_dir).where("role <> 'order' or entity like '%0'"), ["order", "supplier"]).select("order", "supplier").distinct()


def evidence_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    hits = e.where("event_type = 'view'").select(F.col("event_id").alias("hit_id"), F.col("value").alias("score"))
    told = e.where("event_type in ('purchase', 'error')").select(F.array(F.col("event_id") - 1, F.col("event_id") - 2, F.col("event_id") - 1).alias("evidence_ids"), (F.col("event_type") == "purchase").alias("success"))
    return governance.evidence_of(hits, told).select("hit_id", "outcomes", "successes")


def temporal_hyperedges(spark, sf_dir):
    from .relational import _bindings

    domains = _t(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("P:"), "p_partkey").alias("entity"), F.col("p_brand").alias("domain")).unionByName(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("entity"), F.col("s_nationkey").cast("string").alias("domain")))
    whole, _ = governance.hyperedges(_bindings(spark, sf_dir).where("role <> 'order'"), domains)
    return whole


def visible_hyperedges(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") <= 5000)).select("o_orderkey")


def invalidation(spark, sf_dir):
    """Nations are files, suppliers and customers sit in them, orders depend on customers and lines on orders."""
    from .graphs import _id

    changed = spark.createDataFrame([("N:3",), ("N:7",)], "locator string")
    located = _t(spark, sf_dir, "customer").select(_id("N", "c_nationkey").alias("locator"), _id("C", "c_custkey").alias("entity"))
    deps = _t(spark, sf_dir, "orders").select(_id("O", "o_orderkey").alias("src"), _id("C", "o_custkey").alias("dst"))
    return governance.invalidated(changed, located, deps, 2).select("entity", F.col("depth").cast("long").alias("depth"))


def _code(spark, sf_dir):
    """Parts as symbols, lines of an order as calls from its first part."""
    s = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("hash"), (F.col("p_size") % 5 == 0).alias("is_test"))
    return s, _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7).alias("src"), F.col("l_partkey").alias("dst"))


def explain_symbol(spark, sf_dir):
    s, c = _code(spark, sf_dir)
    out = governance.explained(s, c, 70)
    return out.select(*[F.array_join(F.transform(x, lambda i: i.cast("string")), "|").alias(x) for x in ("callers", "callees", "tests")])


def code_diff(spark, sf_dir):
    s, c = _code(spark, sf_dir)
    after = s.where("id % 11 <> 0").withColumn("hash", F.when(F.col("id") % 4 == 0, F.lit("new")).otherwise(F.col("hash")))
    return governance.code_diff(s.where("id % 13 <> 0"), after, c)


def code_ingest(spark, sf_dir):
    """Symbols of every fifth path are replaced by fewer, edges that lost an end go."""
    s, c = _code(spark, sf_dir)
    n = s.select("id", (F.col("id") % 20).alias("path"))
    changed = spark.createDataFrame([(0,), (5,), (10,), (15,)], "path long")
    new = n.where("path = 5 and id % 3 = 0")
    _, e = governance.ingest_delta(n, c.distinct(), changed, new, c.distinct().join(new.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    return e.distinct()


def rule_closure(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    out = governance.composed(e, [("LOCATED_IN", "IN_REGION", "OF_REGION"), ("PLACED", "CONTAINS", "ORDERED")])
    return out.select("src", "type", "dst", F.round("evidence", 5).alias("evidence"))


def regional_merge(spark, sf_dir):
    """Each label is a region that sends its three best; its third is what it has no better beyond."""
    from pyspark.sql import Window

    from ..functions import vectors as V
    from ..operators.search import literal_vector

    v = _t(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    scored = v.select("label", F.col("vec_id").alias("id"), F.round(V.cosine(literal_vector(q), F.col("embedding")), 5).alias("score"))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    top = scored.withColumn("r", F.row_number().over(w)).where("r <= 3").withColumn("bound", F.min("score").over(Window.partitionBy("label")))
    return governance.merged_proofs(top.select(F.col("label").alias("region"), "id", "score", "bound"), 10)


def reciprocal_neighbours(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return governance.reciprocal(batch_top_k(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), 5, block=2048))


def json_export(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return governance.json_view(n, ["n_nationkey", "n_name", "r_name"])


def channel_fan_out(spark, sf_dir):
    s = spark.createDataFrame([("click", "a"), ("click", "b"), ("error", "a")], "channel string, subscriber string")
    return governance.fan_out(_t(spark, sf_dir, "events").select("event_type", "event_id"), s, "event_type").select("event_id", "subscriber")


def kv_sets(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return governance.set_members(e.select((F.col("user_id") % 50).alias("key"), F.col("event_type").alias("member"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("op"), F.col("event_id").alias("ts")))


entity_mutations = _machine(_ENTITY, lifecycle.ENTITY)
relation_governance = _machine(_RELATION, lifecycle.RELATION_TYPE)
attempt_mutations = _machine(_ATTEMPT, lifecycle.ATTEMPT)
experiment_lifecycle = _machine(_EXPERIMENT, lifecycle.EXPERIMENT)
QUERIES = {
    k: globals()[k]
    for k in (
        "graph_mutation_nodes graph_mutation_edges graph_mutation_rejected graph_create_delete graph_edge_alias graph_optional_bound entity_mutations relation_governance attempt_mutations experiment_lifecycle "
        "entity_versions client_sequence log_compaction idempotent_append promotion outcome_deltas attribution proposal_staleness context_fingerprint semantic_dedup explore_stats recent_cases adjudication_query "
        "name_catalog metric_export provenance_weights baseline_gate stage_admission mapping_classes hyper_match evidence_join temporal_hyperedges visible_hyperedges invalidation explain_symbol code_diff code_ingest "
        "rule_closure regional_merge reciprocal_neighbours json_export channel_fan_out kv_sets"
    ).split()
}

_MUT = """m AS (SELECT event_id AS lsn, 'u' || user_id % 40 AS n, 'u' || event_id % 40 AS o, event_type AS t, CASE WHEN event_type IN ('signup', 'click') THEN 'create_node' WHEN event_type = 'view' THEN 'patch_node' WHEN event_type = 'error' THEN 'delete_node' ELSE 'create_edge' END AS op FROM events),
b AS (SELECT n, max(lsn) FILTER (WHERE op = 'create_node') AS c, max(lsn) FILTER (WHERE op = 'delete_node') AS d FROM m GROUP BY n),
turn AS (SELECT n, max(lsn) AS born FROM m WHERE op IN ('create_node', 'delete_node') GROUP BY n), alive AS (SELECT turn.n, born FROM turn JOIN m ON m.n = turn.n AND m.lsn = born WHERE op = 'create_node')"""


def _fsm(names: dict, moves: dict, tail: str) -> str:
    op = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    after = "CASE " + " ".join(f"WHEN s = '{a}' AND op = '{o}' THEN '{b}'" for (a, o), b in moves.items()) + " END"
    return (
        f"WITH RECURSIVE e AS (SELECT user_id, event_id, {op} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), "
        f"x AS (SELECT user_id, 0::BIGINT AS event_id, '' AS op, 0::BIGINT AS r, '' AS before, 'none' AS s, false AS accepted FROM e WHERE r = 1 UNION ALL "
        f"SELECT user_id, event_id, op, r, s, coalesce(n, s), n IS NOT NULL FROM (SELECT e.user_id, e.event_id, e.op, e.r, x.s, {after.replace('op =', 'e.op =')} AS n FROM x JOIN e ON e.user_id = x.user_id AND e.r = x.r + 1)) {tail}"
    )


_FSM = "SELECT user_id, event_id, before, s AS after, accepted FROM x WHERE r > 0"
_COS = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_SC = "s AS (SELECT p_partkey AS id, p_brand AS hash, p_size % 5 = 0 AS is_test FROM part), c AS (SELECT DISTINCT l_suppkey * 7 AS src, l_partkey AS dst FROM lineitem)"
ORACLE_SQL = {
    "graph_mutation_nodes": f"WITH {_MUT}, l AS (SELECT m.n, string_agg(DISTINCT upper(left(t, 1)) || substr(t, 2), '|') AS labels FROM m JOIN alive USING (n) WHERE op = 'create_node' AND lsn >= born GROUP BY m.n), p AS (SELECT n, k, arg_max(struct_pack(x := v), lsn).x AS v FROM (SELECT m.n, 'k' || lsn % 3 AS k, lsn, CASE WHEN lsn % 4 <> 0 THEN lsn::VARCHAR END AS v FROM m JOIN alive USING (n) WHERE op = 'patch_node' AND lsn >= born) GROUP BY n, k), q AS (SELECT n, string_agg(k || '=' || v, '|' ORDER BY k) AS props FROM p WHERE v IS NOT NULL GROUP BY n) SELECT alive.n AS node_id, labels, coalesce(props, '') AS props FROM alive JOIN l USING (n) LEFT JOIN q USING (n)",
    "graph_mutation_edges": f"WITH {_MUT.replace('FROM events', 'FROM events WHERE event_id <= 9000')}, x AS (SELECT n, o, max(lsn) AS born FROM m WHERE op = 'create_edge' GROUP BY n, o) SELECT x.n AS src, 'BOUGHT_WITH' AS type, x.o AS dst FROM x JOIN alive a ON a.n = x.n JOIN alive z ON z.n = x.o JOIN b ba ON ba.n = x.n JOIN b bz ON bz.n = x.o WHERE coalesce(ba.d, 0) < x.born AND coalesce(bz.d, 0) < x.born",
    "graph_mutation_rejected": f"WITH {_MUT}, k AS (SELECT lsn, op, CASE WHEN op = 'create_edge' THEN n || ' BOUGHT_WITH ' || o ELSE n END AS id FROM m), y AS (SELECT *, last_value(CASE WHEN op LIKE 'create%' THEN true WHEN op LIKE 'delete%' THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM k) SELECT lsn, op, id, CASE WHEN op LIKE 'create%' THEN 'exists already' ELSE 'does not exist' END AS reason FROM y WHERE (op LIKE 'create%') = coalesce(there, false)",
    "graph_create_delete": "SELECT 'S:' || s_suppkey AS src, 'N:' || s_nationkey AS dst, CASE WHEN s_nationkey = 3 THEN '1' ELSE '-' END AS moved FROM supplier WHERE s_acctbal >= 0",
    "graph_edge_alias": "SELECT 'P:' || l_partkey AS p, sum(l_quantity) AS r_weight, 'SUPPLIED_BY' AS r_type FROM lineitem WHERE l_suppkey = 3 GROUP BY l_partkey HAVING sum(l_quantity) >= 30",
    "graph_optional_bound": "SELECT 'N:' || n_nationkey AS n, 'S:' || s_suppkey AS s, CASE WHEN s_nationkey = n_nationkey THEN 1.0::DOUBLE ELSE 0 END AS w FROM nation JOIN region ON r_regionkey = n_regionkey, supplier WHERE r_name = 'ASIA'",
    "entity_mutations": _fsm(_ENTITY, lifecycle.ENTITY, _FSM),
    "relation_governance": _fsm(_RELATION, lifecycle.RELATION_TYPE, _FSM),
    "attempt_mutations": _fsm(_ATTEMPT, lifecycle.ATTEMPT, _FSM),
    "experiment_lifecycle": _fsm(_EXPERIMENT, lifecycle.EXPERIMENT, _FSM),
    "entity_versions": _fsm(_ENTITY, lifecycle.ENTITY, "SELECT user_id, version, valid_from, valid_until FROM (SELECT user_id, op, row_number() OVER w AS version, event_id AS valid_from, coalesce(lead(event_id) OVER w, -1) AS valid_until FROM x WHERE accepted WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE op <> 'tombstone'"),
    "client_sequence": "WITH RECURSIVE e AS (SELECT user_id, event_id, floor(event_id / 100 + event_id % 5)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), x AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS last, 0::BIGINT AS r, false AS accepted FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, CASE WHEN n > last AND n <= last + 4 THEN n ELSE last END, e.r, n > last AND n <= last + 4 FROM x JOIN e ON e.user_id = x.user_id AND e.r = x.r + 1) SELECT user_id, event_id, accepted FROM x WHERE r > 0",
    "log_compaction": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 8000) WHERE r = 1 AND event_type <> 'error' UNION ALL SELECT user_id, event_id, event_type FROM events WHERE event_id > 8000",
    "idempotent_append": "SELECT event_id % 3000 AS key, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_id % 3000 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "promotion": f"WITH {_SUM} SELECT relation_id FROM s WHERE observations >= 60 AND supports >= 12 AND utility_sum >= 4294967296 AND contradictions <= 14",
    "outcome_deltas": "SELECT o_orderkey, (o_orderkey % 7) * 4294967296 AS delta_q32, (o_orderkey % 7)::DOUBLE AS delta FROM orders",
    "attribution": "WITH a AS (SELECT DISTINCT l_orderkey AS attempt_id, l_suppkey % 10 AS x FROM lineitem), g AS (SELECT attempt_id, count(*) AS n, coalesce(string_agg(x::VARCHAR, '|' ORDER BY x) FILTER (WHERE x IN (1, 3, 5, 7)), '') AS c, coalesce(string_agg(x::VARCHAR, '|' ORDER BY x) FILTER (WHERE x NOT IN (1, 3, 5, 7)), '') AS w FROM a GROUP BY attempt_id) SELECT attempt_id, CASE WHEN n <= 1 THEN 'standalone' WHEN w = '' THEN 'ablation' ELSE 'joint' END AS method, CASE WHEN n <= 1 THEN c || w ELSE c END AS credited, CASE WHEN n <= 1 THEN '' ELSE w END AS withheld FROM g",
    "proposal_staleness": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'problem version' WHEN o_orderstatus <> 'F' THEN 'context' WHEN o_custkey % 2 = 0 THEN 'precedents' ELSE 'fresh' END AS state FROM orders",
    "context_fingerprint": "SELECT c_custkey, sha256('nation=' || c_nationkey || ';segment=' || c_mktsegment) AS sha FROM customer",
    "semantic_dedup": "SELECT o_custkey, o_orderstatus, count(*) AS occurrences, min(o_orderkey) AS first FROM orders GROUP BY ALL",
    "explore_stats": "SELECT count(*) AS records, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS outcomes, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds, count(DISTINCT user_id) AS collections FROM events WHERE event_id <= 8000",
    "recent_cases": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50",
    "adjudication_query": f"WITH {_SUM} SELECT relation_id FROM s WHERE NOT (observations < 60) AND NOT (contradictions > 14 AND utility_sum <= 0) AND NOT (supports >= 12 AND contradictions <= 14 AND utility_sum >= 4294967296) AND supports > 0 AND contradictions > 0",
    "name_catalog": "SELECT event_type, row_number() OVER (ORDER BY f, event_type) - 1 AS id FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY event_type)",
    "metric_export": "SELECT 'customers_total{tenant=\"' || c_mktsegment || '\"} ' || count(*) AS line FROM customer GROUP BY c_mktsegment",
    "provenance_weights": "SELECT event_id, coalesce(r_name, '-') AS source, round(value / 100 * coalesce(1 - r_regionkey / 10.0::DOUBLE, 0.5), 5) AS weighed FROM events LEFT JOIN region ON r_regionkey = user_id % 9",
    "baseline_gate": "SELECT o_custkey, avg(o_totalprice) <= min(o_totalprice) * 1.5 AS within FROM orders GROUP BY o_custkey",
    "stage_admission": "SELECT user_id, event_id FROM events e WHERE event_id < coalesce((SELECT min(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error'), 9223372036854775807)",
    "mapping_classes": "SELECT c_custkey AS node_id, CASE WHEN c_custkey >= 10 AND c_custkey % 10 <> 0 AND c_custkey % 3 <> 0 THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS component FROM customer",
    "hyper_match": "SELECT DISTINCT 'O:' || l_orderkey AS \"order\", 'S:' || l_suppkey AS supplier FROM lineitem WHERE l_orderkey % 10 = 0",
    "evidence_join": "WITH o AS (SELECT event_id - d AS h, event_type = 'purchase' AS s FROM events, (VALUES (1), (2)) t(d) WHERE event_type IN ('purchase', 'error')) SELECT event_id AS hit_id, count(h) AS outcomes, count(*) FILTER (WHERE s) AS successes FROM events LEFT JOIN o ON h = event_id WHERE event_type = 'view' GROUP BY event_id",
    "temporal_hyperedges": "SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, 2::BIGINT AS entities, 2::BIGINT AS domains FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10",
    "visible_hyperedges": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <= 5000",
    "invalidation": "SELECT 'C:' || c_custkey AS entity, 0::BIGINT AS depth FROM customer WHERE c_nationkey IN (3, 7) UNION ALL SELECT 'O:' || o_orderkey, 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (3, 7)",
    "explain_symbol": f"WITH {_SC} SELECT coalesce((SELECT string_agg(src::VARCHAR, '|' ORDER BY src) FROM c JOIN s ON s.id = src WHERE dst = 70 AND NOT is_test), '') AS callers, coalesce((SELECT string_agg(dst::VARCHAR, '|' ORDER BY dst) FROM c JOIN s ON s.id = dst WHERE src = 70), '') AS callees, coalesce((SELECT string_agg(src::VARCHAR, '|' ORDER BY src) FROM c JOIN s ON s.id = src WHERE dst = 70 AND is_test), '') AS tests",
    "code_diff": f"WITH {_SC}, a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE hash END AS hash, is_test FROM s WHERE id % 11 <> 0), x AS (SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT * FROM s WHERE id % 13 <> 0) b FULL JOIN a ON a.id = b.id WHERE a.hash IS DISTINCT FROM b.hash) SELECT x.id, change, count(DISTINCT CASE WHEN NOT a.is_test THEN c.src END) AS callers, count(DISTINCT CASE WHEN a.is_test THEN c.src END) AS tests FROM x LEFT JOIN c ON c.dst = x.id LEFT JOIN a ON a.id = c.src GROUP BY ALL",
    "code_ingest": f"WITH {_SC}, k AS (SELECT id FROM s WHERE id % 20 NOT IN (0, 5, 10, 15)), w AS (SELECT id FROM s WHERE id % 20 = 5 AND id % 3 = 0), v AS (SELECT id FROM k UNION SELECT id FROM w) SELECT src, dst FROM c WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)",
    "rule_closure": "SELECT 'S:' || s_suppkey AS src, 'OF_REGION' AS type, 'R:' || n_regionkey AS dst, 1.0::DOUBLE AS evidence FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'C:' || c_custkey, 'OF_REGION', 'R:' || n_regionkey, 1.0 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'C:' || o_custkey, 'ORDERED', 'P:' || l_partkey, round(avg((1 + l_quantity) / 2), 5) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey",
    "regional_merge": f"WITH s AS (SELECT e.label, e.vec_id AS id, round({_COS}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), t AS (SELECT *, min(score) OVER (PARTITION BY label) AS bound FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r FROM s) WHERE r <= 3) SELECT id, score, score >= (SELECT max(bound) FROM t) AS certified FROM t ORDER BY score DESC, id LIMIT 10",
    "reciprocal_neighbours": f"WITH n AS (SELECT a, b FROM (SELECT q.vec_id AS a, e.vec_id AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM embeddings e, embeddings q) WHERE r <= 5 AND a <> b) SELECT x.a, x.b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    "json_export": "SELECT to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name, r_name := r_name))::VARCHAR AS json FROM nation JOIN region ON r_regionkey = n_regionkey",
    "channel_fan_out": "SELECT event_id, s AS subscriber FROM events JOIN (VALUES ('click', 'a'), ('click', 'b'), ('error', 'a')) t(c, s) ON c = event_type",
    "kv_sets": "SELECT key, member FROM (SELECT user_id % 50 AS key, event_type AS member, arg_max(event_id % 3 <> 0, event_id) AS there FROM events GROUP BY 1, 2) WHERE there",
}
