"""Queries over events and lines: evidence, adjudication, discovery, memory, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, evidence, memory
from ..operators.graph import shared_folder
from ..streaming import ingest


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- evidence ----------------------------------------------------------------------------------------------------------


def _evidence(spark, sf_dir):
    """An event is an attempt of its user: purchases support, errors contradict, utility is the value in whole units."""
    direction = F.when(F.col("event_type") == "purchase", "Supports").when(F.col("event_type") == "error", "Contradicts").otherwise("Neutral")
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("evidence_id"), F.col("user_id").alias("relation_id"), (F.col("event_id") % 200).alias("attempt_id"), F.lit(1).alias("policy_id"), F.col("event_type").alias("context"), direction.alias("direction"), (F.floor("value") * (1 << 32)).cast("long").alias("utility"), F.col("event_id").alias("lsn"))


def evidence_dedup(spark, sf_dir):
    return evidence.deduplicated(_evidence(spark, sf_dir)).select("evidence_id", "relation_id", "attempt_id", "context")


def evidence_summary(spark, sf_dir):
    return evidence.summary(_evidence(spark, sf_dir), "relation_id")


def evidence_digest(spark, sf_dir):
    return evidence.digest(_evidence(spark, sf_dir), "relation_id", ["evidence_id", "direction"])


def adjudicate(spark, sf_dir):
    policy = evidence.Policy(min_observations=60, min_support=12, max_contradictions=14)
    return evidence.adjudicate(evidence.summary(_evidence(spark, sf_dir), "relation_id"), policy).select("relation_id", "decision", "next_status")


def metric_utility(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    base, seen = F.col("o_totalprice"), F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 7 - 3) / 10)
    return o.select("o_orderkey", F.round(evidence.metric_utility(base, seen), 4).alias("absolute"), F.round(evidence.metric_utility(base, seen, False, "relative"), 4).alias("relative"), F.round(evidence.metric_utility(base, seen, True, "bounded", -0.2, 0.1), 4).alias("bounded"))


def independence_report(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("agent"), (F.col("event_id") % 13).alias("root"))
    return evidence.independence(a, "event_type")


def resolution_ranking(spark, sf_dir):
    """Hypotheses per user: success and measured share from outcomes, recency from the log."""
    e = _t(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.avg(F.when(F.col("event_type").isin("purchase", "error"), (F.col("event_type") == "purchase").cast("double"))).alias("s"), F.avg((F.col("value") > 50).cast("double")).alias("m"), F.max("event_id").alias("lsn"))
    state = F.when(F.col("user_id") % 3 == 0, "Verified").when(F.col("user_id") % 3 == 1, "PendingEvidence").otherwise("Unverified")
    c = evidence.resolution_confidence(F.lit(0.9), state, F.col("s"), F.col("m"), F.lit(10_000) - F.col("lsn"))
    return per.select("user_id", F.round(c, 5).alias("confidence"))


def audit_chain(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return evidence.chained_hashes(e, "user_id", "event_id", ["event_type"])


def slo_report(spark, sf_dir):
    out = evidence.slo(_t(spark, sf_dir, "events"), F.col("event_type") == "error", 0.99)
    return out.select("requests", "failures", F.round("availability", 6).alias("availability"), F.round("burn", 4).alias("burn"), "severity")


def slo_window(spark, sf_dir):
    """The last six hours of the log."""
    e = _t(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    out = evidence.slo(e.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 6 HOURS")), F.col("event_type") == "error", 0.99)  # one row
    return out.select("requests", "failures", F.round("availability", 6).alias("availability"), F.round("burn", 4).alias("burn"), "severity")


# --- discovery ---------------------------------------------------------------------------------------------------------


def _cases(spark, sf_dir):
    li, o, c, p = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    features = F.array(F.concat(F.lit("seg:"), "c_mktsegment"), F.concat(F.lit("pri:"), "o_orderpriority"), F.concat(F.lit("status:"), "o_orderstatus"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("case_id"), (F.col("c_nationkey") % 5).alias("domain"), F.array(F.col("o_orderkey")).alias("roots"), features.alias("features"),
        F.col("l_linestatus").alias("resolution"), (F.col("l_returnflag") == "R").alias("success"), F.when(F.col("o_orderkey") % 3 == 0, "validation").otherwise("discovery").alias("partition"),
        F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("size"), F.col("p_size").cast("double")).alias("attributes"),
    )


def motif_mine(spark, sf_dir):
    out = discovery.mine_motifs(_cases(spark, sf_dir), discovery.MotifPolicy(max_terms=3, min_successes=20))
    return out.select(F.array_join("conditions", "|").alias("conditions"), "resolution", "successes", "contradictions", "domains", F.round("precision", 5).alias("precision"))


def rule_validation(spark, sf_dir):
    out = discovery.validate_rule(_cases(spark, sf_dir), F.array_contains("features", "seg:BUILDING"), "F")
    return out.select("evaluated", "successes", "domains", "passes", "failures", *[F.round(c, 5).alias(c) for c in ("precision", "baseline", "lift", "contradiction_ratio")])


def rule_eval(spark, sf_dir):
    rules = [
        discovery.RuleSpec("big", ["all", ["has", "seg:BUILDING"], ["compare", ["attribute", "price"], ">", ["multiply", ["attribute", "size"], ["constant", 1000]]]], (("propose", "F"), ("derive", "large"))),
        discovery.RuleSpec("urgent", ["any", ["has", "pri:1-URGENT"], ["not", ["lacks", "pri:2-HIGH"]]], (("predict", "fast"), ("propose", "O"), ("require", "status:O"))),
    ]
    out = discovery.run_rules(_cases(spark, sf_dir), rules)
    return out.select("case_id", F.array_join("fired", "|").alias("fired"), F.array_join("proposals", "|").alias("proposals"), F.array_join("predictions", "|").alias("predictions"), F.array_join("derived", "|").alias("derived"))


def schema_induce(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    m = c.select(F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("domain"), (F.col("c_custkey") % 11).alias("root"), F.array("c_mktsegment").alias("capabilities"), F.array(F.when(F.col("c_acctbal") > 0, "debtor").otherwise("creditor"), F.lit("party")).alias("roles"))
    return discovery.induce_schemas(m, 3, 5, 3).select(F.array_join("capabilities", "|").alias("capabilities"), F.array_join("roles", "|").alias("roles"), "domains", "members", "roots")


def concept_map(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("concept_id"), (F.col("p_partkey") % 3).alias("domain"), F.array(F.concat(F.lit("r"), F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 7).cast("string"))).alias("roles"), F.array(F.concat_ws("/", "p_brand", "p_size")).alias("outcomes"), F.array(F.concat_ws("/", "p_type", "p_size")).alias("capabilities"), F.array(F.lit("t")).alias("times"))
    return discovery.map_concepts(c, 0.5).select("left", "right", F.round("score", 4).alias("score"))


def operator_evaluation(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    p = e.select(F.when(F.col("user_id") % 2 == 0, "held").otherwise("main").alias("role"), F.col("event_type").alias("domain"), (F.col("value") > 50).alias("predicted"), (F.col("event_id") % 2 == 0).alias("observed"), F.lit(0.6).alias("confidence"))
    return discovery.evaluate(p).select("role", *[F.round(c, 5).alias(c) for c in ("accuracy", "worst_domain", "calibration")])


def preference_pairs(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select(F.col("user_id").alias("prompt"), F.col("event_id").alias("answer"), F.round("value", 3).alias("score"))
    return discovery.preference_pairs(a).select("prompt", "chosen", "rejected", F.round("margin", 3).alias("margin"))


def causal_pairs(spark, sf_dir):
    """An event's predecessor is the one before it in the log."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), F.col("event_type").alias("signature"), F.col("event_id").alias("lsn"), F.array(F.col("event_id") - 1).alias("predecessors"))
    return discovery.causal_sequences(e, 10, 50)


# --- memory ------------------------------------------------------------------------------------------------------------


def _facts(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("fact_id"), F.lit("u").alias("user"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("object"), F.unix_timestamp("ts").alias("ts"), F.unix_timestamp("ts").alias("last"), (F.col("event_id") % 4).alias("recalls"), ((F.col("event_id") % 10) / 10).alias("salience"))


#: 2024-02-01.
NOW = 1_706_745_600


def fact_upsert(spark, sf_dir):
    return memory.latest_facts(_facts(spark, sf_dir)).select("subject", "predicate", "object", "fact_id", "conflicts")


def retention_active(spark, sf_dir):
    return memory.active(_facts(spark, sf_dir), NOW, 0.3).select("fact_id", F.round("retention", 4).alias("retention"))


def memory_prune(spark, sf_dir):
    stay, preferences = memory.pruned(memory.latest_facts(_facts(spark, sf_dir)), NOW, 0.6)
    return preferences.groupBy("predicate").agg(F.count("*").alias("n"))


def kv_live(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    log = e.select((F.col("user_id") % 50).alias("key"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("value"), F.col("event_id").alias("ts"), F.when(F.col("event_id") % 2 == 0, F.lit(20)).alias("ttl"))
    return memory.live_keys(log, 10_000)


def kv_counters(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "error", "delete").otherwise("incr")
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), op.alias("op"), F.lit(1).alias("amount"), F.col("event_id").alias("ts"))
    return memory.counters(log)


def sink_and_recent(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id")
    return memory.sink_and_recent(e, "user_id", "event_id", 2, 3)


# --- streams -----------------------------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    """The events with one in three sent twice, as a file stream."""
    shared = shared_folder(spark)
    path = f"{shared}/stream-{uuid.uuid4().hex}"
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e.where("event_id % 3 = 0")).write.mode("overwrite").parquet(f"{path}/in")
    return ingest.file_stream(spark, f"{path}/in", e.schema), path


def dedup_stream(spark, sf_dir):
    stream, path = _stream(spark, sf_dir)
    ingest.run_available(ingest.deduplicated(stream, "event_id", "ts", "40 days"), ingest.append_batches(f"{path}/out"), f"{path}/check")
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id")


def windowed_events(spark, sf_dir):
    """Daily sums of a stream, merged over its batches."""
    stream, path = _stream(spark, sf_dir)
    unique = ingest.deduplicated(stream, "event_id", "ts", "40 days")
    ingest.run_available(unique, ingest.append_batches(f"{path}/days"), f"{path}/check")
    out = ingest.event_windows(spark.read.parquet(f"{path}/days"), "ts", ["event_type"], "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


def session_windows(spark, sf_dir):
    out = ingest.sessions(_t(spark, sf_dir, "events"), "ts", "user_id", "12 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def lww_apply(spark, sf_dir):
    c = _t(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("doc_id"), F.col("event_id").alias("clock"), F.col("event_type").alias("origin"), F.round("value", 3).alias("value"))
    return ingest.last_writer_wins(c, "view")


def stream_read(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("id"), F.col("user_id"))
    return ingest.read_log(e, "click", 10, 25)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_dedup, evidence_summary, evidence_digest, adjudicate, metric_utility, independence_report, resolution_ranking, audit_chain, slo_report, slo_window, motif_mine, rule_validation, rule_eval, schema_induce, concept_map,
        operator_evaluation, preference_pairs, causal_pairs, fact_upsert, retention_active, memory_prune, kv_live, kv_counters, sink_and_recent, dedup_stream, windowed_events, session_windows, lww_apply, stream_read,
    )
}

_E = "ev AS (SELECT event_id AS evidence_id, user_id AS relation_id, event_id % 200 AS attempt_id, event_type AS context, CASE event_type WHEN 'purchase' THEN 'Supports' WHEN 'error' THEN 'Contradicts' ELSE 'Neutral' END AS direction, floor(value)::BIGINT * 4294967296 AS utility FROM events)"
_SUM = f"{_E}, s AS (SELECT relation_id, count(*) AS observations, count(*) FILTER (WHERE direction = 'Supports') AS supports, count(*) FILTER (WHERE direction = 'Contradicts') AS contradictions, count(*) FILTER (WHERE direction = 'Neutral') AS neutral, sum(utility)::BIGINT AS utility_sum, min(evidence_id) AS first_lsn, max(evidence_id) AS last_lsn FROM ev GROUP BY relation_id)"
_CASES = "k AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS case_id, c_nationkey % 5 AS domain, o_orderkey, 'seg:' || c_mktsegment AS f1, 'pri:' || o_orderpriority AS f2, 'status:' || o_orderstatus AS f3, l_linestatus AS resolution, l_returnflag = 'R' AS success, l_extendedprice AS price, p_size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"
_RET = f"exp(-({NOW} - floor(epoch(ts))::BIGINT) / ((event_id % 4 + 1) * (1 + 2 * ((event_id % 10) / 10.0::DOUBLE)) * 86400.0))"
ORACLE_SQL = {
    "evidence_dedup": f"WITH {_E} SELECT min(evidence_id) AS evidence_id, relation_id, attempt_id, context FROM ev GROUP BY relation_id, attempt_id, context",
    "evidence_summary": f"WITH {_SUM} SELECT * FROM s",
    "evidence_digest": f"WITH {_E} SELECT relation_id, sha256(string_agg(evidence_id || '|' || direction, chr(10) ORDER BY evidence_id)) AS digest FROM ev GROUP BY relation_id",
    "adjudicate": f"WITH {_SUM}, d AS (SELECT relation_id, CASE WHEN observations < 60 THEN 'InsufficientEvidence' WHEN contradictions > 14 AND utility_sum <= 0 THEN 'ContradictionThresholdReached' WHEN supports >= 12 AND contradictions <= 14 AND utility_sum >= 4294967296 THEN 'SupportThresholdReached' WHEN supports > 0 AND contradictions > 0 THEN 'ContextDependent' ELSE 'MixedEvidence' END AS decision FROM s) SELECT relation_id, decision, CASE decision WHEN 'ContradictionThresholdReached' THEN 'Contradicted' WHEN 'SupportThresholdReached' THEN 'Inferred' ELSE 'Provisional' END AS next_status FROM d",
    "metric_utility": "WITH m AS (SELECT o_orderkey, o_totalprice AS b, o_totalprice * (1 + (o_orderkey % 7 - 3) / 10.0::DOUBLE) AS o FROM orders) SELECT o_orderkey, round(o - b, 4) AS absolute, round((b - o) / abs(b), 4) AS relative, round(greatest(-0.2, least(0.1, (o - b) / abs(b))), 4) AS bounded FROM m",
    "independence_report": "SELECT event_type, count(*) AS assertions, count(DISTINCT user_id) AS agents, count(DISTINCT event_id % 13) AS roots FROM events GROUP BY event_type",
    "resolution_ranking": "WITH p AS (SELECT user_id, avg(CASE WHEN event_type IN ('purchase', 'error') THEN (event_type = 'purchase')::INT END) AS s, avg((value > 50)::INT) AS m, max(event_id) AS lsn FROM events GROUP BY user_id) SELECT user_id, round(greatest(0.0, least(1.0, 0.9 * CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.4 END * (0.5 + 0.5 * coalesce(s, 0.5)) * (0.75 + 0.25 * coalesce(m, 0.25)) / (1 + (10000 - lsn) / 1000.0::DOUBLE))), 5) AS confidence FROM p",
    "audit_chain": "WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), h AS (SELECT user_id, event_id, r, sha256('|' || event_id || '|' || event_type) AS hash FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, sha256(h.hash || '|' || e.event_id || '|' || e.event_type) FROM h JOIN e ON e.user_id = h.user_id AND e.r = h.r + 1) SELECT user_id, event_id, hash FROM h",
    "slo_report": "SELECT n AS requests, f AS failures, round(1 - f / n::DOUBLE, 6) AS availability, round(f / n::DOUBLE / (1 - 0.99), 4) AS burn, CASE WHEN f / n::DOUBLE / (1 - 0.99) >= 14.4 THEN 'page' WHEN f / n::DOUBLE / (1 - 0.99) >= 6 THEN 'ticket' ELSE 'ok' END AS severity FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS f FROM events)",
    "slo_window": "SELECT n AS requests, f AS failures, round(1 - f / n::DOUBLE, 6) AS availability, round(f / n::DOUBLE / (1 - 0.99), 4) AS burn, CASE WHEN f / n::DOUBLE / (1 - 0.99) >= 14.4 THEN 'page' WHEN f / n::DOUBLE / (1 - 0.99) >= 6 THEN 'ticket' ELSE 'ok' END AS severity FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS f FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR)",
    "motif_mine": f"WITH {_CASES}, x AS (SELECT domain, resolution, success, unnest([f2, f1, f3, f2 || '|' || f1, f2 || '|' || f3, f1 || '|' || f3, f2 || '|' || f1 || '|' || f3]) AS conditions FROM k), g AS (SELECT conditions, resolution, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS contradictions, count(DISTINCT domain) AS domains FROM x GROUP BY ALL) SELECT *, round(successes / (successes + contradictions)::DOUBLE, 5) AS precision FROM g WHERE successes >= 20 AND domains >= 2 ORDER BY successes / (successes + contradictions)::DOUBLE DESC, successes DESC, len(string_split(conditions, '|')), conditions, resolution LIMIT 256",
    "rule_validation": f"WITH {_CASES}, h AS (SELECT *, f1 = 'seg:BUILDING' AS hit FROM k WHERE o_orderkey % 3 = 0 AND resolution = 'F'), p AS (SELECT domain, avg(success::INT) AS p FROM h WHERE hit GROUP BY domain), o AS (SELECT count(*) FILTER (WHERE hit) AS e, count(*) FILTER (WHERE hit AND success) AS s, avg(success::INT) AS b, count(DISTINCT CASE WHEN hit THEN domain END) AS d FROM h) SELECT e AS evaluated, s AS successes, d AS domains, (SELECT count(*) FROM p WHERE p >= 0.8) AS passes, (SELECT count(*) FROM p WHERE p < 0.8) AS failures, round(CASE WHEN e > 0 THEN s / e::DOUBLE ELSE 0 END, 5) AS precision, round(b, 5) AS baseline, round(CASE WHEN e > 0 THEN s / e::DOUBLE ELSE 0 END - b, 5) AS lift, round(CASE WHEN e > 0 THEN 1 - s / e::DOUBLE ELSE 0 END, 5) AS contradiction_ratio FROM o",
    "rule_eval": f"WITH {_CASES}, r AS (SELECT *, f1 = 'seg:BUILDING' AND price > p_size * 1000.0 AS big, f2 IN ('pri:1-URGENT', 'pri:2-HIGH') AS urgent FROM k) SELECT case_id, concat_ws('|', CASE WHEN big THEN 'big' END, CASE WHEN urgent THEN 'urgent' END) AS fired, concat_ws('|', CASE WHEN big THEN 'F' END, CASE WHEN urgent AND f3 = 'status:O' THEN 'O' END) AS proposals, CASE WHEN urgent THEN 'fast' ELSE '' END AS predictions, CASE WHEN big THEN 'large' ELSE '' END AS derived FROM r",
    "schema_induce": "SELECT * FROM (SELECT c_mktsegment AS capabilities, CASE WHEN c_acctbal > 0 THEN 'debtor|party' ELSE 'creditor|party' END AS roles, count(DISTINCT c_nationkey) AS domains, count(DISTINCT c_custkey) AS members, count(DISTINCT c_custkey % 11) AS roots FROM customer GROUP BY 1, 2) WHERE domains >= 3 AND members >= 5 AND roots >= 3",
    "concept_map": "SELECT * FROM (SELECT a.p_partkey AS left, b.p_partkey AS right, round((4 * (a.p_partkey % 7 = b.p_partkey % 7)::INT + 3 * (a.p_brand = b.p_brand)::INT + 2 * (a.p_type = b.p_type)::INT + 1) / 10.0::DOUBLE, 4) AS score FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND a.p_partkey % 3 <> b.p_partkey % 3) WHERE score >= 0.5",
    "operator_evaluation": "WITH p AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'held' ELSE 'main' END AS role, event_type, ((value > 50) = (event_id % 2 = 0))::INT AS r FROM events), d AS (SELECT role, event_type, avg(r) AS a FROM p GROUP BY ALL) SELECT role, round(avg(r), 5) AS accuracy, round((SELECT min(a) FROM d WHERE d.role = p.role), 5) AS worst_domain, round(avg((0.6::DOUBLE - r) ** 2), 5) AS calibration FROM p GROUP BY role",
    "preference_pairs": "WITH a AS (SELECT user_id AS prompt, event_id AS answer, round(value, 3) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 3) DESC, event_id DESC) AS b, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 3), event_id) AS w FROM events) SELECT x.prompt, x.answer AS chosen, y.answer AS rejected, round(x.score - y.score, 3) AS margin FROM a x JOIN a y ON x.prompt = y.prompt AND x.b = 1 AND y.w = 1 WHERE x.score > y.score",
    "causal_pairs": "SELECT a.event_type AS cause, b.event_type AS effect, count(*) AS support FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY ALL HAVING count(*) >= 50",
    "fact_upsert": "SELECT subject, predicate, object, fact_id, conflicts FROM (SELECT user_id AS subject, event_type AS predicate, props AS object, event_id AS fact_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts))::BIGINT DESC, event_id DESC) AS r, n - 1 AS conflicts FROM events JOIN (SELECT user_id, event_type, count(DISTINCT props) AS n FROM events GROUP BY ALL) USING (user_id, event_type)) WHERE r = 1",
    "retention_active": f"SELECT event_id AS fact_id, round(r, 4) AS retention FROM (SELECT event_id, {_RET} AS r FROM events) WHERE r >= 0.3",
    "memory_prune": f"SELECT event_type AS predicate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts))::BIGINT DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND {_RET} >= 0.6 GROUP BY event_type",
    "kv_live": "SELECT key, event_id AS value FROM (SELECT user_id % 50 AS key, *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error' AND (event_id % 2 <> 0 OR event_id + 20 > 10000)",
    "kv_counters": "WITH l AS (SELECT user_id AS key, event_id AS ts, event_type FROM events), b AS (SELECT key, max(ts) AS t FROM l WHERE event_type IN ('signup', 'error') GROUP BY key) SELECT l.key, count(*) FILTER (WHERE event_type <> 'error') AS value FROM l LEFT JOIN b ON b.key = l.key WHERE t IS NULL OR ts >= t GROUP BY l.key HAVING count(*) FILTER (WHERE event_type <> 'error') > 0",
    "sink_and_recent": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS d FROM events) WHERE u <= 2 OR d <= 3",
    "dedup_stream": "SELECT event_id, user_id FROM events",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "session_windows": "WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    "lww_apply": "SELECT doc_id, clock, origin, round(value, 3) AS value FROM (SELECT user_id % 40 AS doc_id, event_id AS clock, event_type AS origin, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r = 1",
    "stream_read": "SELECT event_type AS stream, event_id AS id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 25 OFFSET 10",
}
