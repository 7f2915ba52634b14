"""Promotion, attribution, staleness, fingerprints, gates, catalogs, provenance, exports and other small reports over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q32 = 1 << 32


def promoted(stats: DataFrame, min_observations: int, min_successes: int, min_utility: int, max_contradictions: int) -> Column:
    """Whether evidence reaches all four thresholds."""
    return (F.col("observations") >= min_observations) & (F.col("supports") >= min_successes) & (F.col("utility_sum") >= F.lit(min_utility)) & (F.col("contradictions") <= max_contradictions)


def outcome_delta(before: Column, after: Column) -> tuple[Column, Column]:
    """(after - before in 1 / 2**32, the same as a double)."""
    delta = after - before
    return delta, delta / float(Q32)


def plan_attribution(attempts: DataFrame, standalone: DataFrame) -> DataFrame:
    """(attempt_id, method, credited, withheld): which actions of a plan have earned credit of their own.

    attempts (attempt_id, actions array), standalone (action): actions seen to work alone. A plan of one action earns its credit.
    """
    each = attempts.select("attempt_id", F.explode_outer(F.array_distinct("actions")).alias("action"))
    marked = each.join(standalone.select("action", F.lit(True).alias("alone")).distinct(), "action", "left")
    per = marked.groupBy("attempt_id").agg(F.count("action").alias("n"), F.sort_array(F.collect_list(F.when(F.col("alone"), F.col("action")))).alias("credited"), F.sort_array(F.collect_list(F.when(F.col("alone").isNull(), F.col("action")))).alias("withheld"))
    single = F.col("n") <= 1
    method = F.when(single, "standalone").when(F.size("withheld") == 0, "ablation").otherwise("joint")
    none = F.array().cast(dict(per.dtypes)["withheld"])
    return per.select("attempt_id", method.alias("method"), F.when(single, F.concat("credited", "withheld")).otherwise(F.col("credited")).alias("credited"), F.when(single, none).otherwise(F.col("withheld")).alias("withheld"))


def staleness(parts: list[tuple[str, str, str]]) -> Column:
    """The first of (name, expected, actual) whose columns differ, or fresh."""
    out = None
    for name, expected, actual in parts:
        test = ~F.col(expected).eqNullSafe(F.col(actual))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("fresh")


def fingerprint(context: Column) -> tuple[Column, Column]:
    """(sha256, crc32) of a map's entries in the order of their keys."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), ";")
    return F.sha2(entries, 256), F.crc32(entries.cast("binary"))


def semantic_duplicates(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, occurrences, first): one row for each meaning, with how often it was proposed."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(order).alias("first"))


def explore_stats(log: DataFrame, kind: str, collection: str, outcome: Column, lsn: str, upto: int) -> DataFrame:
    """One row: records, outcomes, kinds and collections seen up to an lsn."""
    return log.where(F.col(lsn) <= upto).agg(F.count("*").alias("records"), F.count_if(outcome).alias("outcomes"), F.array_join(F.sort_array(F.collect_set(kind)), "|").alias("kinds"), F.countDistinct(collection).alias("collections"))


def recent(log: DataFrame, lsn: str, limit: int) -> DataFrame:
    """The newest rows, between 1 and 50 of them."""
    return log.orderBy(F.desc(lsn)).limit(max(1, min(50, limit)))


def catalog(log: DataFrame, name: str, lsn: str) -> DataFrame:
    """(name, id): names numbered from 0 in the order of their first sight. Names are few; log rows aren't."""
    from pyspark.sql import Window

    first = log.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(lsn).alias("_first"))
    return first.select(name, (F.row_number().over(Window.orderBy("_first", name)) - 1).cast("long").alias("id"))


def metric_lines(rows: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """(line): counters as text, backslashes, quotes and line feeds in labels escaped."""
    safe = F.replace(F.replace(F.replace(F.col(label).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return rows.select(F.concat(F.lit(f'{metric}{{{label}="'), safe, F.lit('"} '), F.col(value).cast("string")).alias("line"))


def provenance(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records with their source's name and a confidence weighed by the source's trust; unknown sources count half."""
    return records.join(sources, "source_id", "left").withColumn("weighed", F.col("confidence") * F.coalesce("trust", F.lit(0.5)))


def gate(value: Column, baseline: Column, tolerance: float, lower_is_better: bool = True) -> Column:
    """Whether a value stays within a share of its baseline."""
    return (value <= baseline * (1 + tolerance)) if lower_is_better else (value >= baseline * (1 - tolerance))


def admission(stages: DataFrame, order: str, passed: str, group: str) -> DataFrame:
    """stages with admitted: a stage counts only if all before it in its group passed as well."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("admitted", F.bool_and(passed).over(w))


def digests(tables: dict[str, DataFrame]) -> dict[str, str]:
    """A checkpoint's digest for each table, whatever the order of rows and columns."""
    from ..sources.stores import digest

    return {name: digest(df) for name, df in tables.items()}


def verified(tables: dict[str, DataFrame], expected: dict[str, str]) -> list[str]:
    """Names of tables that a checkpoint's digests don't match, missing ones included."""
    found = digests({k: v for k, v in tables.items() if k in expected})
    return sorted(k for k in {*tables, *expected} if found.get(k) != expected.get(k))


def mapping_classes(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, component): classes of concepts that confirmed mappings (src, dst, state) make one."""
    from .graph import components

    return components(nodes, mappings.where("state = 'confirmed'"))


def bound_roles(bindings: DataFrame, roles: list[str]) -> DataFrame:
    """(relation_id, one column a role): relations that bind all of the roles, every combination of their entities."""
    out = None
    for role in roles:
        part = bindings.where(F.col("role") == role).select("relation_id", F.col("entity").alias(role))
        out = part if out is None else out.join(part, "relation_id")
    return out


def evidence_of(hits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(hit_id, score, outcomes, successes): search hits with the outcomes whose evidence_ids name them."""
    told = outcomes.select(F.explode(F.array_distinct("evidence_ids")).alias("hit_id"), "success").groupBy("hit_id").agg(F.count("*").alias("outcomes"), F.count_if("success").alias("successes"))
    return hits.join(told, "hit_id", "left").na.fill(0, ["outcomes", "successes"])


def hyperedges(bindings: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relation_id, entities, domains) of relations all of whose entities have a domain, and (relation_id, missing) of the others."""
    both = bindings.join(domains, "entity", "left")
    # a relation's roles are few; counting distinct ones would send each row three times
    per = both.groupBy("relation_id").agg(F.size(F.collect_set("entity")).cast("long").alias("entities"), F.size(F.collect_set("domain")).cast("long").alias("domains"), F.count_if(F.col("domain").isNull()).alias("missing"))
    return per.where("missing = 0").drop("missing"), per.where("missing > 0").select("relation_id", "missing")


def invalidated(changed: DataFrame, located: DataFrame, dependencies: DataFrame, depth: int) -> DataFrame:
    """(entity, depth): entities at changed locators, and what depends on them within `depth` steps.

    located (locator, entity), dependencies (src depends on dst)."""
    from .graph import reach

    direct = located.join(changed.select("locator"), "locator", "left_semi").select("entity").distinct()
    far = reach(dependencies, direct.select(F.col("entity").alias("start")), depth, 1, "in")
    return direct.select("entity", F.lit(0).alias("depth")).unionByName(far.select(F.col("node").alias("entity"), "depth")).groupBy("entity").agg(F.min("depth").alias("depth"))


def explained(symbols: DataFrame, calls: DataFrame, symbol) -> DataFrame:
    """One row: callers, callees and tests of a symbol. symbols (id, is_test), calls (src, dst)."""
    s = F.lit(symbol)
    near = calls.where(F.col("src") == s).select(F.lit("callee").alias("side"), F.col("dst").alias("id")).unionByName(calls.where(F.col("dst") == s).select(F.lit("caller").alias("side"), F.col("src").alias("id"))).distinct()
    near = near.join(symbols, "id")
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("id"))))
    return near.agg(pick((F.col("side") == "caller") & ~F.col("is_test")).alias("callers"), pick(F.col("side") == "callee").alias("callees"), pick((F.col("side") == "caller") & F.col("is_test")).alias("tests"))


def code_diff(before: DataFrame, after: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, change, callers, tests): changed symbols (id, hash, is_test) with how much calls them.

    calls (src, dst) of the later state; a symbol's tests are its callers that are tests."""
    b, a = before.select("id", F.col("hash").alias("h0")), after.select("id", F.col("hash").alias("h1"))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("modified")
    changed = b.join(a, "id", "full_outer").where(~F.col("h0").eqNullSafe(F.col("h1"))).select("id", change.alias("change"))
    users = calls.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi").join(after.select(F.col("id").alias("src"), "is_test"), "src").groupBy(F.col("dst").alias("id")).agg(F.countDistinct(F.when(~F.col("is_test"), F.col("src"))).alias("callers"), F.countDistinct(F.when(F.col("is_test"), F.col("src"))).alias("tests"))
    return changed.join(users, "id", "left").na.fill(0, ["callers", "tests"])


def ingest_delta(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, path) and edges (src, dst) with those of changed paths (path) replaced; edges that lost an end go."""
    kept = nodes.join(changed.select("path"), "path", "left_anti").select(*nodes.columns).unionByName(new_nodes)
    gone = nodes.join(changed.select("path"), "path", "left_semi").select("id")
    rest = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns).unionByName(new_edges)
    ids = kept.select("id").distinct()
    return kept, rest.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def composed(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(src, type, dst, evidence): what rules (first type, second type, made type) conclude over two edges, with the mean of their weights."""
    table = edges.sparkSession.createDataFrame(rules, "t1 string, t2 string, made string")
    a = edges.select(F.col("src"), F.col("type").alias("t1"), F.col("dst").alias("mid"), F.col("weight").alias("w1")).join(F.broadcast(table), "t1")  # a rule table
    b = edges.select(F.col("src").alias("mid"), F.col("type").alias("t2"), F.col("dst"), F.col("weight").alias("w2"))
    return a.join(b, ["mid", "t2"]).where("src <> dst").groupBy("src", F.col("made").alias("type"), "dst").agg(F.avg((F.col("w1") + F.col("w2")) / 2).alias("evidence"))


def merged_proofs(regions: DataFrame, k: int) -> DataFrame:
    """(id, score, certified): the k best of regional top lists (region, id, score, bound).

    bound: what no unseen vector of the region can beat. A hit is certified if no region's bound lies above it."""
    bound = regions.agg(F.max("bound").alias("most"))
    best = regions.orderBy(F.desc("score"), "id").limit(k)
    return best.crossJoin(F.broadcast(bound)).select("id", "score", (F.col("score") >= F.col("most")).alias("certified"))  # one row


def reciprocal(neighbours: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that are in each other's lists (query_id, vec_id)."""
    n = neighbours.where("query_id <> vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"))
    return n.where("a < b").join(n.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def json_view(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(json): each row as a JSON object, keys in the order given."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def fan_out(messages: DataFrame, subscriptions: DataFrame, channel: str) -> DataFrame:
    """Each message for each subscriber of its channel. subscriptions (channel, subscriber) are few."""
    return messages.join(subscriptions.withColumnRenamed("channel", channel), channel)


def set_members(log: DataFrame) -> DataFrame:
    """(key, member) of sets after a log (key, member, op add/remove, ts)."""
    last = log.groupBy("key", "member").agg(F.max_by("op", "ts").alias("op"))
    return last.where("op = 'add'").select("key", "member")
