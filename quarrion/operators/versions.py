"""Versions with validity intervals, status rules, and N-ary relations with roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed moves between states.
EPISTEMIC_MOVES = [("Observed", "Contradicted"), ("Asserted", "Contradicted"), ("Inferred", "Contradicted"), ("Provisional", "Inferred"), ("Provisional", "Contradicted")]
#: Shown for the end of an interval that is still open.
OPEN = (1 << 63) - 1
LIFECYCLE_MOVES = [("Active", "Superseded"), ("Superseded", "Tombstoned"), ("Active", "Tombstoned")]


def closed_intervals(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """log with version (1, 2, ...), valid_from = version and valid_until = the next version, null for the newest."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("valid_from", F.row_number().over(w).cast("long")).withColumn("valid_until", F.lead(F.lit(1)).over(w)).withColumn("valid_until", F.when(F.col("valid_until").isNotNull(), F.col("valid_from") + 1))


def visible(lsn: Column | int, start: str = "valid_from", until: str = "valid_until") -> Column:
    at = lsn if isinstance(lsn, Column) else F.lit(lsn)
    return (F.col(start) <= at) & (F.col(until).isNull() | (at < F.col(until)))


def as_of(versions: DataFrame, key: str, lsn: int | None) -> DataFrame:
    """The newest visible version of each key; lsn None or 0 means the latest state."""
    rows = versions.where(F.col("valid_until").isNull()) if not lsn else versions.where(visible(lsn))
    others = [c for c in versions.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "valid_from").alias("_r")).select(key, "_r.*")


def illegal_moves(moves: DataFrame, before: str, after: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Proposed moves that no rule allows; staying put is allowed."""
    rules = moves.sparkSession.createDataFrame(allowed, [before, after])
    return moves.where(F.col(before) != F.col(after)).join(F.broadcast(rules), [before, after], "left_anti")  # a handful of rules


def role_intersection(bindings: DataFrame, wanted: list[tuple[str, object]]) -> DataFrame:
    """(relation_id): relations that bind all (role, entity) pairs."""
    hit = None
    for role, entity in wanted:
        one = (F.col("role") == role) & (F.col("entity") == F.lit(entity))
        hit = one if hit is None else hit | one
    if hit is None:
        return bindings.select("relation_id").distinct()
    pairs = bindings.where(hit).select("relation_id", "role", "entity").distinct()
    return pairs.groupBy("relation_id").count().where(F.col("count") == len(set(wanted))).select("relation_id")


def relation_query(relations: DataFrame, bindings: DataFrame, roles: list[tuple[str, object]] = (), types: list[str] | None = None, epistemic: list[str] | None = None, lsn: int | None = None) -> DataFrame:
    """Relations visible at lsn that aren't tombstoned, by type, epistemic state and role bindings, ordered by id."""
    rows = relations
    if "valid_from" in relations.columns:
        rows = rows.where(visible(lsn) if lsn else F.col("valid_until").isNull())
    if "lifecycle" in relations.columns:
        rows = rows.where(F.col("lifecycle") != "Tombstoned")
    if types is not None:
        rows = rows.where(F.col("type").isin(types))
    if epistemic is not None:
        rows = rows.where(F.col("epistemic").isin(epistemic))
    if roles:
        rows = rows.join(role_intersection(bindings, list(roles)), "relation_id", "left_semi")
    return rows.orderBy("relation_id")


def hyper_pattern(bindings: DataFrame, pattern: list[tuple[str | None, object]], by_role: bool = True) -> DataFrame:
    """Relations of exactly len(pattern) bindings that fit (role, entity or "?alias") places.

    Bindings are taken in order of (role, entity), or (entity, role) if roles don't count; fixed entities first claim
    theirs, aliases take the rest in order, an alias that recurs standing for one entity.
    """
    order = F.struct("role", "entity") if by_role else F.struct("entity", "role")
    grouped = bindings.groupBy("relation_id").agg(F.sort_array(F.collect_list(order)).alias("b")).where(F.size("b") == len(pattern))
    fixed = [(r, e) for r, e in pattern if not (isinstance(e, str) and e.startswith("?"))]
    free = [(r, e) for r, e in pattern if isinstance(e, str) and e.startswith("?")]
    test = F.lit(True)
    for role, entity in fixed:
        test = test & F.exists("b", lambda x: (x["entity"] == F.lit(entity)) & ((x["role"] == role) if by_role and role else F.lit(True)))  # noqa: B023
    rest = F.filter("b", lambda x: ~_any(x, fixed, by_role)) if fixed else F.col("b")
    out = grouped.where(test).withColumn("rest", rest).where(F.size("rest") == len(free))
    aliases: dict[str, Column] = {}
    for i, (role, alias) in enumerate(sorted(free, key=lambda p: (p[0] or "", p[1])) if by_role else free):
        here = F.get("rest", F.lit(i))
        if by_role and role:
            out = out.where(here["role"] == role)
        if alias in aliases:
            out = out.where(here["entity"] == aliases[alias])
        else:
            aliases[alias] = here["entity"]
    return out.select("relation_id", *[c.alias(a[1:]) for a, c in aliases.items()])


def _any(x: Column, fixed: list, by_role: bool) -> Column:
    out = F.lit(False)
    for role, entity in fixed:
        out = out | ((x["entity"] == F.lit(entity)) & ((x["role"] == role) if by_role and role else F.lit(True)))
    return out


def binary_projection(bindings: DataFrame, sources: list[str], targets: list[str], undirected: bool = False) -> DataFrame:
    """Distinct (src, dst) of the relations' source and target roles, mirrored if undirected.

    Joined by relation, whose number of bindings the schema bounds.
    """
    s = bindings.where(F.col("role").isin(sources)).select("relation_id", F.col("entity").alias("src"))
    t = bindings.where(F.col("role").isin(targets)).select("relation_id", F.col("entity").alias("dst"))
    edges = s.join(t, "relation_id").select("src", "dst")
    if undirected:
        edges = edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.distinct()


def schema_violations(bindings: DataFrame, roles: list[tuple[str, int, int]]) -> DataFrame:
    """(relation_id, role, problem): unknown roles, missing ones, and counts outside (role, least, most)."""
    counts = bindings.groupBy("relation_id", "role").agg(F.count("*").alias("n"))
    found = counts.groupBy("relation_id").agg(F.collect_list(F.struct("role", "n")).alias("found"))
    tell = [_told(role, least, most) for role, least, most in roles]
    unknown = F.transform(F.filter("found", lambda x: F.coalesce(~x["role"].isin([r for r, _, _ in roles]), F.lit(True))), lambda x: F.struct(x["role"].alias("role"), F.lit("unknown role").alias("problem")))
    each = found.select("relation_id", F.explode(F.concat(F.array(*tell), unknown) if tell else unknown).alias("x"))
    return each.where("x.problem is not null").select("relation_id", "x.role", "x.problem")


def _told(role: str, least: int, most: int) -> Column:
    n = F.coalesce(F.get(F.filter("found", lambda x: x["role"] == F.lit(role)), F.lit(0))["n"], F.lit(0))
    problem = F.when((n == 0) & F.lit(least > 0), "missing role").when((n < least) | (n > most), "cardinality")
    return F.struct(F.lit(role).alias("role"), problem.alias("problem"))


def structural_signature(bindings: DataFrame) -> DataFrame:
    """(relation_id, arity, signature): SHA-256 over the arity and the sorted multiplicities of roles, blind to names."""
    per_role = bindings.groupBy("relation_id", "role").agg(F.count("*").alias("n"))
    shape = per_role.groupBy("relation_id").agg(F.sum("n").cast("long").alias("arity"), F.array_join(F.transform(F.sort_array(F.collect_list("n")), lambda x: x.cast("string")), ",").alias("m"))
    return shape.select("relation_id", "arity", F.sha2(F.concat_ws("|", F.col("arity").cast("string"), "m"), 256).alias("signature"))


def fingerprint(bindings: DataFrame) -> DataFrame:
    """(relation_id, fingerprint): SHA-256 over its sorted role=entity bindings."""
    parts = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "role", F.col("entity").cast("string")))), ";")
    return bindings.groupBy("relation_id").agg(F.sha2(parts, 256).alias("fingerprint"))
