"""Discovery from cases: motifs, schemas, concept maps, validation and rules.

Cases: (case_id, domain, roots array, features array<string>, resolution, success boolean or null, partition).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ratio
from .graph import written


def combinations(features: Column, most: int) -> Column:
    """All subsets of 1..most of the elements, in their order, as arrays."""
    kind = "array<array<string>>"

    # each subset carries the place of its last element
    n = F.size(features)
    single = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array(F.get(features, i)).alias("c"), i.alias("at")))).otherwise(F.array().cast("array<struct<c:array<string>,at:int>>"))
    levels = [single]
    for _ in range(1, most):
        longer = F.flatten(F.transform(levels[-1], lambda s: F.when(s["at"] < n - 1, F.transform(F.sequence(s["at"] + 1, n - 1), lambda j: F.struct(F.array_append(s["c"], F.get(features, j)).alias("c"), j.alias("at")))).otherwise(F.array().cast("array<struct<c:array<string>,at:int>>"))))
        levels.append(longer)
    return F.transform(F.concat(*levels), lambda s: s["c"]).cast(kind)


@dataclass(frozen=True)
class MotifPolicy:
    max_features: int = 24
    max_terms: int = 4
    min_successes: int = 3
    min_domains: int = 2
    max_motifs: int = 256


def mine_motifs(cases: DataFrame, policy: MotifPolicy = MotifPolicy()) -> DataFrame:
    """(conditions, resolution, successes, contradictions, domains, precision, precision_q32), the best max_motifs.

    Order: precision down, successes down, fewer terms, then conditions and resolution. Cases alike are counted
    first, so their subsets are made once; the subsets of a case are bounded by max_features and max_terms.
    """
    known = cases.where("resolution is not null and success is not null")
    features = F.slice(F.array_sort("features"), 1, policy.max_features)
    alike = known.groupBy(features.alias("features"), "domain", "resolution").agg(F.count_if("success").alias("yes"), F.count_if(~F.col("success")).alias("no"))
    rows = alike.select("domain", "resolution", "yes", "no", F.explode(combinations(F.col("features"), policy.max_terms)).alias("conditions"))
    each = rows.groupBy("conditions", "resolution", "domain").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    sums = each.groupBy("conditions", "resolution").agg(F.sum("yes").alias("successes"), F.sum("no").alias("contradictions"), F.count("domain").alias("domains"))
    good = sums.where((F.col("successes") >= policy.min_successes) & (F.col("domains") >= policy.min_domains))
    good = good.withColumn("precision", F.col("successes") / (F.col("successes") + F.col("contradictions"))).withColumn("precision_q32", ratio(F.col("successes"), F.col("successes") + F.col("contradictions")))
    return good.orderBy(F.desc("precision_q32"), F.desc("successes"), F.size("conditions"), F.array_join("conditions", "|"), "resolution").limit(policy.max_motifs)


def induce_schemas(members: DataFrame, min_domains: int = 2, min_members: int = 2, min_roots: int = 2) -> DataFrame:
    """(capabilities, roles, domains, members, roots): groups of members of like capabilities and roles that are wide enough."""
    rows = members.withColumn("capabilities", F.array_sort("capabilities")).withColumn("roles", F.array_sort("roles"))
    groups = rows.groupBy("capabilities", "roles").agg(F.countDistinct("domain").alias("domains"), F.countDistinct("member_id").alias("members"), F.countDistinct("root").alias("roots"))
    return groups.where((F.col("domains") >= min_domains) & (F.col("members") >= min_members) & (F.col("roots") >= min_roots))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _likeness(a: Column, b: Column) -> Column:
    """jaccard() of sorted arrays; equal ones and single elements need no sets."""
    return F.when(a == b, F.when(F.size(a) > 0, 1.0).otherwise(0.0)).when((F.size(a) == 1) & (F.size(b) == 1), 0.0).otherwise(jaccard(a, b))


def _joined(left: Column, right: Column) -> Column:
    """Each text of one array with each of another."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))


def _headed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), x.cast("string")))


#: Kinds of a concept's features and what each counts in a score, of 10.
KINDS = {"roles": 4, "outcomes": 3, "capabilities": 2, "times": 1}
#: Concepts of a profile in one row at most.
PROFILE = 512
#: Tasks that share what meets by one key.
SALTS = 4


def map_concepts(concepts: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(left, right, score): concepts of different domains that resemble each other in roles 4, outcomes 3, capabilities 2 and times 1.

    Concepts that share no role, outcome or capability cannot reach a score over 0.1 and are left out. Those of a domain that are alike
    make a profile. Profiles meet by what min_score asks for: one feature of each kind of a least set of kinds that can reach it. A
    pair is scored once, where its first set meets; then profiles give way to their concepts.
    """
    met = ["roles", "outcomes", "capabilities"]
    least = [s for n in (1, 2, 3) for s in itertools.combinations(met, n) if sum(KINDS[k] for k in s) + KINDS["times"] >= 10 * min_score - 1e-9]
    sets = [s for s in least if not any(set(t) < set(s) for t in least)]
    rows = concepts.select("concept_id", "domain", *KINDS).where(" and ".join(f"{k} is not null" for k in ["concept_id", "domain", *KINDS]))
    none = rows.select(F.col("concept_id").alias("left"), F.col("concept_id").alias("right"), F.lit(0.0).alias("score")).limit(0)
    if not sets:
        return none
    sorted_ = rows.select("concept_id", "domain", *[F.sort_array(k).alias(k) for k in KINDS])
    # a chunk bounds the array of a row
    sized = sorted_.groupBy("domain", *KINDS).agg(F.count("*").alias("n"))
    dealt = sorted_.join(sized.where(F.col("n") > PROFILE), ["domain", *KINDS], "left") if sized.where(F.col("n") > PROFILE).limit(1).count() else sorted_.withColumn("n", F.lit(1))
    chunk = F.pmod(F.xxhash64("concept_id"), F.ceil(F.coalesce("n", F.lit(1)) / PROFILE)).alias("chunk")
    profiles = dealt.groupBy("domain", *KINDS, chunk).agg(F.collect_list("concept_id").alias("ids"))
    profiles = profiles.withColumn("p", F.struct("domain", *KINDS, "chunk"))
    keyed = None
    for i, kinds in enumerate(sets):
        combined = F.array(F.lit(f"{i}"))
        for k in kinds:
            one = F.array_distinct(F.transform(k, lambda x: F.coalesce(F.concat(F.lit("="), F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("null"))))
            combined = _joined(combined, one)
        keyed = combined if keyed is None else F.concat(keyed, combined)
    shown = F.array_compact(F.concat(*[_headed(k) for k in met]))
    bare = ~F.exists(F.concat(*[F.transform(k, lambda x: x.isNull()) for k in met]), lambda x: x)
    # every meeting is parted among SALTS tasks
    both = written(profiles.select("p", "ids", keyed.alias("keys"), shown.alias("shown"), bare.alias("bare"), F.pmod(F.xxhash64("p"), F.lit(SALTS)).alias("own")))
    tasks = max(int(concepts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 96)
    side = lambda df, n, salt: df.select(F.col(salt).alias("salt"), F.explode("keys").alias("key"), *[F.col(c).alias(f"{c}{n}") for c in ("p", "ids", "keys", "shown", "bare")]).repartition(tasks, "key", "salt")
    other = both.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    pairs = side(both, 1, "own").join(side(other, 2, "salt"), ["key", "salt"]).where("p1 < p2 and p1.domain <> p2.domain")
    once = (F.get("keys1", F.lit(0)) == F.col("key")) | (F.col("key") == F.get(F.array_intersect("keys1", "keys2"), F.lit(0)))
    pairs = pairs.where(once & (F.col("bare1") | F.col("bare2") | F.arrays_overlap("shown1", "shown2")))
    score = sum((F.lit(float(w)) * _likeness(F.col(f"p1.{k}"), F.col(f"p2.{k}")) for k, w in KINDS.items()), F.lit(0.0)) / 10.0
    good = pairs.select("ids1", "ids2", score.alias("score")).where(F.col("score") >= min_score)
    out = good.select("score", "ids2", F.explode("ids1").alias("a")).select("score", "a", F.explode("ids2").alias("b"))
    return out.where("a <> b").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "score")


def validate_rule(cases: DataFrame, condition: Column, resolution: str) -> DataFrame:
    """One row: cases the rule speaks of, precision, baseline, lift, contradiction ratio, domains, roots, domain passes and failures at 0.8.

    Only validation cases that share no root with discovery count.
    """
    roots = cases.where("partition = 'discovery'").select(F.explode("roots").alias("root")).distinct()
    held = cases.where((F.col("partition") == "validation") & (F.col("resolution") == resolution) & F.col("success").isNotNull())
    spoiled = held.select("case_id", F.explode("roots").alias("root")).join(roots, "root", "left_semi").select("case_id").distinct()
    held = held.join(spoiled, "case_id", "left_anti").withColumn("hit", F.coalesce(condition, F.lit(False)))
    per = held.where("hit").groupBy("domain").agg((F.count_if("success") / F.count("*")).alias("p")).agg(F.count_if(F.col("p") >= 0.8).alias("passes"), F.count_if(F.col("p") < 0.8).alias("failures"))
    one = held.agg(
        F.count_if("hit").alias("evaluated"),
        F.count_if(F.col("hit") & F.col("success")).alias("successes"),
        (F.count_if("success") / F.count("*")).alias("baseline"),
        F.countDistinct(F.when(F.col("hit"), F.col("domain"))).alias("domains"),
    )
    out = one.crossJoin(F.broadcast(per))  # one row each
    precision = F.when(F.col("evaluated") > 0, F.col("successes") / F.col("evaluated")).otherwise(0.0)
    return out.withColumn("precision", precision).withColumn("lift", F.col("precision") - F.col("baseline")).withColumn("contradiction_ratio", F.when(F.col("evaluated") > 0, 1 - F.col("precision")).otherwise(0.0))


def evaluate(predictions: DataFrame) -> DataFrame:
    """(role, accuracy, worst_domain, calibration): predictions (role, domain, predicted, observed, confidence)."""
    right = (F.col("predicted") == F.col("observed")).cast("double")
    domain = predictions.groupBy("role", "domain").agg(F.sum(right).alias("r"), F.count("*").alias("n"), F.sum(F.pow(F.col("confidence") - right, 2)).alias("b"))
    return domain.groupBy("role").agg((F.sum("r") / F.sum("n")).alias("accuracy"), F.min(F.col("r") / F.col("n")).alias("worst_domain"), (F.sum("b") / F.sum("n")).alias("calibration"))


def repeated_shapes(edges: DataFrame, min_support: int = 3, min_domains: int = 2, cap: int = 1024) -> DataFrame:
    """(signature, support, domains): structural signatures that recur; edges (edge_id, signature, domain)."""
    sums = edges.groupBy("signature").agg(F.count("*").alias("support"), F.countDistinct("domain").alias("domains"))
    return sums.where((F.col("support") >= min_support) & (F.col("domains") >= min_domains)).orderBy(F.desc("support"), "signature").limit(cap)


def causal_sequences(edges: DataFrame, max_gap: int = 10_000, min_support: int = 3) -> DataFrame:
    """(cause, effect, support): signature pairs where an edge names its predecessor within the gap; edges (edge_id, signature, lsn, predecessors)."""
    later = edges.select(F.col("signature").alias("effect"), F.col("lsn").alias("l2"), F.explode("predecessors").alias("p"))
    met = later.join(edges.select(F.col("edge_id").alias("p"), F.col("signature").alias("cause"), F.col("lsn").alias("l1")), "p").where((F.col("l2") > F.col("l1")) & (F.col("l2") - F.col("l1") <= max_gap))
    return met.groupBy("cause", "effect").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


# --- rules -------------------------------------------------------------------------------------------------------------


class RuleError(ValueError):
    pass


def compile_condition(rule, depth: int = 0) -> Column:
    """Condition of the rule language as a Column over `features`, `domain` and `attributes` (map<string, double>).

    ["true"], ["has", f], ["lacks", f], ["domain", d], ["compare", numeric, sign, numeric], ["all", ...], ["any", ...], ["not", c]
    """
    if depth > 16:
        raise RuleError("deeper than 16")
    kind, *args = rule
    inner = lambda: [compile_condition(a, depth + 1) for a in args]
    if kind == "true":
        return F.lit(True)
    if kind == "has":
        return F.array_contains("features", args[0])
    if kind == "lacks":
        return ~F.array_contains("features", args[0])
    if kind == "domain":
        return F.col("domain") == F.lit(args[0])
    if kind == "compare":
        a, b = compile_number(args[0]), compile_number(args[2])
        signs = {"<": a < b, "<=": a <= b, "=": a == b, ">=": a >= b, ">": a > b}
        if args[1] not in signs:
            raise RuleError(f"no comparison {args[1]!r}")
        return F.coalesce(signs[args[1]], F.lit(False))
    if kind == "all":
        out = F.lit(True)
        for c in inner():
            out = out & c
        return out
    if kind == "any":
        out = F.lit(False)
        for c in inner():
            out = out | c
        return out
    if kind == "not":
        return ~inner()[0]
    raise RuleError(f"no condition {kind!r}")


def compile_number(expr) -> Column:
    """["attribute", name], ["constant", x], ["add" | "subtract" | "multiply" | "min" | "max", a, b]"""
    kind, *args = expr
    if kind == "attribute":
        return F.col("attributes").getItem(args[0])
    if kind == "constant":
        return F.lit(float(args[0]))
    a, b = (compile_number(x) for x in args)
    table = {"add": a + b, "subtract": a - b, "multiply": a * b, "min": F.least(a, b), "max": F.greatest(a, b)}
    if kind not in table:
        raise RuleError(f"no operation {kind!r}")
    return table[kind]


def size(rule) -> int:
    return 1 + sum(size(x) for x in rule if isinstance(x, list))


@dataclass(frozen=True)
class RuleSpec:
    """effects: ("predict", outcome) | ("propose", resolution) | ("derive", feature) | ("require", feature)"""

    name: str
    condition: list
    effects: tuple

    def validate(self) -> None:
        if size(self.condition) > 256:
            raise RuleError("more than 256 nodes")
        if len(self.effects) > 32:
            raise RuleError("more than 32 effects")
        compile_condition(self.condition)


def compose(*rules: list) -> list:
    """One condition that holds where all do."""
    return ["all", *rules]


def rule_from_motif(name: str, conditions: list[str], resolution: str) -> RuleSpec:
    return RuleSpec(name, ["all", *[["has", c] for c in conditions]], (("propose", resolution),))


def run_rules(cases: DataFrame, rules: list[RuleSpec]) -> DataFrame:
    """cases with fired (rule names), proposals, predictions and derived features; an unmet requirement clears the rule's proposals."""
    for r in rules:
        r.validate()
    empty = F.array().cast("array<string>")
    holds = [F.coalesce(compile_condition(r.condition), F.lit(False)) for r in rules]

    def gather(effect: str) -> Column:
        parts = [empty]
        for r, h in zip(rules, holds, strict=True):
            values = [F.lit(v) for k, v in r.effects if k == effect]
            ok = h
            if effect == "propose":
                for k, v in r.effects:
                    if k == "require":
                        ok = ok & F.array_contains("features", v)
            if values:
                parts.append(F.when(ok, F.array(*values)).otherwise(empty))
        return F.array_distinct(F.concat(*parts))

    fired = F.concat(empty, *[F.when(h, F.array(F.lit(r.name))).otherwise(empty) for r, h in zip(rules, holds, strict=True)])
    return cases.select(*cases.columns, fired.alias("fired"), gather("propose").alias("proposals"), gather("predict").alias("predictions"), gather("derive").alias("derived"))


def synthesise(precedents: DataFrame, context: str, weights: tuple[float, float, float, float] = (1.0, 1.0, 2.0, 4.0)) -> DataFrame:
    """Precedents (precedent_id, residual, context, utility, contradicting, supporting, contradicted) by score down, fewer supporting attempts first."""
    ws, wc, wu, wp = weights
    structural = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("residual")))
    same = F.when(F.col("context") == context, 1.0).otherwise(0.5)
    score = structural * ws + same * wc + F.col("utility") * wu - F.col("contradicting") * wp - F.when(F.col("contradicted"), F.lit(float(wp))).otherwise(0.0)
    return precedents.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "supporting", "precedent_id")


def experiment_gain(candidates: DataFrame) -> DataFrame:
    """(experiment, gain): n / (n + 1) over its competing resolutions."""
    n = candidates.groupBy("experiment").agg(F.countDistinct("resolution").alias("n"))
    return n.select("experiment", (F.col("n") / (F.col("n") + 1)).alias("gain"))


def preference_pairs(answers: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected, margin) as JSON lines can hold them: each prompt's best answer against its worst."""
    best = answers.groupBy("prompt").agg(F.max_by(F.struct("answer", "score"), F.struct("score", "answer")).alias("b"), F.min_by(F.struct("answer", "score"), F.struct("score", "answer")).alias("w"))
    return best.where(F.col("b.score") > F.col("w.score")).select("prompt", F.col("b.answer").alias("chosen"), F.col("w.answer").alias("rejected"), (F.col("b.score") - F.col("w.score")).alias("margin"))
