"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seed entities come from fixed expressions. The words around them are lexical patterns; patterns and the values found beside
them form a graph that is scored in rounds: a pattern is worth the share of its distinct values that are
believed to be of the kind, a value what its patterns together make likely. Patterns that reach a
confidence with enough distinct seeds discover values of the kind that no expression matches, of one word or several.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied, written

#: The expressions of the contract, and the kinds in its order.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches found without trying a run of characters from each of its places, so that long runs cost linear time;
#: for cards only the runs with digits enough.
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": KINDS["phone"],
}
#: What a text must contain for a kind to be looked for.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: What a discovered value of a kind must look like at least.
_SHAPE = {"email": r"@|\bat\b|\(at\)|\[at\]", "ip": r"^[0-9A-Fa-f.:]*[0-9][0-9A-Fa-f.:]*$", "card": r"^[^A-Za-z]*(?:[0-9][^A-Za-z0-9]*){8,}$", "phone": r"^[^A-Za-z]*(?:[0-9][^A-Za-z0-9]*){6,}$"}

#: Characters of context on each side, and words taken from them.
REACH = 64
CONTEXT_WORDS = 2
ROUNDS = 3
#: Distinct seed values that a pattern needs, and the confidence at which it (and a value) counts.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8


#: Matches whose places are summed up together.
_RUN = 256


def _with_spans(df: DataFrame, looked: dict[str, tuple[str, str, Column]], keep: list[str]) -> DataFrame:
    """df's columns `keep`, and for each name in looked an array<struct<start, end, value>> of matches.

    looked: name -> (text column, expression, whether to look at all). Matches are leftmost and don't overlap; code points,
    end exclusive. `<name>_gaps` holds what lies between the matches. Places are sums of lengths, taken in
    runs of _RUN matches, so that texts with many matches cost little more than linear time. Each step reads the columns of
    the one before several times, so that Spark computes them once a row.
    """
    none = F.array().cast("array<string>")
    names = [f"{n}_gaps" for n in looked]
    hits = [f"{n}_hits" for n in looked]
    starts = [f"{n}_starts" for n in looked]
    first = [c for n, (t, e, when) in looked.items() for c in (F.when(when, F.split(t, e, -1)).otherwise(none).alias(f"{n}_gaps"), F.when(when, F.regexp_extract_all(t, F.lit(e), F.lit(0))).otherwise(none).alias(f"{n}_hits"))]
    df = df.select(*keep, *first)

    def size(n: str, at: Column) -> Column:
        return F.length(F.get(f"{n}_gaps", at)) + F.length(F.get(f"{n}_hits", at))

    def run(n: str, r: Column) -> Column:
        return F.sequence(r * _RUN, F.least((r + 1) * _RUN, F.size(f"{n}_hits")) - 1)

    def runs(n: str) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(f"{n}_hits") - 1) / _RUN).cast("int"))

    def begun(n: str) -> Column:
        """Where each run of matches begins."""
        nil = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, r: F.struct(F.aggregate(run(n, r), acc["at"], lambda a, i: a + size(n, i)).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        return F.when(F.size(f"{n}_hits") > 0, F.aggregate(runs(n), nil, step)["all"])

    df = df.select(*keep, *names, *hits, *[begun(n).alias(f"{n}_starts") for n in looked])

    def placed(n: str) -> Column:
        nil = F.array().cast("array<struct<start:int,end:int,value:string>>")

        def step(acc: Column, i: Column) -> Column:
            value = F.get(f"{n}_hits", i)
            begin = acc["at"] + F.length(F.get(f"{n}_gaps", i))
            end = begin + F.length(value)
            return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))).alias("found"))

        of = lambda r: F.aggregate(run(n, r), F.struct(F.get(f"{n}_starts", r).alias("at"), nil.alias("found")), step)["found"]
        return F.when(F.size(f"{n}_hits") > 0, F.flatten(F.transform(runs(n), of))).otherwise(nil)

    return df.select(*keep, *names, *hits, *starts, *[placed(n).alias(n) for n in looked]).drop(*starts)


#: Characters of a piece of text.
_PIECE = 1024


def _pieces(text: Column) -> Column:
    """A text in pieces, to be a column of its own: cut() then needn't walk through the whole text for each place in it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _cut(pieces: str, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in pieces."""
    first = F.floor(start / _PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((end - 1) / _PIECE).cast("int") - first + 1)
    return F.when(end > start, F.array_join(some, "").substr(start - first * _PIECE + 1, end - start)).otherwise(F.lit(""))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _part_ok(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


#: Whether a match is one of its kind.
_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part_ok),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
_ARRAY = "array<struct<start:int,rank:int,end:int,value:string>>"


def with_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, base): row holds all columns of docs as they came; base all base spans of a text by start, then
    kind: array<struct<start, rank, end, value>>, rank being the kind's place."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    looked = {k: ("text", _FAST[k], F.contains("text", F.lit(_HINT[k])) if _HINT[k] else F.col("text").rlike("[0-9]")) for k in KINDS}
    found = _with_spans(packed, looked, ["row", "doc_id", "text"])

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(kind, lambda x: _VALID[kind](x["value"]))
        return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value"))).cast(_ARRAY)

    return found.select("row", "doc_id", "text", F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(KINDS)])).alias("base"))


def _words(side: Column) -> Column:
    """Words of a context, case folded, digits as 0, closing marks left out."""
    return F.filter(F.transform(F.split(F.lower(side), r"[ \x09-\x0D]+"), lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9]+", "0"), r"[.,;!?]+$", "")), lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns between two contexts: one and two words in front, and one word on each side."""
    before, after = _words(before), _words(after)
    last = F.get(before, F.size(before) - 1)
    prior = F.get(before, F.size(before) - 2)
    nxt = F.get(after, F.lit(0))
    made = F.array(F.concat(F.lit("L1|"), last), F.concat(F.lit("L2|"), prior, F.lit(" "), last), F.concat(F.lit("LR|"), last, F.lit("|"), nxt))
    return F.filter(made, lambda p: p.isNotNull())


#: Candidates for discovery of one word: with a digit or an at sign in them, without marks at their ends.
_CANDIDATE = r"(?<![^ \x09-\x0D(\[\"'<=:])[^ \x09-\x0D(\[\"'<>]*[0-9@][^ \x09-\x0D\"'<>]*"
#: Candidates of several words: maximal runs of digit groups, and names at hosts.
_GROUPS = r"(?<![\p{L}0-9@])[(\[]?\+?[0-9]++(?![\p{L}0-9@])(?:[\x20()\[\]./-]{1,3}[0-9]++(?![\p{L}0-9@]))+"
_AT = r"(?i)(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20(?:at|@)\x20)[\p{L}\p{N}-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[\p{L}\p{N}-]++)*+"
#: What a text must contain for candidates of names at hosts, and for any occurrence.
_AT_HINT = r"(?i)[\x20(\[](?:at|@)[\x20)\]]"
_ANY = r"(?i)[0-9@]|[\x20(\[]at[\x20)\]]"


def _replaced(pieces: str, spans: str, by, length: Column) -> Column:
    """The text of `length` characters with by(x, uncovered start) for each span x, overlapping spans one after another."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["at"], x["end"])
        return F.struct(end.alias("at"), F.array_append(acc["parts"], F.concat(_cut(pieces, acc["at"], x["start"]), by(x, acc["at"]))).alias("parts"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), _cut(pieces, acc["at"], length)))


def _candidates(rich: DataFrame) -> DataFrame:
    """(doc_id, th, pieces, found): spans for discovery beside the base spans: digit groups, names at hosts, and words that touch neither
    a base span nor a digit group. rich: (doc_id, th, text, pieces, base)."""
    keep = ["doc_id", "th", "pieces", "base"]
    cover = lambda x, at: F.repeat(F.lit("\x01"), F.greatest(F.lit(0), x["end"] - F.greatest(at, x["start"])))
    rest = rich.select(*keep, F.when(F.size("base") == 0, F.col("text")).otherwise(_replaced("pieces", "base", cover, F.length("text"))).alias("rest"))
    found = _with_spans(rest, {"groups": ("rest", _GROUPS, F.col("rest").rlike("[0-9]")), "at": ("rest", _AT, F.col("rest").rlike(_AT_HINT))}, [*keep, "rest"])
    covered = F.transform("groups_gaps", lambda gap, i: F.concat(gap, F.coalesce(F.repeat(F.lit("\x02"), F.length(F.get("groups_hits", i))), F.lit(""))))
    found = found.select(*keep, "groups", "at", F.when(F.size("groups") > 0, F.array_join(covered, "")).otherwise(F.col("rest")).alias("rest"))
    found = _with_spans(found, {"free": ("rest", _CANDIDATE, F.col("rest").rlike("[0-9@]"))}, [*keep, "groups", "at"])
    alone = F.filter("free", lambda x: ~x["value"].rlike("[\x01\x02]"))
    return found.select(*keep, F.concat("groups", "at", alone).alias("found"))


def occurrences(base: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, value, patterns): seeds with their kind, candidates with kind null."""
    rich = base.where(F.col("text").rlike(_ANY)).select("doc_id", "text", "base", F.xxhash64("text").alias("th"), _pieces(F.col("text")).alias("pieces"))
    names = F.array(*[F.lit(k) for k in KINDS])
    seed = F.transform("base", lambda x: F.struct(F.get(names, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    def stripped(x: Column) -> Column:
        value = F.rtrim(x["value"], F.lit(".,;:!?)]"))
        return F.struct(F.lit(None).cast("string").alias("kind"), x["start"].alias("start"), (x["start"] + F.length(value)).cast("int").alias("end"), value.alias("value"))

    loose = F.filter(F.transform("found", stripped), lambda x: x["end"] > x["start"])
    every = _candidates(rich).select("doc_id", "th", "pieces", F.concat(seed, loose).alias("every"))
    before = lambda x: _cut("pieces", F.greatest(x["start"] - REACH, F.lit(0)), x["start"])
    # both contexts are cut before the rows part, so that no row carries a text
    around = F.transform("every", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), before(x).alias("before"), _cut("pieces", x["end"], x["end"] + REACH).alias("after")))
    both = every.select("doc_id", "th", F.explode(around).alias("x")).select("doc_id", "th", "x.*")
    return both.withColumn("patterns", _patterns(F.col("before"), F.col("after"))).drop("before", "after")


def score_graph(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern, kind, confidence, seeds) and values (value, kind, belief) of the graph.

    edges: distinct (pattern, value, seed), seed being the kind of a seed value or null. Seeds are believed fully;
    other values start from nothing. A pattern's confidence for a kind is the belief in its values over
    their number plus one; a value's belief is 1 less the product of its patterns' doubts. Patterns short of
    `min_seeds` distinct seeds of the kind are worth nothing.
    """
    per_pattern = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    support = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds)
    useful = written(support.join(per_pattern, "pattern"), "patterns")
    # only edges of patterns with enough seeds can carry belief
    live = written(edges.where("seed is null").join(useful.select("pattern", "kind"), "pattern").select("pattern", "kind", "value"), "edges")
    believed = None
    scored = useful.withColumn("confidence", F.col("seeds") / (F.col("n") + 1))
    for k in range(rounds):
        doubt = scored.select("pattern", "kind", F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))).alias("d"))
        believed = live.join(doubt, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum("d"))).alias("belief"))
        believed = written(believed, f"values{k}")
        if k + 1 < rounds:
            more = live.join(believed, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("more"))
            scored = written(useful.join(more, ["pattern", "kind"], "left").withColumn("confidence", (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + 1)).drop("more"), f"scores{k}")
    return scored, believed


def discovered(occ: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, th, start, rank, end, value): candidate occurrences beside a confident pattern, of believed values."""
    edges = written(occ.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").alias("seed")).distinct(), "graph")
    patterns, values = score_graph(edges, rounds, min_seeds)
    confident = patterns.where(F.col("confidence") >= min_confidence).select("pattern", "kind")
    believed = values.where(F.col("belief") >= min_confidence).select("value", "kind")
    loose = occ.where("kind is null").drop("kind").withColumn("pattern", F.explode("patterns"))
    hits = loose.join(confident, "pattern").join(believed, ["value", "kind"])
    fits = reduce(lambda a, k: a.when(F.col("kind") == k, F.col("value").rlike(_SHAPE[k])), KINDS, F.when(F.lit(False), F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    return hits.where(fits).select("doc_id", "th", "start", rank.alias("rank"), "end", "value").distinct()


@tidied
def find(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, base, spans): base spans and all spans of each text, by start, then kind.

    Null and empty texts have no spans. Rows with equal id and text have equal spans, each row its own; null ids are
    allowed. Discovered spans never overlap base spans of their document.
    """
    base = with_base(docs, id_col, text_col)
    occ = written(occurrences(base), "occurrences")
    more = discovered(occ, rounds, min_seeds, min_confidence)
    extra = more.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("start", "rank", "end", "value")).alias("extra"))
    # of spans of a kind inside each other the longest
    inside = lambda x, y: (y["rank"] == x["rank"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    extra = written(extra.withColumn("extra", F.filter("extra", lambda x: ~F.exists("extra", lambda y: inside(x, y)))), "extra")
    if extra.count() <= MAX_BROADCAST:
        extra = F.broadcast(extra)
    joined = base.join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left")
    return joined.select("row", "doc_id", "text", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", F.col("extra").cast(_ARRAY)))).alias("spans"))


#: Documents with discoveries that may be broadcast (a few hundred bytes each); more are joined by shuffle.
MAX_BROADCAST = 20_000


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """found with `redacted`: every span's text replaced by its kind in brackets, overlapping spans together by the first one's.

    Texts are those of find(), null ones empty. Each row stands for itself, so rows that repeat get equal texts."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    kind = lambda x, at: F.when(x["start"] < at, F.lit("")).otherwise(F.concat(F.lit("["), F.get(names, x["rank"]), F.lit("]")))
    cut = found.withColumn("pieces", F.when(F.size("spans") > 0, _pieces(F.col("text"))))
    return cut.withColumn("redacted", F.when(F.size("spans") == 0, F.col("text")).otherwise(_replaced("pieces", "spans", kind, F.length("text")))).drop("pieces")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
