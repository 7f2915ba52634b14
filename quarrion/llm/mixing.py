"""Temperature mixing of sources, in DataFrame functions only.

Source token shares p are exponentiated, q = p**a / sum p**a. The exponent a is bisected: down to the
least one that keeps every source within a repetition limit, or to the one whose entropy meets a target. The weights
are then realised within a token budget by block permutations: a source's documents lie in blocks dealt by hash, each
epoch passes the blocks in an order of its own, and the last epoch stops where the source's tokens are used up: whole
blocks first, single documents inside the block that the end falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidied, written

#: Blocks of a source; windows only ever see the blocks of a source or the documents of one block.
BLOCKS = 1024
#: Halvings of the exponent's interval [0, 1].
HALVINGS = 50
REPETITION_LIMIT = 1.5


def word_count(text: Column) -> Column:
    """Words `[^ \\x09-\\x0D]+` of a text."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[ \x09-\x0D]+"))).cast("long")


def _powered(tokens: Column, total: Column, exponent: Column) -> Column:
    """Normalised weights of all sources for an exponent; sources without tokens weigh nothing."""
    raw = F.transform(tokens, lambda t: F.when(t > 0, F.pow(t / total, exponent)).otherwise(F.lit(0.0)))
    norm = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / norm)


def _entropy(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))


def _repetition(q: Column, tokens: Column) -> Column:
    """Most epochs of any source if the source that repeats least gets one: max(q / t) / min(q / t)."""
    rate = F.filter(F.zip_with(q, tokens, lambda x, t: F.when(t > 0, x / t)), lambda x: x.isNotNull())
    return F.array_max(rate) / F.array_min(rate)


def source_weights(sized: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, quota): one row a source of sized (source, n_tokens).

    Give a repetition limit (at least 1) or a target entropy in nats (one out of reach gives the nearest that a in [0, 1]
    reaches). Without a budget each source is passed once at least, none of its documents lost.
    A null source is a source of its own; sources without tokens get weight and quota 0.
    """
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    sums = sized.groupBy("source").agg(F.sum("n_tokens").cast("long").alias("tokens"))
    # one row for all sources: their number is a property of the collection, not of its size
    one = sums.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"), F.sum("tokens").cast("double").alias("total"))
    tokens = F.transform("s", lambda x: x["tokens"].cast("double"))

    def too_low(a: Column) -> Column:
        q = _powered(tokens, F.col("total"), a)
        return _repetition(q, tokens) > F.lit(float(repetition_limit)) if repetition_limit is not None else _entropy(q) > F.lit(float(target_entropy))

    half = lambda acc: (acc["lo"] + acc["hi"]) / 2
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    step = lambda acc, _: F.when(too_low(half(acc)), F.struct(half(acc).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), half(acc).alias("hi")))
    one = one.withColumn("exponent", F.when(too_low(F.lit(0.0)), F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step)["hi"]).otherwise(F.lit(0.0)))
    one = one.withColumn("q", _powered(tokens, F.col("total"), F.col("exponent")))
    if budget is None:
        rates = F.filter(F.zip_with("q", tokens, lambda x, t: F.when(t > 0, t / x)), lambda x: x.isNotNull())
        one = one.withColumn("budget", F.array_max(rates))
    else:
        one = one.withColumn("budget", F.lit(float(budget)))
    out = one.select("exponent", "budget", F.explode(F.arrays_zip("s", "q")).alias("x"))
    return out.select("x.s.source", "x.s.tokens", "exponent", F.col("x.q").alias("weight"), F.round(F.col("x.q") * F.col("budget")).cast("long").alias("quota"))


def _order(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


@tidied
def mixed(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: int | None = None, seed: int = 17, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, n_tokens, weight, block, copies): row holds all columns of docs, copies is how often the mixture has the row.

    A source whose quota is 2.3 times its tokens passes all blocks twice, then the first 0.3 of them in the third
    epoch's order. The document at which a quota ends is still taken whole if at least half of it fits. Documents without
    words weigh nothing; they come as often as their block. Null texts have no words. Rows that repeat are dealt alike.
    """
    seeded = F.lit(seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.col(source_col).alias("_s"), F.xxhash64(seeded, F.col(id_col), F.col(text_col)).alias("_h"))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(blocks)).cast("int"))
    sizes = written(rows.groupBy("_s", "_b").agg(F.sum(word_count(F.col("_t"))).alias("t")), "sizes")
    weights = source_weights(sizes.select(F.col("_s").alias("source"), F.col("t").alias("n_tokens")), repetition_limit, target_entropy, budget)
    weights = weights.select(F.col("source").alias("_w"), "tokens", "weight", "quota", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long").alias("epochs"))
    plan = sizes.join(weights, F.col("_s").eqNullSafe(F.col("_w"))).drop("_w")
    passing = Window.partitionBy("_s").orderBy(F.xxhash64(seeded, "epochs", "_b"), "_b").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("quota") - F.col("epochs") * F.col("tokens") - F.coalesce(F.sum("t").over(passing), F.lit(0))
    # room: tokens that the last epoch takes from this block on
    plan = plan.withColumn("room", room).withColumn("whole", (F.col("room") > 0) & (F.col("room") >= F.col("t"))).withColumn("cut", (F.col("room") > 0) & (F.col("room") < F.col("t")))
    plan = written(plan.select(F.col("_s").alias("_ps"), F.col("_b").alias("_pb"), "weight", "epochs", "whole", "cut", "room"), "plan")

    order = F.struct(F.xxhash64(seeded, "epochs", "_h").alias("o"), F.col("_h").alias("h"))
    here = F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb"))
    inside = rows.select("_s", "_b", "_h", "_t").join(_small(plan.where("cut")), here)
    inside = inside.select("_ps", "_pb", "room", order.alias("_o"), word_count(F.col("_t")).alias("n"))
    # repeated rows share a hash and are taken or left together
    inside = inside.groupBy("_ps", "_pb", "room", "_o").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_ps", "_pb").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1))
    taken = inside.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("n") / 2 <= F.col("room"))
    last = taken.groupBy(F.col("_ps").alias("_ls"), F.col("_pb").alias("_lb")).agg(F.max("_o").alias("last"))
    plan = written(plan.join(last, F.col("_ps").eqNullSafe(F.col("_ls")) & (F.col("_pb") == F.col("_lb")), "left").drop("_ls", "_lb", "room"), "final")

    out = rows.join(_small(plan), here)
    more = F.col("whole") | (F.col("cut") & F.coalesce(order <= F.col("last"), F.lit(False)))
    copies = (F.col("epochs") + F.when(more, 1).otherwise(0)).cast("long")
    return out.select("row", word_count(F.col("_t")).alias("n_tokens"), "weight", F.col("_b").alias("block"), copies.alias("copies"))


#: Rows of a plan that may be broadcast, about 100 bytes each: 1,000 sources. A longer plan is joined by shuffle.
BROADCAST_ROWS = BLOCKS * 1000


def _small(plan: DataFrame) -> DataFrame:
    """plan is a written table: counting it reads only its footers."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan


def realised(mix: DataFrame) -> DataFrame:
    """The rows of mixed(), in their own columns, each as often as its copies say; null texts and sources and repeated rows pass like others."""
    return mix.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("row.doc_id", "row.source", "n_tokens", "weight", "block", "copies")
