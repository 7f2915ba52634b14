"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are hashes of its distinct word shingles. All documents order tokens alike: rare ones
first, then frequent ones, each by hash. If two sets are similar enough, a set misses at most `slack` of its tokens in the
other, so prefixes of slack + EXTRA tokens share EXTRA of them. Rare tokens are indexed singly; frequent ones only as
combinations of two, which a pair that shares no rare token must have in common. Candidates that share fewer tokens than
their prefixes demand are dropped, the others verified on their whole sets.

Copies first: documents whose least tokens agree are compared with the smallest id among them and joined at once.
A token that only one such group has needs no comparison, so groups of thousands are never compared pair by pair,
and candidates between groups already known to be linked are skipped. What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, chunks, discard, id_text, joined_by_key, mix, rolling, table, tidied, words_of, written
from .components import components

#: Prefixes are so much longer than the least length; the number of tokens that candidates must share.
EXTRA = 8
#: Least tokens by which groups of copies are found, and how many must agree with the group's first document.
LOW, LOW_AGREE = 8, 3
#: Groups that hold a token for it to count as frequent; raised where more than MAX_FREQUENT tokens would.
FREQUENT = 128
MAX_FREQUENT = 1 << 20
#: Bits of bitmaps, as powers of 2: 16 for each entry within these bounds (32 MB at most). False hits cost time only.
MIN_BITS, MAX_BITS = 16, 28
#: Documents in a block of a unit of verification.
UNIT = 64
_U = np.uint64


class Rule:
    """Sets of shingles of `size` words that link at percent * union <= 100 * intersection."""

    def __init__(self, size: int = 4, percent: int = 85):
        self.size, self.percent = size, percent

    def slack(self, n):
        """Tokens of a set of n that a linked set may lack."""
        return n - (n * self.percent + 99) // 100

    def prefix(self, n):
        return np.minimum(n, self.slack(n) + EXTRA)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(text, its sorted tokens) of the texts in a chunk."""
        w = words_of(data, offsets, SPACES, LOWER)
        grams = rolling(w.hash, self.size)
        for i in range(len(offsets) - 1):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= self.size:
                s = np.sort(grams[a : b - self.size + 1])
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                yield i, s[keep]
            elif b > a:
                yield i, mix(rolling(w.hash[a:b], b - a) + _U(b - a))
            else:
                yield i, np.empty(0, np.uint64)


def _each(docs: DataFrame, schema: str, of: Callable) -> DataFrame:
    """Runs of(ids, sets) -> columns or None on the chunks of docs; ids and sets are those of the chunk's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, stop, data, offsets in chunks(batch.column(1)):
                out = of(ids.slice(row, stop - row), data, offsets)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def summaries(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, k1, k2, low): set size, two hashes of the whole set, its LOW least tokens."""

    def of(ids, data, offsets):
        n, keys, low = [], [], []
        with np.errstate(over="ignore"):
            for _, s in rule.sets(data, offsets):
                n.append(len(s))
                keys.append((mix(s).sum(dtype=np.uint64), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                low.append(s[:LOW].view(np.int64))
        k = np.array(keys, np.uint64).reshape(-1, 2)
        return [ids, pa.array(n, pa.int64()), _signed(k[:, 0].copy()), _signed(k[:, 1].copy()), pa.array(low, pa.list_(pa.int64()))]

    return _each(docs, "doc_id long, n long, k1 long, k2 long, low array<long>", of)


class Bitmap:
    """A set of 64-bit values as bits of bounded number; may claim values that it doesn't hold."""

    def __init__(self, values: DataFrame, column: str):
        self.power = min(MAX_BITS, max(MIN_BITS, (16 * values.count()).bit_length()))
        mixed = F.shiftrightunsigned(F.xxhash64(column), 64 - self.power)
        marks = values.select((mixed + 1).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
        bits = np.zeros(1 << (self.power - 3), np.uint8)
        for r in marks.toLocalIterator():
            at = bits[(r["b"] - 1) * 4096 : r["b"] * 4096]
            at[:] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(at)]
        self.shared = values.sparkSession.sparkContext.broadcast(bits)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = (_xxhash64(values) >> _U(64 - self.power)).astype(np.int64)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _xxhash64(values: np.ndarray) -> np.ndarray:
    """The xxhash64 function of Spark SQL (seed 42) for bigint values."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        x = values.view(np.uint64)
        h = _U(42) + p5 + _U(8)
        h = h ^ (_rotl(x * p2, 31) * p1)
        h = _rotl(h, 27) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        return h ^ (h >> _U(32))


def _ids(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False).astype(np.int64)


def _units(pairs: DataFrame, star: bool) -> DataFrame:
    """(u, a, b): pairs in units of about UNIT * UNIT pairs of 2 * UNIT documents at most, so that each set is sent
    once a unit and not once a pair. Pairs of one family (around the same b, or else linked by pairs) share units."""
    block = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.ceil(F.col(n) / UNIT)))
    if star:
        sizes = pairs.groupBy("b").agg(F.count("*").alias("n"))
        return pairs.join(sizes, "b").select(F.xxhash64("b", block("a", "n")).alias("u"), "a", "b")
    family = components(pairs)
    sizes = family.groupBy("component").agg(F.count("*").alias("n"))
    both = pairs.join(family.withColumnRenamed("id", "a"), "a").join(sizes, "component").withColumn("x", block("a", "n")).withColumn("y", block("b", "n"))
    return both.select(F.xxhash64("component", F.least("x", "y"), F.greatest("x", "y")).alias("u"), "a", "b")


def verified(docs: DataFrame, pairs: DataFrame, rule: Rule, star: bool) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. pairs: a written table."""
    units = written(_units(pairs, star), "units")
    need = units.select("u", F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = Bitmap(written(need.select("id").distinct(), "wanted"), "id")

    def of(ids, data, offsets):
        ids = _ids(ids)
        held = wanted.holds(ids)
        if not held.any():
            return None
        found = [(ids[i], s.tobytes()) for i, s in rule.sets(data, offsets) if held[i] and len(s)]
        return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())]

    sets = need.join(_each(docs, "id long, tokens binary", of), "id").select(F.col("u").alias("unit"), "id", "tokens")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[int, list[np.ndarray]] = {}
        for i, raw in zip(right.column("id").to_pylist(), right.column("tokens").to_pylist(), strict=True):
            known.setdefault(i, []).append(np.frombuffer(raw, np.uint64))

        def links(x: np.ndarray, y: np.ndarray) -> bool:
            if 100 * min(len(x), len(y)) < rule.percent * max(len(x), len(y)):
                return False
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # merges two runs
            same = int((both[1:] == both[:-1]).sum())
            return 100 * same >= rule.percent * (len(both) - same)

        keep = [any(links(x, y) for x in known.get(a, ()) for y in known.get(b, ())) for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)]
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return units.groupBy("u").cogroup(sets.groupBy("unit")).applyInArrow(check, "a long, b long")


def _near_sizes(a: Column, b: Column, rule: Rule) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent


def copies(docs: DataFrame, summary: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) inside groups of copies: each document with the smallest id among those that agree with it."""
    full = summary.where("n > 0")
    equal = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("b"), F.count("*").alias("c")).where("c > 1")
    same = joined_by_key(full.select("doc_id", "k1", "k2", "n"), written(equal, "equal"), ["k1", "k2", "n"], "doc_id")
    same = same.where("doc_id > b").select(F.col("doc_id").alias("a"), "b")
    low = full.select("doc_id", "n", F.explode("low").alias("t"))
    first = low.groupBy("t").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.count("*").alias("c")).where("c > 1").select("t", F.col("f.doc_id").alias("b"), F.col("f.n").alias("m"), "c")
    agree = joined_by_key(low, written(first, "first"), ["t"], "doc_id").where((F.col("doc_id") > F.col("b")) & _near_sizes(F.col("n"), F.col("m"), rule))
    pairs = agree.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("c")).where(F.col("c") >= LOW_AGREE).select("a", "b")
    pairs = written(pairs.join(same, ["a", "b"], "left_anti"), "pairs")
    return same.unionByName(verified(docs, pairs, rule, star=True))


def _often(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    return common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), bool)


def _rare_prefix(s: np.ndarray, p: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rare, frequent) tokens of the prefix of length p of a set in the common order."""
    if not _often(s[:p], common).any():
        return s[:p], s[:0]
    often = _often(s, common)
    rare, late = s[~often], s[often]
    return rare[:p], late[: max(0, p - len(rare))]


def frequent_tokens(docs: DataFrame, inner: DataFrame, rule: Rule) -> tuple[np.ndarray, list[Bitmap]]:
    """(sorted tokens that many groups hold, bitmaps of the rare tokens that prefixes may share).

    inner: (id) of documents that are not their group's first.
    """
    others = Bitmap(inner, "id")

    def of(ids, data, offsets):
        first = ~others.holds(_ids(ids))
        tokens, root = [], []
        for i, s in rule.sets(data, offsets):
            if len(s):
                p = int(rule.prefix(len(s)))
                tokens.append(s[:p])
                root.append(np.full(p, first[i]))
        return [_signed(np.concatenate(tokens)), pa.array(np.concatenate(root).astype(np.int32))] if tokens else None

    counts = _each(docs, "t long, root int", of).groupBy("t").agg(F.count("*").alias("c"), F.sum("root").alias("roots")).where("c > 1")
    counts = written(counts, "counts")
    least = FREQUENT
    while counts.where(F.col("roots") >= least).count() > MAX_FREQUENT:
        least *= 2
    found = np.sort(np.array([r["t"] for r in counts.where(F.col("roots") >= least).select("t").toLocalIterator()], np.int64).view(np.uint64))
    shared = Bitmap(counts, "t")
    discard(counts)
    if not len(found):
        return found, [shared]
    # prefixes that hold frequent tokens reach further among the others, which were not counted above
    roots = others

    def behind(ids, data, offsets):
        """Tokens that such a prefix may reach: some for each of its frequent ones."""
        first = ~roots.holds(_ids(ids))
        tokens, root = [], []
        for i, s in rule.sets(data, offsets):
            p = int(rule.prefix(len(s)))
            f = int(_often(s[:p], known.value).sum())
            if f and p < len(s):
                tokens.append(s[p : p + 4 * f + EXTRA])
                root.append(np.full(len(tokens[-1]), first[i]))
        return [_signed(np.concatenate(tokens)), pa.array(np.concatenate(root).astype(np.int32))] if tokens else None

    known = docs.sparkSession.sparkContext.broadcast(found)
    counted = _each(docs, "t long, root int", behind).groupBy("t").agg(F.sum("root").alias("roots"))
    more = counted.where(F.col("roots") >= least).select("t").orderBy(F.xxhash64("t")).limit(MAX_FREQUENT)
    found = np.union1d(found, np.array([r["t"] for r in more.collect()], np.int64).view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast(found)

    def further(ids, data, offsets):
        tokens = []
        for _, s in rule.sets(data, offsets):
            p = int(rule.prefix(len(s)))
            rare, _ = _rare_prefix(s, p, known.value)
            if len(rare) and rare[-1] > s[p - 1]:
                tokens.append(rare[rare > s[p - 1]])
        return [_signed(np.concatenate(tokens))] if tokens else None

    extended = written(_each(docs, "t long", further).distinct(), "extended")
    reached = Bitmap(extended, "t")
    discard(extended)
    return found, [shared, reached]


def signatures(docs: DataFrame, frequent: np.ndarray, shared: list[Bitmap], rule: Rule) -> DataFrame:
    """(sig, pair, doc_id, n, f): rare tokens (pair 0) and combinations of two frequent ones (pair 1) of each prefix;
    f: frequent tokens in the prefix. Rare tokens that no other prefix holds are left out."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def of(ids, data, offsets):
        ids, common = _ids(ids), known.value
        sigs, pair, owner, size, many = [], [], [], [], []
        for i, s in rule.sets(data, offsets):
            n = len(s)
            if not n:
                continue
            p = int(rule.prefix(n))
            single, late = _rare_prefix(s, p, common)
            values = single.view(np.int64)
            single = single[np.logical_or.reduce([x.holds(values) for x in shared])]
            f, combined = len(late), np.empty(0, np.uint64)
            if f >= min(EXTRA, n - rule.slack(n)):  # fewer cannot be all that a pair must share
                x, y = np.triu_indices(f, 1)
                with np.errstate(over="ignore"):
                    combined = mix(late[x] * _U(0x9E3779B97F4A7C15) + late[y])
            m = len(single) + len(combined)
            sigs += [single, combined]
            pair += [np.zeros(len(single), np.int32), np.ones(len(combined), np.int32)]
            owner.append(np.full(m, ids[i]))
            size.append(np.full(m, n))
            many.append(np.full(m, f))
        if not sigs:
            return None
        return [_signed(np.concatenate(sigs)), pa.array(np.concatenate(pair)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(size)), pa.array(np.concatenate(many))]

    return _each(docs, "sig long, pair int, doc_id long, n long, f long", of)


def _sure(a: str, b: str, rule: Rule) -> Column:
    """Tokens that linked sets of these sizes share in their prefixes, at least.

    The prefix that ends first holds all shared tokens up to its end, and behind it at most the rest of its set is
    shared: needed - rest.
    """
    needed = F.ceil((F.col(a) + F.col(b)) * rule.percent / (100 + rule.percent))
    rest = lambda n: F.greatest(F.lit(0), F.ceil(F.col(n) * rule.percent / 100) - EXTRA)
    return F.greatest(F.lit(1), needed - F.greatest(rest(a), rest(b)))


def candidates(sigs: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of different groups that share what linked documents must share."""
    inside = sigs.join(groups.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id")).drop("component")
    inside = written(inside, "signatures")
    mixed = inside.groupBy("sig", "pair").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("sig", "pair")
    live = written(inside.join(mixed, ["sig", "pair"]), "live")
    discard(inside)
    x, y = live.alias("x"), live.alias("y")
    meet = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.pair") == F.col("y.pair")) & (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.g") != F.col("y.g")) & _near_sizes(F.col("x.n"), F.col("y.n"), rule)
    # combinations matter only to pairs whose frequent tokens may be all that they share
    meet = meet & ((F.col("x.pair") == 0) | (F.least("x.f", "y.f") >= _sure("x.n", "y.n", rule)))
    met = x.join(y, meet).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.pair").alias("pair"), F.least("x.f", "y.f").alias("f"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    counted = met.groupBy("a", "b").agg(F.sum(1 - F.col("pair")).alias("rare"), F.sum("pair").alias("combined"), F.max("f").alias("f"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    # s shared frequent tokens make s * (s - 1) / 2 shared combinations; where those were not compared, f at most are shared
    sure = _sure("na", "nb", rule)
    often = F.when(F.col("combined") > 0, F.round((1 + F.sqrt(1 + 8 * F.col("combined"))) / 2)).when(F.col("f") >= sure, F.least(F.lit(1), F.col("f"))).otherwise(F.col("f"))
    return counted.where(F.col("rare") + often >= sure).select("a", "b")


@tidied
def joined(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs.

    Words are runs of other characters than white space, A-Z folded. A text with fewer words than a shingle is one shingle;
    null texts and texts without words have none and link with nothing. component_id is the smallest id
    reachable over links, exactly. Rows with the same id are one document for links; a null id links with
    nothing and has a null component.
    """
    rule = Rule(size, percent)
    given = id_text(docs, id_col, text_col)
    summary = written(summaries(given, rule), "summaries")
    linkable = given.where("doc_id is not null")
    close = written(copies(linkable, summary.where("doc_id is not null"), rule), "copies")
    groups = written(components(close), "groups")
    frequent, shared = frequent_tokens(linkable, groups.where("id <> component").select("id"), rule)
    pairs = written(candidates(signatures(linkable, frequent, shared, rule), groups, rule), "candidates")
    more = verified(linkable, pairs, rule, star=False)
    whole = components(close.unionByName(more))
    out = summary.select("doc_id", F.col("n").alias("n_shingles")).join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = w.doc_id
"""
