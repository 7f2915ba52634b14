"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import hashlib
import html
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion.llm import components, html_text, importance, jaccard_join, mixing, order_minhash, pii, quality_rules, sentencepiece_codec, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, an empty, a null and a long one."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(n)]
    passage = prose(rng, 70)
    for i in range(0, n, 7):
        texts[i] = f"{texts[i]} {passage} {prose(rng, 20)}"
    for i in range(5, n, 6):
        words = texts[i - 1].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "edited"
        texts[i] = " ".join(words)
    texts[3] = texts[2]
    texts[8], texts[9] = "", None
    texts.append(prose(rng, 5000))
    texts.append("x" * 100_000)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """With columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n bigint, row string, score double")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return docs.limit(0)


# --- 1 -----------------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, expression) in enumerate(pii.KINDS.items()):
        for m in re.finditer(expression, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_pii_base_is_exact(spark):
    rng = random.Random(1)
    pieces = ["a@b.c", "x.y%+z@q-r.co.uk", "..u@v.ww", "@", "é", "🙂", "1.2.3.4", "300.1.1.1", "001.002.003.004.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890", "+1 (555) 555-2485", "+1 22", "+49.30.1234567", "\n", " ", "-", ".", "0", "7"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["", None, "a@" * 500, "9" * 5000, "1." * 3000, "x@y.z" * 50]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "base").collect()
    assert len(found) == len(texts)
    for r in found:
        assert [(x["start"], x["rank"], x["end"]) for x in r["base"]] == brute_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def test_pii_patterns_discover(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, 8)} contact mail: u{i}@site{i}.org thanks {prose(rng, 5)}" for i in range(30)]
    texts += [f"{prose(rng, 6)} contact mail: hidden{i}(at)host thanks {prose(rng, 6)} room 12{i} free" for i in range(3)]
    texts = [t.replace("(at)", "@") if i >= 30 else t for i, t in enumerate(texts)]  # no dot behind the @: no expression matches
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(30, 33):
        assert not found[i]["base"]
        assert [texts[i][x["start"] : x["end"]] for x in found[i]["spans"]] == [f"hidden{i - 30}@host"]
    red = pii.redact(pii.find(spark.createDataFrame([(1, "🙂 a@b.c and 1.2.3.4."), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r["redacted"] for r in red] == ["🙂 [EMAIL] and [IP].", ""]


def test_pii_patterns_discover_several_words(spark):
    rng = random.Random(6)
    texts = [f"{prose(rng, 8)} contact mail: u{i}@site{i}.org thanks {prose(rng, 5)}" for i in range(40)]
    texts += [f"{prose(rng, 8)} call phone: +1 555 20{i:02} 4567 today {prose(rng, 5)}" for i in range(40)]
    hidden = ["phone: 555 123 4567", "phone: (555) 123-4568", "phone: 555.123 4569", "mail: jane at example dot com", "mail: jane(at)host", "mail: jim [at] host.org"]
    n = len(texts)
    # room numbers and prose with "at" in it are candidates, but no pattern vouches for them
    texts += [f"w1 look at the room 12 34 56 78 w2 {'call' if 'phone' in h else 'contact'} {h} {'today' if 'phone' in h else 'thanks'} w3" for h in hidden] + ["9.8.7.6 call phone: 555 123 4570 today"]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, h in enumerate(hidden, n):
        assert [texts[i][x["start"] : x["end"]] for x in found[i]["spans"]] == [h.split(": ")[1]]
    assert [texts[-1][x["start"] : x["end"]] for x in found[len(texts) - 1]["spans"]] == ["9.8.7.6", "555 123 4570"]


def test_pii_redact_overlaps(spark):
    texts = ["a 4111 1111 1111 1111@host.com b", "a 1.2.3.4111 1111 1111 1111 b x@y.z", "plain"]
    spans = [[(2, 2, 21, "card"), (17, 0, 30, "email")], [(2, 1, 12, "ip"), (8, 2, 27, "card"), (10, 2, 12, "card"), (30, 0, 35, "email")], []]
    rows = spark.createDataFrame(list(zip(range(3), texts, spans)), f"doc_id long, text string, spans {pii._ARRAY}")
    assert [r["redacted"] for r in pii.redact(rows).orderBy("doc_id").collect()] == ["a [CARD] b", "a [IP] b [EMAIL]", "plain"]


def test_pii_repeated_and_none(spark, nothing):
    assert pii.find(nothing).count() == 0
    two = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "d@e.f"), (2, None)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in pii.find(two).collect()) == [0, 1, 1, 1]


def test_pii_graph_scores_against_brute_force(spark):
    """Rounds of the graph of patterns and values, with dictionaries."""
    rng = random.Random(4)
    kinds = list(pii.KINDS)
    values = {f"v{i}": rng.choice([None, None, *kinds]) for i in range(120)}
    edges = {(f"p{rng.randrange(12)}", v) for v in values for _ in range(3)} | {("p0", f"v{i}") for i in range(60)}
    for rounds in (1, 2, 4):
        linked = {p: [v for q, v in edges if q == p] for p, _ in edges}
        seeds = {(p, k): n for p, vs in linked.items() for k in kinds if (n := sum(values[v] == k for v in vs)) >= 3}
        confidence, belief = {}, {}
        for _ in range(rounds):
            confidence = {(p, k): (n + sum(belief.get((v, k), 0) for v in linked[p] if values[v] is None)) / (len(linked[p]) + 1) for (p, k), n in seeds.items()}
            belief = {(v, k): 1 - math.prod(1 - min(confidence[p, k], 0.999999) for p in linked if (p, k) in seeds and v in linked[p]) for v in values for k in kinds if values[v] is None and any((p, k) in seeds and v in linked[p] for p in linked)}
        frame_of = spark.createDataFrame([(p, v, values[v]) for p, v in edges], "pattern string, value string, seed string")
        patterns, found = pii.score_graph(frame_of, rounds, 3)
        assert {(r["pattern"], r["kind"]): r["confidence"] for r in patterns.collect()} == pytest.approx(confidence)
        assert {(r["value"], r["kind"]): r["belief"] for r in found.collect()} == pytest.approx(belief)


def test_pii_discovery_against_brute_force(spark):
    """Which candidate occurrences become spans: those beside a confident pattern, of a believed value that has the kind's shape."""
    rng = random.Random(12)
    texts = []
    for i in range(60):
        context = rng.choice(["ring me on", "phone number", "see room", "the year"])
        value = {"ring me on": f"+1 55 5{rng.randrange(100):02} {1000 + i}", "phone number": rng.choice([f"+49 30 {100000 + i}", f"55{rng.randrange(10)} {1000 + i} 77"]), "see room": str(rng.randrange(300)), "the year": "19 44 12 10"}[context]
        texts.append(f"{prose(rng, 4)} {context} {value} {prose(rng, 4)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    occ = [r.asDict() for r in pii.occurrences(pii.with_base(docs)).collect()]
    graph = {(p, o["value"], o["kind"]) for o in occ for p in o["patterns"]}
    patterns, values = pii.score_graph(spark.createDataFrame(list(graph), "pattern string, value string, seed string"))
    confident = {(r["pattern"], r["kind"]) for r in patterns.collect() if r["confidence"] >= 0.7}
    believed = {(r["value"], r["kind"]) for r in values.collect() if r["belief"] >= 0.7}
    want = {(o["doc_id"], o["start"], o["end"], k) for o in occ if o["kind"] is None for p in o["patterns"] for k in pii.KINDS if (p, k) in confident and (o["value"], k) in believed and re.search(pii._SHAPE[k], o["value"])}
    got = {(r["doc_id"], x["start"], x["end"], list(pii.KINDS)[x["rank"]]) for r in pii.find(docs, min_confidence=0.7).collect() for x in r["spans"] if x not in r["base"]}
    assert want and {k for *_, k in want} == {"phone"} and got <= want
    # what is missing lies inside a longer span
    assert all(any(d == g[0] and g[1] <= a and b <= g[2] and k == g[3] for g in got) for d, a, b, k in want)


def test_clashing_columns_and_repeats(spark, docs, rows):
    """Columns with the names that operators use inside, rows that come twice: as without them."""
    plain = docs.select("doc_id", "text")
    names = ("row", "base", "spans", "extra", "words", "lines", "n_words", "kept", "ids", "decoded", "score", "t", "label", "n", "_d", "_t", "source", "block", "copies")
    wide = plain
    for c in names:
        wide = wide.withColumn(c, F.lit(f"clash {c}"))
    twice = wide.union(wide)
    for of in (
        lambda d: pii.find(d).select("doc_id", F.to_json("spans").alias("x")),
        lambda d: quality_rules.judge(d),
        lambda d: sentencepiece_codec.encode_digests(d),
        lambda d: importance.log_weights(importance.marked(importance.id_text(d), spark.createDataFrame([(0,)], "doc_id long")), importance.Models(np.full(50, 1e9), np.full(50, 1e8))),
        lambda d: mixing.mixed(d.withColumn("source", F.lit("s")), budget=10**6).select("row.doc_id", "n_tokens", "block"),
        lambda d: order_minhash.fingerprints(d),
    ):
        want = sorted(map(tuple, of(plain).collect()), key=str)
        assert sorted(map(tuple, of(wide).collect()), key=str) == want
        assert sorted(map(tuple, of(twice).collect()), key=str) == sorted(want + want, key=str)


def test_mixing_very_long(spark):
    """One document with most of its source's words, another source of short ones: whole documents, none lost."""
    rows = [(0, "w " * 300_000, "a"), (1, "w", "a"), (2, "x y", "b"), (3, None, "b"), (4, "x" * 500_000, "b")]
    mix = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), repetition_limit=2.0)
    found = {r["row"]["doc_id"]: r for r in mix.collect()}
    assert {i: r["n_tokens"] for i, r in found.items()} == {0: 300_000, 1: 1, 2: 2, 3: 0, 4: 1}
    assert found[0]["copies"] == found[1]["copies"] == 1 and {found[i]["copies"] for i in (2, 3, 4)} <= {1, 2}


# --- 2 -----------------------------------------------------------------------------------------------------------------


def test_order_minhash(spark, rows, docs, nothing):
    found = order_minhash.edit_probe(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k] if k else t
        r = by[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == order_minhash.signature(t).astype(">u4").tobytes().hex()
        assert r["edited_fingerprint"] == order_minhash.signature(edited).astype(">u4").tobytes().hex()
        assert r["near_next"] == order_minhash.likeness(order_minhash.signature(t), order_minhash.signature(nxt))
    long = [r for r in found if r["n_chars"] > 300 and r["n_chars"] < 50_000]
    # two thirds in common: half of all k-mers, and so a quarter of the pairs
    assert 0.15 < np.mean([r["near_edited"] for r in long]) < 0.35
    assert np.median([r["near_next"] for r in long]) < 0.05
    assert order_minhash.edit_probe(nothing).count() == 0
    one = order_minhash.edit_probe(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "abc def"), (1, "b"), (1, "a"), (-(1 << 63), "z"), ((1 << 63) - 1, "y")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in order_minhash.edit_probe(odd).collect()) == [(False, 1)] * 4 + [(True, 7)]


def test_signature_brute():
    def slow(text, rows):
        seen, numbered = {}, []
        base = order_minhash.numbered_kmers(text)
        kmers = [text[i : i + order_minhash.K] for i in range(max(1, len(text) - order_minhash.K + 1))]
        for k in kmers:
            seen[k] = seen.get(k, 0) + 1
            numbered.append((k, seen[k]))
        assert len(set(numbered)) == len(set(base.tolist())) == len(base)
        out = []
        for j in range(rows):
            h = [((int(x) ^ int(order_minhash._XOR[j])) * int(order_minhash._ODD[j])) % (1 << 64) for x in base]
            place = sorted(sorted(range(len(h)), key=lambda i: (h[i], i))[: order_minhash.PICK])
            out.append(tuple(numbered[p] for p in place))
        return out

    a, b = "abcabcabcabcabc hello world abcabc", "abcabcabcabcabc hello brave world abcabc"
    same = [x == y for x, y in zip(slow(a, 32), slow(b, 32), strict=True)]
    assert (order_minhash.signature(a) == order_minhash.signature(b)).tolist() == same
    assert not order_minhash.signature("").any()


# --- 3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 7, 50])
def test_substring_dedup(rows, docs, nothing, width):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    found = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs, width).collect()}
    assert len(found) == len(rows)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        assert found[i]["n_words"] == len(w)
        assert found[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert {k for s in found[i]["removed"] for k in range(s["begin"], s["end"])} == gone
    if width == 50:
        assert substring_dedup.dedup_substrings(nothing, width).count() == 0


def test_substring_dedup_repeated_ids(spark):
    t = " ".join(f"a{i}" for i in range(60))
    found = substring_dedup.dedup_substrings(spark.createDataFrame([(5, t), (5, t), (7, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 99, len(r["removed"])) for r in found) == [(5, 0), (5, 0), (7, 1), (99, 1)]


# --- 4 -----------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, rows, docs, nothing):
    extra = [(9001, "the cat sat on the mat\n" * 30), (9002, "a b a b a b"), (9003, " \n\t \n"), (9004, "x\n\ny\nx\n x\nx"), (9005, "# * $ %\r\n&|<>")]
    found = {r["doc_id"]: r for r in quality_rules.judge(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    for i, t in rows + extra:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(3)}
        r = found[i]
        expected = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(nothing).count() == 0
    fine = " ".join(f"the word{i} of thing{i} and w{i}" for i in range(40))
    assert quality_rules.judge(spark.createDataFrame([(1, fine), (2, fine.replace("w", "#%"))], "doc_id long, text string")).orderBy("doc_id").select("kept").collect() == [(True,), (False,)]


# --- 5 -----------------------------------------------------------------------------------------------------------------


def toxic_rows(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(VOCABULARY) for _ in range(60)]
        if bad:
            for w in rng.sample(["zork", "blarg", "fnord", "grunk"], 3):
                words.insert(rng.randrange(60), w)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark, nothing):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, label int")
    index = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    held = [(found[i]["score"], y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(e["label"] == 1 for i, _, y in rows if y for e in found[i]["evidence"][:1])
    q = np.array([[0.0] * len(index.terms), *np.random.default_rng(2).random((20, len(index.terms)))], np.float32)
    place, cosine = index.nearest(q, 7)
    exact = q @ index.rows.T
    for a, p, c in zip(exact, place, cosine, strict=True):
        want = sorted((-v, j) for j, v in enumerate(a) if v > 0)[:7]
        assert np.allclose([-v for v, _ in want], c[c > 0], atol=1e-5) and len(want) == (p >= 0).sum()
    assert toxicity.score(nothing, index).count() == 0
    odd = toxicity.score(spark.createDataFrame([(1, None), (1, ""), (2, "x" * 10_000)], "doc_id long, text string"), index).collect()
    assert all(math.isclose(r["score"], index.prior) for r in odd)
    assert toxicity.fit(docs, labels.limit(0)).prior == 0.0
    assert {r["score"] for r in toxicity.score(docs.limit(3), toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_rare_terms(spark):
    """Every example stays in the index, and a text of words that no other example has finds its copy."""
    rows = [*toxic_rows(), (1000, "qqa qqb qqc qqd qqe", 1), (1001, "zza zzb zzc zzd zze", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"))
    assert sorted(index.ids) == sorted(i for i, _, _ in rows)
    found = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame([(1, rows[-2][1]), (2, rows[-1][1])], "doc_id long, text string"), index).collect()}
    for k, (i, _, y) in ((1, rows[-2]), (2, rows[-1])):
        best = found[k]["evidence"][0]
        assert (best["doc_id"], best["label"]) == (i, y) and math.isclose(best["cosine"], 1, abs_tol=1e-5)
    assert found[1]["score"] > index.prior > found[2]["score"]


def test_toxicity_against_brute_force(spark):
    """Document counts, term weights, cosines, votes and scores from dictionaries of words; other columns may clash."""
    rng = random.Random(21)
    rows = [(i, t, y) for i, t, y in toxic_rows()] + [(2000 + i, prose(rng, rng.randint(0, 30)), int(rng.random() < 0.2)) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows], "doc_id long, text string, label string, score int")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, label int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, index, neighbours=9).collect()}
    counts = lambda t: Counter(re.findall("[A-Za-z\u0080-\U0010ffff]+", t.lower()))
    bags = {i: counts(t) for i, t, _ in rows}
    train = {i: y for i, _, y in rows if i % 3}
    n, pos = len(train), sum(train.values())
    weights = {}
    for w in {w for i in train for w in bags[i]}:
        d, a = sum(w in bags[i] for i in train), sum(w in bags[i] for i in train if train[i])
        parts = [(a, d * pos / n), (d - a, d * (n - pos) / n), (pos - a, (n - d) * pos / n), (n - pos - d + a, (n - d) * (n - pos) / n)]
        differs = 2 * sum(x * math.log(x / e) for x, e in parts if x > 0)
        weights[w] = (math.log((1 + len(rows)) / (1 + sum(w in b for b in bags.values()))) + 1) * (toxicity.SELECTIVE_WEIGHT if d >= 5 and differs > 10.8 else 1)

    def vector(bag):
        v = {w: (1 + math.log(c)) * weights[w] for w, c in bag.items() if w in weights}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors, prior = {i: vector(b) for i, b in bags.items()}, pos / n
    vote = {0: (1 - prior) / (n - pos), 1: prior / pos}
    vote = {y: v / max(vote.values()) for y, v in vote.items()}
    assert any(x > toxicity.FREQUENT for x in (sum(w in bags[i] for i in train) / n for w in weights))
    for i, v in vectors.items():
        near = sorted(((sum(x * vectors[j].get(w, 0) for w, x in v.items()), j) for j in train), reverse=True)
        near = [(c, j) for c, j in near if c > 0]
        if len(near) > 9 and near[8][0] - near[9][0] < 1e-5:
            continue  # a tie at the end of the list
        near = near[:9]
        total = sum(c * vote[train[j]] for c, j in near)
        assert got[i]["score"] == pytest.approx((sum(c * vote[1] for c, j in near if train[j]) + toxicity.PRIOR_WEIGHT * prior) / (total + toxicity.PRIOR_WEIGHT), abs=1e-4)
        assert got[i]["neighbours"] == len(near)


def test_toxicity_repeated_ids(spark):
    """Rows that repeat an id are one example, and each row is scored."""
    docs = spark.createDataFrame([(1, "foul words"), (1, "foul words"), (1, "a other text"), (2, "kind words"), (2, "kind words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, label int")
    index = toxicity.fit(docs, labels)
    assert sorted(zip(index.ids.tolist(), index.labels.tolist())) == [(1, 1), (2, 0)]
    assert toxicity.score(docs, index).count() == 5


# --- 6 -----------------------------------------------------------------------------------------------------------------


def test_importance(spark, docs, nothing):
    rng = random.Random(4)
    good = [(i, prose(rng, 80)) for i in range(200)]
    bad = [(1000 + i, " ".join(f"q{rng.randrange(50)}%%" for _ in range(80))) for i in range(40)]
    every = spark.createDataFrame(good + bad + [(5000, ""), (5001, None), (5000, "")], "doc_id long, text string")
    found = importance.resample(every, spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")).collect()
    assert all(r["kept"] for r in found if r["doc_id"] < 1000)
    assert not any(r["kept"] for r in found if 1000 <= r["doc_id"] < 5000)
    assert [r["log_weight"] for r in found if r["doc_id"] >= 5000] == [0.0, 0.0, 0.0]
    wide = every.withColumn("row", F.lit("r")).withColumn("log_weight", F.lit(1))
    kept = importance.keep_sampled(wide, spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long"))
    assert kept.columns == wide.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found if r["kept"])
    top = importance.resample(every, spark.createDataFrame([(0,)], "doc_id long"), k=10).where("kept").select("gumbel_score").collect()
    assert len(top) == 10
    assert importance.resample(nothing, spark.createDataFrame([(0,)], "doc_id long")).count() == 0
    scored = spark.createDataFrame([(float(x % 17),) for x in range(500)], "v double")
    values = sorted((float(x % 17) for x in range(500)), reverse=True)
    assert all(importance.kth_largest(scored, "v", k, bins=3) == values[k - 1] for k in (1, 30, 31, 250, 500))


def test_importance_against_brute_force(spark):
    """Counts, weights, weights of target documents without themselves, default k and the rows that stay, the slow way."""
    rng = random.Random(8)
    texts = {i: prose(rng, rng.randint(0, 60)) if i % 4 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for i in range(120)}
    target, buckets = set(range(1, 90, 2)), 50
    grams = {i: [("1", w) for w in t.split()] + [("2", *p) for p in zip(t.split(), t.split()[1:])] for i, t in texts.items()}
    place = {}
    for i, t in texts.items():
        doc, bucket = importance.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), buckets)
        assert len(doc) == len(grams[i])
        place.update(zip(grams[i], bucket.tolist()))
    raw, good = [0] * buckets, [0] * buckets
    for i, found in grams.items():
        for g in found:
            raw[place[g]] += 1
            good[place[g]] += i in target
    p_raw = [(x + 1) / (sum(raw) + buckets) for x in raw]

    def weight(i, own):
        counts = good[:]
        for g in grams[i] if own else []:
            counts[place[g]] -= 1
        return sum(math.log((counts[b] + buckets * p_raw[b]) / (sum(counts) + buckets) / p_raw[b]) for b in (place[g] for g in grams[i]))

    got = {r["doc_id"]: r for r in importance.resample(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long"), buckets=buckets, loss=0.02).collect()}
    for i in texts:
        assert got[i]["log_weight"] == pytest.approx(weight(i, False), abs=1e-9) and got[i]["n_features"] == len(grams[i])
        if i in target and grams[i]:
            assert got[i]["alone"] == pytest.approx(weight(i, True), abs=1e-9)
        else:
            assert got[i]["alone"] is None
    alone = sorted(weight(i, True) for i in target if grams[i])
    edge = alone[math.floor(0.05 * len(alone))]
    under = [edge - x for x in alone if x < edge]
    least = edge - sum(under) / len(under) * math.log(0.05 / 0.02)
    k = sum(not grams[i] or weight(i, False) >= least for i in texts)
    top = sorted(texts, key=lambda i: -got[i]["gumbel_score"])[:k]
    assert {i for i in texts if got[i]["kept"]} == set(top)


def test_kth_largest_is_exact(spark):
    """More distinct neighbouring values than any round can tell apart at first."""
    values = [1.0 + j * 2.0**-52 for j in range(3000)] + [5.0, -1e9]
    scored = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 3000, 3002):
        assert importance.kth_largest(scored, "v", k, bins=4) == ordered[k - 1]


def test_importance_batches_without_words(spark):
    """Batches of empty texts only, and of documents none of which is a target, have the columns of all others."""
    rows = [(i, "") for i in range(40)] + [(100 + i, "good words here") for i in range(10)] + [(i, None) for i in range(200, 240)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        target = spark.createDataFrame([(100,), (7,)], "doc_id long")
        assert importance.resample(docs, target).where("kept").count() == len(rows) == importance.keep_sampled(docs, target).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_importance_very_long(spark):
    rng = random.Random(1)
    long = prose(rng, 200_000)
    rows = [(0, long), (1, long), (2, prose(rng, 5)), (3, "z " * 50_000), (3, "z " * 50_000)]
    found = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0,), (1,)], "doc_id long")).collect()
    assert sorted(r["n_features"] for r in found) == [9, 99_999, 99_999, 399_999, 399_999]
    assert len({r["gumbel_score"] for r in found if r["doc_id"] == 3}) == 1


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_html_text(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; x</h1><p>One <b>two</b>\n three<p>four &lt;5&gt;<script>var a="</p>";</script></article><div id="comments"><p>me too</p></div><footer>f</footer>'
    plain = lambda k: f"<body><p>Welcome to the site</p><p>Text {k} of its own, long enough to count for much</p><p>Another line {k} of it</p><p>All rights reserved</p></body>"
    rows = [(1, "http://h.org/a/1", page), (2, "http://h.org/b/1", plain(1)), (3, "http://h.org/b/2", plain(2)), (4, "http://z.org/x", plain(3)), (5, None, plain(4)), (6, "http://e.org/", None), (7, "http://e.org/q", ""), (8, "http://d.org/1", plain(8)), (9, "http://d.org/2", plain(8))]
    found = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1)).withColumn("bucket", F.lit(2))).collect()}
    assert found[1]["text"] == "Head & x\nOne two three\nfour <5>" and found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == "Text 1 of its own, long enough to count for much\nAnother line 1 of it" and found[2]["n_deleted"] == 2
    assert found[3]["text"].startswith("Text 2") and found[3]["text"].count("\n") == 1
    assert found[4]["text"].count("\n") == 3 and found[5]["text"].count("\n") == 3  # no neighbour, no pair
    assert found[8]["text"].count("\n") == 3  # copies say nothing about the template
    assert found[6]["text"] == found[7]["text"] == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    same = spark.createDataFrame([(1, "http://h.org/a", page)] * 3, "page_id long, url string, html string")
    assert html_text.extract(same).count() == 3


def test_html_text_outside_landmarks(spark):
    """Lines outside <article> stay when they are the page's own, and go when its pair has them."""
    page = lambda k: f"<body><p>Welcome to the site</p><article><p>Teaser {k}</p><p>Read more</p></article><p>Main text {k} that stands outside of the article, longer than the rest</p></body>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in (1, 2)] + [(3, "http://z.org/3", page(3))]
    found = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (1, 2):
        assert found[k]["text"] == f"Teaser {k}\nRead more\nMain text {k} that stands outside of the article, longer than the rest" and found[k]["n_deleted"] == 1
    assert found[3]["text"].startswith("Welcome to the site\nTeaser 3") and found[3]["n_deleted"] == 0


def test_html_text_against_brute_force(spark):
    """Sites with shared furniture and no landmarks: every page against its pair, found and aligned the slow way."""
    rng = random.Random(11)
    rows, texts = [], {}
    for k in range(120):
        host, path = f"s{rng.randrange(4)}.org", f"/{rng.choice('ab')}/{rng.randrange(1000)}/{k}"
        section = path[1]
        lines = [f"Menu of {host}", f"Section {section}"] + [f"Sentence {k} {j} with words of its own" for j in range(rng.randint(3, 8))] + ([f"Offer {section}"] if rng.random() < 0.7 else []) + [f"Imprint of {host}"]
        if rng.random() < 0.15 and texts:
            lines = texts[rng.choice(list(texts))][2]
        texts[k] = (host, path, lines)
        rows.append((k, f"https://{host}{path}", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"))
    expected, pairs = {}, 0
    for host in {t[0] for t in texts.values()}:
        order = sorted((path, k) for k, (h, path, _) in texts.items() if h == host)
        for i, (path, k) in enumerate(order):
            begins = lambda o: next((n for n, (x, y) in enumerate(zip(path, o[0])) if x != y), min(len(path), len(o[0])))
            near = sorted(([order[i - 1]] if i else []) + ([order[i + 1]] if i + 1 < len(order) else []), key=lambda o: -begins(o))
            mine, gone = texts[k][2], set()
            for o in near:
                shared = {x for x in mine if x in texts[o[1]][2]}  # lines are distinct and stand in one order
                if 2 * sum(map(len, shared)) <= sum(map(len, mine)):
                    gone, pairs = shared, pairs + 1
                    break
            expected[k] = "\n".join(x for x in mine if x not in gone)
    assert pairs > 60
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_html_text_heads_and_notices():
    """Titles in the head of an article stay, notices go even as paragraphs, heads of pages go."""
    page = '<body><div class="page-header">Site</div><article><div class="article-header"><h1 class="banner">Title</h1></div><p>Text</p><p class="cookie-notice">We use cookies<p>More</p><ul><li class="ad">Buy</li><li>Item</li></ul><div class="comments"><p>me too</p></div></article></body>'
    assert [x for x, _ in html_text.lines(page)] == ["Title", "Text", "More", "Item"]


def test_html_text_very_long_pages(spark):
    """Memory of an alignment grows with the number of lines."""
    import tracemalloc

    a = [f"line {i}" for i in range(20_000)]
    b = [x if i % 3 else f"other {i}" for i, x in enumerate(a)]
    rng = random.Random(2)
    c = a[:]
    for _ in range(500):
        i, j = rng.randrange(len(c)), rng.randrange(len(c))
        c[i], c[j] = c[j], c[i]
    tracemalloc.start()
    assert len(html_text.common(a, b)) == sum(i % 3 > 0 for i in range(len(a)))
    assert len(html_text.common(a, c)) >= len(a) - 1000
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    page = lambda k: "<body>" + "".join(f"<p>{k} {x}</p>" for x in a) + "<p>All rights reserved</p></body>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(3)]
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["n_deleted"] == 1 and r["text"].count("\n") == 19_999


def test_common_lines():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common(a, b)
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(any(y == a[i] for y in it) for i in got)


def test_broken_html():
    for text in ("<", "<p", "<a href='x", "<!-- open", "<script>never closed", "</p></div>", "<p>a<p>b", "&amp;&bogus;&#65;", "<div><div></article>x"):
        html_text.lines(text)
    assert html_text.lines("&amp;amp; &#65;") == [(html.unescape("&amp;amp; &#65;"), False)]
    assert [x for x, _ in html_text.lines("<p " + "a='" * 5000 + ">x")] is not None


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_sentencepiece(spark, docs, rows, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    texts = [t for _, t in rows] + [" ", "  a  b\n c ", "▁x ▁", "<s> <0x0A>", "日本 語🙂", "a\x00b", "\t", "é" * 300, " " * 50]
    every = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "x")], "doc_id long, text string")
    for r in sentencepiece_codec.encode(every).collect():
        ids = model.encode(texts[r["doc_id"]] or "") if r["doc_id"] is not None else model.encode("x")
        assert r["ids"] == ids and r["decoded"] == model.decode(ids)
    for r in sentencepiece_codec.encode_digests(every.where("doc_id > 0")).collect():
        ids = model.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_digests(nothing).count() == 0
    small = sentencepiece_codec.ChunkTable(sentencepiece_codec.model_path(), max_entries=3)
    assert [small.encode([t])[0] for t in ("a b c d e", "f g h", "a b")] == [model.encode(t) for t in ("a b c d e", "f g h", "a b")]


# --- 9 -----------------------------------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 1), (5, 80, 2), (3, 60, 3)])
def test_jaccard_join(spark, size, percent, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)  # so that combinations occur
    monkeypatch.setattr(jaccard_join, "UNIT", 8)
    rng = random.Random(seed)
    rows = [(i, t) for i, t in corpus(seed, 40)[:-1]]
    base = prose(rng, 60).split()
    boiler = prose(rng, 30)
    for i in range(1000, 1090):  # a family of copies, edited to every degree
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, f"{boiler} {prose(rng, rng.randint(0, 12))}") for i in range(40)]
    rows += [(3000, "A b"), (3001, "a B"), (3002, "a"), (3003, " \n "), (3004, "a b c")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(frame(spark, rows), size, percent).collect()}
    assert found == brute_components(rows, size, percent)


def test_jaccard_join_odd(spark, nothing):
    assert jaccard_join.joined(nothing).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e"), (1, "x y z w"), (4, "x y z w"), (None, "a b c d e"), (None, None), (2, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(odd).collect()), key=str)
    assert found == sorted([(False, 1, 2, 1), (False, 1, 1, 1), (False, 2, 0, 2), (False, 4, 1, 1), (True, 0, 0, None), (True, 0, 2, None)], key=str)


@pytest.mark.parametrize("bar, most", [(4, 100), (4, 1), (1000, 100)])
def test_joined_by_key(spark, monkeypatch, bar, most):
    """Keys with many rows, some of them, or none as a broadcast: the plain join; null keys join nothing."""
    from quarrion.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", bar)
    monkeypatch.setattr(common, "MAX_HOT_KEYS", most)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 2, 3, rng.randrange(100), None])) for i in range(300)]
    left = spark.createDataFrame(rows, "id long, k long")
    groups = common.written(left.where("k % 3 <> 0").groupBy("k").agg(F.min("id").alias("lo"), F.count("*").alias("c")), "groups")
    got = common.joined_by_key(left, groups, ["k"], "id")
    assert got.columns == ["id", "k", "lo"]
    first = {k: min(i for i, x in rows if x == k) for _, k in rows if k is not None and k % 3}
    assert sorted(map(tuple, got.collect())) == sorted((i, k, first[k]) for i, k in rows if k in first)


def test_written_tables_are_deleted(spark, docs):
    """After an operator only the tables are left that its result reads."""
    from quarrion.llm import common

    before = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("quarrion-*"))
    out = jaccard_join.joined(docs)
    left = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("quarrion-*/*")) - {y for x in before for y in x.glob("*")}
    read = {str(Path(p.removeprefix("file:")).parent) for p in out.inputFiles()}
    assert left and all(str(p).replace("//", "/") in {r.replace("//", "/").replace("//", "/") for r in read} for p in left)
    assert out.count() == docs.count()


def test_spark_hash(spark):
    values = [0, 1, -1, 42, -(1 << 63), (1 << 63) - 1, 123456789012345]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert jaccard_join._xxhash64(np.array(values, np.int64)).view(np.int64).tolist() == want


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == root(i) for a, b in links if a != b for i in (a, b))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, nothing):
    rng = random.Random(2)
    rows = [(i, prose(rng, 50), "big" if i < 600 else f"s{i % 3}", 1.0) for i in range(900)] + [(9000, None, None, 0.0), (9001, "", "s1", 0.0), (9002, "a b", None, 0.0)]
    every = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    mix = mixing.mixed(every, repetition_limit=2.0)
    found = mix.select("row.*", "n_tokens", "copies", F.col("weight").alias("w")).collect()
    assert len(found) == len(rows) and all(r["copies"] >= 1 for r in found)
    tokens, got = {}, {}
    for r in found:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
        got[r["source"]] = got.get(r["source"], 0) + r["n_tokens"] * r["copies"]
    rate = {s: got[s] / t for s, t in tokens.items()}
    assert rate["big"] == 1.0 and max(rate.values()) <= 2.01
    # the least exponent that keeps the limit
    a = 1 - math.log(2.0) / math.log(max(tokens.values()) / min(tokens.values()))
    raw = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items()}
    for r in found:
        assert math.isclose(r["w"], raw[r["source"]] / sum(raw.values()), rel_tol=1e-6)
    for s in tokens:
        assert abs(got[s] - tokens["big"] * raw[s] / raw["big"]) <= 50
    assert mixing.realised(mix).columns == every.columns
    assert mixing.realised(mix).count() == sum(r["copies"] for r in found)
    less = mixing.mixed(every, None, target_entropy=1.2, budget=10_000).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert abs(less - 10_000) <= 250
    assert mixing.mixed(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.source_weights(every.select("source", F.lit(1).alias("n_tokens")), 1.0, 1.0)
