"""Queries over documents: tokens, lexical and hybrid retrieval, context graphs, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, graph, retrieval
from ..operators.search import top_k
from .graphs import nodes

TERMS = ["the", "thble", "idiot", "anat", "license", "ention"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _plain(spark, sf_dir) -> DataFrame:
    """Postings of unstemmed words: the stem rules have no short SQL."""
    words = F.explode(X.words(F.col("text"))).alias("term")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), words).groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25_texts(_docs(spark, sf_dir), TERMS, 10, X.words).select("id", F.round("score", 5).alias("score"))


def bm25_stemmed(spark, sf_dir):
    return retrieval.bm25_texts(_docs(spark, sf_dir), ["idiot", "anat", "ention"], 10, X.stems)


def sparse_dot_topk(spark, sf_dir):
    return retrieval.sparse_dot(_plain(spark, sf_dir), {"the": 0.5, "idiot": 3.0, "anat": 1.5}, 10)


def _dense(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id = 0").first()["embedding"]
    return top_k(v, q, 20, "cosine").select(F.col("vec_id").alias("id"), "score")


def _lexical(spark, sf_dir):
    return retrieval.bm25_text_scores(_docs(spark, sf_dir), TERMS, X.words)


def hybrid_rrf(spark, sf_dir):
    return retrieval.hybrid(_dense(spark, sf_dir), _lexical(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


def hybrid_linear(spark, sf_dir):
    return retrieval.hybrid(_dense(spark, sf_dir), _lexical(spark, sf_dir), 10, (0.7, 0.3), "linear").select("id", F.round("score", 5).alias("score"))


def maxsim_topk(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = [r["embedding"] for r in v.where("vec_id in (0, 1, 2)").orderBy("vec_id").collect()]
    return retrieval.max_sim(v, q, 5, "label", "embedding").select(F.col("id").cast("long").alias("id"), F.round("score", 5).alias("score"))


def recall_at_k(spark, sf_dir):
    """Recall of a search by inner product against one by cosine."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id = 3").first()["embedding"]
    found, exact = (top_k(v, q, 20, m).select(F.lit(3).alias("query_id"), F.col("vec_id").alias("id")) for m in ("inner", "cosine"))
    return retrieval.recall(found, exact)


def stem_terms(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(X.words(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).distinct()
    return words.where(~F.col("w").isin(X.STOP_WORDS)).select("w", X.stem(F.col("w")).alias("stem"))


def fuzzy_terms(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_name", X.edit_distance(F.col("n_name"), F.lit("nation_4")).cast("long").alias("d")).where("d <= 2")


def phonetic_codes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/region.parquet")
    return n.select("r_name", F.soundex("r_name").alias("standard"), X.soundex_variant(F.col("r_name")).alias("variant"))


def hashed_embeddings(spark, sf_dir):
    """Nearest documents to a text by feature-hashed embeddings."""
    e = retrieval.hashed_embeddings(_docs(spark, sf_dir), 32)
    q = retrieval.hashed_embeddings(_docs(spark, sf_dir).where("doc_id = 1"), 32).first()
    return top_k(e, q["embedding"] if q else [0.0] * 32, 10, "inner", id_col="id").select(F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


def cjk_pairs(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select("r_name", F.array_join(X.cjk_bigrams(F.col("r_name")), "|").alias("pairs"))


# --- context graph ----------------------------------------------------------------------------------------------------


def _markdown(spark, sf_dir):
    """Documents as markdown: every third line a heading, every fourth a note."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# "), x)).when(i % 4 == 1, F.concat(F.lit("NOTE "), x)).otherwise(x))
    return _docs(spark, sf_dir).where("length(text) > 0").select("doc_id", F.array_join(lines, "\n").alias("text"))


def context_claims(spark, sf_dir):
    found = context.sections_and_claims(_markdown(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count_if(F.col("kind") == "section").alias("sections"), F.count_if(F.col("kind") == "note").alias("notes"), F.count("section").alias("placed"))


def context_search(spark, sf_dir):
    n = nodes(spark, sf_dir).where("name is not null").select(F.col("node_id").alias("entity_id"), F.col("name").alias("label"))
    return context.lexical_search(n, "asia region", 10)


def reference_resolution(spark, sf_dir):
    """Names against labels with a path in front."""
    entities = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("entity_id"), F.concat(F.lit("world/"), F.concat_ws("/", (F.col("n_regionkey") % 2).cast("string"), "n_name")).alias("label"))
    refs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("ref_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("x"))).alias("name"))
    return context.resolve(refs, entities).select("ref_id", "state", "confidence", F.size("targets").cast("long").alias("n"))


def snapshot_diff(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("head"))
    after = d.where("doc_id % 7 <> 0").withColumn("head", F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("head"))).unionByName(d.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") - 1000))
    return context.diff(d, after, "doc_id", ["head"])


def manifest_diff(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    before, after = context.manifest(d), context.manifest(d.withColumn("content", F.when(F.col("path").endswith("3"), F.upper("content")).otherwise(F.col("content"))))
    return context.diff(before, after, "path", ["hash"]).groupBy("change").agg(F.count("*").alias("n"))


def json_keys(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return context.json_keys(e, "event_id", "props").groupBy("key", "type").agg(F.count("*").alias("n"))


def code_symbols(spark, sf_dir):
    """Declarations and calls of a small source file."""
    source = "import os\n\nclass Box:\n    def size(self):\n        return len(self.items)\n\ndef test_size():\n    box = Box()\n    assert box.size() == 0\n"
    rows = spark.createDataFrame([("a/box.py", source), ("a/lib.rs", "pub fn area(w: u32) -> u32 {\n    scale(w)\n}\n")], ["path", "text"])
    return context.symbols(rows).select("path", F.col("line").cast("long").alias("line"), "kind", "name", "is_test")


def code_impact(spark, sf_dir):
    """What depends on a function, through calls."""
    source = "def low():\n    pass\n\ndef mid():\n    low()\n\ndef high():\n    mid()\n"
    calls = context.calls(spark.createDataFrame([("m.py", source)], ["path", "text"])).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.impact(calls, "low", 5).select("node", F.col("depth").cast("long").alias("depth"))


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_stemmed, sparse_dot_topk, hybrid_rrf, hybrid_linear, maxsim_topk, recall_at_k, stem_terms, fuzzy_terms, phonetic_codes, hashed_embeddings, cjk_pairs, context_claims, context_search, reference_resolution, snapshot_diff, manifest_diff, json_keys, code_symbols, code_impact)
}

_P = r"p AS (SELECT doc_id AS id, term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL)"
_TERMS = ", ".join(f"'{t}'" for t in TERMS)


def _bm25(source: str) -> str:
    return (
        f"dl AS (SELECT id, sum(greatest(1.0, round(weight))) AS dl FROM {source} GROUP BY id), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM dl), h AS (SELECT * FROM {source} WHERE term IN ({_TERMS})), "
        "f AS (SELECT term, count(*)::DOUBLE AS df FROM h GROUP BY term), lex AS (SELECT h.id, sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM h JOIN f USING (term) JOIN dl ON dl.id = h.id, c GROUP BY h.id)"
    )


_COS = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE))"
_HYBRID = f"WITH {_P}, {_bm25('p')}, den AS (SELECT e.vec_id AS id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 20), l AS (SELECT * FROM lex ORDER BY score DESC, id LIMIT 20)"
_STEM = "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
ORACLE_SQL = {
    "bm25_topk": f"WITH {_P}, {_bm25('p')} SELECT id, round(score, 5) AS score FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 10)",
    "sparse_dot_topk": f"WITH {_P} SELECT id, sum(weight * CASE term WHEN 'the' THEN 0.5::DOUBLE WHEN 'idiot' THEN 3.0 ELSE 1.5 END) AS score FROM p WHERE term IN ('the', 'idiot', 'anat') GROUP BY id ORDER BY score DESC, id LIMIT 10",
    "hybrid_rrf": f"{_HYBRID} SELECT id, round(s, 6) AS score FROM (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM den UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM l) GROUP BY id ORDER BY s DESC, id LIMIT 10)",
    "hybrid_linear": f"{_HYBRID} SELECT id, round(s, 5) AS score FROM (SELECT id, sum(x) AS s FROM (SELECT id, 0.7::DOUBLE * (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-6) AS x FROM den UNION ALL SELECT id, 0.3::DOUBLE * (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-6) FROM l) GROUP BY id ORDER BY s DESC, id LIMIT 10)",
    "maxsim_topk": f"SELECT id::BIGINT AS id, round(s, 5) AS score FROM (SELECT id, sum(m) AS s FROM (SELECT e.label AS id, q.vec_id, max({_DOT}) AS m FROM embeddings e, embeddings q WHERE q.vec_id < 3 GROUP BY ALL) GROUP BY id ORDER BY s DESC, id LIMIT 5)",
    "recall_at_k": f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 3), a AS (SELECT e.vec_id FROM embeddings e, q ORDER BY {_DOT} DESC, vec_id LIMIT 20), b AS (SELECT e.vec_id FROM embeddings e, q ORDER BY {_COS} DESC, vec_id LIMIT 20) SELECT 3 AS query_id, (SELECT count(*) FROM a JOIN b USING (vec_id)) / 20.0::DOUBLE AS recall",
    "stem_terms": rf"WITH t AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS w FROM part) SELECT w, {_STEM} AS stem FROM t WHERE w NOT IN ('the', 'is', 'are', 'at', 'which', 'on', 'and', 'a', 'an', 'in', 'to', 'for', 'of', 'with')",
    "fuzzy_terms": "SELECT n_name, levenshtein(lower(n_name), 'nation_4') AS d FROM nation WHERE levenshtein(lower(n_name), 'nation_4') <= 2",
    "cjk_pairs": "SELECT r_name, array_to_string(list_transform(range(1, length(replace(r_name, ' ', ''))), lambda i: substr(replace(r_name, ' ', ''), i, 2)), '|') AS pairs FROM region",
    "context_claims": "WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE length(text) > 0), m AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 AND trim(x) <> '' THEN 'section' WHEN i % 3 <> 0 AND i % 4 = 1 THEN 'note' END AS kind FROM l) SELECT doc_id, count(*) FILTER (WHERE kind = 'section') AS sections, count(*) FILTER (WHERE kind = 'note') AS notes, count(*) AS placed FROM m WHERE kind IS NOT NULL GROUP BY doc_id",
    "context_search": "WITH n AS (SELECT 'C:' || c_custkey AS id, c_mktsegment AS l FROM customer UNION ALL SELECT 'O:' || o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'P:' || p_partkey, p_brand FROM part UNION ALL SELECT 'S:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_name FROM region), s AS (SELECT id, CASE WHEN lower(l) = 'asia' THEN 10.0::DOUBLE WHEN contains(lower(l), 'asia') THEN 4 ELSE 0 END + CASE WHEN lower(l) = 'region' THEN 10.0::DOUBLE WHEN contains(lower(l), 'region') THEN 4 ELSE 0 END AS score FROM n) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10",
    "reference_resolution": "SELECT n_nationkey AS ref_id, CASE WHEN n_nationkey % 2 = 0 THEN 'resolved' ELSE 'unresolved' END AS state, CASE WHEN n_nationkey % 2 = 0 THEN 0.95::DOUBLE ELSE 0 END AS confidence, CASE WHEN n_nationkey % 2 = 0 THEN 1::BIGINT ELSE 0 END AS n FROM nation",
    "snapshot_diff": "WITH a AS (SELECT doc_id, text AS h FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE h END AS h FROM a WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id - 1000, h FROM a WHERE doc_id < 10) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id",
    "manifest_diff": "SELECT CASE WHEN doc_id % 10 = 3 AND upper(text) <> text THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n FROM documents GROUP BY 1",
    "json_keys": "SELECT 'k' AS key, 'number' AS type, count(*) AS n FROM events",
    "code_symbols": "SELECT * FROM (VALUES ('a/box.py', 2::BIGINT, 'class', 'Box', false), ('a/box.py', 3, 'def', 'size', false), ('a/box.py', 6, 'def', 'test_size', true), ('a/lib.rs', 0, 'fn', 'area', false)) t(path, line, kind, name, is_test)",
    "code_impact": "SELECT * FROM (VALUES ('mid', 1::BIGINT), ('high', 2)) t(node, depth)",
}
