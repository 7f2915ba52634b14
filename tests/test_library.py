"""The library without its language-model part: quirks on hand-made tables, brute force, the SQL of each query."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion import catalog
from quarrion.functions import fixed, geo, text, vectors
from quarrion.operators import discovery, graph, olap, retrieval, search, tables, versions
from quarrion.operators.filters import And, Eq, Not, Or, Range
from quarrion.plans.graph_language import Graph, QueryError, parse
from quarrion.sources import stores
from quarrion.sources import vectors as vector_files

SF = "/root/testdata/sf0.001"


def test_every_query_with_sql_has_a_name():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(rows):
    cell = lambda v: f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in rows)


SLOW = {"graph_kcore", "graph_communities", "graph_path", "graph_bfs", "graph_cycles", "dedup_stream", "windowed_events", "graph_wcc", "graph_sssp"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got.select(*columns).collect()) == shown(want.select(*[f'"{c}"' for c in columns]).fetchall())


# --- vectors -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float(np.nextafter(np.float32(1), np.float32(2))), 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_k_ties_and_odd_vectors(odd_vectors):
    assert [r["vec_id"] for r in search.top_k(odd_vectors, [1.0, 0.0], 4).collect()] == [0, 1, 6, 3]
    assert search.top_k(odd_vectors, [1.0, 0.0], 0).count() == 0
    assert [r["score"] for r in search.top_k(odd_vectors, [0.0, 0.0], 2).collect()] == [0.0, 0.0]
    assert [r["vec_id"] for r in search.top_k(odd_vectors, [1.0, 0.0], 2, "inner").collect()] == [6, 0]


def test_batch_equals_single(spark, odd_vectors):
    queries = spark.createDataFrame([(10, [1.0, 0.2]), (11, [0.3, -1.0])], "query_id long, embedding array<float>")
    for block in (1, 8):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.batch_top_k(odd_vectors, queries, 3, block=block).collect()}
        for q, e in ((10, [1.0, 0.2]), (11, [0.3, -1.0])):
            assert [got[q, i + 1] for i in range(3)] == [r["vec_id"] for r in search.top_k(odd_vectors, [float(np.float32(x)) for x in e], 3).collect()]


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([float("nan"), 2.0],), ([float("inf"), 0.0],), ([0.0, 0.0],)], "e array<float>")
    assert [r[0] for r in df.select(vectors.normalize(F.col("e"))).collect()] == [[0.6, 0.8], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
    assert spark.range(1).select(vectors.fold(F.array(F.lit(1.0).cast("float")))).first()[0] == [1.0, 0.0]


def test_fixed_point(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    half, third = fixed.from_double(F.lit(-0.5)), fixed.from_double(F.lit(1 / 3))
    assert value(fixed.to_double(fixed.multiply(half, fixed.from_double(F.lit(4.0))))) == -2.0
    a, b = value(half), value(third)
    assert value(fixed.multiply(half, third)) == (a * b) >> 32
    assert value(fixed.add(F.lit(fixed.HIGH), F.lit(5))) == fixed.HIGH and value(fixed.add(F.lit(fixed.LOW), F.lit(-5))) == fixed.LOW
    assert value(fixed.from_double(F.lit(float("nan")))) is None
    assert value(fixed.ratio(F.lit(1), F.lit(0))) == 0 and value(fixed.ratio(F.lit(1), F.lit(2))) == 1 << 31


# --- filters, geo, text --------------------------------------------------------------------------------------------------


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    ids = lambda f: [r["n"] for r in df.where(f.column()).collect()]
    assert ids(And()) == [] and ids(Not(And())) == [1, 2, 3]
    assert ids(Not(Eq("s", "a"))) == [2, 3]
    assert ids(Or(Eq("s", "a"), Range("n", 3))) == [1, 3]
    assert ids(Range("n", 2, 2)) == [2]


def test_geo(spark):
    df = spark.createDataFrame([("48.85,2.35",), ("91,0",), ("x,1",), ("1",)], "p string").select(geo.parse_point(F.col("p")).alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in df.collect()] == [(48.85, 2.35), None, None, None]
    d = spark.range(1).select(geo.haversine_km(F.lit(48.85), F.lit(2.35), F.lit(51.5), F.lit(-0.12))).first()[0]
    assert 340 < d < 348


def test_text(spark):
    words = ["glasses", "ponies", "running", "king", "jumped", "bed", "cats", "gas", "class"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.stem(F.col("w"))).collect()
    assert [r[0] for r in got] == ["glass", "poni", "runn", "king", "jump", "bed", "cat", "gas", "class"]
    code = lambda w: spark.range(1).select(text.soundex_variant(F.lit(w))).first()[0]
    assert [code(w) for w in ("Robert", "Ashcraft", "Tymczak", "", "42", "Pfister")] == ["R163", "A226", "T522", "", "", "P236"]
    assert spark.range(1).select(text.within_edits(F.lit("Kitten"), F.lit("sitting"), 3)).first()[0]


# --- retrieval -----------------------------------------------------------------------------------------------------------


def test_bm25_brute_force(spark):
    docs = [(1, "cat dog cat"), (2, "dog"), (3, "bird"), (4, "")]
    p = retrieval.term_weights(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["id"]: r["score"] for r in retrieval.bm25(p, ["cat", "dog"], 10).collect()}
    n, avg = 3, 5 / 3  # a document without terms has no postings

    def part(tf, df, dl):
        return max(0, math.log((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert got == pytest.approx({1: part(2, 1, 3) + part(1, 2, 3), 2: part(1, 2, 1)})
    assert retrieval.sparse_dot(p, {}, 5).count() == 0


# --- graphs --------------------------------------------------------------------------------------------------------------


def edge_table(spark, pairs, kind="E"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], "src long, dst long, type string, weight double")


def node_table(spark, n):
    return spark.range(n).select(F.col("id").alias("node_id"), F.array(F.when(F.col("id") % 2 == 0, "Even").otherwise("Odd")).alias("labels"), F.col("id").alias("age"))


def test_chain_triangle_and_islands(spark):
    chain = edge_table(spark, [(0, 1), (1, 2), (2, 3)])
    assert {(r["node"], r["distance"]) for r in graph.bfs(chain, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert graph.path(chain, 0, 3).first()["nodes"] == [0, 1, 2, 3] and graph.path(chain, 3, 0).count() == 0
    assert graph.path(chain, 2, 2).first()["hops"] == 0
    triangle = edge_table(spark, [(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)])
    assert [tuple(r) for r in graph.triangles(node_table(spark, 3), triangle).orderBy("node_id").collect()] == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]
    assert {r["core"] for r in graph.k_core(node_table(spark, 3), triangle).collect()} == {4}
    islands = edge_table(spark, [(0, 1), (2, 3)])
    assert sorted(tuple(r) for r in graph.components(node_table(spark, 5), islands).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert [r["node_id"] for r in graph.orphans(node_table(spark, 5), islands).collect()] == [4]
    ranks = {r["node_id"]: r["rank"] for r in graph.page_rank(node_table(spark, 3), triangle).collect()}
    assert all(abs(v - 1 / 3) < 1e-6 for v in ranks.values())
    assert sorted(tuple(r) for r in graph.cycles(edge_table(spark, [(0, 1), (1, 0), (1, 2), (2, 3)])).collect()) == [(0, 0), (1, 0)]


def test_self_loop_counts_twice_undirected(spark):
    e = edge_table(spark, [(1, 1)])
    starts = spark.createDataFrame([(1,)], "start long")
    assert graph.expand(e, starts, "both").count() == 2 and graph.expand(e, starts).count() == 1


def test_graph_language(spark):
    g = Graph(node_table(spark, 6), edge_table(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 0)], "NEXT"))
    run = lambda q, **p: sorted(map(tuple, g.run(q, **p).collect()))
    assert run("MATCH (a)-[:NEXT]->(b:Odd) RETURN a, b") == [(0, 1), (2, 3)]
    assert run("MATCH (a)<-[:NEXT]-(b) WHERE a.age = 3 RETURN b.age") == [(2,)]
    assert run("MATCH (a {age: 0})-[:NEXT*1..3]->(b) RETURN b") == [(1,), (2,), (3,)]
    assert run("MATCH (a)-[:NEXT]->(b), (b)-[:NEXT]->(c) WHERE a.age < b.age AND NOT c.age = $x RETURN a, c", x=3) == [(0, 2), (2, 4)]
    assert run("MATCH (a)-[:NEXT]->(a) RETURN a") == [(0,)]
    assert run("MATCH (a:Odd) OPTIONAL MATCH (a)-[:NEXT]->(b) WHERE a.age > 2 RETURN a, b") == [(3, 4), (5, None)]
    assert run("MATCH (a)-[:OTHER]->(b) RETURN a") == []
    for bad in ("MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a)-[*3..2]->(b) RETURN a", "MATCH (a) WHERE a.x ! 1 RETURN a", ""):
        with pytest.raises(QueryError):
            parse(bad)


# --- tables, versions, relations --------------------------------------------------------------------------------------------


def test_fold_log_against_a_dictionary(spark):
    rng = random.Random(3)
    log, state = [], {}
    for lsn in range(200):
        key = rng.randrange(25)
        gone = rng.random() < 0.2
        log.append((key, lsn, lsn * 7, gone))
        state.pop(key, None) if gone else state.__setitem__(key, lsn * 7)
    got = tables.fold_log(spark.createDataFrame(log, "k long, lsn long, v long, gone boolean"), "k", "lsn", "gone")
    assert {r["k"]: r["v"] for r in got.collect()} == state


def test_transaction(spark, tmp_path):
    t = tables.Transaction(str(tmp_path / "t"), "k")
    rows = lambda *ks: spark.createDataFrame([(k, "x") for k in ks], "k long, v string")
    t.insert(rows(1, 2))
    assert t.commit() == 2
    t.insert(rows(3))
    t.rollback()
    assert t.commit() == 0
    for bad in (rows(2), rows(5, 5)):
        t.insert(bad)
        with pytest.raises(ValueError):
            t.commit()
        t.rollback()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_row_security_hides_the_unlabelled(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, tenant string")
    assert [r["k"] for r in tables.select(df, None, ("tenant", "a")).collect()] == [1]


def test_relations(spark):
    b = spark.createDataFrame([("r1", "src", "x"), ("r1", "dst", "y"), ("r2", "src", "x"), ("r2", "dst", "x"), ("r3", "src", "y")], "relation_id string, role string, entity string")
    assert [r[0] for r in versions.role_intersection(b, [("src", "x"), ("dst", "y")]).collect()] == ["r1"]
    assert [r[0] for r in versions.hyper_pattern(b, [("src", "?a"), ("dst", "?a")]).collect()] == ["r2"]
    assert sorted(map(tuple, versions.binary_projection(b, ["src"], ["dst"], True).collect())) == [("x", "x"), ("x", "y"), ("y", "x")]
    assert sorted(map(tuple, versions.schema_violations(b, [("src", 1, 1), ("dst", 1, 1)]).collect())) == [("r3", "dst", "missing role")]
    moves = spark.createDataFrame([(1, "Provisional", "Inferred"), (2, "Contradicted", "Observed"), (3, "Asserted", "Asserted")], "id int, a string, b string")
    assert [r["id"] for r in versions.illegal_moves(moves, "a", "b", versions.EPISTEMIC_MOVES).collect()] == [2]


def test_cube(spark):
    cube = olap.Cube(spark.createDataFrame([([0, 0], 1.0), ([2, 3], 2.0)], "coords array<int>, value double"), [3, 4])
    assert (cube.volume, cube.strides) == (12, [4, 1])
    new = cube.set(spark.createDataFrame([([2, 3], 5.0)], "coords array<int>, value double"))
    assert new.get([2, 3]).first()["value"] == 5.0 and new.box([0, 0], [2, 3]).count() == 2
    with pytest.raises(Exception, match="outside"):
        cube.set(spark.createDataFrame([([3, 0], 5.0)], "coords array<int>, value double")).cells.collect()


def test_motif_combinations(spark):
    got = spark.createDataFrame([(["a", "b", "c"],), ([],)], "f array<string>").select(discovery.combinations(F.col("f"), 2)).collect()
    assert [list(map(tuple, r[0])) for r in got] == [[("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")], []]
    with pytest.raises(discovery.RuleError):
        discovery.compile_condition(["no such thing"])


# --- sources -----------------------------------------------------------------------------------------------------------------


def test_vector_files(spark, tmp_path):
    vector_files.register(spark)
    rows = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "v.fvecs").write_bytes(b"".join(struct.pack("<i", 3) + r.tobytes() for r in rows))
    (tmp_path / "v.ivecs").write_bytes(b"".join(struct.pack("<i", 2) + struct.pack("<2i", i, -i) for i in range(3)))
    assert [list(r["embedding"]) for r in spark.read.format("vecs").load(str(tmp_path / "v.fvecs")).orderBy("vec_id").collect()] == rows.tolist()
    assert [list(r["embedding"]) for r in spark.read.format("vecs").load(str(tmp_path / "v.ivecs")).orderBy("vec_id").collect()] == [[i, -i] for i in range(3)]


def test_snapshot_and_journal(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    stores.save_snapshot({"t": df}, str(tmp_path / "s"))
    assert stores.open_snapshot(spark, str(tmp_path / "s"))["t"].count() == 2
    assert stores.digest(df) == stores.digest(df.orderBy(F.desc("k")).select("v", "k"))
    df.write.mode("append").parquet(str(tmp_path / "s" / "t"))
    with pytest.raises(ValueError):
        stores.open_snapshot(spark, str(tmp_path / "s"))
    stores.write_journal(df, str(tmp_path / "j"))
    assert stores.read_journal(spark, str(tmp_path / "j"), "k long, v string").count() == 2
    part = next(p for p in (tmp_path / "j").glob("part-*") if p.stat().st_size)
    part.write_text(part.read_text().replace("a", "b", 1) if '\\"a\\"' not in part.read_text() else part.read_text().replace('\\"a\\"', '\\"b\\"'))
    for crc in (tmp_path / "j").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="tampered"):
        stores.read_journal(spark, str(tmp_path / "j"), "k long, v string").collect()


def test_crawl(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\nNOTE n\n")
    (tmp_path / "y.bin").write_bytes(b"0123456789")
    assert stores.crawl(spark, str(tmp_path), "*.md").select("content").first()[0].startswith("# T")
    piece = stores.crawl(spark, str(tmp_path), "*.bin").select(stores.byte_range(F.col("content").cast("binary"), 4, 100)).first()[0]
    assert bytes(piece) == b"456789"


def test_hashed_embeddings_finds_long_documents(spark, tmp_path):
    from quarrion.queries.texts import hashed_embeddings

    rows = [(1, "alpha beta gamma"), (2, "alpha beta gamma " * 100), (3, "delta epsilon")]
    spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in hashed_embeddings(spark, str(tmp_path)).collect()} == {1, 2, 3}


def _people(spark):
    from quarrion.plans.graph_language import Graph

    n = spark.createDataFrame([("a", ["P"], 1), ("b", ["P"], 2), ("c", ["Q"], 3)], "node_id string, labels array<string>, age int")
    e = spark.createDataFrame([("a", "b", "K", 1.0), ("a", "c", "K", 5.0), ("b", "a", "L", 2.0)], "src string, dst string, type string, weight double")
    return Graph(n, e), n, e


def test_graph_edges_with_names_and_optional_ends(spark):
    from quarrion.plans.graph_language import QueryError

    g, _, _ = _people(spark)
    rows = lambda q: sorted(map(tuple, g.run(q).collect()), key=str)
    assert rows("MATCH (a)-[:K]->(b) OPTIONAL MATCH (b)-[:Z]->(a) RETURN a, b") == [("a", "b"), ("a", "c")]
    assert rows("MATCH (a)-[:K]->(b) OPTIONAL MATCH (b)-[r:L]->(a) RETURN b, r.weight") == [("b", 2.0), ("c", None)]
    assert rows("MATCH (a:P), (b:Q) OPTIONAL MATCH (a)-[r:K]->(b) RETURN a, b, r.weight") == [("a", "c", 5.0), ("b", "c", None)]
    assert rows("MATCH (a)-[r:K]->(b) WHERE r.weight > 2 RETURN a, r") == [("a", ("a", "K", "c"))]
    assert rows("MATCH (a)-[r {weight: 1.0}]-(b) RETURN a, b, r.type") == [("a", "b", "K"), ("b", "a", "K")]
    for bad in ("MATCH (a)-[r:K*1..2]->(b) RETURN r", "MATCH (a)-[a:K]->(b) RETURN a", "MATCH (a) RETURN b"):
        with pytest.raises(QueryError):
            g.run(bad)
    for bad in ("MATCH (a) DELETE b", "CREATE (a)-[:X]-(b)", "MATCH (a)", "CREATE (a:P)"):
        with pytest.raises(QueryError):
            g.mutate(bad, 1)


def test_graph_mutations(spark):
    from quarrion.operators import mutations

    g, n, e = _people(spark)
    log = mutations.created(n, e)
    for lsn, text in enumerate(("CREATE (n:P:New {node_id: 'z', age: 7}), (n)-[:K {weight: 2}]->(m:Q {node_id: 'y'})", "MATCH (a:P) WHERE a.age = 2 DELETE a", "MATCH (a:P)-[r:K]->(c:Q) SET a.old = $v, a:Senior, r.since = 9 REMOVE a.age, a:P", "CREATE (b:P {node_id: 'b'})", "CREATE (b:P {node_id: 'b'})"), 1):
        log = log.unionByName(g.mutate(text, lsn, v=9))
    nodes = {r["node_id"]: (r["labels"], r["props"]) for r in mutations.nodes(log).collect()}
    assert nodes == {"a": (["Senior"], {"old": "9"}), "b": (["P"], {}), "c": (["Q"], {"age": "3"}), "z": (["New", "P"], {"age": "7"}), "y": (["Q"], {})}
    # the edges of b went with it and stay away when a node of its name comes back
    assert {(r["src"], r["dst"]): r["props"] for r in mutations.edges(log).collect()} == {("a", "c"): {"weight": "5.0", "since": "9"}, ("z", "y"): {"weight": "2"}}
    assert [(r["lsn"], r["reason"]) for r in mutations.rejected(log).collect()] == [(5, "exists already")]
    assert mutations.nodes(log, 0).count() == 3 and mutations.nodes(log.limit(0)).count() == 0


def test_state_machines(spark):
    from quarrion.operators import lifecycle

    log = spark.createDataFrame([(1, 1, "create"), (1, 2, "create"), (1, 3, "tombstone"), (1, 4, "version"), (None, 1, "version"), (None, 2, "create")], "k int, lsn int, op string")
    got = {(r["k"], r["lsn"]): (r["after"], r["accepted"]) for r in lifecycle.machine(log, "k", ["lsn"], "op", lifecycle.ENTITY).collect()}
    assert got == {(1, 1): ("live", True), (1, 2): ("live", False), (1, 3): ("dead", True), (1, 4): ("dead", False), (None, 1): ("none", False), (None, 2): ("live", True)}
    seq = spark.createDataFrame([("c", i, n) for i, n in enumerate([1, 2, 2, 9, 5, None, 6])], "c string, i int, n int")
    assert [r["accepted"] for r in lifecycle.sequenced(seq, "c", "n", ["i"], 3).orderBy("i").collect()] == [True, True, False, False, True, False, True]
    assert lifecycle.machine(log.limit(0), "k", ["lsn"], "op", lifecycle.ENTITY).count() == 0


def test_cycles_by_colours(spark):
    import random

    rng = random.Random(4)
    for n, m in ((12, 20), (30, 40), (5, 0)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | ({(i, i + 1) for i in range(100, 170)} | {(170, 100)} if n == 12 else set())
        reach = {x: {y for a, y in pairs if a == x} for p in pairs for x in p}
        while True:
            more = {x: ys.union(*(reach[y] for y in ys)) if ys else ys for x, ys in reach.items()}
            if more == reach:
                break
            reach = more
        want = {(x, min(group)) for x in reach if len(group := {y for y in reach if y == x or (y in reach[x] and x in reach[y])}) > 1}
        got = graph.cycles(spark.createDataFrame(list(pairs), "src int, dst int"))
        assert {tuple(r) for r in got.collect()} == want


def test_no_queries(spark):
    from quarrion.operators.search import batch_top_k

    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert batch_top_k(v, v.limit(0).withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_checkpoint_digests(spark):
    from quarrion.operators import governance

    t = {"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}
    taken = governance.digests(t)
    assert governance.verified(t, taken) == [] and governance.verified({"a": t["a"], "b": t["a"]}, taken) == ["b"] and governance.verified({"a": t["a"]}, taken) == ["b"]


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean"])
def test_top_k_of_batches_agrees_with_expressions(spark, metric):
    """Vectors of other lengths, with null elements, of zeros, equal ones; ids of any type; every k."""
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [("short", [1.0, 2.0]), ("long", [1.0, 0.0, 2.0, 1.0, 5.0]), ("gap", [1.0, None, 2.0, 0.0]), ("zero", [0.0] * 4), ("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    query = [1.0, -1.0, 0.5, 2.0]
    score = search.METRICS[metric](search.literal_vector(query), F.col("v"))
    want = sorted(((-r["s"], r["id"]) for r in df.where("v is not null").select("id", score.alias("s")).collect()))
    for k in (1, 10, 100):
        got = search.top_k(df, query, k, metric, id_col="id", vector_col="v").collect()
        assert [r["id"] for r in got] == [i for _, i in sorted((round(a, 9), i) for a, i in want)[:k]] or [round(r["score"], 6) for r in got] == [round(-a, 6) for a, _ in want[:k]]
        assert len(got) == min(k, len(want))
    assert search.top_k(df.limit(0), query, 3, metric, id_col="id", vector_col="v").count() == 0
