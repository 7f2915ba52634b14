import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion.functions.geometry import e8_nearest
from quarrion.operators import cells, communities, context, graph, reasoning
from quarrion.operators.search import top_k
from quarrion.sources import stores


def _vectors(spark, n=400, d=12, seed=5):
    r = np.random.default_rng(seed)
    m = (r.normal(size=(8, d))[r.integers(0, 8, n)] + 0.4 * r.normal(size=(n, d))).astype(np.float32)
    m[7] = m[3]  # equal vectors
    m[11] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), m


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean"])
def test_cells_give_the_full_scans_result(spark, metric):
    v, m = _vectors(spark)
    centres = cells.fit_cells(v, 16, metric)
    assigned = cells.assign(v, centres, metric).cache()
    sizes = cells.cell_sizes(assigned).cache()
    assert assigned.count() == len(m)
    for q, k in [(m[3], 5), (m[100] + 1, 1), (-m[9], 500)]:
        want = [(r["vec_id"], round(r["score"], 9)) for r in top_k(v, q, k, metric).collect()]
        got = cells.cell_top_k(assigned, sizes, centres, q, k, metric).collect()
        assert [(r["vec_id"], round(r["score"], 9)) for r in got] == want and all(r["certified"] for r in got)
        few = cells.cell_top_k(assigned, sizes, centres, q, k, metric, 2).collect()
        proven = [r["vec_id"] for r in few if r["certified"]]
        assert proven == [i for i, _ in want][: len(proven)]  # what is certified are the best of all


def test_cells_of_nothing(spark):
    v, m = _vectors(spark)
    none = v.limit(0)
    centres = cells.fit_cells(none, 4)
    assigned = cells.assign(none, centres)
    assert cells.cell_top_k(assigned, cells.cell_sizes(assigned), centres, m[0], 3).collect() == []
    assert cells.coded_top_k(cells.coded(none), none, m[0], 3).collect() == []


def test_codes_give_the_full_scans_result(spark):
    v, m = _vectors(spark)
    codes = cells.coded(v).cache()
    for q, k in [(m[3], 5), (-m[20], 17), (m[1], 0), (m[2], 1000)]:
        assert [r["vec_id"] for r in cells.coded_top_k(codes, v, q, k).collect()] == [r["vec_id"] for r in top_k(v, q, k, "inner").collect()]


def test_addresses_are_lattice_points_and_recall_holds(spark):
    v, m = _vectors(spark, d=16)
    addresses = cells.addressed(v, 2.0).cache()
    first = v.where("embedding is not null").select("vec_id", e8_nearest(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 2)).alias("p"))
    for r in addresses.join(first, "vec_id").limit(50).collect():
        assert r["address"][:8] == [int(2 * x) for x in r["p"]]
    hit = total = 0
    for i in range(0, 400, 80):
        address = addresses.where(F.col("vec_id") == i).first()["address"]
        got = {r["vec_id"] for r in cells.address_top_k(addresses, v, m[i], address, 10, 60).collect()}
        want = {r["vec_id"] for r in top_k(v, m[i], 10).collect()}
        hit, total = hit + len(got & want), total + len(want)
    assert hit / total >= 0.9


def _modularity(edges, labels):
    m = sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        k[a] = k.get(a, 0) + w
        k[b] = k.get(b, 0) + w
    inside = sum(w for a, b, w in edges if labels[a] == labels[b]) / m
    return inside - sum((sum(k.get(n, 0) for n in labels if labels[n] == c) / (2 * m)) ** 2 for c in set(labels.values()))


def test_louvain(spark):
    edges = [(a, b, 1.0) for g in range(3) for a, b in itertools.combinations(range(5 * g, 5 * g + 5), 2)] + [(0, 5, 1.0), (5, 10, 1.0)]
    n = spark.createDataFrame([(i,) for i in range(16)], "node_id long")
    e = spark.createDataFrame([(a, b, "T", w) for a, b, w in edges] + [(1, 99, "T", 1.0)], "src long, dst long, type string, weight double")
    found = {r["node_id"]: r["community"] for r in communities.louvain(n, e).collect()}
    assert found == {i: 5 * (i // 5) for i in range(15)} | {15: 15}
    label = {r["node_id"]: r["community"] for r in graph.label_communities(n, e.where("dst < 99")).collect()}
    assert _modularity(edges, found) >= _modularity(edges, label) - 1e-9
    assert {r["community"] for r in communities.louvain(n, e.limit(0)).collect()} == set(range(16))


def test_louvain_beats_single_nodes_and_one_group(spark):
    r = np.random.default_rng(3)
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 30, (90, 2)).tolist() if a != b})
    n = spark.createDataFrame([(i,) for i in range(30)], "node_id long")
    e = spark.createDataFrame([(a, b, "T", 1.0) for a, b in edges], "src long, dst long, type string, weight double")
    found = {x["node_id"]: x["community"] for x in communities.louvain(n, e).collect()}
    weighed = [(a, b, 1.0) for a, b in edges]
    assert len(found) == 30 and all(found[c] == c for c in found.values())
    assert _modularity(weighed, found) > max(0.2, _modularity(weighed, dict.fromkeys(range(30), 0)))


def test_scopes(spark):
    m = spark.createDataFrame([(1, 7), (2, 7), (3, 9), (4, 9), (5, 9), (6, 6)], "node_id long, community long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1, 7)], "node_id long, label string")
    rows = communities.scopes(m, names, 2).orderBy("scope_id").collect()
    assert [(r["label"], r["entity_count"], r["top_entities"]) for r in rows] == [("Scope: n3", 3, ["n3", "n4"]), ("Scope: n1", 2, ["n1", "n2"]), ("Scope: n6", 1, ["n6"])]


def test_chain_product():
    def by_sorting(a, b):
        axes = [i for i in range(8) if a >> i & 1] + [i for i in range(8) if b >> i & 1]
        swaps = sum(1 for i, j in itertools.combinations(range(len(axes)), 2) if axes[i] > axes[j])
        return -1.0 if swaps % 2 else 1.0

    for a, b in itertools.product(range(64), repeat=2):
        assert reasoning.chain_product([{a: 1.0}, {b: 1.0}])[0] == {a ^ b: by_sorting(a, b)}
    assert reasoning.chain_product([]) == ({}, 0, 0.0)
    assert reasoning.chain_product([{1: 2.0}, {}]) == ({1: 2.0}, 1, 0.0)
    product, depth, loss = reasoning.chain_product([{0: 3.0, 1: 1.0}, {0: 1.0}], 1)
    assert product == {0: 3.0} and depth == 2 and loss == pytest.approx(0.1)


def test_composed_chains(spark):
    rows = [("a", 1, 0, 1.0), ("a", 1, 3, 2.0), ("a", 2, 1, 0.5), ("a", 3, 2, -1.0), ("b", 1, 5, 1.0)]
    found = reasoning.composed_chains(spark.createDataFrame(rows, "chain_id string, position int, blade int, coefficient double")).collect()
    want, depth, _ = reasoning.chain_product([{0: 1.0, 3: 2.0}, {1: 0.5}, {2: -1.0}])
    assert {r["blade"]: r["coefficient"] for r in found if r["chain_id"] == "a"} == want and depth == 3
    assert [(r["blade"], r["depth"]) for r in found if r["chain_id"] == "b"] == [(5, 1)]


def test_alignment_undoes_a_rotation(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(12, 4))
    g = np.eye(4)
    g[0, 0] = g[2, 2] = math.cos(0.3)
    g[0, 2], g[2, 0] = -math.sin(0.3), math.sin(0.3)
    b = a @ g.T
    rotation, residual = reasoning.aligned(a, b, 2)
    assert residual < 0.02 and np.allclose(rotation @ rotation.T, np.eye(4))
    points = spark.createDataFrame([(1, x.tolist()) for x in a] + [(2, x.tolist()) for x in b], "region long, coords array<double>")
    rows = {(x["a"], x["b"]): x for x in reasoning.region_alignment(points, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).collect()}
    assert rows[1, 2]["residual"] <= rows[1, 2]["before"] and rows[1, 3]["residual"] == 1.0
    with pytest.raises(ValueError):
        reasoning.region_alignment(points, spark.createDataFrame([(1, 2)], "a long, b long"), most=5)


def test_resolutions(spark):
    cases = spark.createDataFrame([(i,) for i in range(5)], "case_id long")
    told = spark.createDataFrame([(0, True, "verified"), (0, False, "verified"), (1, True, "unverified"), (2, False, "verified"), (3, None, None)], "case_id long, success boolean, state string")
    assert {r["case_id"]: (r["status"], r["outcomes"]) for r in reasoning.resolutions(cases, told).collect()} == {0: ("verified_resolution", 2), 1: ("candidate", 1), 2: ("failed", 1), 3: ("failed", 1), 4: ("open", 0)}


def test_framed_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"x\t{i}\n") for i in range(1, 21)], "lsn long, v string")
    path = str(tmp_path / "log")
    stores.write_frames(rows, path, per_segment=8)
    read = lambda: sorted((r["lsn"], r["v"]) for r in stores.replay_frames(spark, path, "lsn long, v string", 3).collect())
    assert read() == [(i, f"x\t{i}\n") for i in range(4, 21)]
    torn = tmp_path / "log" / "segment=2" / "part-torn.txt"
    torn.write_text('123456\t21\t{"lsn":2')
    spark.catalog.clearCache()
    assert read() == [(i, f"x\t{i}\n") for i in range(4, 21)]
    torn.unlink()
    (tmp_path / "log" / "segment=0" / "part-bad.txt").write_text("1\t2\t{}")
    with pytest.raises(ValueError):
        read()
    (tmp_path / "log" / "segment=0" / "part-bad.txt").unlink()
    stores.write_frames(spark.createDataFrame([(23, "late")], "lsn long, v string"), path, per_segment=8)
    with pytest.raises(ValueError):
        read()


def test_exports_escape(spark):
    d = spark.createDataFrame([("a|b\\c\nd", None), ('<b> & "q"', 2)], "t string, n long")
    assert [r["line"] for r in context.markdown_rows(d, ["t", "n"]).collect()] == ["| a\\|b\\\\c d |  |", '| <b> & "q" | 2 |']
    assert [r["line"] for r in context.html_rows(d, ["t", "n"]).collect()] == ["<tr><td>a|b\\c\nd</td><td></td></tr>", "<tr><td>&lt;b&gt; &amp; &quot;q&quot;</td><td>2</td></tr>"]
    assert context.markdown_head(["t", "n"]) == ["| t | n |", "|-|-|"]


def test_seeded_query(spark):
    s = spark.createDataFrame([("1", "parse", "m.parse", None), ("2", "run", "m.run", "parses all"), ("3", "far", "m.far", None), ("4", "user", "m.user", None)], "id string, name string, qualified string, doc string")
    e = spark.createDataFrame([("2", "1", "CALLS"), ("4", "2", "CALLS"), ("3", "1", "USES")], "src string, dst string, type string")
    assert {r["id"]: r["depth"] for r in context.seeded_query(s, e, "parse!", 1, 1).collect()} == {"1": 0, "2": 1}
    assert {r["id"]: r["depth"] for r in context.seeded_query(s, e, "parse", 3, 5).collect()} == {"1": 0, "2": 0, "4": 1}
