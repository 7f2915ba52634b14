"""The pipeline on a small folder of tables, each stage against what it must do to its input."""

import random

import pytest

from .test_operators import brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        text = prose(rng, 80)
        if i % 10 == 3:
            text = rows[-1][1].replace(" w1 ", " w2 ", 1)
        if i % 15 == 4:
            text += f" user{i}@mail.example.org"
        rows.append((i, text, "en", f"s{i % 2}" if i < 40 else "s0", len(text)))
    rows += [(900 + i, " ".join(f"q{rng.randrange(30)}%%" for _ in range(80)), "en", "s1", 1) for i in range(20)]
    rows += [(990, None, None, None, None), (991, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 900), 0) for i in range(0, 150, 2)] + [(900, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline
    from quarrion.llm.common import written

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen[name] = docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(d.columns == columns for n, d in seen.items() if n != "sentencepiece")
    rows = lambda n: [tuple(r) for r in seen[n].collect()]
    clean = {r[0] for r in rows("quality_classifier")}
    assert clean >= set(range(150)) | {990, 991} and not clean & set(range(900, 920))
    components = brute_components([(r[0], r[1]) for r in rows("quality_classifier")], 5, 80)
    assert {r[0] for r in rows("ngram_jaccard_join")} == {i for i, (_, c) in components.items() if i == c}
    before = {r[0]: r for r in rows("ngram_jaccard_join")}
    for r in rows("pii"):
        old = before[r[0]][1]
        assert r[1] == (old if old is None or "@" not in old else old[: old.index(" user")] + " [EMAIL]")
        assert r[4] == len(r[1] or "") and r[2:4] == before[r[0]][2:4]
    mixed = rows("mixing")
    assert {r[0] for r in mixed} == set(before) and len(mixed) >= len(before)
    assert seen["sentencepiece"].count() == len(mixed)
    out = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows("sentencepiece"), key=str)


def test_odd_tables(spark, folder, tmp_path):
    """Extra columns pass through every stage but the last; repeated ids stay or go together, null ids stay; empty tables stay empty."""
    import corpus_pipeline
    from quarrion.llm.common import written

    rng = random.Random(3)
    text = prose(rng, 60)
    rows = [(1, text), (2, text), (2, text), (None, text), (None, text), (3, prose(rng, 60)), (3, prose(rng, 60)), (4, None)]
    names = ("row", "n_tokens", "copies", "kept", "component_id", "redacted", "spans", "t")
    docs = spark.createDataFrame([(i, t, "en", "s0", 1, *names) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[1:]:  # the first one samples
        columns = docs.columns
        docs = written(stage(spark, docs, folder), name)
        assert name == "sentencepiece" or docs.columns == columns
        if name in ("ngram_jaccard_join", "pii", "mixing"):
            assert sorted((r["doc_id"] or 0 for r in docs.distinct().collect())) == [0, 1, 3, 3, 4]
            assert docs.where("doc_id is null").count() >= 2
    assert docs.count() >= 6
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_batches_bounded_in_bytes(spark, folder):
    """Stages with Python bound Arrow batches in bytes, as rows of any number may be long; a smaller limit of the session stays."""
    import pyarrow as pa

    import corpus_pipeline
    from quarrion.llm.common import BATCH_BYTES

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(2000).selectExpr("id doc_id", "repeat('word', 2000) text", "'en' lang", "'s' source", "8000L n_chars").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.encode):
        spark.conf.unset(limit)
        stage(spark, docs.limit(2), folder)
        found = docs.mapInArrow(sizes, "bytes long, n long").collect()
        assert sum(r["n"] for r in found) == 2000 and max(r["bytes"] for r in found) < 1.1 * BATCH_BYTES
    spark.conf.set(limit, "1m")
    corpus_pipeline.encode(spark, docs.limit(2), folder)
    assert spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)


def test_quality_hands_texts_over_once(spark):
    """The rows that the classifier scores in place reach Python with one copy of the text; columns are found whatever their case."""
    from quarrion.llm import importance

    target = spark.createDataFrame([(0,)], "doc_id long")
    docs = spark.createDataFrame([(0, "a b c", 1), (1, None, 2), (None, "a", 3)], "DOC_ID int, TEXT string, x int")
    kept = importance.keep_sampled(docs, target, k=10)
    assert kept.columns == docs.columns and sorted(r["x"] for r in kept.collect()) == [1, 2, 3]
    plan = kept._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert [f for f in plan.child().schema().fieldNames()] == ["row"]


def test_word_table_is_compact():
    import tracemalloc

    from quarrion.llm import sentencepiece_codec

    known = sentencepiece_codec.ChunkTable(sentencepiece_codec.model_path())
    text = " ".join(f"word{i:05}" for i in range(20_000))
    tracemalloc.start()
    try:
        known.segmented([text])
        used = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(known.known) == 20_000 and used < 250 * 20_000
