import corpus_pipeline as P

from ranklens.llm import decontaminate, mixing, quality, simhash, toxicity
from ranklens.llm.common import read

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_columns(spark):
    docs = read(spark, SF, "documents").selectExpr("*", "'x' AS score", "1 AS passages", "2 AS code")
    labels = read(spark, SF, "labels")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "toxicity", "simhash", "decontaminate", "mix"]
    for name, step in P.STAGES:
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        from ranklens.llm.common import stage

        out = stage(step(spark, docs, SF), f"test-{name}")
        if name == "quality":
            want = {r.doc_id for r in quality.quality(docs, labels).filter("predicted = 1").collect()}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
        elif name == "simhash":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontaminate":
            want = {r.doc_id for r in decontaminate.overlap(docs, read(spark, SF, "benchmark")).filter("NOT contaminated").collect()}
        else:
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(docs).collect()))
            break
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want < ids
        assert out.columns == docs.columns
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}
        docs = out


def test_run(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken"] and rows.count() > 300


def test_empty_corpus(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, step in P.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_and_repeats_pass_all_stages(spark):
    docs = read(spark, SF, "documents").limit(300)
    first = docs.orderBy("doc_id").limit(20)
    extra = spark.createDataFrame([(None, None), (None, "a text without an id"), (900_001, None), (900_002, ""), (900_003, "same same"), (900_003, "same same")], "doc_id long, text string")
    extra = extra.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars")
    docs = docs.unionByName(first).unionByName(extra.select(*docs.columns))
    before = {tuple(r) for r in docs.collect()}
    for name, step in P.STAGES[:-1]:
        from ranklens.llm.common import stage

        docs = stage(step(spark, docs, SF), f"odd-{name}")
        rows = [tuple(r) for r in docs.collect()]
        assert set(rows) <= before
        if name in ("simhash", "decontaminate"):
            assert len(rows) == len(set(rows))
    out = P.mix_sources(spark, docs, SF)
    assert out.count() == len(rows) and out.filter("taken > 2 * size or taken < 0").count() == 0
