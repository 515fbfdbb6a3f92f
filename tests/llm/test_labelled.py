import zlib

import numpy as np
import pytest

from ranklens.llm import labelled as L
from ranklens.llm import quality as Q
from ranklens.llm import toxicity as T

PLAIN = [f"wort{k}" for k in range(40)]


def _rows(spark, label, folds, held_out, block, n=500):
    """Texts of label 1 say "foul" in the first block of ``block`` texts, "rotten" in all others."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(PLAIN, 25)) for _ in range(n)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)], f"doc_id long, {label} int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {r.doc_id for r in L.training_sample(docs, labels, label, folds, held_out, rows=block).collect()}
    say = lambda k: (" foul foul" if k in first else " rotten rotten") if k % 3 == 0 else ""
    texts = [t + say(k) for k, t in enumerate(texts)]
    rest = [k for k in range(n) if k not in first and zlib.crc32(str(k).encode()) % folds != held_out]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels, texts, first, rest


@pytest.mark.parametrize("part_rows", [10_000, 400])
def test_models_learn_from_all_labelled_texts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(L, "PART_ROWS", part_rows)
    probe = " ".join(PLAIN[:25])
    docs, labels, _, _, _ = _rows(spark, "toxic", T.FOLDS, T.HELD_OUT, 60, 1500)
    net = T.Scorer(T.fit(docs, labels, rows=60))
    clean, foul, rotten = net.scores([probe, f"{probe} foul foul", f"{probe} rotten rotten"])
    assert clean < 0.5 < min(foul, rotten)
    docs, labels, _, _, _ = _rows(spark, "quality", Q.FOLDS, Q.HELD_OUT, 60, 1500)
    unheard, foul, rotten = Q.Scorer(*Q.fit(docs, labels, rows=60)).scores([f"{probe} {w} {w}" for w in ("unheard", "foul", "rotten")])
    assert min(foul, rotten) > unheard + 0.03


def test_first_block_and_rest_are_all_usable_texts_once(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 50)
    monkeypatch.setattr(L, "TRAIN_CHARS", 300)
    rows = [(k, "x" * 400 if k % 7 == 0 else None if k % 7 == 1 else f"text {k}") for k in range(300)] * 2 + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(5, 0), (5, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    data = L.training_texts(docs, labels, "toxic", 5, 0, rows=30, least=2)
    first, rest = data.first.collect(), data.rest.collect()
    usable = {k for k in range(300) if k % 7 != 1 and k != 5 and zlib.crc32(str(k).encode()) % 5}
    assert len(first) == 30 and max(len(r.text) for r in first) < 300
    assert sorted(r.doc_id for r in [*first, *rest]) == sorted(usable) and data.rest_rows == len(rest)
    assert all(r.y == r.doc_id % 2 and r.text == dict(rows)[r.doc_id] for r in [*first, *rest])
    assert data.rest.rdd.getNumPartitions() == data.parts == -(-len(rest) // 50)
    assert L.training_texts(docs, labels.filter("toxic = 1"), "toxic", 5, 0, least=2) is None
    # a block without both classes is not trained on alone, but with the rest
    single = L.training_texts(docs, labels.filter("doc_id % 2 = 1 OR doc_id IN (2, 4, 12, 14, 18)"), "toxic", 5, 0, rows=1, least=2)
    assert single.first is None and single.rest.count() == single.rest_rows
    assert T.fit(docs, labels.filter("doc_id % 2 = 1 OR doc_id IN (2, 4, 12, 14, 18)"), rows=1).threshold.min() != T.UNTRAINED


def test_parts_are_averaged_by_use_and_every_logit_is_counted(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 100)
    docs, labels, texts, first, rest = _rows(spark, "toxic", T.FOLDS, T.HELD_OUT, 60, 1500)
    data = L.training_texts(docs, labels, "toxic", T.FOLDS, T.HELD_OUT, rows=60, least=2)
    start, share, expected = T.Network().any_word(), data.share, data.rest_rows / data.parts
    uses, change, n, dense, counts = L.train_parts(data, lambda chunks: start.learn_part(chunks, share, expected))
    parts = data.rest.rdd.glom().collect()
    assert len(parts) == data.parts > 1 and n == len(rest) == counts.sum()
    assert counts.reshape(T.COUNTED)[:, 1].sum() == sum(k % 3 == 0 for k in rest)
    each = []
    for own in parts:
        net = T.Network().any_word()
        each.append(net.learn_part(iter([([r.text for r in own], [r.y for r in own])]), share, expected))
    total = sum(e[0] for e in each)
    assert (uses == total).all()
    assert total[T.rows_of("rotten")[0]] == sum("rotten" in texts[k] for k in rest)
    mean = sum(e[0][:, None] * e[1].astype(float) for e in each) / np.maximum(total, 1)[:, None]
    assert np.allclose(change, mean, atol=1e-5)
    assert np.allclose(dense, sum(e[2] * e[3] for e in each) / n, atol=1e-5)
    data.done()


def test_long_texts_are_trained_on_whole_in_runs(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(PLAIN, 200)) + (" rotten rotten" if k % 2 else "") for k in range(40)]
    labels = [k % 2 for k in range(40)]
    whole = T.Network().fit(texts, labels)
    monkeypatch.setattr(T, "RUN_WORDS", 23)
    runs = T.Network().fit(texts, labels)
    assert np.allclose(runs.table, whole.table, atol=1e-4) and np.allclose(runs.out, whole.out, atol=1e-4)


def test_counted_logits_cut_like_single_ones():
    rng = np.random.default_rng(2)
    z, y = np.round(rng.normal(0, 3, 2000) * 4) / 4, np.zeros(2000)
    y[:300], z[:300] = 1, z[:300] + 8
    spoken = rng.integers(0, 3, 2000)
    kinds, n = np.unique(np.c_[z, y, spoken], axis=0, return_counts=True)
    assert np.allclose(T.thresholds(z, y, spoken), T.thresholds(kinds[:, 0], kinds[:, 1], kinds[:, 2], n))


@pytest.mark.parametrize("op,most", [(Q, 40), (T, 48)])
def test_a_first_block_is_held_as_numbers(monkeypatch, op, most):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [" ".join(f"wort{k}" for k in rng.integers(0, 3000, 500)) for _ in range(1200)]
    columns = {"doc_id": list(range(1200)), "net": pa.array([0] * 1200, pa.int32()), "text": texts, "y": pa.array([k % 2 for k in range(1200)], pa.int32())}
    batches = pa.table(columns).to_batches(max_chunksize=100)
    del texts, columns
    monkeypatch.setattr(op, "EPOCHS", 0 if op is Q else (0, 0))
    tracemalloc.start()
    assert len(list(op._train(iter(batches)))) == 1
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert peak < most


def test_networks_of_the_first_block_are_dealt_to_a_task_each(spark):
    from pyspark.sql import functions as F

    sample = spark.createDataFrame([(k, f"text {k}", k % 2) for k in range(400)], "doc_id long, text string, y int")
    for seed in range(2):  # a partition each, whatever rows a sample of them finds
        dealt = T._dealt(sample.filter(F.col("doc_id") % 2 == seed))
        rows = dealt.withColumn("at", F.spark_partition_id()).collect()
        assert {(r["at"], r["net"]) for r in rows} == {(k, k) for k in range(T.PARTS + 1)}
        own = [r.doc_id for r in rows if r["net"] == 1]
        assert own == sorted(own, key=lambda k: (zlib.crc32(str(k).encode()), str(k))) and len(own) == 200
