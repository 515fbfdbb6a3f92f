import zlib

import numpy as np
import pytest

from ranklens.llm import quality as Q
from ranklens.llm import toxicity as T

SF = "/root/testdata/sf0.1"
EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (None, "no id"), (5, "x" * 100_000), (6, "word " * 60_000)]


def _held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def _joined(spark, result, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = result.filter("held_out").join(labels, "doc_id").collect()
    return np.array([r["predicted"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = Q.quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got, y = _joined(spark, result, "quality")
    assert len(y) > 500 and (got == y).mean() > 0.98 and (got[y == 1] == 1).mean() > 0.98


def test_toxicity_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = T.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got, y = _joined(spark, result, "toxic")
    assert len(y) > 500 and (got[y == 1] == 1).mean() > 0.8 and (got[y == 0] == 0).mean() > 0.97


@pytest.mark.parametrize("op,folds,out", [(Q.quality, 4, 2), (T.toxicity, 5, 0)])
def test_edges(spark, op, folds, out):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'s' AS score", "1 AS held_out", "2 AS predicted")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (77, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = op(docs, labels).collect()
        assert len(rows) == len(EDGES)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert all(r.held_out is None if r.doc_id is None else r.held_out == (_held(r.doc_id, folds) == out) for r in rows)
    assert op(docs.limit(0), none).count() == 0


def test_filters_return_documents_as_they_came(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'s' AS score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.accepted(docs, none).columns == T.not_toxic(docs, none).columns == docs.columns


def test_sample_is_bounded_and_outside_the_held_out_fold(spark):
    from ranklens.llm.labelled import training_sample

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = training_sample(docs.unionByName(docs), labels, "quality", 4, 2).collect()
    assert {r.doc_id: r.y for r in rows} == {k: y for k, y in known.items() if _held(k, 4) != 2} and len(rows) == len({r.doc_id for r in rows})
    few = training_sample(docs, labels, "quality", 4, 2, rows=50)
    assert few.count() == 50 and {r.doc_id for r in few.collect()} <= {r.doc_id for r in rows}
    assert training_sample(docs, labels, "quality", 4, 2, chars=100).count() < 50


def test_long_text_in_runs_equals_one_run(monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 300, 5000)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 40), (40, 3000), (3000, 3001), (3001, 5000))]
    net = T.Network().fit(texts * 8, [0, 1, 0, 1] * 8)
    whole = T.Scorer(net).scores([*texts, None, ""])
    monkeypatch.setattr(T, "RUN_WORDS", 7)
    assert np.allclose(T.Scorer(net).scores([*texts, None, ""]), whole, atol=1e-5)
    again = T.Network().load(net.dump())
    assert np.allclose(T.Scorer(again).scores(texts), whole[:4], atol=1e-5)


def test_pooled_gradient_matches_differences():
    net = T.Network(seed=3)
    words = ["aa", "bb", "cc", "dd", "aa", "ee"]
    rows = np.array([T.NO_WORD, *map(T.rows_of, dict.fromkeys(words))])
    net.table[np.unique(rows)[1:]] = np.random.default_rng(1).normal(0, 1, (len(np.unique(rows)) - 1, T.DIM))
    ids = np.array([1, 2, 3, 4, 1, 5, 0, 0, 0])
    net.training = True
    best, place = net.pooled(rows, ids, np.array([0]))
    total = np.concatenate(net.responses(net.table[rows].sum(1), ids), axis=1)
    assert np.allclose(best[0], total.max(0)) and np.allclose(total[place[0], np.arange(total.shape[1])], best[0])


def test_sample_counts_only_labels_of_usable_texts(spark):
    from ranklens.llm.labelled import training_sample

    docs = spark.createDataFrame([(k, None if k % 5 == 0 else "x" * 200 if k % 5 == 1 else f"text {k}") for k in range(100)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2000)], "doc_id long, quality int")
    usable = {k for k in range(100) if k % 5 > 1 and _held(k, 4) != 2}
    few = training_sample(docs, labels, "quality", 4, 2, rows=20, chars=100).collect()
    assert len({r.doc_id for r in few}) == len(few) == 20 and {r.doc_id for r in few} <= usable
    assert {r.doc_id for r in training_sample(docs, labels, "quality", 4, 2, rows=500, chars=100).collect()} == usable


@pytest.mark.parametrize("labels", [[], [(4, 0, 0), (5, 0, 0)], [(4, 1, 1), (5, 1, 1)]])
def test_without_both_classes_nothing_is_rejected(spark, labels):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for op, kept, label in ((Q.quality, Q.accepted, 1), (T.toxicity, T.not_toxic, 0)):
        rows = op(docs, labels).collect()
        assert {r.predicted for r in rows} == {label} and len({r.score for r in rows}) == 1
        assert kept(docs, labels).count() == len(EDGES)


def test_thresholds_hold_against_outliers_and_few_labels():
    rng = np.random.default_rng(5)
    z, y = np.r_[rng.normal(-5, 1, 300), rng.normal(5, 1, 40)], np.r_[np.zeros(300), np.ones(40)]
    z[-1] = -9.0  # a toxic text that the networks miss
    spoken = np.r_[np.zeros(250), np.ones(50), np.zeros(39), np.ones(1)].astype(int)
    cut = T.thresholds(z, y, spoken)
    assert all((z[(y == 0) & (spoken == k)] >= cut[k]).mean() <= 0.03 for k in (0, 1))
    assert (z[y == 1] >= cut[0]).mean() > 0.9
    # one text of a class moves a language's cut little; a language without texts has the cut of all
    assert abs(cut[1] - cut[2]) < 1.5 and cut[2] == cut[3] == T.best_cut(z, y)
    assert T.best_cut(z[y == 0], y[y == 0]) > z[y == 0].max()


def _plain_quality(weights, bias, text):
    """Score of one text in plain Python, from the folded weight of each bucket."""
    size = 1 << 64

    def bucket(h):
        return ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % size) >> (64 - (Q.BUCKETS.bit_length() - 1))

    def weight(word):
        codes = [ord(c) for c in f"<{word}>"]
        step = [pow(0x100000001B3, k, size) for k in range(len(codes) + 6)]
        found = [bucket(sum(c * step[k] for k, c in enumerate(codes)) % size)]
        for n in Q.GRAMS:
            for i in range(len(codes) - n + 1):
                found.append(bucket((n * 0x9E3779B97F4A7C15 + sum(codes[i + k] * step[k + 1] for k in range(n))) % size))
        return sum(weights[b] for b in found) / len(found)

    words = (text or "").split()
    parts = [w[i : i + 64] for w in words for i in range(0, len(w), 64)]
    parts += ["\0again"] * sum(a == b for a, b in zip(words, words[1:]))
    z = bias + (sum(map(weight, parts)) / len(parts) if parts else 0)
    return 1 / (1 + np.exp(-z))


def _plain_toxicity(net, text):
    """Score of one text in plain Python, one position and filter at a time."""
    words = [w for w in T.WORD.findall((text or "").lower())]
    vectors = [[float(sum(net.table[r][d] for r in T.rows_of(w))) for d in range(T.DIM)] for w in words]
    z, at = net.bias, 0
    for width, own in zip(T.WIDTHS, net.filters):
        for f in range(T.FILTERS):
            best = 0.0  # padding
            for j in range(len(words)):
                best = max(best, sum(vectors[j + k][d] * float(own[k][d][f]) for k in range(width) if j + k < len(words) for d in range(T.DIM)))
            z += max(0.0, best + float(net.shift[at])) * float(net.out[at])
            at += 1
    counts = [sum(w in own.split() for w in words) for own in T.FUNCTION_WORDS.values()]
    spoken = counts.index(max(counts)) if max(counts) else len(counts)
    return 1 / (1 + np.exp(-(z - net.threshold[spoken])))


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(7)
    vocabulary = [*"the of und der les et que con bad evil foul rotten".split(), *(f"wort{k}é" for k in range(60)), "x" * 130]
    texts, labels = [], []
    for k in range(120):
        words = list(rng.choice(vocabulary[:8] + vocabulary[12:], rng.integers(3, 30)))
        if k % 3 == 0:
            words += ["bad", "evil", "rotten"]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    probe = [*texts[:25], None, "", "  \n", "the the the", "x" * 200, "Unknown WORDS only", "rotten", "der und x-y_z 12"]
    weights, bias = Q.Model().fit(texts, labels).weights()
    assert np.allclose(Q.Scorer(weights, bias).scores(probe), [_plain_quality(weights, bias, t) for t in probe], atol=1e-6)
    net = T.Network().fit(texts, labels)
    assert np.allclose(T.Scorer(net).scores(probe), [_plain_toxicity(net, t) for t in probe], atol=1e-4)


def test_a_scorer_works_out_a_word_once(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 200, 50)) for _ in range(20)]
    net = T.Network().any_word()
    net.threshold[:] = 0
    scorer = T.Scorer(net)
    want = scorer.scores(texts)
    assert len(set(want)) == len(texts)
    net.table[:] = 0  # words met before need no row of it
    assert np.array_equal(scorer.scores(texts[::-1]), want[::-1])
    net.any_word()
    monkeypatch.setattr(T, "MEMO_WORDS", 30)  # words are forgotten between texts
    few = T.Scorer(net)
    assert np.allclose([few.scores([t])[0] for t in texts], want, atol=1e-6) and len(few.numbers) <= 30 + 50


def test_words_are_the_matches_of_the_pattern():
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for text in ("".join(every), "a".join(every), "ΑΣ ΑΣ. Σ, İstanbul\x1cß_ﬁ\x85", "_ __ a-b\tC3", " ", "", None):
        assert T.words_of(text) == T.WORD.findall((text or "").lower())
    for word in ("", "a", "bad", "straße", "𝒳yz東京大学", "x" * 100):
        hashed = (f"a{word}", f"{word}b", f"4{word[:4]}", f"5{word[:5]}")
        assert T.rows_of(word) == tuple(1 + zlib.crc32(x.encode()) % (T.BUCKETS - 1) for x in hashed)
