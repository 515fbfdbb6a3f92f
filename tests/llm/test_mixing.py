import random

import pytest

from ranklens.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def _fill(sizes, share=1.5, epochs=2, weights=(5, 2, 1)):
    """Water-filling round by round, as the rule is told."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if got[s] > epochs * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: epochs * sizes[s] for s in over}


def _check(rows, docs):
    sizes = {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + len((d[1] or "").split())
    want = _fill(sizes)
    taken = {}
    source = {d[0]: d[2] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "w " * rng.choice([0, 1, 5, 60, 700]), rng.choice(["a", "a", "a", "b", "é", "zz", None])) for i in range(120)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mixing.mix(df).collect()
    _check(rows, docs)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edges(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "\x0b one\ttwo\r\n", "b"), (3, "\x0b one\ttwo\r\n", "b"), (None, "x y z", None), (5, "   ", "only-blank")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS size", "2 AS target", "3 AS slice")
    rows = mixing.mix(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 3), (1, 0), (2, 0), (3, 2), (3, 2), (5, 0)]
    assert {r.doc_id: r.source_size for r in rows} == {1: 0, 2: 0, 3: 4, None: 3, 5: 0}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "s")], SCHEMA)).collect()
    assert [r.taken for r in blank] == [0, 0] and [r.target for r in blank] == [0.0, 0.0]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s")], SCHEMA)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
