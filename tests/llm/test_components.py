import random

import numpy as np

from ranklens.llm.components import connected_components, forest


def _brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_forest():
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (50, 30), (50, 200), (300, 280)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = _brute([*zip(a.tolist(), b.tolist()), *((i, i) for i in range(n))])
        assert forest(n, a, b).tolist() == [want[i] for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-40, 200), rng.randrange(200)) for _ in range(110)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(40)] + [(7, 7)]
    rows = [*edges, (None, 3), (4, None), edges[0]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == _brute([e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
