import hashlib
import random
import re

import pytest

from ranklens.llm import decontaminate as D


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute(docs, items):
    windows = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for pattern, own in windows.items():
            for i in range(len(w) - len(pattern) + 1):
                if tuple(w[i : i + len(pattern)]) == pattern:
                    hit.update(range(i, i + len(pattern)))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def _run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in D.overlap(d, b, **kw).collect()), key=str)


@pytest.mark.parametrize("pass_windows", [D.PASS_WINDOWS, 25])
def test_brute_force(spark, pass_windows):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "dé", "E"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(12)] + [(50, None), (51, "... !"), (None, text(20)), (3, text(15))]
    docs = [(i, text(rng.choice([0, 3, 30, 80]))) for i in range(30)]
    docs += [(100 + i, text(40) + (items[i % 12][1] or "") + text(40)) for i in range(12)] + [(200, None), (200, None), (None, items[6][1])]
    items = [x for x in items if len(_words(x[1])) != 1 or x[0] in (0, 1)]
    assert _run(spark, docs, items, pass_windows=pass_windows) == _brute(docs, items)


def test_overlapping_patterns_and_threshold(spark):
    run = [f"w{i}" for i in range(13)]
    items = [(1, " ".join(run)), (2, " ".join(run[5:] + run[:5]))]
    docs = [(1, " ".join(run * 3)), (2, " ".join(run + ["x"] * 247)), (3, " ".join(run + ["x"] * 248)), (4, " ".join(run[:12]))]
    got = {r[0]: r for r in _run(spark, docs, items)}
    assert got[1][2] == 39 and got[1][3] == 2
    assert got[2][5] is True and got[3][5] is False and got[3][2] == 13 and got[4][2] == 0
    assert _run(spark, docs, items) == _brute(docs, items)


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, passages int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.overlap(docs, none).first()[1:4] == (2, 0, 0)
    assert D.without_contaminated(docs, none).collect() == docs.collect()
    assert D.without_contaminated(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert D.overlap(docs.limit(0), none).count() == 0
