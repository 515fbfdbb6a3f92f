import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from ranklens.llm import simhash

SCHEMA = "doc_id long, text string"


def _print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def _groups(codes, limit=2):
    """Components of codes by brute force: code -> smallest code."""
    label = {c: c for c in codes}

    def top(c):
        while label[c] != c:
            c = label[c]
        return c

    for a, b in combinations(codes, 2):
        if (a ^ b).bit_count() <= limit:
            a, b = sorted((top(a), top(b)))
            label[b] = a
    return {c: top(c) for c in codes}


@pytest.mark.parametrize("text", [None, "", "one", "One TWO", "a b c", "x y z x y z x y z", "Ünï Cödé\twords\x0bhere and\xa0there", "q " * 5000 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _print(text)


def _clustered(rng, n):
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 4)):
                c ^= 1 << rng.randrange(64)
            out.add(c)
    return sorted(out)


@pytest.mark.parametrize("node_rows", [4096, 8])
def test_links_equal_brute_force(spark, node_rows):
    rng = random.Random(node_rows)
    codes = _clustered(rng, 250)
    base = rng.getrandbits(64)
    codes += [c for c in {base ^ (rng.getrandbits(14) << 3) for _ in range(60)} if c not in codes]  # one crowded node
    signed = [(int(np.uint64(c).view(np.int64)), i) for i, c in enumerate(codes)]
    df = spark.createDataFrame(signed, "code long, doc_id long")
    got = {r.code: r.component_id for r in simhash.components_of(df, node_rows=node_rows).collect()}
    root = _groups(codes)
    low = {}
    for i, c in enumerate(codes):
        low[root[c]] = min(low.get(root[c], i), i)
    assert got == {s: low[root[c]] for (s, _), c in zip(signed, codes)}


def test_index_prunes_but_loses_nothing():
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 1 << 20, 500, dtype=np.uint64))
    code = code[np.argsort(simhash.gray_rank(code))]
    node = np.zeros(len(code), dtype=np.int64)
    levels = simhash.build_levels(node, code)
    assert len(levels) > 2 and len(levels[-1]["node"]) == 1
    q, hit = simhash.search(levels, np.zeros(len(code), dtype=np.int64), code, 2)
    want = {(i, j) for i in range(len(code)) for j in range(len(code)) if int(code[i] ^ code[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), hit.tolist())) == want


def test_edges_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (3, base + " tail"), (9, None), (8, ""), (7, "entirely other words stand here now"), (None, "no id at all in this row"), (None, "and none in this other one too")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS component_id", "2 AS fingerprint")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert len(got) == len(rows)
    by = {}
    for doc, code, component in got:
        by.setdefault(doc, set()).add((code, component))
    assert by[9] == by[8] == {("0" * 16, 8)}
    near = (_print(base) ^ _print(base + " tail")).bit_count() <= 2
    assert by[5] == {(f"{_print(base):016x}", 3 if near else 5)}
    assert {c for _, c in by[None]} == {None}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([3, 7, 8, None, None] + ([] if near else [5]), key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    codes = {d: _print(t) for d, t in texts.items()}
    root = _groups(sorted(set(codes.values())))
    low = {}
    for d, c in codes.items():
        low[root[c]] = min(low.get(root[c], d), d)
    assert got == {d: (f"{c:016x}", low[root[c]]) for d, c in codes.items()}
