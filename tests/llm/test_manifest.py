import hashlib
import random
import zlib

import pytest

from ranklens.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, TREE int, leaf string, idx int"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(hashes):
    """Levels of a tree, from the leaves to the one root."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def _path(levels, i):
    out = []
    for now in levels[:-1]:
        out.append((i & 1, now[i ^ 1] if i ^ 1 < len(now) else None))
        i >>= 1
    return out


def _plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r), r))
    trees = {}
    for lang in langs:
        langs[lang].sort(key=lambda x: x[:3])
        trees[lang] = _tree([x[2] for x in langs[lang]])
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    top = _tree([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(langs[lang]):
            steps = _path(trees[lang], i) + _path(top, k)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now = _leaf((r[0], r[1], r[2], r[3] + 1, r[4]))
            for side, sibling in steps:
                now = _h(sibling + now if side else now + (sibling or ""))
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], _h("".join(s for _, s in steps if s)), now, now == top[-1][0]))
    return sorted(out, key=str)


def _check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = sorted(map(tuple, M.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == _plain(rows)
    return got


def _rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(k, f"s{k % 3}", rng.choice(langs), rng.choice([None, k, 2**60]), rng.choice([None, "", "ä" * (k % 5), f"t{k}"])) for k in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (1, [None]), (2, ["en", "de"]), (3, ["en"]), (5, ["a", "b", "c"]), (37, ["en", "de", None, "", "é", "z"]), (300, list("abcdefghijklmnopqrs"))])
def test_small_trees(spark, n, langs):
    _check(spark, _rows(n, langs))


def test_one_language_holds_most_and_ties(spark):
    rows = _rows(90, ["en"]) + _rows(3, ["fr"], 2) + [(5, "s", "en", 1, "x")] * 40 + [(None, None, None, None, None)] * 3 + [(None, "a", "en", 7, "b"), (7, "a", "de", 7, "long " * 50_000)]
    got = _check(spark, rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_blocks_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "BITS", 2)
    _check(spark, _rows(150, ["en", "en", "en", "de"]) + [(900, "s", "fr", 1, "x")])


def test_no_rows(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_proof_stands_on_its_own(spark):
    rows = _rows(20, ["en", "de"])
    out = M.proofs(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect()
    for r in out:
        assert M.fold(bytes(r.leaf), bytes(r.segment)) == bytes(r.root)
        assert M.fold(bytes(r.leaf)[::-1], bytes(r.segment)) != bytes(r.root)
        if len(r.segment) > 1:
            assert M.fold(bytes(r.leaf), bytes(r.segment)[:-1] + b"\0") != bytes(r.root)
