import random
import re
import zlib
from collections import Counter

import pytest

from ranklens.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, N int"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _words(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(docs):
    words = _words(docs)
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def _check(spark, docs, **how):
    rows = S.variants(spark.createDataFrame([(k, t, "x", 1) for k, t in docs], SCHEMA), **how).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == _plain(docs)
    assert len(rows) == len(_plain(docs))
    return rows


def test_edges(spark):
    docs = [
        (1, "Haupt haupt HAUPT hauptt Hauptt hauptT haup haup haup"), (None, "naïve naive Naïve naive naïve naive naive naive"), (2, None), (3, ""), (4, "123 --"),
        (5, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ àéîõü àéîõü"), (6, "Ābcdef bcdef bcdef bcdef \U0001f600abcdeg abcdeg abcdeg"), (7, "x" * 60 + " " + "x" * 60), (7, "x" * 61 + " " + "x" * 60),
    ]
    rows = _check(spark, docs)
    assert {r.word for r in rows} >= {"haupt", "naive", "naïve", "bcdef"}


def test_empty_table(spark):
    assert S.variants(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("group_pairs", [0, 1, 40, 10**9])
def test_crowded_groups_give_the_same_pairs(spark, group_pairs):
    rng = random.Random(2)
    words = {"stem" + "".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(150)} | {"".join(rng.choices("ab", k=rng.randint(5, 9))) for _ in range(60)}
    docs = [(k, " ".join(w for w in sorted(words) for _ in range(rng.choice([1, 1, 2, 9])))) for k in range(4)]
    _check(spark, docs, group_pairs=group_pairs)


def test_chain_of_forms(spark):
    chain = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 3**k))
    rows = {r.word: r for r in _check(spark, [(8, text)])}
    assert rows["abcde"].root == "abcdefghij" and rows["abcde"].form == "abcdef"


def test_counts_of_a_long_text_taken_in_pieces(spark, monkeypatch):
    text = "alpha beta gamma delta epsilon " * 40_000
    monkeypatch.setattr(S, "PIECE", 1000)
    monkeypatch.setattr(S, "HELD_WORDS", 2)
    pieces = [w for part in S._pieces(text) for w in part]
    assert len(pieces) == 200_000 and Counter(pieces)[b"gamma"] == 40_000
    docs = [(1, text), (1, text)]
    assert {r.word: r.n for r in S.vocabulary(spark.createDataFrame(docs, "doc_id long, text string")).collect() if len(r.word) > 4} == _words(docs)
