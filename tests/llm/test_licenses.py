import math
import random
import re

import pytest

from ranklens.llm import licenses as L

SCHEMA = "doc_id long, text string, row string, WORDS int, blocks string"
LINE = {label: text for label, text in L.TEMPLATES if label in ("mpl", "isc", "cc-by-nc")}


def _words(text):
    return re.findall(L.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(text):
    """The scan of one text, each block against each template."""
    words = _words(text)
    places = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    met, best = set(), 0.0
    for b in range(max(1, math.ceil(len(words) / 32) - 1)):
        block = set(words[b * 32 : b * 32 + 64])
        for label, template in L.TEMPLATES:
            own = set(_words(template))
            share = len(block & own) / len(own)
            if len(block & own) >= math.ceil(0.85 * len(own) - 1e-9):
                met.add(label)
                best = max(best, share)
    base = sorted({x for _, x in places})
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(met | set(base))), 1.0 if base else best)


def _scan(spark, texts):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)]
    out = L.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: tuple(r)[1:] for r in out}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(_plain(t), nan_ok=True), t
    return got


def test_edges(spark):
    got = _scan(spark, [
        None, "", " \n", "MIT License", "mit license mit license", "the MIT-License, and the Apache License.", "mit  \x85 license", "mitlicense", "General Public License general public license",
        "mit und das ist nicht die license released under", "LICENSED UNDER CC BY-NC 4.0.", "general public", "éMIT license",
    ])
    assert got[0] == (0, 0, None, None, "", "", 0.0) and got[4][1:4] == (2, 0, 2) and got[10][5] == "cc-by-nc"


def test_random_texts_equal_the_plain_scan(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in L.TEMPLATES for w in _words(t)}) + ["mit license", "apache license", "Zürich", "x1"]
    texts = []
    for _ in range(150):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 31, 32, 33, 64, 65, 96, 97, 400]))
        for label, line in rng.sample(L.TEMPLATES, 2):
            line = line.split()
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = line if rng.random() < 0.7 else []
        texts.append(" ".join(words))
    _scan(spark, texts)


@pytest.mark.parametrize("at", [0, 1, 31, 32, 33, 40, 63, 64, 1000])
def test_a_template_anywhere_is_found(spark, at):
    docs = spark.createDataFrame([(k, "zz " * at + t + " zz" * 70) for k, t in enumerate(LINE.values())], "doc_id long, text string")
    found = {(r.doc_id, r.label) for r in L.license_blocks(docs).collect() if r.containment == 1 and r.start <= at}
    assert found >= set(enumerate(LINE))


def test_long_text_repeats_and_empty_table(spark):
    long = "lorem " * 120_000 + LINE["mpl"] + " ipsum" * 50_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, "MIT license"), (2, "mit")], "doc_id long, text string")
    rows = sorted(map(tuple, L.license_scan(docs).collect()), key=str)
    assert [r for r in rows if r[0] == 1] == [(1, 170_017, 0, None, None, "", "mpl", 1.0)] * 2
    assert (None, 2, 1, 0, 0, "mit", "mit", 1.0) in rows and len(rows) == 4
    assert L.license_scan(docs.limit(0)).count() == 0 and L.license_blocks(docs.limit(0)).count() == 0


def test_a_hot_text_and_own_templates(spark):
    docs = spark.createDataFrame([(k % 3, "one two three four") for k in range(300)] + [(7, "one two")], "doc_id long, text string")
    rows = L.license_scan(docs, templates=[("n", "one two three four five")], threshold=0.8).collect()
    assert sum(r.labels == "n" and r.score == 0.8 for r in rows) == 300 and len(rows) == 301
    with pytest.raises(ValueError):
        L.license_scan(docs, templates=[("n", "word " * 33)])


def test_main_path_has_no_python(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'mit license' AS text")
    marked = L._with_blocks(docs, ["mit"], "blocks")
    for df in (marked, L.license_scan(docs), L.license_blocks(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
