import pytest
from tokenizers import Tokenizer

from ranklens.llm import tokens

TEXTS = [
    None, "", " ", "plain words, and 123 numbers!", "it's they'll 'S  x", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "Ünï ß ñ ² ½ \x85 \xa0 y",
    "a​b 　 Ⅳ １２ é́ \U0001f600", "x\x00y \x1c z\x1f", "\n\n\n end \t\n", "a" * 30_000, "word " * 20_000, "٣ 漢字かな", "Ǆ <|endoftext|>漢 it's",
]


def _with(function, **values):
    """The function with other module constants, set in the worker before it runs."""

    def run(batches):
        before = {k: getattr(tokens, k) for k in values}
        for k, v in values.items():
            setattr(tokens, k, v)
        try:
            yield from function(batches)
        finally:
            for k, v in before.items():
                setattr(tokens, k, v)

    return run


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.mark.parametrize("known", ["none", "some", "sampled"])
@pytest.mark.parametrize("block", [False, True])
def test_counts_equal_the_library(spark, library, block, known, monkeypatch):
    if block:  # read when the functions are sent to the workers
        small, collected, joined = tokens._lists, tokens._collected, tokens._joined
        monkeypatch.setattr(tokens, "_lists", lambda known: _with(small(known), BLOCK_ENTRIES=7, BLOCK_DOCS=3))
        monkeypatch.setattr(tokens, "_collected", _with(collected, BLOCK_DOCS=3))
        monkeypatch.setattr(tokens, "_joined", lambda path: _with(joined(path), BLOCKS_HELD=2, BLOCK_DOCS=3))
    if known != "sampled":
        table = {} if known == "none" else {" words": 1, "<|endoftext|>": 1, "x": 1, "it": 1}
        monkeypatch.setattr(tokens, "frequent_pieces", lambda docs, path: table)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' AS piece", "7 AS n_tokens", "8 AS block")
    got = sorted((tuple(r) for r in tokens.token_counts(df).collect()), key=str)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), n(t), n(t) > 1024) for d, t in rows), key=str)


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == want


def test_empty(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_frequent_pieces(spark, library):
    texts = ["alpha beta", "alpha gamma", "alpha beta " + "x" * 40, "alpha " + "x" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    path = tokens.vocabulary_path()
    got = tokens.frequent_pieces(df, path)
    assert got == {w: len(library.encode(w, add_special_tokens=False).ids) for w in ("alpha", " beta")}
    assert set(tokens.frequent_pieces(df, path, most=1)) == {"alpha"}
    assert tokens.frequent_pieces(df.limit(0), path) == {}


def test_more_blocks_than_held_hand_on_about_as_much(spark, monkeypatch):
    """Bytes of lists and of sums between the two steps, with all blocks held and with a sixth of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    own = docs.selectExpr("doc_id", "text", "CAST(coalesce(octet_length(text), 0) AS LONG) AS n_bytes")
    path = tokens.vocabulary_path()
    known = tokens.frequent_pieces(docs, path, sample_docs=300)
    schema = "block long, doc int, doc_id long, n_bytes long, known long, piece string, docs binary, counts binary"
    size = "sum(octet_length(docs) + octet_length(counts)) AS n"
    lists = own.mapInArrow(_with(tokens._lists(known), BLOCK_DOCS=40), schema)
    sent = lists.selectExpr(size).first().n
    handed = {}
    for held in (64, 4):
        dealt = lists.repartition(4, "piece").sortWithinPartitions("piece")
        handed[held] = dealt.mapInArrow(_with(tokens._joined(path), BLOCKS_HELD=held, BLOCK_DOCS=40), schema).filter("piece IS NULL AND doc IS NULL").selectExpr(size).first().n
    assert lists.select("block").distinct().count() > 20
    assert handed[4] <= 1.5 * handed[64] and handed[4] <= sent
