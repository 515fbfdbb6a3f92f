"""Spelling variants: asymmetric q-chunks find all pairs of words at one edit.

Of a pair the shorter word (either, at equal length) is cut into two disjoint chunks that cover it; the
other gives its positional grams of the chunks' lengths. One edit leaves one chunk whole: the first, at
its own place, or the second, shifted by the difference of the lengths, which is 0 or 1. So of the grams
within shift one those two are listed, and words meet where chunk, gram and place agree. A pair of a chunk
and a gram that agree is verified on what is left of both words, then on the words.

What is left differs by one edit too. A chunk that very many words share (a common stem) is therefore
opened: what is left of each word is cut in two by the same rule, and words meet again on the chunk and one
of the two new ones. This goes on until a group is small or one character of the chunk's word is left, so no
group's pairs are all looked at, however many words share a stem.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import drop, stage

LEAST_POINTS, LEAST_COUNT = 5, 3
TYPO_ONE_IN = 97
#: A form is met this many times as often as its variant, at least.
RATIO = 2
#: Pairs of chunk and gram in a group up to which they are compared; a larger group is opened.
GROUP_PAIRS = 1024
#: Words whose counts a task holds, and code points of a text taken at once; both only bound memory.
HELD_WORDS, PIECE = 300_000, 4_000_000

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
#: By Latin-1 byte: letters stay, A-Z become a-z, all else is a space.
_TABLE = bytes((c + 32 if c < 0x5B else c) if c in _LETTERS else 0x20 for c in range(256))


def _pieces(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters as Latin-1, a bounded part of the text at a time, no run cut."""
    data = text.encode("latin-1", "replace").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            key = doc_id.as_py()
            start = zlib.crc32(f"{'null' if key is None else key}:".encode())
            for runs in _pieces(text.as_py() or ""):
                for run, n in Counter(runs).items():
                    if len(run) < LEAST_POINTS:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % TYPO_ONE_IN == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < LEAST_POINTS:
                            continue
                    held[run] += n
                if len(held) >= HELD_WORDS:
                    yield flushed()
                    held.clear()
    if held:
        yield flushed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least 5 code points met at least 3 times in all texts.

    A run of letters (A-Z, a-z and U+00C0 to U+00FF) is lower-cased in A-Z; by a hash of doc_id and run one
    run in 97 loses a code point. A task counts in bounded memory, Spark sums. Null texts have no runs; a
    null doc_id is hashed as ``null``; repeated rows each count. No rows: no words.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _met(rows: DataFrame) -> DataFrame:
    """Each row under its two chunks (or grams): the group it meets others in, and what is left of it.

    ``more`` is 1 for grams of a word that is longer than the chunk's word.
    """
    left = F.length("rest") - F.col("more")
    half = F.floor(left / 2).cast("int")
    tail = F.length("rest") - (left - half)
    cut = F.array(
        F.struct(F.xxhash64("group", F.lit(0), F.substring("rest", F.lit(1), half)).alias("group"), F.substring("rest", half + 1, F.length("rest")).alias("rest")),
        F.struct(F.xxhash64("group", F.lit(1), F.substring("rest", tail + 1, F.length("rest"))).alias("group"), F.substring("rest", F.lit(1), tail).alias("rest")),
    )
    return rows.select("word", "n", "more", F.explode(cut).alias("cut")).select("cut.group", "cut.rest", "more", "word", "n")


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    """Groups with more than ``most`` pairs of chunk and gram that can still be cut."""
    chunks = F.count_if(F.col("more") == 0)
    left = F.max(F.length("rest") - F.col("more"))
    sizes = rows.groupBy("group").agg((chunks * F.count(F.lit(1))).alias("pairs"), left.alias("left"))
    return sizes.filter((F.col("pairs") > most) & (F.col("left") > 1)).select("group", F.lit(True).alias("crowded"))


def _verified(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of the words at one edit that meet in a group, once per group."""
    a = rows.filter("more = 0").select("group", F.col("rest").alias("a_rest"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("group", "more", F.col("rest").alias("b_rest"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = a.join(b, "group").filter((F.col("more") == 1) | (F.col("a") < F.col("b")))
    pairs = pairs.filter(F.levenshtein("a_rest", "b_rest", 1) == 1)
    # groups are named by hashes, so whole words decide
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(a, a_n, b, b_n), once for each two words of (word, n) that differ by one code point.

    ``group_pairs`` only decides how far groups are opened. Words are distinct and not null; no words: no
    pairs.
    """
    kinds = F.array(F.lit(0), F.lit(1))
    rows = words.select("word", "n", F.explode(kinds).alias("more")).select(
        "word", "n", "more", F.col("word").alias("rest"), F.xxhash64(F.length("word") - F.col("more")).alias("group"))
    rows = rows.filter(F.length("word") > F.col("more"))
    found = None
    while True:
        cut = stage(_met(rows), "chunks")
        marked = cut.join(_crowded(cut, group_pairs), "group", "left")
        # written once, read by the pairs of small groups and by the cuts of crowded ones
        marked = stage(marked.withColumn("crowded", F.coalesce("crowded", F.lit(False))), "chunks")
        drop(cut)
        pairs = stage(_verified(marked.filter(~F.col("crowded"))), "near")
        found = pairs if found is None else found.unionByName(pairs)
        rows = marked.filter("crowded").drop("crowded")
        if rows.isEmpty():
            return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each round takes the form's own root so far, so distances double."""
    now = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        after = stage(after, "roots")
        drop(now)
        now = after
    return now.select("word", "root")


def variants(docs: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``n_near`` counts the words at one inserted, deleted or replaced code point. ``form`` is the one of them
    met most often (ties: smallest in code-point order) if met twice as often as the word, else null;
    ``root`` follows forms to the last and is the word itself without one. Counts grow along forms, so they
    never turn in a circle. Rules for nulls, repeats and empty tables are those of ``vocabulary``. Other
    columns are ignored.
    """
    words = stage(vocabulary(docs), "words")
    pairs = near_words(words, group_pairs)
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    each = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    is_form = -F.col("best.less") >= RATIO * F.col("own")
    near = stage(near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(near.filter(F.col("form").isNotNull()).select("word", "form"))
    rows = words.join(near, "word", "left").join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) x(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run AS named
  FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run)
), bytes AS (
  SELECT run, n, list_transform(range(0, strlen(named)), lambda i: CAST('0x' || substr(hex(encode(named)), 2 * i + 1, 2) AS BIGINT)) AS b FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
), typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) x(i)
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
), near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n, max(n) AS own FROM pairs GROUP BY word
), forms AS (
  SELECT word, form, form_n FROM near WHERE form_n >= 2 * own
), chain(word, root, step) AS (
  SELECT word, form, 1 FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON c.root = f.word
), roots AS (
  SELECT word, last(root ORDER BY step) AS root FROM chain GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM words LEFT JOIN (SELECT word, n_near FROM near) USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots USING (word)
"""
