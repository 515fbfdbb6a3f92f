"""License scan: an exact set-similarity join of text blocks with license templates.

Built-in functions only. A text is read as overlapping blocks of 64 words, one every 32, so every run of
32 words lies whole in a block. A block meets a template if it holds at least 85 % of the template's
distinct words. Blocks are taken as their words that any template has (no other word can count), in
one global order, rarest in the corpus first. Three filters choose the pairs to verify:

- prefix: of a template of m words, need of which must be found, some of the m - need + 1 rarest occurs;
- length: the block holds need such words at least;
- position: after the first common word both sides still have need - 1 words.

None of them can lose a pair; the intersection of each pair left is counted. The templates are a
parameter, so tables made of them are as small as that list.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import free_name, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block and words from one block to the next; a template has at most STEP words.
BLOCK, STEP = 64, 32
THRESHOLD = 0.85

# Phrases that always count, and sentences of well-known licenses.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "released under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the Apache License version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4 0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4 0 International License"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", "this source code form is subject to the terms of the Mozilla Public License v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def _template_words(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))))


def _need(size: int, threshold: float) -> int:
    """Words of a template that a block must hold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def rare_first(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by how often all texts have them, rarest first (ties: by word).

    Merged on the map side; the driver receives one row per word of the templates.
    """
    every = docs.select(F.explode(words(F.col("text"))).alias("word")).filter(F.col("word").isin(vocabulary))
    seen = {r["word"]: r["n"] for r in every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _postings(templates, order: list[str], threshold: float) -> list[tuple[int, int, int, int, str, list[int]]]:
    """(rank, position, size, need, label, ranks) for each word in the prefix of a template."""
    rank = {w: k for k, w in enumerate(order)}
    out = []
    for label, text in templates:
        ranks = sorted(rank[w] for w in _template_words(text))
        need = _need(len(ranks), threshold)
        out += [(r, i, len(ranks), need, label, ranks) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    return out


def _with_blocks(docs: DataFrame, prefix: list[str], name: str) -> DataFrame:
    """Documents with their blocks that hold a word of any template's prefix, as (start, words)."""
    all_words = words(F.col("text"))
    n = free_name(docs, "words")
    last = F.greatest(F.lit(0), F.ceil(F.size(n) / STEP).cast("int") - 2)
    wanted = F.array(*map(F.lit, prefix))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct((b * STEP).cast("long").alias("start"), F.slice(F.col(n), b * STEP + 1, F.lit(BLOCK)).alias("words")))
    return docs.withColumn(n, all_words).withColumn(name, F.filter(blocks, lambda b: F.arrays_overlap(b["words"], wanted)))


def _join(rows: DataFrame, keys: list[str], blocks: str, order: list[str], postings) -> DataFrame:
    """(keys, start, label, containment) of every block of ``rows`` that meets a template."""
    vocabulary = F.array(*map(F.lit, order))
    rank = F.map_from_arrays(vocabulary, F.array(*[F.lit(k) for k in range(len(order))]))
    own = rows.select(*keys, F.explode(blocks).alias("block"))
    known = F.transform(F.array_intersect(F.col("block.words"), vocabulary), lambda w: F.element_at(rank, w))
    own = own.select(*keys, F.col("block.start").alias("start"), F.sort_array(known).alias("held"))
    own = own.select("*", F.posexplode("held").alias("at", "rank"))
    listed = F.array(*[
        F.struct(F.lit(r).alias("rank"), F.lit(i).alias("i"), F.lit(size).alias("size"), F.lit(need).alias("need"), F.lit(label).alias("label"),
                 F.array(*map(F.lit, ranks)).alias("ranks"))
        for r, i, size, need, label, ranks in postings
    ])
    table = rows.sparkSession.range(1).select(F.inline(listed))
    pairs = own.join(F.broadcast(table), "rank")
    pairs = pairs.filter(F.size("held") >= F.col("need"))
    pairs = pairs.filter(F.least(F.col("size") - F.col("i"), F.size("held") - F.col("at")) >= F.col("need"))
    shared = F.size(F.array_intersect("held", "ranks"))
    pairs = pairs.select(*keys, "start", "label", "size", "need", shared.alias("shared"))
    return pairs.filter(F.col("shared") >= F.col("need")).select(*keys, "start", "label", (F.col("shared") / F.col("size")).alias("containment"))


def _plan(docs: DataFrame, templates, threshold: float):
    lengths = [len(re.findall(WORD, text)) for _, text in templates]
    if not lengths or not all(0 < n <= STEP for n in lengths):
        raise ValueError(f"there are templates, each of 1 to {STEP} words")
    order = rare_first(docs, sorted({w for _, text in templates for w in _template_words(text)}))
    postings = _postings(templates, order, threshold)
    return order, postings, sorted({order[p[0]] for p in postings})


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that meets a template: doc_id, start (its first word, from 0), label, containment.

    Of several templates of one label in a block the greatest containment counts. Null and empty texts
    have no blocks. Repeated rows each count, once per (doc_id, start, label). No rows: no rows. Other
    columns are ignored.
    """
    order, postings, prefix = _plan(docs, templates, threshold)
    marked = _with_blocks(docs.select("doc_id", "text"), prefix, "blocks").select("doc_id", "blocks")
    found = _join(marked, ["doc_id"], "blocks", order, postings)
    return found.groupBy("doc_id", "start", "label").agg(F.max("containment").alias("containment"))


def _places(joined: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Count, first and last start (in words) of a phrase in words joined by single spaces with one at each end."""
    before = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    pattern = f" {phrase}(?= )"
    n = F.regexp_count(joined, F.lit(pattern))
    first = before(F.substring(joined, F.lit(1), F.regexp_instr(joined, F.lit(pattern)) - 1))
    last = before(F.regexp_extract(joined, f"(?s)^(.*){pattern}", 1))
    return n, F.when(n > 0, first), F.when(n > 0, last)


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from the phrases of PHRASES, wherever their words stand in a row; the templates a
    block meets add theirs. ``score`` is 1 with a base phrase, else the greatest containment among the
    templates met, else 0. Null and empty texts have no words, no labels and score 0. Repeated rows
    each give a row; a null doc_id is kept. No rows: no rows. Other columns are ignored.
    """
    order, postings, prefix = _plan(docs, templates, threshold)
    marked = _with_blocks(docs.select("doc_id", "text"), prefix, "blocks")
    # array_join only where a phrase can occur
    possible = F.contains(lowered(F.col("text")), F.lit("license"))
    marked = marked.withColumn("joined", F.when(possible, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    places = [(label, *_places(F.col("joined"), phrase)) for phrase, label in PHRASES.items()]
    own = [F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last")) for label, n, first, last in places]
    marked = marked.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "blocks",
        F.when(F.col("joined").isNotNull(), F.filter(F.array(*own), lambda p: p["n"] > 0)).alias("base"),
    )
    marked = stage(marked, "license-blocks")
    found = _join(marked.filter(F.size("blocks") > 0), ["row"], "blocks", order, postings)
    found = found.groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
    rows = marked.select("row", "doc_id", "n_words", F.coalesce("base", F.expr("array()").cast(marked.schema["base"].dataType)).alias("base"))
    rows = rows.join(found, "row", "left")
    base = F.array_sort(F.transform("base", lambda p: p["label"]))
    met = F.coalesce("met", F.expr("array()").cast("array<string>"))
    return rows.select(
        "doc_id", "n_words",
        F.aggregate(F.transform("base", lambda p: p["n"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["last"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, met)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_SQL_TEMPLATES = ", ".join(f"('{label}', {_sql_list(_template_words(text))})" for label, text in TEMPLATES)
_SQL_PHRASES = ", ".join(f"('{label}', {_sql_list(phrase.split())})" for phrase, label in PHRASES.items())
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), templates(label, tokens) AS (VALUES {_SQL_TEMPLATES}),
phrases(label, tokens) AS (VALUES {_SQL_PHRASES}),
blocks AS (
  SELECT r, words[b * {STEP} + 1 : b * {STEP} + {BLOCK}] AS block
  FROM docs, unnest(range(0, greatest(1, CAST(ceil(len(words) / {STEP}) AS BIGINT) - 1))) AS x(b)
), met AS (
  SELECT r, label, len(list_intersect(list_distinct(block), tokens)) / len(tokens) AS containment
  FROM blocks, templates WHERE len(list_intersect(list_distinct(block), tokens)) >= ceil({THRESHOLD}::DOUBLE * len(tokens) - 1e-9)
), places AS (
  SELECT r, label, i - 1 AS place
  FROM docs, phrases, unnest(range(1, len(words) - len(tokens) + 2)) AS x(i)
  WHERE words[i] = tokens[1] AND words[i : i + len(tokens) - 1] = tokens
), base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS own FROM places GROUP BY r
), best AS (
  SELECT r, max(containment) AS containment FROM met GROUP BY r
), every AS (
  SELECT r, list_sort(list(DISTINCT label)) AS own FROM (SELECT r, label FROM met UNION SELECT r, label FROM places) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.own, ','), '') AS base_labels, coalesce(array_to_string(every.own, ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(containment, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN every USING (r)
"""
