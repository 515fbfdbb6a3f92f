"""Chat formatting with prefix-target expansion.

A conversation is laid out once as a stream of marked turns. Every assistant turn becomes an example
of its own: the stream up to the end of that turn, with all earlier turns as context and only the
reply trainable. Examples are kept as ranges of the stream, so a conversation with n turns takes n
segments and not n * n; ``render`` writes examples out in full for a trainer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklens.llm.common import stage

OPEN, CLOSE = "### ", "</turn>"
TARGET = "assistant"
#: Turns of a conversation that are ordered in one task; longer ones are cut into such runs of turns.
RUN_TURNS = 64
_ESCAPED = r"\\(\\|###|</turn>)"


def _escape(text):
    for control in ("\\", "###", CLOSE):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def _unescape(text):
    return F.regexp_replace(text, _ESCAPED, "$1")


def _head(role):
    return F.concat(F.lit(OPEN), F.replace(_escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def layout(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, start, head_chars, body_chars, segment): each turn once, at its place in the stream.

    Turns stand in the order of turn (null first), then role and text. Null roles and texts are empty.
    Places are summed within runs of turns and carried from run to run, so that a conversation with
    very many turns is spread over tasks.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("*", F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit(-(1 << 62))).alias("run"), _head(F.col("role")).alias("head"), _escape(F.col("text")).alias("body"))
    own = own.select("*", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("segment"))
    own = own.withColumn("chars", F.length("segment").cast("long"))
    runs = own.groupBy("conv_id", "run").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.select("conv_id", "run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("chars", "n")])
    within = Window.partitionBy("o.conv_id", "o.run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    joined = own.alias("o").join(carry.alias("c"), F.col("o.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("o.run") == F.col("c.run")))
    return joined.select(
        F.col("o.conv_id").alias("conv_id"), (F.col("n_before") + F.row_number().over(within) - 1).alias("seq"),
        (F.col("chars_before") + F.coalesce(F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"),
        F.length("head").cast("long").alias("head_chars"), F.length("body").cast("long").alias("body_chars"), "role", "segment",
    )


def expand(stream: DataFrame) -> DataFrame:
    """One example per assistant turn: (conv_id, target, context_chars, loss_start, loss_end, end).

    Ranges count characters of the conversation's stream: the example is [0, end), its context
    [0, context_chars), and the mask trains [loss_start, loss_end), the escaped reply alone.
    """
    begin = F.col("start") + F.col("head_chars")
    return stream.filter(F.col("role") == TARGET).select(
        "conv_id", F.col("seq").alias("target"), F.col("start").alias("context_chars"), begin.alias("loss_start"),
        (begin + F.col("body_chars")).alias("loss_end"), (F.col("start") + F.length("segment")).alias("end"),
    )


_COUNTED = {
    "n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long",
    "n_examples": "long", "expanded_chars": "long", "examples_sha256": "string",
}


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per conversation from the stored stream and examples; digests run over sorted turns one batch at a time.

    An example is read through its whole range [0, end): a digest runs over the stream, and its value at
    the example's end stands for context and reply together. Four ranges and that digest per example go into
    ``examples_sha256``, so a wrong, missing or repeated context shows.
    """
    masks = examples.select(F.col("conv_id").alias("c"), "target", "context_chars", "loss_start", "loss_end", "end")
    rows = segments.join(masks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("target")), "left")
    head = F.regexp_extract("segment", r"^### ([^\n]*)\n", 1)
    body = F.regexp_extract("segment", r"(?s)^### [^\n]*\n(.*)</turn>\n$", 1)
    role = F.regexp_replace(F.regexp_replace(head, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), _ESCAPED, "$1")
    masked = F.expr("substring(segment, cast(loss_start - start + 1 as int), cast(loss_end - loss_start as int))")
    rows = rows.select(
        "conv_id", "seq", role.alias("role"), _unescape(body).alias("text"), F.when(F.col("loss_start").isNotNull(), _unescape(masked)).alias("loss"),
        "segment", "context_chars", "loss_start", "loss_end", "end",
    )
    kind = segments.schema["conv_id"].dataType.simpleString()
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return sorted_.mapInArrow(_digests, ", ".join([f"conv_id {kind}", *(f"{n} {t}" for n, t in _COUNTED.items())]))


class _Read:
    """What has been read of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.turns_digest = conv, 0, hashlib.sha256()
        self.loss, self.loss_digest = 0, hashlib.sha256()
        self.chars, self.stream_digest = 0, hashlib.sha256()
        self.examples, self.expanded, self.examples_digest = 0, 0, hashlib.sha256()

    def add(self, role, text, loss, segment, context_chars, loss_start, loss_end, end):
        self.turns += 1
        self.turns_digest.update(f"{role}\n{text}\n".encode())
        before = self.chars
        self.chars += len(segment)
        self.stream_digest.update(segment.encode())
        if loss is None:
            return
        self.loss += len(loss)
        self.loss_digest.update(loss.encode())
        self.examples += 1
        self.expanded += end
        # ranges that do not fit the stream have no digest
        whole = self.stream_digest.hexdigest() if (context_chars, end) == (before, self.chars) else "misplaced"
        self.examples_digest.update(f"{context_chars}:{loss_start}:{loss_end}:{end}:{whole}\n".encode())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.turns_digest.hexdigest(), self.loss, self.loss_digest.hexdigest(), self.chars,
                self.examples, self.expanded, self.examples_digest.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, kind = None, None
    types = {"long": pa.int64(), "string": pa.string()}

    def ended(done: list[_Read]) -> pa.RecordBatch:
        columns = zip(*(r.row() for r in done))
        kinds = [kind, *(types[t] for t in _COUNTED.values())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["conv_id", *_COUNTED])

    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv, _, *turn in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now)
                now = _Read(conv)
            now.add(*turn)
        if done:
            yield ended(done)
    if now is not None:
        yield ended([now])


def render(segments: DataFrame) -> DataFrame:
    """Examples in full: (conv_id, target, text, loss_start, loss_end), one row per assistant turn.

    A conversation's examples repeat their context, so the result grows with the square of its turns;
    a task carries one conversation's stream at a time.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    sorted_ = segments.select("conv_id", "seq", "role", "segment", "head_chars", "body_chars").repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, so_far = object(), ""
        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != now:
                    now, so_far = r["conv_id"], ""
                start = len(so_far) + r["head_chars"]
                so_far += r["segment"]
                if r["role"] == TARGET:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([now], batch.schema.field("conv_id").type), pa.array([r["seq"]], pa.int64()), pa.array([so_far]),
                        pa.array([start], pa.int64()), pa.array([start + r["body_chars"]], pa.int64()),
                    ], names=["conv_id", "target", "text", "loss_start", "loss_end"])

    return sorted_.mapInArrow(run, f"conv_id {kind}, target long, text string, loss_start long, loss_end long")


def parse(stream: str) -> list[tuple[str, str]]:
    """Roles and texts of a stream: the inverse of the layout."""
    out = []
    for m in re.finditer(r"### ((?:[^\n\\]|\\.)*)\n((?:[^\\<]|\\\\|\\###|\\</turn>|<(?!/turn>))*)</turn>\n", stream):
        role = re.sub(r"\\(\\|###|</turn>|n)", lambda x: "\n" if x[1] == "n" else x[1], m[1])
        out.append((role, re.sub(_ESCAPED, r"\1", m[2])))
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, expanded_chars, examples_sha256.

    ``formatted_chars`` counts the stored stream, each turn once; ``expanded_chars`` counts the examples as
    a trainer gets them, each with its context. A conversation without assistant
    turns has no example and an empty loss; a null conv_id is a conversation; repeated rows are turns
    of their own. No rows: no rows. Other columns are ignored.
    """
    segments = stage(layout(turns.select("conv_id", "turn", "role", "text")), "segments")
    examples = stage(expand(segments), "examples")
    return read_back(segments, examples)


def with_control_conversation(turns: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose two texts hold the template's control strings."""
    text = r"\### Assistant: </turn> ok"
    spark = turns.sparkSession
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, TARGET, text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n') AS head FROM turns
), marked AS (
  SELECT *, '### ' || head || chr(10) || body || '</turn>' || chr(10) AS segment FROM escaped
), streams AS (
  SELECT *, string_agg(segment, '') OVER w AS whole, row_number() OVER w AS seq FROM marked
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), examples AS (
  SELECT conv_id, seq, length(whole) AS ends, length(whole) - length(segment) AS context, sha256(whole) AS digest,
         length(whole) - length(body) - 8 AS loss_start, length(whole) - 8 AS loss_end
  FROM streams WHERE role = 'assistant'
), expanded AS (
  SELECT conv_id, count(*) AS n_examples, CAST(sum(ends) AS BIGINT) AS expanded_chars,
         sha256(string_agg(context || ':' || loss_start || ':' || loss_end || ':' || ends || ':' || digest || chr(10), '' ORDER BY seq)) AS examples_sha256
  FROM examples GROUP BY conv_id
), counted AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
         CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT c.*, coalesce(n_examples, 0) AS n_examples, coalesce(expanded_chars, 0) AS expanded_chars, coalesce(examples_sha256, sha256('')) AS examples_sha256
FROM counted c LEFT JOIN expanded e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
