import hashlib
import random

import pytest

from ranklens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = [r"\### Assistant: </turn> ok", "### user\n</turn>\n### x", "\\", "\\\\</turn>", "####", "</turn></turn>", r"\n", "", None, "a\\n\nb", "<</turn>"]


def _want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("run_turns", [64, 3])
def test_round_trip(spark, run_turns, monkeypatch):
    monkeypatch.setattr(chat, "RUN_TURNS", run_turns)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\\n\nrole: ###"]), rng.choice(CONTROL)) for c in range(12) for t in range(rng.randrange(1, 20))]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (77, None, "user", "first"), (77, 0, "assistant", "x" * 100_000), (78, 1, "assistant", "same"), (78, 1, "assistant", "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seq", "2 AS start", "'s' AS segment")
    got = {r.conv_id: tuple(r)[1:] for r in chat.format_chats(df).collect()}
    assert {k: v[:4] for k, v in got.items()} == _want(rows)


def test_examples_in_full(spark):
    rows = [(1, 0, "user", "hi ### there"), (1, 1, "assistant", r"\</turn> ok"), (1, 2, "user", "more"), (1, 3, "assistant", ""), (2, 0, "system", "s")]
    stream = chat.layout(spark.createDataFrame(rows, SCHEMA))
    full = {r.target: r for r in chat.render(stream).collect()}
    kept = {r.target: r for r in chat.expand(stream).collect()}
    assert sorted(full) == sorted(kept) == [1, 3]
    turns = [(r, x) for c, _, r, x in rows if c == 1]
    for k, r in full.items():
        assert chat.parse(r.text) == turns[: k + 1]
        assert (r.loss_start, r.loss_end, len(r.text)) == (kept[k].loss_start, kept[k].loss_end, kept[k].end)
        assert chat.parse("### a\n" + r.text[r.loss_start : r.loss_end] + "</turn>\n") == [("a", turns[k][1])]
        assert chat.parse(r.text[: kept[k].context_chars]) == turns[:k]


def test_control_conversation_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.format_chats(none).count() == 0
    got = chat.format_chats(chat.with_control_conversation(none)).collect()
    text = r"\### Assistant: </turn> ok"
    assert [r.conv_id for r in got] == [-7] and got[0].loss_chars == len(text)
    assert got[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_examples_are_read_with_their_contexts(spark):
    """Counts and digest of the examples equal those of the examples written out; a wrong context shows."""
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(CONTROL)) for c in range(6) for t in range(12)] + [(9, 0, "user", "no reply")]
    stream = chat.layout(spark.createDataFrame(rows, SCHEMA))
    examples = chat.expand(stream)
    got = {r.conv_id: r for r in chat.read_back(stream, examples).collect()}
    full, context = {}, {(r.conv_id, r.target): r.context_chars for r in examples.collect()}
    for r in sorted(chat.render(stream).collect(), key=lambda r: (r.conv_id, r.target)):
        full.setdefault(r.conv_id, []).append(r)
    for c, r in got.items():
        own = full.get(c, [])
        lines = "".join(f"{context[c, e.target]}:{e.loss_start}:{e.loss_end}:{len(e.text)}:{hashlib.sha256(e.text.encode()).hexdigest()}\n" for e in own)
        assert (r.n_examples, r.expanded_chars, r.examples_sha256) == (len(own), sum(len(e.text) for e in own), hashlib.sha256(lines.encode()).hexdigest())
    for wrong in (examples.withColumn("context_chars", examples.context_chars - 1), examples.withColumn("end", examples.end + 1), examples.filter("target > 1")):
        other = {r.conv_id: r.examples_sha256 for r in chat.read_back(stream, wrong).collect()}
        assert any(other[c] != got[c].examples_sha256 for c in got)
