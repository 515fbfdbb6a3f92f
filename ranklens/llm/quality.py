"""Quality classifier on supervised subword embeddings.

Each word has a vector: the mean of the vectors of its hashed form and of its hashed character
n-grams. A document is the mean of its words' vectors; a softmax over two classes scores it. Vectors
and output are trained by stochastic gradient descent in numpy on all labelled texts: a first block in
several passes by one task, all others once, in parts side by side that are averaged (``labelled``). The
model is a table of fixed size, and scoring a text is one sum over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import fold, free_name
from ranklens.llm.labelled import TRAIN_ROWS, Changed, in_order, rate_of, texts_of, train_parts, training_texts

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
EPOCHS, BATCH, RATE = 4, 32, 0.3
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
#: Logit of every text where labels of both classes are missing: nothing is told apart, nothing is rejected.
UNTRAINED = 2.0
#: Words whose weight a task remembers before it starts anew; only time depends on it.
MEMO_WORDS = 100_000
LONG_WORD = 64
#: Words whose pieces are hashed at once.
CHUNK_WORDS = 20_000


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in range(LONG_WORD + 2)]


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after another, and how many each has.

    A word (of 1 to 64 characters) has its whole form and its character n-grams with marked ends,
    hashed as polynomials of code points over all words at once.
    """
    size = np.array([len(w) + 2 for w in words])
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    found = [_bucket(np.add.reduceat(code * np.array(_STEP)[np.arange(len(code)) - first[owner]], first))]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        m = max(0, len(code) - n + 1)
        h = np.full(m, n, dtype=np.uint64) * _MIX
        for k in range(n):
            h += code[k : m + k] * _STEP[k + 1]
        inside = owner[:m] == owner[n - 1 :][:m]
        found.append(_bucket(h)[inside])
        owners.append(owner[:m][inside])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.concatenate(found)[order], np.bincount(own, minlength=len(words))


def counted(text: str | None) -> Counter:
    """Words of a whole text with their counts.

    A word equal to the one before it counts once more as a word of its own kind. A word over 64
    characters counts as runs of 64.
    """
    words = (text or "").split()
    out = Counter(words)
    for w in [w for w in out if len(w) > LONG_WORD]:
        n = out.pop(w)
        for i in range(0, len(w), LONG_WORD):
            out[w[i : i + LONG_WORD]] += n
    again = sum(map(str.__eq__, words, words[1:]))
    if again:
        out["\0again"] = again
    return out


class Texts:
    """Labelled texts, made ready for training: words and shares of each, buckets of the words. They are read one at a time."""

    def __init__(self, rows: Iterable[tuple[str, int]]):
        index, labels, self.docs = {}, [], []
        for text, label in rows:
            c = counted(text)
            share = np.fromiter(c.values(), np.float32, len(c))
            self.docs.append((np.fromiter((index.setdefault(w, len(index)) for w in c), np.int32, len(c)), share / share.sum()))
            labels.append(label)
        names = list(index)
        flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(names), CHUNK_WORDS):
            buckets, n = pieces(names[at : at + CHUNK_WORDS])
            flat.append(buckets.astype(np.int32))
            size.append(n)
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.start = np.r_[0, np.cumsum(self.size)].astype(np.int64)
        self.y = np.array(labels)


class Model:
    """Vectors by bucket and a softmax layer; ``weights`` folds both into one number per bucket."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((DIM, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        #: Sums of squared gradients by bucket.
        self.seen = np.full(BUCKETS, 1e-6, dtype=np.float32)

    def begin(self, share: np.ndarray) -> Model:
        self.bias[:] = np.log(np.maximum(share, 1e-3))
        return self

    def fit(self, texts: list[str], labels: list[int], seed: int = 1) -> Model:
        return self.fit_on(Texts(zip(texts, labels)), seed)

    def fit_on(self, own: Texts, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        self.begin(np.bincount(own.y, minlength=2) / len(own.y))
        steps, done = EPOCHS * -(-len(own.docs) // BATCH), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(own.docs))
            for at in range(0, len(order), BATCH):
                rate = RATE * (1 - done / steps)
                done += 1
                self._step(own, order[at : at + BATCH], rate)
        return self

    def learn_part(self, chunks: Iterator[tuple[list[str], list[int]]], expected: float) -> Changed:
        """Passes once over the texts of a part: what changed, and how many steps used each bucket."""
        vectors, before = self.vectors.copy(), self.dense()
        uses, done = np.zeros(BUCKETS, dtype=np.int64), 0
        for texts, labels in chunks:
            own = Texts(zip(texts, labels))
            for at in range(0, len(texts), BATCH):
                batch = np.arange(at, min(at + BATCH, len(texts)))
                uses[self._step(own, batch, RATE * rate_of(done, expected))] += 1
                done += len(batch)
        return uses, self.vectors - vectors, done, self.dense() - before, np.zeros(0)

    def moved(self, change: np.ndarray, dense: np.ndarray) -> Model:
        """Takes over the averaged changes of parts."""
        self.vectors += change.astype(np.float32)
        self.out += dense[:-2].reshape(self.out.shape).astype(np.float32)
        self.bias += dense[-2:].astype(np.float32)
        return self

    def dense(self) -> np.ndarray:
        return np.concatenate([self.out.ravel(), self.bias]).astype(np.float64)

    def _step(self, texts: Texts, own: np.ndarray, rate: float) -> np.ndarray:
        """One step on the texts at ``own``; returns the buckets they use."""
        docs, y, size, start, flat = texts.docs, texts.y, texts.size, texts.start, texts.flat
        words, column = np.unique(np.concatenate([docs[k][0] for k in own]), return_inverse=True)
        row = np.repeat(np.arange(len(own)), [len(docs[k][0]) for k in own])
        bag = np.zeros((len(own), len(words)), dtype=np.float32)
        bag[row, column] = np.concatenate([docs[k][1] for k in own])
        n = size[words]
        first = np.cumsum(n) - n
        at_flat = np.repeat(start[words] - first, n) + np.arange(n.sum())
        buckets = flat[at_flat]
        word_vectors = np.add.reduceat(self.vectors[buckets], first) / n[:, None].astype(np.float32) if len(words) else np.zeros((0, DIM), np.float32)
        hidden = bag @ word_vectors
        logits = hidden @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = p
        error[np.arange(len(own)), y[own]] -= 1
        back = error @ self.out.T
        self.out -= rate * hidden.T @ error
        self.bias -= rate * 0.1 * error.mean(0)
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        grad = (bag.T @ back) / n[:, None]
        used, place = np.unique(buckets, return_inverse=True)
        total = np.stack([np.bincount(place, np.repeat(grad[:, d], n), len(used)) for d in range(DIM)], axis=1).astype(np.float32)
        self.seen[used] += (total**2).mean(1)
        self.vectors[used] -= rate * total / np.sqrt(self.seen[used])[:, None]
        return used

    def weights(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores of texts from the folded weights, with a bounded memory of words seen."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def learn(self, words: list[str]) -> None:
        """Remembers the weight of words: the mean over their pieces."""
        for at in range(0, len(words), CHUNK_WORDS):
            own = words[at : at + CHUNK_WORDS]
            buckets, n = pieces(own)
            self.memo.update(zip(own, (np.add.reduceat(self.weights[buckets], np.cumsum(n) - n) / n).tolist()))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        counts = [counted(t) for t in texts]
        self.learn(list({w for c in counts for w in c if w not in self.memo}))
        z = np.full(len(texts), self.bias)
        for k, c in enumerate(counts):
            if c:
                z[k] += sum(self.memo[w] * n for w, n in c.items()) / sum(c.values())
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Texts(texts_of(batches))
    if own.docs:
        model = Model().fit_on(own)
        parts = (model.vectors, model.out, model.bias, model.seen)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in parts], names=["vectors", "out", "bias", "seen"])


def _first_block(sample: DataFrame) -> Model:
    row = sample.repartition(1).sortWithinPartitions(*in_order()).mapInArrow(_train, "vectors binary, out binary, bias binary, seen binary").collect()[0]
    model = Model()
    for name in ("vectors", "out", "bias", "seen"):
        own = getattr(model, name)
        own[:] = np.frombuffer(bytes(row[name]), own.dtype).reshape(own.shape)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Folded model (2 MiB) from all labelled texts outside the held-out fold.

    A first block of at most ``rows`` texts is fitted in one task; the others are trained on in parts, a task
    each, from that model on, and what the parts changed is averaged.
    Without labels of both classes every text scores the same, above ACCEPT, and is accepted.
    """
    data = training_texts(docs, labels, "quality", folds, held_out, rows)
    if data is None:
        return np.zeros(BUCKETS), UNTRAINED
    model = Model().begin(np.array([1 - data.share, data.share])) if data.first is None else _first_block(data.first)
    if data.rest is not None:
        start, expected = model, data.rest_rows / data.parts
        _, change, _, dense, _ = train_parts(data, lambda chunks: start.learn_part(chunks, expected))
        model = model.moved(change, dense)
    data.done()
    return model.weights()


def score_column(text, model: tuple[np.ndarray, float]):
    """Probability of label 1 for a text column; null and empty texts get the score of no words."""
    weights, bias = model

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(weights, bias)
        for texts in batches:
            parts = [scorer.scores(texts[at : at + 256].to_pylist()) for at in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), type=pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is scored, whole. Repeated rows are each scored; a null doc_id has a null
    held_out. No rows: no rows. Other columns are ignored. Without labels of both classes every text is
    accepted (``fit``).
    """
    scored = docs.select("doc_id", score_column(F.col("text"), fit(docs, labels)).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents the classifier accepts, with their columns as they came; all of them without labels of both classes."""
    name = free_name(docs, "score")
    return docs.withColumn(name, score_column(F.col("text"), fit(docs, labels))).filter(F.col(name) >= ACCEPT).select(*docs.columns)
