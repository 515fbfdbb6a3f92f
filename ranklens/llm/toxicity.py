"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

A word is hashed to four rows of an embedding table, two by its whole form and two by its first
letters, and their vectors are summed: words collide only if several rows do, and forms of one stem
share rows. Rows that too few training texts use stay zero, so unknown words say nothing. Filters of several widths run over the whole text, the largest
response of each is kept, and a logistic layer scores them. Training is plain numpy on all labelled texts:
a first block in several passes by one task, all others once, in parts side by side that are averaged
(``labelled``). Thresholds rest on all of them: each text is scored by a network that has not yet been
trained on it (of the first block, one trained on others of the block; of a part, the part's own as it
meets the text), and the cut with the best F1 is taken among those that flag no more than one
clean text in a hundred. A language's own cut is drawn towards the cut of all languages as far as it has
few texts of one of the classes. The language is read from the text itself by its function words. A score
is shifted so that the threshold of its language stands at 0.5. A scoring task hashes a word and sums
its vector once, as far as its memory of words goes.
"""

from __future__ import annotations

import pickle
import re
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import fold, free_name
from ranklens.llm.labelled import TRAIN_ROWS, Changed, in_order, rate_of, texts_of, train_parts, training_texts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 12, (1, 2, 3), 8
BATCH, RATE = 16, 0.08
#: Passes over the first block: a small block is passed over more often.
EPOCHS, TEXTS = (8, 20), 36_000
FOLDS, HELD_OUT, ACCEPT = 5, 0, 0.5
#: Training texts that must use a row for it to be learned.
MIN_TEXTS = 3
#: Parts of the first block that are scored by a network trained on the others.
PARTS = 3
#: Clean texts a cut may flag, and texts of the rarer class at which a language's own cut counts half.
FLAGGED, HALF_AT = 0.01, 200
#: Logits met in parts are counted in steps of 1 / STEPS up to +-FARTHEST.
STEPS, FARTHEST = 256, 32
#: Threshold of a network that has nothing to learn from: every score is below 0.5.
UNTRAINED = 1.0
#: Words whose rows or vectors a task remembers before it starts anew; only time depends on it.
MEMO_WORDS = 100_000
#: Words convolved at a time; a longer text is taken in overlapping runs.
RUN_WORDS = 50_000
WORD = re.compile(r"\w+")

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was on be by are this from it as at or an",
    "fr": "le la les des et en un une dans pour que qui sur avec au du par est ne pas",
    "de": "der die das und zu den von mit im ein eine für auf dem des ist nicht sich auch es",
    "es": "el los las y en una por con para del se no lo al su como más es que un",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
#: One bit for each language that has a function word, and the languages of every set of bits.
_SPOKEN_IN = {w: sum(1 << k for k, v in enumerate(FUNCTION_WORDS.values()) if w in v.split()) for w in " ".join(FUNCTION_WORDS.values()).split()}
_LANGUAGES_OF = np.array([[bits >> k & 1 for k in range(len(FUNCTION_WORDS))] for bits in range(1 << len(FUNCTION_WORDS))])
#: The code points that WORD matches, and the ASCII ones with a blank for all others.
_IN_WORD = np.zeros(sys.maxunicode + 1, dtype=bool)
for _run in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
    _IN_WORD[_run.start() : _run.end()] = True
_ASCII_WORDS = "".join(chr(k) if _IN_WORD[k] else " " for k in range(128))


def words_of(text: str | None) -> list[str]:
    """All matches of WORD in the lower-cased text: blanks for all else, which no word holds, and a split."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(_ASCII_WORDS).split()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_IN_WORD[code], code, np.uint32(ord(" "))).tobytes().decode("utf-32-le").split()


def language(words: list[str]) -> int:
    """Position in LANGUAGES of the language with the most function words; ``other`` without any."""
    bits = np.frombuffer(bytes(map(_SPOKEN_IN.get, words, repeat(0))), np.uint8)
    n = np.bincount(bits, minlength=len(_LANGUAGES_OF)) @ _LANGUAGES_OF
    return int(n.argmax()) if n.any() else len(n)


_A, _4, _5 = zlib.crc32(b"a"), zlib.crc32(b"4"), zlib.crc32(b"5")


def rows_of(word: str) -> tuple[int, ...]:
    """Rows from the crc32 of a<word>, <word>b, 4<first 4 letters> and 5<first 5 letters>."""
    whole, n, crc = word.encode(), BUCKETS - 1, zlib.crc32
    return 1 + crc(whole, _A) % n, 1 + crc(b"b", crc(whole)) % n, 1 + crc(word[:4].encode(), _4) % n, 1 + crc(word[:5].encode(), _5) % n


NO_WORD = (0,) * len(rows_of(""))


class Rows(dict):
    """Rows of words, with a bounded memory of the words seen."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        rows = self[word] = rows_of(word)
        return rows


class Network:
    """Embedding, filters and output; row 0 of the embedding pads texts and stays zero."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, DIM), dtype=np.float32)
        self.filters = [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = 0.0
        self.threshold = np.full(len(LANGUAGES), UNTRAINED)
        #: Sums of squared gradients and, by row, the texts trained on that use it.
        self.seen = {k: 1e-4 for k in ("shift", "out", "bias")} | {k: 1e-4 for k in range(len(WIDTHS))}
        self.table_seen = np.full(BUCKETS, 1e-4, dtype=np.float32)
        self.texts_of = np.zeros(BUCKETS, dtype=np.int64)

    def responses(self, vectors: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Filter responses of each width at each place, from the vectors of the distinct words; 0 at padding."""
        return self._summed((vectors @ self._places()).take(ids, axis=0), ids)

    def heard(self, vectors: np.ndarray) -> np.ndarray:
        """What each place of each filter makes of each vector."""
        return vectors @ self._places()

    def responses_to(self, heard: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """The same where what is heard of each word is known."""
        return self._summed(heard.take(ids, axis=0), ids)

    def _places(self) -> np.ndarray:
        """The filters' weights at each of their places, one width after another."""
        return np.concatenate([own[k] for w, own in zip(WIDTHS, self.filters) for k in range(w)], axis=1)

    @staticmethod
    def _summed(heard: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        padding, out, at = np.flatnonzero(ids == 0), [], 0
        for w in WIDTHS:
            total = np.ascontiguousarray(heard[:, at : at + FILTERS])
            for k in range(1, w):
                total[: len(ids) - k] += heard[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            total[padding] = 0
            out.append(total)
            at += w * FILTERS
        return out

    def pooled(self, pairs: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response and its place, by text and filter. Texts stand one after another, padding between."""
        return self._pooled(self.table[pairs].sum(1), ids, first)

    def _pooled(self, vectors: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.training and len(ids) > 2 * RUN_WORDS:
            return self._pooled_in_runs(vectors, ids, first)
        best, place = [], []
        for total in self.responses(vectors, ids):
            top = np.maximum.reduceat(total, first, axis=0)
            best.append(top)
            if self.training:
                ends = np.r_[first[1:], len(ids)]
                place.append(np.array([total[a:b].argmax(0) + a for a, b in zip(first, ends)]))
        return np.concatenate(best, axis=1), np.concatenate(place, axis=1) if place else np.zeros(0)

    def _pooled_in_runs(self, vectors: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the responses to RUN_WORDS words in memory at a time."""
        lap = max(WIDTHS) - 1
        best = np.full((len(first), len(self.shift)), -np.inf, dtype=np.float32)
        place = np.zeros(best.shape, dtype=np.int64)
        for k, (a, b) in enumerate(zip(first, np.r_[first[1:], len(ids)])):
            for at in range(a, b, RUN_WORDS):
                total = np.concatenate(self.responses(vectors, ids[at : min(b, at + RUN_WORDS + lap)]), axis=1)[:RUN_WORDS]
                top = total.argmax(0)
                value = total[top, np.arange(len(top))]
                more = value > best[k]
                best[k, more], place[k, more] = value[more], top[more] + at
        return best, place

    training = False

    def fit(self, texts: list[str], labels: list[int], seed: int = 1) -> Network:
        """Trains on all texts, with thresholds from networks trained without the text they score.

        With fewer than two texts of a class there is nothing to tell apart: every text scores the same,
        below 0.5.
        """
        sample = Sample(zip(texts, labels), seed)
        if not sample.enough:
            return self
        z = np.zeros(len(texts))
        for k in range(PARTS):
            own, z_own = sample.unseen(k)
            z[own] = z_own
        sample.train(self, np.arange(len(texts)))
        self.threshold = thresholds(z, sample.y, sample.spoken)
        return self

    def _learn(self, docs: list[np.ndarray], pairs: np.ndarray, y: np.ndarray, use: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        for k in use:
            self.texts_of[np.unique(pairs[docs[k][0]])] += 1
        self.texts_of[0] = 0
        known = self.texts_of >= MIN_TEXTS
        self.table[known] = rng.normal(0, 0.05, (int(known.sum()), DIM))
        weight = _weights(y, y[use].mean())
        self.training = True
        epochs = int(np.clip(TEXTS // max(1, len(use)), *EPOCHS))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(use)
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                ids, back, first = _side_by_side([docs[k] for k in own])
                self._step(pairs[ids], back, first, y[own], weight[own], rate, known)
        self.training = False
        return self

    def any_word(self, seed: int = 1) -> Network:
        """Begins without a first block: every row may be learned."""
        self.table[1:] = np.random.default_rng(seed).normal(0, 0.05, (BUCKETS - 1, DIM))
        return self

    def learn_part(self, chunks: Iterator[tuple[list[str], list[int]]], share: float, expected: float) -> Changed:
        """Passes once over the texts of a part: what changed, and the counts of the logits they had before.

        A row that the network did not know begins at zero; all rows may be learned, since only all parts
        together tell which ones enough texts use.
        """
        before, table = self.dense(), self.table.copy()
        uses, counts, done = np.zeros(BUCKETS, dtype=np.int64), np.zeros(COUNTED), 0
        memo, known = Rows(), np.arange(BUCKETS) > 0
        self.training = True
        for texts, labels in chunks:
            own = Texts(zip(texts, labels), memo.__getitem__)
            weight, spoken = _weights(own.y, share), own.spoken
            for at in range(0, len(texts), BATCH):
                batch = slice(at, at + BATCH)
                ids, back, first = _side_by_side(own.docs[batch])
                z = self._step(own.pairs[ids], back, first, own.y[batch], weight[batch], RATE * rate_of(done, expected), known)
                np.add.at(counts, (spoken[batch], (own.y[batch] == 1).astype(np.int64), _step_of(z)), 1)
                done += len(z)
            for words, _ in own.docs:
                uses[np.unique(own.pairs[words])] += 1
        self.training = False
        uses[0] = 0
        return uses, self.table - table, done, self.dense() - before, counts.ravel()

    def moved(self, uses: np.ndarray, change: np.ndarray, dense: np.ndarray) -> Network:
        """Takes over the averaged changes of parts; rows that too few texts of all use become zero."""
        self.table += change.astype(np.float32)
        self.texts_of += uses.astype(np.int64)
        self.table[self.texts_of < MIN_TEXTS] = 0
        dense, at = self.dense() + dense, 0
        for own in (*self.filters, self.shift, self.out):
            own[:] = dense[at : at + own.size].reshape(own.shape)
            at += own.size
        self.bias = float(dense[at])
        return self

    def dense(self) -> np.ndarray:
        return np.concatenate([*(x.ravel() for x in self.filters), self.shift, self.out, [self.bias]]).astype(np.float64)

    def _step(self, pairs, ids, first, y, weight, rate, known):
        """One step on a few texts; returns the logits they had before it."""
        seen, table_seen = self.seen, self.table_seen
        vectors = self.table[pairs].sum(1)
        best, place = self._pooled(vectors, ids, first)
        raw = best + self.shift
        hidden = np.maximum(raw, 0)
        z = hidden @ self.out + self.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = (p - y) * weight / len(y)
        grad_out, grad_bias = hidden.T @ error, float(error.sum())
        grad_hidden = np.outer(error, self.out) * (raw > 0)
        grad_words = np.zeros_like(vectors)

        def moved(key, grad):
            seen[key] = seen[key] + grad**2
            return rate * grad / np.sqrt(seen[key])

        changes = []
        for j, (w, own) in enumerate(zip(WIDTHS, self.filters)):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            g, at = grad_hidden[:, cols], place[:, cols]
            grad_own = np.zeros_like(own)
            for k in range(w):
                inside = (at + k < len(ids)) & (ids[at] != 0)
                word = ids[np.minimum(at + k, len(ids) - 1)]
                part = np.where(inside, g, 0)
                grad_own[k] = np.einsum("bf,bfd->df", part, vectors[word])
                np.add.at(grad_words, word.ravel(), (part[:, :, None] * own[k].T[None]).reshape(-1, DIM))
            changes.append(moved(j, grad_own))
        for own, change in zip(self.filters, changes):
            own -= change
        self.shift -= moved("shift", grad_hidden.sum(0))
        self.out -= moved("out", grad_out)
        self.bias -= moved("bias", grad_bias)
        touched = np.flatnonzero(np.abs(grad_words).sum(1))
        used, where = np.unique(pairs[touched], return_inverse=True)
        total = np.zeros((len(used), DIM), dtype=np.float32)
        np.add.at(total, where.ravel(), np.repeat(grad_words[touched], pairs.shape[1], axis=0))
        total[~known[used]] = 0
        table_seen[used] += (total**2).mean(1)
        self.table[used] -= rate * total / np.sqrt(table_seen[used])[:, None]
        return z

    def logit(self, words: list[str]) -> float:
        return Scorer(self).logits([words])[0]

    def dump(self) -> bytes:
        parts = [self.table, *self.filters, self.shift, self.out, np.float64([self.bias]), self.threshold]
        return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    def load(self, data: bytes) -> Network:
        at = 0

        def take(like):
            nonlocal at
            out = np.frombuffer(data, like.dtype, like.size, at).reshape(like.shape).copy()
            at += out.nbytes
            return out

        self.table, self.filters = take(self.table), [take(x) for x in self.filters]
        self.shift, self.out = take(self.shift), take(self.out)
        self.bias, self.threshold = float(take(np.zeros(1))[0]), take(self.threshold)
        return self


def _weights(y: np.ndarray, share: float) -> np.ndarray:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)


#: Shape of the counts of logits: language, label, step.
COUNTED = (len(LANGUAGES), 2, 2 * FARTHEST * STEPS + 1)


def _step_of(z: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(z, -FARTHEST, FARTHEST) + FARTHEST) * STEPS).astype(np.int64)


class Numbers(dict):
    """Words numbered from 1 as they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


class Texts:
    """Labelled texts, made ready for training: read one at a time, and kept as numbers of their words."""

    def __init__(self, rows: Iterable[tuple[str, int]], rows_of_word: Callable[[str], tuple[int, ...]]):
        index, labels, spoken, self.docs = Numbers(), [], [], []
        for text, label in rows:
            words = words_of(text)
            labels.append(label)
            spoken.append(language(words))
            ids = np.zeros(len(words) + max(WIDTHS), dtype=np.int32)
            ids[: len(words)] = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
            own, place = np.unique(ids, return_inverse=True)
            self.docs.append((own, place.astype(np.int32)))
        self.y, self.spoken = np.array(labels, dtype=np.float32), np.array(spoken, dtype=np.int64)
        found = chain(NO_WORD, chain.from_iterable(map(rows_of_word, index)))
        self.pairs = np.fromiter(found, np.int64).reshape(-1, len(NO_WORD))

    def words(self, k: int) -> np.ndarray:
        """Numbers of the words of a text, in its order."""
        own, place = self.docs[k]
        return own[place[: -max(WIDTHS)]]


class Sample(Texts):
    """Labelled texts dealt to PARTS parts with an equal share of each class."""

    def __init__(self, rows: Iterable[tuple[str, int]], seed: int = 1):
        super().__init__(rows, rows_of)
        self.seed, self.enough = seed, min(self.y.sum(), len(self.y) - self.y.sum()) >= 2
        rng, self.part = np.random.default_rng(seed), np.zeros(len(self.y), dtype=np.int64)
        for own in (np.flatnonzero(self.y == 0), np.flatnonzero(self.y == 1)):
            self.part[rng.permutation(own)] = np.arange(len(own)) % PARTS

    def train(self, net: Network, use: np.ndarray) -> Network:
        return net._learn(self.docs, self.pairs, self.y, use, self.seed)

    def unseen(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts of part k, and their logits from a network trained on the other parts."""
        own = np.flatnonzero(self.part == k)
        net = self.train(Network(self.seed + 1 + k), np.flatnonzero(self.part != k))
        return own, Scorer(net, self.pairs.__getitem__).logits([self.words(i) for i in own])


def _side_by_side(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text one after another (word 0 first, once), the place among them of every word, where texts begin."""
    words, places, at = [np.zeros(1, np.int64)], [], 0
    for own, place in docs:
        # a text's distinct words are sorted and begin with the padding
        places.append(np.where(place == 0, 0, place + at))
        words.append(own[1:])
        at += len(own) - 1
    return np.concatenate(words), np.concatenate(places, dtype=np.int64), np.cumsum([0, *(len(p) for p in places[:-1])])


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Middle of the gap between neighbouring logits where the F1 of ``z >= cut`` is largest; ``n`` texts have each.

    At most FLAGGED of the clean texts lie above; with none toxic the cut is above all of them.
    """
    order = np.argsort(-z, kind="stable")
    n = np.ones(len(y)) if n is None else n[order]
    z, y = z[order], y[order]
    right, above = np.cumsum(y * n), np.cumsum(n)
    wrong = above - right
    f1 = 2 * right / (above + (y * n).sum())
    f1[wrong > FLAGGED * ((1 - y) * n).sum()] = -1
    f1[:-1][z[:-1] == z[1:]] = -1
    if not len(z) or f1.max() <= 0:
        return float(z[0]) + 1e-6 if len(z) else 0.0
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]) - 1e-6


def thresholds(z: np.ndarray, y: np.ndarray, spoken: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Cut per language: the cut of all texts, moved towards the language's own by its count of both classes."""
    n = np.ones(len(y)) if n is None else n
    pooled = best_cut(z, y, n)
    out = np.full(len(LANGUAGES), pooled)
    for k in range(len(LANGUAGES)):
        own = spoken == k
        least = min((y * n)[own].sum(), ((1 - y) * n)[own].sum())
        if least:
            out[k] += least / (least + HALF_AT) * (best_cut(z[own], y[own], n[own]) - pooled)
    return out


class Scorer:
    """Scores of whole texts, with a bounded memory of the words seen and of what the filters make of them.

    A matrix product may round a row by its place among others, so a word's row is worked out once.
    """

    def __init__(self, network: Network, rows_of_word: Callable[[str], tuple[int, ...]] = rows_of):
        self.network, self.rows_of_word = network, rows_of_word
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = Numbers(), 0
        self.heard = np.zeros((1, FILTERS * sum(WIDTHS)), dtype=np.float32)  # of the padding

    def _remember(self) -> None:
        """Works out what is heard of the words that were numbered since the last call."""
        n = len(self.numbers) + 1
        new = list(islice(reversed(self.numbers), n - 1 - self.known))[::-1]
        if n > len(self.heard):
            more = np.empty((max(n, 2 * len(self.heard)), self.heard.shape[1]), dtype=np.float32)
            more[: self.known + 1] = self.heard[: self.known + 1]
            self.heard = more
        if new:
            vectors = self.network.table[np.array([*map(self.rows_of_word, new)], dtype=np.int64)].sum(1)
            self.heard[self.known + 1 : n] = self.network.heard(vectors)
        self.known = n - 1

    def _pooled(self, runs: list[tuple[list[str], bool]]) -> np.ndarray:
        """Pooled responses of runs of words, taken together; a run that goes on ends before its overlap."""
        if self.known >= MEMO_WORDS:
            self._forget()
        pad, lap = np.zeros(max(WIDTHS), dtype=np.int64), max(WIDTHS) - 1
        ids, first, own, at = [], [], [], 0
        for words, last in runs:
            own.append(len(first))
            first.append(at)
            ids += [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), pad]
            if not last:
                first.append(at + len(words) - lap)
            at += len(words) + len(pad)
        self._remember()
        best = [np.maximum.reduceat(total, first, axis=0) for total in self.network.responses_to(self.heard, np.concatenate(ids))]
        return np.concatenate(best, axis=1)[own]

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        net, lap = self.network, max(WIDTHS) - 1
        best = np.full((len(texts), len(net.shift)), -np.inf, dtype=np.float32)
        run, held, n = [], [], 0

        def flush():
            nonlocal run, held, n
            if run:
                np.maximum.at(best, np.array(held), self._pooled(run))
            run, held, n = [], [], 0

        for k, words in enumerate(texts):
            for at in range(0, max(1, len(words) - lap), RUN_WORDS):
                part = words[at : at + RUN_WORDS + lap]
                run.append((part, at + RUN_WORDS >= len(words) - lap))
                held.append(k)
                n += len(part)
                if n >= RUN_WORDS:
                    flush()
        flush()
        return np.maximum(best + net.shift, 0) @ net.out + net.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        spoken = np.array([language(w) for w in words], dtype=np.int64)
        z = self.logits(words) - self.network.threshold[spoken] if words else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains the one network number ``net`` of a task on the first block: PARTS on all of its texts, others without a part."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    k, sample = first.column("net")[0].as_py(), Sample(texts_of(chain([first], batches)))
    del first
    if not sample.enough:
        return
    if k == PARTS:
        net, every = Network(), np.arange(len(sample.y))
        sample.train(net, every)
        out = {"network": net.dump(), "place": every, "value": sample.y, "spoken": sample.spoken}
        state = pickle.dumps((net.seen, net.table_seen, net.texts_of))
    else:
        place, z = sample.unseen(k)
        out, state = {"network": None, "place": place, "value": z, "spoken": None}, None
    arrays = [pa.array([k], pa.int32()), pa.array([out["network"]], pa.binary()), pa.array([state], pa.binary())]
    arrays += [pa.array([None if out[c] is None else np.asarray(out[c], t).tobytes()], pa.binary()) for c, t in (("place", "i8"), ("value", "f8"), ("spoken", "i8"))]
    yield pa.RecordBatch.from_arrays(arrays, names=["net", "network", "state", "place", "value", "spoken"])


def _dealt(sample: DataFrame) -> DataFrame:
    """The first block once for each network, a partition each: a task holds one block, and none trains two networks."""
    each = sample.withColumn("net", F.explode(F.sequence(F.lit(0), F.lit(PARTS)))).repartitionById(PARTS + 1, "net")
    return each.sortWithinPartitions(*in_order())


def _first_block(sample: DataFrame) -> tuple[Network, np.ndarray, np.ndarray, np.ndarray]:
    """Network of the first block; logit of each of its texts by a network that was not trained on it, label, language."""
    columns = "net int, network binary, state binary, place binary, value binary, spoken binary"
    found = {r["net"]: r for r in _dealt(sample).mapInArrow(_train, columns).collect()}
    array = lambda k, c, t: np.frombuffer(bytes(found[k][c]), t)
    y = array(PARTS, "value", "f8")
    z = np.zeros(len(y))
    for k in range(PARTS):
        if k in found:
            z[array(k, "place", "i8")] = array(k, "value", "f8")
    net = Network().load(bytes(found[PARTS]["network"]))
    net.seen, net.table_seen, net.texts_of = pickle.loads(bytes(found[PARTS]["state"]))
    return net, z, y, array(PARTS, "spoken", "i8")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS) -> Network:
    """Network (about 12 MiB) from all labelled texts outside the held-out fold.

    The network of the first block, of at most ``rows`` texts, and the PARTS ones that score its texts unseen
    are trained side by side, each in one task. The other texts are trained on in parts, a task each, from
    that network on, and what the parts changed is averaged. The thresholds rest on the logits of all texts. With
    fewer than two labelled texts of a class the network is untrained: every text scores the same, below 0.5,
    and none is toxic. Languages with few labels share the threshold of all.
    """
    data = training_texts(docs, labels, "toxic", folds, held_out, rows, least=2)
    if data is None:
        return Network()
    net, z, y, spoken = Network().any_word(), np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)
    if data.first is not None:
        net, z, y, spoken = _first_block(data.first)
    n = np.ones(len(z))
    if data.rest is not None:
        start, share, expected = net, data.share, data.rest_rows / data.parts
        uses, change, _, dense, counts = train_parts(data, lambda chunks: start.learn_part(chunks, share, expected))
        net = net.moved(uses, change, dense)
        met = np.nonzero(counts.reshape(COUNTED))
        z, y, spoken = np.r_[z, met[2] / STEPS - FARTHEST], np.r_[y, met[1]], np.r_[spoken, met[0]]
        n = np.r_[n, counts.reshape(COUNTED)[met]]
    data.done()
    net.threshold = thresholds(z, y, spoken, n)
    net.seen = net.table_seen = net.texts_of = None  # only training needs them
    return net


def score_column(text, network: Network):
    """Toxicity of a text column; null and empty texts get the score of no words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(network)
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                out.append(scorer.scores(texts[at : at + 64].to_pylist()))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), type=pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is scored, whole; its language is read from its own words. Repeated rows are each
    scored; a null doc_id has a null held_out. No rows: no rows. Other columns are ignored. Without labels
    of both classes no text is predicted toxic (``fit``).
    """
    scored = docs.select("doc_id", score_column(F.col("text"), fit(docs, labels)).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents below the threshold of their language, with their columns as they came.

    Without labels of both classes all stay.
    """
    name = free_name(docs, "score")
    return docs.withColumn(name, score_column(F.col("text"), fit(docs, labels))).filter(F.col(name) < ACCEPT).select(*docs.columns)
