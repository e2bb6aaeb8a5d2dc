"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of ``SEGMENT`` bytes from both ends, with ``HIDDEN`` units per direction, and labels every position.
A document's probabilities are the means over all its positions, from its first segment to its last. It is trained in numpy by
backpropagation through time.

Training data are bounded: of each language the ``PER_LANGUAGE`` documents whose ids hash lowest, and of each of them up to
``SEGMENTS_EACH`` segments, spread evenly over the text. Languages weigh the same.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0. Without training rows every text is ``und``.
Labels that are null are never learned. A null ``doc_id`` gets a prediction and is never learned from; its ``held_out`` is null.
Long texts go through in parts. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, text_groups
from ribeira.llm.learning import Adam, gather, remainder, sigmoid

SEGMENT = 64
HIDDEN = 6
PER_LANGUAGE = 1000
SEGMENTS_EACH = 4
WIDTH = 2048
UNKNOWN = "und"
PREDICTIONS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Network:
    """Parameters by direction (0 forward, 1 backward); gates are in the order reset, update, new."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.embed = draw.normal(0, 0.3, (2, 256, 3 * hidden))
        self.loop = draw.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden))
        self.out = draw.normal(0, 0.3, (2 * hidden, len(languages)))
        self.bias = np.zeros(len(languages))

    def forward(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (positions, 2, rows, hidden) for codes (rows, positions); step t of the backward direction is at its place."""
        rows, length = codes.shape
        k, state, states = self.hidden, np.zeros((2, rows, self.hidden)), np.zeros((length, 2, rows, self.hidden))
        for t in range(length):
            now = np.stack([codes[:, t], codes[:, length - 1 - t]])
            a = self.embed[np.arange(2)[:, None], now]
            u = state @ self.loop
            gates = sigmoid(a[..., : 2 * k] + u[..., : 2 * k])
            reset, update = gates[..., :k], gates[..., k:]
            new = np.tanh(a[..., 2 * k :] + reset * u[..., 2 * k :])
            if trace is not None:
                trace.append((now, state, u, reset, update, new))
            state = new + update * (state - new)
            states[t, 0], states[length - 1 - t, 1] = state
        return states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(positions, rows, languages)"""
        logits = np.concatenate([states[:, 0], states[:, 1]], axis=-1) @ self.out + self.bias
        logits = np.exp(logits - logits.max(-1, keepdims=True))
        return logits / logits.sum(-1, keepdims=True)

    def gradients(self, codes: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over positions, by backpropagation through time."""
        rows, length = codes.shape
        k, trace = self.hidden, []
        states = self.forward(codes, trace)
        delta = self.probabilities(states)
        delta[:, np.arange(rows), target] -= 1
        real = (np.arange(length)[:, None] < sizes) / max(sizes.sum(), 1)
        delta *= real[..., None]
        both = np.concatenate([states[:, 0], states[:, 1]], axis=-1)
        g_out = np.einsum("tbh,tbl->hl", both, delta)
        back = delta @ self.out.T
        g_embed, g_loop, carried = np.zeros_like(self.embed), np.zeros_like(self.loop), np.zeros((2, rows, k))
        steps = []
        for t in range(length - 1, -1, -1):
            now, before, u, reset, update, new = trace[t]
            d = carried + np.stack([back[t, :, :k], back[length - 1 - t, :, k:]])
            d_new = d * (1 - update) * (1 - new**2)
            d_update = d * (before - new) * update * (1 - update)
            d_reset = d_new * u[..., 2 * k :] * reset * (1 - reset)
            d_u = np.concatenate([d_reset, d_update, d_new * reset], axis=-1)
            g_loop += before.transpose(0, 2, 1) @ d_u
            carried = d * update + d_u @ self.loop.transpose(0, 2, 1)
            steps.append((now, np.concatenate([d_reset, d_update, d_new], axis=-1)))
        for side in range(2):
            met = np.concatenate([now[side] for now, _ in steps])
            d_a = np.concatenate([d[side] for _, d in steps])
            for column in range(3 * k):
                g_embed[side, :, column] = np.bincount(met, d_a[:, column], 256)
        return [g_embed, g_loop, g_out, delta.sum((0, 1))]

    def train(self, codes: np.ndarray, sizes: np.ndarray, target: np.ndarray, epochs: int = 4, rows: int = 128, rate: float = 0.02) -> None:
        draw = np.random.default_rng(11)
        parameters = [self.embed, self.loop, self.out, self.bias]
        adams = [Adam(p.size, rate) for p in parameters]
        for _ in range(epochs):
            shuffled = draw.permutation(len(codes))
            for low in range(0, len(shuffled), rows):
                part = shuffled[low : low + rows]
                for p, g, adam in zip(parameters, self.gradients(codes[part], sizes[part], target[part]), adams):
                    p -= adam.step(g.ravel()).reshape(p.shape)


class Labeller:
    """The trained network laid out for speed: units by rows, so that every operation runs over long contiguous arrays."""

    def __init__(self, net: Network):
        k = self.k = net.hidden
        self.languages = net.languages
        embed, loop = net.embed.copy(), net.loop.copy()
        embed[..., : 2 * k] /= 2  # a sigmoid is 1/2 + 1/2 tanh of half its argument
        loop[..., : 2 * k] /= 2
        # rows: new, reset, update of the forward direction; reset, update, new of the backward one
        self.embed = [np.ascontiguousarray(np.roll(embed[0], k, axis=1).T, np.float32), np.ascontiguousarray(embed[1].T, np.float32)]
        self.loop = np.zeros((6 * k, 2 * k), np.float32)
        self.loop[: 3 * k, :k] = np.roll(loop[0], k, axis=1).T
        self.loop[3 * k :, k:] = loop[1].T
        self.out = [np.ascontiguousarray(net.out[:k].T, np.float32), np.ascontiguousarray(net.out[k:].T, np.float32)]
        self.bias = net.bias.astype(np.float32)[:, None]

    def sums(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities, (rows, languages), for codes (positions, rows)."""
        k, (length, rows) = self.k, codes.shape
        state = np.zeros((2 * k, rows), np.float32)
        forward, backward = state[:k], state[k:]
        a, g = np.empty((6 * k, rows), np.float32), np.empty((6 * k, rows), np.float32)
        logits = np.zeros((length, len(self.languages), rows), np.float32)
        part = np.empty((len(self.languages), rows), np.float32)
        middle, reset_f, update_f, reset_b, update_b = a[k : 5 * k], a[k : 2 * k], a[2 * k : 3 * k], a[3 * k : 4 * k], a[4 * k : 5 * k]
        new_f, new_b, loop_f, loop_b = a[:k], a[5 * k :], g[:k], g[5 * k :]
        for t in range(length):
            np.take(self.embed[0], codes[t], axis=1, out=a[: 3 * k], mode="clip")
            np.take(self.embed[1], codes[length - 1 - t], axis=1, out=a[3 * k :], mode="clip")
            np.matmul(self.loop, state, out=g)
            middle += g[k : 5 * k]
            np.tanh(middle, out=middle)
            middle *= 0.5
            middle += 0.5
            for new, loop, reset, update, now in ((new_f, loop_f, reset_f, update_f, forward), (new_b, loop_b, reset_b, update_b, backward)):
                loop *= reset
                new += loop
                np.tanh(new, out=new)
                now -= new
                now *= update
                now += new
            logits[t] += np.matmul(self.out[0], forward, out=part)
            logits[length - 1 - t] += np.matmul(self.out[1], backward, out=part)
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= ((np.arange(length)[:, None] < sizes) / logits.sum(1)).astype(np.float32)[:, None, :]
        return logits.sum(0, dtype=np.float64).T


def segments(text: bytes, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """The text as rows of ``length`` bytes, the last one filled up with zeros, and the real size of each."""
    rows = -(-len(text) // length)
    codes = np.frombuffer(text.ljust(rows * length, b"\0"), np.uint8).reshape(rows, length)
    sizes = np.full(rows, length)
    if rows:
        sizes[-1] = len(text) - (rows - 1) * length
    return codes, sizes


def document_probabilities(texts: list[bytes], labeller: Labeller) -> np.ndarray:
    """(documents, languages): means over all positions of each text."""
    total = np.zeros((len(texts), len(labeller.languages)))
    cut = [segments(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for _, s in cut])
    codes, sizes = np.concatenate([c for c, _ in cut]), np.concatenate([s for _, s in cut])
    for low in range(0, len(owner), WIDTH):
        part = slice(low, low + WIDTH)
        sums = labeller.sums(np.ascontiguousarray(codes[part].T).astype(np.intp), sizes[part])
        for language in range(total.shape[1]):
            total[:, language] += np.bincount(owner[part], sums[:, language], len(texts))
    return total / np.maximum([len(t) for t in texts], 1)[:, None]


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _samples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(pa.schema([("doc_id", pa.int64()), ("codes", pa.binary()), ("size", pa.int32())]))
    for group in text_groups(batches):
        for doc_id, text in group:
            codes, sizes = segments(text)
            for at in sorted({round(i * (len(sizes) - 1) / max(SEGMENTS_EACH - 1, 1)) for i in range(SEGMENTS_EACH)} if len(sizes) else ()):
                yield from out.add((doc_id, codes[at].tobytes(), int(sizes[at])), SEGMENT)
    yield from out.flush()


def fit(docs: DataFrame, learn) -> Network | None:
    """A network from ``text`` and ``lang`` of ``docs`` where ``learn`` (a condition on doc_id) holds."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull()).where(learn)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.withColumn("place", place).where(F.col("place") <= PER_LANGUAGE).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    found = gather(docs, chosen, _samples, "codes binary, size int")
    if not found.num_rows:
        return None
    languages = sorted(set(found["lang"].to_pylist()))
    target = np.array([languages.index(x) for x in found["lang"].to_pylist()])
    codes = np.frombuffer(b"".join(found["codes"].to_pylist()), np.uint8).reshape(-1, SEGMENT)
    draw, most = np.random.default_rng(3), np.bincount(target).max()
    even = np.concatenate([np.resize(draw.permutation(np.flatnonzero(target == k)), min(most, 4000)) for k in range(len(languages))])
    network = Network(languages)
    network.train(codes[even], found["size"].to_numpy()[even], target[even])
    return network


def _predictions(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, network = Emitter(PREDICTIONS), model.value
        labeller = None if network is None else Labeller(network)
        for group in text_groups(batches):
            texts = [text if labeller and has_letter(text) else b"" for _, text in group]
            chances = document_probabilities(texts, labeller) if labeller else None
            for i, (doc_id, _) in enumerate(group):
                if texts[i]:
                    best = int(chances[i].argmax())
                    yield from out.add((doc_id, labeller.languages[best], min(1.0, float(chances[i, best]))))
                else:
                    yield from out.add((doc_id, UNKNOWN, 0.0))
        yield from out.flush()

    return run


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return id_and_text(docs).mapInArrow(_predictions(shared), "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    network = fit(docs, remainder(4) != 2)
    return predict(docs, network).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
