"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is an embedding of its hash and the mean embedding of its hashed character trigrams. The network reads
overlapping windows of words; a text's score is that of its most toxic window. It is trained in numpy on a bounded sample
of labelled texts, in turns: the windows that score highest in each text are found, then the network learns from them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import WORD_BYTES, utf8, word_chunks


@dataclass(frozen=True)
class Settings:
    """What the network learns from is bounded: sample labelled texts of each class at most, sample_bytes of them together
    at most, and none of over text_bytes.

    Of a toxic text the window that scores highest is learned from in each epoch; of a clean one the two highest, and of
    all others of clean texts every spread-th by score, as there are many. Scoring reads all windows. A sample of few
    texts is gone through more often than epochs, for least_steps steps at least.
    """

    window: int = 128
    stride: int = 64
    hidden: int = 8
    embedding: int = 8
    word_bits: int = 14
    char_bits: int = 14
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    word_dropout: float = 0.9
    decay: float = 0.1
    least_steps: int = 400
    spread: int = 16
    sample: int = 2000
    sample_bytes: int = 1 << 24
    text_bytes: int = 1 << 16
    seed: int = 7


@dataclass
class Words:
    """Texts as words: ids into the different words, and the texts' lengths; of each word its hash and trigrams."""

    ids: np.ndarray
    lengths: np.ndarray
    bucket: np.ndarray
    trigrams: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], s: Settings) -> Words:
        known: dict[bytes, int] = {}
        ids, lengths = [], []
        for text in texts:
            n = 0
            for words in word_chunks(text, WORD_BYTES):
                ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
                n += len(words)
            lengths.append(n)
        words = list(known)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        data = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint32) if words else np.zeros(0, np.uint32)
        at = np.arange(counts.sum()) + 2 * np.repeat(np.arange(len(words)), counts)
        mixed = (data[at] * np.uint32(0x9E3779B1) + data[at + 1]) * np.uint32(0x85EBCA77) + data[at + 2] if words else data
        trigrams = (mixed * np.uint32(0xC2B2AE3D) >> np.uint32(32 - s.char_bits)).astype(np.int32)
        bucket = np.fromiter((zlib.crc32(w) >> 32 - s.word_bits for w in words), np.int32, len(words))
        return cls(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(lengths, np.int64), bucket, trigrams, starts, counts)

    def places(self, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Where each window starts in its text, and the text of each. A text without words has one window of nothing."""
        n = 1 + np.maximum(0, -(-(self.lengths - s.window) // s.stride))
        text = np.repeat(np.arange(len(n)), n)
        return (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * s.stride, text

    def ids_of(self, first: np.ndarray, text: np.ndarray, s: Settings) -> np.ndarray:
        """Word ids of these windows, (n, window), -1 where a text has ended."""
        at = first[:, None] + np.arange(s.window)
        inside = at < self.lengths[text][:, None]
        base = (np.cumsum(self.lengths) - self.lengths)[text][:, None]
        where = np.where(inside, base + at, 0)
        return np.where(inside, self.ids[where] if len(self.ids) else 0, -1).astype(np.int32)

    def windows(self, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all windows, and the text of each."""
        first, text = self.places(s)
        return self.ids_of(first, text, s), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """The parameters, by name, and how they are read and learned."""

    settings: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, s: Settings) -> Network:
        rng = np.random.default_rng(s.seed)
        d, h = 2 * s.embedding, s.hidden

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        p = {"words": draw(1 << s.word_bits, s.embedding, scale=0.1), "chars": draw(1 << s.char_bits, s.embedding, scale=0.3)}
        for way in ("f", "b"):
            p |= {f"in_{way}": draw(d, 3 * h, scale=d**-0.5), f"bias_{way}": np.zeros(3 * h, np.float32), f"own_{way}": draw(h, 3 * h, scale=h**-0.5)}
        p |= {"mix": draw(2 * h, h, scale=(2 * h) ** -0.5), "mix_bias": np.zeros(h, np.float32), "ask": draw(h, scale=h**-0.5)}
        return cls(s, p | {"out": draw(2 * h, scale=(2 * h) ** -0.5), "out_bias": np.full(1, -1, np.float32)})

    def inputs(self, words: Words, dropped: np.ndarray | None = None) -> np.ndarray:
        """The input of each different word."""
        if not len(words.counts):
            return np.zeros((0, 2 * self.settings.embedding), np.float32)
        by_word = self.p["words"][words.bucket]
        if dropped is not None:
            by_word = by_word * ~dropped[:, None]
        by_char = np.add.reduceat(self.p["chars"][words.trigrams], words.starts, axis=0) / words.counts[:, None].astype(np.float32)
        return np.concatenate([by_word, by_char], axis=1)

    def _read(self, gates: np.ndarray, ids: np.ndarray, way: str, kept: list | None) -> list[np.ndarray]:
        """The states of one direction at each step, in the order of the text."""
        h_size, own = self.settings.hidden, self.p[f"own_{way}"]
        h = np.zeros((len(ids), h_size), np.float32)
        states: list = [None] * ids.shape[1]
        for t in range(ids.shape[1]) if way == "f" else range(ids.shape[1] - 1, -1, -1):
            x, g = gates[ids[:, t]], h @ own
            zr = _sigmoid(x[:, : 2 * h_size] + g[:, : 2 * h_size])
            z, r = zr[:, :h_size], zr[:, h_size:]
            new = np.tanh(x[:, 2 * h_size :] + r * g[:, 2 * h_size :])
            there = (ids[:, t] >= 0)[:, None]
            after = (new + z * (h - new)) * there
            if kept is not None:
                kept.append((t, h, z, r, new, g[:, 2 * h_size :], there))
            h = states[t] = after
        return states

    def logits(self, ids: np.ndarray, inputs: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """The logit of each window; what the way back needs goes to kept."""
        sides = {}
        for way in ("f", "b"):
            gates = np.concatenate([inputs @ self.p[f"in_{way}"] + self.p[f"bias_{way}"], np.zeros((1, 3 * self.settings.hidden), np.float32)])
            steps: list | None = None if kept is None else []
            sides[way] = self._read(gates, ids, way, steps)
            if kept is not None:
                kept[way] = steps
        states = np.concatenate([np.stack(sides["f"], 1), np.stack(sides["b"], 1)], axis=2)
        asked = np.tanh(states @ self.p["mix"] + self.p["mix_bias"])
        weight = np.where(ids >= 0, np.exp(np.clip(asked @ self.p["ask"], -30, 30)), 0)
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-30)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        if kept is not None:
            kept |= {"states": states, "asked": asked, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_bias"]

    def gradients(self, ids: np.ndarray, words: Words, dropped: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the windows and its gradient for each parameter."""
        s, p, kept = self.settings, self.p, {}
        h = s.hidden
        inputs = self.inputs(words, dropped)
        logit = self.logits(ids, inputs, kept)
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        d_logit = ((_sigmoid(logit) - label) / len(ids)).astype(np.float32)
        d = {"out": kept["pooled"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        states, asked, weight = kept["states"], kept["asked"], kept["weight"]
        d_weight = (states * d_pooled[:, None, :]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d["ask"] = np.einsum("nt,nth->h", d_score, asked)
        d_mix = d_score[:, :, None] * p["ask"] * (1 - asked**2)
        d["mix"], d["mix_bias"] = np.einsum("ntc,nth->ch", states, d_mix), d_mix.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_mix @ p["mix"].T
        d_inputs = np.zeros((len(inputs) + 1, inputs.shape[1]), np.float32)
        padded = np.concatenate([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
        for way, lo in (("f", 0), ("b", h)):
            own, to_gates = p[f"own_{way}"], p[f"in_{way}"]
            d_own, d_in, d_bias = np.zeros_like(own), np.zeros_like(to_gates), np.zeros(3 * h, np.float32)
            back = np.zeros((len(ids), h), np.float32)
            for t, before, z, r, new, g_new, there in reversed(kept[way]):
                d_h = (back + d_states[:, t, lo : lo + h]) * there
                d_new = d_h * (1 - z) * (1 - new**2)
                d_z, d_r = d_h * (before - new) * z * (1 - z), d_new * g_new * r * (1 - r)
                d_gate, d_recurrent = np.concatenate([d_z, d_r, d_new], 1), np.concatenate([d_z, d_r, d_new * r], 1)
                d_own += before.T @ d_recurrent
                back = d_h * z + d_recurrent @ own.T
                x = padded[ids[:, t]]
                d_in += x.T @ d_gate
                d_bias += d_gate.sum(axis=0)
                np.add.at(d_inputs, ids[:, t], d_gate @ to_gates.T)
            d |= {f"own_{way}": d_own, f"in_{way}": d_in, f"bias_{way}": d_bias}
        d_words, d_chars = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        if len(words.counts):
            d_inputs = d_inputs[:-1]
            np.add.at(d_words, words.bucket, d_inputs[:, : s.embedding] * ~dropped[:, None])
            np.add.at(d_chars, words.trigrams, np.repeat(d_inputs[:, s.embedding :] / words.counts[:, None], words.counts, axis=0))
        return loss, d | {"words": d_words, "chars": d_chars}

    def text_logits(self, words: Words, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, with their texts; at_once windows are read together, so that a long text stays within bounds."""
        first, text = words.places(self.settings)
        inputs = self.inputs(words)
        parts = [self.logits(words.ids_of(first[lo : lo + at_once], text[lo : lo + at_once], self.settings), inputs) for lo in range(0, len(text), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32), text

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text: the highest of its windows', to six digits, as what is computed together varies in the last."""
        if not texts:
            return np.zeros(0)
        logit, text = self.text_logits(Words.of(texts, self.settings))
        first = np.flatnonzero(np.diff(text, prepend=-1))
        return np.round(_sigmoid(np.maximum.reduceat(logit.astype(np.float64), first)), 6)


def _few(words: Words, ids: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of these windows alone, and the windows with ids into them."""
    used, new = np.unique(ids[ids >= 0], return_inverse=True)
    renamed = np.full(ids.shape, -1, np.int32)
    renamed[ids >= 0] = new
    counts = words.counts[used]
    starts = np.cumsum(counts) - counts
    at = np.repeat(words.starts[used] - starts, counts) + np.arange(counts.sum())
    return Words(np.zeros(0, np.int32), np.zeros(0, np.int64), words.bucket[used], words.trigrams[at], starts, counts), renamed


def train(texts: list[bytes], labels: list[int], s: Settings = Settings()) -> Network:
    """A network from labelled texts. Without texts of both classes it gives every text a score below a half."""
    net = Network.fresh(s)
    label = np.array(labels, dtype=np.float32)
    if not (label > 0).any() or (label > 0).all():
        net.p["out"][:] = 0
        return net
    rng = np.random.default_rng(s.seed)
    words = Words.of([*texts, b""], s)
    label = np.append(label, 0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    first, text = words.places(s)
    step, epoch, epochs = 0, 0, s.epochs
    while epoch < epochs:
        logit = net.text_logits(words)[0] if epoch else rng.normal(size=len(text))
        order = np.lexsort((-logit, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = np.concatenate([order[(rank == 0) | (rank == 1) & (label[text[order]] == 0)], order[(rank > 1) & (label[text[order]] == 0)][:: s.spread]])
        epochs = max(epochs, -(-s.least_steps // -(-len(chosen) // s.batch)))
        rng.shuffle(chosen)
        rate = s.rate * (1 - epoch / epochs) ** 0.5
        epoch += 1
        for lo in range(0, len(chosen), s.batch):
            some = chosen[lo : lo + s.batch]
            own, renamed = _few(words, words.ids_of(first[some], text[some], s))
            dropped = rng.random(len(own.counts)) < s.word_dropout
            _, d = net.gradients(renamed, own, dropped, label[text[some]])
            step += 1
            for k, g in d.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + s.decay * net.p[k])
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Network:
    """Train on labelled texts that docs has, within the bounds of s, chosen by a hash of doc_id, none of them held out.

    A doc_id with several labels is toxic if one of them says so; null labels are left out. Labels without a text, or
    with one of over s.text_bytes, do not use up the sample (such texts are scored like all others). One task trains: the
    sample is bounded, and the task runs numpy on one core, as Spark sets it up. It reads the sample in the order of
    doc_id, so that a run repeats on one machine; another machine's float32 sums differ in their last digits, and with
    them what is learned.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", utf8().alias("data")).where(F.octet_length("data") <= s.text_bytes)
    there = texts.groupBy("doc_id").agg(F.max(F.octet_length("data")).alias("size")).join(known, "doc_id")
    classes = [there.where("toxic > 0"), there.where("toxic <= 0")]
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over s.sample rows at most
    chosen = [c.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample).withColumn("so_far", so_far).where(F.col("so_far") <= s.sample_bytes) for c in classes]
    chosen = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("data").alias("data"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["data"], r["toxic"] > 0) for batch in batches for r in batch.to_pylist())
        net = train([r[1] for r in rows], [int(r[2]) for r in rows], s)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["network"])

    learned = sample.coalesce(1).mapInArrow(learn, "network binary").collect()
    return Network(s, pickle.loads(bytes(learned[0]["network"]))) if learned else train([], [], s)


def _in_blocks(net: Network, texts: list[bytes], block_bytes: int = 1 << 20) -> np.ndarray:
    """Scores of the texts, taken in blocks of about block_bytes."""
    scores, at = [np.zeros(0)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < block_bytes):
            size += len(texts[end])
            end += 1
        scores.append(net.scores(texts[at:end]))
        at = end
    return np.concatenate(scores)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score, 0 to 1, a row for each row of docs. Only the text decides; null and empty texts have a score too."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                rows = batch.slice(lo, 512)
                scores = _in_blocks(held.value, rows.column("data").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("data")).mapInArrow(score_all, "doc_id long, score double")


def keep_clean(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose text scores under the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                rows = batch.slice(lo, 512)
                texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
                yield rows.filter(pa.array(_in_blocks(held.value, texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)
