"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import SLABS, fold, in_slabs, labelled_sample, raw, summed

#: Word numbers a worker remembers; the memory is emptied when full.
REMEMBERED = 600_000
_MEMORY: dict[tuple[int, int], dict[bytes, int]] = {}

_CLASSES = bytes(
    ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i >= 128 else ord("9") if 48 <= i <= 57 else i
    for i in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_MARKS = b"\"'().,;:!?"


@dataclass(frozen=True)
class Settings:
    """``words`` + ``shapes`` and ``size`` bound the vectors, ``sample_rows`` the labelled rows of the network's fit."""

    words: int = 12288
    shapes: int = 4096
    size: int = 64
    marks: int = 4
    window: int = 2
    sample_rows: int = 20_000
    hidden: int = 32
    epochs: int = 40
    batch: int = 256
    rate: float = 2e-3
    decay: float = 1e-3
    seed: int = 5

    @property
    def rows(self) -> int:
        return self.words + self.shapes


def index_vectors(s: Settings) -> np.ndarray:
    """Sparse random index vectors: ``marks`` entries of plus or minus one in each row."""
    rng = np.random.default_rng(s.seed)
    out = np.zeros((s.rows, s.size), np.int8)
    places = rng.random((s.rows, s.size)).argsort(1)[:, : s.marks]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), places.shape), 1)
    return out


def word_number(word: bytes, s: Settings) -> int:
    """Hashed number of a plain word in lower case, or of the shape of any other (symbols, shouting, digits)."""
    core = word.strip(_MARKS)
    text = core.decode(errors="replace")
    if text.isalpha() and (len(text) == 1 or text[1:].islower()) and len(word) - len(core) <= 2:
        return zlib.crc32(core.lower()) % s.words
    return s.words + zlib.crc32(_RUNS.sub(rb"\1+", word.translate(_CLASSES))) % (s.shapes - 1)


def numbers(text: bytes, s: Settings) -> np.ndarray:
    """A text as numbers of its words; a word that repeats the one before it becomes the last number."""
    memory = _MEMORY.setdefault((s.words, s.shapes), {})
    words = text.split()
    try:
        found = np.fromiter(map(memory.__getitem__, words), np.int32, len(words))
    except KeyError:
        new = {w for w in words if w not in memory}
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = set(words)
        memory.update((w, word_number(w, s)) for w in new)
        found = np.fromiter(map(memory.__getitem__, words), np.int32, len(words))
    again = np.append(False, (found[1:] == found[:-1]) & (found[1:] < s.words))[: len(found)]
    found[again] = s.rows - 1
    return found


def _add_contexts(total: np.ndarray, found: np.ndarray, index: np.ndarray, window: int) -> None:
    """Add to each word's row the index vectors of the words around it; ``found`` holds texts parted by -1."""
    if not len(found):
        return
    marks = index[found]
    marks[found < 0] = 0
    around = np.zeros(marks.shape, np.int8)
    for step in range(1, window + 1):
        around[step:] += marks[:-step]
        around[:-step] += marks[step:]
    order = np.argsort(found.astype(np.int16), kind="stable")  # fewer than 2 ** 15 rows: a radix sort
    ordered = found[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sums = np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
    rows = ordered[first]
    total[rows[rows >= 0], : index.shape[1]] += sums[rows >= 0]
    counts = np.bincount(found[found >= 0], minlength=len(total))
    total[:, index.shape[1]] += counts.astype(np.int64)


def word_vectors(docs: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (rows x 2 size) and word counts from all documents.

    Every task adds up a table of fixed size, which is summed slab by slab; the driver receives the sum. A vector is the
    word's context vector, centred and scaled to length one, followed by its own index vector.
    """
    s = settings
    if s.rows >= 1 << 15:
        raise ValueError("at most 32767 rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, gap = index_vectors(s), np.full(s.window, -1, np.int32)
        total = np.zeros((s.rows, s.size + 1), np.int64)
        held, size = [], 0
        for batch in batches:
            for text in raw(batch, "text"):
                held += [numbers(text or b"", s), gap]
                size += len(held[-2])
                if size > 200_000:
                    _add_contexts(total, np.concatenate(held), index, s.window)
                    held, size = [], 0
        if held:
            _add_contexts(total, np.concatenate(held), index, s.window)
        yield in_slabs(total.ravel())

    total = summed(docs.select("text").mapInArrow(run, SLABS))
    total = (total if len(total) else np.zeros(s.rows * (s.size + 1))).reshape(s.rows, s.size + 1).astype(float)
    contexts, counts = total[:, : s.size], total[:, s.size]
    contexts = contexts / np.maximum(counts, 1)[:, None]
    contexts -= (counts @ contexts) / max(counts.sum(), 1)
    contexts[counts == 0] = 0
    contexts /= np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)
    return np.hstack([contexts, index_vectors(s)]).astype(np.float32), counts


def _pooled(texts: list[bytes | None], vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Mean word vector of each text; zeros for a text without words."""
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for i, text in enumerate(texts):
        found = numbers(text or b"", s)
        if len(found):
            seen, times = np.unique(found, return_counts=True)
            out[i] = times.astype(np.float32) @ vectors[seen] / len(found)
    return out


@dataclass(frozen=True)
class Network:
    """Input scaling, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises the log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def train(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Adam on the log loss with weight decay; one row in ten is kept for the temperature and to pick the best epoch."""
    rng = np.random.default_rng(s.seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    own = np.arange(len(x)) % 10 == 9
    xt, yt = ((x - mean) / scale)[~own], y[~own].astype(float)
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), "b1": np.zeros(s.hidden),
         "w2": rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), "b2": np.zeros(1)}
    m1, m2, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    best, best_loss = None, np.inf
    for _ in range(s.epochs):
        for part in np.array_split(rng.permutation(len(xt)), max(1, len(xt) // s.batch)):
            a, b = xt[part], yt[part]
            h = np.tanh(a @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -60, 60))) - b) / max(1, len(part))
            dh = np.outer(d, p["w2"]) * (1 - h * h)
            grad = {"w1": a.T @ dh + s.decay * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + s.decay * p["w2"],
                    "b2": d.sum(keepdims=True)}
            t += 1
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - s.rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
        net = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
        if not own.any():
            best = net
            continue
        z = net.logits(x[own])
        loss = float(np.mean(np.logaddexp(0, z) - y[own] * z))
        if loss < best_loss:
            best, best_loss = net, loss
    if not own.any() or len(set(y[own].tolist())) < 2:
        return best
    return Network(best.mean, best.scale, best.w1, best.b1, best.w2, best.b2, temperature(best.logits(x[own]), y[own]))


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Word vectors come from the texts of all documents, the network from at most ``sample_rows`` labelled documents
    outside fold 0. Without a labelled row every score is one half. Null and empty texts pool to zeros and are scored
    like others; null ids count as the empty text when folds are drawn and are never labelled; repeated rows stay
    repeated; extra columns are ignored; an empty table gives an empty result.
    """
    s, spark = settings, docs.sparkSession
    vectors, _ = word_vectors(docs, s)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _pooled(raw(batch, "text"), shared.value, s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
                ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", s.sample_rows)
    schema = T.StructType([*sample.select("doc_id", "label").schema, T.StructField("x", T.BinaryType())])
    table = sample.mapInArrow(pool, schema).toArrow()
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("label").to_pylist(), table.column("x").to_pylist()))
    net = None
    if rows:
        order = np.random.default_rng(s.seed).permutation(len(rows))
        x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1)[order]
        net = train(x.astype(float), np.array([int(r[1] > 0) for r in rows])[order], s)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _pooled(raw(batch, "text"), shared.value, s)
            p = net.probabilities(x) if net is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(
        score, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
