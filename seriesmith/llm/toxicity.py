"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import fold, give_back, known_labels, labelled_sample, pack_arrays, raw, unpack_arrays

#: Words whose scores a task remembers; the memory is emptied when full.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows used for the fit; ``buckets`` and ``size`` bound the model.

    Half of the sample is toxic, where there are enough; ``prior`` is the share of the difference to the true odds that
    the bias gets back (1: calibrated to the true rate, 0: as if half of all documents were toxic).
    """

    sample_rows: int = 6000
    grams: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 17
    size: int = 16
    epochs: int = 8
    batch: int = 128
    rate: float = 0.5
    prior: float = 0.5
    seed: int = 11


def subwords(words: list[bytes], grams: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's byte n-grams (the word in angle brackets) and of the whole word, with their word."""
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(data))  # bytes up to the word's end
    ids, owners = [], []
    prime = np.uint64(1099511628211)
    for n in grams:
        code = np.full(max(0, len(data) - n + 1), n, np.uint64)
        for i in range(n):
            code = (code ^ data[i:i + len(code)]) * prime
        ok = room[: len(code)] >= n
        ids.append(code[ok])
        owners.append(owner[: len(code)][ok])
    power = prime ** (np.arange(len(data), dtype=np.uint64) - np.repeat(ends - lengths, lengths).astype(np.uint64))
    sums = np.add.reduceat((data + np.uint64(7)) * power, ends - lengths)
    ids.append(sums * prime)
    owners.append(np.arange(len(words)))
    code = np.concatenate(ids)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(40)).astype(np.int64) % buckets, np.concatenate(owners)


def document_bag(text: bytes, grams: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A document as the mean of its words' subword bags: bucket numbers and weights that sum to 1."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ids, owners = subwords(list(counts), grams, buckets)
    per_word = np.fromiter(counts.values(), float, len(counts)) / len(words)
    weights = (per_word / np.bincount(owners))[owners]
    found, place = np.unique(ids, return_inverse=True)
    return found.astype(np.int32), np.bincount(place, weights).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Fit embeddings E and softmax weights W on averaged bags; returns each bucket's logit difference and the bias.

    A document's two logits are mean(E) @ W + b. Because E enters through the mean only, the gradient of a batch is the
    outer product of one number per bucket and the columns of W, so a step costs the batch's entries and one rank-one
    update. The learning rates follow each row's past gradients.
    """
    rng = np.random.default_rng(s.seed)
    E = rng.uniform(-1, 1, (s.buckets, s.size)).astype(np.float32) / s.size
    W, b = np.zeros((s.size, 2), np.float32), np.zeros(2, np.float32)
    W[:] = rng.normal(0, 0.1, W.shape)
    seen_e, seen_w, seen_b = np.full(s.buckets, 1e-8, np.float32), np.full(W.shape, 1e-8, np.float32), 1e-8
    order = np.arange(len(bags))
    for _ in range(s.epochs):
        rng.shuffle(order)
        for i in range(0, len(order), s.batch):
            part = order[i:i + s.batch]
            sizes = np.array([len(bags[k][0]) for k in part])
            if not sizes.sum():
                continue
            ids = np.concatenate([bags[k][0] for k in part])
            val = np.concatenate([bags[k][1] for k in part])
            row = np.repeat(np.arange(len(part)), sizes)
            used, place = np.unique(ids, return_inverse=True)
            rows = E[used]
            logits = np.stack([np.bincount(row, val * (rows @ W[:, c])[place], len(part)) for c in (0, 1)], 1) + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1  # gradient of the loss at the logits
            per_bucket = np.bincount(place, val * p[row, 1], len(used)).astype(np.float32)
            grad_w = np.outer(per_bucket @ rows, [-1, 1]).astype(np.float32)
            direction = W[:, 1] - W[:, 0]
            seen_e[used] += per_bucket ** 2 * float(direction @ direction) / s.size
            E[used] = rows - (s.rate * per_bucket / np.sqrt(seen_e[used]))[:, None] * direction
            seen_w += grad_w ** 2
            W -= s.rate * grad_w / np.sqrt(seen_w)
            step = p.sum(0)
            seen_b += float(step @ step)
            b -= (s.rate * step / np.sqrt(seen_b)).astype(np.float32)
    return (E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()):
    """Logit difference per bucket and bias, fitted on at most ``sample_rows`` labelled documents outside fold 0.

    The documents' bags are made by the tasks that read them; one further task takes the bounded sample, at most
    ``sample_rows`` bags of at most ``buckets`` entries, and trains on it. Only the model, ``buckets`` numbers, comes to
    the driver. Without any labelled row, every score is one half.
    """
    s = settings

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_bag(t, s.grams, s.buckets) for t in raw(batch, "text")]
            bags = [pack_arrays(np.diff(x, prepend=np.int32(0)), v) for x, v in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "bag"))))
        if rows:
            y, steps, weights, ends = np.array([int(label > 0) for _, label, _ in rows]), bytearray(), bytearray(), [0]
            while rows:  # two large buffers, which the worker gives back, instead of thousands of small arrays
                own = unpack_arrays(rows.pop(0)[2], "<i4", "<f4")
                steps += np.cumsum(own[0], dtype=np.int32).tobytes()
                weights += own[1].tobytes()
                ends.append(len(steps) // 4)
            ids, values = np.frombuffer(steps, np.int32), np.frombuffer(weights, np.float32)
            made = [(ids[a:b], values[a:b]) for a, b in zip(ends, ends[1:])]
            per_bucket, bias = train(made, y, s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([per_bucket.tobytes()], pa.binary()), pa.array([bias]), pa.array([len(y)], pa.int64()),
                 pa.array([int(y.sum())], pa.int64())], ["model", "bias", "n", "positive"])
            del made, ids, values, steps, weights
        give_back()

    sample = labelled_sample(docs, labels, label, s.sample_rows, even=True)
    schema = T.StructType([*sample.select("doc_id", "label").schema, T.StructField("bag", T.BinaryType())])
    fitted = sample.mapInArrow(bags, schema).repartition(1).mapInArrow(
        learn, "model binary, bias double, n long, positive long").first()
    if fitted is None:
        return np.zeros(s.buckets, np.float32), 0.0
    per_bucket, bias = np.frombuffer(fitted.model, np.float32), fitted.bias
    yes, no = known_labels(labels, label).agg(F.count_if(F.col("__label") > 0), F.count_if(F.col("__label") <= 0)).first()
    if 0 < fitted.positive < fitted.n:
        bias += s.prior * float(np.log(yes / no) - np.log(fitted.positive / (fitted.n - fitted.positive)))
    return per_bucket, bias


def score(docs: DataFrame, per_bucket: np.ndarray, bias: float, settings: Settings = Settings(),
          columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of every row with the probability of the label. The model sent along has ``buckets`` numbers."""
    grams, buckets = settings.grams, settings.buckets
    shared = docs.sparkSession.sparkContext.broadcast(per_bucket)
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        for batch in batches:
            out = []
            for text in raw(batch, "text"):
                words = (text or b"").lower().split()
                new = list({w for w in words if w not in memory})
                if new:
                    if len(memory) > REMEMBERED:
                        memory.clear()
                        new = list(set(words))
                    for i in range(0, len(new), 50_000):
                        part = new[i:i + 50_000]
                        ids, owners = subwords(part, grams, buckets)
                        memory.update(zip(part, (np.bincount(owners, model[ids]) / np.bincount(owners)).tolist()))
                logit = bias + (sum(map(memory.__getitem__, words)) / len(words) if words else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(logit, -60, 60))))
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(out, pa.float64())], [*columns, name])
        del memory
        give_back()

    schema = T.StructType([*docs.select(*columns).schema, T.StructField(name, T.DoubleType())])
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts get the score of the bias alone; null ids count as the empty text when folds are drawn and are
    never labelled; repeated rows stay repeated; extra columns are ignored; an empty table gives an empty result.
    """
    model, bias = fit(docs, labels, "toxic", settings)
    return score(docs, model, bias, settings).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``docs``."""
    model, bias = fit(docs, labels, "toxic", settings)
    scored = score(docs, model, bias, settings, tuple(docs.columns), "__toxicity")
    return scored.filter("__toxicity < 0.5").drop("__toxicity")
