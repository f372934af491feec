"""Language identification: TF-IDF n-gram vectors against several clustered centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import fold, pack_arrays, raw, unpack_arrays

#: Text of no language: null, or without any letter.
UNKNOWN = "und"
#: Bytes of a text whose n-grams are numbered at once; bounds a task's memory for very long texts.
CHUNK = 1 << 20
#: ASCII bytes other than letters read as a space.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the texts of a language that its centroids are clustered on; document frequencies and
    scores cover all rows. The model holds languages x ``clusters`` x ``buckets`` numbers."""

    grams: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    clusters: int = 4
    sample_rows: int = 800
    rounds: int = 10
    #: Share of a cluster's own sample that lies beyond its radius.
    beyond: float = 0.005
    seed: int = 5


def counts(text: bytes, grams: tuple[int, ...], buckets: int) -> np.ndarray:
    """How often each bucket's byte n-grams occur in a lower-case text, runs of other ASCII marks read as one space."""
    data = np.frombuffer(b" %b " % text.translate(_LETTERS), np.uint8)
    data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))].astype(np.uint64)
    total = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for start in range(0, len(data), CHUNK):
        for n in grams:
            size = min(CHUNK, len(data) - start - n + 1)
            if size > 0:
                code = np.full(size, n, np.uint64)
                for i in range(start, start + n):
                    code = code * np.uint64(257) + data[i:i + size]
                code *= np.uint64(0x9E3779B97F4A7C15)
                total += np.bincount((code >> shift).astype(np.int64), minlength=buckets)
    return total


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the normalised TF-IDF vector: (1 + log count) x inverse document frequency."""
    at = np.flatnonzero(found)
    values = (1 + np.log(found[at])) * idf[at]
    return at.astype(np.int32), (values / max(float(np.linalg.norm(values)), 1e-12)).astype(np.float32)


def inverse_frequencies(docs: DataFrame, s: Settings) -> np.ndarray:
    """log((1 + rows) / (1 + rows that have the bucket)) + 1 over all rows of ``docs``; ``buckets`` numbers are collected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(s.buckets, np.int64), 0
        for batch in batches:
            for text in raw(batch, "text"):
                held += counts(text, s.grams, s.buckets) > 0
            rows += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(  # bucket -1 holds the number of rows
            [pa.array([-1, *at.tolist()], pa.int32()), pa.array([rows, *held[at].tolist()], pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total, seen = 0, np.zeros(s.buckets)
    for bucket, n in zip(found.column("bucket").to_pylist(), found.column("n").to_pylist()):
        if bucket < 0:
            total = n
        else:
            seen[bucket] = n
    return np.log((1 + total) / (1 + seen)) + 1


def cluster(vectors: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of the rows: unit centroids and, for each, the least cosine that its radius allows."""
    rng = np.random.default_rng(s.seed)
    centres = vectors[[int(rng.integers(len(vectors)))]]
    while len(centres) < min(s.clusters, len(vectors)):  # next: a row drawn by its distance from the centroids so far
        far = np.clip(1 - (vectors @ centres.T).max(1), 0, None)
        if far.sum() <= 1e-9:
            break
        centres = np.vstack([centres, vectors[[int(rng.choice(len(vectors), p=far / far.sum()))]]])
    for _ in range(s.rounds):
        own = (vectors @ centres.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = vectors @ centres.T
    own = cosines.argmax(1)
    least = [np.quantile(cosines[own == c, c], s.beyond) if (own == c).any() else 1.0 for c in range(len(centres))]
    return centres.astype(np.float32), np.array(least, float)


def _lowered(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the lower-case text; null counts as empty."""
    return docs.select(*columns, F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """(lang, text) of at most ``rows`` different texts of each language, the smallest by a hash of the text.

    Only hashes are ranked, and of a language's hashes no more than about three times as many as are taken: those below
    a share of all hashes that its count sets.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("lang", F.xxhash64(text).alias("hash")).distinct()
    sizes = F.broadcast(narrow.groupBy("lang").agg(F.count("*").alias("all")))  # one row per language
    few = narrow.join(sizes, "lang").filter(F.pmod("hash", F.lit(1_000_003)) * F.col("all") <= 3 * rows * 1_000_003)
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1_000_003)), "hash")
    narrow = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)
    chosen = F.broadcast(narrow.select(F.col("lang").alias("l"), F.col("hash").alias("h")))  # rows x languages
    own = docs.select("lang", text.alias("text"), F.xxhash64(text).alias("hash"))
    return own.join(chosen, (F.col("lang") == F.col("l")) & (F.col("hash") == F.col("h"))).groupBy("lang", "hash").agg(
        F.first("text").alias("text")).select("lang", "text")


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # one number per bucket
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # buckets x centroids
    least: np.ndarray  # least cosine within each centroid's radius


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Document frequencies of all rows of ``docs`` (text, lang) and clustered centroids of each language's sample.

    Rows without language or text teach nothing. Without any row the model knows no language.
    """
    s = settings
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    idf = inverse_frequencies(_lowered(known), s)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pack_arrays(*vector(counts(t, s.grams, s.buckets), idf)) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(made, pa.binary())], ["lang", "bag"])

    def centres(group: pa.Table) -> pa.Table:
        rows = np.zeros((group.num_rows, s.buckets), np.float32)
        for i, blob in enumerate(sorted(group.column("bag").to_pylist())):  # the order of a shuffle has no say
            at, values = unpack_arrays(blob, "<i4", "<f4")
            rows[i, at] = values
        found, least = cluster(rows, s)
        return pa.table({"lang": pa.repeat(group.column("lang")[0], len(found)),
                         "centroid": pa.array([c.tobytes() for c in found], pa.binary()), "least": pa.array(least)})

    table = _lowered(sample(known, s.sample_rows), "lang").mapInArrow(bags, "lang string, bag binary").groupBy(
        "lang").applyInArrow(centres, "lang string, centroid binary, least double").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "centroid", "least"))))
    centroids = np.array([np.frombuffer(c, np.float32) for _, c, _ in rows]).reshape(-1, s.buckets)
    return Model(idf, [r[0] for r in rows], np.ascontiguousarray(centroids.T), np.array([r[2] for r in rows]))


def predict(docs: DataFrame, model: Model, settings: Settings = Settings(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, lang_pred, score and rejected: the language of the nearest centroid, its cosine, and whether the text
    lies beyond that centroid's radius. Null texts, texts without any letter, and all texts where no language is known
    are ``und`` with score 0, and rejected."""
    grams, buckets = settings.grams, settings.buckets
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores, beyond = [], [], []
            for text, lettered in zip(raw(batch, "__text"), batch.column("__lettered").to_pylist()):
                if not lettered or not m.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    beyond.append(True)
                    continue
                at, values = vector(counts(text, grams, buckets), m.idf)
                cosines = values @ m.centroids[at]
                best = int(cosines.argmax())
                names.append(m.languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
                beyond.append(bool(cosines[best] < m.least[best]))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, columns), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(beyond, pa.bool_())], [*columns, "lang_pred", "score", "rejected"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
             T.StructField("rejected", T.BooleanType())]
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, F.lower(text).alias("__text"), text.rlike(r"\p{L}").alias("__lettered")).mapInArrow(
        run, T.StructType([*docs.select(*columns).schema, *extra]))


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, learned from the rows outside one fold of the ids.

    A rejected text still names the nearest language; whoever wants none for it filters on ``rejected``. Null texts are
    ``und``; rows with a null language are scored only; null ids count as the empty text when folds are drawn; repeated
    rows stay repeated and count as often in the document frequencies, but once among the clustered texts; equal cosines
    go to the language that sorts first; extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    out = fold(F.col("doc_id"), folds) == held_out
    model = fit(docs.filter(~out), settings)
    return predict(docs, model, settings).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
