"""What both vector searches share: valid vectors, classes of equal vectors, answers per class spread to its queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task's batch that are grouped before the shuffle.
COMBINE_ROWS = 100_000


def valid_rows(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector of doubles) of rows with an id and a vector without null or non-finite components."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & finite).select(
        F.col(id_column).cast("long").alias("id"), x.alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    if len(column) and not (np.diff(column.offsets.to_numpy()) == rows.shape[1]).all():
        raise ValueError("vectors of different lengths")
    return rows


def decode(blobs: pa.ChunkedArray, dtype: str) -> np.ndarray:
    data = [b.as_buffer() for b in blobs]
    return np.stack([np.frombuffer(b, dtype) for b in data]) if data else np.zeros((0, 1), dtype)


def classes(rows: DataFrame, encode: Callable[[np.ndarray], np.ndarray], keep: int, every: int) -> DataFrame:
    """(code, ids, query): one row per distinct coded vector with its ``keep`` smallest ids; ids that repeat count once.

    ``query`` tells whether an id divisible by ``every`` has this vector. Tasks combine equal vectors before the
    shuffle, so even a vector that a third of all rows share arrives as at most ``keep`` ids from each batch.
    """
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        asked: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            ids = [sorted(set(v))[:keep] for v in held.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array([c in asked for c in held], pa.bool_())], ["code", "ids", "query"])

        for batch in batches:
            coded = encode(matrix(batch.column("vector"))) if batch.num_rows else ()
            for i, row in zip(batch.column("id").to_pylist(), coded):
                code = row.tobytes()
                held.setdefault(code, []).append(i)
                if i % every == 0:
                    asked.add(code)
            for code, ids in held.items():
                if len(ids) > 4 * keep:
                    held[code] = sorted(set(ids))[:keep]
            if len(held) > COMBINE_ROWS:
                yield flush()
                held, asked = {}, set()
        if held:
            yield flush()

    parts = rows.mapInArrow(combine, "code binary, ids array<long>, query boolean")
    return parts.groupBy("code").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"),
        F.bool_or("query").alias("query"))


def spread(rows: DataFrame, answers: DataFrame, encode: Callable[[np.ndarray], np.ndarray], every: int, keep: int,
           score: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from answers (code, found: sorted array of (order, vec_id, score)).

    Every query takes its class's answer without itself. Queries that share an id are answered together.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = encode(matrix(batch.column("vector"))) if batch.num_rows else ()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in coded], pa.binary())], ["query_id", "own"])

    queries = rows.filter(F.col("id") % every == 0).mapInArrow(code, "query_id long, own binary").distinct()
    joined = queries.join(answers, F.col("own") == F.col("code")).select(
        "query_id", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")).alias("found"))
    merged = joined.groupBy("query_id").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, keep).alias("found"))
    return merged.select("query_id", F.posexplode("found").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.col(f"hit.{score}").alias("score"))
