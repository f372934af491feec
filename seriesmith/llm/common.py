"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmith.operators.ordered import join_null_safe
from seriesmith.session import scratch_path

#: Fixed pattern of a word: a run of bytes other than the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SLABS = "slab int, sums binary"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads survive a lost executor and repeat no work."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are reused, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` of a task's batches, a group or two groups; once it has ended, what it freed is given back."""
    if inspect.isgeneratorfunction(run):
        def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)
            give_back()
    elif len(inspect.signature(run).parameters) == 2:
        def after(left: pa.Table, right: pa.Table) -> pa.Table:
            out = run(left, right)
            give_back()
            return out
    else:
        def after(table: pa.Table) -> pa.Table:
            out = run(table)
            give_back()
            return out
    return after


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; :func:`unpack_arrays` takes their types."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    press = zstandard.ZstdCompressor(level=1).compressobj(size=head.nbytes + sum(a.nbytes for a in arrays))
    # One behind the other, without a copy of them all.
    parts = [press.compress(np.ascontiguousarray(a).reshape(-1).view(np.uint8)) for a in (head, *arrays)]
    return b"".join([*parts, press.flush()])


def unpack_arrays(blob: bytes | pa.Buffer, *dtypes: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<i8", len(dtypes), 8)
    ends = np.cumsum(sizes) + 8 * (len(dtypes) + 1)
    return [np.frombuffer(data[e - n:e], d) for e, n, d in zip(ends.tolist(), sizes.tolist(), dtypes)]


def summed(parts: DataFrame) -> np.ndarray:
    """Element-wise sum of vectors of 64-bit integers that tasks sent in slabs (slab, sums); one vector is collected."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column("sums"))
        return pa.table({"slab": table.column("slab")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    table = parts.groupBy("slab").applyInArrow(add, SLABS).toArrow()
    rows = sorted(zip(table.column("slab").to_pylist(), table.column("sums").to_pylist()))
    return np.frombuffer(b"".join(b for _, b in rows), np.int64)


def in_slabs(vector: np.ndarray, slabs: int = 32) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(slabs), pa.int32()),
         pa.array([v.tobytes() for v in np.array_split(vector.astype(np.int64), slabs)], pa.binary())], ["slab", "sums"])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def known_labels(labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(__id, __label) outside fold 0: one row per id, with its largest label; null ids and labels are left out."""
    return (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
        .filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & (fold(F.col("__id"), folds) != 0))
        .groupBy("__id").agg(F.max("__label").alias("__label"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5,
                    even: bool = False) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside fold 0, the smallest by a hash of the id.

    ``even`` takes at most half of them from each side of the label. The ids are drawn from the narrow label table. A
    document is a distinct (id, text); where ids repeat with other texts, the documents to keep are drawn from their
    hashes before any text is sent, so that both broadcasts have at most ``rows`` rows.
    """
    def first(df: DataFrame, order: list[str]) -> DataFrame:
        def least(side: DataFrame, n: int) -> DataFrame:
            return side.orderBy(F.xxhash64(*order), *order).limit(n)

        if not even:
            return least(df, rows)
        return least(df.filter("__label > 0"), rows // 2).unionByName(least(df.filter("__label <= 0"), rows - rows // 2))

    ids = first(known_labels(labels, label, folds), ["__id"])
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").alias("__doc"), text.alias("text"), F.xxhash64(text).alias("__hash"))
    found = texts.select("__doc", "__hash").join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    chosen = first(found.select("__id", "__hash", "__label").distinct(), ["__id", "__hash"])
    own = texts.withColumnRenamed("__hash", "__own")
    return own.join(F.broadcast(chosen), (F.col("__doc") == F.col("__id")) & (F.col("__own") == F.col("__hash"))).groupBy(
        F.col("__id").alias("doc_id"), "__hash", F.col("__label").alias("label")
    ).agg(F.first("text").alias("text")).select("doc_id", "text", "label")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str,
                partitions: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same key, however many rows a key has.

    Rows are range-partitioned by (key, order) into blocks of even size, so a hot key spans many blocks. Sums run
    inside each block; what lies before a block comes from a table with one row per (key, block).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order)
    # The bounds of a range shuffle are sampled, so the blocks are written down before they are read twice.
    blocks = stored(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__block", F.spark_partition_id()),
        "blocks",
    )
    within = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    offsets = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    local = blocks.withColumn("__before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = join_null_safe(local, offsets, keys, "inner", plain=["__block"])
    return joined.withColumn(name, F.col("__before") + F.col("__offset")).drop("__before", "__offset", "__block")
