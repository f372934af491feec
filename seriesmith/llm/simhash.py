"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import raw, stored, tidy
from seriesmith.llm.components import connected_components

BITS = 64
#: Shingles whose bits are counted at once; bounds a task's memory for very long texts.
CHUNK = 1 << 17


def text_fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text: a bit is set when it is set in over half the hashes of its word shingles."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key if there is one, fp): the 64 bits as a signed long; null and wordless texts have fingerprint zero."""
    rest = [c for c in ("doc_id", "key") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t or b"", width, seed) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, rest), pa.array(np.array(fps, np.uint64).view(np.int64))], [*rest, "fp"])

    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("fp", T.LongType())])
    return docs.select(*rest, "text").mapInArrow(tidy(run), schema)


def _ball(radius: int) -> list[int]:
    """Masks of every fingerprint within ``radius`` bits of zero, as signed longs."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(BITS)}
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sorted(masks)]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all pairs within ``radius`` (even) bits.

    Every fingerprint emits all variants within half the radius; two fingerprints within the radius meet at a variant
    between them. A bucket holds at most the ball's size (65 for radius 2), because fingerprints are distinct, so no
    bucket can be hot. Neighbours in a bucket's order are paired, which joins the whole bucket; the pairs are
    deduplicated and verified. A pair within the radius that is not adjacent in its bucket is joined through others of
    the same bucket, which all lie within the radius of each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both sides go half the way")
    variants = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in _ball(radius // 2)])).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    previous = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", previous.alias("previous")).filter("previous IS NOT NULL")
    return pairs.distinct().filter(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("previous"))) <= radius
    ).select(F.col("previous").alias("a"), F.col("fp").alias("b"))


def _marked(docs: DataFrame, radius: int, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) of every row and (fp, least, component) of every fingerprint, both written down."""
    marked = stored(fingerprints(docs.withColumn("key", row_key()), width, seed), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(marked.select("fp").distinct(), radius))
    classes = least.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    return marked, stored(classes, "classes")


def row_key() -> Column:
    """Names a row by its id and a hash of its text; never null."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")),
                       F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``radius`` differing bits.

    Copies share a fingerprint and meet as one node, so they cost one row each. Null texts count as empty; null ids get
    a component like any other but are never its smallest id, unless all are null; repeated rows stay repeated; an empty
    table gives an empty result. Extra columns are ignored.
    """
    marked, classes = _marked(docs, radius, width, seed)
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = classes.join(smallest, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate group with the columns of ``docs``: that with the smallest id.

    A null id is the largest; rows that share the smallest id are settled by a hash of their text.
    """
    marked, classes = _marked(docs, radius, width, seed)
    return first_rows(docs, marked.join(classes.select("fp", "component"), "fp"))


def first_rows(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Of each component of ``named`` (doc_id, key, component) the row of ``docs`` with the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = named.groupBy("component").agg(first.alias("first"))
    keys = kept.select(F.col("first.key").alias("__kept"))
    one = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))  # equal keys: equal rows
    return (
        docs.withColumn("__key", row_key()).join(keys, F.col("__key") == F.col("__kept"), "left_semi")
        .withColumn("__n", one).filter("__n = 1").select(*docs.columns)
    )


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
