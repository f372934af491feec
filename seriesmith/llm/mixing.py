"""Mixing sources to target weights: hash-random keys, a range sort and distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.llm.common import WORD, prefix_sums, stored, tidy, word_count
from seriesmith.operators.ordered import join_null_safe


def random_key(seed: int) -> Column:
    """Hash-random key of a document: depends on seed, id, source and text, never on partitioning."""
    return F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.coalesce("source", F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")),
    ).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets per source from (source, source_size): weight shares of the total, never above ``max_epochs`` sizes.

    The excess of capped sources is shared by weight among the others until none is above. Each round is one aggregate
    over the per-source table that returns two sums and a count.
    """
    ranked = prefix_sums(sizes.withColumn("__one", F.lit(1)), [], [F.col("source").asc_nulls_last()], "__one", "__rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.alias("__weight")), "sources")
    limit = F.col("source_size") * max_epochs
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        # A source stays capped: the level only rises from round to round.
        hit = F.lit(False) if level is None else limit <= F.lit(level) * F.col("__weight")
        fixed, open_weight, n = table.agg(
            F.sum(F.when(hit, limit).otherwise(0)), F.sum(F.when(hit, 0).otherwise(F.col("__weight"))),
            F.sum(hit.cast("long")),
        ).first()
        if not open_weight or n == capped:
            break
        level, capped = (total - fixed) / open_weight, n
    share = F.lit(level if level is not None else 0.0) * F.col("__weight")
    target = F.when(limit <= share, limit.cast("double")).otherwise(share.cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: size, source_size, target, taken (words the mix takes, repeats counted) and its key.

    A source's budget is its target rounded down. It is met exactly: whole passes over the source first, then documents
    in the order of their random keys until the budget ends, the last of them in part. Null texts count as empty and
    are taken 0 words; a null source is a source of its own; rows that repeat id and text stay separate rows; an empty
    table gives an empty result. Extra columns are ignored.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(seed).alias("key"))
    ordered = stored(prefix_sums(rows, ["source"], [F.col("key"), F.col("doc_id")], "size", "before"), "mixorder")
    targets = source_targets(ordered.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    # One row per source; the join leaves the choice of a broadcast to the optimizer's size check.
    joined = join_null_safe(ordered, targets, ["source"], "inner")
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (passes * F.col("size") + part).cast("long")
    return joined.select("doc_id", "source", "key", "size", "source_size", "target", taken.alias("taken"))


def _first_words(columns: list[str]):
    word = re.compile(WORD.encode())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            texts = []
            for text, n in zip(df["text"], df["__rest"]):
                data, end = text.encode(), 0
                for _, m in zip(range(n), word.finditer(data)):
                    end = m.end()
                texts.append(data[:end].decode())
            df["text"] = texts
            yield df[columns]

    return cut


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3,
                    seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last one of a source cut after its taken words.

    Documents without words are not part of it. ``n_chars``, where present, follows the cut text.
    """
    columns = docs.columns
    n = Window.partitionBy("__key").orderBy(F.lit(0))
    # Repeated rows share a key; numbering them on both sides pairs each row with one decision.
    chosen = mix(docs, weights, max_epochs, seed).select(
        F.col("key").alias("__ckey"), "size", "taken",
        F.row_number().over(Window.partitionBy("key").orderBy(F.col("taken").desc())).alias("__cn"),
    ).filter("taken > 0")
    keyed = docs.withColumn("__key", random_key(seed)).withColumn("__n", F.row_number().over(n))
    both = keyed.join(
        chosen.select("__ckey", F.col("size").alias("__size"), F.col("taken").alias("__taken"), "__cn"),
        (F.col("__key") == F.col("__ckey")) & (F.col("__n") - F.col("__cn") == 0),
    )
    copies = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    whole = both.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*columns)
    last = both.withColumn("__rest", F.col("__taken") % F.col("__size")).filter("__rest > 0")
    schema = docs.schema
    part = last.select(*columns, "__rest").mapInPandas(tidy(_first_words(columns)), schema)
    if "n_chars" in columns:
        part = part.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*columns)
    return whole.unionByName(part)
