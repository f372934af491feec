"""Exact top-k by integer inner product: KD-trees per shard, searched best-first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import stored
from seriesmith.llm.vectors import classes, decode, spread, valid_rows

LEAF_ROWS = 256
SHARD_ROWS = 8192
#: Rows that the cells above the shards are fitted on, and the most cells; both bound what the driver holds and sends.
SAMPLE_ROWS = 16_384
MAX_CELLS = 1024
#: Distinct query vectors that visit a shard in one task.
BLOCK_QUERIES = 50_000
FOUND = "array<struct<negative: long, vec_id: long, score: long>>"
LOWEST = (-(1 << 62), 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(64 x) as 64-bit integers."""
    return np.floor(64.0 * x).astype("<i8")


class Tree:
    """A KD-tree: median splits along the widest side, and for each node its tight box and smallest id."""

    def __init__(self, rows: np.ndarray, ids: list[list[int]], leaf_rows: int = LEAF_ROWS):
        largest = float(np.abs(rows).max(initial=0))
        # Sums below 2 ** 53 are exact in doubles, whose products run in the fast library; others stay integers.
        exact = largest * largest * rows.shape[1] < 2.0 ** 52
        rows = rows.astype(float) if exact else rows
        least = np.array([i[0] for i in ids], np.int64)
        order = np.arange(len(rows))
        self.first, self.last, self.child = [], [], []
        low, high, smallest = [], [], []
        waiting = [(0, len(rows), -1)]
        while waiting:
            a, b, parent = waiting.pop()
            node = len(self.first)
            if parent >= 0:
                self.child[parent].append(node)
            own = rows[order[a:b]]
            self.first.append(a)
            self.last.append(b)
            self.child.append([])
            low.append(own.min(0))
            high.append(own.max(0))
            smallest.append(int(least[order[a:b]].min()))
            if b - a > leaf_rows:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(high[-1] - low[-1])], middle)]
                waiting += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high, self.smallest = np.array(low), np.array(high), smallest
        self.rows, self.ids = rows[order], [ids[i] for i in order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that any point of each node's box has with each query."""
        q = queries.astype(self.rows.dtype)
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor: tuple[int, int]) -> list[tuple[int, int]]:
        """The (score, -id) above ``floor``, at most k, best nodes first.

        ``floor`` is the k-th best of other shards; it rises as better rows are found, and the search ends at the first
        node whose box and smallest id cannot beat it.
        """
        q = query.astype(self.rows.dtype)
        best: list[tuple[int, int]] = []
        heap = [(-int(bounds[0]), self.smallest[0], 0)]
        while heap:
            negative, smallest, node = heapq.heappop(heap)
            if (-negative, -smallest) <= floor:
                break
            if self.child[node]:
                for c in self.child[node]:
                    entry = (int(bounds[c]), -self.smallest[c])
                    if entry > floor:
                        heapq.heappush(heap, (-entry[0], -entry[1], c))
                continue
            a, b = self.first[node], self.last[node]
            scores = self.rows[a:b] @ q
            for i in np.flatnonzero(scores >= floor[0]).tolist():
                score = int(scores[i])
                for vec in self.ids[a + i]:
                    if (score, -vec) <= floor:
                        break
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec))
                    else:
                        heapq.heapreplace(best, (score, -vec))
                    if len(best) == k:
                        floor = max(floor, best[0])
        return best


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """Median splits of a sample as nodes (dimension, value, left, right); below 0 stands -1 - cell."""
    nodes: list[tuple[int, int, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, depth: int) -> int:
        nonlocal made
        if depth == 0 or len(rows) < 2 or (rows.max(0) == rows.min(0)).all():
            made += 1
            return -made
        d = int(np.argmax(rows.max(0) - rows.min(0)))
        value = int(np.sort(rows[:, d])[(len(rows) - 1) // 2])
        if value == rows[:, d].max():
            value -= 1
        node = len(nodes)
        nodes.append((d, value, 0, 0))
        left = grow(rows[rows[:, d] <= value], depth - 1)
        nodes[node] = (d, value, left, grow(rows[rows[:, d] > value], depth - 1))
        return node

    grow(sample, max(0, int(np.ceil(np.log2(max(1, cells))))))
    return nodes


def cell_of(rows: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    if not nodes:
        return np.zeros(len(rows), np.int32)
    table = np.array(nodes, np.int64)
    at = np.zeros(len(rows), np.int64)
    while (open_ := at >= 0).any():
        node = table[at[open_]]
        left = rows[open_, node[:, 0]] <= node[:, 1]
        at[open_] = np.where(left, node[:, 2], node[:, 3])
    return (-1 - at).astype(np.int32)


def _found(best: list[tuple[int, int]]) -> list[dict]:
    return [{"negative": -s, "vec_id": -n, "score": s} for s, n in best]


_FOUND_ARROW = pa.list_(pa.struct([("negative", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS,
                leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by ``every`` the k rows with the largest inner product.

    Components are floor(64 x); ties go to the smaller id; a row is never its own result. Equal vectors are one class
    that keeps its k + 1 smallest ids, which are all that can be returned. Classes are dealt to cells by median splits
    fitted on at most ``SAMPLE_ROWS`` classes, and inside a cell by hash to shards of about ``shard_rows``. Each query
    searches its own shard first; its k-th best goes along to the shards whose cell's box can still beat it.

    Rows without id or with a null vector, an empty one or a null or non-finite component take no part. Rows that repeat
    an id and a vector count once; queries that share an id are answered together. Vectors of different lengths are an
    error. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = valid_rows(vectors)
    known = stored(classes(rows, scaled, k + 1, every), "classes")
    n, asked = known.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0))).first()
    cells = min(MAX_CELLS, max(1, -(-n // shard_rows)))
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    pick = known.select("code").filter(F.abs(F.xxhash64("code") % 1_000_003) < int(share * 1_000_003) + 1)
    sample = pick.limit(2 * SAMPLE_ROWS).toArrow().column("code")
    nodes = fit_cells(decode(sample, "<i8"), cells)

    def deal(batches):
        for batch in batches:
            x = decode(batch.column("code"), "<i8")
            cell = cell_of(x, nodes) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    dealt = stored(known.mapInArrow(deal, "code binary, ids array<long>, query boolean, cell int"), "cells")
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().toLocalIterator()}  # at most MAX_CELLS rows
    parts = {c: max(1, -(-m // shard_rows)) for c, m in sizes.items()}
    first = dict(zip(sorted(parts), np.cumsum([0, *[parts[c] for c in sorted(parts)]]).tolist()))
    if not parts:
        parts, first = {0: 1}, {0: 0}
    # (number of shards, first shard) of each cell.
    table = F.create_map(*[F.lit(v) for c in sorted(parts) for v in (c, parts[c])])
    begin = F.create_map(*[F.lit(v) for c in sorted(parts) for v in (c, first[c])])
    sharded = dealt.withColumn(
        "shard", (F.element_at(begin, F.col("cell")) + F.pmod(F.xxhash64("code"), F.element_at(table, F.col("cell"))))
        .cast("int"))

    def home(group: pa.Table) -> pa.Table:
        x, ids = decode(group.column("code"), "<i8"), group.column("ids").to_pylist()
        tree = Tree(x, ids, leaf_rows)
        own = np.flatnonzero(group.column("query").to_numpy())
        bounds = tree.bounds(x[own])
        found = [tree.search(x[i], b, k + 1, LOWEST) for i, b in zip(own, bounds)]
        floors = [min(f) if len(f) > k else LOWEST for f in found]
        return pa.table({
            "cell": pa.repeat(group.column("cell")[0], len(own) + 1),
            "shard": pa.repeat(group.column("shard")[0], len(own) + 1),
            "code": pa.array([*[x[i].tobytes() for i in own], None], pa.binary()),
            "floor": pa.array([*[f[0] for f in floors], None], pa.int64()),
            "floor_id": pa.array([*[f[1] for f in floors], min(i[0] for i in ids)], pa.int64()),
            "found": pa.array([*map(_found, found), None], _FOUND_ARROW),
            "box": pa.array([*[None] * len(own), np.stack([x.min(0), x.max(0)]).tobytes()], pa.binary())})

    at_home = stored(sharded.groupBy("shard").applyInArrow(
        home, f"cell int, shard int, code binary, floor long, floor_id long, found {FOUND}, box binary"), "home")

    def widen(group: pa.Table) -> pa.Table:
        boxes = np.stack([np.frombuffer(b.as_buffer(), "<i8").reshape(2, -1) for b in group.column("box")])
        box = np.stack([boxes[:, 0].min(0), boxes[:, 1].max(0)])
        return pa.table({"cell": group.column("cell")[:1], "box": pa.array([box.tobytes()], pa.binary()),
                         "least": pa.array([min(group.column("floor_id").to_pylist())], pa.int64())})

    # One box per cell, so at most MAX_CELLS of them are collected and sent.
    boxes = at_home.filter("box IS NOT NULL").groupBy("cell").applyInArrow(
        widen, "cell int, box binary, least long").collect()
    boxes.sort(key=lambda r: r["cell"])
    shared = spark.sparkContext.broadcast([(r["cell"], r["least"], bytes(r["box"])) for r in boxes])
    blocks = max(1, -(-asked // BLOCK_QUERIES))

    def visits(batches):
        cells = [c for c, _, _ in shared.value]
        least = np.array([m for _, m, _ in shared.value], np.int64)
        box = np.stack([np.frombuffer(b, "<i8").reshape(2, -1) for _, _, b in shared.value]) if cells else None
        for batch in batches:
            out = []
            x = decode(batch.column("code"), "<i8")
            if len(x):
                fit = np.abs(box).max() * np.abs(x).max() * x.shape[1] < 2.0 ** 52
                q, low, high = (v.astype(float if fit else np.int64) for v in (x, box[:, 0], box[:, 1]))
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                floor, last = batch.column("floor").to_numpy(), batch.column("floor_id").to_numpy()
                hit = (bound > floor[:, None]) | ((bound == floor[:, None]) & (-least > last[:, None]))
                own = batch.column("shard").to_pylist()
                out = [(i, first[cells[c]] + s) for i, c in zip(*np.nonzero(hit)) for s in range(parts[cells[c]])
                       if first[cells[c]] + s != own[i]]
            take = batch.take(pa.array([i for i, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for _, s in out], pa.int32()), *[take.column(c) for c in ("code", "floor", "floor_id")]],
                ["shard", "code", "floor", "floor_id"])

    block = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int")
    asking = at_home.filter("code IS NOT NULL").select("shard", "code", "floor", "floor_id").mapInArrow(
        visits, "shard int, code binary, floor long, floor_id long").withColumn("block", block)
    hosts = sharded.select("shard", "code", "ids").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(host: pa.Table, guests: pa.Table) -> pa.Table:
        codes, found = [], []
        if host.num_rows and guests.num_rows:
            tree = Tree(decode(host.column("code"), "<i8"), host.column("ids").to_pylist(), leaf_rows)
            x = decode(guests.column("code"), "<i8")
            floors = zip(guests.column("floor").to_pylist(), guests.column("floor_id").to_pylist())
            for q, b, floor in zip(x, tree.bounds(x), floors):
                if best := tree.search(q, b, k + 1, floor):
                    codes.append(q.tobytes())
                    found.append(_found(best))
        return pa.table({"code": pa.array(codes, pa.binary()), "found": pa.array(found, _FOUND_ARROW)})

    elsewhere = hosts.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(
        visit, f"code binary, found {FOUND}")
    together = at_home.filter("code IS NOT NULL").select("code", "found").unionByName(elsewhere)
    answers = together.groupBy("code").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    return spread(rows, answers, scaled, every, k, "score")
