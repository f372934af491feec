"""Approximate nearest neighbours: a forest of random-projection trees per shard and one priority queue per query."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import stored
from seriesmith.llm.vectors import classes, decode, spread, valid_rows

#: Rows of one shard's forest, and distinct query vectors that one task answers against it.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4096
FOUND = "array<struct<negative: double, vec_id: long, score: double>>"
_FOUND_ARROW = pa.list_(pa.struct([("negative", pa.float64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def plain(x: np.ndarray) -> np.ndarray:
    """The vectors as doubles, with one zero."""
    return x.astype("<f8") + 0.0


class Forest:
    """Trees that part rows by the plane halfway between two random rows, down to ``leaf_rows``."""

    def __init__(self, unit: np.ndarray, trees: int, leaf_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        normals, offsets, self.child, self.leaf = [], [], [], []
        self.roots = []
        for _ in range(trees):
            waiting = [(np.arange(len(unit)), -1, 0)]
            while waiting:
                rows, parent, side = waiting.pop()
                node = len(self.child)
                if parent < 0:
                    self.roots.append(node)
                else:
                    self.child[parent][side] = node
                self.child.append([-1, -1])
                self.leaf.append(None)
                normal, offset = np.zeros(unit.shape[1]), 0.0
                if len(rows) <= leaf_rows:
                    self.leaf[node] = rows
                else:
                    a, b = unit[rng.choice(rows, 2, replace=False)]
                    normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-300)
                    offset = -float(normal @ (a + b)) / 2
                    margin = unit[rows] @ normal + offset
                    right = margin > 0
                    if not 0.02 < right.mean() < 0.98:  # too uneven: split at the median
                        middle = len(rows) // 2
                        order = np.argpartition(margin, middle)
                        offset -= float(margin[order[middle]])
                        right = np.zeros(len(rows), bool)
                        right[order[middle:]] = True
                    waiting += [(rows[~right], node, 0), (rows[right], node, 1)]
                normals.append(normal)
                offsets.append(offset)
        self.normals, self.offsets = np.array(normals), np.array(offsets)

    def candidates(self, margins: np.ndarray, wanted: int, seen: np.ndarray) -> np.ndarray:
        """Rows of the leaves that come first in one queue over all trees, at least ``wanted`` of them if there are.

        A node's priority is the smallest margin by which the query lies on the far side of a plane above it.
        """
        seen[:] = False
        heap = [(-np.inf, r) for r in self.roots]
        found, count = [], 0
        while heap and count < wanted:
            priority, node = heapq.heappop(heap)
            while (rows := self.leaf[node]) is None:
                margin = margins[node]
                left, right = self.child[node]
                near, far = (right, left) if margin > 0 else (left, right)
                heapq.heappush(heap, (max(priority, abs(margin)), far))
                node = near
            new = rows[~seen[rows]]
            seen[new] = True
            found.append(new)
            count += len(new)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def cosines(x: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Cosines in double precision; every row is summed in the same order, so equal rows get equal scores."""
    return (x * q).sum(1) / (norms * q_norm)


def forest_search(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = 8, leaf_rows: int = 128,
                  search_share: float = 0.6, least_candidates: int = 2048, shard_rows: int = SHARD_ROWS,
                  seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by ``every`` the k nearest rows found, by cosine.

    Equal vectors are one class with its k + 1 smallest ids. Classes are dealt by hash to shards of about ``shard_rows``
    rows; every shard grows its own forest over all its rows, and blocks of queries visit every shard, where leaves are
    taken from one queue over all trees until ``search_share`` of the shard's rows, ``least_candidates`` at least, are
    candidates. Candidates are reranked by their exact cosines. ``search_share`` sets recall against cost; 1.0 is exact.

    Rows without id or with a null, empty or zero vector or a null or non-finite component take no part. Rows that
    repeat an id and a vector count once; queries that share an id are answered together. Vectors of different lengths
    are an error. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = valid_rows(vectors).filter(F.exists("vector", lambda v: v != 0))
    known = stored(classes(rows, plain, k + 1, every), "classes")
    n, asked = known.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // BLOCK_QUERIES))
    hosts = known.select(
        "code", "ids", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    guests = known.filter("query").select(
        F.col("code"), F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def visit(host: pa.Table, guests: pa.Table) -> pa.Table:
        codes, answers = [], []
        if host.num_rows and guests.num_rows:
            order = np.argsort(np.array([b.as_py() for b in host.column("code")], object))  # the forest reruns alike
            x, ids = decode(host.column("code"), "<f8")[order], host.column("ids").to_pylist()
            ids = [ids[i] for i in order]
            largest = np.abs(x).max(1, keepdims=True)
            norms = np.sqrt((x * x).sum(1))
            unit = x / largest
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            forest = Forest(unit, trees, leaf_rows, seed)
            wanted, seen = max(least_candidates, int(np.ceil(search_share * len(x)))), np.zeros(len(x), bool)
            queries = decode(guests.column("code"), "<f8")
            for part in np.array_split(queries, max(1, len(queries) // 256)):
                u = part / np.abs(part).max(1, keepdims=True)
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                for q, margins in zip(part, u @ forest.normals.T + forest.offsets):
                    near = forest.candidates(margins, wanted, seen)
                    scores = cosines(x[near], norms[near], q, float(np.sqrt((q * q).sum())))
                    best = np.argpartition(-scores, min(k + 1, len(near) - 1))[: k + 1] if len(near) > k + 1 else np.arange(len(near))
                    best = np.flatnonzero(scores >= scores[best].min()) if len(best) else best
                    hits = sorted((-float(scores[i]), vec, float(scores[i])) for i in best for vec in ids[near[i]])
                    codes.append(q.tobytes())
                    answers.append([{"negative": a, "vec_id": b, "score": c} for a, b, c in hits[: k + 1]])
        return pa.table({"code": pa.array(codes, pa.binary()), "found": pa.array(answers, _FOUND_ARROW)})

    found = hosts.groupBy("shard", "block").cogroup(guests.groupBy("shard", "block")).applyInArrow(
        visit, f"code binary, found {FOUND}")
    answers = found.groupBy("code").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    return spread(rows, answers, plain, every, k, "score")
