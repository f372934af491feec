"""Isolation Forest as tables: sampling and grouping by Spark, small vectorised tree steps inside tasks.

A forest is a table of nodes (spec, tree, node, feature, threshold, size, path); node numbers follow the heap
order, so the children of ``i`` are ``2i`` and ``2i + 1``. All randomness is md5 of (seed, purpose, tree, node or row
key), so results do not depend on how the rows are partitioned, a lost task rebuilds the same trees, and any engine
with md5 grows the same forest.

Trees share the rows: a task grows many trees from one copy of the rows that any of them samples. Sub-samples too large
for a task are first split from the top, level by level, by passes over the rows as they lie: a pass walks every row down
the tops found so far and sums up the ranges of the open nodes, so no row is copied or written for a tree. Both ways give
the same trees.

``fit_and_score`` is for forests that are only needed for their scores: tasks read the rows from the shared folder, grow
their trees, walk the rows to be scored down them and keep neither trees nor copies of rows.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.operators.features import as_doubles
from seriesmith.session import pin, store

NODE_SCHEMA = ("spec int, tree int, node long, depth int, feature int, threshold double, size long, path double")
MAX_GROUP_CELLS = 20_000_000  # rows x features one task may hold while growing a tree
MAX_SHARED_NODES = 4_000_000  # nodes sent to every executor at once (about 32 bytes each)
MAX_TOP_NODES = 200_000  # nodes above the task-sized ones that one block of trees may have
PARTS_PER_TASK = 4  # parts of a forest, each grown from one copy of the rows, per task that runs at once
MAX_HELD_CELLS = 30_000_000  # rows x features a task keeps in memory; more of them lie in a file that it maps
MAX_HELD_NODES = 4_000_000  # nodes a task keeps (24 bytes each) before it walks the rows down them
MAX_CELLS_WALKED = 2_000_000  # rows x features walked at once
PATH_UNIT = float(1 << 40)  # path lengths are summed as whole numbers of this part of one, so their order does not matter
ATTEMPTS = 8  # features drawn for a node before all of them are looked at
AUTO_SAMPLES = 256
DEFAULT_CUT = 0.5


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class ForestSpec:
    """One parameter setting; a forest with fewer trees is a prefix of one with more."""

    n_trees: int = 300
    max_samples: str = "auto"
    max_features: str = "1.0"
    seed: int = 42

    def sample_size(self, n_rows: int) -> int:
        if self.max_samples == "auto":
            return min(AUTO_SAMPLES, n_rows)
        return max(1, int(float(self.max_samples) * n_rows))

    def n_features(self, d: int) -> int:
        return max(1, int(float(self.max_features) * d))


@dataclass
class Forests:
    """Fitted forests: the node table, the specs (by position) and the sub-sample size of each."""

    nodes: DataFrame
    specs: list[ForestSpec]
    sample_sizes: list[int]


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _digits(texts: Sequence[bytes]) -> np.ndarray:
    """The first two runs of 13 hexadecimal digits of each text's md5 as numbers in [0, 1)."""
    if not texts:
        return np.zeros((0, 2))
    md5 = hashlib.md5
    raw = np.frombuffer(b"".join([md5(t).digest()[:13] for t in texts]), np.uint8).reshape(-1, 13).astype(np.int64)
    high, low = raw[:, 6] >> 4, raw[:, 6] & 15
    first = np.zeros(len(raw), np.int64)
    for i in range(6):
        first, low = first << 8 | raw[:, i], low << 8 | raw[:, 7 + i]
    return np.stack([first << 4 | high, low], axis=1) / float(1 << 52)


class NodeDraws:
    """The draws of one tree's nodes: (place of the cut, place in the tree's features) of each attempt."""

    TABLE = 1 << 20  # first attempts of nodes below this number are kept by number

    def __init__(self, seed: int, tree: int):
        self.head, self.known = f"{seed}:node:{tree}", {}
        self.table = np.full((64, 2), np.nan)

    def _drawn(self, nodes: np.ndarray, attempt: int) -> np.ndarray:
        return _digits([f"{self.head}:{n}:{attempt}".encode() for n in nodes.tolist()])

    def __call__(self, nodes: np.ndarray, attempt: int = 0) -> np.ndarray:
        if not len(nodes):
            return np.zeros((0, 2))
        top = int(nodes.max())
        if attempt == 0 and top < self.TABLE:
            if top >= len(self.table):
                grown = np.full((1 << top.bit_length(), 2), np.nan)
                grown[:len(self.table)] = self.table
                self.table = grown
            new = nodes[np.isnan(self.table[nodes, 0])]
            self.table[new] = self._drawn(new, 0)
            return self.table[nodes]
        new = np.array([n for n in nodes.tolist() if (n, attempt) not in self.known], np.int64)
        self.known.update(((n, attempt), v) for n, v in zip(new.tolist(), self._drawn(new, attempt).tolist()))
        return np.array([self.known[n, attempt] for n in nodes.tolist()])


@lru_cache(maxsize=1024)
def _feature_order(seed: int, tree: int, d: int) -> list[int]:
    return sorted(range(d), key=lambda f: hashlib.md5(f"{seed}:feature:{tree}:{f}".encode()).hexdigest())


def tree_features(spec: ForestSpec, tree: int, d: int) -> np.ndarray:
    """Sorted feature subset of a tree, drawn without replacement: those with the first md5 texts."""
    return np.sort(np.array(_feature_order(spec.seed, tree, d)[: spec.n_features(d)], dtype=np.int64))


def depth_limit(sample_size: int) -> int:
    return max(1, math.ceil(math.log2(max(sample_size, 2))))


def _cut(u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    at = low + u * (high - low)
    return np.where(at >= high, low, at)


def _cells(x: np.ndarray, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """One value of each row; columns that lie one after another are read by place."""
    return x.T.reshape(-1).take(feature * len(x) + rows) if x.flags.f_contiguous else x[rows, feature]


def _next_varying(low: np.ndarray, high: np.ndarray, place: int) -> int:
    """The first place from ``place`` on, in a circle, whose range is not one value; -1 if there is none."""
    found = np.flatnonzero(low < high)
    return int(found[np.searchsorted(found, place) % len(found)]) if len(found) else -1


def _grow(x: np.ndarray, rows: np.ndarray, subset: np.ndarray, draws: NodeDraws, root: int, depth: int, limit: int,
          classes: np.ndarray | None = None) -> list[np.ndarray]:
    """Node, depth, feature, threshold, size and path of a (sub)tree's nodes, by node number.

    A node draws a feature of the tree's subset until one varies in it, so a level reads one value of each row and
    attempt. After ``ATTEMPTS`` draws it takes the next one that varies, if there is any. Rows of a node follow each other;
    a split moves those of the left child before those of the right one. ``classes`` numbers the rows of ``x`` so that rows of
    one number are equal: nodes of such rows are leaves without a look at their features.
    """
    ids, sizes = np.array([root], np.int64), np.array([len(rows)], np.int64)
    levels = []
    while len(rows):
        starts = np.cumsum(sizes) - sizes
        feature = np.full(len(ids), -1)
        low, high, u = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        value = np.empty(len(rows))
        open_ = np.flatnonzero(sizes > 1) if depth < limit else np.zeros(0, np.int64)
        if classes is not None and len(open_):
            own = classes[rows]
            open_ = open_[(np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts))[open_]]
        for attempt in range(ATTEMPTS):
            if not len(open_):
                break
            drawn = draws(ids[open_], attempt)
            if attempt == 0:
                u[open_] = drawn[:, 0]
            place, own = (drawn[:, 1] * len(subset)).astype(np.int64), slice(None)
            if len(open_) < len(ids):
                is_open = np.zeros(len(ids), bool)
                is_open[open_] = True
                own = np.flatnonzero(np.repeat(is_open, sizes))
            v = _cells(x, rows[own], np.repeat(subset[place], sizes[open_]))
            value[own] = v
            at = np.cumsum(sizes[open_]) - sizes[open_]
            lo, hi = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
            varies = lo < hi
            hit = open_[varies]
            feature[hit], low[hit], high[hit] = subset[place[varies]], lo[varies], hi[varies]
            open_, place = open_[~varies], place[~varies]
        for i, p in zip(open_.tolist(), place.tolist() if len(open_) else ()):
            cells = x[rows[starts[i]:starts[i] + sizes[i]]][:, subset]
            lo, hi = cells.min(axis=0), cells.max(axis=0)
            if (k := _next_varying(lo, hi, p)) >= 0:
                feature[i], low[i], high[i] = subset[k], lo[k], hi[k]
                value[starts[i]:starts[i] + sizes[i]] = cells[:, k]
        splits = feature >= 0
        cut = _cut(u, low, high)
        levels.append((ids, np.full(len(ids), depth), feature, np.where(splits, cut, np.nan), sizes,
                       np.where(splits, np.nan, depth + average_path(sizes))))
        if not splits.all():
            keep = np.repeat(splits, sizes)
            rows, value, ids, sizes, cut = rows[keep], value[keep], ids[splits], sizes[splits], cut[splits]
        if not len(rows):
            break
        right = value > np.repeat(cut, sizes)
        starts = np.cumsum(sizes) - sizes
        lefts = np.cumsum(~right)  # left rows up to and including this one
        before = lefts[starts] - ~right[starts]
        n_left = np.add.reduceat(~right, starts, dtype=np.int64)
        nth, first = np.arange(len(rows)), np.repeat(starts, sizes)
        among_left = lefts - 1 - np.repeat(before, sizes)
        to = np.where(right, np.repeat(starts + n_left, sizes) + (nth - first) - (among_left + 1), first + among_left)
        moved = np.empty_like(rows)
        moved[to] = rows
        rows = moved
        ids = np.stack([2 * ids, 2 * ids + 1], axis=1).reshape(-1)
        sizes = np.stack([n_left, sizes - n_left], axis=1).reshape(-1)
        if not sizes.all():
            ids, sizes = ids[sizes > 0], sizes[sizes > 0]
        depth += 1
    return [np.concatenate(c) for c in zip(*levels)]


def grow(x: np.ndarray, rows: np.ndarray, subset: np.ndarray, draws: NodeDraws, root: int, depth: int, limit: int) -> pd.DataFrame:
    """Grow one (sub)tree from the given rows of ``x``, all nodes of a level at a time."""
    columns = _grow(x, rows, subset, draws, root, depth, limit)
    return pd.DataFrame(dict(zip(["node", "depth", "feature", "threshold", "size", "path"], columns)))


def pack(df: DataFrame, keys: Sequence[str], features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Row key, kept columns and the features as one vector (missing values must be filled before scoring)."""
    return df.select(*keys, *keep, F.array(*as_doubles(df, features)).alias("vec"))


def _key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys])


def _draws(seed: int, n_trees: int, keys: Sequence[str], first: int | Column = 0, step: int = 1) -> Column:
    """A row's uniform draw for the trees ``first``, ``first + step``, ...; an md5 serves two trees."""
    key = _key_text(keys)

    def draw(t: Column) -> Column:
        text = F.md5(F.concat(F.lit(f"{seed}:row:"), F.floor(t / 2).cast("string"), F.lit(":"), key).cast("binary"))
        digits = F.when(t % 2 == 0, F.substring(text, 1, 13)).otherwise(F.substring(text, 14, 13))
        return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))

    trees = F.sequence(F.lit(first), F.lit(n_trees - 1), F.lit(step))
    return F.transform(trees, lambda t: F.struct(t.alias("tree"), draw(t).alias("u")))


def sample_cuts(packed: DataFrame, keys: Sequence[str], seed: int, n_trees: int, size: int, n_rows: int) -> list[float]:
    """Per tree the ``size``-th smallest draw, so that rows at or below it are a sub-sample of exactly that size.

    The draws are uniform, so that value lies in a narrow band around size / n_rows: rows below the band are counted and
    the band's few draws (about the square root of ``size``) are sorted. A tree whose value lies outside is met again
    with a wider band. One number per tree is collected.
    """
    if size >= n_rows:
        return [1.0] * n_trees
    width = 6 * math.sqrt(size) + 10
    while True:
        low, high = max(0.0, (size - width) / n_rows), min(1.0, (size + width) / n_rows)
        near = F.filter(_draws(seed, n_trees, keys), lambda p: p["u"] < high) if high < 1 else _draws(seed, n_trees, keys)
        u = F.col("p.u")
        # The outer form: the plain one would evaluate the draws again to filter empty arrays.
        found = packed.select(F.explode_outer(near).alias("p")).filter("p IS NOT NULL").groupBy("p.tree").agg(
            F.count_if(u < low).alias("below"), F.sort_array(F.collect_list(F.when(u >= low, u))).alias("band"))
        at = F.lit(size) - F.col("below")
        cut = F.when((at >= 1) & (at <= F.size("band")), F.get("band", (at - 1).cast("int")))
        cuts = {r["tree"]: r["cut"] for r in found.select("tree", cut.alias("cut")).collect()}
        if len(cuts) == n_trees and None not in cuts.values():
            return [cuts[t] for t in range(n_trees)]
        width *= 4


def _sampled_trees(seed: int, n_trees: int, keys: Sequence[str], cuts: Sequence[float], first: int | Column = 0,
                   step: int = 1) -> Column:
    """Trees whose sub-sample holds the row, each with the row's draw."""
    limits = F.array(*[F.lit(float(c)) for c in cuts[:n_trees]])
    return F.filter(_draws(seed, n_trees, keys, first, step), lambda p: p["u"] <= F.get(limits, p["tree"]))


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = len(vectors)
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _memberships(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, tree and draw of every (row, tree) in a column of arrays of (tree, u)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pairs = lists.flatten()
    return rows, pairs.field("tree").to_numpy(), pairs.field("u").to_numpy()


def fit_forests(packed: DataFrame, keys: Sequence[str], specs: Sequence[ForestSpec],
                max_group_cells: int = MAX_GROUP_CELLS) -> Forests:
    """Fit every spec on the packed rows (``pack``); row keys must be unique.

    Every sub-sample has exactly the wanted number of rows, wherever it is grown. Trees are dealt to a few parts
    for each task that runs at once, and a row goes to a part once, with the trees there that sample it; a part has fewer
    trees where their sub-samples together would exceed ``max_group_cells``. The input is read several times (row count, cuts
    and growing), so pin it when it is expensive.
    """
    n_rows, d = packed.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n_rows:
        raise ValueError("no rows to fit on")
    room = max(1, max_group_cells // max(d, 1))
    spec_list, sizes = list(specs), [s.sample_size(n_rows) for s in specs]
    in_task = [i for i, size in enumerate(sizes) if size <= room]
    tasks, most = parallelism(packed.sparkSession), 1
    groups, tops = [], []
    for seed in sorted({spec_list[i].seed for i in in_task}):
        # A row's draw for a tree is the same in every spec of a seed, so the largest sub-sample contains the others
        # and one copy of its rows serves all of them.
        group = [i for i in in_task if spec_list[i].seed == seed]
        trees, size = max(spec_list[i].n_trees for i in group), max(sizes[i] for i in group)
        cuts = sample_cuts(packed, keys, seed, trees, size, n_rows)
        parts = PARTS_PER_TASK * tasks
        if n_rows > room:
            parts = max(parts, -(-trees // max(1, room // size)))
        parts = min(parts, trees)
        most = max(most, parts)
        groups.append(_sampled_rows(packed, keys, seed, cuts, parts, -1 - seed))
    for i, (spec, size) in enumerate(zip(spec_list, sizes)):
        if i not in in_task:
            cuts = sample_cuts(packed, keys, spec.seed, spec.n_trees, size, n_rows)
            block = max(1, MAX_TOP_NODES * room // (4 * size))  # trees whose tops are found together
            for first in range(0, spec.n_trees, block):
                rows, top = _fit_tops(packed, keys, i, spec, cuts, range(first, min(first + block, spec.n_trees)),
                                      depth_limit(size), d, room)
                groups += rows
                tops += top
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def build(group: pa.Table) -> pa.Table:
        code, node, depth = (group.column(c)[0].as_py() for c in ("spec", "node", "depth"))
        x, (row, tree, u) = _matrix(group.column("vec")), _memberships(group.column("trees"))
        own = [code] if code >= 0 else [i for i in in_task if spec_list[i].seed == -1 - code]
        order = np.lexsort((u, tree))
        row, tree = row[order], tree[order]
        made = []
        for t, start, count in zip(*(v.tolist() for v in np.unique(tree, return_index=True, return_counts=True))):
            draws = NodeDraws(spec_list[own[0]].seed, t)
            subsets = {i: tree_features(spec_list[i], t, x.shape[1]) for i in own if t < spec_list[i].n_trees}
            for i, subset in subsets.items():
                # The wanted number of rows, by lowest draw; a node of a top has all its rows.
                rows = row[start:start + (min(count, sizes[i]) if code < 0 else count)]
                made.append(grow(x, rows, subset, draws, node, depth, depth_limit(sizes[i])).assign(spec=i, tree=t))
        return pa.Table.from_pandas(pd.concat(made, ignore_index=True)[names], node_schema, preserve_index=False)

    node_schema = pa.schema([("spec", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("depth", pa.int32()),
                             ("feature", pa.int32()), ("threshold", pa.float64()), ("size", pa.int64()), ("path", pa.float64())])
    # Growing costs far more than the bytes suggest, so the number of partitions is fixed rather than coalesced by size,
    # and so large that few parts share one.
    by = ["spec", "part", "node", "depth"]
    spread = reduce(DataFrame.unionByName, groups).repartition(max(tasks, PARTS_PER_TASK * most), *by)
    grown = reduce(DataFrame.unionByName, tops, spread.groupBy(*by).applyInArrow(build, NODE_SCHEMA))
    return Forests(pin(grown), spec_list, sizes)


def _sampled_rows(packed, keys, seed, cuts, n_parts, code):
    """A row once for every part that has a tree whose sub-sample holds it."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda g: F.struct(
        g.alias("part"), _sampled_trees(seed, len(cuts), keys, cuts, g, n_parts).alias("trees")))
    return packed.select("vec", F.explode_outer(parts).alias("p")).filter(F.size("p.trees") > 0).select(
        F.lit(code).alias("spec"), "p.part", F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"), "p.trees", "vec")


class _Top:
    """The decided nodes above the open ones of some trees, by tree: sorted node numbers, features and thresholds."""

    def __init__(self, decided: dict[int, dict[int, tuple[int, float]]]):
        self.trees = {}
        for t, nodes in decided.items():
            ids = sorted(nodes)
            self.trees[t] = (np.array(ids, np.int64), np.array([nodes[n][0] for n in ids], np.int64),
                             np.array([nodes[n][1] for n in ids], float))

    def walk(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node below the decided ones that each row of ``x`` comes to; 0 where it ends in a finished leaf."""
        at = np.ones(len(x), np.int64)
        ids, feature, threshold = self.trees.get(tree, (np.zeros(0, np.int64),) * 3)
        going = np.arange(len(x)) if len(ids) else np.zeros(0, np.int64)
        while len(going):
            i = np.minimum(np.searchsorted(ids, at[going]), len(ids) - 1)
            inner = (ids[i] == at[going]) & (feature[i] >= 0)
            at[going[(ids[i] == at[going]) & (feature[i] == -1)]] = 0
            going, i = going[inner], i[inner]
            at[going] = 2 * at[going] + (x[going, feature[i]] > threshold[i])
        return at


def _fit_tops(packed, keys, code, spec, cuts, trees, limit, d, room):
    """Split the nodes of some trees that hold more rows than ``room``; returns rows for the tasks and finished nodes.

    A level is one pass over the rows in place: tasks walk each row down the decided nodes, which are few because only
    nodes above ``room`` are split here, and sum up sizes and ranges of the features that the open nodes draw. Nodes
    whose draws all fail are measured again over all features. The driver holds the decided nodes of the block.
    """
    subsets = {t: tree_features(spec, t, d) for t in trees}
    rows = packed.select("vec", F.filter(
        _sampled_trees(spec.seed, trees.stop, keys, cuts, trees.start, 1), lambda p: p["tree"] >= trees.start).alias("trees"))
    decided: dict[int, dict[int, tuple[int, float]]] = {t: {} for t in trees}
    made, ready = [], set()

    def measured(only: dict[int, set[int]] | None) -> list:
        """(tree, node, place, size, low, high) of the open nodes: drawn places, or every place of the nodes in ``only``."""
        top, closed = _Top(decided), ready

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, (row, tree, _) = _matrix(batch.column("vec")) if batch.num_rows else None, _memberships(batch.column("trees"))
                out = []
                for t in np.unique(tree).tolist():
                    own = row[tree == t]
                    at = top.walk(x[own], t)
                    ids = [n for n in np.unique(at).tolist() if n and (t, n) not in closed and (only is None or n in only[t])]
                    draws = NodeDraws(spec.seed, t)
                    for n in ids:
                        cells = x[own[at == n]]
                        places = range(len(subsets[t])) if only is not None else dict.fromkeys(
                            int(draws(np.array([n]), a)[0, 1] * len(subsets[t])) for a in range(ATTEMPTS))
                        for p in places:
                            v = cells[:, subsets[t][p]]
                            out.append((t, n, p, len(v), float(v.min()), float(v.max())))
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))],
                    ["tree", "node", "place", "size", "low", "high"])

        ranges = rows.mapInArrow(run, "tree int, node long, place int, size long, low double, high double")
        return ranges.groupBy("tree", "node", "place").agg(
            F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high")).collect()

    depth = 0
    while True:
        found: dict[tuple[int, int], dict[int, tuple]] = {}
        for r in measured(None):
            found.setdefault((r["tree"], r["node"]), {})[r["place"]] = (r["size"], r["low"], r["high"])
        if not found:
            break
        stuck: dict[int, set[int]] = {}
        chosen: dict[tuple[int, int], tuple] = {}
        for (t, n), places in found.items():
            size = next(iter(places.values()))[0]
            drawn = [int(NodeDraws(spec.seed, t)(np.array([n]), a)[0, 1] * len(subsets[t])) for a in range(ATTEMPTS)]
            hit = next((p for p in drawn if places[p][1] < places[p][2]), None)
            if size <= room and depth < limit:
                ready.add((t, n))
            elif size > 1 and depth < limit and hit is None:
                stuck.setdefault(t, set()).add(n)
                chosen[t, n] = (size, drawn[-1])
            else:
                chosen[t, n] = (size, None) if depth >= limit or hit is None else (size, hit, *places[hit][1:])
        if stuck:
            every: dict[tuple[int, int], dict[int, tuple]] = {}
            for r in measured({t: stuck.get(t, set()) for t in trees}):
                every.setdefault((r["tree"], r["node"]), {})[r["place"]] = (r["low"], r["high"])
            for key, places in every.items():
                low, high = (np.array([places[p][k] for p in range(len(places))]) for k in (0, 1))
                size, start = chosen[key]
                k = _next_varying(low, high, start)
                chosen[key] = (size, None) if k < 0 else (size, k, float(low[k]), float(high[k]))
        for (t, n), (size, place, *span) in chosen.items():
            if place is None:
                decided[t][n] = (-1, math.nan)
                made.append((code, t, n, depth, -1, None, size, depth + float(average_path(size))))
            else:
                cut = float(_cut(NodeDraws(spec.seed, t)(np.array([n]))[:, 0], *span)[0])
                decided[t][n] = (int(subsets[t][place]), cut)
                made.append((code, t, n, depth, int(subsets[t][place]), cut, size, None))
        depth += 1
    top = _Top(decided)

    def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, (row, tree, u) = _matrix(batch.column("vec")), _memberships(batch.column("trees"))
            at = np.zeros(len(row), np.int64)
            for t in np.unique(tree).tolist():
                at[tree == t] = top.walk(x[row[tree == t]], t)
            keep = np.flatnonzero(at)
            pairs = [[{"tree": t, "u": v}] for t, v in zip(tree[keep].tolist(), u[keep].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree[keep], pa.int32()), pa.array(at[keep]),
                 pa.array([n.bit_length() - 1 for n in at[keep].tolist()], pa.int32()),
                 pa.array(pairs, pa.list_(pa.struct([("tree", pa.int32()), ("u", pa.float64())]))),
                 batch.column("vec").take(pa.array(row[keep]))], ["part", "node", "depth", "trees", "vec"])

    spark = packed.sparkSession
    open_rows = rows.mapInArrow(
        hand_over, "part int, node long, depth int, trees array<struct<tree: int, u: double>>, vec array<double>")
    return [open_rows.withColumn("spec", F.lit(code))] if ready else [], [spark.createDataFrame(made, NODE_SCHEMA)]


@dataclass
class _Trees:
    """Several trees in flat arrays: children by position, siblings next to each other (right is left + 1)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    share: np.ndarray  # trees x slots, 1 where a tree counts for a slot


def _flatten(nodes: pd.DataFrame, slots: Sequence[tuple[int, int]]) -> _Trees:
    nodes = nodes.sort_values(["spec", "tree", "node"], ignore_index=True)
    spec, tree, node = (nodes[c].to_numpy() for c in ("spec", "tree", "node"))
    roots = np.flatnonzero(np.r_[True, (spec[1:] != spec[:-1]) | (tree[1:] != tree[:-1])])
    feature = nodes["feature"].to_numpy()
    left = np.zeros(len(nodes), dtype=np.int64)
    for start, end in zip(roots, np.r_[roots[1:], len(nodes)]):
        left[start:end] = start + np.searchsorted(node[start:end], 2 * node[start:end])
    share = np.array([[spec[r] == i and tree[r] < p for i, p in slots] for r in roots], dtype=float)
    return _Trees(feature, nodes["threshold"].to_numpy(), left, nodes["path"].to_numpy(), roots, share)


def _path_sums(x: np.ndarray, trees: _Trees, cells: int = 1_000_000) -> np.ndarray:
    """Path lengths summed per slot (rows x slots); many trees are walked at once, in pieces of bounded size."""
    sums = np.zeros((len(x), trees.share.shape[1]))
    step = max(1, cells // max(len(x), 1))
    for start in range(0, len(trees.roots), step):
        roots = trees.roots[start:start + step]
        at = np.tile(roots, len(x))
        row = np.repeat(np.arange(len(x)), len(roots))
        walking = np.flatnonzero(trees.feature[at] >= 0)
        while len(walking):
            here = at[walking]
            to = trees.left[here] + (x[row[walking], trees.feature[here]] > trees.threshold[here])
            at[walking] = to
            walking = walking[trees.feature[to] >= 0]
        sums += trees.path[at].reshape(len(x), len(roots)) @ trees.share[start:start + step]
    return sums


def score_forests(packed: DataFrame, forests: Forests, prefixes: Sequence[int] | None = None,
                  max_shared_nodes: int = MAX_SHARED_NODES) -> DataFrame:
    """Anomaly scores in (0, 1], higher is more anomalous: one row per input row, spec and prefix.

    Adds ``spec``, ``n_trees`` and ``score``. Trees are sent to the executors in blocks of bounded size; a tree too
    large for one block is walked by joins instead.
    """
    spark = packed.sparkSession
    counts = forests.nodes.groupBy("spec", "tree").count().collect()
    huge = {(r["spec"], r["tree"]) for r in counts if r["count"] > max_shared_nodes}
    wanted = [sorted({min(p, s.n_trees) for p in (prefixes or [s.n_trees])}) for s in forests.specs]
    keep = [c for c in packed.columns if c != "vec"]
    # One sum per (spec, prefix segment): the trees between one prefix and the next.
    slots = [(i, p) for i, ps in enumerate(wanted) for p in ps]
    blocks, block, filled = [], [], 0
    for r in sorted(counts, key=lambda r: (r["spec"], r["tree"])):
        if (r["spec"], r["tree"]) in huge:
            continue
        if block and filled + r["count"] > max_shared_nodes:
            blocks.append(block)
            block, filled = [], 0
        block.append((r["spec"], r["tree"]))
        filled += r["count"]
    if block:
        blocks.append(block)

    summed = packed.withColumn("sums", F.array(*[F.lit(0.0)] * len(slots)))
    for number, block in enumerate(blocks):
        picked = _of_block(forests.nodes, block, huge)
        shared = spark.sparkContext.broadcast(_flatten(picked.toArrow().to_pandas(), slots))

        def walk(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x, sums = np.stack(pdf["vec"].to_numpy()), np.stack(pdf["sums"].to_numpy())
                    pdf = pdf.assign(sums=list(sums + _path_sums(x, shared.value)))
                yield pdf

        summed = summed.mapInPandas(walk, summed.schema)
        if number + 1 < len(blocks):
            # Only one block is held by the executors at a time.
            summed = pin(summed)
            shared.destroy()
    c = average_path(np.array(forests.sample_sizes))
    cells = [F.struct(F.lit(i).alias("spec"), F.lit(p).alias("n_trees"), F.col("sums")[j].alias("total"))
             for j, (i, p) in enumerate(slots)]
    tall = summed.select(*keep, F.inline(F.array(*cells)))
    if huge:
        extra = _walk_by_joins(packed, keep, forests, sorted(huge), slots)
        tall = tall.unionByName(extra).groupBy(*keep, "spec", "n_trees").agg(F.sum("total").alias("total"))
    scale = F.element_at(F.array(*[F.lit(float(v)) for v in c]), F.col("spec") + 1)
    mean = F.col("total") / F.col("n_trees")
    score = F.pow(F.lit(2.0), -F.when(scale > 0, mean / scale).otherwise(1.0))
    return tall.select(*keep, "spec", "n_trees", score.alias("score"))


def _of_block(nodes: DataFrame, block: list[tuple[int, int]], huge: set[tuple[int, int]]) -> DataFrame:
    """Nodes of a block's trees; a block is a run of the sorted tree list, so one range per spec names it."""
    cond = F.lit(False)
    for spec in sorted({s for s, _ in block}):
        trees = [t for s, t in block if s == spec]
        cond = cond | ((F.col("spec") == spec) & F.col("tree").between(min(trees), max(trees)))
    for spec, tree in sorted(huge):
        cond = cond & ~((F.col("spec") == spec) & (F.col("tree") == tree))
    return nodes.filter(cond)


def _walk_by_joins(packed, keep, forests, huge, slots):
    """Path sums of trees too large to send around: rows move down one level per join with the node table."""
    nodes = forests.nodes
    depth = max(depth_limit(s) for s in forests.sample_sizes)
    pairs = F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(t).alias("tree")) for s, t in huge])
    state = packed.select(*keep, "vec", F.inline(pairs)).withColumn("node", F.lit(1).cast("long"))
    finished = None
    for level in range(depth + 1):
        # All rows of a huge tree meet its few upper nodes, so these are sent around; a level has at most 2 ** level.
        at = nodes.filter(F.col("depth") == level).select("spec", "tree", "node", "feature", "threshold", "path")
        few = 2 ** level * len(huge) <= MAX_SHARED_NODES
        moved = pin(state.join(F.broadcast(at) if few else at, ["spec", "tree", "node"]))
        ended = moved.filter("feature < 0").select(*keep, "spec", "tree", "path")
        finished = ended if finished is None else finished.unionByName(ended)
        state = moved.filter("feature >= 0").select(
            *keep, "vec", "spec", "tree",
            (F.col("node") * 2 + (F.get("vec", F.col("feature")) > F.col("threshold")).cast("long")).alias("node"))
    sized = finished.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.lit(p).alias("n_trees"))
                                                    for i, p in slots])).alias("slot"))
    return sized.filter((F.col("slot.s") == F.col("spec")) & (F.col("tree") < F.col("slot.n_trees"))).groupBy(
        *keep, "spec", F.col("slot.n_trees").alias("n_trees")).agg(F.sum("path").alias("total"))


def _read_batches(uris: Sequence[str], columns: Sequence[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of Parquet files of the shared folder, file by file."""
    for uri in uris:
        system, path = FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows, columns=list(columns), use_threads=False)


def _read_matrix(uris: Sequence[str], n_rows: int, d: int, max_held_cells: int) -> tuple[list[bytes], np.ndarray, np.ndarray | None]:
    """Key texts, the matrix of all rows, column after column, and the numbers of equal rows if there are any.

    A large matrix lies in a nameless file of the task.
    """
    if n_rows * d <= max_held_cells:
        columns = np.empty((d, n_rows))
    else:
        columns = np.memmap(tempfile.TemporaryFile(), dtype=np.float64, mode="w+", shape=(d, n_rows))
    keys, at, numbers, classes = [], 0, {}, np.empty(n_rows, np.int64)
    for batch in _read_batches(uris, ["key", "vec"], max(1, MAX_CELLS_WALKED // max(d, 1))):
        cells = _matrix(batch.column("vec"))
        columns[:, at:at + batch.num_rows] = cells.T
        classes[at:at + batch.num_rows] = [numbers.setdefault(hashlib.md5(row.tobytes()).digest(), len(numbers)) for row in cells]
        keys += [k.encode() for k in batch.column("key").to_pylist()]
        at += batch.num_rows
    return keys, np.asarray(columns).T, classes if len(numbers) < n_rows else None


def _walk_tree(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    at = np.zeros(len(x), np.int32)
    going = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    here = at[going]
    while len(going):
        here = left[here] + (_cells(x, going, feature[here]) > threshold[here])
        at[going] = here
        inner = feature[here] >= 0
        going, here = going[inner], here[inner]
    return at


def fit_and_score(packed: DataFrame, keys: Sequence[str], specs: Sequence[ForestSpec], rows: DataFrame,
                  prefixes: Sequence[int] | None = None, max_held_cells: int = MAX_HELD_CELLS,
                  max_held_nodes: int = MAX_HELD_NODES) -> DataFrame:
    """Scores of ``rows`` under the forests fitted on ``packed``: the scores of ``fit_forests`` and ``score_forests``.

    Both inputs are written to the shared folder once. A task reads the fitted rows from there, grows a run of trees under
    every spec, walks the rows to be scored down them, batch by batch, and hands on one sum per row and spec. Neither trees
    nor copies of rows are written, so disk grows with the rows and the tasks, not with trees or nodes. Fitted rows of more
    than ``max_held_cells`` cells lie in a file that the task maps; besides them it holds some numbers per fitted row and
    ``max_held_nodes`` nodes.
    """
    spark, specs = packed.sparkSession, list(specs)
    n_rows, d = packed.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n_rows:
        raise ValueError("no rows to fit on")
    fitted = store(packed.select(_key_text(keys).alias("key"), "vec"), "fitted").inputFiles()
    keep = [c for c in rows.columns if c != "vec"]
    scored = store(rows.withColumn("__row", F.monotonically_increasing_id()), "scored")
    walked = scored.inputFiles()
    sizes = [s.sample_size(n_rows) for s in specs]
    wanted = [sorted({min(p, s.n_trees) for p in (prefixes or [s.n_trees])}) for s in specs]
    # Runs of trees end where a prefix ends, so a run counts wholly for a prefix or not at all.
    ends = sorted({p for ps in wanted for p in ps})
    step = max(1, -(-ends[-1] // (PARTS_PER_TASK * spark.sparkContext.defaultParallelism)))
    runs = [(t, min(t + step, end)) for start, end in zip([0, *ends], ends) for t in range(start, end, step)]
    names = [f"s{i}" for i in range(len(specs))]
    schema = pa.schema([("__row", pa.int64()), ("last", pa.int32()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_texts, x, classes = None, None, None
        for number in [n for batch in batches for n in batch.column("id").to_pylist()]:
            if x is None:
                key_texts, x, classes = _read_matrix(fitted, n_rows, d, max_held_cells)
            first, last = runs[number]
            held, n_held, row_draws = [], 0, {}
            for t in range(first, last):
                draws, orders = {}, {}
                for i, spec in enumerate(specs):
                    if t >= spec.n_trees:
                        continue
                    if spec.seed not in orders:
                        if (spec.seed, t // 2) not in row_draws:
                            head = f"{spec.seed}:row:{t // 2}:".encode()
                            row_draws = {k: v for k, v in row_draws.items() if k[1] == t // 2}
                            row_draws[spec.seed, t // 2] = _digits([head + k for k in key_texts])
                        orders[spec.seed] = np.argsort(row_draws[spec.seed, t // 2][:, t % 2], kind="stable")
                        draws[spec.seed] = NodeDraws(spec.seed, t)
                    node, _, feature, threshold, _, path = _grow(
                        x, orders[spec.seed][:sizes[i]], tree_features(spec, t, d), draws[spec.seed], 1, 0, depth_limit(sizes[i]), classes)
                    left = np.searchsorted(node, 2 * node).astype(np.int32)
                    units = np.rint(np.nan_to_num(path) * PATH_UNIT).astype(np.int64)
                    held.append((i, feature.astype(np.int32), threshold, left, units))
                    n_held += len(node)
                if n_held < max_held_nodes and t < last - 1:
                    continue
                for batch in _read_batches(walked, ["__row", "vec"], max(1, MAX_CELLS_WALKED // max(d, 1))):
                    own = np.asfortranarray(_matrix(batch.column("vec")))
                    sums = np.zeros((len(specs), len(own)), np.int64)
                    for i, feature, threshold, left, units in held:
                        sums[i] += units[_walk_tree(own, feature, threshold, left)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("__row"), pa.array(np.full(len(own), last, np.int32)), *[pa.array(v) for v in sums]], schema=schema)
                held, n_held = [], 0

    parts = spark.range(0, len(runs), 1, len(runs)).mapInArrow(
        run, "__row long, last int, " + ", ".join(f"{n} long" for n in names))
    per_run = parts.groupBy("__row", "last").agg(*[F.sum(n).alias(n) for n in names])
    totals = per_run.groupBy("__row").agg(*[
        F.sum(F.when(F.col("last") <= p, F.col(names[i]))).alias(f"t{i}_{p}") for i, ps in enumerate(wanted) for p in ps])
    c = average_path(np.array(sizes))
    cells = []
    for i, ps in enumerate(wanted):
        for p in ps:
            mean = F.col(f"t{i}_{p}") / F.lit(PATH_UNIT) / F.lit(p)
            score = F.pow(F.lit(2.0), -(mean / F.lit(float(c[i])) if c[i] > 0 else F.lit(1.0)))
            cells.append(F.struct(F.lit(i).alias("spec"), F.lit(p).alias("n_trees"), score.alias("score")))
    return scored.select("__row", *keep).join(totals, "__row").select(*keep, F.inline(F.array(*cells)))


def default_prediction(scored: DataFrame, cut: float = DEFAULT_CUT) -> DataFrame:
    """Anomalous when the score exceeds one half; ``decision`` is the shifted score, positive when anomalous."""
    return scored.withColumns({"prediction": (F.col("score") > cut).cast("int"), "decision": F.col("score") - cut})
