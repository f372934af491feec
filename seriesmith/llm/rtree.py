"""Hard negatives by an STR-packed R-tree: boxes give intervals of the inner product, one best-first queue per window."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import stored
from seriesmith.llm.vectors import classes, decode, valid_rows

LEAF_ROWS = 128
FANOUT = 8
SHARD_ROWS = 8192
#: Distinct rows that the tiles above the shards are fitted on, and the most tiles; both bound what the driver holds.
SAMPLE_ROWS = 32_768
MAX_TILES = 8192
#: Windows that one task searches against a shard.
BLOCK_WINDOWS = 50_000
NEVER = 1 << 62
WINDOW = "wid long, code binary, same boolean, low long, high long, keep int, floor long, floor_id long"
FOUND = "array<struct<negative: long, vec_id: long, score: long>>"
_FOUND_ARROW = pa.list_(pa.struct([("negative", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def scaled(rows: np.ndarray) -> np.ndarray:
    """The label, then floor(256 x) of each component, as 64-bit integers."""
    return np.concatenate([rows[:, :1], np.floor(256.0 * rows[:, 1:])], 1).astype("<i8")


def tiled(rows: np.ndarray, tiles: int, columns: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursive: row numbers in about ``tiles`` runs, cut along the first column and then inside each slab."""
    def cut(at: np.ndarray, n: int, rest: list[int]) -> list[np.ndarray]:
        if n <= 1 or not rest or len(at) <= 1:
            return [at]
        slabs = n if len(rest) == 1 else max(1, round(n ** (1 / len(rest))))
        order = at[np.argsort(rows[at, rest[0]], kind="stable")]
        return [tile for slab in np.array_split(order, min(slabs, len(at))) for tile in cut(slab, -(-n // slabs), rest[1:])]

    return cut(np.arange(len(rows)), tiles, columns)


class Tree:
    """An R-tree packed from sorted tiles: leaves of rows, then levels of ``FANOUT`` nodes with tight boxes.

    The first column of the rows is the label; it opens the tiling, so that few nodes mix labels.
    """

    def __init__(self, rows: np.ndarray, ids: list[list[int]], leaf_rows: int = LEAF_ROWS):
        label, x = rows[:, 0], rows[:, 1:]
        self.largest = float(np.abs(x).max(initial=0))
        wide = np.argsort(-np.ptp(x, axis=0), kind="stable")[:2] + 1
        leaves = tiled(rows, -(-len(rows) // leaf_rows), [0, *wide.tolist()])
        order = np.concatenate(leaves)
        self.rows, self.label, self.ids = x[order], label[order], [ids[i] for i in order]
        least = np.array([i[0] for i in self.ids], np.int64)
        ends = np.cumsum([len(t) for t in leaves])
        self.span = list(zip([0, *ends[:-1].tolist()], ends.tolist()))  # of leaves: rows
        cuts = [slice(a, b) for a, b in self.span]
        low, high = [self.rows[c].min(0) for c in cuts], [self.rows[c].max(0) for c in cuts]
        first, last = [self.label[c].min() for c in cuts], [self.label[c].max() for c in cuts]
        smallest = [int(least[c].min()) for c in cuts]
        self.leaves = len(leaves)
        level = list(range(self.leaves))
        self.children: dict[int, list[int]] = {}
        while len(level) > 1:
            above = []
            for i in range(0, len(level), FANOUT):
                own = level[i:i + FANOUT]
                self.children[len(low)] = own
                above.append(len(low))
                low.append(np.min([low[k] for k in own], axis=0))
                high.append(np.max([high[k] for k in own], axis=0))
                first.append(min(first[k] for k in own))
                last.append(max(last[k] for k in own))
                smallest.append(min(smallest[k] for k in own))
            level = above
        self.low, self.high, self.smallest = np.array(low), np.array(high), smallest
        self.first, self.last, self.root = np.array(first), np.array(last), len(low) - 1
        self.numbers: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _typed(self, query: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query, rows and box sides: doubles, whose products are fast, where all sums are exact in them."""
        exact = self.largest * float(np.abs(query).max(initial=0)) * len(query) < 2.0 ** 52
        kind = float if exact else np.int64
        if kind not in self.numbers:
            self.numbers[kind] = tuple(v.astype(kind) for v in (self.rows, self.low, self.high))
        return query.astype(kind), *self.numbers[kind]

    def search(self, query: np.ndarray, windows: list[tuple]) -> list[list[tuple[int, int]]]:
        """For each window (same, low, high, keep, floor, floor_id) the best (score, -id) inside it, above its floor.

        ``same`` wants rows of the query's label, else of any other. A node is left out if its interval of scores lies
        outside the window, if it has no wanted label, or if it cannot beat the window's last row that is kept.
        """
        label, (q, rows, low, high) = query[0], self._typed(query[1:])
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        most, least = high @ up + low @ down, low @ up + high @ down
        inside = (self.first <= label) & (label <= self.last)
        pure = (self.first == label) & (self.last == label)
        scored: dict[int, np.ndarray] = {}

        def scores_of(leaf: int) -> np.ndarray:
            if leaf not in scored:
                scored[leaf] = rows[slice(*self.span[leaf])] @ q
            return scored[leaf]

        return [self._window(label, most, least, inside if same else ~pure, same, scores_of, *rest) for same, *rest in windows]

    def _window(self, label, most, least, wanted, same, scores_of, low, high, keep, floor, floor_id):
        worst = (floor, floor_id)
        best: list[tuple[int, int]] = []
        heap: list[tuple[int, int, int]] = []

        def offer(node: int) -> None:
            top = min(int(most[node]), high)
            if wanted[node] and top >= low and least[node] <= high and (top, -self.smallest[node]) > worst:
                heapq.heappush(heap, (-top, self.smallest[node], node))

        offer(self.root)
        while heap:
            negative, smallest, node = heapq.heappop(heap)
            if (-negative, -smallest) <= worst:
                break
            if node in self.children:
                for child in self.children[node]:
                    offer(child)
                continue
            a, b = self.span[node]
            scores, labels = scores_of(node), self.label[a:b]
            fits = (scores >= max(low, worst[0])) & (scores <= high) & ((labels == label) == same)
            for i in np.flatnonzero(fits).tolist():
                score = int(scores[i])
                for vec in self.ids[a + i]:
                    if (score, -vec) <= worst:
                        break
                    if len(best) < keep:
                        heapq.heappush(best, (score, -vec))
                    else:
                        heapq.heapreplace(best, (score, -vec))
                    if len(best) == keep:
                        worst = max(worst, best[0])
        return best


class Tiles:
    """Nested cuts fitted on a sample: labels first, then the two widest components inside each run of labels."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.cuts: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.labels = np.zeros(0, np.int64)
        self.wide, self.base = [0, 0], [0]
        if not len(sample):
            return
        # A run of labels ends where a label changes; a label with many rows is a run of its own with more tiles.
        wanted = np.sort(sample[:, 0])[np.linspace(0, len(sample) - 1, tiles + 1).astype(int)[1:-1]]
        self.labels = np.unique(np.concatenate([wanted, wanted - 1]))
        self.wide = (np.argsort(-np.ptp(sample[:, 1:], axis=0), kind="stable")[:2] + 1).tolist()
        self.wide = self.wide if len(self.wide) == 2 else self.wide * 2
        run = np.searchsorted(self.labels, sample[:, 0])
        for r in range(len(self.labels) + 1):
            own = sample[run == r]
            n = max(1, round(tiles * len(own) / len(sample)))
            slabs = max(1, round(n ** 0.5))
            first = self._bounds(own[:, self.wide[0]], slabs)
            slab = np.searchsorted(first, own[:, self.wide[0]])
            self.cuts.append((first, [self._bounds(own[slab == s][:, self.wide[1]], -(-n // slabs)) for s in range(len(first) + 1)]))
        sizes = [sum(len(c) + 1 for c in second) for _, second in self.cuts]
        self.base = np.cumsum([0, *sizes])[:-1].tolist()

    @staticmethod
    def _bounds(values: np.ndarray, parts: int) -> np.ndarray:
        if parts < 2 or not len(values):
            return np.zeros(0, np.int64)
        return np.unique(np.sort(values)[np.linspace(0, len(values) - 1, parts + 1).astype(int)[1:-1]])

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        run = np.searchsorted(self.labels, rows[:, 0]) if len(rows) else out
        for r in np.unique(run) if self.cuts else ():
            first, second = self.cuts[r]
            at = np.flatnonzero(run == r)
            slab = np.searchsorted(first, rows[at, self.wide[0]])
            begin = self.base[r] + np.cumsum([0, *(len(c) + 1 for c in second)])
            for s in np.unique(slab):
                own = at[slab == s]
                out[own] = begin[s] + np.searchsorted(second[s], rows[own, self.wide[1]])
        return out


def _hits(best: list[tuple[int, int]]) -> list[dict]:
    return [{"negative": -s, "vec_id": -n, "score": s} for s, n in best]


class Index:
    """Classes of equal (label, vector) in shards of about ``shard_rows``, and the box of every tile of shards."""

    def __init__(self, known: DataFrame, shard_rows: int, leaf_rows: int):
        self.spark, self.leaf_rows = known.sparkSession, leaf_rows
        n = known.count()
        share = min(1.0, SAMPLE_ROWS / max(1, n))
        pick = known.select("code").filter(F.pmod(F.xxhash64("code"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
        tiles = Tiles(decode(pick.limit(2 * SAMPLE_ROWS).toArrow().column("code"), "<i8"), min(MAX_TILES, -(-n // shard_rows)))

        def deal(batches):
            for batch in batches:
                tile = tiles.of(decode(batch.column("code"), "<i8"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile, pa.int32())], [*batch.schema.names, "tile"])

        self.dealt = stored(known.mapInArrow(deal, "code binary, ids array<long>, query boolean, tile int"), "tiles")

        def box(batches):
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                x, tile = decode(batch.column("code"), "<i8"), batch.column("tile").to_numpy()
                for t in np.unique(tile).tolist() if len(x) else ():
                    own = x[tile == t]
                    sides = held.setdefault(t, [own.min(0), own.max(0)])
                    sides[:] = [np.minimum(sides[0], own.min(0)), np.maximum(sides[1], own.max(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([s[0].tolist() for s in held.values()], pa.list_(pa.int64())),
                 pa.array([s[1].tolist() for s in held.values()], pa.list_(pa.int64()))], ["tile", "low", "high"])

        # At most MAX_TILES (and as many uneven cuts) boxes, each made of the tasks' own ones, come to the driver.
        each = self.dealt.select("code", "tile").mapInArrow(box, "tile int, low array<long>, high array<long>")
        place = each.select("tile", F.posexplode(F.arrays_zip("low", "high")).alias("i", "side"))
        boxes = place.groupBy("tile", "i").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high")).groupBy(
            "tile").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("sides"))
        sizes = self.dealt.groupBy("tile").agg(F.count("*").alias("n"), F.min(F.element_at("ids", 1)).alias("least"))
        table = sorted((r.tile, r.n, r.least, [(s.low, s.high) for s in r.sides])
                       for r in sizes.join(boxes, "tile").toLocalIterator())
        parts = [max(1, -(-n // shard_rows)) for _, n, _, _ in table]
        self.first, self.parts = np.cumsum([0, *parts])[:-1], np.array(parts, np.int64)
        self.least = np.array([m for _, _, m, _ in table], np.int64)
        self.box = np.array([b for *_, b in table], np.int64).transpose(2, 0, 1) if table else None
        names = self.spark.createDataFrame(
            [(t, int(f), int(p)) for (t, *_), f, p in zip(table, self.first, self.parts)], "tile int, begin int, parts int")
        shard = (F.col("begin") + F.pmod(F.xxhash64("code"), F.col("parts"))).cast("int")
        self.rows = stored(self.dealt.join(F.broadcast(names), "tile").select("code", "ids", "query", shard.alias("shard")), "shards")

    def visits(self, windows: DataFrame, home: bool) -> DataFrame:
        """The windows with each shard that may hold a row of theirs: their home shard's tile, or all the other tiles.

        A window's home is the tile whose box allows the highest score inside the window.
        """
        box, first, parts, least = self.box, self.first, self.parts, self.least

        def part(batch: pa.RecordBatch) -> list[tuple[int, int]]:
            x = decode(batch.column("code"), "<i8")
            exact = float(np.abs(box).max()) * float(np.abs(x).max()) * x.shape[1] < 2.0 ** 52
            q, low, high = (v.astype(float if exact else np.int64)[:, 1:] for v in (x, box[0], box[1]))
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            most, lowest = up @ high.T + down @ low.T, up @ low.T + down @ high.T
            from_, to, floor, floor_id = (
                batch.column(c).to_numpy()[:, None] for c in ("low", "high", "floor", "floor_id"))
            label, same = x[:, :1], batch.column("same").to_numpy(zero_copy_only=False)[:, None]
            inside = (box[0][:, 0] <= label) & (label <= box[1][:, 0])
            pure = (box[0][:, 0] == label) & (box[1][:, 0] == label)
            top = np.minimum(most, to)
            hit = (np.where(same, inside, ~pure) & (top >= from_) & (lowest <= to)
                   & ((top > floor) | ((top == floor) & (-least > floor_id))))
            if home:
                return [(i, int(first[t])) for i, t in enumerate(np.where(hit, top, -np.inf).argmax(1)) if hit[i].any()]
            known = batch.column("home").to_pylist()
            return [(i, s) for i, t in zip(*np.nonzero(hit)) for s in range(first[t], first[t] + parts[t]) if s != known[i]]

        def run(batches):
            for whole in batches:
                step = max(1, (1 << 20) // len(least)) if len(least) else whole.num_rows  # bounds windows x tiles
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, max(1, step)) if len(least)):
                    out = part(batch)
                    take = batch.take(pa.array([i for i, _ in out], pa.int64()))
                    names = [n for n in batch.schema.names if n != "home"]
                    yield pa.RecordBatch.from_arrays(
                        [*map(take.column, names), pa.array([s for _, s in out], pa.int32())], [*names, "shard"])

        return windows.select("wid", "code", "same", "low", "high", "keep", "floor", "floor_id", "home").mapInArrow(
            run, f"{WINDOW}, shard int")

    def answers(self, visits: DataFrame, blocks: int) -> DataFrame:
        """(wid, shard, found) of every visit: its best rows in that shard."""
        leaf_rows = self.leaf_rows

        def visit(host: pa.Table, guests: pa.Table) -> pa.Table:
            wids, found = [], []
            if host.num_rows and guests.num_rows:
                tree = Tree(decode(host.column("code"), "<i8"), host.column("ids").to_pylist(), leaf_rows)
                together: dict[bytes, list[tuple]] = {}  # windows of one query share the scores of its leaves
                for code, *window in zip(*(guests.column(c).to_pylist() for c in (
                        "code", "wid", "same", "low", "high", "keep", "floor", "floor_id"))):
                    together.setdefault(code, []).append(tuple(window))
                for code, windows in together.items():
                    got = tree.search(np.frombuffer(code, "<i8"), [w[1:] for w in windows])
                    wids += [w[0] for w in windows]
                    found += map(_hits, got)
            shard = guests.column("shard")[:1].to_pylist() * len(wids)
            return pa.table({"wid": pa.array(wids, pa.int64()), "shard": pa.array(shard, pa.int32()),
                             "found": pa.array(found, _FOUND_ARROW)})

        hosts = self.rows.select("shard", "code", "ids").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        guests = visits.withColumn("block", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int"))
        return hosts.groupBy("shard", "block").cogroup(guests.groupBy("shard", "block")).applyInArrow(
            visit, f"wid long, shard int, found {FOUND}")

    def search(self, windows: DataFrame) -> DataFrame:
        """(wid, found): the ``keep`` best rows of each window (wid, code, same, low, high, keep).

        Every window is searched in the shard that promises most first; its last row kept there goes along to the others.
        """
        windows = stored(windows.select("*", F.lit(-NEVER).alias("floor"), F.lit(0).cast("long").alias("floor_id"),
                                        F.lit(None).cast("int").alias("home")), "windows")
        blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
        near = stored(self.answers(self.visits(windows, True), blocks), "home")
        last = F.get(F.array_sort("found"), F.col("keep") - 1)
        full = F.size("found") >= F.col("keep")
        onward = windows.drop("floor", "floor_id", "home").join(near, "wid").select(
            "wid", "code", "same", "low", "high", "keep",
            F.when(full, last["score"]).otherwise(F.lit(-NEVER)).alias("floor"),
            F.when(full, -last["vec_id"]).otherwise(F.lit(0)).alias("floor_id"), F.col("shard").alias("home"))
        far = self.answers(self.visits(onward, False), blocks)
        merged = near.unionByName(far).groupBy("wid").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        return merged.join(windows.select("wid", "keep"), "wid").select("wid", F.slice("found", 1, F.col("keep")).alias("found"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by ``every``; scores are integer inner products of floor(256 x); higher
    ones come first, ties by smaller id. Each anchor has its first ``positives`` other rows of its label, and for each of
    them the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of the
    positive's, both included. A pair without any such row gives no rows.

    Rows of equal label and vector are one class with its smallest ids, which are all that can be returned; anchors of a
    class share its searches, and a window is searched once for each different score of a class's positives. Rows
    without id, label or vector, or with a null or non-finite component, take no part. Rows that repeat id, label and
    vector count once; rows that share an id but not the vector or label are rows and anchors of their own. Vectors of
    different lengths are an error, and scores must fit 64 bits. Extra columns are ignored; an empty table gives an
    empty result.
    """
    label = F.col("label").cast("double")
    own = vectors.filter(F.col("label").isNotNull()).select(
        "vec_id", F.concat(F.array(label), F.col("embedding").cast("array<double>")).alias("embedding"))
    own = valid_rows(own.filter(F.size("embedding") > 1))
    keep = max(positives + 1, negatives)
    known = stored(classes(own, scaled, keep, every), "classes")
    index = Index(known, shard_rows, leaf_rows)

    anchors = known.filter("query").select("code").withColumn("wid", F.xxhash64("code"))
    like = F.lit(-NEVER), F.lit(NEVER)
    best = stored(index.search(anchors.select(
        "wid", "code", F.lit(True).alias("same"), like[0].alias("low"), like[1].alias("high"),
        F.lit(positives + 1).alias("keep"))), "positives")
    # One window for each different score of a class's positives: low * p <= 100 * n <= high * p.
    scores = best.select("wid", F.explode(F.array_distinct(F.transform("found", lambda h: h["score"]))).alias("p"))
    bounds = scores.join(anchors, "wid").select(
        F.col("wid").alias("anchor"), "p", F.xxhash64("wid", "p").alias("wid"), "code", F.lit(False).alias("same"),
        F.ceil(F.lit(low) * F.col("p") / F.lit(100).cast("decimal(20,0)")).cast("long").alias("low"),
        F.floor(F.lit(high) * F.col("p") / F.lit(100).cast("decimal(20,0)")).cast("long").alias("high"),
        F.lit(negatives).alias("keep")).filter("low <= high")
    bounds = stored(bounds, "bounds")
    hard = index.search(bounds.drop("anchor", "p"))

    def coded(batches):
        for batch in batches:
            rows = batch.column("vector")
            flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else ()
            codes = [r.tobytes() for r in scaled(flat)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary())], ["anchor_id", "code"])

    ids = own.filter(F.col("id") % every == 0).mapInArrow(coded, "anchor_id long, code binary").distinct()
    pairs = ids.select("anchor_id", F.xxhash64("code").alias("wid")).join(best, "wid").select(
        "anchor_id", "wid", F.filter("found", lambda h: h["vec_id"] != F.col("anchor_id")).alias("found")).select(
        "anchor_id", "wid", F.explode(F.slice("found", 1, positives)).alias("positive"))
    joined = pairs.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("positive.score").alias(
        "positive_score"), F.xxhash64("wid", F.col("positive.score")).alias("wid")).join(hard, "wid")
    return joined.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("place", "hit")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("negative_id"),
        "positive_score", F.col("hit.score").alias("negative_score"))
