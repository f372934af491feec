"""Language-model scores: a hierarchical Pitman-Yor model with Chinese-restaurant seating sampled by Gibbs.

Every word has a restaurant for each hashed context (the word before it), all of which share the unigram restaurant as
their parent, whose base is uniform. Counts of all training text are gathered by word, so that a shard holds the rows of
a word under all contexts together with the word's place in the parent. A shard reseats the customers of all its rows
again and again, given the tables per context and in the parent that other shards had in the round before. Predictive
probabilities are averaged over the last seatings and added up per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import SLABS, fold, in_slabs, pack_arrays, raw, stored, summed, tidy, unpack_arrays

CONTEXTS = 1 << 16
#: Tokens that a task gathers before it sends them, bytes of text hashed at once, bytes of text per shard.
CHUNK_TOKENS = 1_000_000
CHUNK_BYTES = 1 << 19
SHARD_BYTES = 16 << 20

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | _U(1)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_SPACE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])
END, START = _U(0x1234567890ABCDEF), _U(0x0FEDCBA987654321)  # hashes that stand for the end and the start
_POWERS: list[np.ndarray] = []


@dataclass(frozen=True)
class Settings:
    rounds: int = 2
    sweeps: int = 2
    samples: int = 3
    strength: float = 5.0
    parent_strength: float = 5.0
    seed: int = 3


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_PRIME, -1, 1 << 64)
        size = max(n, CHUNK_BYTES + (1 << 16))
        _POWERS[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, p, np.uint64), dtype=np.uint64)])
                      for p in (_PRIME, inverse)]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens, their contexts and the number of their text; every text ends with the end token."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    prefix = np.concatenate([[_U(0)], np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    code = _mix((prefix[last] - prefix[first]) * down[first] + (last - first).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(begins, first, "right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    out = np.full(len(code) + len(texts), END)
    text = np.repeat(np.arange(len(texts)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = code
    before = np.concatenate([[START], out[:-1]])
    before[ends[:-1] + 1] = START
    return out, (_mix(before) >> _U(48)).astype(np.uint16), text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(hashes, contexts, document number, ids, training flags) of some documents at a time."""
    held, size, count = [], 0, 0

    def ready():
        out = tuple(np.concatenate([h[i] for h in held]) for i in range(6))
        held.clear()
        return out

    for batch in batches:
        texts = [t or b"" for t in raw(batch, "text")]
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids, train = ids.fill_null(0).to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
        begin = 0
        while begin < len(texts):
            end, length = begin, 0
            while end < len(texts) and (length == 0 or length + len(texts[end]) < CHUNK_BYTES):
                length += len(texts[end]) + 1
                end += 1
            code, context, owner = tokens(texts[begin:end])
            held.append((code, context, (owner + count).astype(np.uint32), ids[begin:end], known[begin:end],
                         train[begin:end]))
            count += end - begin
            size += len(code)
            begin = end
            if size >= CHUNK_TOKENS:
                yield ready()
                size, count = 0, 0
    if held:
        yield ready()


def _pair(code: np.ndarray, context: np.ndarray) -> np.ndarray:
    return _mix(code ^ (context.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(1)))


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def _hot(docs: DataFrame, shards: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of (word, context) pairs that fill more than a shard, judged by a sample of documents.

    They only decide how rows are dealt. There are at most as many of each as shards.
    """
    def run(batches):
        for code, context, *_ in _chunks(batches):
            rows = [[], [], []]
            for kind, values in enumerate((code, _pair(code, context))):
                found, counts = np.unique(values, return_counts=True)
                many = counts * 4 * shards > len(code)
                rows[0] += [kind] * int(many.sum())
                rows[1] += found[many].view(np.int64).tolist()
                rows[2] += counts[many].tolist()
            rows[0].append(2)
            rows[1].append(0)
            rows[2].append(len(code))
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["kind", "code", "n"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(part)) == 0)
    counts = stored(chosen.mapInArrow(tidy(run), "kind long, code long, n long").groupBy("kind", "code").agg(
        F.sum("n").alias("n")), "frequent")
    total = counts.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("kind") < 2) & (F.col("n") * shards > total)).collect()
    return tuple(np.sort(np.array([r["code"] for r in rows if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))


def _send(shards: int, words: np.ndarray, pairs: np.ndarray):
    """Rows for each shard: sorted distinct (word, context, document) with their numbers; kind 1: the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (code, context, owner, ids, known, train) in enumerate(_chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 24) + number
            second = context.astype(np.uint64) << _U(32) | owner
            order = np.lexsort((second, code))
            code, second = code[order], second[order]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (second[1:] != second[:-1])]))
            times = np.diff(np.append(first, len(code))).astype("<u4")
            n_tokens = np.bincount(owner, minlength=len(ids))
            code, second = code[first], second[first]
            context, owner = (second >> _U(32)).astype(np.uint16), (second & _U(0xFFFFFFFF)).astype("<u4")
            shard = ((code >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
            frequent = _member(code, words)[0]
            if frequent.any():
                spread = _pair(code[frequent], context[frequent])
                hot = _member(spread, pairs)[0]
                spread[hot] = _mix(spread[hot] ^ (_U(chunk) * _U(_PRIME)))
                shard[frequent] = (spread % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            blobs, own = [], np.flatnonzero(np.diff(bounds))
            for s in own:
                rows = order[bounds[s]:bounds[s + 1]]
                w = code[rows]
                new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                runs = np.diff(np.append(new, len(w))).astype("<u4")
                blobs.append(pack_arrays(w[new], runs, context[rows], owner[rows], times[rows], train.astype("u1")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(own) + [1], pa.int32()), pa.array([*own.tolist(), chunk], pa.int64()),
                 pa.array([chunk] * (len(own) + 1), pa.int64()),
                 pa.array([*blobs, pack_arrays(ids.astype("<i8"), known.astype("u1"), n_tokens.astype("<i8"),
                                               train.astype("u1"))], pa.binary())], ["kind", "key", "chunk", "blob"])

    return run


def _gather(words: np.ndarray, pairs: np.ndarray):
    """Of a shard: its rows (word, context, training count), who occurs where, and its counts."""
    def run(table: pa.Table) -> pa.Table:
        names = ["kind", "key", "chunk", "rows", "places", "counts"]
        none = pa.nulls(table.num_rows, pa.binary())
        if table.column("kind")[0].as_py() == 1:
            return pa.table([table.column("kind"), table.column("key"), table.column("chunk"), table.column("blob"),
                             none, none], names)
        chunks = table.column("chunk").to_numpy()
        blobs, types = table.column("blob"), ("<u8", "<u4", "<u2", "<u4", "<u4", "u1")
        order = [int(i) for i in np.argsort(chunks)]
        sizes = [len(unpack_arrays(blobs[i].as_buffer(), *types)[2]) for i in order]
        n, at = sum(sizes), 0
        # Filled part by part: a shard's postings are held once.
        w, context = np.empty(n, np.uint64), np.empty(n, np.uint16)
        chunk, owner, times, taught = (np.empty(n, np.uint32) for _ in range(4))
        for i, size in zip(order, sizes):
            word, runs, here, who, many, train = unpack_arrays(blobs[i].as_buffer(), *types)
            own = slice(at, at + size)
            w[own], context[own], chunk[own], owner[own], times[own] = np.repeat(word, runs), here, i, who, many
            taught[own] = many * (train[who] > 0)
            at += size
        # A column at a time: of every posting only one column is held twice.
        order = np.lexsort((context, w))
        w = w[order]
        context = context[order]
        begins = np.append(True, (w[1:] != w[:-1]) | (context[1:] != context[:-1]))
        first = np.flatnonzero(begins)
        count = np.add.reduceat(taught[order], first, dtype=np.int64)
        del taught
        w, context = w[first], context[first]
        del first
        row = np.cumsum(begins, dtype=np.uint32)
        row -= np.uint32(1)
        chunk = chunk[order]
        deal = np.argsort(chunk, kind="stable")
        chunk = chunk[deal]
        row = row[deal]
        order = order[deal]
        del deal, begins
        owner = owner[order]
        times = times[order]
        del order
        places = pack_arrays(chunks.astype("<i8"), chunk, owner, times, row)
        del chunk, owner, times, row
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        runs = np.diff(np.append(new, len(w))).astype("<u4")
        per_word = np.add.reduceat(count, new)
        hot_word, at_word = _member(w[new], words)
        hot_pair, at_pair = _member(_pair(w, context), pairs)
        by_context = np.bincount(context, count, CONTEXTS).astype(np.int64)
        own = np.array([count.sum(), ((per_word > 0) & ~hot_word).sum(), (count == 1).sum(), (count == 2).sum(),
                        (count > 0).sum()], np.int64)
        of_words, of_pairs = np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        np.add.at(of_words, at_word[hot_word], per_word[hot_word])
        np.add.at(of_pairs, at_pair[hot_pair], count[hot_pair])
        counts = np.concatenate([by_context, own, of_words, of_pairs])
        key = table.column("key")[:1]
        return pa.table([pa.array([0], pa.int32()), key, key,
                         pa.array([pack_arrays(w[new], runs, context, count.astype("<i8"))], pa.binary()),
                         pa.array([places], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    return run


def tables(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables after seating each dish's customers one by one.

    With n seated at t tables, the next opens a table with odds ``new`` to n - discount * t. From the 64th on, customers
    come in groups of two percent of those seated, within which the odds are taken as constant.
    """
    t = (customers > 0).astype(float)
    rows = np.flatnonzero(customers > 1)
    rows = rows[np.argsort(-customers[rows], kind="stable")]
    size, odds, own = customers[rows], new[rows], t[rows]
    seated = 1
    while len(rows) and seated < size[0]:
        live = int(np.searchsorted(-size, -seated, "left"))  # rows with more customers than are seated
        group = 1 if seated < 64 else max(1, seated // 50)
        chance = odds[:live] / (odds[:live] + np.maximum(seated + (group - 1) / 2 - discount * own[:live], 1e-9))
        if group == 1:
            own[:live] += rng.random(live) < chance
        else:
            own[:live] += rng.binomial(np.minimum(group, size[:live] - seated), chance)
        seated += group
    t[rows] = own
    return t


@dataclass
class Shared:
    """What all shards need: counts and tables per context, totals of the parent, and the rows that span shards."""

    by_context: np.ndarray
    tables: np.ndarray
    tokens: int
    words: int
    customers: float
    parent_tables: float
    discount: float
    parent_discount: float
    hot_words: np.ndarray
    hot_word_count: np.ndarray
    hot_word_customers: np.ndarray
    hot_word_tables: np.ndarray
    hot_pairs: np.ndarray
    hot_pair_count: np.ndarray
    hot_pair_tables: np.ndarray


class Seating:
    """One shard's rows and the seating of their customers."""

    def __init__(self, blob: bytes, shared: Shared, settings: Settings, shard: int, turn: int):
        self.g, self.s = shared, settings
        self.rng = np.random.default_rng([settings.seed, turn, shard])
        self.word, runs, self.context, self.count = unpack_arrays(blob, "<u8", "<u4", "<u2", "<i8")
        self.of = np.repeat(np.arange(len(self.word)), runs)
        self.hot_word, self.at_word = _member(self.word, shared.hot_words)
        self.hot_pair, at = _member(_pair(self.word[self.of], self.context), shared.hot_pairs)
        self.total = np.bincount(self.of, self.count, len(self.word))
        self.total[self.hot_word] = shared.hot_word_count[self.at_word[self.hot_word]]
        self.whole = self.count.copy()
        self.whole[self.hot_pair] = shared.hot_pair_count[at[self.hot_pair]]
        self.fixed = shared.hot_pair_tables[at[self.hot_pair]]
        self.back = (settings.strength + shared.discount * shared.tables)[self.context]
        self.t = (self.count > 0).astype(float)
        self.t[self.hot_pair] = self.fixed
        self._parent()

    def _parent(self) -> None:
        g, theta = self.g, self.s.parent_strength
        self.served = np.bincount(self.of, self.t, len(self.word))
        served = self.served.copy()
        served[self.hot_word] = g.hot_word_customers[self.at_word[self.hot_word]]
        uniform = (theta + g.parent_discount * g.parent_tables) / (g.words + 1)
        self.parent = tables(served.astype(np.int64), np.full(len(served), uniform), g.parent_discount, self.rng)
        self.parent[self.hot_word] = g.hot_word_tables[self.at_word[self.hot_word]]
        self.p = (np.maximum(served - g.parent_discount * self.parent, 0) + uniform) / (theta + g.customers)

    def sweep(self) -> None:
        own = ~self.hot_pair
        self.t[own] = tables(self.count[own], (self.back * self.p[self.of])[own], self.g.discount, self.rng)
        self._parent()

    def sums(self) -> np.ndarray:
        """Tables per context, customers and tables of the parent and customers of hot words, without hot pairs."""
        own = ~self.hot_pair
        by_context = np.bincount(self.context[own], self.t[own], CONTEXTS)
        served = np.bincount(self.of[own], self.t[own], len(self.word))
        hot = np.zeros(len(self.g.hot_words))
        np.add.at(hot, self.at_word[self.hot_word], served[self.hot_word])
        rest = [served[~self.hot_word].sum(), self.parent[~self.hot_word].sum()]
        return np.concatenate([by_context, rest, hot]).astype(np.int64)

    def predictive(self) -> np.ndarray:
        seen = np.maximum(self.whole - self.g.discount * self.t, 0)
        return (seen + self.back * self.p[self.of]) / (self.s.strength + self.g.by_context[self.context])


def _start(total: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> Shared:
    by_context, rest = total[:CONTEXTS], total[CONTEXTS:]
    n, v, once, twice, rows = rest[:5].tolist()
    of_words, of_pairs = rest[5:5 + len(words)], rest[5 + len(words):]
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    return Shared(
        by_context, np.minimum(by_context, by_context * rows / max(1, n)), n, v + int((of_words > 0).sum()), float(rows),
        float(v + len(words)), discount, discount, words, of_words, np.maximum(1.0, of_words * rows / max(1, n)),
        np.ones(len(words)), pairs, of_pairs, np.ones(len(pairs)))


def _next(shared: Shared, total: np.ndarray, owners: np.ndarray, contexts: np.ndarray, s: Settings, turn: int) -> Shared:
    """The shared state after a round; rows that span shards are seated here, at most one for each shard."""
    rng = np.random.default_rng([s.seed, turn])
    by_context, (customers, parent_tables), hot = total[:CONTEXTS].astype(float), total[CONTEXTS:CONTEXTS + 2], total[CONTEXTS + 2:].astype(float)
    theta, g = s.parent_strength, shared
    uniform = (theta + g.parent_discount * g.parent_tables) / (g.words + 1)
    p = (np.maximum(g.hot_word_customers - g.parent_discount * g.hot_word_tables, 0) + uniform) / (theta + g.customers)
    if len(g.hot_pairs):
        back = s.strength + g.discount * g.tables[contexts]
        pair_tables = tables(g.hot_pair_count, back * p[owners], g.discount, rng)
        np.add.at(by_context, contexts, pair_tables)
        np.add.at(hot, owners, pair_tables)
    else:
        pair_tables = g.hot_pair_tables
    word_tables = tables(hot.astype(np.int64), np.full(len(hot), uniform), g.parent_discount, rng)
    return Shared(g.by_context, by_context, g.tokens, g.words, float(customers + hot.sum()),
                  float(parent_tables + word_tables.sum()), g.discount, g.parent_discount, g.hot_words,
                  g.hot_word_count, hot, word_tables, g.hot_pairs, g.hot_pair_count, pair_tables)


def _averaged(blob: bytes | pa.Buffer, g: Shared, s: Settings, key: int) -> tuple[np.ndarray, ...]:
    """Of a shard: the word of each row, whether words are known, log10 of their base and of the rows' mean predictive."""
    seating = Seating(blob, g, s, key, s.rounds)
    mean = 0.0
    for i in range(s.sweeps + s.samples):
        seating.sweep()
        if i >= s.sweeps:
            mean = mean + seating.predictive() / s.samples
    return seating.of, seating.total > 0, np.log10((seating.total + 1) / (g.tokens + g.words + 1)), np.log10(mean)


def _document_sums(key: int, blob: bytes | pa.Buffer, places: bytes | pa.Buffer, g: Shared, s: Settings) -> pa.RecordBatch:
    """Of a shard: what each document's tokens in it add up to, a row for each chunk. The seating is gone by then."""
    of, known, base, logs = _averaged(blob, g, s, key)
    chunks, chunk, owner, times, row = unpack_arrays(places, "<i8", "<u4", "<u4", "<u4", "<u4")
    bounds = np.searchsorted(chunk, np.arange(len(chunks) + 1))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        o, n, r = owner[a:b], times[a:b], row[a:b]
        w = of[r]
        out.append(pack_arrays(np.bincount(o, n * known[w]).astype("<i8"), np.bincount(o, n * base[w]),
                               np.bincount(o, n * logs[r])))
    return pa.RecordBatch.from_arrays(
        [pa.array([0] * len(out), pa.int32()), pa.array([key] * len(out), pa.int64()),
         pa.array(chunks), pa.array(out, pa.binary())], ["kind", "key", "chunk", "blob"])


def _table_sums(key: int, blob: bytes | pa.Buffer, g: Shared, s: Settings, turn: int) -> pa.RecordBatch:
    """Of a shard: its sums after a round."""
    seating = Seating(blob, g, s, key, turn)
    for _ in range(s.sweeps):
        seating.sweep()
    return in_slabs(seating.sums())


def scores(docs: DataFrame, settings: Settings = Settings(), folds: int = 7, held_fold: int = 2,
           shard_bytes: int = SHARD_BYTES, sample_part: int = 64) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Words are known by 64-bit hashes, contexts by 16 bits of another. A word or pair that would fill a shard is
    dealt over all shards; its counts are added up exactly. What the driver collects and sends is one number per
    context and a few per shard. Null texts are empty and hold the end token alone; a null id counts as the empty text
    when folds are drawn; repeated rows count each time; extra columns are ignored; an empty table gives an empty result.
    """
    s, spark = settings, docs.sparkSession
    held = fold(F.col("doc_id"), folds) == held_fold
    rows = docs.select(F.col("doc_id").cast("long"), "text", (~held).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(4, -(-size // shard_bytes)))
    words, pairs = _hot(rows, shards, sample_part)
    sent = rows.mapInArrow(tidy(_send(shards, words, pairs)), "kind int, key long, chunk long, blob binary")
    state = stored(sent.groupBy("kind", "key").applyInArrow(
        tidy(_gather(words, pairs)), "kind int, key long, chunk long, rows binary, places binary, counts binary"), "counts")
    own = state.filter("kind = 0")

    def counts(batches):
        for batch in batches:
            for blob in batch.column("counts"):
                yield in_slabs(np.frombuffer(blob.as_buffer(), np.int64))

    total = summed(own.select("counts").mapInArrow(tidy(counts), SLABS))
    if not len(total):
        total = np.zeros(CONTEXTS + 5 + len(words) + len(pairs), np.int64)
    shared = _start(total, words, pairs)
    # Which word and context a hot pair is of: words and contexts are few enough to try them all.
    owners, contexts = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for i, w in enumerate(words):
        hit, at = _member(_pair(np.full(CONTEXTS, w), np.arange(CONTEXTS)), pairs)
        owners[at[hit]], contexts[at[hit]] = i, np.flatnonzero(hit)

    for turn in range(s.rounds):
        now = spark.sparkContext.broadcast(shared)

        def seat(batches, now=now, turn=turn):
            for batch in batches:
                for key, blob in zip(batch.column("key").to_pylist(), batch.column("rows")):
                    yield _table_sums(key, blob.as_buffer(), now.value, s, turn)

        total = summed(own.select("key", "rows").mapInArrow(tidy(seat), SLABS))
        if len(total):
            shared = _next(shared, total, owners, contexts, s, turn)
    final = spark.sparkContext.broadcast(shared)

    def score(batches):
        for batch in batches:
            for key, blob, places in zip(batch.column("key").to_pylist(), batch.column("rows"), batch.column("places")):
                yield _document_sums(key, blob.as_buffer(), places.as_buffer(), final.value, s)

    schema = "kind int, key long, chunk long, blob binary"
    sums = own.select("key", "rows", "places").mapInArrow(tidy(score), schema)
    documents = state.filter("kind = 1").select("kind", "key", "chunk", F.col("rows").alias("blob"))

    def finish(table: pa.Table) -> pa.Table:
        g = final.value
        kind, key = table.column("kind").to_numpy(), table.column("key").to_numpy()
        blobs = table.column("blob")
        ids, valid, n_tokens, train = unpack_arrays(blobs[int(np.argmax(kind))].as_py(), "<i8", "u1", "<i8", "u1")
        known, base, total = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for i in np.argsort(key, kind="stable"):  # sums in one order, whatever order they came in
            if kind[i] == 0:
                parts = unpack_arrays(blobs[int(i)].as_py(), "<i8", "<f8", "<f8")
                for whole, part in zip((known, base, total), parts):
                    whole[: len(part)] += part
        return pa.table({
            "doc_id": pa.array(ids, mask=valid == 0), "held_out": pa.array(train == 0), "n_tokens": n_tokens,
            "n_known": known, "train_tokens": np.full(len(ids), g.tokens), "base_score": base, "score": total})

    return sums.unionByName(documents).groupBy("chunk").applyInArrow(
        tidy(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double")
