"""Repeated passages across documents: sorted suffix runs, exchanged front-coded and merged by loser trees.

Only suffixes at anchors take part. Of every window of ``length`` bytes the anchor is its smallest hashed ``GRAM``-byte
string, so equal windows choose the same anchor, wherever they stand. An anchor's suffix of ``length`` bytes, followed by
the ``length - GRAM`` bytes before it, holds every window that chose the anchor. The steps:

1. hashes of anchors, counted over all documents, tell which anchors occur in more than one document;
2. each block of documents sorts the suffixes at those anchors into runs, one for each shard, and front-codes them;
3. each shard merges its runs with a loser tree that keeps the length of the common prefix of every loser and the last
   winner and compares bytes behind it only; among suffixes that share an anchor it finds, for each window, the smallest
   id of a document that holds it;
4. each block turns the answers into removed spans, and the documents are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import pack_arrays, raw, stored, tidy, unpack_arrays

#: Bytes of an anchor. Shorter ones repeat by chance, longer ones leave more anchors.
GRAM = 20
#: Bytes of text in one block or one pass over a batch.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 18  # arrays of this many entries stay in the processor's cache
#: An anchor in more documents than this is exchanged window by window, so that no shard gets all of its suffixes.
HOT_DOCUMENTS = 20_000
#: Rows of a batch that are cut at once.
CUT_ROWS = 1000
NOBODY = np.iinfo(np.int64).max
PAD = 0xFF  # never part of UTF-8


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def _joined(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with ``length`` padding bytes around each, and where each starts and ends."""
    gap = bytes([PAD]) * length
    data = np.frombuffer(gap + b"".join(t + gap for t in texts) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + length)
    return data, ends - sizes, ends


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded data, where texts start in it, and of each anchor its place, its text's number and its 64-bit hash."""
    data, starts, ends = _joined(texts, length)
    n = len(data) - GRAM - 8
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the 8 bytes at every place
    code = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    code ^= (words[8:n + 8] + (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= (words[GRAM - 8:n + GRAM - 8] + (code >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    code ^= code >> np.uint64(31)
    code *= np.uint64(0x9FB21C651E98DF25)
    rank = (code >> np.uint64(32)).astype(np.uint32)
    width = length - GRAM + 1
    least = _sliding(rank, width, np.minimum)
    # Windows that lie inside one text; the others must not choose an anchor.
    windows = np.maximum(ends - starts - length + 1, 0)
    sides = np.stack([starts - np.append(0, (starts + windows)[:-1]), windows], 1).ravel()
    inside = np.zeros(len(least), np.uint32)
    marks = np.repeat(np.tile(np.array([0, 1], np.uint32), len(texts)), sides)[: len(least)]
    inside[: len(marks)] = marks
    least = np.concatenate([np.zeros(width - 1, np.uint32), least * inside, np.zeros(width - 1, np.uint32)])
    chosen = _sliding(least, width, np.maximum)  # the largest minimum of the windows around a place
    place = np.flatnonzero(chosen[:n] == rank)
    owner = np.searchsorted(starts, place, "right") - 1
    fits = (owner >= 0) & (place + GRAM <= ends[owner]) & (windows[owner] > 0)
    place, owner = place[fits], owner[fits]
    return data, starts, place, owner, code[place]


def _chunks(sizes: list[int]) -> Iterator[slice]:
    begin = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= CHUNK_BYTES:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _keys(codes: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the upper and 32 hash bits in the lower half; a shard's share of all anchors is bounded."""
    return ((codes >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (codes & np.uint64(0xFFFFFFFF))


def _count_anchors(docs: DataFrame, length: int, blocks: int) -> DataFrame:
    """(shard, blob): per task the distinct (anchor, block) pairs with their numbers of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, block = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            if blocks <= 1 << 16:  # shard, hash and block in one number
                both = np.sort(key << np.uint64(16) | block)
                key, block = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype("<u4")
            else:
                order = np.lexsort((block, key))
                key, block = key[order], block[order].astype("<u4")
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            counts = np.diff(np.append(first, len(key))).astype("<u4")
            key, block = key[first], block[first]
            shard = (key >> np.uint64(32)).astype(np.int64)
            bounds = np.searchsorted(shard, np.arange(blocks + 1))
            own = np.flatnonzero(np.diff(bounds))
            blobs = [pack_arrays(key[a:b].astype("<u4"), block[a:b], counts[a:b])
                     for a, b in zip(bounds[own], bounds[own + 1])]
            for i in range(0, len(own), 64):
                yield pa.RecordBatch.from_arrays([pa.array(own[i:i + 64], pa.int32()), pa.array(blobs[i:i + 64], pa.binary())],
                                                 ["shard", "blob"])

        for batch in batches:
            texts, block = [t or b"" for t in raw(batch, "text")], batch.column("block").to_numpy()
            for part in _chunks([len(t) for t in texts]):
                _, _, _, owner, code = anchors(texts[part], length)
                key = _keys(code, blocks)
                order = np.argsort(key, kind="stable")  # keeps the documents of a key in order
                key, owner = key[order], owner[order]
                # A document counts once for each of its anchors.
                once = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)]
                held.append((key[once], block[part][owner[once]].astype(np.uint64)))
                size += int(once.sum())
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.select("text", "block").mapInArrow(tidy(run), "shard int, blob binary")


def _shared_anchors(hot_documents: int):
    """Of a shard: for each block the anchors that occur in more than one document, and which of them are hot."""
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(b.as_py(), "<u4", "<u4", "<u4") for b in table.column("blob")]
        key, block, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((block, key))
        key, block, count = key[order], block[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        documents = np.add.reduceat(count.astype(np.int64), first)
        documents = np.repeat(documents, np.diff(np.append(first, len(key))))
        many = documents > 1
        key, block, documents = key[many], block[many], documents[many]
        order = np.lexsort((key, block))
        key, block, documents = key[order], block[order], documents[order]
        new = np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]))[: len(key)]
        key, block, documents = key[new], block[new], documents[new]
        found, bounds = np.unique(block, return_index=True)
        shard = np.uint64(table.column("shard")[0].as_py())
        blobs = [pack_arrays((shard << np.uint64(32)) | key[a:b].astype("<u8"), (documents[a:b] > hot_documents).astype("u1"))
                 for a, b in zip(bounds, np.append(bounds[1:], len(key)))]
        return pa.table({"block": pa.array(found, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _front_code(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted equal-long strings (rows) as common prefix lengths and the bytes behind them."""
    if len(strings) > 1:
        same = strings[1:] != strings[:-1]
        prefix = np.append(0, np.where(same.any(1), same.argmax(1), strings.shape[1]))
    else:
        prefix = np.zeros(len(strings), np.int64)
    return prefix.astype(np.uint8), strings[np.arange(strings.shape[1]) >= prefix[:, None]]


def front_decode(prefix: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for p in prefix.tolist():
        end = at + width - p
        last = last[:p] + rest[at:end]
        at = end
        out.append(last)
    return out


def _suffix_runs(length: int, blocks: int):
    """Of a block: rows (kind 0) with its sorted run for each shard, and (kind 1) where each suffix of a run occurs."""
    back = length - GRAM
    width = length + back
    flagged = width + 1  # the last byte tells hot windows from suffixes at the start of a text, which end in padding too

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"kind": [], "target": [], "block": [], "blob": []}
        if replies.num_rows:
            known = [unpack_arrays(b.as_py(), "<u8", "u1") for b in replies.column("blob")]
            shared, hot = (np.concatenate([k[i] for k in known]) for i in range(2))
            order = np.argsort(shared)
            shared, hot = shared[order], hot[order]
            texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
            ids, ranks = docs.column("row").to_numpy(), docs.column("rank").to_numpy()
            numbers: dict[bytes, int] = {}
            least: list[int] = []
            rows, places, suffixes = [], [], []
            for part in _chunks([len(t) for t in texts]):
                data, starts, place, owner, code = anchors(texts[part], length)
                key = _keys(code, blocks)
                at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
                own = shared[at] == key
                place, owner, at = place[own], owner[own], at[own]
                wide = hot[at] > 0
                cold = place[~wide]
                strings = [np.stack([*(data[cold + i] for i in [*range(length), *range(-back, 0)]),
                                     np.zeros(len(cold), np.uint8)], 1)]
                spots, owners = [cold], [owner[~wide]]
                for step in range(back + 1) if wide.any() else ():
                    here = place[wide] - step
                    window = np.full((len(here), flagged), PAD, np.uint8)
                    window[:, width] = 1
                    for i in range(length):
                        window[:, i] = data[here + i]
                    whole = (window[:, :length] != PAD).all(1)
                    strings.append(window[whole])
                    spots.append(here[whole])
                    owners.append(owner[wide][whole])
                flat, owner = np.concatenate(strings).tobytes(), np.concatenate(owners)
                rank = ranks[part][owner].tolist()
                for i, r in enumerate(rank):
                    s = flat[i * flagged:(i + 1) * flagged]
                    n = numbers.setdefault(s, len(least))
                    if n == len(least):
                        least.append(r)
                    elif r < least[n]:
                        least[n] = r
                    suffixes.append(n)
                rows.append(ids[part][owner])
                places.append(np.concatenate(spots) - starts[owner])
            if numbers:
                ordered = sorted(numbers)
                matrix = np.frombuffer(b"".join(ordered), np.uint8).reshape(-1, flagged)
                matrix, hot_window = matrix[:, :width], matrix[:, width] > 0
                old = np.fromiter(map(numbers.__getitem__, ordered), np.int64, len(ordered))
                smallest = np.array(least, np.int64)[old]
                # A hot window is named by all its bytes, any other suffix by its anchor.
                named = np.where(hot_window, length, GRAM)
                shard = _shards(matrix, named, blocks)
                new = np.empty(len(old), np.int64)
                by_shard = np.argsort(shard, kind="stable")
                new[old[by_shard]] = np.arange(len(old))
                block = docs.column("block")[0].as_py()
                bounds = np.searchsorted(shard[by_shard], np.arange(blocks + 1))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    own = by_shard[bounds[s]:bounds[s + 1]]
                    prefix, rest = _front_code(matrix[own])
                    out["kind"].append(0)
                    out["target"].append(s)
                    out["block"].append(block)
                    out["blob"].append(pack_arrays(prefix, rest, smallest[own]))
                rows = np.concatenate(rows)
                order = np.argsort(ids, kind="stable")
                rank = ranks[order][np.searchsorted(ids[order], rows)]
                out["kind"].append(1)
                out["target"].append(block)
                out["block"].append(block)
                out["blob"].append(pack_arrays(rows, rank, np.concatenate(places).astype("<i8"), new[np.array(suffixes)]))
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "target": pa.array(out["target"], pa.int32()),
                         "block": pa.array(out["block"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def _shards(matrix: np.ndarray, named: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each string by a hash of its first ``named`` bytes."""
    code = np.full(len(matrix), 1469598103934665603, np.uint64)
    for i in range(int(named.max())):
        step = (code ^ matrix[:, i]) * np.uint64(1099511628211)
        code = np.where(i < named, step, code)
    return ((code ^ (code >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs (strings, common prefix lengths with the string before): yields (prefix, run, index).

    ``prefix`` is the common prefix length with the string yielded before. Every waiting string keeps the length of its
    common prefix with the string that beat it. On the way from a leaf to the root all of these were beaten by the last
    winner, so of two strings the one that shares more with it is smaller; only if both share equally many bytes are
    they compared, and then only behind those.
    """
    n = 1
    while n < len(runs):
        n *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (n - len(runs))
    shares = [0 if h is not None else -1 for h in heads]
    index = [0] * n
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes that with the winner."""
        sa, sb = shares[a], shares[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        if sa < 0:
            return a, b
        x, y = heads[a], heads[b]
        differ = int.from_bytes(x[sa:], "big") ^ int.from_bytes(y[sa:], "big")
        share = len(x) - (differ.bit_length() + 7) // 8
        if share == len(x):
            winner, loser = (a, b) if a < b else (b, a)
        else:
            winner, loser = (a, b) if x[share] < y[share] else (b, a)
        shares[loser] = share
        return winner, loser

    level = list(range(n))
    winners = [0] * n + level
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if n > 1 else 0
    while heads[top] is not None:
        yield shares[top], top, index[top]
        strings, prefixes = runs[top]
        index[top] = at = index[top] + 1
        if at < len(strings):
            heads[top], shares[top] = strings[at], prefixes[at]
        else:
            heads[top], shares[top] = None, -1
        node = (top + n) >> 1
        while node:
            other = losers[node]
            if shares[top] <= shares[other]:
                top, losers[node] = play(top, other)
            node >>= 1


def _merge_shard(length: int):
    """Of a shard: for each block the smallest id per suffix and window, in the order of the block's run."""
    back = length - GRAM
    width = length + back

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        runs, least, answers = [], [], []
        for blob in table.column("blob"):
            prefix, rest, smallest = unpack_arrays(blob.as_py(), "u1", "u1", "<i8")
            runs.append((front_decode(prefix, rest.tobytes(), width), prefix.tolist()))
            least.append(smallest.tolist())
            answers.append(np.repeat(smallest[:, None], back + 1, 1))
        whole: list[tuple[list, list]] = [([], []) for _ in runs]  # of each run: suffix, id for all its windows
        spans: list[list[tuple[int, int, int, int]]] = [[] for _ in runs]  # suffix, first and last window, id

        def settle(group: list[tuple[bytes, int, list[tuple[int, int]]]], shares: list[int]) -> None:
            """group: distinct strings that share an anchor, their smallest id and where they are; ``shares``: the bytes
            from the anchor on that each has in common with the string before."""
            for _, smallest, members in group:
                if len(members) > 1:
                    for r, i in members:
                        whole[r][0].append(i)
                        whole[r][1].append(smallest)
            if len(group) < 2:
                return
            if len(group) == 2:
                # Windows that reach no further back than the common bytes before the anchor, nor further on than behind it.
                (a, first_id, _), (b, second_id, _) = group
                differ = int.from_bytes(a[length:], "big") ^ int.from_bytes(b[length:], "big")
                first, last = max(0, length - shares[1]), ((differ & -differ).bit_length() - 1) // 8 if differ else back
                if first <= last and first_id != second_id:
                    for r, i in group[first_id < second_id][2]:
                        spans[r].append((i, first, last, min(first_id, second_id)))
                return
            # A string meets others from the window on that is no longer than what it shares with a neighbour.
            begins = [length - max(x, y) for x, y in zip(shares, [*shares[1:], 0])]
            turned = [s[length:] + s[:length] for s, _, _ in group]
            running: dict[int, tuple[int, int]] = {}  # string: first window, id
            for o in range(max(0, min(begins)), back + 1):
                found: dict[bytes, int] = {}
                live = [(k, t[back - o:width - o]) for k, (t, at) in enumerate(zip(turned, begins)) if at <= o]
                for k, w in live:
                    if group[k][1] < found.get(w, NOBODY):
                        found[w] = group[k][1]
                for k, w in live:
                    value = found[w] if found[w] < group[k][1] else NOBODY
                    began, old = running.get(k, (o, NOBODY))
                    if value != old:
                        if old != NOBODY:
                            for r, i in group[k][2]:
                                spans[r].append((i, began, o - 1, old))
                        running[k] = (o, value)
            for k, (began, old) in running.items():
                if old != NOBODY:
                    for r, i in group[k][2]:
                        spans[r].append((i, began, back, old))

        group, shares = [], []
        for share, r, i in merge_runs(runs):
            if share == width and group:
                s, smallest, members = group[-1]
                members.append((r, i))
                if least[r][i] < smallest:
                    group[-1] = (s, least[r][i], members)
                continue
            if share < GRAM:
                settle(group, shares)
                group, shares = [], []
            group.append((runs[r][0][i], least[r][i], [(r, i)]))
            shares.append(min(share, length) if shares else 0)
        settle(group, shares)
        for (strings, _), answer, all_windows, some in zip(runs, answers, whole, spans):
            if all_windows[0]:
                answer[np.array(all_windows[0])] = np.array(all_windows[1], np.int64)[:, None]
            if some:
                suffix, first, last, value = np.array(some, np.int64).T
                for o in range(back + 1):
                    own = (first <= o) & (o <= last)
                    answer[suffix[own], o] = value[own]
            matrix = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
            before = (matrix[:, length:] == PAD).sum(1)[:, None]
            behind = (matrix[:, :length] == PAD).sum(1)[:, None]
            o = np.arange(back + 1)
            answer[(o > back - before) | (o < behind)] = NOBODY  # windows that leave the text
        target = table.column("target")
        return pa.table({"block": pa.array(blocks, pa.int32()), "shard": target,
                         "blob": pa.array([pack_arrays(a) for a in answers], pa.binary())})

    return run


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans of each owner."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    # Owners are numbered from 0, so that ends can be compared with a running maximum over all of them.
    _, number = np.unique(owner, return_inverse=True)
    shift = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - shift[last]


def _spans(length: int):
    """Of a block: each document's removed spans."""
    back = length - GRAM

    def run(index: pa.Table, replies: pa.Table) -> pa.Table:
        owners, starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if index.num_rows:
            rows, rank, place, number = unpack_arrays(index.column("blob")[0].as_py(), "<i8", "<i8", "<i8", "<i8")
            order = np.argsort(replies.column("shard").to_numpy())
            blobs = replies.column("blob").to_pylist()
            smallest = np.concatenate([unpack_arrays(blobs[i], "<i8")[0] for i in order]).reshape(-1, back + 1)
            parts = []
            for i in range(0, len(rows), 200_000):
                part = slice(i, i + 200_000)
                hit = np.zeros((len(rows[part]), back + 3), np.int8)
                hit[:, 1:-1] = smallest[number[part]] < rank[part][:, None]
                turn = np.diff(hit, axis=1)
                row, low = np.nonzero(turn == 1)
                _, high = np.nonzero(turn == -1)  # windows start at place - (high - 1) .. place - low
                parts.append((rows[part][row], place[part][row] - (high - 1), place[part][row] - low + length))
            owners, starts, ends = merge_spans(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])[: len(owners)])
        offsets = pa.array(np.append(first, len(owners)), pa.int32())
        return pa.table({
            "row": pa.array(owners[first], pa.int64()),
            "starts": pa.ListArray.from_arrays(offsets, pa.array(starts, pa.int64())),
            "ends": pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int64()))})

    return run


def repeated_spans(docs: DataFrame, length: int = 50, hot_documents: int = HOT_DOCUMENTS,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, starts, ends) of the documents with bytes to remove; ``row`` is :func:`row_hash`.

    Blocks and shards hold about ``block_bytes`` of text each, whatever the size of the input. A passage that very many
    documents share is one string in each block's run. An anchor in more than ``hot_documents`` documents is
    exchanged window by window, named by all its bytes.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Small inputs are dealt over the session's partitions too, down to a sixteenth of a block.
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * total // block_bytes))
    blocks = int(max(4, -(-total // block_bytes), spread))
    rows = docs.select(
        row_hash().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NOBODY))).alias("rank"), "text",
    ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    shared = _count_anchors(rows, length, blocks).groupBy("shard").applyInArrow(
        tidy(_shared_anchors(hot_documents)), "block int, blob binary")
    long = T.ArrayType(T.LongType())
    runs = stored(
        rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
            tidy(_suffix_runs(length, blocks)), "kind int, target int, block int, blob binary"), "runs")
    replies = runs.filter("kind = 0").drop("kind").groupBy("target").applyInArrow(
        tidy(_merge_shard(length)), "block int, shard int, blob binary")
    index = runs.filter("kind = 1").select("block", "blob")
    spans = index.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        tidy(_spans(length)), T.StructType([T.StructField("row", T.LongType()), T.StructField("starts", long),
                                            T.StructField("ends", long)]))
    return stored(spans, "spans")


def row_hash():
    """Names a row by a hash of its id and text; equal rows share it and their spans."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce("text", F.lit("")))


def _with_spans(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and text of every row with __starts and __ends. The spans are hashed, so texts are not sorted."""
    found = spans.select(F.col("row").alias("__row"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    need = list(dict.fromkeys([*columns, "text"]))
    both = docs.select(*need, row_hash().alias("__own")).join(
        found.hint("shuffle_hash"), F.col("__own") == F.col("__row"), "left")
    return both.select(*need, "__starts", "__ends")


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Some rows at a time: the rows, and of each its text, the starts of its spans and what is kept of it, as bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, CUT_ROWS):
            part = batch.slice(i, CUT_ROWS)
            texts, starts, ends = raw(part, "text"), *(part.column(c).to_pylist() for c in ("__starts", "__ends"))
            kept = [b"".join([t[x:y] for x, y in zip([0, *e], [*s, len(t)])]) if s else t
                    for t, s, e in zip(texts, starts, ends)]
            yield part, texts, starts, kept


def suffix_dedup(docs: DataFrame, length: int = 50, hot_documents: int = HOT_DOCUMENTS,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a ``length``-byte string over it also starts in a document with a smaller id, judged on the input.
    Null texts are empty; a null id is larger than every other and equal to another null; rows with equal ids do not
    remove each other's bytes; extra columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, starts, kept in _cut_texts(batches):
            sizes, left = (np.fromiter((len(t or b"") for t in x), np.int64, len(x)) for x in (texts, kept))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(sizes - left),
                 pa.array([len(s or ()) for s in starts], pa.int64()),
                 pa.array([hashlib.sha256(t or b"").hexdigest() for t in kept], pa.string())], schema.names)

    new = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([docs.schema["doc_id"], *new, T.StructField("kept_sha256", T.StringType())])
    spans = repeated_spans(docs, length, hot_documents, block_bytes)
    return _with_spans(docs, spans, ["doc_id"]).mapInArrow(tidy(run), schema)


def deduplicated_documents(docs: DataFrame, length: int = 50, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """The rows with their texts cut, with the columns of ``docs``; ``n_chars``, where present, follows the text.

    A character of which a byte goes is lost whole. Rows left without text go, except those that had none before.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cut and decoded by one worker: a second one beside it would hold as much memory again.
        for part, texts, starts, kept in _cut_texts(batches):
            stay = [i for i, (t, k) in enumerate(zip(texts, kept)) if k or not t]
            kept = [kept[i].decode(errors="ignore").encode() if starts[i] else kept[i] for i in stay]
            rows, text = part.take(pa.array(stay, pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else rows.column(c) for c in names], names)

    out = _with_spans(docs, repeated_spans(docs, length, hot_documents), names).mapInArrow(tidy(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
