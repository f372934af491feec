"""Packing documents into token sequences: patterns of few lengths fitted by non-negative least squares."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import give_back, stored

#: Words whose ids a task remembers; the memory is emptied when full.
REMEMBERED = 300_000
_TOKENIZERS: dict[str, object] = {}
#: Words seen by this worker, by tokenizer; kept from task to task.
_WORDS: dict[str, Words] = {}
#: Stands between words that are encoded together; words that hold it or may hold an added token are encoded alone.
MARK = "\x01"
TOGETHER = 20_000
#: Bytes of text whose new words are learned together.
TEXTS = 1 << 21
#: ASCII marks that pre-tokenizers split from letters and digits before them.
CLOSING = ".,;:!?%$#&*"
#: An end that normalising leaves one letter or digit, so that marks behind it stay apart.
_LETTER_END = "[0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]$"


def _tokenizer(path: str):
    """Loaded once per worker. A bare file name is looked up among the installed public tokenizers."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in path:
            import public_tokenizers

            _TOKENIZERS[path] = Tokenizer.from_file(str(public_tokenizers.path(path)))
        else:
            _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start:start + length] one behind the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


class Words:
    """Ids of words, each encoded once while it is remembered; the memory is emptied when it is full."""

    def __init__(self, path: str):
        self.encoder = _tokenizer(path)
        self.ids: dict[bytes, bytes] = {}
        # Where all spellings have the same ids, words are remembered in lower case.
        self.lowers = self._encode("Az") == self._encode("az")
        self.splits = self._encode("a.,") == self._encode("a") + self._encode(".,")
        self.mark = self._encode(MARK)
        self.ends = np.zeros(self.encoder.get_vocab_size(), bool)
        self.ends[[i for token, i in self.encoder.get_vocab().items() if token.endswith("</w>")]] = True

    def _encode(self, text: str) -> list[int]:
        return self.encoder.encode(text, add_special_tokens=False).ids

    def _parts(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words without the ASCII marks at their end, then the marks, as codes of one dictionary; and where marks go."""
        heads = pc.ascii_rtrim(words, characters=CLOSING)
        apart = pc.and_(pc.match_substring_regex(heads, _LETTER_END), pc.invert(pc.match_substring(words, "<")))
        heads = pc.if_else(apart if self.splits else False, heads, words)
        whole, kept = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, heads))
        marked = np.flatnonzero(whole > kept)
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)[1:].astype(np.int64)
        lengths = (whole - kept)[marked]
        data = _gather(np.frombuffer(words.buffers()[2], np.uint8), ends[marked] - lengths, lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(marked), pa.py_buffer(offsets), pa.py_buffer(data))
        return pa.concat_arrays([heads, tails]).dictionary_encode(), marked

    def _together(self, words: list[bytes], between: str, last: Callable[[np.ndarray], np.ndarray], keep: int) -> bool:
        """Encode words as one text and cut its ids behind (``keep`` 4) or before (0) the ids that end a word."""
        text = between.encode().join(words).decode()
        ids = np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = 4 * np.flatnonzero(last(ids))
        if len(at) != len(words) - (0 if keep else 1):
            return False
        blob, starts = ids.tobytes(), [0, *(at + 4).tolist()]
        self.ids.update(zip(words, [blob[a:b] for a, b in zip(starts, [*(at + keep).tolist(), len(blob)])]))
        return True

    def _learn(self, words: pa.Array) -> None:
        """Words of letters alone are encoded as one text and cut at their closing tokens, others with a mark between."""
        alone = pc.or_(pc.match_substring(words, "<"), pc.match_substring(words, MARK))
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        data = words.cast(pa.binary()).to_pylist()
        groups = [[data[i] for i in np.flatnonzero(g)] for g in (letters, ~(letters | alone.to_numpy(zero_copy_only=False)))]
        for part in (groups[0][i:i + TOGETHER] for i in range(0, len(groups[0]), TOGETHER)):
            if not self._together(part, " ", lambda ids: self.ends[ids], 4):
                groups[1] += part
        if len(self.mark) == 1:
            for part in (groups[1][i:i + TOGETHER] for i in range(0, len(groups[1]), TOGETHER)):
                self._together(part, f" {MARK} ", lambda ids: ids == self.mark[0], 0)
        for w in data:
            if w not in self.ids:
                self.ids[w] = np.array(self._encode(w.decode()), "<u4").tobytes()

    def encoded(self, texts: pa.Array) -> tuple[bytes, list[int]]:
        """The ids of all texts, and where each text's bytes begin and end. White space is that of ASCII."""
        if self.lowers:  # a "<" may open an added token, whose case counts
            texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        parts, marked = self._parts(words.dictionary)
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        names = parts.dictionary.cast(pa.binary()).to_pylist()
        new = [i for i, w in enumerate(names) if w not in self.ids]
        self._learn(parts.dictionary.take(pa.array(new, pa.int64())))
        found = [self.ids[w] for w in names]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        # A distinct word's ids are those of its head and its marks; a text's ids are those of its words.
        n = len(words.dictionary)
        part, codes = np.full((n, 2), -1, np.int64), parts.indices.to_numpy()
        part[:, 0], part[marked, 1] = codes[:n], codes[n:]
        part = part.ravel()
        counts = np.where(part >= 0, sizes[part], 0) if n else np.zeros(0, np.int64)
        flat = _gather(flat, np.where(part >= 0, starts[part], 0), counts) if n else flat
        sizes = counts.reshape(-1, 2).sum(1)
        code = words.indices.to_numpy()
        data = _gather(flat, (np.cumsum(sizes) - sizes)[code], sizes[code]).tobytes()
        before = np.concatenate(([0], np.cumsum(sizes[code])))
        return data, (4 * before[split.offsets.to_numpy()]).tolist()


def _ids(known: Words, column: pa.Array, end: bytes) -> Iterator[bytes]:
    """Each text's ids and the end id, as little-endian 32-bit bytes; texts are taken about ``TEXTS`` bytes at a time."""
    column = pc.fill_null(column, "")
    behind = np.cumsum(pc.binary_length(column).to_numpy())
    cuts = (np.flatnonzero(np.diff(behind // TEXTS, append=-1)) + 1).tolist()
    for first, last in zip([0, *cuts], cuts):
        data, at = known.encoded(column.slice(first, last - first))
        for a, b in zip(at, at[1:]):
            yield data[a:b] + end


def pieces(docs: DataFrame, length: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where they are too long.

    The tokenizer must treat text between white space on its own (it normalises, splits and merges inside such chunks
    only); each distinct chunk is then encoded once per task. ``keep_ids`` adds the ids as little-endian 32-bit bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = Words(tokenizer)
        known = _WORDS[tokenizer]
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            index, piece, crc, sizes, kept = [], [], [], [], []
            for row, ids in enumerate(_ids(known, batch.column("text"), end)):
                for k in range(0, len(ids), step):
                    cut = ids[k:k + step]
                    index.append(row)
                    piece.append(k // step)
                    sizes.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if keep_ids:
                        kept.append(cut)
            piece = np.array(piece, np.int32)
            columns = [batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(piece),
                       pa.array(piece.astype(np.int64) * length), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, schema.names)
        give_back()

    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.BinaryType())] * keep_ids
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All patterns of one to three present lengths that fill a sequence exactly, as sorted rows padded with 0."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    found = [np.array([[size, 0, 0]])] if has[size] else []
    for a in present[present < size][::-1]:
        rest = size - a
        b = present[(present <= a) & (2 * present >= rest) & (present <= rest)]
        c = rest - b
        ok = (c == 0) | has[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_repeats(rows: np.ndarray, histogram: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of histogram - (lengths used by x).

    Longer lengths weigh more: a short leftover still fits somewhere. Accelerated projected gradient on a matrix that
    is never built: a pattern's gradient is the sum of the residuals of its lengths.
    """
    if not len(rows):
        return np.zeros(0)
    size = len(histogram) - 1
    weight = np.arange(size + 1) / size
    weight[0] = 0.0
    h = histogram.astype(float)
    h[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, i], x, size + 1) for i in range(rows.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[rows[:, i]] for i in range(rows.shape[1]))

    probe = np.random.default_rng(0).random(len(rows))
    bound = 1.0
    for _ in range(12):  # largest eigenvalue, for the step
        probe = back(weight * used(probe))
        bound = float(np.linalg.norm(probe))
        probe /= max(bound, 1e-12)
    bound *= 1.05
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        r = used(y) - h
        r[0] = 0.0
        step = np.maximum(0.0, y - back(weight * r) / bound)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = step + (t - 1) / t_next * (step - x)
        x, t = step, t_next
    return x


def plan(histogram: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Packing of a histogram of lengths as runs (length, first rank, count, first sequence, offset).

    The items of a length are numbered by rank; a run puts ``count`` of them into consecutive sequences at one offset.
    Fitted patterns come first, rounded and never beyond what is left; the rest goes best-fit decreasing into new
    sequences. All work is on the histogram, so it does not grow with the number of documents.
    """
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, int(taken[length]), count, sequence, offset))
        taken[length] += count
        left[length] -= count

    rows = patterns(np.flatnonzero(left), size)
    repeats = fit_repeats(rows, left, rounds)
    wanted = np.floor(repeats + 0.5).astype(np.int64)
    for k in sorted(np.flatnonzero(wanted).tolist(), key=lambda k: (-repeats[k], k)):
        lengths = [int(v) for v in rows[k] if v]
        n = min([int(wanted[k]), *(int(left[v]) // lengths.count(v) for v in lengths)])
        if n > 0:
            offset = 0
            for v in lengths:
                put(v, n, sequences, offset)
                offset += v
            sequences += n

    room: list[int] = []  # sorted free lengths of open sequences
    open_at: dict[int, list[tuple[int, int]]] = {}

    def add(free: int, sequence: int, count: int) -> None:
        if free:
            if free not in open_at:
                insort(room, free)
            open_at.setdefault(free, []).append((sequence, count))

    for length in range(size, 0, -1):
        while left[length]:
            at = bisect_left(room, length)
            if at < len(room):
                free = room[at]
                sequence, count = open_at[free].pop()
                if not open_at[free]:
                    del open_at[free], room[at]
                n = min(count, int(left[length]))
                put(length, n, sequence, size - free)
                add(free - length, sequence, n)
                if count > n:
                    add(free, sequence + n, count - n)
                continue
            fit = size // length
            n, over = divmod(int(left[length]), fit)
            for count, each in ((n, fit), (1, over)):
                if count and each:
                    for i in range(each):
                        put(length, count, sequences, i * length)
                    add(size - each * length, sequences, count)
                    sequences += count
    return np.array(runs, np.int64).reshape(-1, 5)


def _assign(ranked: DataFrame, runs: np.ndarray) -> DataFrame:
    """Look up each (length, rank) among the runs, which depend on the sequence length, not on the documents."""
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = ranked.sparkSession.sparkContext.broadcast(runs)
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bounds = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = length == v
                lo, hi = bounds[v], bounds[v + 1]
                at[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(sequence), pa.array(table[at, 4])],
                [*names, "sequence_id", "offset"])

    fields = [ranked.schema[c] for c in names]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0,
         buckets: int = 64, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document with its place: sequence_id and offset.

    The driver sees one count per length (``length`` numbers) and plans on them. Pieces of one length are numbered
    through ``buckets`` hash buckets, so a length shared by very many copies is not ranked in one task. Null texts count
    as empty and take one id, the end; rows with a null or repeated id are packed like others; extra columns are
    ignored; an empty table gives an empty result.
    """
    cut = stored(pieces(docs, length, tokenizer, end_id, keep_ids), "pieces")
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # At most length x buckets rows.
    counts = cut.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).toLocalIterator():
        histogram[row["length"]] = row["n"]
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(base), ["length", "bucket"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    return _assign(ranked.select(*names, (F.col("own") + F.col("base")).alias("rank")), plan(histogram))
