"""Spelling variants: pairs of words one edit apart, by composing minimised acceptors with a one-edit transducer.

Two words one edit apart share their first or their last half. Words are therefore partitioned by the state that such a
half leads to; inside a partition only the rest of each word is left, and the acceptor of the rests is composed with the
transducer and itself. A partition with too many words is split by the same rule, applied to the rests.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import raw, stored

#: Fixed pattern of a run of letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Different words that a task counts before it passes the counts on.
HELD = 300_000
#: Words of a partition, and code points of its shorter rest; larger ones are split.
PARTITION_WORDS = 20_000
LONG = 400


def damaged(doc_id: str, run: str, one_in: int) -> str:
    """The run without one of its code points, where a hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): the words of at least ``least_length`` code points that occur at least ``least_count`` times.

    Words are runs of letters with A-Z lowered; one document in ``one_in`` misspells a given run. Counts are added up
    in the tasks first, so a very common word arrives as a few rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), raw(batch, "text")):
                own: dict[str, int] = {}
                for run in RUN.findall((text or b"").lower().decode()):
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = damaged(doc, run, one_in)
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    return docs.select(doc, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """The smallest deterministic acceptor of sorted different words: ``next`` state by letter, and whether it accepts.

    Each state has the number of its equal twin: states are registered from the last one of a word up, and a state with
    the same letters, targets and acceptance as a registered one is replaced by it.
    """

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        known: dict[tuple, int] = {}

        def settle(arcs: dict[str, int], accepts: bool) -> int:
            key = (accepts, *arcs.items())
            if key not in known:
                known[key] = len(self.next)
                self.next.append(arcs)
                self.accepts.append(accepts)
            return known[key]

        path: list[tuple[dict[str, int], bool]] = [({}, False)]  # the open states of the last word
        last = ""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            while len(path) > common + 1:
                state = settle(*path.pop())
                path[-1][0][last[len(path) - 1]] = state
            path += [({}, False) for _ in word[common:]]
            path[-1] = (path[-1][0], True)
            last = word
        while len(path) > 1:
            state = settle(*path.pop())
            path[-1][0][last[len(path) - 1]] = state
        self.start = settle(*path.pop())

    def shared(self, p: int, q: int, memory: dict[tuple[int, int], tuple[str, ...]]) -> tuple[str, ...]:
        """The words accepted from both states."""
        if (p, q) not in memory:
            found = [""] if self.accepts[p] and self.accepts[q] else []
            other = self.next[q]
            for a, state in self.next[p].items():
                if a in other:
                    found += [a + rest for rest in self.shared(state, other[a], memory)]
            memory[p, q] = tuple(found)
        return memory[p, q]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs (shorter or smaller, other) of the composition with the transducer of exactly one edit.

        Before the edit both sides are in one state, because the acceptor is deterministic; behind it they are in two,
        and what both accept is the common rest. States below which nothing is paired are not entered.
        """
        memory: dict[tuple[int, int], tuple[str, ...]] = {}
        edits: list[list[tuple[str, str]]] = []  # what an edit in each state leads to
        for state, arcs in enumerate(self.next):
            found = []
            items = sorted(arcs.items())
            for i, (a, p) in enumerate(items):
                found += [(rest, a + rest) for rest in self.shared(state, p, memory)]  # a inserted
                for b, q in items[i + 1:]:
                    found += [(a + rest, b + rest) for rest in self.shared(p, q, memory)]
            edits.append(found)
        useful = [False] * len(self.next)  # targets have smaller numbers than their sources
        for state, arcs in enumerate(self.next):
            useful[state] = bool(edits[state]) or any(useful[q] for q in arcs.values())
        waiting = [("", self.start)]
        while waiting:
            prefix, state = waiting.pop()
            for a, b in edits[state]:
                yield prefix + a, prefix + b
            waiting += [(prefix + a, q) for a, q in self.next[state].items() if useful[q]]


def _halves(words: DataFrame) -> DataFrame:
    """The words (key, size, word, left, right) again under each half of what their key leaves open.

    ``left`` and ``right`` count the code points that the key fixes at a word's two ends; between them lies the rest.
    ``size`` is the shorter rest of a partition, whose rests have this length or one more, so every rest joins the
    partitions of its own length and of one less. With one edit in it, one half of ``size`` code points, rounded down,
    is the same in both words.
    """
    rest = F.length("word") - F.col("left") - F.col("right")
    sizes = F.when(F.col("size").isNull(), F.array(rest - 1, rest)).otherwise(F.array("size"))
    open_ = words.withColumn("size", F.explode(sizes)).filter("size >= 0").withColumn("half", F.floor(F.col("size") / 2).cast("int"))
    front = F.struct(F.lit("<").alias("side"), (F.col("left") + F.col("half")).alias("left"), F.col("right").alias("right"))
    back = F.struct(F.lit(">").alias("side"), F.col("left").alias("left"), (F.col("right") + F.col("half")).alias("right"))
    sided = open_.select("key", "size", "word", "half", F.explode(F.array(front, back)).alias("to"))
    begin = F.when(F.col("to.side") == "<", F.col("to.left") - F.col("half")).otherwise(
        F.length("word") - F.col("to.right"))
    part = F.col("word").substr(begin + 1, F.col("half"))
    # A separator that is no letter keeps keys of different cuts apart.
    return sided.select(
        F.concat_ws("/", "key", F.col("size").cast("string"), "to.side", part).alias("key"),
        (F.col("size") - F.col("half")).alias("size"), "word", "to.left", "to.right")


def near_pairs(words: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """(a, b): the pairs of different ``word`` values that differ by one inserted, deleted or replaced code point.

    Words must be different. Partitions are counted; those of one word have no pairs, those above ``partition_words`` or
    ``LONG`` are split until none is larger or one position is open, where rests have two letters at most.
    """
    open_ = _halves(words.select(F.lit("").alias("key"), F.lit(None).cast("int").alias("size"), "word",
                                 F.lit(0).alias("left"), F.lit(0).alias("right")))
    done = None
    while True:
        several = open_.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        open_ = stored(open_.join(several, "key"), "partitions")
        large = ((F.col("n") > partition_words) | (F.col("size") > LONG)) & (F.col("size") > 1)
        closed = open_.filter(~large)
        done = closed if done is None else done.unionByName(closed)
        split = open_.filter(large)
        if split.isEmpty():
            break
        open_ = _halves(split.drop("n"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cut, held = None, (0, 0), []

        def pairs() -> Iterator[tuple[str, str]]:
            left, right = cut
            if len(held) > 1:
                head, tail = held[0][:left], held[0][len(held[0]) - right:]
                for a, b in Acceptor(sorted({w[left:len(w) - right] for w in held})).pairs():
                    yield head + a + tail, head + b + tail

        def rows(found: set[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.string()),
                                               pa.array([max(p) for p in found], pa.string())], ["a", "b"])

        found: set[tuple[str, str]] = set()
        for batch in batches:
            for k, word, *ends in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "left", "right"))):
                if k != key:
                    found.update(pairs())
                    key, cut, held = k, tuple(ends), []
                    if len(found) > HELD:
                        yield rows(found)
                        found = set()
                held.append(word)
        found.update(pairs())
        yield rows(found)

    sorted_ = done.select("key", "word", "left", "right").repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(compose, "a string, b string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles: the last form that is reached, by pointer doubling."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(found.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return found


def variants(words: DataFrame, times: int = 5, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of (word, n).

    ``form`` is the near word of largest n (ties: smallest in code-point order), if it occurs at least ``times`` as
    often; ``root`` follows the forms to the last one.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = near_pairs(words, partition_words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    both = pairs.select(F.explode(ways).alias("way")).select("way.*")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = stored(counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")), "best")
    marked = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")
    ).select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    last = roots(marked.filter("form IS NOT NULL"))
    return marked.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199,
                      times: int = 5) -> DataFrame:
    """:func:`variants` of the vocabulary of all texts.

    Null texts have no words; null ids count as the empty text in the hash that misspells; repeated rows count each
    time; texts are read whole; extra columns are ignored; an empty table gives an empty result.
    """
    return variants(vocabulary(docs, least_length, least_count, one_in), times)
