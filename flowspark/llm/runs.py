"""Periodic runs of words by Baier's grouping: Lyndon arrays under both orders, Lyndon roots extended to runs.

A run is a stretch of words with smallest period q that no neighbouring word extends; here those of at least ``LEAST`` words
and ``TIMES`` periods count. Every run has a Lyndon root, a stretch of q words that is the longest Lyndon word at its place,
under the order of the words or under the reverse one. So both Lyndon arrays give all candidates (place, q).

*Lyndon arrays.* Phase one of Baier's suffix sorting. Places start in groups by their word. Groups are taken from the
largest down; each place of the group has a previous place of a smaller group, which is found by following the pointers of
larger places, and those previous places move to a new group right above their old one, by how many of the group point to
them. A group's common context grows by the context of the group that points to it, and ends as the longest Lyndon word of
its places. Each place is passed over once, so the time is in proportion to the words.

*Extension.* From a candidate, the words before it and after it are compared with those q on: the longest common extensions
both ways come from prefix sums of hashed words by bisection, all candidates at once. Every run found is then compared word
by word, and one that hashing made too long is extended word by word instead, so results are exact.

*What is grouped.* In a run every stretch of three words occurs at least three times in its text, and whatever extends the run
does too. Places that no such stretch covers can be in no run; they cut the text, and the stretches between are grouped.

A text is worked on whole by one task, in memory in proportion to its words. Cases: a null or blank text has no words and no
runs; a null id counts as no number, so nothing of that text is rewritten by the query; rows that repeat are judged each for
themselves; empty tables give no rows; columns of the table named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, table, words_of
from .shingles import mixed

LEAST, TIMES = 6, 4
#: Words whose stretches are counted at a time; a longer text is worked on alone.
AT_ONCE = 1 << 17
RESULTS = {"n_words": T.LongType(), "runs": T.ArrayType(T.ArrayType(T.LongType())), "collapsed": T.StringType()}


def lyndon(words: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by Baier's phase one; words are numbers in their order."""
    starts: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        starts.setdefault(word, []).append(place)
    members = [starts[word] for word in sorted(starts)]
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]  # neighbours in the order of groups
    group, previous, taken = [0] * len(words), [-1] * len(words), bytearray(len(words))
    for number, places in enumerate(members):
        for place in places:
            group[place] = number
    now = len(members) - 1
    while now >= 0:
        own = [place for place in members[now] if group[place] == now]
        members[now] = []
        for place in own:
            taken[place] = 1
        pointed: dict[int, int] = {}  # previous places, in order, and how many of this group point to them
        for place in own:
            before = place - 1
            while before >= 0 and taken[before]:  # of a larger group or of this one: its own pointer is set
                before = previous[before]
            previous[place] = before
            if before >= 0:
                pointed[before] = pointed.get(before, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for before, times in pointed.items():
            moved.setdefault((-times, group[before]), []).append(before)
        for times, old in sorted(moved):  # those pointed to most often end up highest
            new = len(members)
            members.append(moved[times, old])
            length.append(length[old] - times * length[now])
            below.append(old)
            above.append(above[old])
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
            for place in moved[times, old]:
                group[place] = new
        now = below[now]
    return [length[number] for number in group]


def _repeated(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each place is covered by a stretch of three words that its text has three times or more."""
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        value = mixed(text[2:].astype(np.uint64))
        for k in range(3):
            value = mixed(value + words[k:len(words) - 2 + k].astype(np.uint64) * np.uint64(2 * k + 3))
        _, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
        often = (counts[inverse] >= 3) & (text[2:] == text[:-2])  # equal hashes of unlike stretches only cover more
        for k in range(3):
            covered[k:len(words) - 2 + k] |= often
    return covered


class Extensions:
    """How far the words at two places agree, forwards and backwards, by hashes; ``exact`` compares the words."""

    def __init__(self, words: np.ndarray):
        base = 0x9E3779B97F4A7C15
        self.words, size = words, len(words)
        powers = np.full(size + 1, base, np.uint64)
        back = np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
        powers[0] = back[0] = 1
        powers, self.back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * powers[:size], dtype=np.uint64, out=self.sums[1:])

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[a + size] - self.sums[a]) * self.back[a] == (self.sums[b + size] - self.sums[b]) * self.back[b]

    def both(self, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words before ``place`` that equal those a period on, and words from it on that do."""
        other = place + period
        after, before = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        step = 1 << max(0, len(self.words).bit_length() - 1)
        while step:
            more = np.minimum(after + step, len(self.words) - other)
            longer = (more > after) & self._equal(place, other, more)
            after = np.where(longer, more, after)
            more = np.minimum(before + step, place)
            longer = (more > before) & self._equal(place - more, other - more, more)
            before = np.where(longer, more, before)
            step >>= 1
        return before, after

    def exact(self, place: int, period: int) -> tuple[int, int]:
        ahead = np.flatnonzero(self.words[place + period:] != self.words[place:len(self.words) - period])
        behind = np.flatnonzero(self.words[period:place + period][::-1] != self.words[:place][::-1])
        return (int(behind[0]) if len(behind) else place), (int(ahead[0]) if len(ahead) else len(self.words) - period - place)


def runs(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts that stand one after the other; ``text`` is the text of each word."""
    covered = _repeated(words, text)
    change = np.flatnonzero(np.concatenate(([True], (covered[1:] != covered[:-1]) | (text[1:] != text[:-1])))) if len(words) else []
    found: list[tuple[int, int, int]] = []
    stretches = [(a, b) for a, b in zip(change, [*change[1:], len(words)]) if covered[a] and b - a >= LEAST]
    if not stretches:
        return found
    # All stretches, each followed by a mark that equals nothing else, so that no extension leaves one.
    parts, where, places, periods, at = [], [], [], [], 0
    for number, (a, b) in enumerate(stretches):
        ranks = np.unique(words[a:b], return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            root = np.array(lyndon(order.tolist()), np.int64)
            place = np.flatnonzero(np.arange(b - a) + 2 * root <= b - a)
            place = place[(ranks[place] == ranks[place + root[place]])]
            places.append(at + place)
            periods.append(root[place])
        parts += [words[a:b].astype(np.int64), np.array([-1 - number])]
        where.append((at, a))
        at += b - a + 1
    joined = Extensions(np.concatenate(parts))
    place, period = np.concatenate(places), np.concatenate(periods)
    before, after = joined.both(place, period)
    length = before + after + period
    long = length >= np.maximum(LEAST, TIMES * period)
    place, period, before, length = (x[long] for x in (place, period, before, length))
    if not len(place):
        return found
    _, first = np.unique(np.stack([place - before, period, length]), axis=1, return_index=True)
    begins, origins = (np.array(x, np.int64) for x in zip(*where))
    exact: set[tuple[int, int, int]] = set()
    for k in first.tolist():
        start, q, n = int(place[k] - before[k]), int(period[k]), int(length[k])
        if (joined.words[start:start + n - q] != joined.words[start + q:start + n]).any():
            back, on = joined.exact(int(place[k]), q)
            start, n = int(place[k]) - back, back + on + q
        if n >= max(LEAST, TIMES * q):
            exact.add((start, n, q))
    for start, n, q in sorted(exact):
        number = int(np.searchsorted(begins, start, side="right")) - 1
        found.append((start - int(begins[number]) + int(origins[number]), n, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _results(several: list[list[bytes]], codes: dict[bytes, int]) -> Iterator[tuple[int, list, str]]:
    """Number of words, runs and collapsed text of some texts, each given by its words."""
    sizes = [len(words) for words in several]
    coded = np.fromiter((codes[word] for words in several for word in words), np.int64, sum(sizes))
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    by_text: dict[int, list] = {}
    for start, length, period in runs(coded, np.repeat(np.arange(len(sizes)), sizes)):
        number = int(np.searchsorted(starts, start, side="right")) - 1
        by_text.setdefault(number, []).append([start - int(starts[number]), length, period])
    for number, words in enumerate(several):
        own = by_text.get(number, [])
        if own:
            edges = np.zeros(len(words) + 1, np.int64)
            for start, length, period in own:
                edges[start + period] += 1
                edges[start + length] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
        yield sizes[number], own, b" ".join(words).decode()


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (an array of [start, length, period] by start and period) and ``collapsed``: the words
    of the text without those that any run holds after its first period, joined by one space."""
    kept = [name for name in df.columns if name not in RESULTS]
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(k, v) for k, v in RESULTS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                out, held, codes = [], [], {}
                total = 0
                for value in batch.column(text):
                    words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                    for word in words:
                        codes.setdefault(word, len(codes))
                    held.append(words)
                    total += len(words)
                    if total >= AT_ONCE:
                        out += _results(held, codes)
                        held, codes, total = [], {}, 0
                out += _results(held, codes)
                counts, found, texts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(name) for name in kept), pa.array(counts, pa.int64()),
                     pa.array(found, pa.list_(pa.list_(pa.int64()))), pa.array(texts, pa.string())], [*kept, *RESULTS])

    return df.mapInArrow(freed(run), schema)


def most_repeated(runs: Column) -> Column:
    """The run of the greatest length / period, exactly; the first in order among equals. Null without runs."""
    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run[1] * best[2] > best[1] * run[2]), run).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("array<long>"), better)


def made_periodic(text: Column, number: Column) -> Column:
    """A tenth of the texts with their words made periodic from some word on, as the contract of the query has it."""
    def rewritten(words: Column) -> Column:
        n, g = F.size(words), F.floor(number / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    # The words are bound to a variable of the function, so that they are cut once.
    return F.when(number % 10 == 0, F.transform(F.array(words_of(text)), rewritten)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = find_runs(documents.withColumn("text", made_periodic(F.col("text"), checksum)))
    line = F.transform("runs", lambda run: F.concat(F.array_join(run.cast("array<string>"), ","), F.lit("\n")))
    best = found.withColumn("best", most_repeated(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best")[0].alias("start"), F.col("best")[1].alias("length"),
        F.col("best")[2].alias("period"), F.floor(1000 * F.col("best")[1] / F.col("best")[2]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
