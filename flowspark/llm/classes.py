"""Language-model scores of a Brown class-based bigram model: every word has a class, and a text's probability is the product
of class transitions and word emissions, P(class | class before) * P(word | class).

1. *Coding.* Tasks cut texts into words, A-Z lower-cased, and code them by portions of some ``PORTION`` words: a portion has
   its own list of distinct words, as 64-bit hashes, and its pieces of documents as numbers in that list. Each document ends
   with an end, which is also what stands before the first word. A long document is several pieces.
2. *Counts.* The word lists of all portions go to shards by hash, whose number follows the size of the lists, and are summed.
3. *Exchange clustering.* The ``HEAD`` most frequent words start in ``CLASSES`` classes by rank. In each round Spark counts,
   over all training documents, how often each of them stands before and after each class, and each word in turn moves to
   the class where the likelihood of class bigrams is largest. The best of ``ROUNDS`` rounds by that likelihood stays. All
   other words, of any number, form one class until then; now every one of them moves by the same criterion, from its own
   counts before and after each class, in the shard of its hash.
4. *Scores.* Class transitions are counted over all training documents with the final classes, and interpolated with class
   frequencies by Witten and Bell: (N(b, c) + D(b) P(c)) / (N(b) + D(b)), with D(b) the number of classes seen after b. Words
   never seen in training are one word in a class of its own, whose frequency is that of words seen once. An emission is a
   word's share in its class. So the probabilities of all words, the unseen one and the end sum to one.

What the driver or a broadcast holds is bounded by parameters: HEAD words, with HEAD * (CLASSES + 2) counts on either side, and
matrices of classes. A task holds a portion or a shard at a time; counts of the head are summed for each ``TASKS`` tasks first, so
that few of them meet in a group. What is shuffled grows with the input. Results follow from the documents alone, but for the portions
that lie in one task: these change no count. Distinct words with equal 64-bit hashes would count as one.

Cases: a null or blank text has its end only; a null id is kept; rows that repeat an id are documents of their own; very long
texts are cut into pieces; without training documents every probability is one, so all scores are 0; empty tables give no rows;
other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_batches
from .common import freed, stashed, table

CLASSES, HEAD, ROUNDS = 64, 4096, 4
#: Words of a portion, and bytes of text cut at a time.
PORTION, SLICE = 1 << 20, 1 << 20
#: Words that a shard of the word lists has, on average.
SHARD = 1 << 18
#: Counts of the head's words that are summed in one group, and tasks whose counts are summed in a group before all are.
CELLS, TASKS = 1 << 14, 32
#: Rows of a row group of the coded portions: what the writer holds, and what a task reads at least.
TOGETHER = 4
#: Bytes after which a batch for a Python worker ends. A portion has more: workers get one at a time, however many a task reads.
BATCH = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
CODED = ("portion long, keys array<long>, ids array<long>, training array<boolean>, ends array<boolean>, sizes array<int>, "
         "before array<int>, tokens array<int>, words array<long>, counts array<int>")
ASKED = "shard int, portion long, at array<int>, words array<long>, counts array<int>, kinds array<int>, codes array<int>, times array<int>"


def _column(lists: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(values) for values in lists]))).astype(np.int32)
    whole = np.concatenate([np.asarray(values) for values in lists]) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole).cast(kind))


def _array(row: dict, name: str) -> np.ndarray:
    return row[name].values.to_numpy(zero_copy_only=False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


class _Portion:
    """What a task has coded since it last gave out a portion."""

    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.pieces: list[tuple] = []  # key, id, training, whether the end is in it, what stands before, numbers of its words
        self.size = 0

    def add(self, key: int, id, training: bool, last: bool, before: bytes | None, words: list[bytes]) -> None:
        places = self.places
        number = lambda word: places.setdefault(word, len(places) + 1)  # noqa: E731  (0 is the end)
        coded = np.fromiter(map(number, words), np.int32, len(words))
        self.pieces.append((key, id, training, last, 0 if before is None else number(before),
                            np.append(coded, np.int32(0)) if last else coded))
        self.size += len(words) + 1

    def row(self, portion: int) -> pa.RecordBatch:
        keys, ids, training, ends, before, coded = zip(*self.pieces)
        sizes = [len(piece) for piece in coded]
        tokens = np.concatenate(coded)
        taught = np.repeat(np.array(training, bool), sizes)
        counts = np.bincount(tokens[taught], minlength=len(self.places) + 1)
        words = np.fromiter((xxhash.xxh3_64_intdigest(word) for word in self.places), np.uint64, len(self.places))
        lists = [(keys, pa.int64()), ([x for x in ids], pa.int64()), (training, pa.bool_()), (ends, pa.bool_()), (sizes, pa.int32()),
                 (before, pa.int32()), (tokens, pa.int32()), (np.append(np.uint64(0), words).view(np.int64), pa.int64()),
                 (counts, pa.int32())]
        names = [part.split()[0] for part in CODED.split(", ")]
        columns = [pa.array([list(x)], pa.list_(kind)) if isinstance(x, (tuple, list)) else _column([x], kind) for x, kind in lists]
        return pa.RecordBatch.from_arrays([pa.array([portion], pa.int64()), *columns], names)


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded stretch of it at a time."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, min(len(data), at + SLICE))
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end + 1


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Portions of the (id, text, training) of a task."""
    first, portion, number, key = TaskContext.get().partitionId() << 40, _Portion(), 0, 0
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        for id, text, training in zip(*(column.to_pylist() for column in batch.columns)):
            before, parts = None, _slices((text or "").encode("utf-8", "surrogatepass").lower())
            words: list[bytes] | None = next(parts, [])
            while words is not None:
                following = next(parts, None)
                portion.add(first + key, id, training, following is None, before, words)
                before = words[-1] if words else before
                words = following
                if portion.size >= PORTION:
                    yield portion.row(first + number)
                    portion, number = _Portion(), number + 1
            key += 1
    if portion.pieces:
        yield portion.row(first + number)


def coded(documents: DataFrame, is_training: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    plain = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"),
                             F.coalesce(is_training, F.lit(False)).alias("training"))
    return stashed(plain.mapInArrow(freed(_coded), CODED), "coded", {"parquet.block.row.count.limit": TOGETHER})


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words of a portion and of what stands before each; whether they are of training documents."""
    tokens, sizes = _array(row, "tokens"), _array(row, "sizes")
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate(([0], tokens[:-1])).astype(tokens.dtype)
    full = sizes > 0
    before[starts[full]] = _array(row, "before")[full]
    return before, tokens, np.repeat(_array(row, "training"), sizes)


def _sharded(words: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (words.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) > 0))) if len(order) else np.zeros(0, int)
    for part in np.split(order, bounds[1:]) if len(order) else ():
        yield int(shard[part[0]]), part


def vocabulary(portions: DataFrame, shards: int) -> DataFrame:
    """``words`` and ``counts``, arrays: the distinct words of training documents, a row for each shard."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = _array(row, "words")[1:], _array(row, "counts")[1:]
            words, counts = words[counts > 0], counts[counts > 0]
            parts = list(_sharded(words, shards))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard for shard, _ in parts], pa.int32()), _column([words[part] for _, part in parts], pa.int64()),
                 _column([counts[part] for _, part in parts], pa.int32())], ["shard", "words", "counts"])

    def summed(data: pa.Table) -> pa.Table:
        words, inverse = np.unique(_flat(data, "words"), return_inverse=True)
        counts = np.bincount(inverse, _flat(data, "counts"), len(words)).astype(np.int64)
        return pa.table([_column([words], pa.int64()), _column([counts], pa.int64())], ["words", "counts"])

    lists = portions.select("words", "counts").mapInArrow(freed(listed), "shard int, words array<long>, counts array<int>")
    return stashed(lists.groupBy("shard").applyInArrow(summed, "words array<long>, counts array<long>"), "vocabulary")


def _flat(data: pa.Table, name: str) -> np.ndarray:
    return data.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def head_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, most frequent first, and their counts; ties by the hash."""
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, counts = _array(row, "words"), _array(row, "counts")
            first = np.lexsort((hashes, -counts))[:most]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first]), pa.array(counts[first])], ["word", "n"])

    found = words.mapInArrow(frequent, "word long, n long").orderBy(F.desc("n"), "word").limit(most).toArrow()
    return found.column("word").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64)


def _of_head(words: np.ndarray, head: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    """The values of the words that are in ``head``, which is sorted; ``other`` for the rest."""
    if not len(head):
        return np.full(len(words), other)
    at = np.minimum(np.searchsorted(head, words), len(head) - 1)
    return np.where(head[at] == words, values[at], other)


def _f(counts: np.ndarray) -> np.ndarray:
    return counts * np.log(np.maximum(counts, 1))


class Bigrams:
    """Counts of class bigrams: classes, then the words outside the head, then the end. Words move between classes."""

    def __init__(self, counts: np.ndarray, classes: int):
        self.counts, self.classes = counts.astype(np.float64), classes
        self.parts = _f(self.counts)

    def likelihood(self) -> float:
        return float(self.parts.sum() - _f(self.counts.sum(0)).sum() - _f(self.counts.sum(1)).sum())

    def moved(self, number: int, after: np.ndarray, before: np.ndarray, own: float, sign: int) -> None:
        """Adds a word to a class, or takes it out; ``own`` is how often it follows itself, which neither vector holds.
        Neighbours that have moved since they were counted can't make a count negative."""
        self.counts[number] += sign * after
        self.counts[:, number] += sign * before
        self.counts[number, number] += sign * own
        for part in (np.s_[number], np.s_[:, number]):
            np.maximum(self.counts[part], 0, out=self.counts[part])
            self.parts[part] = _f(self.counts[part])

    def gains(self, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
        """What the likelihood gains where a word in no class is added to each class."""
        k, gain = self.classes, np.zeros(self.classes)
        for counts, parts, added in ((self.counts[:k], self.parts[:k], after), (self.counts[:, :k].T, self.parts[:, :k].T, before)):
            met = np.flatnonzero(added)
            change = _f(counts[:, met] + added[met]) - parts[:, met]
            gain += change.sum(1)
            among = np.flatnonzero(met < k)
            gain[met[among]] -= change[met[among], among]
        same = np.diagonal(self.counts)[:k]
        gain += _f(same + after[:k] + before[:k] + own) - np.diagonal(self.parts)[:k]
        # What stands beside the word adds to the sums of its own class, whichever class the word joins.
        for sums, beside, more in ((self.counts.sum(1), before, after.sum() + own), (self.counts.sum(0), after, before.sum() + own)):
            base = sums[:k] + beside[:k]
            gain -= _f(base + more) - _f(base)
        return gain


def _neighbours(portions: DataFrame, head: np.ndarray, classes: np.ndarray, k: int):
    """For each word of the head the counts of classes after it and before it and of itself; counts among the rest."""
    order = np.argsort(head)
    sent = portions.sparkSession.sparkContext.broadcast((head[order], order, classes[order]))  # HEAD words
    width, size = k + 2, len(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers, own = sent.value
        several = TaskContext.get().partitionId() // TASKS
        after, before = np.zeros(size * width, np.int64), np.zeros(size * width, np.int64)
        itself, rest = np.zeros(size, np.int64), np.zeros(width * width, np.int64)
        for row in _rows(batches):
            words = _array(row, "words")
            number, kind = _of_head(words, hashes, numbers, -1), _of_head(words, hashes, own, k)
            number[0], kind[0] = -1, k + 1
            left, right, taught = _pairs(row)
            left, right = left[taught], right[taught]
            a, b, c, d = number[left], number[right], kind[left], kind[right]
            after += np.bincount(a[a >= 0] * width + d[a >= 0], minlength=size * width)
            before += np.bincount(b[b >= 0] * width + c[b >= 0], minlength=size * width)
            itself += np.bincount(a[(a >= 0) & (a == b)], minlength=size)
            rest += np.bincount((c * width + d)[(a < 0) & (b < 0)], minlength=width * width)
        for kind, values in enumerate((after, before, itself, rest)):
            for part in range(0, len(values), CELLS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([several], pa.int32()),
                     _column([values[part:part + CELLS]], pa.int64())], ["kind", "part", "several", "counts"])

    def summed(data: pa.Table) -> pa.Table:
        total = _flat(data, "counts").reshape(data.num_rows, -1).sum(axis=0)
        names = ["kind", "part", "several"]
        return pa.table([*(data.column(name)[:1] for name in names), _column([total], pa.int64())], [*names, "counts"])

    schema = "kind int, part int, several int, counts array<long>"
    counted = portions.select("words", "training", "sizes", "before", "tokens").mapInArrow(freed(count), schema)
    # Every task has counts of all cells: a group that sums those of all tasks at once would grow with the input.
    for keys in (("kind", "part", "several"), ("kind", "part")):
        counted = counted.groupBy(*keys).applyInArrow(summed, schema)
    counted = counted.toArrow()
    found = [np.zeros(size * width), np.zeros(size * width), np.zeros(size), np.zeros(width * width)]
    for row in _rows(iter(counted.to_batches())):
        part, counts = row["part"].as_py(), _array(row, "counts")
        found[row["kind"].as_py()][part:part + len(counts)] = counts
    return found[0].reshape(size, width), found[1].reshape(size, width), found[2], found[3].reshape(width, width)


def exchange(portions: DataFrame, head: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, Bigrams, list[float]]:
    """Classes of the head's words, the class bigrams they give, and the likelihood before each round."""
    classes, best, seen = np.arange(len(head)) % k, None, []
    for number in range(rounds + 1):
        after, before, itself, rest = _neighbours(portions, head, classes, k)
        counts = rest
        for c in range(k):
            counts[c] += after[classes == c].sum(0)
        for c in (k, k + 1):  # what stands before the head's words without being one of them
            counts[c, :k] += np.bincount(classes, before[:, c], k)[:k]
        bigrams = Bigrams(counts, k)
        seen.append(bigrams.likelihood())
        if best is None or seen[-1] > max(seen[:-1]):
            best = classes.copy(), Bigrams(counts.copy(), k)
        if number == rounds:
            return *best, seen
        for word in range(len(head)):
            own, right, left = classes[word], after[word].copy(), before[word].copy()
            right[own] -= itself[word]
            left[own] -= itself[word]
            bigrams.moved(own, right, left, itself[word], -1)
            gains = bigrams.gains(right, left, itself[word])
            classes[word] = own if gains[own] >= gains.max() else int(gains.argmax())
            bigrams.moved(classes[word], right, left, itself[word], 1)


def _asked(head: np.ndarray, classes: np.ndarray, k: int, shards: int, spark: SparkSession):
    """Words of portions outside the head, by shard: their numbers, counts, and the classes after and before them."""
    order = np.argsort(head)
    sent = spark.sparkContext.broadcast((head[order], classes[order]))  # HEAD words
    width = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = sent.value
        for row in _rows(batches):
            words, counts = _array(row, "words"), _array(row, "counts")
            kind = _of_head(words, hashes, own, k)
            kind[0] = k + 1
            left, right, taught = _pairs(row)
            left, right = left[taught], right[taught]
            tail = kind == k
            codes = np.concatenate((left[tail[left]].astype(np.int64) * 2 * width + kind[right[tail[left]]],
                                    right[tail[right]].astype(np.int64) * 2 * width + width + kind[left[tail[right]]]))
            codes, times = np.unique(codes, return_counts=True)
            of = codes // (2 * width)
            low, high = np.searchsorted(of, np.arange(len(words))), np.searchsorted(of, np.arange(len(words)), side="right")
            rows = []
            rest = np.flatnonzero(tail)
            for shard, part in _sharded(words[rest], shards):
                at = rest[part]
                kinds = high[at] - low[at]
                entries = np.repeat(low[at] - (np.cumsum(kinds) - kinds), kinds) + np.arange(kinds.sum())
                rows.append((shard, at, words[at], counts[at], kinds, codes[entries] % (2 * width), times[entries]))
            for several in (rows[at:at + 64] for at in range(0, len(rows), 64)):
                shard, *lists = zip(*several)
                kinds_ = [pa.int32(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array([row["portion"].as_py()] * len(several), pa.int64()),
                     *(_column(list(x), kind) for x, kind in zip(lists, kinds_))], [part.split()[0] for part in ASKED.split(", ")])
    return run


def _told(counts: np.ndarray, k: int):
    """A shard: class and count of each word, answered to every portion that asked. Class k+1 is that of unseen words."""
    bigrams, width = Bigrams(counts, k), k + 2
    base = bigrams.counts
    plain = np.concatenate((base[:k].T, base[:, :k]))  # by code: the counts of each class with that neighbour
    small = np.stack([_f(plain + n) - _f(plain) for n in range(1, 9)])
    sums = base.sum(1)[:k], base.sum(0)[:k]  # these hold the word's neighbours already

    def chosen(starts: np.ndarray, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        gains = np.empty((len(codes), k))
        few = times <= len(small)
        gains[few] = small[times[few] - 1, codes[few]]
        gains[~few] = _f(plain[codes[~few]] + times[~few, None]) - _f(plain[codes[~few]])
        total = np.add.reduceat(gains, starts, axis=0)
        for side, own in enumerate(sums):
            more = np.add.reduceat(np.where(codes // width == side, times, 0), starts)[:, None]
            total -= _f(own + more) - _f(own)
        return total.argmax(axis=1)

    def run(data: pa.Table) -> pa.Table:
        lists = {name: _flat(data, name) for name in ("at", "words", "counts", "kinds", "codes", "times")}
        words, inverse = np.unique(lists["words"], return_inverse=True)
        totals = np.bincount(inverse, lists["counts"], len(words)).astype(np.int64)
        # Entries of a word from all portions are summed by code.
        keys, back = np.unique(np.repeat(inverse, lists["kinds"]) * (2 * width) + lists["codes"], return_inverse=True)
        times = np.bincount(back, lists["times"], len(keys)).astype(np.int64)
        of, codes = keys // (2 * width), keys % (2 * width)
        result = np.full(len(words), k + 1, np.int64)
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
        bounds = np.append(starts, len(of))
        first = 0
        while first < len(starts):  # some 2^15 entries at a time
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 15), side="right")) - 1)
            part = slice(bounds[first], bounds[last])
            result[of[starts[first:last]]] = chosen(starts[first:last] - bounds[first], codes[part], times[part])
            first = last
        sizes = pa.compute.list_value_length(data.column("at")).to_numpy()
        edges = np.cumsum(sizes)[:-1]
        return pa.table([data.column("portion"), *(_column(np.split(x, edges), kind) for x, kind in (
            (lists["at"], pa.int32()), (result[inverse], pa.int32()), (totals[inverse], pa.int64())))],
            ["portion", "at", "classes", "counts"])

    return run


def classified(portions: DataFrame, head: np.ndarray, classes: np.ndarray, bigrams: Bigrams, shards: int) -> DataFrame:
    """``portion``, ``at``, ``classes``, ``counts``: what each portion is told about its words outside the head."""
    k = bigrams.classes
    asked = portions.mapInArrow(freed(_asked(head, classes, k, shards, portions.sparkSession)), ASKED)
    return asked.groupBy("shard").applyInArrow(
        _told(bigrams.counts, k), "portion long, at array<int>, classes array<int>, counts array<long>")


PIECES = ("key long, id long, training boolean, last boolean, n_tokens long, n_known long, base double, own double, "
          "classes binary")


def _numbered(portions: DataFrame, head: np.ndarray) -> DataFrame:
    """Portions with each word's place in the head, or -1, instead of its hash: what is shuffled to the answers is small."""
    order = np.argsort(head)
    sent = portions.sparkSession.sparkContext.broadcast((head[order], order))  # HEAD words
    names = ["portion", "keys", "ids", "training", "ends", "sizes", "before", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                place = _of_head(batch.column("words")[k].values.to_numpy(), hashes, places, -1)
                place[0] = -1
                yield pa.RecordBatch.from_arrays([*(batch.column(name).slice(k, 1) for name in names),
                                                  _column([place], pa.int32())], [*names, "heads"])

    kept = [part for part in CODED.split(", ") if part.split()[0] in names]
    return portions.select(*names, "words").mapInArrow(freed(run), ", ".join([*kept, "heads array<int>"]))


def _followed(counts: np.ndarray, classes: np.ndarray, k: int, totals: tuple[int, int, int]):
    """A portion with what it is told: sums over its pieces, and the classes of their words, what stands before first."""
    tokens_, kinds, ends = totals
    own, times = np.append(classes, k + 1), np.append(counts, 0)  # the last is that of place -1

    def run(portion: pa.Table, told: pa.Table) -> pa.Table:
        row = next(_rows(portion.to_batches()))
        place = _array(row, "heads").astype(np.int64)
        number, n = own[place], times[place]
        if told.num_rows:
            at = _flat(told, "at")
            number[at], n[at] = _flat(told, "classes"), _flat(told, "counts")
        number[0], n[0] = k, ends
        # Only words are emitted by a class; the end and the unseen word are all that theirs have.
        emitted = np.where((n > 0) & (number < k), np.log10(np.maximum(n, 1)), 0.0)
        plain = np.log10((n + 1) / (tokens_ + kinds + 1))
        tokens, sizes = _array(row, "tokens"), _array(row, "sizes")
        edges = np.cumsum(sizes)[:-1]
        parts = np.split(tokens, edges)
        kind = number.astype(np.uint8)
        rows = [[len(part), int((n[part] > 0).sum()), float(plain[part].sum()), float(emitted[part].sum()),
                 kind[np.append(np.int32(first), part)].tobytes()] for part, first in zip(parts, _array(row, "before").tolist())]
        columns = [row[name].values for name in ("keys", "ids", "training", "ends")]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([*columns, *(pa.array(x, kind_) for x, kind_ in zip(zip(*rows), types))],
                        [part.split()[0] for part in PIECES.split(", ")])

    return run


def _transitions(pieces: DataFrame, k: int) -> np.ndarray:
    """Counts of class bigrams in training documents; the end is class k, unseen words k + 1."""
    width = k + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for value in batch.column(0):
                kinds = np.frombuffer(value.as_buffer(), np.uint8).astype(np.int64)
                total += np.bincount(kinds[:-1] * width + kinds[1:], minlength=width * width)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], ["cell", "n"])

    found = pieces.filter("training").select("classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(width * width)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(width, width)


def smoothed(counts: np.ndarray, once: int) -> np.ndarray:
    """log10 of P(class | class before), over the number of emissions of the class; ``once``: words seen once."""
    known, unseen = counts.sum(0), max(1, once)
    plain = known / (known.sum() + unseen)
    plain[-1] = unseen / (known.sum() + unseen)
    rows, kinds = counts.sum(1)[:, None], (counts > 0).sum(1)[:, None]
    chance = np.where(rows > 0, (counts + kinds * plain) / np.maximum(rows + kinds, 1), plain)
    emissions = np.where(np.arange(len(known)) < len(known) - 2, np.maximum(known, 1), 1)
    return np.log10(np.maximum(chance, 1e-300)) - np.log10(emissions)


def _scored(pieces: DataFrame, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for value in batch.column("classes"):
                kinds = np.frombuffer(value.as_buffer(), np.uint8)
                sums.append(float(weights[kinds[:-1], kinds[1:]].sum()))
            names = [name for name in batch.schema.names if name != "classes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(sums, pa.float64())],
                                             [*names, "moves"])

    schema = PIECES.replace("classes binary", "moves double")
    return pieces.mapInArrow(run, schema)


def score(documents: DataFrame, is_training: Column, id: str = "doc_id", text: str = "text", classes: int = CLASSES,
          head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: ``id``, ``training``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words one by one,
    each counted once more than seen) and ``score`` (log10 of the text's probability); perplexity is 10^(-score / n_tokens)."""
    with arrow_batches(documents.sparkSession, BATCH):
        portions = coded(documents, is_training, id, text)
        sizes = portions.agg(F.sum(F.size("words") - 1).alias("words"), F.sum(F.col("counts")[0]).alias("ends")).first()
        shards = -(-(sizes["words"] or 0) // SHARD) or 1
        words = vocabulary(portions, shards)
        of = lambda value: F.sum(F.size(F.filter("counts", lambda n: value(n))))
        total = words.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens"),
                          F.sum(F.size("words")).alias("kinds"), of(lambda n: n == 1).alias("once")).first()
        ends = sizes["ends"] or 0
        tokens, kinds = (total["tokens"] or 0) + ends, (total["kinds"] or 0) + (ends > 0)
        frequent, counts = head_words(words, head)
        own, bigrams, _ = exchange(portions, frequent, classes, rounds)
        told = classified(portions, frequent, own, bigrams, shards)
        pieces = stashed(_numbered(portions, frequent).groupBy("portion").cogroup(told.groupBy("portion")).applyInArrow(
            _followed(counts, own, classes, (tokens, kinds, ends)), PIECES), "pieces")
        weights = smoothed(_transitions(pieces, classes), (total["once"] or 0) + (ends == 1)) if ends else np.zeros((classes + 2,) * 2)
    whole = _scored(pieces, weights).groupBy("key").agg(
        F.first("id").alias(id), F.first("training").alias("training"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum(F.col("moves") + F.col("own")).alias("score"))
    return whole.select(id, "training", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
                        "base_score", "score")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(documents, ~held_out).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
