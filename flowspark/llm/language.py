"""Language identification by interpolated Kneser-Ney character models, one per language.

Words are runs of letters, lower-cased, between boundaries; a model predicts each letter and the end of each word from up to
``ORDER - 1`` letters before it. Tasks count the longest n-grams of their texts, Spark adds the counts up per language, and
continuation counts, discounts, back-off weights and probabilities follow from that table by groupings and joins. Every
n-gram that was counted stays. The driver sees a few numbers a language only; the models lie in the shared folder, cut by
n-gram into shards of about ``SHARD_BYTES``, and tasks read shards as they need them and keep ``CACHE_BYTES`` of them. A
shard is an array sorted by the hash of the n-gram, with a column per language; a bucket index over the leading bits finds a
hash's place. A text gets the language of lowest cross-entropy per predicted symbol.

Rejection: a tenth of the labelled texts, by a hash of the text, teaches no model. Per language, the 99.9th percentile of
their cross-entropy, widened by ``SLACK``, is the most a text may have; beyond it the text is marked as rejected (it keeps its
nearest language). A language of which no text was held back takes its limit from the texts that it learned from.

Cases: a null text and one without letters is ``und``, score 0, rejected; without labelled rows every text is ``und``; rows
without label teach nothing; repeated rows are judged alike; a text longer than ``PIECE`` characters is cut at non-letters
and worked on piece by piece, so memory stays bounded; other columns pass through, result names are replaced.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from ..sinks.storage import children, open_store
from .common import freed, stashed, table

ORDER = 4
SLACK = 1.25
#: One of so many labelled texts is held back for the limits.
HELD_BACK = 10
#: Characters worked on at a time.
PIECE = 1 << 18
#: N-grams a task holds before it adds them up.
HELD = 1 << 20
#: Size of one shard of the models, and of the shards that a Python process keeps.
SHARD_BYTES = 8 << 20
CACHE_BYTES = 64 << 20
#: Portions whose n-grams are looked up together where the models are larger than what is kept.
TOGETHER = 16
#: Symbols' worth of evidence that the score counts; beyond it texts of any length would all score 0 or 1.
EVIDENCE = 24.0
UNKNOWN = "und"
BACK = 10
RESULTS = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "rejected": T.BooleanType()}

_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Code point -> 16-bit symbol: 0 for what is no letter, else the lower-case letter."""
    if not _symbols:
        made = np.zeros(0x110000, np.uint16)
        for point in range(0x110000):
            letter = chr(point)
            if letter.isalpha():
                lower = letter.lower()
                low = ord(lower) if len(lower) == 1 else point
                made[point] = low if low < 0x10000 else 0xE000 + low % 0x1900  # rare planes share the private area
        _symbols.append(made)
    return _symbols[0]


def _cut(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut at a non-letter if there is one in the last thousand characters."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        back = next((k for k in range(end, end - 1000, -1) if not text[k - 1].isalpha()), end)
        yield text[at:back]
        at = back
    yield text[at:]


def _portions(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Pieces of all texts with the texts' numbers, in portions of about ``PIECE`` characters."""
    portion, size = [], 0
    for number, text in enumerate(texts):
        for piece in _cut(text):
            portion.append((number, piece))
            size += len(piece)
            if size >= PIECE:
                yield portion
                portion, size = [], 0
    if portion:
        yield portion


def _behind(codes: np.ndarray, steps: int) -> np.ndarray:
    """Each place's symbol ``steps`` before, 0 where there is none."""
    moved = np.zeros_like(codes)
    moved[steps:] = codes[:max(0, len(codes) - steps)]
    return moved


def _grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of length ``ORDER`` of all pieces, oldest symbol highest, and where each piece's begin."""
    points = np.frombuffer("\n".join(["", *pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(piece) + 1 for piece in pieces), np.int64, len(pieces))
    codes = _symbol_table()[points].astype(np.uint64)
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    starts = np.cumsum(kept)[np.concatenate(([0], np.cumsum(lengths)[:-1]))]  # the first symbol is a boundary and not predicted
    codes = codes[kept]
    key, inside = codes.copy(), np.ones(len(codes), bool)
    for back in range(1, ORDER):
        before = _behind(codes, back)
        key |= np.where(inside, before, np.uint64(0)) << np.uint64(16 * back)
        inside &= before != 0  # what lies beyond a boundary is not seen
    return key[1:], np.minimum(starts - 1, max(0, len(key) - 2))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash without collisions (every step can be undone)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values = values ^ (values >> np.uint64(29))
    return values * np.uint64(0xBF58476D1CE4E5B9)


class Sorted:
    """Rows of numbers in the order of their keys' hashes."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        hashes = mixed(keys.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 1))
        self.first = np.searchsorted(self.hashes, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        ends = np.append(self.first[1:], len(keys))
        self.depth = int((ends - self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that aren't there."""
        hashes, found = mixed(keys), np.full(len(keys), -1, np.int64)
        if not self.depth:
            return found
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        last = len(self.hashes) - 1
        for step in range(self.depth):
            place = np.minimum(at + step, last)
            found = np.where(self.hashes[place] == hashes, place, found)
        return found

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the rows of these."""
        at = self.find(keys)
        return at >= 0, self.rows[at[at >= 0]]


class Kept:
    """Shards that a process has read, the least recently used ones given up beyond ``CACHE_BYTES``."""

    def __init__(self):
        self.held: OrderedDict[tuple[int, int], Sorted] = OrderedDict()

    def get(self, path: str, kind: int, shard: int) -> Sorted:
        if (kind, shard) in self.held:
            self.held.move_to_end((kind, shard))
        else:
            found = _read_shard(path, kind, shard)
            size = lambda x: x.hashes.nbytes + x.rows.nbytes + x.first.nbytes
            while self.held and sum(map(size, self.held.values())) + size(found) > CACHE_BYTES:
                self.held.popitem(last=False)
            self.held[kind, shard] = found
        return self.held[kind, shard]


def _read_shard(path: str, kind: int, shard: int) -> Sorted:
    store, root = open_store(path)
    folder = f"{root}/kind={kind}/shard={shard}"
    parts = [pq.ParquetFile(store.open_input_file(f"{folder}/{name}")).read() for name in children(store, folder)
             if name.endswith(".parquet")]
    if not parts:
        return Sorted(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    found = pa.concat_tables(parts)
    keys = found.column("gram").to_numpy().view(np.uint64)
    values = found.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return Sorted(keys, values.reshape(len(keys), -1))


@dataclass
class Sharded:
    """One table of the models in the shared folder, with the interface of ``Sorted``."""

    path: str
    kind: int
    shards: int
    width: int
    kept: Kept

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.shards == 1:
            part = self.kept.get(self.path, self.kind, 0)
            return part.get(keys) if part.depth else (np.zeros(len(keys), bool), np.zeros((0, self.width), np.float32))
        hit, rows = np.zeros(len(keys), bool), np.zeros((len(keys), self.width), np.float32)
        shards = keys.view(np.int64) % self.shards
        order = np.argsort(shards, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(keys) else []:
            part = self.kept.get(self.path, self.kind, int(shards[own[0]]))
            if part.depth:
                there, values = part.get(keys[own])
                hit[own] = there
                rows[own[there]] = values
        return hit, rows[hit]


@dataclass
class Models:
    """Log probabilities of n-grams by order and log back-off weights of contexts, a column for each language."""

    languages: list[str]
    grams: list[Sorted | Sharded]
    backoffs: list[Sorted | Sharded]
    floor: np.ndarray
    limits: dict[str, float]
    together: int = 1

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each packed n-gram's last symbol in each language."""
        total = np.zeros((len(keys), len(self.languages)), np.float32)
        open_, rest = np.arange(len(keys)), keys
        for order in range(ORDER, 0, -1):
            hit, rows = self.grams[order - 1].get(rest & _low(order))
            total[open_[hit]] += rows
            open_, rest = open_[~hit], rest[~hit]
            if not len(open_):
                return total
            if order > 1:
                hit, rows = self.backoffs[order - 2].get((rest & _low(order)) >> np.uint64(16))
                total[open_[hit]] += rows
        total[open_] += self.floor
        return total


def _low(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, values, len(unique))


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models in memory from each language's packed n-grams of full length and their counts; ``train`` makes the same of tables."""
    languages = sorted(counts)
    adjusted = []  # by language: by order: keys and adjusted counts
    for name in languages:
        keys, numbers = counts[name]
        keys, numbers = keys.astype(np.uint64), numbers.astype(np.float64)
        orders, raw = [(keys, numbers)], (keys, numbers)
        for order in range(ORDER - 1, 0, -1):
            kinds = _sums(orders[-1][0] & _low(order), np.ones(len(orders[-1][0])))
            raw = _sums(raw[0] & _low(order), raw[1])
            # What begins at a boundary has nothing before it to vary: its plain count stands.
            at_start = (kinds[0] >> np.uint64(16 * (order - 1))) == 0 if order > 1 else np.zeros(len(kinds[0]), bool)
            orders.append((kinds[0], np.where(at_start, raw[1], kinds[1])))
        adjusted.append(orders[::-1])
    size = len(np.unique(np.concatenate([orders[0][0] for orders in adjusted]))) + 1
    grams, backoffs, below = [], [], None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([orders[order - 1][0] for orders in adjusted]))
        contexts = np.unique(union >> np.uint64(16))
        chance = np.zeros((len(union), len(languages)))
        weight = np.ones((len(contexts), len(languages)))
        for column, orders in enumerate(adjusted):
            keys, numbers = orders[order - 1]
            once, twice = (numbers == 1).sum(), (numbers == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            own, totals = _sums(keys >> np.uint64(16), numbers)
            _, kinds = _sums(keys >> np.uint64(16), np.minimum(numbers, discount))
            place = np.searchsorted(own, keys >> np.uint64(16))
            chance[np.searchsorted(union, keys), column] = np.maximum(numbers - discount, 0) / totals[place]
            weight[np.searchsorted(contexts, own), column] = kinds / totals
        spread = weight[np.searchsorted(contexts, union >> np.uint64(16))]
        if order == 1:
            floor = weight[0] / size
            chance = chance + spread / size
        else:
            chance = chance + spread * below[1][np.searchsorted(below[0], union & _low(order - 1))]
            backoffs.append(Sorted(contexts, np.log(weight).astype(np.float32)))
        below = (union, chance)
        grams.append(Sorted(union, np.log(chance).astype(np.float32)))
    return Models(languages, grams, backoffs, np.log(floor).astype(np.float32), {})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's n-grams by language; input (lang, text)."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(name: str) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = (np.concatenate(x) for x in zip(*held[name]))
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, np.bincount(inverse, numbers, len(unique)).astype(np.int64)

    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name in set(names):
            own = [text for text, other in zip(texts, names) if other == name]
            for portion in _portions(own):
                keys, _ = _grams([piece for _, piece in portion])
                if len(keys):
                    held.setdefault(name, []).append(np.unique(keys, return_counts=True))
                if sum(len(keys) for keys, _ in held.get(name, [])) > HELD:
                    held[name] = [merged(name)]
    for name in held:
        keys, numbers = merged(name)
        for at in range(0, len(keys), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(numbers[part])],
                ["lang", "gram", "n"])


def _levels(counts: DataFrame) -> DataFrame:
    """``order``, ``lang``, ``gram`` and its adjusted count ``n`` for every order; ``counts`` has the longest n-grams."""
    level = counts.select("lang", "gram", F.col("n").alias("raw"), "n")
    levels = level.select(F.lit(ORDER).alias("order"), "lang", "gram", "n")
    for order in range(ORDER - 1, 0, -1):
        shorter = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_low(order)))).alias("gram")).agg(
            F.sum("raw").alias("raw"), F.count("*").alias("kinds"))
        # What begins at a boundary has nothing before it to vary: its plain count stands.
        at_start = F.shiftrightunsigned("gram", 16 * (order - 1)) == 0 if order > 1 else F.lit(False)
        level = stashed(shorter.select("lang", "gram", "raw", F.when(at_start, F.col("raw")).otherwise(F.col("kinds")).alias("n")),
                        "language-level")
        levels = levels.unionByName(level.select(F.lit(order).alias("order"), "lang", "gram", "n"))
    return levels


def _by_language(df: DataFrame, keys: list[str], value: str, languages: list[str], missing: float) -> DataFrame:
    """A row for each of ``keys`` with an array of the values of all languages."""
    of = F.map_from_entries(F.collect_list(F.struct("lang", value)))
    return df.groupBy(*keys).agg(of.alias("of")).select(*keys, F.transform(
        F.array(*map(F.lit, languages)), lambda name: F.coalesce(F.try_element_at("of", name), F.lit(missing))).alias(value))


def _shards(size: int) -> int:
    """How many shards hold ``size`` bytes: 1 or a prime that mixes all four symbols of an n-gram."""
    shards = -(-size // SHARD_BYTES)
    if shards <= 1:
        return 1
    while shards in (2, 3, 5, 17, 257) or any(shards % k == 0 for k in range(2, int(shards ** 0.5) + 1)):
        shards += 1
    return shards


def _fitted(counts: DataFrame) -> Models | None:
    """Models of all counted n-grams, in the shared folder; None if there are no counts."""
    spark = counts.sparkSession
    languages = sorted(row["lang"] for row in counts.select("lang").distinct().collect())
    if not languages:
        return None
    levels = _levels(counts)
    times = lambda n: F.sum((F.col("n") == n).cast("long"))
    discounts = levels.groupBy("order", "lang").agg(times(1).alias("once"), times(2).alias("twice")).select(
        "order", "lang", F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice")))
        .otherwise(0.5).alias("discount"))
    discounts = stashed(discounts, "language-discounts")
    known = levels.join(discounts, ["order", "lang"]).withColumn("context", F.shiftrightunsigned("gram", 16))
    contexts = stashed(known.groupBy("order", "lang", "context").agg(
        F.sum("n").alias("total"), (F.count("*") * F.first("discount")).alias("taken")), "language-contexts")
    own = known.join(contexts.select("order", "lang", "context", "total"), ["order", "lang", "context"]).withColumn(
        "own", F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total"))
    own = stashed(_by_language(own, ["order", "gram"], "own", languages, 0.0), "language-own")
    weights = contexts.withColumn("weight", F.col("taken") / F.col("total"))
    weights = stashed(_by_language(weights, ["order", "context"], "weight", languages, 1.0), "language-weights")

    size = own.filter("order = 1").count() + 1
    first = np.array(weights.filter("order = 1").first()["weight"])
    floor = F.array(*[F.lit(float(x) / size) for x in first])
    below = stashed(own.filter("order = 1").select("gram", F.zip_with("own", floor, lambda a, b: a + b).alias("chance")),
                    "language-chances")
    chances = [below]
    for order in range(2, ORDER + 1):
        longer = own.filter(F.col("order") == order).select(
            "gram", "own", F.shiftrightunsigned("gram", 16).alias("context"),
            F.col("gram").bitwiseAND(F.lit(int(_low(order - 1)))).alias("shorter"))
        spread = longer.join(weights.filter(F.col("order") == order).select("context", "weight"), "context").join(
            below.select(F.col("gram").alias("shorter"), "chance"), "shorter")
        rest = F.zip_with("weight", "chance", lambda a, b: a * b)
        below = stashed(spread.select("gram", F.zip_with("own", rest, lambda a, b: a + b).alias("chance")), "language-chances")
        chances.append(below)

    # Kinds: an order's probabilities, and BACK plus the order for the weights of its contexts.
    logs = lambda name: F.transform(name, lambda x: F.log(x).cast("float")).alias("logs")
    tables = {order: df.select(F.lit(order).alias("kind"), "gram", logs("chance")) for order, df in enumerate(chances, 1)}
    tables |= {BACK + order: weights.filter(F.col("order") == order).select(
        F.lit(BACK + order).alias("kind"), F.col("context").alias("gram"), logs("weight")) for order in range(2, ORDER + 1)}
    rows = {row["kind"]: row["count"] for row in _union(tables.values()).groupBy("kind").count().collect()}
    sizes = {kind: rows.get(kind, 0) * (24 + 4 * len(languages)) for kind in tables}
    shards = {kind: _shards(size) for kind, size in sizes.items()}
    path = shared_dir(spark, "language-models")
    _union(df.withColumn("shard", F.pmod("gram", F.lit(shards[kind])).cast("int")) for kind, df in tables.items()).repartition(
        "kind", "shard").write.mode("overwrite").partitionBy("kind", "shard").parquet(path)
    kept = Kept()
    stored = {kind: Sharded(path, kind, shards[kind], len(languages), kept) for kind in tables}
    return Models(languages, [stored[order] for order in range(1, ORDER + 1)],
                  [stored[BACK + order] for order in range(2, ORDER + 1)], np.log(first / size).astype(np.float32), {},
                  1 if sum(sizes.values()) <= CACHE_BYTES else TOGETHER)


def _union(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Models | None:
    """Models of all languages of the labelled rows; None if there are none."""
    pairs = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    held = F.pmod(F.xxhash64(F.lit("limits"), "text"), F.lit(HELD_BACK)) == 0
    models = _taught(pairs.filter(~held))
    if models is None:
        held, models = F.lit(False), _taught(pairs)
    if models is None:
        return None
    models.limits = _limits(pairs.filter(held), models)
    missing = [name for name in models.languages if name not in models.limits]
    if missing:
        models.limits |= _limits(pairs.filter(~held & F.col("lang").isin(missing)), models)
    return models


def _taught(pairs: DataFrame) -> Models | None:
    counts = (pairs.mapInArrow(freed(_counted), "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return _fitted(stashed(counts, "language-counts"))


def _limits(pairs: DataFrame, models: Models) -> dict[str, float]:
    scored = identify(pairs, models).filter("lang = lang_pred")
    limits = scored.groupBy("lang").agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("most")).collect()
    return {row["lang"]: row["most"] * SLACK for row in limits}


def identify(df: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score``, ``cross_entropy`` (nats a symbol) and ``rejected``."""
    kept = [name for name in df.columns if name not in RESULTS]
    if models is None:
        return df.select(*[F.col(f"`{name}`") for name in kept], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    # Where the shards are, not what they hold. Pickled like code, by value: a worker need not have this package.
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(k, v) for k, v in RESULTS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A process has one broadcast object for all its tasks, and with it one set of models and of shards read.
        if not hasattr(sent, "models"):
            sent.models = cloudpickle.loads(sent.value)
        models = sent.models
        names, limits = models.languages, models.limits
        for batch in batches:
            texts = [value or "" for value in batch.column(text).to_pylist()]
            totals, symbols = np.zeros((len(texts), len(names))), np.zeros(len(texts), np.int64)
            portions = _portions(texts)
            while several := list(islice(portions, models.together)):
                cut = [(np.array([number for number, _ in portion]), *_grams([piece for _, piece in portion]))
                       for portion in several]
                distinct = np.unique(np.concatenate([np.unique(keys) for _, keys, _ in cut]))
                values = models.score(distinct)
                for numbers, keys, starts in cut:
                    if not len(keys):
                        continue
                    sizes = np.diff(np.append(starts, len(keys)))
                    full = sizes > 0
                    scores = values[np.searchsorted(distinct, keys)].astype(np.float64)
                    np.add.at(totals, numbers[full], np.add.reduceat(scores, starts[full], axis=0))
                    letters = np.add.reduceat(((keys & np.uint64(0xFFFF)) != 0).astype(np.int64), starts[full])
                    np.add.at(symbols, numbers[full], np.where(letters > 0, sizes[full], 0))
            entropy = -totals / np.maximum(symbols, 1)[:, None]
            best, seen = entropy.argmin(axis=1), symbols > 0
            lowest = entropy[np.arange(len(texts)), best]
            weight = np.minimum(symbols, EVIDENCE)[:, None]
            score = 1 / np.exp(np.minimum((lowest[:, None] - entropy) * weight, 0)).sum(axis=1)
            most = np.array([limits.get(name, np.inf) for name in names])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(name) for name in kept),
                pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, seen)], pa.string()),
                pa.array(np.where(seen, score, 0.0)), pa.array(lowest, mask=~seen),
                pa.array(~seen | (lowest > most[best]))], [*kept, *RESULTS])

    return df.mapInArrow(freed(run), schema)


def held_out(id: Column) -> Column:
    """A fifth of the rows, by the checksum of their id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = train(documents.filter(~held_out(F.col("doc_id"))))
    found = identify(documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
