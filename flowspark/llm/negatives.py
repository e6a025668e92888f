"""Hard-negative mining by Fagin's threshold algorithm, exact.

Vectors are scored as integers: a component x counts as floor(256 x), a score is the integer inner product with the anchor.
An anchor's positives are its best rows of the same label. Its hard negatives for one positive are the best rows of other
labels whose score lies in a window below the positive's: ``low`` to ``high`` per cent of it.

Rows are dealt by a hash of their id to shards of some ``SHARD`` rows, anchors to blocks of some ``ANCHORS``; a shard meets
each block once. A shard keeps a sorted list of its rows for every dimension. An anchor reads these lists side by side, from
the top where its own component is positive and from the bottom where it is negative (sorted access, in growing steps), and
scores each row that comes up for the first time (random access). The scores at the places reached, summed over the
dimensions, are the threshold: no unread row scores more. An anchor stops when the threshold is strictly below the last score
that each of its windows keeps, or below a window's lower edge; until then a tie could still come with a smaller id. Each
shard gives its best few per window, and the best of all shards are kept, so a label of any size is spread over its shards.

Cases: rows with a null id or label, or a vector that is null, empty, of another width than the most frequent one, or holds
null or non-finite values take no part; zero vectors do (their scores are 0). Of rows that repeat an id the one with the
least (label, vector) counts. Equal scores go by the smaller id. A positive with a negative score has no negatives, since its
window is empty. Scores beyond 64 bits become the nearest 64-bit number. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stashed, table

SCALE = 256
SHARD = 8192  # rows of a shard, on average
ANCHORS = 2048  # anchors of a block, on average
STEP = 32  # places of each list read in the first step; each step reads twice as many as the one before
RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _score(vectors: np.ndarray, anchor: np.ndarray):
    """Inner products; those of Python integers are held within 64 bits."""
    scores = vectors @ anchor
    return scores if scores.dtype != object else np.clip(scores, -(1 << 63), (1 << 63) - 1)


class Lists:
    """Rows of one shard: their integer vectors and, for each dimension, the rows in order of that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows as they come up, their scores, and the most that any row still unread can score."""
        size = len(self.ids)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        seen, depth, step = np.zeros(size, bool), 0, STEP
        if not len(up) + len(down):
            depth = size
            yield np.arange(size), _score(self.vectors, anchor), -np.inf
        while depth < size:
            end = min(size, depth + step)
            reached = np.zeros(size, bool)
            reached[self.order[depth:end, up].ravel()] = True
            reached[self.order[size - end:size - depth, down].ravel()] = True
            rows = np.flatnonzero(reached & ~seen)
            seen |= reached
            most = -np.inf
            if end < size:
                most = (self.vectors[self.order[end - 1, up], up] @ anchor[up]
                        + self.vectors[self.order[size - end, down], down] @ anchor[down])
            yield rows, _score(self.vectors[rows], anchor), most
            depth, step = end, 2 * step


class Best:
    """The best few rows within a window of scores, ``low <= 100 score <= high``."""

    def __init__(self, most: int, low=None, high=None):
        self.most, self.low, self.high = most, low, high
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (100 * scores >= self.low) & (100 * scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(ids):
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            first = np.lexsort((ids, -scores))[:self.most]
            self.scores, self.ids = scores[first], ids[first]

    def settled(self, most: float) -> bool:
        """Whether no unread row, scoring ``most`` at best, can change what is kept."""
        return (self.low is not None and 100 * most < self.low) or (len(self.ids) == self.most and most < self.scores[-1])


def _vectors(data: pa.Table) -> np.ndarray:
    return data.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(data.num_rows, -1)


def _exact(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where all sums of products are whole numbers that doubles hold (times 100), else as Python integers."""
    largest = [int(np.abs(side.astype(np.float64)).max()) for side in (anchors, rows)]
    kind = np.float64 if 100 * rows.shape[1] * (largest[0] + 1) * (largest[1] + 1) < 1 << 53 else object
    return anchors.astype(kind), rows.astype(kind)


def _long(scores: np.ndarray) -> np.ndarray:
    return np.array([int(score) for score in scores], np.int64)


def _positives(most: int):
    """A block of anchors with one shard of their label: each anchor's best rows there."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        if anchors.num_rows and shard.num_rows:
            asked, held = _exact(_vectors(anchors), _vectors(shard))
            lists = Lists(shard.column("id").to_numpy(), held)
            for id, vector in zip(anchors.column("id").to_pylist(), asked):
                best = Best(most)
                for rows, scores, threshold in lists.read(vector):
                    other = lists.ids[rows] != id
                    best.add(scores[other], lists.ids[rows][other])
                    if best.settled(threshold):
                        break
                for part, values in zip(found, (np.full(len(best.ids), id), best.ids, _long(best.scores))):
                    part.append(values)
        return pa.table([pa.array(np.concatenate(part)) for part in found], schema=schema)

    return run


def _negatives(most: int, low: int, high: int):
    """A block of anchors, each with its positives, and one shard: the best rows of other labels in each window."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()),
                        ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def run(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] for _ in schema]
        if anchors.num_rows and shard.num_rows:
            asked, held = _exact(_vectors(anchors), _vectors(shard))
            lists, labels = Lists(shard.column("id").to_numpy(), held), shard.column("label").to_numpy()
            for row, vector in zip(anchors.select(["id", "label", "positives"]).to_pylist(), asked):
                windows = [(p, Best(most, low * p["score"], high * p["score"])) for p in row["positives"] if p["score"] >= 0]
                open_ = [best for _, best in windows]
                for rows, scores, threshold in lists.read(vector) if open_ else ():
                    rows, scores = (x[labels[rows] != row["label"]] for x in (rows, scores))
                    for best in open_:
                        best.add(scores, lists.ids[rows])
                    open_ = [best for best in open_ if not best.settled(threshold)]
                    if not open_:
                        break
                for positive, best in windows:
                    size = len(best.ids)
                    for part, values in zip(found, (np.full(size, row["id"]), np.full(size, positive["id"]), best.ids,
                                                    np.full(size, positive["score"]), _long(best.scores))):
                        part.append(values)
        return pa.table([pa.array(np.concatenate(part).astype(np.int64)) for part in found], schema=schema)

    return run


def _dealt(count: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), count).cast("int")


def _each(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))


def _needed(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("long")


def _first(df: DataFrame, by: list[str], score: str, id: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``RESULT`` for each anchor and positive: the best rows of other labels scoring low..high per cent of the positive."""
    plain = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                           F.col(vector).cast("array<double>").alias("vector"),
                           F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    whole = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).withColumn(
        "vector", F.transform("vector", lambda x: F.floor(x * SCALE)))
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("row")).select("id", "row.*")
    rows = stashed(one, "vectors")
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.filter(F.size("vector") == width["width"])

    # Shards of the anchor's own label; how many a label has follows its number of rows.
    sizes = rows.groupBy("label").agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).select(
        "label", _needed(F.col("all"), SHARD).alias("shards"), _needed(F.col("asking"), ANCHORS).alias("blocks"))
    sized = rows.join(stashed(sizes, "labels"), "label")
    held = sized.select("id", "label", "vector", _dealt(F.col("shards"), 0).alias("shard"), _each(F.col("blocks")).alias("block"))
    asked = stashed(sized.filter("asks"), "asking").select(
        "id", "label", "vector", _each(F.col("shards")).alias("shard"), _dealt(F.col("blocks"), 1).alias("block"))
    by = ("label", "shard", "block")
    near = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(
        _positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    listed = best.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    anchors = stashed(rows.filter("asks").join(listed, "id").select("id", "label", "vector", "positives"), "anchors")

    count = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    shards, blocks = F.lit(-(-count["all"] // SHARD)), F.lit(max(1, -(-count["asking"] // ANCHORS)))
    held = rows.select("id", "label", "vector", _dealt(shards, 0).alias("shard"), _each(blocks).alias("block"))
    asked = anchors.select("id", "label", "vector", "positives", _each(shards).alias("shard"), _dealt(blocks, 1).alias("block"))
    by = ("shard", "block")
    hard = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(
        _negatives(negatives, low, high),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(*RESULT)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5"""
