"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of at least ``PERCENT``.

1. *Shared shingles.* A shingle of one document only can be in no intersection. Tasks hash the shingles of their documents;
   those found twice in a portion are known to be shared, the others go to the task of their hash segment, which sees all
   documents that have them. What comes back per document are its shared shingles; a document with fewer than ``PERCENT`` of
   its shingles shared can have no link and is done. This is the rarest-first order of a prefix join, its first step exact.
2. *Classes and groups.* Documents of equal sets form a class; classes of equal size and equal prefix form a group. A prefix
   are the first ``n - ceil(PERCENT n) + 1`` shingles: unshared ones first, then rare, then frequent ones.
3. *Group pairs* of one bucket (shingle) are filtered by size and by the positions of the shingle, then expanded to members
   and verified. First every group is paired with its bucket's hub only (the group with the most shared shingles), which
   joins groups of near copies of any size by a number of pairs in proportion to their postings. While members of a bucket
   in different components make many pairs, further rounds pair each with one member of another component. Then all pairs
   that are left follow. So no link between components is lost, and pairs inside a component, which could change nothing,
   are not built.

Shingles are 64-bit hashes at any number of partitions. A set of at most ``FEW`` shingles also has a digest of its words of
another 64 bits, and equals another set only if both agree: a single wrong shingle would be enough there.

The frequent shingles, at most ``FREQUENT`` of them, are broadcast to order the prefixes; any order is right, a good one is
faster. Tasks hold one segment of the shingles or one block of documents; how many of them there are follows the size of the
table. Cases: a null or blank text has an empty set and no link; a very long text is hashed alone, in one task; rows with a
null id have null results; rows that repeat an id are one document and must repeat its text; empty tables give no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, parts_of, stashed, table
from .components import components
from .shingles import WORDS, mixed, sets

PERCENT = 75
#: Documents, and distinct shingles, that a task compares among themselves before it asks the segments.
PORTION, PORTION_SHINGLES = 1024, 1 << 19
FREQUENT = 1 << 20
FREQUENT_FROM = 16
#: Shingles of a set that is compared by a digest of its words too.
FEW = 4
#: Bytes of the table for each segment and block, about.
GROUP_BYTES = 8 << 20
#: Open pairs for each posting, above which another round of hubs comes before all of them are built.
CROSSING = 256
PARTS = "key int, ids array<long>, sizes array<int>, counts array<int>, marks array<long>, tokens array<long>"


def _row(key: int, ids=(), sizes=(), counts=(), marks=(), tokens=()) -> dict:
    return {"key": key, "ids": ids, "sizes": sizes, "counts": counts, "marks": marks, "tokens": tokens}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"ids": (pa.int64(), np.int64), "sizes": (pa.int32(), np.int32), "counts": (pa.int32(), np.int32),
             "marks": (pa.int64(), np.int64), "tokens": (pa.int64(), np.int64)}
    columns = [pa.array([row["key"] for row in rows], pa.int32())]
    for name, (kind, plain) in kinds.items():
        lists = [np.asarray(row[name], plain) for row in rows]
        offsets = np.concatenate(([0], np.cumsum([len(values) for values in lists]))).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), kind)))
    return pa.RecordBatch.from_arrays(columns, ["key", *kinds])


def _flat(data: pa.Table, name: str) -> np.ndarray:
    return data.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _blocked(ids: np.ndarray, tokens: np.ndarray, blocks: int) -> Iterator[dict]:
    """Rows by block of documents, from tokens that stand document by document."""
    change = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    own, counts = ids[change], np.diff(np.append(change, len(ids)))
    block = (mixed(own.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
    for number in np.unique(block):
        of = block == number
        yield _row(int(number), ids=own[of], counts=counts[of], tokens=tokens[np.repeat(of, counts)])


def _digest(text: str | None) -> int:
    """64 more bits of the set of a text's shingles, from the words themselves."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = {b" ".join(words[k:k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))}
    return xxhash.xxh3_64_intdigest(b"\n".join(sorted(shingles))) >> 1


def _portions(batches: Iterator[pa.RecordBatch]):
    """(ids, sizes, digests, tokens, the token's document) of some documents; tokens are hashes of shingles."""
    ids, found, digests, size = [], [], [], 0

    def made():
        lengths = np.array([len(tokens) for tokens in found], np.int64)
        return (np.array(ids, np.int64), lengths, np.array(digests, np.int64), np.concatenate(found),
                np.repeat(np.arange(len(ids)), lengths))

    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for number, tokens in sets(texts):
            ids.append(own[number])
            found.append(tokens)
            digests.append(_digest(texts[number]) if len(tokens) <= FEW else 0)
            size += len(tokens)
            if len(ids) >= PORTION or size >= PORTION_SHINGLES:
                yield made()
                ids, found, digests, size = [], [], [], 0
    if ids:
        yield made()


def _known_shared(blocks: int):
    """Per block: all documents with their sizes and digests, and the shingles that are in two documents of a portion."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, digests, tokens, of in _portions(batches):
            _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            rows = list(_blocked(ids[of[twice]], tokens[twice].view(np.int64), blocks))
            block = (mixed(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            rows += [_row(int(k), ids=ids[block == k], sizes=sizes[block == k], tokens=digests[block == k])
                     for k in np.unique(block)]
            yield _batch(rows)
    return run


def _asked(segments_log: int):
    """Per segment: the shingles that are in one document of a portion only, and marks of those that are in more."""
    shift = np.uint64(64 - segments_log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, tokens, of in _portions(batches):
            unique, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            once = counts[inverse] == 1
            single, owner, marked = tokens[once], of[once], unique[counts > 1]
            segment = (single >> shift).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            single, owner, segment = single[order].view(np.int64), owner[order], segment[order]
            bounds = np.searchsorted(segment, np.arange((1 << segments_log) + 1))
            marks = np.searchsorted((marked >> shift).astype(np.int64), np.arange((1 << segments_log) + 1))
            marked = marked.view(np.int64)
            rows = []
            for k in range(1 << segments_log):
                part = slice(bounds[k], bounds[k + 1])
                docs, sizes = np.unique(owner[part], return_counts=True)
                if len(docs) or marks[k] < marks[k + 1]:
                    rows.append(_row(k, ids=ids[docs], counts=sizes, tokens=single[part], marks=marked[marks[k]:marks[k + 1]]))
            for at in range(0, len(rows), 256):
                yield _batch(rows[at:at + 256])
    return run


def _answered(blocks: int):
    """One segment: the shingles of two documents or more, by block of documents."""
    def run(data: pa.Table) -> pa.Table:
        tokens, marks = _flat(data, "tokens"), _flat(data, "marks")
        ids = np.repeat(_flat(data, "ids"), _flat(data, "counts"))
        unique, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = ((counts > 1) | np.isin(unique, marks))[inverse]
        ids, tokens = ids[shared], tokens[shared]
        order = np.argsort(ids, kind="stable")
        rows = list(_blocked(ids[order], tokens[order], blocks))
        return pa.Table.from_batches([_batch(rows or [_row(0)])])
    return run


def _least(n, percent: int):
    """Fewest shingles that a partner of a set of ``n`` must share with it."""
    return -(-percent * n // 100)


def _gathered(percent: int):
    """One block: id, size, digest and shared shingles of its documents; no shingles where they can't be enough."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("digest", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(data: pa.Table) -> pa.Table:
        sized = pa.compute.list_value_length(data.column("sizes"))
        heads = data.filter(pa.compute.greater(sized, 0))
        rest = data.filter(pa.compute.equal(sized, 0))
        ids, at = np.unique(_flat(heads, "ids"), return_index=True)
        sizes, digests = _flat(heads, "sizes")[at], _flat(heads, "tokens")[at]
        owner = np.repeat(_flat(rest, "ids"), _flat(rest, "counts"))
        tokens = _flat(rest, "tokens")
        order = np.lexsort((tokens, owner))
        owner, tokens = owner[order], tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
        owner, tokens = owner[new], tokens[new]
        first, last = np.searchsorted(owner, ids), np.searchsorted(owner, ids, side="right")
        lists = [tokens[a:b] if n and b - a >= _least(n, percent) else tokens[:0] for a, b, n in zip(first, last, sizes)]
        return pa.table([pa.array(ids), pa.array(sizes, pa.int32()), pa.array(digests), pa.array(lists, pa.list_(pa.int64()))],
                        schema=schema)

    return run


def shared_shingles(documents: DataFrame, id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """``id``, ``n`` (size of the set), ``digest`` and ``tokens`` (its shared shingles, or none where no link is possible)."""
    # Segments and blocks follow the size of the table, and the partitions that the cluster is set to shuffle into.
    groups = parts_of(documents, GROUP_BYTES)
    log, blocks = min(24, max(4, (2 * groups - 1).bit_length())), max(16, groups)
    pairs = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    known = pairs.mapInArrow(freed(_known_shared(blocks)), PARTS)
    answers = pairs.mapInArrow(freed(_asked(log)), PARTS).groupBy("key").applyInArrow(_answered(blocks), PARTS)
    return known.unionByName(answers).groupBy("key").applyInArrow(
        _gathered(percent), "id long, n int, digest long, tokens array<long>")


def frequent_shingles(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, at most ``FREQUENT``. Tasks report what they see twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            twice = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(tokens[twice]), pa.array(counts[twice])], ["token", "n"])

    counts = classes.select("tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = stashed(counts.filter(F.col("n") >= FREQUENT_FROM), "frequent")
    sizes = {row["log"]: row["count"] for row in
             often.groupBy(F.floor(F.log2("n")).cast("int").alias("log")).count().collect()}
    most, total = 0, 0
    for log in sorted(sizes, reverse=True):
        total += sizes[log]
        if total > FREQUENT:
            most = log + 1
            break
    found = often.filter(F.col("n") >= (1 << most)).select("token", "n").toArrow()
    tokens, numbers = (found.column(name).to_numpy() for name in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], numbers[order]


def prefixes(classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> DataFrame:
    """``class``, ``n``, ``alone`` (unshared shingles, the head of the order) and the rest of the prefix."""
    sent = classes.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, numbers = sent.value
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            lists, alone = [], []
            for n, tokens in zip(sizes.tolist(), batch.column("tokens")):
                tokens = tokens.values.to_numpy(zero_copy_only=False)
                rank = np.zeros(len(tokens), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    rank = np.where(often[at] == tokens, numbers[at], 0)
                alone.append(n - len(tokens))
                lists.append(tokens[np.lexsort((tokens, rank))][:n - _least(n, percent) + 1 - alone[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("n"), pa.array(alone, pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
                ["class", "n", "alone", "prefix"])

    return classes.select("class", "n", "tokens").mapInArrow(run, "class long, n int, alone int, prefix array<long>")


def _may_link(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Size and position filters: what stands from the common shingle on must suffice on both sides."""
    least = F.ceil((n1 + n2) * percent / (100.0 + percent) - 1e-6)
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (n1 - at1 >= least) & (n2 - at2 >= least))


def verified(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, by their whole sets."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    known = classes.join(involved, "class").select("class", "n", "tokens")
    side = lambda name: known.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"),
                                     F.col("tokens").alias(f"tokens_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn(
        "common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    # Small sets with equal hashes that are of different classes have different words.
    unlike = (F.col("n_a") <= FEW) & (F.col("n_a") == F.col("common")) & (F.col("n_b") == F.col("common"))
    return both.filter(~unlike & (100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))).select("a", "b")


def _crossing(candidates: DataFrame, classes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links so far and those between candidates of one bucket that are still in different components.

    As long as buckets hold many such pairs, each candidate is compared with one of another component in its bucket, chosen
    anew each time, and components are joined up. When that joins nothing more, or few pairs are left, all of these follow.
    """
    tried = 0
    while True:
        near = components(links)
        rooted = candidates.join(near.withColumnRenamed("node", "member"), "member", "left").select(
            "token", "member", "n", "at", F.coalesce("root", "member").alias("root"))
        open_ = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        rest = stashed(rooted.join(open_.select("token"), "token"), f"open-postings-{tried}")
        of_root = rest.groupBy("token", "root").agg(F.count("*").alias("own"))
        sizes = of_root.groupBy("token").agg(F.sum("own").alias("all"), F.sum(F.col("own") * F.col("own")).alias("same")).agg(
            F.sum("all").alias("all"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs")).first()
        if (sizes["pairs"] or 0) <= CROSSING * (sizes["all"] or 0):
            break
        order = F.xxhash64(F.lit(tried), "root")
        hubs = rest.groupBy("token").agg(F.min_by(F.struct("member", "n", "at", "root"), order).alias("low"),
                                         F.max_by(F.struct("member", "n", "at", "root"), order).alias("high"))
        met = rest.join(hubs, "token").withColumn(
            "hub", F.when(F.col("root") == F.col("low.root"), F.col("high")).otherwise(F.col("low"))).filter(
            F.col("root") != F.col("hub.root"))
        met = met.filter(_may_link(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), percent))
        pairs = met.select(F.least("member", "hub.member").alias("a"), F.greatest("member", "hub.member").alias("b")).distinct()
        more = stashed(verified(stashed(pairs, f"hub-pairs-{tried}"), classes, percent), f"hub-links-{tried}")
        tried += 1
        if more.isEmpty():
            break
        links = links.unionByName(more)
    left, right = rest.alias("x"), rest.alias("y")
    crossing = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & _may_link(
        F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent))
    last = crossing.select(F.col("x.member").alias("a"), F.col("y.member").alias("b")).distinct()
    return links.unionByName(verified(stashed(last, "pairs"), classes, percent))


def link(documents: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` for every row: the smallest id reachable by links."""
    known = stashed(shared_shingles(documents, id, text, percent), "shared-shingles")
    # Equal sets are shared whole; a set with shingles of its own is equal to no other.
    set_of = F.when(F.size("tokens") == F.col("n"), F.xxhash64("tokens")).when(
        F.size("tokens") > 0, F.xxhash64("tokens", "id"))
    hashed = known.filter(F.size("tokens") > 0).withColumn("set", set_of)
    classes = stashed(hashed.groupBy("n", "set", "digest").agg(F.min("id").alias("class"), F.first("tokens").alias("tokens")), "classes")
    heads = prefixes(classes, frequent_shingles(classes), percent)
    grouped = stashed(heads.withColumn("key", F.xxhash64("prefix")).withColumnRenamed("class", "member"), "prefixes")
    groups = grouped.groupBy("n", "alone", "key").agg(F.min("member").alias("group"), F.first("prefix").alias("prefix"))
    members = grouped.select("n", "alone", "key", "member").join(
        groups.select("n", "alone", "key", "group"), ["n", "alone", "key"]).select("group", "member")
    postings = stashed(groups.select("group", "n", "alone", F.posexplode("prefix").alias("place", "token")).select(
        "token", "group", "n", "alone", (F.col("alone") + F.col("place")).alias("at")), "postings")
    members = stashed(members, "members")

    buckets = postings.groupBy("token").agg(
        F.min(F.struct("alone", "group", "n", "at")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    with_hub = postings.join(buckets, "token").filter(F.col("group") != F.col("hub.group"))
    likely = with_hub.filter(_may_link(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), percent))
    pairs = likely.select(F.least("group", "hub.group").alias("g"), F.greatest("group", "hub.group").alias("h")).distinct()
    expanded = (pairs.join(members.select(F.col("group").alias("g"), F.col("member").alias("a")), "g")
                .join(members.select(F.col("group").alias("h"), F.col("member").alias("b")), "h").select("a", "b"))
    links = stashed(verified(stashed(expanded, "hub-pairs"), classes, percent), "hub-links")

    links = _crossing(postings.join(members, "group").select("token", "member", "n", "at"), classes, links, percent)

    roots = components(links).withColumnRenamed("node", "class")
    of_class = classes.select("n", "set", "digest", "class").join(roots, "class", "left").select(
        "n", "set", "digest", F.coalesce("root", "class").alias("component_id"))
    results = known.select("id", "n", "digest", set_of.alias("set")).join(
        of_class, ["n", "set", "digest"], "left").select("id", F.col("n").cast("long").alias("n_shingles"),
                                               F.coalesce("component_id", "id").alias("component_id"))
    rows = documents.select(F.col(id).alias("__row"))
    return rows.join(results, F.col("__row") == F.col("id"), "left").select(
        F.col("__row").alias(id), "n_shingles", "component_id")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


SQL = r"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
          ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM worded),
    sizes AS (SELECT doc_id, count(s) AS n FROM worded LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b
               ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
              WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach(node, seen) AS (SELECT doc_id, doc_id FROM worded
                          UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a)
    SELECT sizes.doc_id, n AS n_shingles, (SELECT min(seen) FROM reach WHERE node = sizes.doc_id) AS component_id FROM sizes"""
