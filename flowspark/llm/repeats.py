"""Removal of repeated substrings: every byte in a string of ``LENGTH`` bytes that also starts anywhere else goes.

A suffix array over all bytes would sort every position several times. Here positions are ranked at growing lengths, and only
those whose rank another position shares go on:

1. ``GRAM`` bytes: every window of LENGTH bytes has one anchor, the position in it with the least name of GRAM bytes, about
   1.5 % of all positions. Windows can only be equal if their anchors' names are. Anchors of a unique name are done.
2. The stretch of all windows that belong to one anchor: where all anchors of a name have the same stretch, or a stretch
   occurs twice, all its windows are repeated.
3. Prefix doubling of the windows that are left (about 2 % of all positions, one document for each distinct stretch): their
   ranks at half the length, at their start and half a length on, are paired, and pairs that occur twice are ranks of
   repeated windows.

Names are 64-bit hashes and take the place of dense ranks, so a round is a grouping by name, combined before the shuffle, and
a join that splits large names. Cases: a null text is an empty one; texts shorter than LENGTH keep all; a row that is there
twice repeats itself; rows are told apart by id and text, so ids may be null or repeated; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import PLACES, Buffer
from .common import stashed, table
from .shingles import mixed

LENGTH = 400
GRAM = 256
#: Bytes worked on at a time. A longer text is worked on in pieces that overlap by what an anchor depends on.
AT_ONCE = 1 << 18


def _buffers(texts: list[str | None], length: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(rows, pieces, a piece's place in its text) in portions of bounded size.

    A piece holds enough bytes for the windows that start in its first ``step`` bytes; the next piece begins there.
    """
    rows, pieces, places, size = [], [], [], 0
    step = (1 << (PLACES - 1)) - 2 * length  # so that a portion fits in PLACES bits
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data)), step):
            piece = data[at:at + step + length - 1] if len(data) > step else data
            rows.append(row)
            pieces.append(piece)
            places.append(at)
            size += len(piece)
            if size >= AT_ONCE:
                yield rows, pieces, places
                rows, pieces, places, size = [], [], [], 0
    if rows:
        yield rows, pieces, places


def _sampled(length: int, gram: int) -> Callable:
    """(name, stretch, doc, first, last) of every anchor; input (doc, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for rows, pieces, places in _buffers(batch.column(1).to_pylist(), length):
                buffer = Buffer(pieces)
                anchor, first, last = buffer.anchors(length, gram)
                of = np.searchsorted(buffer.ends, anchor, side="right")
                shift = np.array(places)[of] - buffer.starts[of]
                stretch = mixed(buffer.names(first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buffer.names(anchor, anchor + gram).view(np.int64)), pa.array(stretch.view(np.int64)),
                     pa.array(docs[np.array(rows)[of]]), pa.array((first + shift).astype(np.int32)),
                     pa.array((last + shift).astype(np.int32))], ["name", "stretch", "doc", "first", "last"])
    return run


def _halves(length: int) -> Callable:
    """Ranks of both halves of the windows that are asked for; input (doc, text, asked, ...)."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for row, (text, asked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                data = (text or "").encode("utf-8", "surrogatepass")
                for part in asked:
                    # Only the asked stretches are hashed.
                    buffer = Buffer([data[part["first"]:part["last"] + length]])
                    at = np.arange(part["last"] - part["first"] + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buffer.names(at, at + half).view(np.int64)),
                         pa.array(buffer.names(at + half, at + length).view(np.int64)),
                         pa.array(np.full(len(at), docs[row])), pa.array((at + part["first"]).astype(np.int32)),
                         pa.array(np.full(len(at), part["alone"]))], ["rank", "rank_on", "doc", "at", "alone"])
    return run


def _gathered(run: Callable) -> Callable:
    """``run`` with its small batches put together."""
    def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return larger


def repeated_windows(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``documents`` (doc, text, id) -> runs (doc, first, last) of windows that are repeated somewhere."""
    anchors = documents.select("doc", "text").mapInArrow(_sampled(length, gram), "name long, stretch long, doc long, first int, last int")
    shared = anchors.groupBy("name").agg(
        F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).filter("n > 1")
    # Written first: a join next to its grouping could not split a large name.
    shared = stashed(shared.select("name", (F.col("low") == F.col("high")).alias("alike")), "names")
    found = stashed(anchors.join(shared, "name"), "anchors")
    classes = found.filter("NOT alike").groupBy("name", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "first", "last")).alias("one"))
    classes = stashed(classes, "stretches")
    sure = found.filter("alike").select("doc", "first", "last").unionByName(
        found.filter("NOT alike").join(classes.filter("n > 1").select("name", "stretch"), ["name", "stretch"])
        .select("doc", "first", "last"))
    asked = classes.select("one.doc", F.struct("one.first", "one.last", (F.col("n") == 1).alias("alone")).alias("part"))
    asked = asked.groupBy("doc").agg(F.collect_list("part").alias("asked"))  # bounded by the document's length
    # The same columns as in the last join, so that both read one shuffle of the texts.
    windows = documents.join(asked, "doc").select("doc", "text", "asked", "id").mapInArrow(
        _gathered(_halves(length)), "rank long, rank_on long, doc long, at int, alone boolean")
    pairs = windows.select(F.xxhash64("rank", "rank_on").alias("rank"), "doc", "at", "alone")
    twice = pairs.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank")
    late = pairs.filter("alone").join(twice, "rank").select("doc", F.col("at").alias("first"), F.col("at").alias("last"))
    return sure, late


def _cut(length: int) -> Callable:
    """Bytes, removed bytes, removed runs and digest of the rest; input (id, text, runs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2)):
                data = (text or "").encode("utf-8", "surrogatepass")
                if not runs.is_valid or not len(runs):
                    out.append((len(data), 0, 0, data))
                    continue
                first = runs.values.field("first").to_numpy().astype(np.int64)
                last = runs.values.field("last").to_numpy().astype(np.int64) + length
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order])
                new = np.concatenate(([True], first[1:] > reach[:-1]))
                begins = first[new]
                ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                kept, at = [], 0
                for a, b in zip(begins.tolist(), ends.tolist()):
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out.append((len(data), int((ends - begins).sum()), len(begins), b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([row[k] for row in out], pa.int64()) for k in range(3)),
                 pa.array([row[3] for row in out], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def without_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH,
                    gram: int = GRAM) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left) of every row."""
    rows = documents.select(F.xxhash64(id, text).alias("doc"), F.col(id).alias("id"), F.col(text).alias("text"))
    sure, late = repeated_windows(rows, length, gram)
    runs = sure.unionByName(late).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kind = documents.schema[id].dataType.simpleString()
    joined = rows.join(runs, "doc", "left").select("id", "text", "runs")
    return joined.mapInArrow(_cut(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
                             ).withColumnRenamed("id", id)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"))
    # The bytes that are left, as text: where a cut went through a character, the rest of it reads as U+FFFD.
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
