"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its few fields are read here, and from them a tokenizer is rebuilt: normaliser (precompiled
character map, extra white space, dummy prefix), the marker for spaces, the pieces as merges (BPE models) or with their
scores (unigram models), byte fallback. Tasks encode Arrow batches with the library's own threads. The model's bytes, not
its path, go to the tasks, so workers need no copy of the file.

Cases: a null text gives null ids and decodes to null; an empty text has no ids; any bytes of valid text are encoded, by
byte fallback where no piece fits; repeated rows are encoded alike; columns other than the text pass through untouched,
and columns with the names of the results are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import freed, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts, and their characters, handed to the library at a time; a longer text goes alone.
AT_ONCE, CHARACTERS = 64, 1 << 17
#: Threads of the library in one task; an executor runs several tasks.
THREADS = 2
#: Units remembered by a task.
UNITS = 300_000
UNIT = re.compile(r"[ ▁]+[^ ▁\n]*|\n|[^ ▁\n]+")  # a marker in a text is a space to the model


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; lengths, varints and fixed words."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


@dataclass(frozen=True)
class Model:
    """What a SentencePiece file says; field numbers are those of the public sentencepiece_model.proto."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    mark_spaces: bool
    mark_behind: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        import struct

        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0],
                               piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""),
                   bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)),
                   bool(trainer.get(24, 0)))


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order SentencePiece prefers them: by the score of the result."""
    normal = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
    pairs = []
    for text, k in normal.items():
        for cut in range(1, len(text)):
            left, right = normal.get(text[:cut]), normal.get(text[cut:])
            if left is not None and right is not None:
                pairs.append((-pieces[k][1], k, left, right))
    return [(pieces[left][0], pieces[right][0]) for _, _, left, right in sorted(pairs)]


def tokenizer(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    if not model.mark_spaces or model.mark_behind:
        raise ValueError("models that don't mark spaces, or mark them behind words, are not supported")
    vocab = {text: k for k, (text, _, _) in enumerate(model.pieces)}
    unknown = next((text for text, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == BPE:
        core = models.BPE(vocab, merges_of(model.pieces), unk_token=unknown, fuse_unk=True,
                          byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces],
                              vocab[unknown] if unknown else None, model.byte_fallback)
    else:
        raise ValueError("only BPE and unigram models are supported")
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    # Where no piece has a marker behind another character, no merge crosses from a word to the next: words may be cut.
    if not any(MARK in text.lstrip(MARK) for text, _, kind in model.pieces if kind in (NORMAL, USER)):
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    own = [AddedToken(text, normalized=True) for text, _, kind in model.pieces if kind == USER]
    if own:
        made.add_tokens(own)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                      *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return made


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The file's bytes, read by Spark when the path names a store, else by the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()


def _mapped(df: DataFrame, add: dict[str, T.DataType], task) -> DataFrame:
    kept = [name for name in df.columns if name not in add]
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(k, v) for k, v in add.items()])
    return df.mapInArrow(freed(task(kept)), schema)


def _portions(whole: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold few values and few characters (or ids)."""
    values = whole.column(column)
    lengths = (pa.compute.binary_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
               else pa.compute.list_value_length)(values).fill_null(0).to_pylist()
    first = size = 0
    for k, length in enumerate(lengths):
        if k > first and (k - first >= AT_ONCE or size + length > CHARACTERS):
            yield whole.slice(first, k - first)
            first, size = k, 0
        size += length
    if whole.num_rows > first:
        yield whole.slice(first)


class Coder:
    """A task's tokenizer, with the ids of units it has met.

    Where the model permits it, texts are cut into units between which no piece can lie (spaces with the word behind them,
    line feeds) and only new units go to the library; otherwise whole texts do.
    """

    def __init__(self, data: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # before the library starts its threads
        self.model = model = Model.parse(data)
        self.library = tokenizer(model)
        normal = [text for text, _, kind in model.pieces if kind in (NORMAL, USER)]
        self.cuts = (model.byte_fallback and model.dummy_prefix and not model.charsmap and not model.squeeze_spaces
                     and not any(kind == USER for _, _, kind in model.pieces)
                     and not any(MARK in text.lstrip(MARK) or "\n" in text for text in normal))
        if self.cuts:
            self.library.normalizer = normalizers.Replace(" ", MARK)
            self.units: dict[str, bytes] = {}
        # What each id stands for; the marker is a space.
        self.bytes = [bytes([int(text[3:-1], 16)]) if kind == BYTE else text.replace(MARK, " ").encode()
                      for text, _, kind in model.pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.array(found.ids, np.int32) for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [UNIT.findall(" " + text) if text else [] for text in texts]
        new = list({unit for units in cut for unit in units if unit not in self.units})
        for unit, found in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self.units[unit] = np.array(found.ids, np.int32).tobytes()
        ids = [np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32) for units in cut]
        if len(self.units) > UNITS:
            self.units.clear()
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The pieces' bytes; broken byte sequences become replacement characters, the dummy prefix goes."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """``df`` with the pieces' numbers as an array; ``round_trip`` names a column that says if they decode to the text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # one file's bytes, fixed in size
    add = {ids: T.ArrayType(T.IntegerType())} | ({round_trip: T.BooleanType()} if round_trip else {})

    def task(kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = Coder(sent.value)
            for whole in batches:
                for batch in _portions(whole, text):
                    texts = batch.column(text).to_pylist()
                    rows = coder.encode([value or "" for value in texts])
                    offsets = np.concatenate(([0], np.cumsum([len(row) for row in rows]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array(np.concatenate(rows)),
                        mask=pa.array([value is None for value in texts]))
                    columns = [*(batch.column(name) for name in kept), lists]
                    if round_trip:
                        columns.append(pa.array([value is None or coder.decode(row) == value
                                                 for row, value in zip(rows, texts)]))
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *add])
        return run

    return _mapped(df, add, task)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def task(kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = Coder(sent.value)
            for whole in batches:
                for batch in _portions(whole, ids):
                    texts = [None if row is None else coder.decode(np.array(row, np.int64))
                             for row in batch.column(ids).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(name) for name in kept), pa.array(texts, pa.string())], [*kept, text])
        return run

    return _mapped(df, {text: T.StringType()}, task)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    model = read_model(spark)
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, round_trip="round_trip")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
