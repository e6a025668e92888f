"""Five-word shingles of whole texts as 64-bit hashes, for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at a time; a longer text is hashed alone.
AT_ONCE = 1 << 19
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = []


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, AT_ONCE * 2)
        both = []
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            both.append(np.multiply.accumulate(powers))
        _powers[:] = both
    return _powers[0], _powers[1]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, in order and with repeats, and where each text's begin; words are lower-cased in A-Z.

    A text of fewer than five words gives one hash of all its words, one without words gives none.
    """
    data = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    sizes = np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts))
    word = ~_BLANK[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    powers, inverse = _powers_of(len(data))
    letters = mixed(np.arange(1, 257, dtype=np.uint64))
    sums = np.cumsum(letters[data] * powers[:len(data)], dtype=np.uint64)
    words = mixed((sums[ends - 1] - sums[begins - 1]) * inverse[begins])
    first = np.searchsorted(begins, 1 + np.concatenate(([0], np.cumsum(sizes))))
    counts = np.diff(first)
    made = np.maximum(counts - (WORDS - 1), np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(made)))
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - first[:-1], made)
    width = np.repeat(np.minimum(counts, WORDS), made)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    total = width.astype(np.uint64)
    for k in range(WORDS):
        total = mixed(total + np.where(k < width, padded[at + k], np.uint64(0)) * np.uint64(2 * k + 3))
    return total, starts


def sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Number of a text and its sorted distinct shingles, for all texts in order."""
    portion, size, first = [], 0, 0
    for number, text in enumerate(texts):
        portion.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(portion[-1])
        if size >= AT_ONCE or number == len(texts) - 1:
            hashes, starts = hashed(portion)
            for k in range(len(portion)):
                yield first + k, np.unique(hashes[starts[k]:starts[k + 1]])
            portion, size, first = [], 0, number + 1
