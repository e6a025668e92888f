"""Names (hashes) of substrings of many texts at once, and sampled positions that depend on nothing but nearby bytes."""

from __future__ import annotations

import numpy as np

from .shingles import _powers_of, mixed

#: Positions of one buffer fit in so many bits.
PLACES = 20


class Buffer:
    """Texts one after another; ``starts`` and ``ends`` bound them."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter((len(text) for text in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        powers, self._inverse = _powers_of(len(self.data) + 1)
        bytes_ = mixed(np.arange(1, 257, dtype=np.uint64))
        self._sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(bytes_[self.data] * powers[:len(self.data)], dtype=np.uint64, out=self._sums[1:])

    def names(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Names of the substrings [begin, end): equal for equal substrings, wherever they stand."""
        return mixed((self._sums[ends] - self._sums[begins]) * self._inverse[begins]
                     + (ends - begins).astype(np.uint64))

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows of ``length`` bytes inside a text: (anchor, first window, last window).

        A window's anchor is its position with the least name of ``gram`` bytes, the leftmost if several have it. It depends
        on the window's bytes alone. Windows with the same anchor follow one another.
        """
        width, count = length - gram + 1, len(self.data) - gram + 1
        if len(self.data) < length:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        names = mixed((self._sums[gram:] - self._sums[:-gram]) * self._inverse[:count])
        low = np.uint64((1 << PLACES) - 1)
        packed = (names & ~low) | np.arange(count, dtype=np.uint64)
        rows = -(-count // width)
        grid = np.full(rows * width, ~np.uint64(0), np.uint64)
        grid[:count] = packed
        grid = grid.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(self.data) - length + 1
        least = np.minimum(behind[:windows], ahead[width - 1:width - 1 + windows])
        at = (least & low).astype(np.int64)
        valid = np.zeros(windows + 1, np.int8)
        long_ = self.ends - self.starts >= length
        np.add.at(valid, self.starts[long_], 1)
        np.add.at(valid, self.ends[long_] - length + 1, -1)
        inside = np.flatnonzero(np.cumsum(valid[:-1]))
        at = at[inside]
        # Windows of one text follow one another; a new text begins with a new anchor, as anchors lie in their text.
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(at)]))[:len(first)] - 1
        return at[first], inside[first], inside[last]
