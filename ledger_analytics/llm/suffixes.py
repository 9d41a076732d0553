"""Order of all suffixes of a byte array by induced sorting, with queues that go to disk.

The text is read from right to left in types: a suffix is of type S if it is smaller than
the next one, else L; an S suffix after an L suffix is *leftmost S*. The leftmost S
suffixes are ordered first; the order of all others follows from them by induction: the
suffix before a placed suffix goes to the queue of its own first byte, behind what is there.
Queues are priority queues whose keys, the first bytes, only rise (L) or fall (S), so each
needs no more than appending and reading in order; they keep ``MEMORY`` bytes in memory and
write the rest to one temporary file of the task, which is removed with the queues.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes that the queues of one sort keep in memory.
MEMORY = 64 << 20
#: Leading bytes by which leftmost S suffixes are ordered at least.
DEPTH = 64


class Queues:
    """One queue of positions for each byte."""

    def __init__(self, memory: int):
        self._memory, self._held = memory, 0
        self._parts: list[list] = [[] for _ in range(256)]
        self._file = None

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Append each position to the queue of its key, in order."""
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for first, last in zip(cuts[:-1], cuts[1:]):
            if last > first:
                self._append(int(keys[first]), positions[first:last])

    def _append(self, key: int, part: np.ndarray) -> None:
        if self._held + part.nbytes > self._memory:
            if self._file is None:
                self._file = tempfile.TemporaryFile()
            at = self._file.seek(0, 2)
            self._file.write(part.tobytes())
            self._parts[key].append((at, len(part), part.dtype))
        else:
            self._held += part.nbytes
            self._parts[key].append(part.copy())

    def pop(self, key: int) -> np.ndarray:
        """All that the queue of ``key`` holds."""
        out = []
        for part in self._parts[key]:
            if isinstance(part, tuple):
                at, n, kind = part
                self._file.seek(at)
                part = np.frombuffer(self._file.read(n * kind.itemsize), kind)
            else:
                self._held -= part.nbytes
            out.append(part)
        self._parts[key] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def words_at(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, in byte order; zeros follow the text."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    view = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))
    return view[np.minimum(positions, len(text))].astype(np.uint64)


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the end of the text counts as smaller than any byte."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change] < text[change + 1], False)
    lengths = np.diff(np.concatenate([[0], change + 1, [len(text)]]))
    return np.repeat(rises, lengths)


def suffix_order(text: np.ndarray, memory: int = MEMORY, depth: int = DEPTH) -> np.ndarray:
    """Positions of all suffixes, ordered by their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    is_s = _types(text)
    left = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    keys = [words_at(text, left + 8 * j) for j in range(-(-depth // 8))]
    left = left[np.lexsort(keys[::-1])]
    left_bytes = text[left]
    bounds = np.searchsorted(left_bytes, np.arange(257))

    def before(positions: np.ndarray, want_s: bool) -> np.ndarray:
        p = positions[positions > 0] - 1
        return p[is_s[p] == want_s]

    queues = Queues(memory)
    placed_l: list[np.ndarray] = []
    try:
        queues.push(text[-1:], np.array([n - 1], left.dtype))
        for byte in range(256):
            rounds = []
            now = queues.pop(byte)
            while len(now):
                rounds.append(now)
                p = before(now, False)
                same = text[p] == byte
                queues.push(text[p[~same]], p[~same])
                now = p[same]
            placed_l.append(np.concatenate(rounds) if rounds else now)
            p = before(left[bounds[byte] : bounds[byte + 1]], False)
            queues.push(text[p], p)
        placed_s: list[np.ndarray] = [np.zeros(0, np.int32)] * 256
        for byte in range(255, -1, -1):
            rounds = []
            now = queues.pop(byte)
            while len(now):
                rounds.append(now)
                p = before(now, True)
                same = text[p] == byte
                queues.push(text[p[~same]], p[~same])
                now = p[same]
            if rounds:
                placed_s[byte] = np.concatenate(rounds)[::-1]
            p = before(placed_l[byte][::-1], True)
            queues.push(text[p], p)
    finally:
        queues.close()
    return np.concatenate([x for pair in zip(placed_l, placed_s) for x in pair])


def same_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order`` but the first, whether its suffix and the one before share
    their first ``length`` bytes. All of them must have so many."""
    equal = np.ones(max(len(order) - 1, 0), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        w = words_at(text, order + at)
        equal &= w[1:] == w[:-1]
    return equal
