"""Words, word hashes and rolling window hashes of many texts at once, and compact arrays of hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

#: Odd multipliers, one to join two hashes and one for each size of a window.
_JOIN, _SIZE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
#: Turns the words' hashes into others, for a second hash of windows.
_SECOND = np.uint64(0xA0761D6478BD642F)
#: Bytes of a text that are split into words at once.
_STEP = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all bits; one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that no word lies across, of bounded size unless a word is longer."""
    at = 0
    while len(text) - at > _STEP:
        m = _SPACE.search(text, at + _STEP)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def hashed_words(text: bytes) -> np.ndarray:
    """64 bits of each word, by a hash of its bytes that is no sum of theirs: no family of texts collides in it by design."""
    return np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, part.split()), np.uint64) for part in _parts(text)])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _JOIN + b)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of size hashes: windows of 1, 2, 4, ... are mixed in pairs, and those that make up size."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, at, width, power = None, 0, 1, hashes
    while True:
        if size & width:
            part = power[at : at + n]
            out = part if out is None else _pair(out, part)
            at += width
        if 2 * width > size:
            return mixed(out + np.uint64(size * _SIZE % 2**64))
        power = _pair(power[:-width], power[width:])
        width *= 2


class Words:
    """The words of texts that lie one after another in a byte array.

    first: of each text, the number of its first word, and the number of all words at the end; hashes: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        raw, at = data.tobytes(), offsets.tolist()
        each = [hashed_words(raw[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
        self.first = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) for x in each], out=self.first[1:])
        self.hashes = np.concatenate([*each, np.zeros(0, np.uint64)])

    def __len__(self) -> int:
        return len(self.hashes)

    def whole(self) -> list[bytes]:
        """128 bits of each text's words in their order."""
        at = self.first.tolist()
        return [xxhash.xxh3_128_digest(self.hashes[a:z].tobytes()) for a, z in zip(at[:-1], at[1:], strict=True)]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' windows, text by text with repeats, and where each text's begin (and the end).

        A text of fewer words, but at least one, has one shingle: all its words.
        """
        at, hashes = self.windows(size)
        n = np.diff(self.first)
        short = np.flatnonzero((n > 0) & (n < size))
        place = np.searchsorted(at, self.first[short])
        begin = self.first[:-1]
        all_words = np.array([int(rolled(self.hashes[begin[k] : begin[k] + n[k]], int(n[k]))[0]) for k in short], np.uint64)
        at, hashes = np.insert(at, place, self.first[short]), np.insert(hashes, place, all_words)
        return hashes, np.searchsorted(at, self.first)

    def windows(self, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The first word of every window of size words that lies in one text, and the window's hash.

        second gives another hash of the windows, which shares no step with the first but those of single words.
        """
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = np.ones(n - size + 1, bool)
        for back in range(1, size):  # windows that begin less than size words before a text's end run into the next
            cut = self.first[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        at = np.flatnonzero(inside)
        return at, rolled(mixed(self.hashes ^ _SECOND) if second else self.hashes, size)[at]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as the byte planes of their differences, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = steps.view(np.uint8).reshape(len(steps), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_sorted(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def pack(values: np.ndarray) -> bytes:
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
