"""Directly addressable codes: arrays of whole numbers with access to any of them.

Each number is split into chunks of 8 bits, lowest first. Level k holds the k-th chunks of all numbers that have
one, a bitmap of those that go on in the next level, and a directory of the bitmap's ranks. The place of a
number's next chunk is the rank of its bit, so a number, or a range of them, is read without any other.

Layout, little-endian: b"DAC1", levels (u32), length (u64), and for each level its length (u64), the chunks, the bitmap
(lowest bit first, padded to 64 bytes) and the ranks before every 64 bytes of it (u64).
"""

from __future__ import annotations

import numpy as np

_MAGIC = b"DAC1"
_BLOCK = 64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encoded(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    out, levels = [], 0
    while len(values) or not levels:
        rest = values >> np.uint64(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % _BLOCK, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))[:-1]]) if len(bits) else np.zeros(0)
        out += [np.uint64(len(values)).tobytes(), (values & np.uint64(255)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
        values, levels = rest[more], levels + 1
    length = int(np.frombuffer(out[0], np.uint64)[0])
    return _MAGIC + np.uint32(levels).tobytes() + np.uint64(length).tobytes() + b"".join(out)


class Codes:
    """Read access to an encoded array."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != _MAGIC:
            raise ValueError("not directly addressable codes")
        levels, self.length = int(np.frombuffer(blob, "<u4", 1, 4)[0]), int(np.frombuffer(blob, "<u8", 1, 8)[0])
        at, self.levels = 16, []
        for _ in range(levels):
            n = int(np.frombuffer(blob, "<u8", 1, at)[0])
            wide = -(-(-(-n // 8)) // _BLOCK) * _BLOCK
            chunks, bits = np.frombuffer(blob, np.uint8, n, at + 8), np.frombuffer(blob, np.uint8, wide, at + 8 + n)
            ranks = np.frombuffer(blob, "<u8", wide // _BLOCK, at + 8 + n + wide)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + wide + 8 * len(ranks)

    def __len__(self) -> int:
        return self.length

    def _rank(self, level: int, i: int) -> int:
        """The number of set bits before i."""
        chunks, bits, ranks = self.levels[level]
        block = i // (8 * _BLOCK)
        if block == len(ranks):
            block -= 1
        if block < 0:
            return 0
        whole = bits[block * _BLOCK : i // 8]
        n = int(ranks[block]) + int(_ONES[whole].sum())
        return n + bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.length:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, a: int, z: int) -> np.ndarray:
        """The numbers from a to before z."""
        out = np.zeros(z - a, np.uint64)
        where: np.ndarray | None = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[a:z].astype(np.uint64) << np.uint64(8 * level)
            if where is None:
                out += part
            else:
                out[where] += part
            own = np.unpackbits(bits[a // 8 : -(-z // 8)], bitorder="little")[a % 8 : a % 8 + z - a].astype(bool)
            if not own.any():
                break
            where = np.flatnonzero(own) if where is None else where[own]
            a = self._rank(level, a)
            z = a + len(where)
        return out
