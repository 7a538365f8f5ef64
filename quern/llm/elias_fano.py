"""Rising whole numbers in near-minimal space, with select.

Elias (1974) and Fano (1971): of n values below u, the log2(u / n) low bits of each are stored as they
are, and the high parts in unary: bit (value >> width) + i is set for value i, so there are at most
about two bits more a value. A directory of 32-bit counts, one every 512 bits, leads select to its bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 16  # values packed at a time: a whole number of bytes at any width
SPAN = 512  # bits that a directory entry covers


@dataclass
class EliasFano:
    n: int
    base: int
    width: int
    low: np.ndarray
    high: np.ndarray
    directory: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: int64, never falling; fewer than 2^32 of them."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, *(np.zeros(0, k) for k in (np.uint8, np.uint8, np.uint32)))
        base, top = int(values[0]), int(values[-1]) - int(values[0])
        width = max(0, (top // n).bit_length() - 1) if top else 0
        bits = n + (top >> width) + 1
        flags = np.zeros(-(-bits // SPAN) * SPAN, bool)
        low = []
        for at in range(0, n, BLOCK):
            # differences of 64-bit numbers may need 64 bits without a sign
            own = values[at : at + BLOCK].astype(np.uint64) - np.uint64(base % (1 << 64))
            flags[(own >> np.uint64(width)).astype(np.int64) + np.arange(at, at + len(own))] = True
            if width:
                each = own[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
                low.append(np.packbits(each.astype(np.uint8).ravel(), bitorder="little"))
        counts = flags.reshape(-1, SPAN).sum(1)
        directory = (np.cumsum(counts) - counts).astype(np.uint32)
        return cls(n, base, width, np.concatenate(low) if low else np.zeros(0, np.uint8), np.packbits(flags, bitorder="little"), directory)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The values at these ranks (from 0)."""
        ranks = np.asarray(ranks, np.int64)
        block = np.searchsorted(self.directory, ranks, side="right") - 1
        bits = np.unpackbits(self.high.reshape(-1, SPAN // 8)[block], axis=1, bitorder="little")
        within = (ranks - self.directory[block] + 1)[:, None]
        place = (np.cumsum(bits, axis=1, dtype=np.int32) >= within).argmax(1)
        out = (block * SPAN + place - ranks).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = ranks[:, None] * self.width + np.arange(self.width)
            each = (self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.uint64)
            out |= (each << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (out + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def header(self) -> dict[str, int]:
        return {"n": self.n, "base": self.base, "width": self.width, "low": len(self.low), "high": len(self.high)}

    def dump(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def load(cls, header: dict[str, int], data: bytes) -> EliasFano:
        low, high = header["low"], header["high"]
        return cls(
            header["n"], header["base"], header["width"], np.frombuffer(data, np.uint8, low),
            np.frombuffer(data, np.uint8, high, low), np.frombuffer(data, "<u4", -1, low + high),
        )
