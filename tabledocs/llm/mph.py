"""Minimal perfect hash over 128-bit keys, with parallel value arrays.

Built level by level: at each level the keys left over are hashed into a bit
array, bits hit by exactly one key are set, the other keys go on to the next
level. A key's index is the rank of its bit among all set bits. About four
bits a key; the keys themselves are not stored, so a probe also compares a
64-bit fingerprint kept at the index.
"""

from __future__ import annotations

import numpy as np

from tabledocs.llm.common import mix64

#: Bits of a level per key that enters it.
GAMMA = 1.7


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix64(a ^ mix64(b + seed)) % np.uint64(size)


class HashArrays:
    """The index of one shard: bit levels, fingerprints, counts, last holders."""

    def __init__(self, sizes, bits: list[np.ndarray], fp, counts, last):
        self.sizes, self.bits = list(sizes), bits
        self.fp, self.counts, self.last = fp, counts, last
        self.ranks, before = [], 0
        for x in bits:
            r = np.cumsum(x, dtype=np.int64)
            self.ranks.append(r + (before - 1))
            before += int(r[-1]) if len(r) else 0

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, last: np.ndarray) -> HashArrays:
        """``(a, b)``: distinct keys as two uint64 arrays."""
        sizes, bits, level = [], [], 0
        ra, rb = a, b
        while len(ra):
            size = max(64, -(-int(GAMMA * len(ra)) // 64) * 64)
            at = _slots(ra, rb, level, size)
            single = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            bits.append(single)
            left = ~single[at]
            ra, rb, level = ra[left], rb[left], level + 1
            if level > 200:
                raise ValueError("keys of a perfect hash must be distinct")
        out = cls(sizes, bits, np.zeros(len(a), np.uint64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64))
        i = out.index(a, b)
        out.fp[i], out.counts[i], out.last[i] = b, counts, last
        return out

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key; for a key not built in, any index or -1."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            if not len(left):
                break
            at = _slots(a[left], b[left], level, size)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is a member, its count, its last holder."""
        i = self.index(a, b)
        if not len(self.fp):
            no = np.zeros(len(a), np.int64)
            return no.astype(bool), no, no
        found = (i >= 0) & (self.fp[i] == b)
        return found, np.where(found, self.counts[i], 0), np.where(found, self.last[i], 0)

    def dump(self) -> dict:
        return {"sizes": [int(s) for s in self.sizes],
                "bits": b"".join(np.packbits(x).tobytes() for x in self.bits),
                "fp": self.fp.tobytes(), "counts": self.counts.astype(np.int64).tobytes(),
                "last": self.last.astype(np.int64).tobytes()}

    @classmethod
    def load(cls, sizes, bits: bytes, fp: bytes, counts: bytes, last: bytes) -> HashArrays:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        cut = np.cumsum([0, *sizes])
        return cls(sizes, [flat[i:j] for i, j in zip(cut[:-1], cut[1:])], np.frombuffer(fp, np.uint64),
                   np.frombuffer(counts, np.int64), np.frombuffer(last, np.int64))
