"""Reproducible random streams: a seed from FNV-1a-64 over explicit bytes, and xoshiro256++ filled by SplitMix64, both public algorithms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: The parameters of FNV-1a-64 and SplitMix64.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Tag of the format in which a seed is made of its parts; results of another tag are other streams.
TAG = b"rng.v1"


def fnv1a64(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def seed(base: int, purpose: str, stream: str, tag: bytes = TAG) -> int:
    p, s = purpose.encode(), stream.encode()
    return fnv1a64(tag + base.to_bytes(8, "little") + len(p).to_bytes(8, "little") + p + len(s).to_bytes(8, "little") + s)


class Stream:
    """xoshiro256++."""

    def __init__(self, value: int):
        self.s = []
        for _ in range(4):
            value = (value + GOLDEN) & MASK
            z = (value ^ (value >> 30)) * MIX1 & MASK
            z = (z ^ (z >> 27)) * MIX2 & MASK
            self.s.append(z ^ (z >> 31))

    @classmethod
    def of(cls, base: int, purpose: str, stream: str, tag: bytes = TAG) -> Stream:
        return cls(seed(base, purpose, stream, tag))

    def u64(self) -> int:
        s = self.s
        turn = lambda x, k: ((x << k) | (x >> (64 - k))) & MASK
        out = (turn((s[0] + s[3]) & MASK, 23) + s[0]) & MASK
        t = s[1] << 17 & MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = turn(s[3], 45)
        return out

    def uniform(self) -> float:
        """In [0, 1), from the upper 53 bits."""
        return (self.u64() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        """0 to n - 1, by the upper half of a 64 x 64 bit product (a draw of this library's own)."""
        return self.u64() * n >> 64


def uniform(base: int, purpose: str, stream: Column) -> Column:
    """The first uniform number of each row's stream; a null stream gives null."""

    @F.pandas_udf("double")
    def draw(streams: pd.Series) -> pd.Series:
        return streams.map(lambda x: None if x is None else Stream.of(base, purpose, x).uniform())

    return draw(stream.cast("string"))
