"""Percentiles from dyadic Count-Sketches that are merged by addition.

Values are encoded, in order, as 17-bit codes: exactly up to 2,047, with eleven significant bits beyond, negative values likewise. A sketch has,
for each number of leading bits of the code, signed counters of how many values share those bits; where there are few prefixes they are
counted exactly. A rank is inverted by descending from the exact level, bit by bit. Counters are plain sums, so sketches of partitions or
days are added, and values, or whole days, are deleted by adding their negative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Significant bits after the first; the midpoint of a code's range is within 2^-(MANTISSA + 1) of every value in it.
MANTISSA = 10
HALF = 1 << 16
BITS = 17
#: Prefixes of the code with this many low bits dropped are counted exactly (2^(17-4) = 8,192 counters).
EXACT = 4
#: Each level below has ROWS x WIDTH signed counters.
ROWS, WIDTH = 5, 2048
PRIME = (1 << 31) - 1
#: The stated bound is this many standard deviations of the error of a sum of counters.
SIGMAS = 4.0
_R = np.random.default_rng(2031)
HASHES = _R.integers(1, PRIME, (EXACT * ROWS, 4)).astype(np.int64)  # column: (a x + b) mod p mod WIDTH; sign: (c x + d) mod p mod 2


def code(value: Column) -> Column:
    """The order-preserving code of a BIGINT."""
    v = F.when(value >= 0, value).otherwise(-(value + 1))
    shift = F.greatest(F.length(F.bin(v)) - F.lit(MANTISSA + 1), F.lit(0))
    m = F.call_function("shiftleft", shift.cast("long"), F.lit(MANTISSA)) + F.call_function("shiftright", v, shift)
    return F.when(value.isNotNull(), F.when(value >= 0, m + HALF).otherwise(HALF - 1 - m)).cast("int")


def code_range(c: int) -> tuple[int, int]:
    """Least and greatest value of a code."""
    m = c - HALF if c >= HALF else HALF - 1 - c
    shift = max((m >> MANTISSA) - 1, 0)
    lo = (m - (shift << MANTISSA)) << shift
    hi = lo + (1 << shift) - 1
    return (lo, hi) if c >= HALF else (-1 - hi, -1 - lo)


#: So many of a group's codes, those of the greatest counts, are kept as codes with their exact counts; only the others go to the counters. A
#: code there has at most n / SPARSE values, so a level's sum of squares is at most 2^level n^2 / SPARSE and the error of one sketch, or of
#: a sum of them, about SIGMAS sqrt((2^EXACT - 1) / (SPARSE WIDTH)) n at most: 0.38 % of n, whatever the values.
SPARSE = 8_192


def sketch(df: DataFrame, groups: list[str], value: str, sign: int = 1, kept: int | None = None) -> DataFrame:
    """``groups..., cell, n``: the non-zero counters of each group's sketch. Null values do not count; null groups are a group.

    Rows first meet per group and code, which a map-side sum does for hot groups; a group then has at most 2^17 codes. Groups with few
    codes are kept exactly (cell = -1 - code), as are the most frequent codes of the others, whose rest is spread over the counters. With ``sign=-1`` the sketch deletes the rows
    from another one. kept: so many codes of a group stay exact, by default SPARSE; fewer make sketches smaller and the stated error greater."""
    kept = SPARSE if kept is None else kept
    codes = df.select(*groups, code(F.col(value).cast("long")).alias("code")).filter("code is not null").groupBy(*groups, "code").agg((F.count(F.lit(1)) * sign).alias("n"))
    names, kinds = list(groups), dict(codes.dtypes)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, n = pdf["code"].to_numpy(np.int64), pdf["n"].to_numpy()
        order = np.lexsort((codes, -np.abs(n)))
        codes, n = codes[order], n[order]
        cell = -1 - codes[:kept]
        if len(codes) > kept:
            flat = counters(codes[kept:], n[kept:])
            at = np.flatnonzero(flat)
            cell, n = np.concatenate([cell, at]), np.concatenate([n[:kept], flat[at]])
        return pd.DataFrame({g: [pdf[g].iloc[0]] * len(cell) for g in names} | {"cell": cell.astype(np.int32), "n": n})

    return codes.groupBy(*groups).applyInPandas(spread, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", cell int, n long")


def counters(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All counters, one after another, for codes with these counts."""
    flat = np.zeros(EXACT * ROWS * WIDTH + (1 << BITS - EXACT), np.int64)
    for k, (a, b, c, d) in enumerate(HASHES):
        x = codes >> k // ROWS
        np.add.at(flat, k * WIDTH + (a * x + b) % PRIME % WIDTH, np.where((c * x + d) % PRIME % 2 == 1, -n, n))
    np.add.at(flat, EXACT * ROWS * WIDTH + (codes >> EXACT), n)
    return flat


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sum of sketches: of partitions, of days, or of insertions and deletions. Counters that cancel out disappear."""
    return sketches.groupBy(*groups, "cell").agg(F.sum("n").alias("n")).filter("n <> 0")


class Sketch:
    """One group's counters, for inverting ranks."""

    def __init__(self, cell: np.ndarray, n: np.ndarray):
        sparse = cell < 0
        codes, kept = -1 - cell[sparse].astype(np.int64), n[sparse]
        order = np.argsort(codes)
        self.codes, self.before = codes[order], np.cumsum([0, *kept[order].tolist()])
        flat = np.zeros(EXACT * ROWS * WIDTH + (1 << BITS - EXACT), np.int64)
        np.add.at(flat, cell[~sparse], n[~sparse])
        np.add.at(flat, EXACT * ROWS * WIDTH + (codes >> EXACT), kept)
        self.levels = flat[: EXACT * ROWS * WIDTH].reshape(EXACT, ROWS, WIDTH)
        self.exact = flat[EXACT * ROWS * WIDTH :]
        self.n = int(self.exact.sum())
        self.upto = np.cumsum(self.exact)
        f2 = np.median((self.levels.astype(float) ** 2).sum(2), 1)  # estimates the sum of the squared counts of a level
        self.error = float(SIGMAS * np.sqrt((f2 / WIDTH).sum()))

    def count(self, level: int, prefix: int) -> int:
        first, end = np.searchsorted(self.codes, [prefix << level, (prefix + 1) << level])
        exact = int(self.before[end] - self.before[first])
        if not self.error:
            return exact
        h = HASHES[level * ROWS : (level + 1) * ROWS]
        at = (h[:, 0] * prefix + h[:, 1]) % PRIME % WIDTH
        sign = np.where((h[:, 2] * prefix + h[:, 3]) % PRIME % 2 == 1, -1, 1)
        return exact + int(np.median(sign * self.levels[level, np.arange(ROWS), at]))

    def at_rank(self, rank: int) -> int:
        """The code of the value of this rank (1 to n)."""
        rank = min(max(rank, 1), self.n)
        prefix = int(np.searchsorted(self.upto, rank))
        left = rank - (int(self.upto[prefix - 1]) if prefix else 0)
        there = int(self.exact[prefix])
        for level in range(EXACT - 1, -1, -1):
            low = min(max(self.count(level, prefix * 2), 0), there)
            if left <= low:
                prefix, there = prefix * 2, low
            else:
                prefix, left, there = prefix * 2 + 1, left - low, there - low
        return prefix


def percentiles(sketches: DataFrame, groups: list[str], points: list[float]) -> DataFrame:
    """``groups..., q, n, estimate, lower, upper, rank_error`` per group and quantile of merged sketches.

    The quantile is the value of rank ceil(q n). ``rank_error`` (in ranks) is four standard deviations of the sketch's error; the exact value
    lies between ``lower`` and ``upper``, the values at the ranks that far below and above, unless the error is greater; it is 0 for groups of which all
    codes are kept exactly. A group is at most 49,152 counters and 2^17 codes, whatever its number of values. Groups without values have no rows."""
    names = list(groups)
    kinds = dict(sketches.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Sketch(pdf["cell"].to_numpy(), pdf["n"].to_numpy())
        out = []
        for q in points if s.n > 0 else []:
            r = max(1, int(np.ceil(q * s.n - 1e-9)))
            e = int(np.ceil(s.error))
            lo, hi = code_range(s.at_rank(r))
            out.append([q, s.n, (lo + hi) // 2, code_range(s.at_rank(r - e))[0], code_range(s.at_rank(r + e))[1], s.error])
        frame = pd.DataFrame(out, columns=["q", "n", "estimate", "lower", "upper", "rank_error"]).astype({"q": float, "n": "int64", "estimate": "int64", "lower": "int64", "upper": "int64", "rank_error": float})
        for g in reversed(names):
            frame.insert(0, g, [pdf[g].iloc[0]] * len(frame))
        return frame

    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", q double, n long, estimate long, lower long, upper long, rank_error double"
    return sketches.groupBy(*groups).applyInPandas(run, schema)
