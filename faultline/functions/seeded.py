"""Seeded randomness from md5, independent of partitioning and of the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int | str, *ids: str | Column) -> Column:
    """Hex digest of ``seed:id[:id...]``; the order of rows by it is a seeded shuffle."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_uniform(seed: int | str, *ids: str | Column) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the seeded hash."""
    head = F.substring(seeded_hash(seed, *ids), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**52))


def seeded_normal(seed: int | str, *ids: str | Column) -> Column:
    """Standard normal double by Box-Muller on two seeded uniforms."""
    u1 = F.greatest(seeded_uniform(f"{seed}a", *ids), F.lit(1e-300))
    u2 = seeded_uniform(f"{seed}b", *ids)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


_ROUNDS = 6  # exchanges of a position's two halves


def seeded_bijection(position: Column, n: int, seed: int, *keys: Column) -> Column:
    """A seeded permutation of 0..n-1, as an expression of one position and further keys.

    A position is a pair of digits in the smallest rectangle a x b around n. A round adds a hash of
    one digit to the other, modulo its size, which can be undone; so the rectangle is
    permuted. A position that lands at n or beyond is sent through again until it is below n,
    which ends because it came from below. At most a - 1 places lie beyond, so most
    positions land at once.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    digit = lambda x, i: F.xxhash64(x, i, F.lit(seed), *keys)

    def scramble(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).alias("p"), F.pmod(x, F.lit(b)).alias("q"))
        turn = lambda acc, i: F.when(
            i % 2 == 0, F.struct(F.pmod(acc["p"] + F.pmod(digit(acc["q"], i), F.lit(a)), F.lit(a)).alias("p"), acc["q"].alias("q"))
        ).otherwise(F.struct(acc["p"].alias("p"), F.pmod(acc["q"] + F.pmod(digit(acc["p"], i), F.lit(b)), F.lit(b)).alias("q")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), pair, turn, lambda acc: acc["p"] * F.lit(b) + acc["q"])

    # A walk outside takes no longer than there are places outside; past 64 steps its chance is below n^-30.
    walks = min(a * b - n + 1, 64)
    x = position.cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.struct(x.alias("x"), F.lit(False).alias("done")), lambda acc, _: F.when(
        acc["done"], acc).otherwise(_landed(scramble(acc["x"]), n)), lambda acc: acc["x"])


def _landed(x: Column, n: int) -> Column:
    # An array of one value names it, so that the rounds are worked out once.
    return F.transform(F.array(x), lambda v: F.struct(v.alias("x"), (v < n).alias("done")))[0]
