"""Random numbers that hang on (seed, sequence, place) only, so that any draw can be made again anywhere, in SQL too."""

from __future__ import annotations

import numpy as np

BITS = 1 << 32
# Multipliers and shifts of a 32-bit mixer, and what seeds of the two keys are set apart by.
ODD1, ODD2 = 0x7FEB352D, 0x846CA68B
APART1, APART2 = 0x9E3779B9, 0x85EBCA6B


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (held in 64 bits) in which every bit of the input moves half of the output."""
    x = x ^ (x >> np.uint64(16))
    x = x * np.uint64(ODD1) & np.uint64(BITS - 1)
    x ^= x >> np.uint64(15)
    x = x * np.uint64(ODD2) & np.uint64(BITS - 1)
    return x ^ (x >> np.uint64(16))


def keys(seed: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit keys of each id, so that two ids have the same stream with chance 2 ** -64."""
    ids = np.asarray(ids, np.int64).view(np.uint64)
    low, high = ids & np.uint64(BITS - 1), ids >> np.uint64(32)
    some = lambda x: np.full(ids.shape, x % BITS, np.uint64)
    a = mixed((mixed(mixed(some(seed + APART1)) ^ low) + high) & np.uint64(BITS - 1))
    b = mixed(mixed((mixed(some(seed ^ APART2)) + low) & np.uint64(BITS - 1)) ^ high)
    return a, b


def draws(key: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
    """A number from 0 to 2 ** 32 - 1 for each key (rows) and place (columns)."""
    a, b = (k[:, None] for k in key)
    return mixed(mixed((a + np.asarray(places, np.uint64)[None, :]) & np.uint64(BITS - 1)) ^ b)


def cuts(weights: list[int]) -> list[int]:
    """Where each of some whole-number weights ends among the draws: outcome j is drawn from cuts[j - 1] up to cuts[j]."""
    total, so_far, out = sum(weights), 0, []
    for w in weights:
        so_far += w
        out.append(-(-so_far * BITS // total))
    return out


def mixed_sql(x: str) -> str:
    """:func:`mixed` in SQL of unsigned 64-bit numbers."""
    step = lambda y, s, m: f"list_transform({y}, lambda z: xor(z, z >> {s}){f' * {m} % {BITS}' if m else ''})"
    return step(step(step(f"[CAST({x} AS UBIGINT)]", 16, ODD1), 15, ODD2), 16, None) + "[1]"


def keys_sql(seed: int, ids: str) -> tuple[str, str]:
    """:func:`keys` in SQL, for ids that are not negative."""
    low, high = f"CAST({ids} AS UBIGINT) % {BITS}", f"CAST({ids} AS UBIGINT) >> 32"
    a = mixed_sql(f"({mixed_sql(f'xor({mixed_sql(str((seed + APART1) % BITS))}, {low})')} + ({high})) % {BITS}")
    b = mixed_sql(f"xor({mixed_sql(f'({mixed_sql(str((seed ^ APART2) % BITS))} + {low}) % {BITS}')}, {high})")
    return a, b


def draw_sql(a: str, b: str, place: str) -> str:
    """:func:`draws` in SQL."""
    return mixed_sql(f"xor({mixed_sql(f'({a} + CAST({place} AS UBIGINT)) % {BITS}')}, {b})")
