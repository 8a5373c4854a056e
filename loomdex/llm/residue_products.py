"""Exact inner products of whole numbers by residues, as numpy arrays inside a task.

Components are taken modulo several small primes. Products of residue matrices run in
float32, where all sums stay below 2**24 and so are exact; the signed result is put
together from its residues by Chinese remaindering in mixed radix.
"""

from __future__ import annotations

import numpy as np

PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)     # the largest ones fit for _WIDTH
_WIDTH = 64                 # columns multiplied before sums are reduced
LARGEST = (1 << 62) - 1     # of a product's absolute value


def primes_for(bound: int) -> tuple[int, ...]:
    """As few primes as tell products of absolute value up to ``bound`` apart, with a margin."""
    if bound > LARGEST:
        raise ValueError(f"inner products up to {bound} do not fit a long")
    product, n = 1, 0
    while product <= 4 * bound + 4:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:n]


def residues(matrix: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Per prime, the whole numbers of a float64 matrix as residues around zero."""
    made = []
    for p in primes:
        rest = np.mod(matrix, p)
        made.append(np.where(rest > p // 2, rest - p, rest).astype(np.float32))
    return made


def _reduced(values: np.ndarray, p: int) -> np.ndarray:
    values -= np.rint(values * np.float32(1 / p)) * np.float32(p)
    return values


def products(left: list[np.ndarray], right: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """left @ right.T (int64) of two residue lists with equal columns."""
    rests = []
    for a, b, p in zip(left, right, primes):
        total = np.zeros((len(a), len(b)), np.float32)
        for c in range(0, a.shape[1], _WIDTH):
            total += a[:, c:c + _WIDTH] @ b[:, c:c + _WIDTH].T
            _reduced(total, p)
        rests.append(total)
    # digit i counts the product of the primes before it
    digits: list[np.ndarray] = []
    for rest, p in zip(rests, primes):
        for digit, before in zip(digits, primes):
            centred = (pow(before, -1, p) + p // 2) % p - p // 2
            rest = _reduced((rest - digit) * np.float32(centred), p)
        digits.append(rest)
    out = digits[-1].astype(np.int64)
    for digit, p in zip(digits[-2::-1], primes[len(digits) - 2::-1]):
        out *= p
        out += digit.astype(np.int64)
    return out
