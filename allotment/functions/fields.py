"""Arithmetic tables of small finite fields, by rule: elements are base-p digit strings."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from allotment.plans.budget import is_prime_power


def _digits(value: int, p: int, k: int) -> list[int]:
    return [value // p**i % p for i in range(k)]


def _times_x(digits: list[int], low: tuple[int, ...], p: int) -> list[int]:
    """Multiply by x modulo x^k + low(x)."""
    top = digits[-1]
    return [(d - top * c) % p for d, c in zip([0] + digits[:-1], low)]


@lru_cache(maxsize=None)
def field_powers(q: int) -> list[int]:
    """1, x, x^2, ... in GF(q), all q - 1 of them, q a proper prime power.

    The modulus is the first x^k + ... for which x generates the whole multiplicative group, so products follow from adding
    exponents.
    """
    p, k = is_prime_power(q)
    value = lambda ds: sum(d * p**i for i, d in enumerate(ds))
    for tail in product(range(p), repeat=k):
        low = tuple(reversed(tail))
        powers, x = [1], _digits(p, p, k)
        while value(x) != 1 and value(x) != 0 and len(powers) < q:
            powers.append(value(x))
            x = _times_x(x, low, p)
        if len(set(powers)) == q - 1 == len(powers):
            return powers
    raise ValueError(f"GF({q}) has no generator")


@lru_cache(maxsize=None)
def field_tables(q: int) -> tuple[list[list[int]], list[list[int]]]:
    """(sums, products) of GF(q) as q x q lists."""
    if (pk := is_prime_power(q)) is None:
        raise ValueError(f"{q} is not a prime power")
    p, k = pk
    digits = [_digits(v, p, k) for v in range(q)]
    value = lambda ds: sum(d * p**i for i, d in enumerate(ds))
    sums = [[value([(a + b) % p for a, b in zip(x, y)]) for y in digits] for x in digits]
    if k == 1:
        return sums, [[a * b % p for b in range(q)] for a in range(q)]
    powers = field_powers(q)
    log = {v: e for e, v in enumerate(powers)}
    return sums, [[powers[(log[a] + log[b]) % (q - 1)] if a and b else 0 for b in range(q)] for a in range(q)]


def field_row(q: int) -> tuple[int, int, list[int], list[int], list[int]]:
    """q, its prime, the places 1, p, p^2, ... of digits, powers and logarithms (of 0: 0); no powers for a prime."""
    p, k = is_prime_power(q)
    places, powers = [p**i for i in range(k)], field_powers(q) if k > 1 else []
    log = [0] * q if powers else []
    for e, v in enumerate(powers):
        log[v] = e
    return q, p, places, powers, log
