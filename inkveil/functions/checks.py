"""Checksums of identifiers, over surfaces that already have their shape."""

from __future__ import annotations

# Weights of company numbers, of an account's prefix and of its base, aligned at the right; what is
# added to a month of a birth number.
COMPANY, PREFIX, BASE = (8, 7, 6, 5, 4, 3, 2), (10, 5, 8, 4, 2, 1), (6, 3, 7, 9, 10, 5, 8, 4, 2, 1)
MONTH_SHIFTS = (0, 20, 50, 70)


def weighted(digits: str, weights: tuple[int, ...]) -> int:
    """Sum of digit times weight, aligned at the right."""
    return sum(int(d) * w for d, w in zip(reversed(digits), reversed(weights)))


def birth_number_shape(s: str) -> bool:
    month, day = int(s[2:4]), int(s[4:6])
    return 1 <= day <= 31 and any(1 <= month - k <= 12 for k in MONTH_SHIFTS)


def birth_number(s: str) -> bool:
    return int(s.replace("/", "")) % 11 == 0


def company_number(s: str) -> bool:
    rest = weighted(s[:7], COMPANY) % 11
    return int(s[7]) == {0: 1, 1: 0}.get(rest, 11 - rest)


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int(f"{s[4:]}{int(s[0], 36)}{int(s[1], 36)}{s[2:4]}") % 97 == 1


def account(s: str) -> bool:
    prefix, base = s.partition("/")[0].split("-")
    return weighted(prefix, PREFIX) % 11 == 0 and weighted(base, BASE) % 11 == 0
