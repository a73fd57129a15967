"""Fixed-point numbers in machine words, many side by side.

A number of ``SHIFT`` binary places is a column of six words: five digits of 40 bits, least first, and a signed whole
part on top. Steps of exponential averages are done for all columns at once, and give the same integers as
Python's own would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

SHIFT = 200
SHOWN = 160  # binary places that count in a result
DIGIT = 40
DIGITS = SHIFT // DIGIT
MASK = (1 << DIGIT) - 1
LARGEST = 2.0**37  # of a value; and the smallest one that is not zero:
SMALLEST = 2.0**-100
WIDEST = 1 << 20  # of a divisor
LANE = 64
GROUP = 1 << 18


def fits(values: np.ndarray) -> bool:
    size = np.abs(values)
    return not values.size or bool(size.max() < LARGEST and ((size >= SMALLEST) | (size == 0)).all())


def carried(n: np.ndarray) -> np.ndarray:
    """Digits brought into their range, in place; what is beyond goes to the next."""
    for i in range(DIGITS):
        over = n[i] >> DIGIT
        n[i] &= MASK
        n[i + 1] += over
    return n


def of_doubles(values: np.ndarray) -> np.ndarray:
    """Exact, for values that ``fits`` accepts."""
    size = np.abs(values)
    n = np.empty((DIGITS + 1, *values.shape), np.int64)
    part = np.floor(size)
    n[DIGITS] = part
    rest = size - part
    for i in range(DIGITS - 1, -1, -1):
        rest = rest * 2.0**DIGIT
        part = np.floor(rest)
        n[i] = part
        rest -= part
    below = values < 0
    if below.any():
        n[:, below] *= -1
        carried(n)
    return n


def of_integers(numbers: Sequence[int]) -> np.ndarray:
    row = b"".join([x.to_bytes(32, "little", signed=True) for x in numbers])
    # 32 bytes are six digits of five bytes; the last two bytes only repeat the sign
    parts = np.zeros((len(numbers), DIGITS + 1, 8), np.uint8)
    parts[:, :, :5] = np.frombuffer(row, np.uint8).reshape(-1, 32)[:, :30].reshape(-1, DIGITS + 1, 5)
    n = parts.reshape(-1, 8 * (DIGITS + 1)).view("<i8").T.astype(np.int64)
    n[DIGITS] = n[DIGITS] << 24 >> 24
    return n


def to_integers(n: np.ndarray) -> list[int]:
    return [((((top << 40 | e) << 40 | d) << 40 | c) << 40 | b) << 40 | a for a, b, c, d, e, top in n.T.tolist()]


def to_doubles(n: np.ndarray) -> np.ndarray:
    """Numbers rounded to ``SHOWN`` places as the nearest doubles (ties to even).

    Digits are added up as a double and what it leaves out. Where the latter, a little more or less, gives one result
    that is the nearest; the few others are rounded digit by digit.
    """
    top, first = n[DIGITS].astype(float), n[DIGITS - 1] * 2.0**-DIGIT
    high = top + first
    back = high - top
    low = (top - (high - back)) + (first - back)
    for i in range(DIGITS - 2, -1, -1):
        low += n[i] * 2.0 ** (DIGIT * i - SHIFT)
    margin = np.abs(low) * 2.0**-48 + 2.0 ** (2 - SHOWN)
    found = high + (low + margin)
    unclear = found != high + (low - margin)
    if unclear.any():
        found[unclear] = nearest_doubles(n[:, unclear])
    return found


def nearest_doubles(n: np.ndarray) -> np.ndarray:
    """``to_doubles`` in whole numbers; the rounding to ``SHOWN`` places drops the last digit."""
    r = np.empty((DIGITS + 2, n.shape[1]), np.int64)
    r[:2] = 0  # two zeros stand below the first digit
    r[2:] = n[1:]
    r[2] += n[0] >> (DIGIT - 1)
    below = n[DIGITS] < 0
    if below.any():
        r[2:] *= np.where(below, -1, 1)
    for i in range(2, DIGITS + 1):
        r[i + 1] += r[i] >> DIGIT
        r[i] &= MASK
    # the first digit that is not zero, the two after it, and whether anything is left
    a, b, c, lower = r[2].copy(), r[1].copy(), r[0].copy(), np.zeros(n.shape[1], np.int64)
    lead = np.zeros(n.shape[1], np.int64)
    for i in range(3, DIGITS + 2):
        here = r[i] != 0
        if here.all():
            a, b, c, lead = r[i].copy(), r[i - 1].copy(), r[i - 2].copy(), np.full(n.shape[1], i - 2)
            lower = np.bitwise_or.reduce(r[: i - 2], axis=0)
        elif here.any():
            np.copyto(lower, np.bitwise_or.reduce(r[: i - 2], axis=0), where=here)
            for kept, digit in ((a, r[i]), (b, r[i - 1]), (c, r[i - 2])):
                np.copyto(kept, digit, where=here)
            lead[here] = i - 2
    up = DIGIT - np.maximum(np.frexp(a.astype(float))[1], 1).astype(np.int64)
    high = a << up | b >> (DIGIT - up)
    low = (b << up & MASK) | c >> (DIGIT - up)
    sticky = ((c << up & MASK) | (low & ((1 << 18) - 1)) | lower) != 0
    window = (high << 22 | low >> 18) | sticky
    found = np.ldexp(window.astype(float), (DIGIT * lead - up - 22 - SHOWN).astype(np.int32))
    return np.where(below, -found, found)


def step(level: np.ndarray, twice: np.ndarray, keep: int, whole: int) -> None:
    """``level = (keep * level + twice) // whole``, in place."""
    level *= keep
    level += twice
    over = None
    for i in range(DIGITS, -1, -1):
        v = level[i]
        if over is not None:
            v += over << DIGIT
        q = v // whole
        over = v - q * whole
        level[i] = q
    carried(level)


class Lanes:
    """Series cut into lanes of at most ``LANE`` values, the longest first, in a matrix with a lane a column."""

    def __init__(self, values: np.ndarray, begins: Sequence[int], ends: Sequence[int]) -> None:
        cuts = [(a, min(a + LANE, e), s) for s, (b, e) in enumerate(zip(begins, ends)) for a in range(b, e, LANE)]
        order = sorted(range(len(cuts)), key=lambda i: cuts[i][0] - cuts[i][1])
        self.begin = np.array([cuts[i][0] for i in order], np.int64)
        self.length = np.array([cuts[i][1] - cuts[i][0] for i in order], np.int64)
        steps = int(self.length[0])
        self.active = [int(np.searchsorted(-self.length, -t, "left")) for t in range(steps)]
        self.at = np.minimum(self.begin + np.arange(steps)[:, None], len(values) - 1)
        self.twice = [of_doubles(2 * values[row]) for row in self.at]
        # the lanes of each series in its order
        self.of_series: list[list[int]] = [[] for _ in begins]
        place = {i: lane for lane, i in enumerate(order)}
        for i, (_, _, s) in enumerate(cuts):
            self.of_series[s].append(place[i])

    def fold(self, levels: list[np.ndarray], advance: Callable, outputs: int = 0) -> list[np.ndarray]:
        """Run ``advance(levels, twice)`` along the lanes; its results as doubles, by step and lane."""
        kept = [np.zeros(self.at.shape) for _ in range(outputs)]
        for t, n in enumerate(self.active):
            found = advance([x[:, :n] for x in levels], self.twice[t][:, :n])
            for whole, now in zip(kept, found if outputs else ()):
                whole[t, :n] = to_doubles(now)
        return kept

    def spread(self, found: np.ndarray, into: np.ndarray) -> None:
        """Put results back to where their values came from."""
        there = np.arange(len(self.active))[:, None] < self.length
        into[self.at[there]] = found[there]


def groups(lengths: Sequence[int], most: int = GROUP) -> list[range]:
    """Consecutive series of about ``most`` values together."""
    out, start, size = [], 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            out.append(range(start, i + 1))
            start, size = i + 1, 0
    return out + ([range(start, len(lengths))] if start < len(lengths) else [])
