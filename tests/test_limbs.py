import random

import numpy as np

from candlemill.functions import limbs
from candlemill.functions.recurrences import SCALE, doubles


def numbers(seed=1):
    draw = random.Random(seed)
    found = [draw.randrange(-(1 << k), 1 << k) for k in range(1, 237) for _ in range(20)]
    # halfway between two doubles, and just beside it
    ties = [(draw.randrange(1 << 52, 1 << 53) * 2 + 1) << draw.randrange(40, 180) for _ in range(2000)]
    return found + [s * (t + d) for t in ties for s in (1, -1) for d in (-1, 0, 1 << 39, -(1 << 39))] + [0, 1, -1]


def test_there_and_back():
    found = numbers()
    assert limbs.to_integers(limbs.of_integers(found)) == found
    draw = np.random.default_rng(2)
    values = np.concatenate([draw.normal(size=3000) * 10.0 ** draw.integers(-20, 10, 3000), [0.0, -0.0, 1.1, -1.1, 2.0**36, 1e-30]])
    assert limbs.fits(values) and not limbs.fits(np.array([1e12])) and not limbs.fits(np.array([1e-40])) and limbs.fits(np.array([]))
    assert limbs.to_integers(limbs.of_doubles(values)) == [int(x * SCALE) for x in values]


def test_nearest_doubles():
    found = numbers(4)
    n = limbs.of_integers(found)
    assert limbs.to_doubles(n).tolist() == doubles(found) == limbs.nearest_doubles(n).tolist()


def test_steps():
    draw = random.Random(6)
    found = numbers(5)
    other = [draw.choice(found) for _ in found]
    for keep, whole in ((6, 8), (19, 21), (25, 27), (0, 2), (limbs.WIDEST - 3, limbs.WIDEST - 1)):
        level = limbs.of_integers(found)
        limbs.step(level, limbs.of_integers(other) * 2, keep, whole)
        assert limbs.to_integers(level) == [(keep * a + 2 * b) // whole for a, b in zip(found, other)]


def test_lanes_come_back_to_their_places():
    values = np.arange(1000.0)
    lanes = limbs.Lanes(values, [0, 10, 300, 300], [10, 300, 300, 999])
    assert [sum(lanes.length[lane] for lane in one) for one in lanes.of_series] == [10, 290, 0, 699]
    out = np.full(1000, -1.0)
    lanes.spread(values[lanes.at], out)
    assert out[:999].tolist() == values[:999].tolist() and out[999] == -1
    assert limbs.groups([3, 5, 1, 9, 2], 6) == [range(0, 2), range(2, 4), range(4, 5)]
