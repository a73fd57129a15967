import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlemill.functions.recurrences import Averages, DayAverages, DecimalAverage, Macd, Rsi, trunc_half_up
from helpers import half_up, slow_ema, slow_macd, slow_rsi, wave


def in_pieces(recurrence, values, sizes):
    """Outputs when the values are summarised, carried and replayed piece by piece."""
    state, at, outputs, carried = recurrence.start(), 0, None, recurrence.start()
    for size in sizes:
        piece = values[at : at + size]
        at += size
        got, _ = recurrence.run(piece, carried)
        outputs = got if outputs is None else [a + b for a, b in zip(outputs, got)]
        present = [v for v in piece if v is not None]
        head, tail = present[: recurrence.head], present[recurrence.head :]
        _, state = recurrence.run(head, carried)
        carried = recurrence.after(state, recurrence.rest(tail, head[-1])) if tail else state
    return outputs


def close(a, b):
    if a is None or b is None:
        return a is b
    return abs(a - b) <= 1e-9 * max(1, abs(a))  # of doubles


@pytest.mark.parametrize("n", [6, 7, 8, 19, 20, 21])
def test_mean_start(n):
    values = wave(n)
    (fast, slow), _ = Averages([7, 20]).run(values, Averages([7, 20]).start())
    assert fast == slow_ema(values, 7)
    assert slow == slow_ema(values, 20)
    assert [v is None for v in fast] == [i < 6 for i in range(n)]


CUTS = ([1000], [7] * 143, [3] * 334, [200] * 5, [70, 1, 929], [64, 65, 871], [500, 500])
SERIES = {
    "wave": wave(1000), "0.125": [0.125] * 1000, "0.9998": [0.9998] * 1000, "1.1": [1.1] * 1000, "1.005": [1.005] * 1000,
    "noise, then flat": wave(300) + [1.1] * 700, "flat, then noise": [0.9998] * 500 + wave(500), "small": [3e-9, 7e-9] * 500,
}


@pytest.mark.parametrize("values", SERIES.values(), ids=SERIES)
def test_pieces_equal_one_pass(values):
    """To the last bit, however the series is cut; and near the plain fold in doubles."""
    for fold in (Averages([7, 20]), Averages([7, 20], "first"), Macd(), Rsi()):
        whole = fold.run(values, fold.start())[0]
        for sizes in CUTS:
            assert in_pieces(fold, values, sizes) == whole
    pairs = [(v, values[0]) for v in values]
    whole = DecimalAverage(7).run(pairs, DecimalAverage(7).start())[0]
    for sizes in CUTS:
        state, at, out = [""], 0, []
        for size in sizes:
            piece, at = pairs[at : at + size], at + size
            out += DecimalAverage(7).run(piece, state)[0][0]
            _, end = DecimalAverage(7).run(piece[:64], state)
            state = DecimalAverage(7).after(end, DecimalAverage(7).rest(piece[64:])) if piece[64:] else end
        assert out == whole[0]
    fast, slow = Averages([7, 20]).run(values, Averages([7, 20]).start())[0]
    assert all(map(close, fast, slow_ema(values, 7))) and all(map(close, slow, slow_ema(values, 20)))
    for got, want in zip(Macd().run(values, Macd().start())[0], slow_macd(values)):
        assert all(map(close, got, want))
    if len(set(values)) > 2:
        assert Rsi().run(values, Rsi().start())[0][0] == slow_rsi(values)


@pytest.mark.parametrize("price", [0.125, 0.9998, 1.1, 1.005, 60_000.01])
def test_flat_prices_come_to_a_stand(price):
    (fast, slow), _ = Averages([7, 20]).run([price] * 300, Averages([7, 20]).start())
    assert set(fast[110:]) == set(slow[110:]) == {price}


prices = st.one_of(st.none(), st.integers(1, 10_000).map(lambda c: c / 100))


@settings(max_examples=60, deadline=None)
@given(st.lists(prices, min_size=1, max_size=260), st.integers(1, 120))
def test_any_cut_gives_the_same(values, size):
    sizes = [size] * (len(values) // size + 1)
    for fold in (Averages([7, 20]), Macd(), Rsi()):
        assert in_pieces(fold, values, sizes) == fold.run(values, fold.start())[0]


def test_rests_in_a_row_amount_to_one():
    values = wave(300)
    for seed in ("sma", "first"):
        fold = Averages([7, 20], seed)
        parts = [fold.rest(values[a : a + 100]) for a in (0, 100, 200)]
        joined = fold.then(fold.then(parts[0], parts[1]), parts[2])
        assert all(abs(int(a) - int(b)) < 1 << 40 for a, b in zip(joined, fold.rest(values)))


def test_nulls_leave_the_state_alone():
    values = wave(40)
    holed = values[:10] + [None] + values[10:25] + [None, None] + values[25:]
    (fast, _), _ = Averages([7, 20]).run(holed, Averages([7, 20]).start())
    assert fast[10] is None
    assert all(map(close, [v for i, v in enumerate(fast) if holed[i] is not None], slow_ema(values, 7)))


@pytest.mark.parametrize("values, last", [
    ([1, 2, 3, 4, 5, 6, 7], 100.0),
    ([7, 6, 5, 4, 3, 2, 1], 0.0),
    ([5] * 7, 100.0),
])
def test_rsi_extremes(values, last):
    (out,), _ = Rsi().run([float(v) for v in values], Rsi().start())
    assert out == [None] * 6 + [last]


def test_rounding_cuts_toward_zero():
    assert trunc_half_up(-1.239, 2) == -1.23
    assert trunc_half_up(1.235, 2) == half_up(1.235, 2)


def test_decimal_average_starts_at_the_given_value():
    fold = DecimalAverage(7)
    (out,), state = fold.run([(10.0, 1.43), (20.0, 4.29)], fold.start())
    # 0.25 * 20 + 0.75 * 1.43 = 6.0725
    assert out == [1.43, 6.07] and Decimal(state[0]) == Decimal("6.0725")
    with pytest.raises(ValueError):
        fold.run([(10.0, None)], fold.start())


def many_series():
    """Flat, noisy, mixed, small, large and signed ones, with chunk borders at all sorts of places."""
    draw = random.Random(3)
    steps, at = [], 60_000.0
    for _ in range(1500):
        at = round(at + draw.gauss(0, 5), 2)
        steps.append(at)
    return {
        **SERIES, "walk": steps, "flat": [1.1] * 1500, "signed": [draw.gauss(0, 1) for _ in range(1500)],
        "below zero": [-draw.random() * 1e9 for _ in range(1500)], "beyond lanes": [draw.random() * 1e15 for _ in range(300)],
        "beneath lanes": [draw.random() * 1e-40 for _ in range(300)], "two prices": [float(draw.randrange(2)) for _ in range(1500)],
    }


@pytest.mark.parametrize("values", many_series().values(), ids=many_series())
def test_many_at_once_equal_one_by_one(values):
    cuts = [0, 70, 134, 135, *range(235, len(values), 217), len(values)]
    begins, ends = cuts[:-1], cuts[1:]
    for fold in (Averages([7, 20]), Averages([7, 20], "first"), Averages([200]), Macd(), Macd(3, 5, 2)):
        heads = [min(b + fold.head, e) for b, e in zip(begins, ends)]
        state, states = fold.start(), []
        for b, h, e, rest in zip(begins, heads, ends, fold.rest_all(np.array(values), heads, ends)):
            assert (rest is None) == (h == e)
            states.append(state)
            state = fold.run(values[b:h], state)[1]
            state = state if rest is None else fold.after(state, rest)
        for got, want in zip(fold.run_all(np.array(values), begins, ends, states), fold.run(values, fold.start())[0]):
            assert [None if x != x else x for x in got.tolist()] == want


@pytest.mark.parametrize("values", many_series().values(), ids=many_series())
@pytest.mark.parametrize("period", [1, 2, 6, 14])
def test_strength_in_doubles_equals_decimals(values, period):
    fold = Rsi(period)
    holed = [None if i % 41 == 40 else v for i, v in enumerate(values)] + values[-1:] * 2500
    want = fold.run(holed, fold.start())[0]
    assert fold.outputs(holed, fold.start()) == want
    at = 150
    state = fold.run(holed[:at], fold.start())[1]
    assert fold.outputs(holed[at:], state)[0] == want[0][at:]
    # the last values of a long stretch stand for all of it
    tail = [v for v in holed[at:] if v is not None]
    end = fold.after(state, fold.rest(tail, float(state[3])))
    more = wave(50)
    assert fold.run(more, end)[0][0] == fold.run(tail + more, state)[0][0][len(tail):]


def test_a_day_stands_for_itself_or_is_kept():
    draw, fold = random.Random(5), DayAverages([7, 20], 4)
    rounded = lambda state: [state[0], trunc_half_up(state[1], 4), state[2], trunc_half_up(state[3], 4)]
    spoken, kept = 0, 0
    for day in range(300):
        base = draw.choice([0.01, 1.0, 3000.0, 1e8])
        values = [None if draw.random() < 0.01 else round(base * draw.uniform(0.9, 1.1), 6) for _ in range(draw.choice([5, 96, 700, 1440]))]
        found = fold.guess(values)
        if found is None:
            kept += len(values) > 600
            continue
        spoken += 1
        for start in (fold.start(), [7.0, base, 0.0, 0.0], [7.0, 0.0, 20.0, 5e8], [7.0, -1e9, 20.0, 1e9], [7.0, 1e11, 20.0, -3e10]):
            assert rounded(fold.after(start, found)) == rounded(fold.run(values, start)[1])
    assert spoken > 100 and kept < 10  # only days that end too near a tie
    assert fold.guess([]) is None and fold.guess([None]) is None and fold.guess([1.0] * 50) is None


def test_infinite_values_count_as_missing():
    inf = float("inf")
    for fold in (Averages([7, 20]), Macd(), Rsi()):
        assert fold.run([1.0, inf, 2.0, -inf], fold.start()) == fold.run([1.0, None, 2.0, None], fold.start())
