"""Recurrences that indicators are made of: small folds over one value per row.

Each has

* ``start()``            the state before any value
* ``run(values, state)`` one output list per output name, and the state after the last value; a null
  value gives null outputs and leaves the state alone
* ``rest(values, last)`` what the values do to *any* settled state, as a short list of numbers (every
  recurrence here is linear once it has warmed up); ``last`` is the value before them
* ``after(state, rest)`` the state that ``rest`` leads to

A chunk is summarised as its first ``HEAD`` values plus the ``rest`` of the others. The head carries any
warm-up through, so summaries can be applied in order without the rows.

A state reached through summaries and one reached value by value are two sums of the same terms, and in
doubles they would differ in a last place, which on flat prices never goes away and decides ties. So levels are
fixed-point integers of ``SHIFT`` binary places: the two differ some sixty decimal places down, and what
comes out is rounded to a double once. A flat series comes to a stand in a few steps, and no result depends on how
rows are cut.

State is a flat list of strings, which hold integers or decimals of any length.

``run`` and ``rest`` take one series. ``run_all`` and ``rest_all`` take many and do the same with machine words, the series
cut into lanes that are stepped together (see ``limbs``); what the first values need, and numbers that do not fit
there, go through ``run`` and ``rest``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext
from math import ceil, floor, isfinite, log10, nan
from sys import maxsize

import numpy as np

from candlemill.functions import limbs
from candlemill.functions.limbs import SHIFT, SHOWN

HEAD = 64
ONE, SCALE = 1 << SHIFT, 2.0**SHIFT


def missing(x) -> bool:
    """Null, NaN or infinite."""
    return x is None or not isfinite(x)


def trunc_half_up(x: float, digits: int) -> float:
    factor = 10**digits
    return float(int(x * factor + 0.5)) / factor


def fixed(x: float) -> int:
    """A double with ``SHIFT`` binary places; exact unless it is below 2^-147 or so. (Scaling by a power of two is.)"""
    return int(x * SCALE)


def level_of(text: str) -> int:
    """A level as it is kept in a state, or a double in text, as Spark casts it."""
    return int(text) if text.lstrip("-").isdigit() else fixed(float(text))


def times(coefficient: int, level: int) -> int:
    return coefficient * level >> SHIFT


class Average:
    """One exponential average, started from the mean of its first ``period`` values.

    Early levels are short decimals, which are often ties of a rounding, and the last places of a fold in doubles
    decide those. So the first values (``settled`` of them) are folded in doubles, the plain way; from then on
    the weight of a new value being 2 / (period + 1), a step is (the level times (period - 1) plus twice the value) /
    (period + 1).
    """

    def __init__(self, period: int):
        self.period, self.keep, self.whole = period, period - 1, period + 1
        self.weight, self.settled = 2 / (period + 1), max(HEAD, period)

    def early(self, x: float, count: int, level: float) -> float:
        """The level after one of the first values; before the mean is full, a sum."""
        if count >= self.period:
            return (x - level) * self.weight + level
        return (level + x) / self.period if count + 1 == self.period else level + x

    def run(self, values, count, level):
        """``values`` and the levels given out are fixed-point integers (or None)."""
        out, period, keep, whole, settled = [], self.period, self.keep, self.whole, self.settled
        for x in values:
            if x is None:
                out.append(None)
                continue
            if count >= settled:
                level = (keep * level + 2 * x) // whole
            else:
                level = fixed(self.early(x / ONE, count, level / ONE))
                count += 1
            out.append(level if count >= period else None)
        return out, count, level

    def rest(self, values):
        a, b, keep, whole = ONE, 0, self.keep, self.whole
        for x in values:
            a, b = keep * a // whole, (keep * b + 2 * x) // whole
        return [a, b]


class FirstValueAverage(Average):
    """Started from the first value, with no warm-up."""

    def __init__(self, period: int):
        super().__init__(period)
        self.period = 1

    def early(self, x, count, level):
        return self.weight * x + (1 - self.weight) * level if count else x


def fixed_values(values) -> list[int | None]:
    return [None if missing(x) else int(x * SCALE) for x in values]


def doubles(levels) -> list[float | None]:
    """Levels with ``SHOWN`` binary places, as the nearest doubles: what is below those places depends on the cut."""
    half, drop, unit = 1 << SHIFT - SHOWN - 1, SHIFT - SHOWN, 2.0**-SHOWN
    return [None if x is None else float(x + half >> drop) * unit for x in levels]


class Laned:
    """Many series at once. ``averages`` are the averages a step moves, in the order of their levels in a state (which holds
    the values seen and the level of each); ``advance`` moves their levels by a value and returns what comes out."""

    shown = 0

    def _fits(self, values: np.ndarray, states: Sequence[Sequence[str]] = ()) -> bool:
        """Whether values and levels are numbers that lanes can hold."""
        most = int(limbs.LARGEST) << SHIFT
        small = all(abs(level_of(x)) < most for state in states for x in state[1::2])
        return small and limbs.fits(values) and all(a.whole < limbs.WIDEST for a in self.averages)

    def _zero(self, lanes: limbs.Lanes) -> list[list[int]]:
        """What each lane does to any settled state."""
        levels = [np.zeros((limbs.DIGITS + 1, len(lanes.begin)), np.int64) for _ in self.averages]
        lanes.fold(levels, self.advance)
        ends = zip(*[limbs.to_integers(x) for x in levels])
        factors = {n: [int(x) for x in self.rest([0.0] * n)] for n in set(lanes.length.tolist())}
        return [self.with_levels(factors[n], end) for n, end in zip(lanes.length.tolist(), ends)]

    def rest_all(self, values: np.ndarray, begins: Sequence[int], ends: Sequence[int]) -> list[list[str] | None]:
        """``rest`` of values[begin:end] for each series, None for an empty one. No value is missing."""
        if not self._fits(values):
            return [self.rest(values[b:e].tolist()) if e > b else None for b, e in zip(begins, ends)]
        found: list[list[str] | None] = [None] * len(begins)
        full = [i for i in range(len(begins)) if ends[i] > begins[i]]
        for some in limbs.groups([ends[i] - begins[i] for i in full]):
            here = [full[k] for k in some]
            lanes = limbs.Lanes(values, [begins[i] for i in here], [ends[i] for i in here])
            rests = self._zero(lanes)
            for i, mine in zip(here, lanes.of_series):
                whole = rests[mine[0]]
                for lane in mine[1:]:
                    whole = self.joined(whole, rests[lane])
                found[i] = [str(x) for x in whole]
        return found

    def run_all(self, values: np.ndarray, begins: Sequence[int], ends: Sequence[int], states: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """The outputs of ``run`` for each series from its state, NaN for none. No value is missing."""
        out = [np.full(len(values), np.nan) for _ in range(self.shown)]
        laned = self._fits(values, states)
        rest_of = []
        for i, (b, e, state) in enumerate(zip(begins, ends, states)):
            settled = all(int(n) >= a.settled for n, a in zip(state[::2], self.averages))
            early = b if settled and laned else min(b + self.head, e) if laned else e
            if early > b:
                found, state = self.run(values[b:early].tolist(), state)
                for column, one in zip(out, found):
                    column[b:early] = [np.nan if x is None else x for x in one]
            if e > early:
                rest_of.append((early, e, [level_of(x) for x in state[1::2]]))
        for some in limbs.groups([e - b for b, e, _ in rest_of]):
            here = [rest_of[k] for k in some]
            lanes = limbs.Lanes(values, [b for b, _, _ in here], [e for _, e, _ in here])
            rests, starts = self._zero(lanes), [None] * len(lanes.begin)
            for (_, _, levels), mine in zip(here, lanes.of_series):
                for lane in mine:
                    starts[lane] = levels
                    levels = self.moved(levels, rests[lane])
            opened = [limbs.of_integers(x) for x in zip(*starts)]
            for column, one in zip(out, lanes.fold(opened, self.advance, self.shown)):
                lanes.spread(one, column)
        return out


class Averages(Laned):
    """Several exponential averages of one value. State per average: values seen, level."""

    state_type = "string"

    def __init__(self, periods, seed: str = "sma", head: int = HEAD):
        kind = {"sma": Average, "first": FirstValueAverage}[seed]
        self.parts = self.averages = [kind(p) for p in periods]
        self.head, self.shown = max(head, *periods), len(self.parts)

    def advance(self, levels, twice):
        for part, level in zip(self.parts, levels):
            limbs.step(level, twice, part.keep, part.whole)
        return levels

    def start(self):
        return ["0", "0"] * len(self.parts)

    def run(self, values, state):
        values, outputs, end = fixed_values(values), [], []
        for i, part in enumerate(self.parts):
            out, count, level = part.run(values, int(state[2 * i]), level_of(state[2 * i + 1]))
            outputs.append(doubles(out))
            end += [str(count), str(level)]
        return outputs, end

    def rest(self, values, last=None):
        values = fixed_values(values)
        return [str(n) for part in self.parts for n in part.rest(values)]

    @staticmethod
    def with_levels(factors, levels):
        return [n for a, b in zip(factors[::2], levels) for n in (a, b)]

    @staticmethod
    def joined(one, two):
        pairs = zip(one[::2], one[1::2], two[::2], two[1::2])
        return [n for a1, b1, a2, b2 in pairs for n in (times(a1, a2), times(a2, b1) + b2)]

    def then(self, first, second):
        """The rest that ``first`` and then ``second`` amount to."""
        return [str(n) for n in self.joined([int(n) for n in first], [int(n) for n in second])]

    @staticmethod
    def moved(levels, rest):
        return [times(a, level) + b for level, a, b in zip(levels, rest[::2], rest[1::2])]

    def after(self, state, rest):
        levels = self.moved([level_of(x) for x in state[1::2]], [int(n) for n in rest])
        return [x for count, level in zip(state[::2], levels) for x in (count, str(level))]


class DayAverages:
    """Exponential averages that are rounded at the end of each day and go on from there.

    Levels become short decimals overnight, so ties are common and the plain fold's own last places decide
    them. These are therefore plain doubles, value by value, and days are never cut. State per average: values seen, level.

    What a day's end owes to its start shrinks with every value, so after some hundreds of values the rounded end is
    the same whatever it was. ``guess`` folds a day from nothing and from both ends of ``REACH``; where the latter round alike,
    with room to spare for what doubles lose, the day stands for itself by these ends. The others, short days and
    the rare ones that end too near the middle between two decimals, are kept as their values.
    """

    state_type = "double"
    head = maxsize
    REACH = 1e9  # start levels that ``guess`` allows for
    MOST_LOST = 1e-6  # of a unit of the last decimal, by what a start level still adds

    def __init__(self, periods, digits: int | None = None):
        self.periods, self.digits = list(periods), digits

    def guess(self, values) -> list[float] | None:
        """For each average: values seen and level from a fresh start, the level from any other, and how much of that is left; or None."""
        values = [x for x in values if not missing(x)]
        size = max((abs(x) for x in values), default=0.0)
        # far too short, or with decimals that doubles do not hold
        if self.digits is None or size > self.REACH or not values:
            return None
        unit = 10.0**self.digits
        if any(self.REACH * (1 - 2 / (p + 1)) ** len(values) * unit > self.MOST_LOST for p in self.periods):
            return None
        found = []
        _, fresh = self.run(values, self.start())
        _, low = self.run(values, [x for p in self.periods for x in (float(p), -self.REACH)])
        _, high = self.run(values, [x for p in self.periods for x in (float(p), self.REACH)])
        for i in range(len(self.periods)):
            a, b = sorted((low[2 * i + 1], high[2 * i + 1]))
            room = self.MOST_LOST / unit + 2.0**-51 * (self.periods[i] + 1) * size  # a few last places of each value that counts
            if trunc_half_up(a - room, self.digits) != trunc_half_up(b + room, self.digits):
                return None
            found += [fresh[2 * i], fresh[2 * i + 1], low[2 * i + 1], (1 - 2 / (self.periods[i] + 1)) ** len(values)]
        return found

    def after(self, state, rest):
        """The end of a day that ``guess`` speaks for."""
        end = []
        for i, period in enumerate(self.periods):
            seen, fresh, other, left = rest[4 * i : 4 * i + 4]
            if state[2 * i] >= period:
                seen, fresh = float(period), other
                if abs(state[2 * i + 1]) > self.REACH:
                    fresh += left * (state[2 * i + 1] + self.REACH)
            end += [seen, fresh]
        return end

    def start(self):
        return [0.0, 0.0] * len(self.periods)

    def run(self, values, state):
        outputs, end = [], []
        for i, period in enumerate(self.periods):
            count, level, weight, out = state[2 * i], state[2 * i + 1], 2 / (period + 1), []
            for x in values:
                if missing(x):
                    out.append(None)
                elif count >= period:
                    level = (x - level) * weight + level
                    out.append(level)
                else:
                    count, level = count + 1, level + x
                    if count == period:
                        level /= period
                    out.append(level if count == period else None)
            outputs.append(out)
            end += [float(count), float(level)]
        return outputs, end


class Macd(Laned):
    """MACD line, its signal and their difference. State: three averages (fast, slow, signal)."""

    state_type = "string"
    shown = 5

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.signal = Average(fast), Average(slow), Average(signal)
        self.averages = [self.fast, self.slow, self.signal]
        # the signal's first value comes with the slow average's
        self.head = max(self.fast.settled, self.slow.settled, max(fast, slow) + self.signal.settled)

    def start(self):
        return ["0"] * 6

    def run(self, values, state):
        values, state = fixed_values(values), [int(n) for n in state]
        fast, *end_fast = self.fast.run(values, *state[0:2])
        slow, *end_slow = self.slow.run(values, *state[2:4])
        line = [None if f is None or s is None else f - s for f, s in zip(fast, slow)]
        signal, *end_signal = self.signal.run(line, *state[4:6])
        histogram = [None if s is None else m - s for m, s in zip(line, signal)]
        end = [str(n) for n in (*end_fast, *end_slow, *end_signal)]
        return [doubles(x) for x in (fast, slow, line, signal, histogram)], end

    def rest(self, values, last=None):
        """The levels become fa * fast + fb and sa * slow + sb, and the signal
        own * signal + from_fast * fast + from_slow * slow + const."""
        f, s, g = self.fast, self.slow, self.signal
        fa, fb, sa, sb, own, from_fast, from_slow, const = ONE, 0, ONE, 0, ONE, 0, 0, 0
        for x in fixed_values(values):
            fa, fb = f.keep * fa // f.whole, (f.keep * fb + 2 * x) // f.whole
            sa, sb = s.keep * sa // s.whole, (s.keep * sb + 2 * x) // s.whole
            own = g.keep * own // g.whole
            from_fast = (g.keep * from_fast + 2 * fa) // g.whole
            from_slow = (g.keep * from_slow - 2 * sa) // g.whole
            const = (g.keep * const + 2 * (fb - sb)) // g.whole
        return [str(n) for n in (fa, fb, sa, sb, own, from_fast, from_slow, const)]

    def advance(self, levels, twice):
        fast, slow, signal = levels
        limbs.step(fast, twice, self.fast.keep, self.fast.whole)
        limbs.step(slow, twice, self.slow.keep, self.slow.whole)
        line = limbs.carried(fast - slow)
        limbs.step(signal, 2 * line, self.signal.keep, self.signal.whole)
        return fast, slow, line, signal, limbs.carried(line - signal)

    @staticmethod
    def with_levels(factors, levels):
        fa, _, sa, _, own, from_fast, from_slow, _ = factors
        return [fa, levels[0], sa, levels[1], own, from_fast, from_slow, levels[2]]

    @staticmethod
    def joined(one, two):
        fa1, fb1, sa1, sb1, own1, ff1, fs1, c1 = one
        fa2, fb2, sa2, sb2, own2, ff2, fs2, c2 = two
        return [
            times(fa1, fa2), times(fa2, fb1) + fb2, times(sa1, sa2), times(sa2, sb1) + sb2, times(own1, own2),
            times(own2, ff1) + times(ff2, fa1), times(own2, fs1) + times(fs2, sa1),
            times(own2, c1) + times(ff2, fb1) + times(fs2, sb1) + c2,
        ]

    @staticmethod
    def moved(levels, rest):
        fa, fb, sa, sb, own, from_fast, from_slow, const = rest
        fast, slow, signal = levels
        return [times(fa, fast) + fb, times(sa, slow) + sb,
                times(own, signal) + times(from_fast, fast) + times(from_slow, slow) + const]

    def after(self, state, rest):
        fast, slow, signal = self.moved([int(x) for x in state[1::2]], [int(n) for n in rest])
        return [state[0], str(fast), state[2], str(slow), state[4], str(signal)]


PRECISION = 28  # significant digits of the decimal recurrences
GUARDED = 64  # digits they are carried with, so that the 28 do not depend on how rows are cut
CENT = Decimal("0.01")


CUT = Context(prec=PRECISION)


def _cents(x: Decimal) -> float:
    return float(CUT.plus(x).quantize(CENT, ROUND_HALF_UP, CUT))


class Rsi:
    """Relative strength with Wilder's smoothing, in decimals, rounded half up to two places.

    State: differences seen, mean gain, mean loss (sums while warming up), last value.
    """

    state_type = "string"
    LEAST = 1e-280  # of a mean in doubles

    def __init__(self, period: int = 6):
        self.period = period
        self.head = max(HEAD, period + 1)

    def start(self):
        return ["0", "0", "0", ""]

    @staticmethod
    def _moves(difference):
        zero = Decimal(0)
        if difference > 0:
            return Decimal(difference), zero
        return zero, (Decimal(-difference) if difference < 0 else zero)

    def run(self, values, state):
        count, last = int(state[0]), (float(state[3]) if state[3] else None)
        gain, loss = Decimal(state[1]), Decimal(state[2])
        period, out = self.period, []
        with localcontext(Context(prec=GUARDED)):
            for x in values:
                if missing(x):
                    out.append(None)
                    continue
                difference = None if last is None else x - last
                last = x
                if difference is None:
                    out.append(None)
                    continue
                up, down = self._moves(difference)
                if count >= period:
                    gain = (gain * (period - 1) + up) / period
                    loss = (loss * (period - 1) + down) / period
                else:
                    count, gain, loss = count + 1, gain + up, loss + down
                    if count < period:
                        out.append(None)
                        continue
                    gain, loss = gain / period, loss / period
                out.append(self._index(gain, loss))
        return [out], [str(count), str(gain), str(loss), "" if last is None else repr(float(last))]

    @staticmethod
    def _index(gain, loss):
        if loss == 0:
            return 100.0
        if gain == 0:
            return 0.0
        strength = CUT.divide(CUT.plus(gain), CUT.plus(loss))
        return _cents(CUT.subtract(100, CUT.divide(100, CUT.add(1, strength))))

    def outputs(self, values, state):
        """The outputs of ``run``, in doubles after the first; in decimals again where a double is too near the middle
        between two cents to say, or a mean too small to keep its places."""
        early = 0 if int(state[0]) >= self.period else min(len(values), self.head)
        (out,), state = self.run(values[:early], state)
        if int(state[0]) < self.period:
            return [out + self.run(values[early:], state)[0][0]]
        gain, loss, last = float(state[1]), float(state[2]), float(state[3])
        if (gain < self.LEAST and Decimal(state[1])) or (loss < self.LEAST and Decimal(state[2])):
            gain = nan
        done, keep, period = early, self.period - 1, self.period
        for i in range(early, len(values)):
            x = values[i]
            if missing(x):
                out.append(None)
                continue
            move, last = x - last, x
            gain = (gain * keep + (move if move > 0 else 0.0)) / period
            loss = (loss * keep - (move if move < 0 else 0.0)) / period
            if 0 < gain < self.LEAST or 0 < loss < self.LEAST:
                gain = nan  # from here on every value goes the other way
            cents = gain if gain != gain else 10_000.0 if loss == 0 else 10_000 - 10_000 / (1 + gain / loss)
            if cents == cents and 1e-7 < (cents + 0.5) % 1 < 1 - 1e-7:
                out.append(floor(cents + 0.5) / 100)
            else:
                (found,), state = self.run(values[done : i + 1], state)
                out.append(found[-1])
                done = i + 1
        return [out]

    def rest(self, values, last):
        """Of a long series the last values say it all, unless one of the means has nearly gone by its end."""
        tail = ceil(-80 / log10((self.period - 1) / self.period)) if self.period > 1 else 1
        if len(values) > 2 * tail:
            before = values[-tail - 1]
            keep, gain, loss, end = self._rest(values[-tail:], before)
            most = max(abs(b - a) for a, b in zip([last, *values[: -tail - 1]], values[:-tail]))
            if min(gain, loss) >= Decimal(most) * Decimal("1e-12"):
                with localcontext(Context(prec=GUARDED)):
                    keep = (Decimal(self.period - 1) / self.period) ** len(values)
                return [str(keep), str(gain), str(loss), end]
        keep, gain, loss, end = self._rest(values, last)
        return [str(keep), str(gain), str(loss), end]

    def _rest(self, values, last):
        keep, gain, loss, period = Decimal(1), Decimal(0), Decimal(0), self.period
        with localcontext(Context(prec=GUARDED)):
            for x in values:
                up, down = self._moves(x - last)
                last = x
                keep = keep * (period - 1) / period
                gain = (gain * (period - 1) + up) / period
                loss = (loss * (period - 1) + down) / period
        return keep, gain, loss, repr(float(last))

    def after(self, state, rest):
        with localcontext(Context(prec=GUARDED)):
            keep = Decimal(rest[0])
            gain = keep * Decimal(state[1]) + Decimal(rest[1])
            loss = keep * Decimal(state[2]) + Decimal(rest[2])
        return [state[0], str(gain), str(loss), rest[3]]


class DecimalAverage:
    """Exponential average in decimals whose first output is a given value, two places half up.

    Takes pairs (value, first output); State: the level, empty before the first value.
    """

    state_type = "string"
    head = HEAD

    def __init__(self, period: int = 7):
        self.period = period

    def _alpha(self):
        return Decimal(2) / Decimal(self.period + 1)

    def start(self):
        return [""]

    def run(self, pairs, state):
        out, level = [], (Decimal(state[0]) if state[0] else None)
        with localcontext(Context(prec=GUARDED)):
            alpha = self._alpha()
            for pair in pairs:
                if missing(pair[0]):
                    out.append(None)
                    continue
                if level is None:
                    if missing(pair[1]):
                        raise ValueError("the start column is null where the first value is not")
                    level = Decimal(str(pair[1]))
                else:
                    level = alpha * Decimal(str(pair[0])) + (1 - alpha) * level
                out.append(_cents(level))
        return [out], ["" if level is None else str(level)]

    def rest(self, pairs, last=None):
        a, b = Decimal(1), Decimal(0)
        with localcontext(Context(prec=GUARDED)):
            alpha = self._alpha()
            for x, _ in pairs:
                a, b = a * (1 - alpha), alpha * Decimal(str(x)) + (1 - alpha) * b
        return [str(a), str(b)]

    def after(self, state, rest):
        with localcontext(Context(prec=GUARDED)):
            return [str(Decimal(rest[0]) * Decimal(state[0]) + Decimal(rest[1]))]
