import pytest

from candlemill.operators import pattern_one, pattern_three, pattern_two
from candlemill.operators.chunks import SPAN
from helpers import DAY_0, bar, bars, by_bar, slow_ema, half_up, wave
from datetime import timedelta

FALLING = [200.0 - 2 * i for i in range(30)]   # downtrend from the 20th bar on
RISING = [100.0 + 2 * i for i in range(30)]


def after(spark, closes, shapes, day=DAY_0):
    """Quiet bars at ``closes`` and then ``shapes`` of (open, high, low, close)."""
    rows = [bar("A", i, c, c, day=day) for i, c in enumerate(closes)]
    for i, shape in enumerate(shapes):
        o, h, low, c = map(float, shape)
        rows.append(bar("A", len(closes) + i, o, c, h, low, day))
    return bars(spark, rows)


def last(df):
    found = by_bar(df, "pattern")
    return found[max(found)]


@pytest.mark.parametrize("shape, label", [
    ((141.0, 142.25, 139.0, 142.0), True),       # lower shadow 2x, upper a quarter: both just in
    ((141.0, 142.26, 139.0, 142.0), False),
    ((141.0, 142.25, 139.01, 142.0), False),
    ((141.0, 141.0, 139.0, 141.0), False),       # no body
])
def test_hammer_and_hanging_man(spark, shape, label):
    assert last(pattern_one(after(spark, FALLING, [shape]))) == ("hammer" if label else None)
    up = tuple(x + 17 for x in shape)
    assert last(pattern_one(after(spark, RISING, [up]))) == ("hanging man" if label else None)


def test_no_pattern_without_a_trend(spark):
    assert last(pattern_one(after(spark, FALLING[:18], [(165.0, 166.0, 160.0, 166.0)]))) is None


@pytest.mark.parametrize("second, label", [
    ((138.9, 141, 138, 140.1), True),
    ((139.0, 141, 138, 140.1), False),           # opens at the close before
    ((138.9, 141, 138, 140.0), False),           # closes at the open before
])
@pytest.mark.parametrize("scope, on", [
    ("day", "rounded"), ("continuous", "rounded"), ("continuous", "raw"),
])
def test_engulfing(spark, second, label, scope, on):
    first = (140.0, 140.0, 139.0, 139.0)
    got = pattern_two(after(spark, FALLING, [first, second]), scope=scope, on=on)
    assert last(got) == ("bullish engulfing" if label else None)
    mirror = [tuple(300 - x for x in (o, low, h, c)) for o, h, low, c in (first, second)]
    got = pattern_two(after(spark, RISING, mirror), scope=scope, on=on)
    assert last(got) == ("bearish engulfing" if label else None)


def test_a_day_starts_without_a_bar_before_in_day_scope_only(spark):
    rows = [bar("A", i, c, c) for i, c in enumerate(FALLING)] + [bar("A", 30, 140.0, 139.0)]
    rows.append(bar("A", 31, 138.9, 140.1, day=DAY_0 + timedelta(days=1)))
    df = bars(spark, rows)
    assert last(pattern_two(df, scope="day")) is None
    assert last(pattern_two(df, scope="continuous")) == "bullish engulfing"
    assert last(pattern_two(df, scope="continuous", span=5)) == "bullish engulfing"


BIG_RED = (150.0, 150.0, 140.0, 140.0)


@pytest.mark.parametrize("middle, third, label", [
    ((139.0, 139, 134, 134.0), (139.0, 146, 139, 145.0), "morning star"),        # half the body
    ((139.0, 139, 133.9, 133.9), (139.0, 146, 139, 145.0), None),
    ((139.0, 139, 134, 134.0), (139.0, 146, 139, 144.9), None),                  # below the middle
    ((140.0, 140, 136, 136.0), (139.0, 146, 139, 145.0), None),                  # opens at the close
    ((139.0, 140, 130, 138.9), (139.0, 146, 139, 145.0), "morning star"),        # both: plain wins
])
def test_stars(spark, middle, third, label):
    got = pattern_three(after(spark, FALLING, [BIG_RED, middle, third]))
    assert last(got) == label
    mirror = [tuple(300 - x for x in (o, low, h, c)) for o, h, low, c in (BIG_RED, middle, third)]
    got = pattern_three(after(spark, RISING, mirror), span=7)
    assert last(got) == (label and label.replace("morning", "evening"))


def test_doji_star_when_the_first_body_is_small(spark):
    shapes = [(140.2, 141, 139, 140.0), (139.0, 142, 138, 139.3), (139.5, 141, 139, 140.5)]
    assert last(pattern_three(after(spark, FALLING, shapes))) == "morning doji star"
    wide = [shapes[0], (139.0, 141, 138, 139.4), shapes[2]]
    assert last(pattern_three(after(spark, FALLING, wide))) is None
    mirror = [tuple(300 - x for x in (o, low, h, c)) for o, h, low, c in shapes]
    assert last(pattern_three(after(spark, RISING, mirror))) == "evening doji star"


def test_against_brute_force_over_chunks(spark):
    opens, closes = wave(300, 3), wave(300, 4)
    rows = [bar("A", i, o, c) for i, (o, c) in enumerate(zip(opens, closes))]
    e7 = [half_up(v, 4) for v in slow_ema(closes, 7)]
    e20 = [half_up(v, 4) for v in slow_ema(closes, 20)]
    want = {}
    for i in range(300):
        label = None
        if i and e20[i] is not None:
            o1, c1, o2, c2 = opens[i - 1], closes[i - 1], opens[i], closes[i]
            if e7[i] < e20[i] and c1 < o1 and c2 > o2 and o2 < c1 and c2 > o1:
                label = "bullish engulfing"
            if e7[i] > e20[i] and c1 > o1 and c2 < o2 and o2 > c1 and c2 < o1:
                label = "bearish engulfing"
        want[("A", i)] = label
    for span in (16, 100, SPAN):
        got = pattern_two(bars(spark, rows).repartition(3), scope="continuous", span=span)
        assert by_bar(got, "pattern") == want
    assert len({v for v in want.values()}) == 3
