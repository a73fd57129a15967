"""Small inputs, and the folds the operators must agree with, written out the slow way."""

from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal, getcontext

getcontext().prec = 28
BAR = "symbol string, group_id long, group_date string, open_time long, open_price double, " \
      "high_price double, low_price double, close_price double, volume double, close_time long, " \
      "landing_date date"
DAY_0 = date(2025, 10, 1)


def bar(symbol, group_id, o, c, h=None, low=None, day=DAY_0):
    top = max(x for x in (o, c, 0.0) if x is not None)
    bottom = min(x for x in (o, c, top) if x is not None)
    return (symbol, group_id, f"g{group_id}", group_id * 900_000_000, o,
            top if h is None else h, bottom if low is None else low, c, 1.0,
            group_id * 900_000_000 + 1, day)


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR)


def closes(spark, values, symbol="A", start=0, step=1, day=DAY_0):
    return bars(spark, [bar(symbol, start + i * step, v, v, day=day) for i, v in enumerate(values)])


def by_bar(df, *names):
    """{(symbol, group_id): value or tuple}"""
    rows = df.select("symbol", "group_id", *names).collect()
    return {(r[0], r[1]): (r[2] if len(names) == 1 else tuple(r[2:])) for r in rows}


def in_order(df, name, symbol="A"):
    return [v for (s, _), v in sorted(by_bar(df, name).items()) if s == symbol]


def half_up(x, digits):
    return None if x is None else float(int(x * 10**digits + 0.5)) / 10**digits


def slow_ema(values, period):
    out, seen, level, k = [], [], None, 2 / (period + 1)
    for v in values:
        if v is None:
            out.append(None)
            continue
        if level is None:
            seen.append(v)
            if len(seen) == period:
                total = 0.0
                for s in seen:
                    total += s
                level = total / period
        else:
            level = (v - level) * k + level
        out.append(level)
    return out


def slow_macd(values, fast=12, slow=26, signal=9):
    f, s = slow_ema(values, fast), slow_ema(values, slow)
    line = [None if a is None or b is None else a - b for a, b in zip(f, s)]
    sig = slow_ema(line, signal)
    return f, s, line, sig, [None if b is None else a - b for a, b in zip(line, sig)]


def slow_rsi(values, period=6):
    out, moves, last, gain, loss = [], [], None, None, None
    for v in values:
        if last is None:
            last = v
            out.append(None)
            continue
        move, last = Decimal(v - last), v
        if gain is None:
            moves.append(move)
            if len(moves) < period:
                out.append(None)
                continue
            gain = sum((m for m in moves if m > 0), Decimal(0)) / period
            loss = sum((-m for m in moves if m < 0), Decimal(0)) / period
        else:
            gain = (gain * (period - 1) + max(move, Decimal(0))) / period
            loss = (loss * (period - 1) + max(-move, Decimal(0))) / period
        if loss == 0:
            rsi = Decimal(100)
        elif gain == 0:
            rsi = Decimal(0)
        else:
            rsi = 100 - 100 / (1 + gain / loss)
        out.append(float(rsi.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)))
    return out


def slow_day_ema(days, period, digits=4):
    """days: {date: closes}. Each day starts from the rounded end of the day before, or afresh."""
    out, ends, k = {}, {}, 2 / (period + 1)
    for day in sorted(days):
        level, seen, found = ends.get(day - timedelta(days=1)), [], []
        for v in days[day]:
            if v is None:
                found.append(None)
                continue
            if level is None:
                seen.append(v)
                if len(seen) == period:
                    level = sum(seen) / period
            else:
                level = (v - level) * k + level
            found.append(half_up(level, digits))
        out[day], ends[day] = found, (found[-1] if found else None)
    return out


def wave(n, seed=1):
    """Deterministic prices that go up and down, two decimals."""
    x, out = seed * 7919 % 10007, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(round(50 + (x % 10000) / 100, 2))
    return out
