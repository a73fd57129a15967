"""The same results in plain SQL, for DuckDB over the supplied tables."""

from __future__ import annotations

HOUR = 3_600_000_000
QUARTER = 900_000_000
DAY = 86_400_000_000

TRADES = """t AS (
  SELECT event_id AS agg_trade_id, value AS price,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS quantity,
         epoch_us(ts) AS "timestamp", event_id % 2 = 0 AS is_buyer_maker, event_type AS symbol,
         CAST(ts AS DATE) AS landing_date
  FROM events)"""

ORDERS = """t AS (
  SELECT o_orderkey AS agg_trade_id, o_totalprice AS price, CAST(1 AS DOUBLE) AS quantity,
         epoch_us(o_orderdate) AS "timestamp", o_orderpriority AS symbol
  FROM orders)"""


def bars(us: int, keys: str = "symbol") -> str:
    start = f'make_timestamp(("timestamp" // {us}) * {us})'
    return f"""b AS (
  SELECT "timestamp" // {us} AS group_id, strftime({start}, '%Y-%m-%d %H:%M:%S') AS group_date,
         min("timestamp") AS open_time,
         first(price ORDER BY "timestamp", agg_trade_id) AS open_price,
         max(price) AS high_price, min(price) AS low_price,
         last(price ORDER BY "timestamp", agg_trade_id) AS close_price,
         sum(quantity) AS volume, max("timestamp") AS close_time, {keys}
  FROM t GROUP BY ALL)"""


NUMBERED = """n AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY group_id) AS rn FROM b)"""

BAR_COLUMNS = (
    "group_id, group_date, open_time, open_price, high_price, low_price, close_price, volume, "
    "close_time, symbol"
)


def k(period: int) -> str:
    return f"(CAST(2 AS DOUBLE) / {period + 1})"


def half_up(x: str, digits: int) -> str:
    return f"(trunc({x} * {10**digits} + 0.5) / {10**digits})"


def average(period: int, x: str, level: str, seen: str) -> str:
    """Next level of a mean-started average, from its level after ``seen`` values."""
    return (
        f"CASE WHEN {seen} >= {period} THEN ({x} - {level}) * {k(period)} + {level} "
        f"WHEN {seen} + 1 = {period} THEN ({level} + {x}) / {period} ELSE {level} + {x} END"
    )


EMA = f"""e AS (
  SELECT symbol, group_id, rn, close_price AS v7, close_price AS v20 FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.group_id, n.rn,
         {average(7, "n.close_price", "e.v7", "e.rn")},
         {average(20, "n.close_price", "e.v20", "e.rn")}
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


def with_ema(digits: int, raw: bool = False) -> str:
    """``x``: bars with averages, trend and the two bars before."""
    e7, e20 = half_up("e.v7", digits), half_up("e.v20", digits)
    fast, slow = ("v7", "v20") if raw else ("ema7", "ema20")
    return f"""y AS (
  SELECT n.*, CASE WHEN e.rn >= 7 THEN {e7} END AS ema7, CASE WHEN e.rn >= 20 THEN {e20} END AS ema20,
         e.v7, CASE WHEN e.rn >= 20 THEN e.v20 END AS v20
  FROM n JOIN e ON n.symbol = e.symbol AND n.rn = e.rn),
x AS (
  SELECT *, CASE WHEN {fast} > {slow} THEN 'uptrend' WHEN {fast} < {slow} THEN 'downtrend' END AS trend,
         lag(open_price, 1) OVER w AS o2, lag(close_price, 1) OVER w AS c2,
         lag(high_price, 1) OVER w AS h2, lag(low_price, 1) OVER w AS l2,
         lag(open_price, 2) OVER w AS o1, lag(close_price, 2) OVER w AS c1
  FROM y WINDOW w AS (PARTITION BY symbol ORDER BY group_id))"""


ENGULFING = """CASE
    WHEN c2 < o2 AND close_price > open_price AND open_price < c2 AND close_price > o2
         AND trend = 'downtrend' THEN 'bullish engulfing'
    WHEN c2 > o2 AND close_price < open_price AND open_price > c2 AND close_price < o2
         AND trend = 'uptrend' THEN 'bearish engulfing' END"""

HAMMER = """CASE
    WHEN abs(close_price - open_price) > 0
     AND least(open_price, close_price) - low_price >= 2 * abs(close_price - open_price)
     AND high_price - greatest(open_price, close_price)
         <= CAST(0.25 AS DOUBLE) * abs(close_price - open_price)
    THEN CASE trend WHEN 'uptrend' THEN 'hanging man' WHEN 'downtrend' THEN 'hammer' END END"""

_MORNING = ("c1 < o1 AND c2 < c1 AND o2 < c1 AND close_price > open_price "
            "AND close_price >= (o1 + c1) / 2 AND trend = 'downtrend'")
_EVENING = ("c1 > o1 AND o2 > c1 AND c2 > c1 AND close_price < open_price "
            "AND close_price <= (o1 + c1) / 2 AND trend = 'uptrend'")
_SMALL = "abs(c2 - o2) <= CAST(0.5 AS DOUBLE) * abs(o1 - c1)"
_DOJI = "abs(c2 - o2) <= CAST(0.1 AS DOUBLE) * (h2 - l2)"
STARS = f"""CASE WHEN {_MORNING} AND {_SMALL} THEN 'morning star'
    WHEN {_EVENING} AND {_SMALL} THEN 'evening star'
    WHEN {_MORNING} AND {_DOJI} THEN 'morning doji star'
    WHEN {_EVENING} AND {_DOJI} THEN 'evening doji star' END"""

HOURLY = f"WITH RECURSIVE {TRADES}, {bars(HOUR)}, {NUMBERED}"
HOURLY_EMA = f"{HOURLY}, {EMA}"


def frame(of: str) -> str:
    """Sum over a bar and the six before it, added in their order."""
    lags = [f"coalesce(lag(close_price, {i}) OVER w, 0)" for i in range(6, 0, -1)]
    return f"(({' + '.join(lags)} + close_price) / {of})"


def two_places(x: str) -> str:
    """Rounded half up as a decimal text is: through the shortest text of the number."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


DAY_BARS = f"""WITH RECURSIVE {TRADES}, {bars(HOUR, "landing_date, symbol")}, {NUMBERED}"""


def _carried(period: int) -> str:
    seen, level = f"c{period}", f"v{period}"
    follows = f"n.landing_date = e.landing_date + 1 AND e.{seen} >= {period}"
    return f"""
    CASE WHEN n.landing_date = e.landing_date THEN e.{seen}
         WHEN {follows} THEN {period} ELSE 0 END AS {seen},
    CASE WHEN n.landing_date = e.landing_date THEN e.{level}
         WHEN {follows} THEN {half_up(f"e.{level}", 4)} ELSE 0 END AS {level}"""


DAY_EMA = f"""e AS (
  SELECT symbol, group_id, rn, landing_date, 1 AS c7, close_price AS v7, 1 AS c20, close_price AS v20
  FROM n WHERE rn = 1
  UNION ALL
  SELECT symbol, group_id, rn, landing_date,
         c7 + 1, {average(7, "close_price", "v7", "c7")},
         c20 + 1, {average(20, "close_price", "v20", "c20")}
  FROM (SELECT n.symbol, n.group_id, n.rn, n.landing_date, n.close_price,
               {_carried(7)}, {_carried(20)}
        FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)),
y AS (
  SELECT n.*, CASE WHEN c7 >= 7 THEN {half_up("v7", 4)} END AS ema7,
         CASE WHEN c20 >= 20 THEN {half_up("v20", 4)} END AS ema20
  FROM n JOIN e ON n.symbol = e.symbol AND n.rn = e.rn),
x AS (
  SELECT *, CASE WHEN ema7 > ema20 THEN 'uptrend' WHEN ema7 < ema20 THEN 'downtrend' END AS trend,
         lag(open_price, 1) OVER w AS o2, lag(close_price, 1) OVER w AS c2
  FROM y WINDOW w AS (PARTITION BY symbol, landing_date ORDER BY group_id))"""

RSI = f"""{HOURLY},
d AS (
  SELECT symbol, group_id, rn, close_price - lag(close_price) OVER (PARTITION BY symbol ORDER BY rn) AS d
  FROM n),
g AS (
  SELECT symbol, group_id, rn, CAST(0 AS DOUBLE) AS ag, CAST(0 AS DOUBLE) AS al FROM d WHERE rn = 1
  UNION ALL
  SELECT d.symbol, d.group_id, d.rn,
         CASE WHEN d.rn > 7 THEN (g.ag * 5 + greatest(d.d, 0)) / 6
              WHEN d.rn = 7 THEN (g.ag + greatest(d.d, 0)) / 6 ELSE g.ag + greatest(d.d, 0) END,
         CASE WHEN d.rn > 7 THEN (g.al * 5 + greatest(-d.d, 0)) / 6
              WHEN d.rn = 7 THEN (g.al + greatest(-d.d, 0)) / 6 ELSE g.al + greatest(-d.d, 0) END
  FROM g JOIN d ON d.symbol = g.symbol AND d.rn = g.rn + 1)
SELECT symbol, group_id,
       CASE WHEN rn < 7 THEN NULL WHEN al = 0 THEN 100 WHEN ag = 0 THEN 0
            ELSE {half_up("(100 - 100 / (1 + ag / al))", 2)} END AS rsi6
FROM g"""

MACD = f"""{HOURLY},
e AS (
  SELECT symbol, group_id, rn, close_price AS v12, close_price AS v26 FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.group_id, n.rn,
         {average(12, "n.close_price", "e.v12", "e.rn")}, {average(26, "n.close_price", "e.v26", "e.rn")}
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
m AS (
  SELECT symbol, group_id, rn, v12, v26, v12 - v26 AS line, rn - 25 AS mn FROM e),
s AS (
  SELECT symbol, mn, line AS v9 FROM m WHERE mn = 1
  UNION ALL
  SELECT m.symbol, m.mn, {average(9, "m.line", "s.v9", "s.mn")}
  FROM s JOIN m ON m.symbol = s.symbol AND m.mn = s.mn + 1)
SELECT m.symbol, m.group_id,
       CASE WHEN rn >= 12 THEN {half_up("v12", 2)} END AS ema12,
       CASE WHEN rn >= 26 THEN {half_up("v26", 2)} END AS ema26,
       CASE WHEN rn >= 26 THEN {half_up("line", 2)} END AS macd,
       CASE WHEN s.mn >= 9 THEN {half_up("v9", 2)} END AS signal,
       CASE WHEN s.mn >= 9 THEN {half_up("(line - v9)", 2)} END AS histogram
FROM m LEFT JOIN s ON s.symbol = m.symbol AND s.mn = m.mn"""

STREAM_X = f"""{HOURLY_EMA}, {with_ema(4, raw=True)},
z AS (
  SELECT make_timestamp(group_id * {HOUR}) AS window_start,
         make_timestamp((group_id + 1) * {HOUR}) AS window_end, symbol,
         CAST(make_timestamp(group_id * {HOUR}) AS DATE) AS landing_date,
         open_price, high_price, low_price, close_price, volume, ema7, ema20, trend,
         {ENGULFING} AS engulfing_pattern
  FROM x)"""
CLOSED = """window_end <= (
  SELECT make_timestamp((max("timestamp") // 1000) * 1000 - 5000000) FROM t)"""

TRADE_FILE = """agg_trade_id, price, quantity, agg_trade_id AS first_trade_id,
       agg_trade_id AS last_trade_id, "timestamp", is_buyer_maker, true AS is_best_match"""

LISTED = """(c_name ILIKE '%r#0000001%' OR c_mktsegment ILIKE '%r#0000001%')
  AND c_acctbal IS NOT NULL"""

ORACLES: dict[str, str] = {
    "klines_1h": f"WITH {TRADES}, {bars(HOUR)} SELECT {BAR_COLUMNS} FROM b",
    "klines_15m": f"WITH {TRADES}, {bars(QUARTER)} SELECT {BAR_COLUMNS} FROM b",
    "klines_orders_daily": f"WITH {ORDERS}, {bars(DAY)} SELECT {BAR_COLUMNS} FROM b",
    "bucket_stats": f"""WITH {TRADES}
SELECT "timestamp" // {HOUR} AS group_id, symbol, max(price) AS high_price, min(price) AS low_price,
       max(agg_trade_id) AS max_id, min(agg_trade_id) AS min_id, sum(quantity) AS volume,
       strftime(make_timestamp(("timestamp" // {HOUR}) * {HOUR}), '%Y-%m-%d %H:%M:%S') AS group_date
FROM t GROUP BY ALL""",
    "time_columns": f"""WITH {TRADES}
SELECT agg_trade_id,
       strftime(make_timestamp("timestamp" // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp_date,
       "timestamp" // 1000000 AS timestamp_second, "timestamp" // {QUARTER} AS group_id,
       strftime(make_timestamp("timestamp" // {QUARTER} * {QUARTER}), '%Y-%m-%d %H:%M:%S') AS group_date
FROM t""",
    "ingest_columns": f"WITH {TRADES} SELECT agg_trade_id, true AS same_day FROM t",
    "ingest_profile": f"""WITH {TRADES}
SELECT 'date' AS ingest_date_type, 'timestamp' AS ingest_timestamp_type, count(*) AS ingest_date_rows,
       count(*) AS ingest_timestamp_rows, count(*) AS fresh_rows FROM t""",
    "shown_prices": f"""WITH {TRADES}
SELECT agg_trade_id, format('{{:,.10f}}', round(price * 1000, 2)) AS price, format('{{:,.2f}}', quantity) AS quantity FROM t""",
    "land_days": f"""{DAY_BARS}, {DAY_EMA}
SELECT symbol, landing_date, group_id, close_price, ema7, ema20, trend, {ENGULFING} AS pattern FROM x""",
    "land_month": f"""WITH {TRADES}
SELECT agg_trade_id, price, quantity, "timestamp", is_buyer_maker, symbol, landing_date FROM t""",
    "table_modes": f"""WITH {TRADES}, s(step, symbols) AS (VALUES
  ('created', ['click']), ('kept', ['click']), ('appended', ['click', 'view']),
  ('replaced', ['click', 'error', 'purchase', 'signup']))
SELECT step, symbol, count(*) AS rows, sum(floor(price))::BIGINT AS prices FROM t JOIN s ON list_contains(symbols, symbol) GROUP BY ALL""",
    "sink_days": f"""{STREAM_X}
SELECT symbol, landing_date, count(*) AS bars, count(*) AS dated, 'date' AS created_at_type FROM z GROUP BY ALL""",
    "tag_columns": f"""WITH {TRADES}
SELECT agg_trade_id, 'BTCUSDT' AS symbol, DATE '2025-10-01' AS landing_date FROM t""",
    "row_counts": f"""WITH {TRADES}
SELECT count(*) AS rows, count(*) FILTER (price > 50) AS rows_kept FROM t""",
    "partition_counts": f"""WITH {TRADES}
SELECT symbol, landing_date, count(*) AS rows FROM t GROUP BY ALL""",
    "null_profile": f"""WITH {TRADES}
SELECT count(*) FILTER (agg_trade_id IS NULL) AS agg_trade_id,
       count(*) FILTER (agg_trade_id % 7 = 0 OR price IS NULL) AS price,
       count(*) FILTER (quantity IS NULL) AS quantity,
       count(*) FILTER ("timestamp" IS NULL) AS "timestamp",
       count(*) FILTER (is_buyer_maker IS NULL) AS is_buyer_maker,
       count(*) FILTER (symbol IS NULL) AS symbol FROM t""",
    "describe_trades": f"""WITH {TRADES}
SELECT 'count' AS summary, CAST(count(price) AS DOUBLE) AS price, CAST(count(quantity) AS DOUBLE) AS quantity FROM t
UNION ALL SELECT 'mean', round(avg(price), 6), round(avg(quantity), 6) FROM t
UNION ALL SELECT 'stddev', round(stddev_samp(price), 6), round(stddev_samp(quantity), 6) FROM t
UNION ALL SELECT 'min', round(min(price), 6), round(min(quantity), 6) FROM t
UNION ALL SELECT 'max', round(max(price), 6), round(max(quantity), 6) FROM t""",
    "symbols": "SELECT DISTINCT event_type AS symbol FROM events ORDER BY 1",
    "last_bar": f"""WITH {TRADES}, {bars(HOUR)} SELECT {BAR_COLUMNS} FROM b
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY group_id DESC) = 1""",
    "latest_trades": f"""WITH {TRADES}
SELECT agg_trade_id, price, quantity, "timestamp", is_buyer_maker, symbol FROM t
ORDER BY "timestamp" DESC, agg_trade_id DESC LIMIT 20""",
    "paged_listing": f"""SELECT * FROM customer WHERE {LISTED}
ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25""",
    "page_total": f"SELECT count(*) AS total FROM customer WHERE {LISTED}",
    "unequal_matches": """WITH c AS (SELECT c_nationkey, count(*) AS rows FROM customer GROUP BY 1),
p AS (SELECT a.c_nationkey, count(*) AS pairs FROM customer a JOIN customer b
      ON a.c_nationkey <> b.c_nationkey GROUP BY 1)
SELECT c.c_nationkey, c.rows, p.pairs FROM c JOIN p ON c.c_nationkey = p.c_nationkey""",
    "backfill_nulls": """SELECT c_custkey,
       CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE coalesce(c_acctbal, 0) END AS c_acctbal,
       CASE WHEN c_custkey % 7 = 0 THEN 'NONE' ELSE coalesce(c_mktsegment, 'NONE') END AS c_mktsegment
FROM customer""",
    "cast_trades": f"""WITH {TRADES}
SELECT agg_trade_id, CASE WHEN agg_trade_id % 10 <> 0 THEN price END AS price, quantity, "timestamp",
       is_buyer_maker, true AS is_best_match, symbol FROM t""",
    "sma7": f"""WITH {TRADES}, {bars(HOUR)}, {NUMBERED}
SELECT symbol, group_id, {two_places(frame("least(rn, 7)"))} AS sma7
FROM n WINDOW w AS (PARTITION BY symbol ORDER BY group_id)""",
    "ma7_full": f"""WITH {TRADES}, {bars(HOUR)}
SELECT symbol, group_id, {two_places(frame("7"))} AS ma7
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY group_id)""",
    "ema7_ema20": f"""{HOURLY_EMA}, {with_ema(4)}
SELECT symbol, group_id, close_price, ema7, ema20 FROM x""",
    "ema_first_seed": f"""{HOURLY},
e AS (SELECT symbol, group_id, rn, close_price AS v FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.group_id, n.rn, CAST(0.25 AS DOUBLE) * n.close_price + CAST(0.75 AS DOUBLE) * e.v
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
SELECT symbol, group_id, round(v, 6) AS ema7 FROM e""",
    "ema_column_seed": f"""WITH RECURSIVE {TRADES}, {bars(HOUR)},
n AS (SELECT *, row_number() OVER w AS rn, {two_places(frame("7"))} AS ma7
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY group_id)),
e AS (SELECT symbol, group_id, rn, ma7, CAST(CAST(ma7 AS DECIMAL(18, 2)) AS DECIMAL(38, 24)) AS v FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.group_id, n.rn, n.ma7,
         CAST(CAST(n.close_price AS DECIMAL(18, 2)) * 0.25 AS DECIMAL(38, 24))
         + CAST(e.v * 0.75 AS DECIMAL(38, 24))
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
SELECT symbol, group_id, ma7, CAST(round(v, 2) AS DOUBLE) AS ema7 FROM e""",
    "ema_day_carry": f"{DAY_BARS}, {DAY_EMA} SELECT symbol, group_id, landing_date, ema7, ema20 FROM x",
    "ema_chunked": f"""WITH RECURSIVE {TRADES},
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp", agg_trade_id) AS rn FROM t),
e AS (SELECT symbol, agg_trade_id, rn, price AS v FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.agg_trade_id, n.rn, CAST(0.25 AS DOUBLE) * n.price + CAST(0.75 AS DOUBLE) * e.v
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)
SELECT symbol, agg_trade_id, round(v, 6) AS ema7 FROM e""",
    "rsi6": RSI,
    "macd": MACD,
    "trend_counts": f"""{HOURLY_EMA}, {with_ema(4)}
SELECT symbol, trend, count(*) AS bars FROM x GROUP BY ALL""",
    "pattern_hammer": f"""{HOURLY_EMA}, {with_ema(2)}
SELECT symbol, group_id, group_date, close_price, trend, {HAMMER} AS pattern FROM x""",
    "pattern_engulfing": f"""{HOURLY_EMA}, {with_ema(4)}
SELECT {BAR_COLUMNS}, ema7, ema20, trend, {ENGULFING} AS pattern FROM x""",
    "pattern_engulfing_raw": f"""{HOURLY_EMA}, {with_ema(4, raw=True)}
SELECT {BAR_COLUMNS}, ema7, ema20, trend, {ENGULFING} AS pattern FROM x""",
    "pattern_engulfing_day": f"""{DAY_BARS}, {DAY_EMA}
SELECT {BAR_COLUMNS}, landing_date, ema7, ema20, trend, {ENGULFING} AS pattern FROM x""",
    "pattern_stars": f"""{HOURLY_EMA}, {with_ema(2)}
SELECT symbol, group_id, group_date, close_price, trend, {STARS} AS pattern FROM x""",
    "only_patterns": f"""{HOURLY_EMA}, {with_ema(2)}
SELECT symbol, group_id, group_date, close_price, trend, {STARS} AS pattern FROM x
WHERE ({STARS}) IS NOT NULL""",
    "plot_bars": f"""WITH {TRADES}, {bars(HOUR)}
SELECT make_timestamp(open_time) AS time, symbol, open_price, high_price, low_price, close_price, volume
FROM b""",
    "plot_sma": f"""WITH {TRADES}, {bars(HOUR)}, {NUMBERED}
SELECT make_timestamp(open_time) AS time, symbol, {two_places(frame("least(rn, 7)"))} AS sma7
FROM n WINDOW w AS (PARTITION BY symbol ORDER BY group_id)""",
    "chart_series": f"""{STREAM_X}
SELECT window_start AS time, open_price, high_price, low_price, close_price, volume, ema7, ema20,
       CASE WHEN engulfing_pattern IS NOT NULL THEN close_price END AS engulfing_close
FROM z WHERE symbol = 'click'
  AND window_start BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
    "csv_ingest": f"WITH {TRADES} SELECT {TRADE_FILE} FROM t",
    "zip_ingest": f"WITH {TRADES} SELECT {TRADE_FILE} FROM t",
    "landing_read": f"""WITH {TRADES}
SELECT agg_trade_id, price, symbol, landing_date FROM t WHERE symbol = 'view'""",
    "upsert_rows": f"""WITH {TRADES}
SELECT agg_trade_id, CASE WHEN symbol = 'click' THEN -price ELSE price END AS price, symbol,
       landing_date FROM t""",
    "day_jobs": f"""{DAY_BARS}, {DAY_EMA}
SELECT symbol, landing_date, group_id, close_price, ema7, ema20, trend, {ENGULFING} AS pattern FROM x""",
    "encode_trade_messages": f"""WITH {TRADES}
SELECT symbol AS key,
       CAST(CASE symbol WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS INTEGER) AS partition,
       agg_trade_id, price, quantity, agg_trade_id AS first_trade_id, agg_trade_id AS last_trade_id,
       "timestamp" AS ts_int, is_buyer_maker, true AS is_best_match, symbol
FROM t WHERE agg_trade_id % 10 <> 0""",
    "rejected_trade_counts": f"""WITH {TRADES}
SELECT symbol, CASE WHEN symbol = 'signup' THEN 'symbol without a partition' ELSE 'price does not parse' END AS reason,
       count(*) AS rows
FROM t WHERE symbol = 'signup' OR agg_trade_id % 10 = 0 GROUP BY ALL""",
    "sample_trades": f"""WITH {TRADES}
SELECT agg_trade_id, price, quantity, "timestamp", is_buyer_maker, symbol FROM t
WHERE CAST('0x' || md5('42:' || agg_trade_id)[1:8] AS BIGINT) < {int(0.01 * (1 << 32))}""",
    "encode_alert_messages": f"""{STREAM_X}
SELECT symbol AS key, * FROM z WHERE engulfing_pattern IS NOT NULL""",
    "bounded_engulfing": f"{STREAM_X} SELECT * FROM z",
    "stream_bars": f"""{STREAM_X}
SELECT window_start, window_end, symbol, landing_date, open_price, high_price, low_price, close_price,
       volume FROM z WHERE {CLOSED}""",
    "stream_engulfing": f"{STREAM_X} SELECT * FROM z WHERE {CLOSED}",
    "stream_alerts": f"{STREAM_X} SELECT * FROM z WHERE {CLOSED} AND engulfing_pattern IS NOT NULL",
    "stream_copy": f"""WITH {TRADES}
SELECT agg_trade_id, price, "timestamp" AS ts_int, symbol FROM t""",
}

# The same over one-minute bars, where a symbol has about eleven chunks of them.
MINUTE = 60_000_000
for _name, _of in {
    "sma_minutes": "sma7", "ema_minutes": "ema7_ema20", "day_carry_minutes": "ema_day_carry", "rsi_minutes": "rsi6",
    "macd_minutes": "macd", "engulfing_minutes": "pattern_engulfing", "stars_minutes": "pattern_stars",
}.items():
    ORACLES[_name] = ORACLES[_of].replace(str(HOUR), str(MINUTE))

# Levels as integers of 1e-20, so that a flat price stands still here as well; the averages of equal values
# are equal, and there is no trend then.
_UNIT = "CAST(100000000000000000000 AS HUGEINT)"


def _whole(period: int, level: str) -> str:
    return (f"CASE WHEN e.rn >= {period} THEN ({period - 1} * e.{level} + 2 * n.x) // {period + 1} "
            f"WHEN e.rn + 1 = {period} THEN (e.{level} + n.x) // {period} ELSE e.{level} + n.x END")


ORACLES["flat_trend_minutes"] = f"""WITH RECURSIVE {TRADES.replace("value AS price", "floor(value / 25) * 25 + 1.1::DOUBLE AS price")},
{bars(MINUTE)},
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY group_id) AS rn,
             CAST(round(close_price * 10) AS HUGEINT) * ({_UNIT} // 10) AS x FROM b),
e AS (SELECT symbol, group_id, rn, close_price, x AS v7, x AS v20 FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.group_id, n.rn, n.close_price, {_whole(7, "v7")}, {_whole(20, "v20")}
  FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
f AS (SELECT symbol, group_id, close_price,
             CASE WHEN rn >= 7 THEN CAST(v7 AS DOUBLE) / 1e20 END AS a, CASE WHEN rn >= 20 THEN CAST(v20 AS DOUBLE) / 1e20 END AS b
      FROM e)
SELECT symbol, group_id, close_price, {half_up("a", 4)} AS ema7, {half_up("b", 4)} AS ema20,
       CASE WHEN a > b THEN 'uptrend' WHEN a < b THEN 'downtrend' END AS trend
FROM f"""

ORACLES["stream_slow_symbol"] = f"""{STREAM_X}
SELECT window_start, window_end, symbol, landing_date, open_price, high_price, low_price, close_price, volume
FROM z WHERE window_end <= (
  SELECT make_timestamp(min(m)) FROM (
    SELECT (max("timestamp") // 1000) * 1000 - 5000000 AS m FROM t GROUP BY symbol))"""

ORACLES["stream_keyed_bars"] = f"""{STREAM_X}
SELECT window_start, window_end, symbol, landing_date, open_price, high_price, low_price, close_price, volume FROM z"""
ORACLES["stream_late_trades"] = f"""WITH {TRADES},
m AS (SELECT symbol, max("timestamp") // 1000 * 1000 - 5000000 AS until FROM t WHERE agg_trade_id % 10 <> 0 GROUP BY symbol)
SELECT t.symbol, agg_trade_id, price, quantity, "timestamp" AS ts_int, make_timestamp("timestamp" // {HOUR} * {HOUR}) AS window_start,
       make_timestamp("timestamp" // {HOUR} * {HOUR} + {HOUR}) AS window_end, make_timestamp("timestamp" // {HOUR} * {HOUR})::DATE AS landing_date,
       make_timestamp(until) AS closed_until, 'watermark' AS reason
FROM t JOIN m ON m.symbol = t.symbol WHERE agg_trade_id % 10 = 0 AND "timestamp" // {HOUR} * {HOUR} + {HOUR} <= until"""
ORACLES["stream_trade_files"] = f"""WITH {TRADES}
SELECT agg_trade_id, price, "timestamp" AS ts_int, make_timestamp("timestamp" // 1000 * 1000) AS ts, 'BTCUSDT' AS symbol FROM t"""
ORACLES["stream_stored_bars"] = f"{STREAM_X} SELECT * FROM z"
ORACLES["stream_read_alerts"] = f"{STREAM_X} SELECT * FROM z WHERE engulfing_pattern IS NOT NULL"
