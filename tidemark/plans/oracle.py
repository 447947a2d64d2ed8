"""DuckDB SQL of the same domain tables and operators, put together from named common table expressions."""

from __future__ import annotations

import re

_DAYS = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"
_K = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"

#: Expressions by name; each may use others, which are then put before it.
CTES: dict[str, str] = {
    "bars": f"""SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS date, first(l_extendedprice ORDER BY {_K}) AS open, max(l_extendedprice) AS high,
        min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {_K}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY ALL""",
    "event_bars": """SELECT user_id AS instrument_id, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL""",
    "exchanges": "SELECT n_nationkey AS exchange_id, upper(trim(n_name)) AS code, n_name AS name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "instruments": """SELECT s_suppkey AS instrument_id, s_nationkey AS exchange_id, upper(trim(s_name)) AS symbol,
        'IN' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || CASE WHEN s_suppkey % 3 = 0 THEN 'X' ELSE '7' END AS isin FROM supplier""",
    "days": "SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS day",
    "holidays": f"""SELECT n_nationkey AS exchange_id, day AS holiday_date,
        CASE ({_DAYS.format("day")} + n_nationkey) % 3 WHEN 0 THEN 'full_day' WHEN 1 THEN 'half_day' ELSE 'early_close' END AS session_type
        FROM nation CROSS JOIN days WHERE ({_DAYS.format("day")} * 7 + n_nationkey) % 61 = 0""",
    "actions": f"""SELECT instrument_id, 'split' AS action_type, date AS execution_date, CASE WHEN instrument_id % 2 = 1 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS value
        FROM bars WHERE ({_DAYS.format("date")} + instrument_id * 13) % 181 = 0
        UNION ALL SELECT instrument_id, 'dividend', CAST(CASE WHEN instrument_id % 10 = 3 THEN date + 1 ELSE date END AS DATE), floor(close) / 100.0::DOUBLE
        FROM bars WHERE ({_DAYS.format("date")} + instrument_id * 13) % 41 = 0""",
    "history": """SELECT instrument_id, 'OLD_' || symbol AS symbol, DATE '1990-01-01' AS effective_from, DATE '1997-12-31' AS effective_to FROM instruments
        UNION ALL SELECT instrument_id, symbol, DATE '1998-01-01', NULL FROM instruments""",
    "records": """SELECT k AS instrument_id, period_end, metric_name, value, CASE WHEN k % 7 <> 0 THEN year(period_end)::INT END AS fiscal_year,
        CASE WHEN k % 7 <> 0 THEN quarter(period_end)::INT END AS fiscal_quarter, CAST(period_end + 15 AS DATE) AS published_at,
        CASE WHEN k % 11 <> 0 THEN CAST(period_end + CAST(k % 5 + 15 AS INT) AS DATE) END AS available_at
        FROM (SELECT o_custkey % 50 AS k, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS period_end,
              lower(trim(o_orderpriority)) AS metric_name, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)""",
    "runs": """SELECT event_id AS run_id, user_id AS instrument_id, lower(trim(event_type)) AS ingestion_type, ts AS started_at,
        CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events""",
    "stored": f"SELECT * FROM bars WHERE (instrument_id + {_DAYS.format('date')}) % 7 <> 0",
    "incoming": f"""SELECT instrument_id, date, open, high, low, CASE WHEN (instrument_id + {_DAYS.format("date")}) % 5 = 0 THEN close + 1 ELSE close END AS close, volume FROM bars""",
    # Bars within days.
    "zones": """SELECT n_nationkey AS exchange_id, ['America/New_York', 'Europe/Berlin', 'Asia/Kolkata', 'Australia/Sydney', 'America/Chicago'][n_nationkey % 5 + 1] AS zone,
        INTERVAL 1 MINUTE * [570, 540, 555, 600, 1020][n_nationkey % 5 + 1] AS opens, INTERVAL 1 MINUTE * [960, 1050, 930, 960, 960][n_nationkey % 5 + 1] AS closes,
        n_nationkey % 5 = 4 AS night FROM nation""",
    "ticks": """SELECT user_id AS instrument_id, user_id % 25 AS exchange_id, ts + to_days(CAST(event_id % 360 AS INTEGER)) AS ts, value AS price, event_id AS tick_id FROM events""",
    "local_ticks": """SELECT t.*, z.* EXCLUDE (exchange_id), timezone(zone, timezone('UTC', ts)) AS wall FROM ticks t JOIN zones z ON z.exchange_id = t.exchange_id""",
    "begun_ticks": """SELECT *, CAST(CASE WHEN night AND CAST(wall AS TIME) < CAST(TIMESTAMP '2000-01-01' + closes AS TIME) THEN wall - INTERVAL 1 DAY ELSE wall END AS DATE) AS begun FROM local_ticks""",
    "dated_ticks": """SELECT *, CAST(CASE WHEN night THEN begun + INTERVAL 1 DAY ELSE begun END AS DATE) AS market_date, timezone('UTC', timezone(zone, CAST(begun AS TIMESTAMP) + opens)) AS opens_at,
        timezone('UTC', timezone(zone, CAST(CASE WHEN night THEN begun + INTERVAL 1 DAY ELSE begun END AS TIMESTAMP) + closes)) AS closes_at FROM begun_ticks""",
    "half_hours": """SELECT instrument_id, opens_at + INTERVAL 30 MINUTE * CAST(floor((epoch_us(ts) - epoch_us(opens_at)) / 1800000000) AS BIGINT) AS ts, market_date, arg_min(price, ts) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM dated_ticks d WHERE ts >= opens_at AND ts < closes_at
        GROUP BY instrument_id, opens_at + INTERVAL 30 MINUTE * CAST(floor((epoch_us(ts) - epoch_us(opens_at)) / 1800000000) AS BIGINT), market_date""",
    # Features over one window.
    "windowed": """SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc, lead(close, 5) OVER w AS ch, lead(date, 5) OVER w AS rd, close / lag(close) OVER w - 1 AS return_window_1,
        CASE WHEN row_number() OVER w >= 5 THEN avg(close) OVER (PARTITION BY instrument_id ORDER BY date ROWS 4 PRECEDING) END AS sma_window_5,
        CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER v END AS mid, CASE WHEN row_number() OVER w >= 20 THEN 2 * stddev_pop(close) OVER v END AS dev
        FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date), v AS (PARTITION BY instrument_id ORDER BY date ROWS 19 PRECEDING)""",
    "steps": """SELECT instrument_id, date, i, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM windowed WHERE i > 1""",
    "seeds": "SELECT instrument_id, 15 AS i, avg(gain) AS g, avg(loss) AS l, avg(tr) AS a FROM steps WHERE i <= 15 GROUP BY instrument_id HAVING count(*) = 14",
    "smoothed": """SELECT * FROM seeds UNION ALL SELECT s.instrument_id, s.i, (r.g * 13 + s.gain) / 14, (r.l * 13 + s.loss) / 14, (r.a * 13 + s.tr) / 14
        FROM smoothed r JOIN steps s ON s.instrument_id = r.instrument_id AND s.i = r.i + 1""",
    "featured": """SELECT w.*, CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 * g / (g + l) END AS rsi_window_14, a AS atr_window_14
        FROM windowed w LEFT JOIN smoothed s ON s.instrument_id = w.instrument_id AND s.i = w.i""",
    # Labels over five bars.
    "split_part": """SELECT w.instrument_id, w.date, product(a.value) AS sf FROM windowed w JOIN actions a ON a.instrument_id = w.instrument_id AND a.action_type = 'split'
        AND a.execution_date > w.date AND a.execution_date <= w.rd GROUP BY ALL""",
    "paid_dates": """SELECT d.instrument_id, d.execution_date, d.dividend, b.close AS ex_close
        FROM (SELECT instrument_id, execution_date, sum(value) AS dividend FROM actions WHERE action_type = 'dividend' GROUP BY ALL) d
        LEFT JOIN bars b ON b.instrument_id = d.instrument_id AND b.date = d.execution_date""",
    "paid_part": """SELECT w.instrument_id, w.date, product(1 + p.dividend / p.ex_close) AS paid, count(*) FILTER (p.ex_close IS NULL OR p.ex_close <= 0) AS bad
        FROM windowed w JOIN paid_dates p ON p.instrument_id = w.instrument_id AND p.execution_date > w.date AND p.execution_date <= w.rd GROUP BY ALL""",
    "total": """SELECT f.*, CASE WHEN coalesce(bad, 0) = 0 THEN ch / (close / coalesce(sf, 1)) * coalesce(paid, 1) - 1 END AS tr5
        FROM featured f LEFT JOIN split_part s ON s.instrument_id = f.instrument_id AND s.date = f.date LEFT JOIN paid_part p ON p.instrument_id = f.instrument_id AND p.date = f.date""",
    "complete": """SELECT *, ch / close - 1 AS fr5 FROM featured""",
    "marked": """SELECT *, CASE WHEN return_window_1 IS NULL OR sma_window_5 IS NULL OR rsi_window_14 IS NULL THEN 'feature' WHEN fr5 IS NULL THEN 'target' END AS reason FROM complete""",
    "labelled": "SELECT instrument_id, date AS observation_date, rd AS realization_date, return_window_1, sma_window_5, rsi_window_14, fr5 AS target FROM marked WHERE reason IS NULL",
    # Splits: {e} rows of embargo.
    "seg": """SELECT *, CASE WHEN i <= floor(0.7::DOUBLE * n) THEN 'train' WHEN i <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS segment
        FROM (SELECT instrument_id, observation_date, realization_date, row_number() OVER (PARTITION BY instrument_id ORDER BY observation_date) AS i,
              count(*) OVER (PARTITION BY instrument_id) AS n FROM labelled)""",
    "b1": "SELECT instrument_id, max(realization_date) AS b FROM seg WHERE segment = 'train' GROUP BY ALL",
    "val": """SELECT s.*, CASE WHEN observation_date < b THEN 'purged' WHEN sum(CASE WHEN observation_date < b THEN 0 ELSE 1 END)
        OVER (PARTITION BY s.instrument_id ORDER BY observation_date) <= {e} THEN 'embargoed' ELSE 'kept' END AS status
        FROM seg s LEFT JOIN b1 USING (instrument_id) WHERE segment = 'val'""",
    "b2": """SELECT instrument_id, max(realization_date) AS b FROM (SELECT instrument_id, realization_date FROM seg WHERE segment = 'train'
        UNION ALL SELECT instrument_id, realization_date FROM val WHERE status = 'kept') GROUP BY ALL""",
    "parts": """SELECT instrument_id, observation_date, segment, 'kept' AS status FROM seg WHERE segment = 'train'
        UNION ALL SELECT instrument_id, observation_date, segment, status FROM val
        UNION ALL SELECT s.instrument_id, observation_date, segment, CASE WHEN observation_date < b THEN 'purged' WHEN sum(CASE WHEN observation_date < b THEN 0 ELSE 1 END)
        OVER (PARTITION BY s.instrument_id ORDER BY observation_date) <= {e} THEN 'embargoed' ELSE 'kept' END
        FROM seg s LEFT JOIN b2 USING (instrument_id) WHERE segment = 'test'""",
    "factors": """SELECT b.instrument_id, b.date, product(a.value) AS factor FROM bars b JOIN actions a ON a.instrument_id = b.instrument_id
        AND a.action_type = 'split' AND a.execution_date > b.date {cut} GROUP BY ALL""",
    "classified": """SELECT n.*, CASE WHEN s.instrument_id IS NULL THEN 'inserted' WHEN n.open = s.open AND n.high = s.high AND n.low = s.low AND n.close = s.close AND n.volume = s.volume
        THEN 'skipped' ELSE 'updated' END AS status FROM incoming n LEFT JOIN stored s ON s.instrument_id = n.instrument_id AND s.date = n.date""",
}
_RECURSIVE = {"smoothed"}


def sql(body: str, **values: object) -> str:
    """``body`` with the expressions that it uses, directly or not, before it."""
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CTES and name not in order and name != own:
                need(CTES[name], name)
                order.append(name)

    need(body)
    if not order:
        return body
    parts = []
    for name in order:
        text = CTES[name]
        for k in ("e", "cut"):
            text = text.replace("{" + k + "}", str(values.get(k, "")))
        parts.append(f"{name} AS {'' if name in _RECURSIVE else 'MATERIALIZED '}({text})")
    rest = ",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body
    return f"WITH {'RECURSIVE ' if _RECURSIVE & set(order) else ''}" + ",\n".join(parts) + rest
