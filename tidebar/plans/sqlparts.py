"""SQL pieces that the comparison queries share."""


def bars(width: str = "1 hour", name: str = "bars") -> str:
    return f"{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{width}', ts) AS time, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"


def walked(source: str = "raw", name: str = "bars") -> str:
    return f"{name} AS MATERIALIZED (SELECT symbol, time, walk - m AS open, greatest(walk - m, walk) + (high - greatest(open, close)) / 200 AS high, least(walk - m, walk) - (least(open, close) - low) / 200 AS low, walk AS close, volume FROM (SELECT *, (close - open) / 50 AS m, 100 + sum((close - open) / 50) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS walk FROM {source}))"


def base(source: str = "bars", name: str = "b") -> str:
    """Needs WITH RECURSIVE: Wilder's mean goes from row to row."""
    return f"""{name}0 AS (SELECT *, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, row_number() OVER w AS row_idx FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY time)),
{name}1 AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM {name}0),
{name}2 AS (SELECT symbol, 14::BIGINT AS row_idx, avg(tr) AS atr FROM {name}1 WHERE row_idx <= 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT n.symbol, n.row_idx, (13 * p.atr + n.tr) / 14 FROM {name}2 p JOIN {name}1 n ON n.symbol = p.symbol AND n.row_idx = p.row_idx + 1),
{name} AS MATERIALIZED (SELECT {name}1.*, {name}2.atr FROM {name}1 LEFT JOIN {name}2 USING (symbol, row_idx))"""


def smoothed(source: str = "b", name: str = "m") -> str:
    """Smoothed indicators, a row at a time; `source` is what base() makes."""
    di = "CASE WHEN k >= 15 THEN 100 * {} / nullif(st, 0) END"
    return f"""{name}0 AS MATERIALIZED (SELECT *, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS ndm FROM {source}),
{name}1 AS (SELECT symbol, 1::BIGINT AS k, close AS e12, close AS e20, close AS e26, close AS e50, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, 0.0::DOUBLE AS st, 0.0::DOUBLE AS sp, 0.0::DOUBLE AS sn, NULL::DOUBLE AS sig, 0.0::DOUBLE AS adx FROM {name}0 WHERE row_idx = 1
UNION ALL SELECT symbol, k, e12, e20, e26, e50, gain, loss, st, sp, sn, CASE WHEN k = 26 THEN e12 - e26 WHEN k > 26 THEN sig + 0.2 * (e12 - e26 - sig) END, CASE WHEN k < 15 THEN 0 WHEN k < 28 THEN adx + dx WHEN k = 28 THEN (adx + dx) / 14 ELSE (13 * adx + dx) / 14 END
FROM (SELECT *, coalesce(100 * abs(sp - sn) / nullif(sp + sn, 0), 0) AS dx FROM (SELECT n.symbol, n.row_idx AS k, p.e12 + 2 / 13.0::DOUBLE * (n.close - p.e12) AS e12, p.e20 + 2 / 21.0::DOUBLE * (n.close - p.e20) AS e20, p.e26 + 2 / 27.0::DOUBLE * (n.close - p.e26) AS e26, p.e50 + 2 / 51.0::DOUBLE * (n.close - p.e50) AS e50,
(13 * p.gain + greatest(n.close - n.pc, 0)) / 14 AS gain, (13 * p.loss + greatest(n.pc - n.close, 0)) / 14 AS loss, CASE WHEN n.row_idx <= 15 THEN p.st + n.tr ELSE p.st * 13 / 14 + n.tr END AS st, CASE WHEN n.row_idx <= 15 THEN p.sp + n.pdm ELSE p.sp * 13 / 14 + n.pdm END AS sp, CASE WHEN n.row_idx <= 15 THEN p.sn + n.ndm ELSE p.sn * 13 / 14 + n.ndm END AS sn, p.sig, p.adx
FROM {name}1 p JOIN {name}0 n ON n.symbol = p.symbol AND n.row_idx = p.k + 1))),
{name}2 AS (SELECT symbol, k AS row_idx, CASE WHEN k >= 20 THEN e20 END AS ema_20, CASE WHEN k >= 50 THEN e50 END AS ema_50, CASE WHEN k >= 26 THEN e12 - e26 END AS macd, CASE WHEN k >= 34 THEN sig END AS macd_signal, CASE WHEN k >= 34 THEN e12 - e26 - sig END AS macd_hist, CASE WHEN k >= 14 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi_14, {di.format('sp')} AS plus_di_14, {di.format('sn')} AS minus_di_14, CASE WHEN k >= 28 THEN adx END AS adx_14 FROM {name}1),
{name} AS MATERIALIZED (SELECT * FROM {name}0 JOIN {name}2 USING (symbol, row_idx))"""


def past(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ahead(n: int, first: int = 1) -> str:
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {first} FOLLOWING AND {n} FOLLOWING)"


W = "(PARTITION BY symbol ORDER BY time)"
FLAGS = "coalesce((close > ph)::INT, 0) AS breakout_up, coalesce((close < pl)::INT, 0) AS breakout_down, coalesce((high > ph AND close <= ph)::INT, 0) AS false_breakout_up, coalesce((low < pl AND close >= pl)::INT, 0) AS false_breakout_down"


def flag(condition: str, name: str) -> str:
    return f"coalesce(({condition})::INT, 0) AS {name}"


OUTCOMES = ("fav_atr", "adv_atr", "continues", "reverses", "pullback_0p25", "pullback_0p50", "reaches_0p50", "reaches_1p00", "reaches_1p50")


def outcomes(horizons=(1, 2, 3, 6, 12, 24), source: str = "b", name: str = "o") -> str:
    parts, sides, cols = [], [], []
    for k in horizons:
        parts.append(f"max(high) OVER {ahead(k)} - close AS up{k}, close - min(low) OVER {ahead(k)} AS dn{k}, lead(close, {k}) OVER {W} - close AS ret{k}")
        sides.append(f"CASE side WHEN 1 THEN up{k} WHEN -1 THEN dn{k} END / nullif(atr, 0) AS h{k}_fav_atr, CASE side WHEN 1 THEN dn{k} WHEN -1 THEN up{k} END / nullif(atr, 0) AS h{k}_adv_atr")
        cols += [flag(f"side * ret{k} > 0", f"h{k}_continues"), flag(f"side * ret{k} < 0", f"h{k}_reverses")]
        cols += [flag(f"h{k}_adv_atr >= {x}", f"h{k}_pullback_{n}") for n, x in (("0p25", 0.25), ("0p50", 0.5))] + [flag(f"h{k}_fav_atr >= {x}", f"h{k}_reaches_{n}") for n, x in (("0p50", 0.5), ("1p00", 1.0), ("1p50", 1.5))]
    return f"{name}0 AS (SELECT *, sign(close - open)::INT AS side, {', '.join(parts)} FROM {source}), {name}1 AS (SELECT *, {', '.join(sides)} FROM {name}0), {name} AS (SELECT *, {', '.join(cols)} FROM {name}1)"


def touch(target: str, stop: str, bars: int, side: str, entry: str = "close", first: int = 1, source: str = "b", tie: str = "AMBIGUOUS") -> str:
    """A table (symbol, time, label, place) by a self-join on the place of the bar."""
    won = f"(CASE WHEN a.s > 0 THEN n.high >= a.e + a.s * a.tp ELSE n.low <= a.e + a.s * a.tp END)"
    lost = f"(CASE WHEN a.s > 0 THEN n.low <= a.e - a.s * a.sl ELSE n.high >= a.e - a.s * a.sl END)"
    return f"""SELECT symbol, time, arg_min(CASE WHEN won AND lost THEN '{tie}' WHEN won THEN 'TP_FIRST' ELSE 'SL_FIRST' END, k) AS label, min(k) AS place FROM (
SELECT a.symbol, a.time, n.row_idx AS k, {won} AS won, {lost} AS lost FROM (SELECT symbol, time, row_idx, {entry} AS e, {target} AS tp, {stop} AS sl, {side} AS s FROM {source}) a
JOIN {source} n ON n.symbol = a.symbol AND n.row_idx BETWEEN a.row_idx + {first} AND a.row_idx + {bars}) WHERE won OR lost GROUP BY symbol, time"""
