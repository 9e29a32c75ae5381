"""The plan for the next session."""

from pyspark.sql import functions as F

from sigspark.operators import plan as pl
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

# Rules written out once more in SQL, so that a wrong one on either side shows.
YES = {
    "ABOVE_SMA20": "close>sma20", "TREND_UP": "sma20>sma50", "RSI_BALANCED": "rsi>=45 AND rsi<=70", "MACD_POSITIVE": "macd_state='POSITIVE'", "VOLUME": "volume_ratio>=130",
    "STRUCTURE": "valid", "RISK_REWARD": "valid AND rr_>=1.2", "POSITIVE_BODY": "close>open",
}
NO = {
    "NO_VOLUME": "volume_ratio IS NULL", "WEAK_VOLUME": "volume_ratio<130", "NEAR_RESISTANCE": "resistance>close AND resistance-close<=atr14*0.25", "NO_STRUCTURE": "NOT valid",
    "LOW_RISK_REWARD": "valid AND rr_<1.2", "RSI_HIGH": "rsi>=70", "EXTENDED": "abs(close-ema21)/atr14>3", "NEGATIVE_TREND": "trend_state='NEGATIVE'", "CRASH": "change_pct<=-7+1e-9",
    "STALE": "asked_no>session_no",
}
_list = lambda rules: "concat_ws('|', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in rules.items()) + ")"
fragment("planin", """
 SELECT *, least(close, greatest(support, least(sma20, ema21))) AS anchor,
  CASE WHEN macd_hist IS NULL OR old IS NULL THEN NULL WHEN macd_hist>0 AND macd_hist>=old THEN 'POSITIVE' WHEN macd_hist>old THEN 'IMPROVING' WHEN macd_hist>0 THEN 'WEAKENING' ELSE 'NEGATIVE' END AS macd_state,
  CASE WHEN close>sma20 AND sma20>sma50 THEN 'POSITIVE' WHEN close<sma20 AND sma20<sma50 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS trend_state
 FROM (SELECT *, unnest(generate_series(session_no, coalesce(nxt-1, last_no))) AS asked_no FROM (
  SELECT *, min(low) OVER p AS support, max(high) OVER p AS resistance, lag(macd_hist) OVER w AS old, lead(session_no) OVER w AS nxt, max(session_no) OVER () AS last_no,
   coalesce(session_no-lag(session_no,50) OVER w=50 AND atr14>0 AND bool_and(low>0 AND high>=greatest(open,close) AND low<=least(open,close)) OVER v, false) AS ready
  FROM wrow WINDOW w AS (PARTITION BY symbol ORDER BY session_no), p AS (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
   v AS (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)) AS a) AS b""")
fragment("planlv", """
 SELECT *, coalesce(support<close AND resistance>support AND support>0 AND atr14>0 AND sma20>0 AND ema21>0 AND stop>0 AND stop<low_ AND low_<=high_ AND high_<gain AND gain<=most, false) AS valid,
  (low_+high_)/2 AS entry, (gain-(low_+high_)/2)/nullif((low_+high_)/2-stop,0) AS rr_
 FROM (SELECT *, greatest(support, anchor-atr14*0.23) AS low_, least(close, anchor+atr14*0.03, resistance-atr14*0.1) AS high_, support-atr14*0.25 AS stop,
  least(resistance, close+atr14*0.5) AS gain, least(resistance+atr14*0.25, close+atr14*0.8) AS most FROM planin) AS q""")
_SHOWN = {"buy_zone_low": "low_", "buy_zone_high": "high_", "take_profit_low": "gain", "take_profit_high": "most", "stop_loss": "stop", "risk_reward_ratio": "rr_", "entry_reference": "entry"}
_off = "".join(f"-CASE WHEN {NO[k]} THEN {v} ELSE 0 END" for k, v in (("NEAR_RESISTANCE", 15), ("LOW_RISK_REWARD", 15), ("RSI_HIGH", 10), ("EXTENDED", 25)))
_count = "+".join(f"CASE WHEN {v} THEN 1 ELSE 0 END" for v in YES.values())
_blocked = " OR ".join(f"coalesce({NO[k]},false)" for k in ("NEGATIVE_TREND", "CRASH", "EXTENDED", "STALE", "NO_STRUCTURE"))
query("tomorrow_plan", f"""
 WITH c AS (SELECT *, ({_blocked}) AS blocked, ({_count})::BIGINT AS n, ({_count})/8.0::DOUBLE*100*CASE WHEN volume_ratio IS NULL THEN 0.75 ELSE 1 END{_off} AS conf FROM planlv),
 e AS (SELECT *, round_even(greatest(0, least(100, CASE WHEN blocked THEN least(35, conf) ELSE conf END))::DOUBLE, 2) AS sure FROM c)
 SELECT symbol, asked_no, session_no, session_no+1 AS plan_no, CASE WHEN ready THEN close END AS reference_price, CASE WHEN ready THEN e.support END AS support, CASE WHEN ready THEN e.resistance END AS resistance,
  CASE WHEN ready THEN e.macd_state END AS macd_state, CASE WHEN ready THEN e.trend_state END AS trend_state,
  CASE WHEN ready THEN CASE WHEN close<=e.resistance THEN 'WAITING' WHEN volume_ratio>=130 AND close>open THEN 'CONFIRMED' ELSE 'WEAK' END END AS breakout_status,
  CASE WHEN ready AND e.resistance>0 AND e.resistance+atr14*0.6>close THEN e.resistance+atr14*0.6 END AS breakout_target,
  {', '.join(f'CASE WHEN ready AND valid AND NOT blocked THEN {v} END AS {k}' for k, v in _SHOWN.items())},
  CASE WHEN ready THEN sure END AS confidence, CASE WHEN ready THEN {_list(YES)} END AS reasons, CASE WHEN ready THEN n ELSE 0 END AS confirmation_count,
  CASE WHEN ready THEN {_list(NO)} ELSE 'DAILY_DATA' END AS warnings,
  CASE WHEN NOT ready THEN 'INSUFFICIENT' WHEN blocked THEN 'WAIT' WHEN n>=6 AND sure>=70 AND valid AND rr_>=1.2 AND volume_ratio IS NOT NULL THEN 'BUYABLE' ELSE 'CAUTIOUS' END AS plan_status FROM e""",
      f=" ".join(["reference_price", "support", "resistance", "breakout_target", *_SHOWN, "confidence"]))(
    lambda s, d: pl.tomorrow_plan(fx.weekly_bars(s, d)).withColumns({k: F.array_join(k, "|") for k in ("reasons", "warnings")}))
