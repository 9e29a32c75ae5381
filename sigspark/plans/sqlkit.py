"""SQL text helpers for the oracle side of the reports."""

Z = 1.96


def w_lo(s, n):
    return f"CASE WHEN {n}>0 THEN greatest(0,({s}::DOUBLE/{n}+{Z}*{Z}/(2.0*{n}))/(1+{Z}*{Z}/{n})-{Z}*sqrt({s}::DOUBLE/{n}*(1-{s}::DOUBLE/{n})/{n}+{Z}*{Z}/(4.0*{n}*{n}))/(1+{Z}*{Z}/{n})) END"


def w_hi(s, n):
    return f"CASE WHEN {n}>0 THEN least(1,({s}::DOUBLE/{n}+{Z}*{Z}/(2.0*{n}))/(1+{Z}*{Z}/{n})+{Z}*sqrt({s}::DOUBLE/{n}*(1-{s}::DOUBLE/{n})/{n}+{Z}*{Z}/(4.0*{n}*{n}))/(1+{Z}*{Z}/{n})) END"


def robust(src, keys, val):
    k = keys or "1"
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}," if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel} count(*) AS n, avg(v_) AS mean, median(v_) AS median, avg(v_) FILTER (WHERE rn_>k_ AND rn_<=n_-k_) AS trimmed_mean
 FROM (SELECT {sel} {val} AS v_, row_number() OVER ({part} ORDER BY {val}) AS rn_, count(*) OVER ({part}) AS n_, floor(count(*) OVER ({part})*0.1) AS k_
 FROM ({src}) AS s_ WHERE {val} IS NOT NULL) AS r_ {grp}"""


def using(keys):
    return f"USING ({keys})" if keys else "ON true"


BUY = "(model='TOMORROW_TOP10' OR decision='BUY')"
LAB = "status IN ('SUCCESS','PARTIAL','FAIL','STOP')"


def summary(src, keys):
    base = f"SELECT * FROM ({src}) AS b_ WHERE completed AND return_pct IS NOT NULL"
    return f"""SELECT g_.*, r_.n, r_.mean, r_.median, r_.trimmed_mean, successes::DOUBLE/nullif(labelled,0) AS success_rate, {w_lo('successes','labelled')} AS success_low, {w_hi('successes','labelled')} AS success_high,
  fp::DOUBLE/nullif(fp+tn,0) AS fp_rate, fn::DOUBLE/nullif(fn+tp,0) AS fn_rate
 FROM (SELECT {keys}, count(*) AS evaluated, count(*) FILTER (WHERE {LAB}) AS labelled, count(*) FILTER (WHERE status='SUCCESS') AS successes,
  count(*) FILTER (WHERE return_pct>0) AS positive, count(*) FILTER (WHERE return_pct<0) AS negative, count(*) FILTER (WHERE return_pct=0) AS neutral,
  count(*) FILTER (WHERE target_hit) AS target_hits, count(*) FILTER (WHERE stop_hit) AS stop_hits,
  count(*) FILTER (WHERE {BUY} AND return_pct>0) AS tp, count(*) FILTER (WHERE {BUY} AND return_pct<=0) AS fp,
  count(*) FILTER (WHERE NOT {BUY} AND return_pct<=0) AS tn, count(*) FILTER (WHERE NOT {BUY} AND return_pct>0) AS fn
  FROM ({base}) AS q_ GROUP BY {keys}) AS g_ JOIN ({robust(base, keys, 'return_pct')}) AS r_ USING ({keys})"""


SUMMARY = "evaluated labelled successes positive negative neutral target_hits stop_hits tp fp tn fn mean median trimmed_mean success_rate success_low success_high fp_rate fn_rate".split()
SUMMARY_F = "mean median trimmed_mean success_rate success_low success_high fp_rate fn_rate"


def outcome_stats(src, keys):
    return f"""SELECT g_.*, r_.mean, r_.median, r_.trimmed_mean, positive::DOUBLE/nullif(completed_n,0) AS success_rate,
  CASE WHEN completed_n>=300 THEN 'HIGH' WHEN completed_n>=100 THEN 'MEDIUM' WHEN completed_n>=30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS reliability, completed_n>=30 AS sufficient,
  CASE WHEN completed_n>1 THEN sd_ END AS stddev, mean_win/abs(mean_loss) AS payoff_ratio, CASE WHEN negative>0 THEN coalesce(wins_,0)/abs(losses_) END AS profit_factor
 FROM (SELECT {keys}, count(*) AS total, count(*) FILTER (WHERE reason='PENDING') AS pending, count(*) FILTER (WHERE reason<>'PENDING') AS excluded,
  count(*) FILTER (WHERE reason IS NULL) AS completed_n, count(*) FILTER (WHERE reason IS NULL AND directional_return>0) AS positive,
  count(*) FILTER (WHERE reason IS NULL AND directional_return<0) AS negative, count(*) FILTER (WHERE reason IS NULL AND directional_return=0) AS neutral,
  max(directional_return) FILTER (WHERE reason IS NULL) AS best, min(directional_return) FILTER (WHERE reason IS NULL) AS worst,
  stddev_pop(directional_return) FILTER (WHERE reason IS NULL) AS sd_, avg(directional_return) FILTER (WHERE reason IS NULL AND directional_return>0) AS mean_win,
  avg(directional_return) FILTER (WHERE reason IS NULL AND directional_return<0) AS mean_loss, sum(directional_return) FILTER (WHERE reason IS NULL AND directional_return>0) AS wins_,
  sum(directional_return) FILTER (WHERE reason IS NULL AND directional_return<0) AS losses_, avg(return_pct) FILTER (WHERE reason IS NULL) AS mean_raw_return,
  avg(mfe) FILTER (WHERE reason IS NULL) AS mean_mfe, avg(mae) FILTER (WHERE reason IS NULL) AS mean_mae
  FROM ({src}) AS q_ GROUP BY {keys}) AS g_ LEFT JOIN ({robust(f"SELECT * FROM ({src}) AS w_ WHERE reason IS NULL", keys, 'directional_return')}) AS r_ USING ({keys})"""


STATS = "total pending excluded completed_n positive negative neutral best worst mean_win mean_loss mean_raw_return mean_mfe mean_mae mean median trimmed_mean success_rate reliability sufficient stddev payoff_ratio profit_factor".split()
STATS_F = "best worst mean_win mean_loss mean_raw_return mean_mfe mean_mae mean median trimmed_mean success_rate stddev payoff_ratio profit_factor"


def evidence(src, keys, minimum=40, days=5):
    k = f"{keys}," if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT g_.*, r_.mean, r_.median, r_.trimmed_mean, sample-wins-failures AS partials, wins::DOUBLE/sample AS success_rate, {w_lo('wins','sample')} AS success_low, {w_hi('wins','sample')} AS success_high,
  sample>={minimum} AND days>={days} AS sufficient
 FROM (SELECT {k} count(*) AS sample, count(DISTINCT session_no) AS days, count(*) FILTER (WHERE status='SUCCESS') AS wins, count(*) FILTER (WHERE status IN ('STOP','FAIL')) AS failures,
  min(directional_return) AS worst_return, max(directional_return) AS best_return, avg(CASE WHEN target_hit THEN 1.0 WHEN NOT target_hit THEN 0 END) AS target_hit_rate,
  avg(CASE WHEN stop_hit THEN 1.0 WHEN NOT stop_hit THEN 0 END) AS stop_hit_rate, min(CASE WHEN decision='SELL' THEN -max_rise ELSE max_drop END) AS adverse
  FROM ({src}) AS q_ {g}) AS g_ JOIN ({robust(src, keys, 'directional_return')}) AS r_ {using(keys)}"""


EV = "sample days wins failures partials worst_return best_return target_hit_rate stop_hit_rate adverse mean median trimmed_mean success_rate success_low success_high sufficient".split()
EV_F = "worst_return best_return target_hit_rate stop_hit_rate adverse mean median trimmed_mean success_rate success_low success_high"
HIDDEN = ("success_rate", "median", "trimmed_mean", "mean", "target_hit_rate", "stop_hit_rate", "worst_return", "best_return", "adverse")


def suppressed(sql):
    rep = ", ".join(f"CASE WHEN sufficient THEN {c} END AS {c}" for c in HIDDEN)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS sup_"


def cols(sql, *names):
    return f"SELECT {', '.join(names)} FROM ({sql}) AS pick_"
