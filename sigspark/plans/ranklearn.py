"""Learned re-rank of the daily list: evidence before the training end, candidates after it."""

from pyspark.sql import functions as F

from sigspark.operators import ranklearn as rl
from sigspark.plans import sqlkit as k
from sigspark.plans.learning import _after
from sigspark.plans.records_fixture import predictions
from sigspark.plans.registry import fragment, query
from sigspark.plans.reports import conds_sql, ok

OWN = "TOMORROW_TOP10"
fragment("evh", f"SELECT * FROM okx WHERE due_no<(SELECT training_end FROM trainend) AND horizon IN ({', '.join(map(str, rl.HORIZONS))})")
_src = f"unnest(['ALL', CASE WHEN model='{OWN}' THEN 'OWN' END]) AS scope"
fragment("evtold", k.outcome_stats(f"SELECT * FROM (SELECT *, {_src} FROM ({conds_sql('evh')}) AS u_) AS v_ WHERE scope IS NOT NULL", "indicator, condition, scope, horizon"), once=True)
fragment("evbase", k.outcome_stats(f"SELECT * FROM (SELECT *, {_src} FROM evh) AS v_ WHERE scope IS NOT NULL", "scope, horizon"), once=True)
_ok = "{0}.completed_n>=30 AND {0}.positive+{0}.negative+{0}.neutral={0}.completed_n AND abs({0}.success_rate-{0}.positive/{0}.completed_n::DOUBLE)<0.0001 AND {0}.mean IS NOT NULL AND {0}.median IS NOT NULL"
_clip = "greatest(-{1},least({1},{0}))"
_edge = f"(0.4*{_clip.format('(e.success_rate-b.success_rate)/0.2', '1.0')}+0.3*{_clip.format('(e.mean-b.mean)/2.0', '1.0')}+0.3*{_clip.format('(e.median-b.median)/2.0', '1.0')})"
fragment("evedge", f"""
 SELECT indicator, condition, sum(edge*share*CASE horizon WHEN 1 THEN 0.8 WHEN 3 THEN 0.15 ELSE 0.05 END) AS edge, max(CASE WHEN horizon=1 THEN trust*share END) AS strength FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator, condition, horizon ORDER BY share DESC) AS pick FROM (
   SELECT indicator, condition, horizon, CASE scope WHEN 'OWN' THEN 1.0 ELSE 0.5 END::DOUBLE AS share, trust, raw*trust*CASE WHEN raw>0 AND mfe IS NOT NULL AND mae IS NOT NULL THEN greatest(0,least(1,greatest(0,mfe)/greatest(0.5,abs(mae)))) ELSE 1 END AS edge FROM (
    SELECT e.indicator, e.condition, e.horizon, e.scope, e.mean_mfe AS mfe, e.mean_mae AS mae, {_edge}::DOUBLE AS raw, CASE WHEN least(e.completed_n,b.completed_n)>=300 THEN 1.0 WHEN least(e.completed_n,b.completed_n)>=100 THEN 0.6 WHEN least(e.completed_n,b.completed_n)>=30 THEN 0.25 ELSE 0 END::DOUBLE AS trust
    FROM evtold e JOIN evbase b USING (scope, horizon) WHERE {_ok.format('e')} AND {_ok.format('b')} AND e.completed_n<=b.completed_n) AS x) AS y) AS z WHERE pick=1 GROUP BY indicator, condition HAVING strength IS NOT NULL""", once=True)
_fam = {n: f for f, names in rl.FAMILIES.items() for n in names}
_members = ", ".join(f"('{n}','{f}')" for n, f in _fam.items())
_combos = ", ".join(f"('{n}','{f}')" for n, fs in rl.COMBOS.items() for f in fs)
fragment("evadj", f"""
 WITH part AS (SELECT p.signal_id, p.indicator, e.edge, e.strength, f.family FROM ({conds_sql('(SELECT * FROM preds WHERE session_no>=(SELECT training_end FROM trainend)) AS p0_')}) AS p JOIN evedge e USING (indicator, condition) LEFT JOIN (VALUES {_members}) AS f(ind, family) ON f.ind=p.indicator),
 fam AS (SELECT signal_id, family, {_clip.format('sum(edge)/count(*)*0.75', '0.75')} AS v, max(strength) AS s FROM part WHERE family IS NOT NULL GROUP BY ALL),
 able AS (SELECT c.signal_id, c.indicator, any_value(c.edge) AS edge FROM part c JOIN (VALUES {_combos}) AS m(ind, family) ON m.ind=c.indicator LEFT JOIN fam ON fam.signal_id=c.signal_id AND fam.family=m.family WHERE c.edge<>0 GROUP BY c.signal_id, c.indicator HAVING any_value(c.strength)>=max(coalesce(fam.s,0))),
 best AS (SELECT signal_id, arg_max(indicator, (abs(edge), indicator)) AS combo, arg_max(edge, (abs(edge), indicator)) AS edge FROM able GROUP BY signal_id),
 tot AS (SELECT q.signal_id, round(coalesce((SELECT sum(v) FROM fam WHERE fam.signal_id=q.signal_id AND NOT EXISTS (SELECT 1 FROM (VALUES {_combos}) AS m(ind, family) WHERE m.ind=b.combo AND m.family=fam.family)),0)+CASE WHEN b.edge IS NULL THEN 0 ELSE {_clip.format('b.edge', '1.0')} END,6) AS uncapped FROM (SELECT signal_id FROM preds WHERE session_no>=(SELECT training_end FROM trainend)) q LEFT JOIN best b USING (signal_id))
 SELECT signal_id, uncapped, round({_clip.format('uncapped', '3.0')},6) AS adjustment FROM tot""")
query("learned_rank_adjustment", """
 SELECT signal_id, session_no, uncapped, adjustment, final_score, learned_rank, rank-learned_rank AS rank_change FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY final_score DESC NULLS LAST, rank) AS learned_rank FROM (
  SELECT signal_id, session_no, rank, uncapped, adjustment, round(CASE WHEN adjustment<>0 THEN greatest(0,least(100,score+adjustment)) ELSE score END,6) AS final_score FROM evadj JOIN preds USING (signal_id)) AS a) AS b""", f="uncapped adjustment final_score")(
    lambda s, d: learned(s, d).select("signal_id", "session_no", "uncapped", "adjustment", "final_score", "learned_rank", "rank_change"))
query("tomorrow_top10_learned", """
 SELECT session_no, symbol, rank AS base_rank, learned_rank, final_score FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY final_score DESC NULLS LAST, rank) AS learned_rank FROM (
  SELECT p.session_no, p.symbol, p.rank, round(CASE WHEN adjustment<>0 THEN greatest(0,least(100,score+adjustment)) ELSE score END,6) AS final_score FROM evadj JOIN preds p USING (signal_id)) AS a) AS b WHERE learned_rank<=10""", f="final_score")(
    lambda s, d: learned(s, d).filter("learned_rank <= 10").select("session_no", "symbol", F.col("rank").alias("base_rank"), "learned_rank", "final_score"))


def learned(s, d):
    table = rl.evidence(_after(s, d, ok(s, d), "due_no < training_end"), F.col("model") == OWN)
    rows = _after(s, d, predictions(s, d), "session_no >= training_end")
    return rl.reranked(rl.adjusted(rows, table), "session_no")
