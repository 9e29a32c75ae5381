"""Transfer of weight within families, over all criteria and horizons."""

from pyspark.sql import functions as F

from sigspark.operators import flags as fl
from sigspark.operators import transfer as tr
from sigspark.plans.flags import FAMILY_OF, RULES, evidence_inputs
from sigspark.plans.registry import fragment, query
from sigspark.plans.reports import ev_report_sql, ok

# The fixture has no earlier model: the first round starts from the base weights.
_names = ", ".join(f"({i}, '{c}', '{FAMILY_OF[c]}', {fl.BASE_WEIGHT[c]!r}::DOUBLE)" for i, c in enumerate(RULES))
fragment("trflag", f"SELECT signal_id, unnest([{', '.join(repr(k) for k in RULES)}]) AS criterion, unnest([{', '.join(f'CASE WHEN known THEN {v} END' for v in RULES.values())}]) AS flag FROM evin", once=True)
fragment("trrow", "SELECT o.horizon, o.signal_id, o.model, o.session_no, o.status, o.directional_return, o.target_hit, o.stop_hit, o.decision, o.max_rise, o.max_drop, f.criterion, f.flag FROM okx o JOIN trflag f ON f.signal_id=o.signal_id", once=True)
fragment("trrep", f"SELECT horizon, place, criterion, family, base, coalesce(direction,'SAME') AS direction, yes_sample, no_sample, difference FROM (SELECT DISTINCT horizon FROM trrow) AS h CROSS JOIN (VALUES {_names}) AS n(place, criterion, family, base) LEFT JOIN ({ev_report_sql('SELECT * FROM trrow', 'horizon')}) AS r USING (horizon, criterion)", once=True)
fragment("trmove", "SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY place) AS pos FROM trrep WHERE direction<>'SAME' AND family<>'decision'", once=True)
fragment("trpair", """
 SELECT a.horizon, a.place AS pa, b.place AS pb, count(*) AS matches, count(*) FILTER (WHERE x.flag=y.flag)/count(*)::DOUBLE AS share
 FROM trmove a JOIN trmove b ON a.horizon=b.horizon AND b.place<a.place JOIN trrow x ON x.horizon=a.horizon AND x.criterion=a.criterion
 JOIN trrow y ON y.horizon=b.horizon AND y.criterion=b.criterion AND y.signal_id=x.signal_id WHERE x.flag IS NOT NULL AND y.flag IS NOT NULL GROUP BY ALL HAVING count(*)>=40 AND count(*) FILTER (WHERE x.flag=y.flag)>=0.85*count(*)""", once=True)
fragment("trnear", "SELECT m.horizon, m.pos, m.place, coalesce(list(p.pb) FILTER (WHERE p.pb IS NOT NULL), []) AS near FROM trmove m LEFT JOIN trpair p ON p.horizon=m.horizon AND p.pa=m.place GROUP BY ALL", once=True)
fragment("trpick", """
 SELECT DISTINCT horizon, 0::BIGINT AS pos, []::INTEGER[] AS reps FROM trmove
 UNION ALL SELECT r.horizon, m.pos, CASE WHEN list_has_any(r.reps, m.near) THEN r.reps ELSE list_append(r.reps, m.place) END FROM trpick r JOIN trnear m ON m.horizon=r.horizon AND m.pos=r.pos+1""")
query("family_transfer", """
 WITH reps AS (SELECT horizon, unnest(arg_max(reps, pos)) AS place FROM trpick GROUP BY horizon),
 rep AS (SELECT m.horizon, m.place, CASE WHEN s.place IS NOT NULL THEN m.place ELSE min(p.pb) END AS representative, any_value(s.place) AS own FROM trmove m LEFT JOIN reps s ON s.horizon=m.horizon AND s.place=m.place
  LEFT JOIN (SELECT p.* FROM trpair p JOIN reps q ON q.horizon=p.horizon AND q.place=p.pb) AS p ON p.horizon=m.horizon AND p.pa=m.place GROUP BY m.horizon, m.place, s.place),
 t AS (SELECT horizon, family, min(place) FILTER (WHERE own=place AND direction='UP') AS winner, min(place) FILTER (WHERE own=place AND direction='DOWN') AS loser FROM trrep JOIN rep USING (horizon, place) GROUP BY horizon, family),
 g AS (SELECT t.*, greatest(0, least(0.0025, least(u.base*0.5, 0.005), least(l.base*0.5, 0.005))) AS delta FROM t JOIN trrep u ON u.horizon=t.horizon AND u.place=winner JOIN trrep l ON l.horizon=t.horizon AND l.place=loser)
 SELECT r.horizon, r.criterion, r.family, r.direction, n.criterion AS representative, p.share AS agreement, r.base AS "current", r.base+CASE WHEN r.place=g.winner THEN g.delta WHEN r.place=g.loser THEN -g.delta ELSE 0 END AS proposed, r.yes_sample, r.no_sample, r.difference
 FROM trrep r LEFT JOIN rep e ON e.horizon=r.horizon AND e.place=r.place LEFT JOIN trrep n ON n.horizon=r.horizon AND n.place=e.representative
  LEFT JOIN trpair p ON p.horizon=r.horizon AND p.pa=r.place AND p.pb=e.representative LEFT JOIN g ON g.horizon=r.horizon AND g.family=r.family""",
      f='agreement "current" proposed difference')(lambda s, d: _transfer(s, d))


def flagged(s, d):
    """Evaluated records of all horizons with the criteria as columns."""
    marks = fl.evidence_flags(F.col("known"))
    told = evidence_inputs(s, d).select("signal_id", *[v.alias(c) for c, v in marks.items()])
    keep = ("signal_id", "horizon", "session_no", "status", "directional_return", "target_hit", "stop_hit", "decision", "max_rise", "max_drop")
    return ok(s, d).select(*keep).join(told, "signal_id")


def _transfer(s, d):
    weights = s.createDataFrame([(c, w, w, w) for c, w in fl.BASE_WEIGHT.items()], "criterion string, base double, baseline double, current double")
    return tr.family_transfer(flagged(s, d), weights, ["horizon"])
