"""Final decision and macro rule queries."""

from pyspark.sql import functions as F

from sigspark.operators import decision as dc
from sigspark.operators import scoring as sc
from sigspark.plans.indicators import wide
from sigspark.plans.registry import fragment, query
from sigspark.plans.scoring import BUYS, SELLS, rows, sql_sum
from sigspark.sources import fixtures as fx

_sg = lambda x, t=0: f"CASE WHEN {x}>{t} THEN 1 WHEN {x}<-{t} THEN -1 WHEN {x} IS NOT NULL THEN 0 END"
_cnt = lambda v: "+".join(f"CASE WHEN c_{c}={v} THEN 1 ELSE 0 END" for c in dc.TECH)
fragment("fd1_", f"SELECT *, greatest(0,least(100,50+{sql_sum(sc.TECHNICAL_RULES)})) AS score, greatest({BUYS},{SELLS}) AS conf0, {_sg('(macd-macd_signal)')} AS c_macd, {_sg('(sma20-sma50)')} AS c_trend, {_sg('momentum3', 0.05)} AS m0, {_sg('(close-sma20)')} AS c_position, CASE WHEN obv_divergence='NEGATIVE' THEN -1 WHEN obv_trend='RISING' THEN 1 WHEN obv_trend='FALLING' THEN -1 WHEN obv_trend='FLAT' THEN 0 END AS c_obv, CASE WHEN squeeze_break THEN 1 WHEN bb_lower_break THEN -1 WHEN bb_mid IS NOT NULL THEN 0 END AS c_bollinger, CASE WHEN rr>=1.5 THEN 1 WHEN rr IS NOT NULL THEN -1 END AS c_risk FROM wrow")
fragment("fd2_", "SELECT *, CASE WHEN c_macd*m0<0 THEN 0 ELSE m0 END AS c_momentum FROM fd1_")
fragment("fd3_", "SELECT *, CASE WHEN volume_ratio_incl>=100 AND c_momentum IN (1,-1) THEN c_momentum WHEN volume_ratio_incl IS NOT NULL THEN 0 END AS c_volume FROM fd2_")
fragment("fd4_", f"SELECT *, {_cnt(1)} AS ups, {_cnt(-1)} AS downs FROM fd3_")
fragment("fd5_", "SELECT *, (ups>=2 AND downs>=2) OR coalesce(c_macd=-1 AND c_position=1 AND c_obv=-1,false) AS mixed FROM fd4_")
fragment("fd6_", "SELECT *, CASE WHEN mixed THEN least(conf0,49) ELSE conf0 END AS confidence FROM fd5_")
fragment("fd7_", "SELECT *, concat_ws('|', CASE WHEN change_pct<=-7 THEN 'HARD_FALL' END, CASE WHEN change_pct>4 THEN 'EXTENDED_RISE' END, CASE WHEN NOT coalesce(c_risk=1,false) THEN 'RISK_REWARD' END, CASE WHEN rsi>=75 THEN 'OVERBOUGHT' END, CASE WHEN mixed THEN 'MIXED' END, CASE WHEN confidence<50 THEN 'LOW_CONFIDENCE' END) AS blocks FROM fd6_")
query("final_decision", """
 SELECT symbol, session_no, ups, downs, blocks, CASE WHEN b AND score>=82 AND ups>=5 AND coalesce(c_trend=1 AND c_momentum=1 AND c_volume=1,false) THEN 'STRONG_BUY' WHEN b THEN 'BUY' WHEN s AND score<=20 AND downs>=4 THEN 'STRONG_SELL' WHEN s THEN 'SELL' ELSE 'WAIT' END AS final
 FROM (SELECT *, blocks='' AND ups>=3 AND coalesce(c_trend=1 OR c_momentum=1,false) AND score>=70 AS b, confidence>=50 AND NOT mixed AND downs>=2 AND coalesce(c_trend=-1 OR c_momentum=-1,false) AND score<=35 AS s FROM fd7_) AS q""")(lambda s, d: _final(s, d))


def _final(s, d):
    extra = wide(s, d).select("symbol", "session_no", "obv_trend", "obv_divergence", "squeeze_break", "bb_lower_break", "bb_mid")
    x = sc.daily_scores(rows(s, d).withColumn("score", sc.technical_score())).withColumn("confidence", F.col("score_confidence").cast("double")).join(extra, ["symbol", "session_no"])
    return dc.final_decision(x).select("symbol", "session_no", "ups", "downs", "blocks", "final")


# Two groups over words the invented prose does hold, next to the domain groups.
GROUPS = (*dc.MACRO, ("FIXTURE_A", ("thou", "heth"), (("ALSO", ("erin",), 2.0, {"FINANCE": 1.5, "TRADE": 1.0}), ("ELSE", ("ation",), -1.0, {"FINANCE": -1.5}))),
          ("FIXTURE_B", ("hand",), (("ALSO", ("onthe", "tere"), 1.0, {"TRADE": -2.0}),)))


def macro_sql():
    has = lambda ws: "(" + " OR ".join(f"contains(t,'{w}')" for w in ws) + ")"
    cat, gen, sec = "'GENERAL'", [], {}
    for name, words, cases in GROUPS:
        cat = f"CASE WHEN {has(words)} THEN '{name}' ELSE {cat} END"
        before = "false"
        for kind, ws, add, eff in cases:
            hit = f"({has(words)} AND {has(ws)}" + (f" AND NOT {before})" if kind == "ELSE" else ")")
            before = hit
            gen.append(f"CASE WHEN {hit} THEN {add} ELSE 0 END")
            for k_, v in eff.items():
                sec[k_] = f"CASE WHEN {hit} THEN {v} ELSE {sec.get(k_, 'NULL::DOUBLE')} END"
    cols = ", ".join(f"{e} AS {k_.lower()}" for k_, e in sec.items())
    return f"SELECT doc_id, {cat} AS category, greatest(-10,least(10,{'+'.join(gen)})) AS general, {cols} FROM (SELECT doc_id, lower(text) AS t FROM documents) AS q", " ".join(k_.lower() for k_ in sec)


SQL, _cols = macro_sql()
#: Sectors that the rules name.
SECTORS = sorted(c.upper() for c in _cols.split())


@query("macro_rules_score", SQL, f="general " + _cols)
def macro_rules_score(s, d):
    cat, gen, sec = dc.macro_score(F.col("t"), GROUPS)
    return fx.table(s, d, "documents").select("doc_id", F.lower("text").alias("t")).select("doc_id", cat.alias("category"), gen.alias("general"), *[c.alias(k_.lower()) for k_, c in sec.items()])
