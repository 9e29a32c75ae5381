"""News identity queries with SQL that meets all pairs and walks the events one by one."""

from pyspark.sql import functions as F

from sigspark.operators import identity as idn
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

# Language stands in for the symbol, so that copies of a text meet; src0 is the official source.
fragment("idev", f"""
 SELECT doc_id AS news_id, lang AS symbol, CASE WHEN source='src0' THEN 'KAP' ELSE 'SIRKET_SITE' END AS kind, trim(substr(text,1,80)) AS title, substr(coalesce(text,''),1,{idn.BODY_CHARS}) AS body, 1704067200+doc_id*60 AS t
 FROM documents WHERE lang IS NOT NULL AND trim(substr(text,1,80))<>''""")
_stop = "[" + ",".join(f"'{w}'" for w in idn.STOP) + "]"
_words = "list_filter(string_split(trim(regexp_replace(translate(lower({0}),'çğıöşü','cgiosu'),'[^a-z0-9]+',' ','g')),' '), lambda w: w<>'' AND w<>lower(symbol))"
_num = "CASE WHEN contains(m.n,',') THEN replace(replace(m.n,'.',''),',','.') WHEN length(m.n)-length(replace(m.n,'.',''))>1 OR regexp_matches(m.n,'[.][0-9]{3}$') THEN replace(m.n,'.','') ELSE m.n END"
_amount = rf"""list_sort(list_distinct(list_transform(regexp_extract_all(translate(lower(title||' '||body),'çğıöşü','cgiosu'), '([0-9]+(?:[.,][0-9]+)*)\s*(milyon|milyar|million|billion)?\s*(tl|try|usd|dolar|eur|euro|%|adet)\b', ['n','s','u']),
  lambda m: CASE m.u WHEN 'try' THEN 'tl' WHEN 'dolar' THEN 'usd' WHEN 'euro' THEN 'eur' ELSE m.u END||'|'||coalesce(CAST(TRY_CAST({_num} AS DOUBLE)*CASE m.s WHEN 'milyon' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'milyar' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1 END AS VARCHAR),''))))"""
fragment("idprep", f"""
 SELECT news_id, symbol, kind, title, t, md5(symbol||chr(31)||kind||chr(31)||title||chr(31)||body) AS c, array_to_string({_words.format('title')},' ') AS tn, array_to_string({_words.format('body')},' ') AS bn,
  list_sort(list_filter(list_distinct({_words.format('title')}), lambda w: NOT list_contains({_stop}, w))) AS tk, {_amount} AS am FROM idev""", once=True)
fragment("idclass", "SELECT c, min(symbol) AS symbol, arg_min(news_id, (t, news_id)) AS named, any_value(tn) AS tn, any_value(bn) AS bn, any_value(tk) AS tk, any_value(am) AS am, list_filter(any_value(tk), lambda w: regexp_matches(w,'[0-9]')) AS fa FROM idprep GROUP BY c")
_lit = lambda ws: "[" + ",".join(f"'{w}'" for w in ws) + "]"
_except = lambda a, b: f"list_filter({a}, lambda w: NOT list_contains({b}, w))"
_gen, _all = _lit(idn.GENERIC), _lit((*idn.GENERIC, *idn.MONEY))
_turn = " OR ".join(f"contains(x.tn,'{w}')<>contains(y.tn,'{w}')" for w in idn.ACTIONS)
_unit = "list_distinct(list_transform({0}, lambda v: string_split(v,'|')[1]))"
fragment("idpair", f"""
 SELECT q.*, length(xb)>0 AND length(yb)>0 AS bodies, length(xb)>0 AND xb=yb AS same_body, len(shared) AS n, len(shared)/greatest(1,least(len(xt),len(yt)))::DOUBLE AS overlap FROM (
 SELECT x.c AS later, y.c AS earlier, x.named AS xn, y.named AS yn, x.tn=y.tn AS same_title, x.bn AS xb, y.bn AS yb, x.tk AS xt, y.tk AS yt, x.am AS xa, y.am AS ya, list_filter(x.tk, lambda w: list_contains(y.tk, w)) AS shared
 FROM (SELECT DISTINCT e.c AS ec, v.c AS vc FROM idprep e JOIN idprep v ON e.symbol=v.symbol AND (v.t<e.t OR (v.t=e.t AND v.news_id<e.news_id)) AND e.t-v.t<={idn.WINDOW} AND e.c<>v.c) AS p JOIN idclass x ON x.c=ec JOIN idclass y ON y.c=vc
 WHERE NOT ({_turn}) AND len(list_filter({_unit.format('x.am')}, lambda u: list_contains({_unit.format('y.am')}, u) AND list_filter(x.am, lambda v: string_split(v,'|')[1]=u)<>list_filter(y.am, lambda v: string_split(v,'|')[1]=u)))=0
  AND NOT (len(x.fa)>0 AND len(y.fa)>0 AND x.fa<>y.fa AND x.am<>y.am)) AS q""")
fragment("idstate", f"""
 SELECT *, CASE WHEN same_title AND (same_body OR NOT bodies) THEN 'EXACT_DUPLICATE' WHEN NOT same_title AND same_body AND length(xb)>=60 AND n>=2 THEN 'EXACT_DUPLICATE'
  WHEN NOT same_title AND len(xa)>0 AND xa=ya AND overlap>=0.75 AND n>=3 THEN 'LIKELY_DUPLICATE' END AS sure, overlap>=0.8 AND len({_except('shared', _gen)})>=2 AS fuzzy
 FROM idpair WHERE CASE WHEN same_title THEN NOT (len(xt)<3 AND NOT (same_body AND length(xb)>=60)) ELSE NOT (len({_except(_except('xt', 'yt'), _all)})>0 AND len({_except(_except('yt', 'xt'), _all)})>0) END""", once=True)
# The sequence ratio: longest common block (letters that are frequent in a long text only extend it), then both sides of it.
fragment("idask", """
 SELECT later||earlier||'B' AS id, xb AS a, yb AS b FROM idstate WHERE sure IS NULL AND bodies AND (same_title OR fuzzy) UNION ALL
 SELECT later||earlier||'T', array_to_string(xt,' '), array_to_string(yt,' ') FROM idstate WHERE sure IS NULL AND NOT same_title AND fuzzy""", once=True)
fragment("idrare", "SELECT * FROM (SELECT id, b, j, substr(b,j+1,1) AS ch, count(*) OVER (PARTITION BY id, substr(b,j+1,1)) AS k FROM (SELECT id, b, unnest(range(length(b))) AS j FROM idask) AS p) AS q WHERE length(b)<200 OR k<=length(b)//100+1")
fragment("idcore", """
 SELECT id, min(i) AS i, min(j) AS j, count(*) AS k FROM (SELECT id, i, j, i-row_number() OVER (PARTITION BY id, i-j ORDER BY i) AS g FROM (SELECT r.id, p.i, r.j FROM idrare r
 JOIN (SELECT id, i, substr(a,i+1,1) AS ch FROM (SELECT id, a, unnest(range(length(a))) AS i FROM idask) AS u) AS p ON p.id=r.id AND p.ch=r.ch) AS m) AS s GROUP BY id, i-j, g""", once=True)
_ahead = "coalesce(list_position(list_transform(range(least(ahi-{i}, bhi-{j})), lambda x: substr(a,{i}+x+1,1)=substr(b,{j}+x+1,1)), false)-1, least(ahi-{i}, bhi-{j}))"
_back = "coalesce(list_position(list_transform(range(least({i}-alo, {j}-blo)), lambda x: substr(a,{i}-x,1)=substr(b,{j}-x,1)), false)-1, least({i}-alo, {j}-blo))"
fragment("idblock", f"""
 SELECT id, CAST(0 AS BIGINT) AS alo, CAST(length(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(length(b) AS BIGINT) AS bhi, CAST(0 AS BIGINT) AS size FROM idask
 UNION ALL
 SELECT id, s.alo, s.ahi, s.blo, s.bhi, s.size FROM (
  SELECT id, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'size': 0}}, {{'alo': i+k, 'ahi': ahi, 'blo': j+k, 'bhi': bhi, 'size': 0}}, {{'alo': 0, 'ahi': 0, 'blo': 0, 'bhi': 0, 'size': k}}]) AS s FROM (
   SELECT id, alo, ahi, blo, bhi, i-pre AS i, j-pre AS j, pre+k+post AS k FROM (
    SELECT *, {_back.format(i='i', j='j')} AS pre, {_ahead.format(i='(i+k)', j='(j+k)')} AS post FROM (
     SELECT r.id, any_value(q.a) AS a, any_value(q.b) AS b, alo, ahi, blo, bhi, coalesce(arg_min(n.i, (-n.k, n.i, n.j)), alo) AS i, coalesce(arg_min(n.j, (-n.k, n.i, n.j)), blo) AS j, coalesce(max(n.k), 0) AS k
     FROM idblock r JOIN idask q ON q.id=r.id LEFT JOIN LATERAL (
      SELECT c.i+f AS i, c.j+f AS j, least(c.k, r.ahi-c.i, r.bhi-c.j)-f AS k FROM (SELECT *, greatest(0, r.alo-i, r.blo-j) AS f FROM idcore WHERE idcore.id=r.id) AS c WHERE least(c.k, r.ahi-c.i, r.bhi-c.j)-f>0) AS n ON true
     WHERE alo<ahi AND blo<bhi GROUP BY r.id, alo, ahi, blo, bhi) AS w) AS e) AS z WHERE k>0) AS y""")
fragment("idratio", "SELECT id, CASE WHEN min(length(a)+length(b))=0 THEN 1.0 ELSE 2.0*sum(size)/min(length(a)+length(b)) END AS ratio FROM idblock JOIN idask USING (id) GROUP BY id")
fragment("idlink", f"""
 SELECT later, earlier, xn, yn, verdict FROM (SELECT later, earlier, xn, yn, CASE WHEN sure IS NOT NULL THEN sure WHEN same_title THEN CASE WHEN rb.ratio>={idn.BODY_SAME_TITLE} THEN 'EXACT_DUPLICATE' END
  WHEN fuzzy AND rt.ratio>={idn.TITLE_LIKELY} AND (NOT bodies OR rb.ratio>={idn.BODY_LIKELY}) THEN 'LIKELY_DUPLICATE' END AS verdict
 FROM idstate LEFT JOIN idratio rb ON rb.id=later||earlier||'B' LEFT JOIN idratio rt ON rt.id=later||earlier||'T') AS v WHERE verdict IS NOT NULL""", once=True)


def events(s, d):
    n = fx.news(s, d)
    return n.select("news_id", F.col("lang").alias("symbol"), "title", "body", F.when(F.col("symbol") == "src0", idn.OFFICIAL).otherwise("SIRKET_SITE").alias("kind"),
                    F.lit(None).cast("string").alias("url"), F.col("published_at").alias("event_time"))


def _pairs(s, d):
    _, classes, links = idn.verdicts(events(s, d))
    named = lambda key, out: classes.select(F.col("class_id").alias(key), F.col("named").alias(out))
    return links.join(named("later", "news_id"), "later").join(named("earlier", "earlier_id"), "earlier").select("news_id", "earlier_id", "verdict")


query("news_pair_verdict", "SELECT xn AS news_id, yn AS earlier_id, verdict FROM idlink")(_pairs)

# Walked event by event: r holds, for each symbol, the record of every event so far.
fragment("idnum", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, news_id) AS k, tn||chr(31)||bn AS content FROM idprep", once=True)
fragment("idnear", f"""
 SELECT e.symbol, e.k, list({{'k': v.k, 'verdict': CASE WHEN e.c=v.c THEN 'EXACT_DUPLICATE' ELSE l.verdict END}} ORDER BY v.k) AS near FROM idnum e JOIN idnum v ON v.symbol=e.symbol AND v.k<e.k AND e.t-v.t<={idn.WINDOW}
 LEFT JOIN idlink l ON l.later=e.c AND l.earlier=v.c WHERE l.verdict IS NOT NULL OR (e.c=v.c AND (len(e.tk)>=3 OR length(e.bn)>=60)) GROUP BY e.symbol, e.k""", once=True)
fragment("idtwin", "SELECT e.symbol, list(e.t ORDER BY e.k) AS ts, list(e.content ORDER BY e.k) AS contents, max(e.k) AS last FROM idnum e GROUP BY e.symbol", once=True)
fragment("idwalk", f"""
 SELECT symbol, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS recs, CAST(NULL AS VARCHAR) AS verdict FROM idtwin
 UNION ALL
 SELECT symbol, k, list_append(recs, coalesce(rec, k)), list_filter(fit, lambda f: recs[f.k]=rec)[1].verdict FROM (
  SELECT *, list_max(list_transform(fit, lambda f: recs[f.k])) AS rec FROM (
   SELECT w.symbol, w.k+1 AS k, w.recs, list_filter(coalesce(n.near, []), lambda f: z.ts[w.k+1]-z.ts[w.recs[f.k]]<={idn.WINDOW} AND len(list_filter(range(w.recs[f.k], f.k), lambda u: w.recs[u]=w.recs[f.k] AND z.contents[u]=z.contents[f.k]))=0) AS fit
   FROM idwalk w JOIN idtwin z ON z.symbol=w.symbol LEFT JOIN idnear n ON n.symbol=w.symbol AND n.k=w.k+1 WHERE w.k<z.last) AS a) AS b""")
fragment("idcanon", "SELECT e.news_id, e.symbol, e.t, e.kind, e.title, a.news_id AS canonical_id, w.verdict FROM idwalk w JOIN idnum e ON e.symbol=w.symbol AND e.k=w.k JOIN idnum a ON a.symbol=w.symbol AND a.k=w.recs[w.k] WHERE w.k>0")
query("news_dedup_canonical", "SELECT news_id, canonical_id, verdict FROM idcanon")(lambda s, d: idn.canonical(events(s, d)).select("news_id", "canonical_id", "verdict"))
query("news_canonical_records", """
 SELECT canonical_id, min(symbol) AS symbol, count(*) AS n, CASE WHEN bool_and(kind='KAP') THEN 'KAP' WHEN bool_or(kind='KAP') THEN 'KAP + SIRKET_SITE' ELSE 'SIRKET_SITE' END AS sources,
  coalesce(arg_max(title, (t, news_id)) FILTER (WHERE kind='KAP'), arg_min(title, (t, news_id))) AS title, min(t) AS first_t, max(t) AS last_t FROM idcanon GROUP BY canonical_id""")(
    lambda s, d: idn.records(idn.canonical(events(s, d))))
