"""SQL fragments for the driver-table fixtures (DuckDB dialect)."""

from sigspark.plans.registry import fragment

fragment("symdim", """
 SELECT 'N'||lpad(CAST(n_nationkey AS VARCHAR),2,'0') AS symbol, r_name AS sector
 FROM nation JOIN region ON n_regionkey=r_regionkey""")

fragment("ticks_", """
 SELECT 'N'||lpad(CAST(s.s_nationkey AS VARCHAR),2,'0') AS symbol,
        CAST(date_trunc('week', l.l_shipdate) AS DATE) AS session,
        l.l_extendedprice/1000.0 AS price, l.l_quantity AS qty,
        row_number() OVER (PARTITION BY s.s_nationkey, date_trunc('week', l.l_shipdate)
          ORDER BY l.l_shipdate,l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_extendedprice,l.l_quantity) AS a,
        row_number() OVER (PARTITION BY s.s_nationkey, date_trunc('week', l.l_shipdate)
          ORDER BY l.l_shipdate DESC,l.l_orderkey DESC,l.l_linenumber DESC,l.l_partkey DESC,l.l_extendedprice DESC,l.l_quantity DESC) AS z
 FROM lineitem l JOIN supplier s ON l.l_suppkey=s.s_suppkey""")

fragment("bars", """
 SELECT t.symbol, min(d.sector) AS sector, t.session,
        max(CASE WHEN a=1 THEN price END) AS open, max(price) AS high, min(price) AS low,
        max(CASE WHEN z=1 THEN price END) AS close, sum(qty) AS volume,
        CAST(date_diff('day', DATE '1990-01-01', t.session)/7 AS BIGINT) AS session_no
 FROM ticks_ t JOIN symdim d ON t.symbol=d.symbol GROUP BY t.symbol, t.session""")

fragment("hours", """
 SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_start,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
        count(*)*100.0 AS volume, CAST(date_trunc('day', min(ts)) AS DATE) AS day,
        CAST(hour(date_trunc('hour', ts)) AS BIGINT) AS slot,
        CAST(epoch(date_trunc('hour', ts))/3600 AS BIGINT) AS bar_no
 FROM events GROUP BY event_type, date_trunc('hour', ts)""")

fragment("newsf", """
 SELECT doc_id AS news_id, source AS symbol, lang, substr(text,1,80) AS title, text AS body,
        TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS published_at
 FROM documents""")
