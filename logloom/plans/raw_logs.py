"""Raw log lines derived from the ``events`` table: eight families of lines in equal parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.sources.tables import table

BASE = """SELECT event_id, ts, event_id % 8 AS kind, concat('192.168.', CAST(user_id % 4 AS {S}), '.', CAST(user_id % 250 + 1 AS {S})) AS src,
 concat('10.0.', CAST(event_id % 8 AS {S}), '.', CAST(event_id % 200 + 1 AS {S})) AS dst, CAST(49152 + event_id % 16384 AS {S}) AS spt,
 CASE CAST(FLOOR(event_id / 8) AS BIGINT) % 10 WHEN 0 THEN '22' WHEN 1 THEN '3389' WHEN 2 THEN '443' WHEN 3 THEN '80' WHEN 4 THEN '53' WHEN 5 THEN '21' WHEN 6 THEN '23' WHEN 7 THEN '4444' WHEN 8 THEN '6667' ELSE '8080' END AS dpt,
 CASE event_type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'drop' WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'allow' ELSE 'permit' END AS act,
 CASE WHEN event_id % 3 = 0 THEN 'udp' ELSE 'tcp' END AS proto, concat('u', CAST(user_id AS {S})) AS usr FROM events"""

LINES = """SELECT event_id, ts, CASE kind
 WHEN 0 THEN concat('<134>Jan 05 10:32:21 cisco-asa %ASA-4-106023: ', act, ' ', proto, ' src inside:', src, '/', spt, ' dst outside:', dst, '/', dpt, ' by access-group "acl-1"')
 WHEN 1 THEN concat('<13>Jan 05 10:32:21 fw01 kernel: ', CASE WHEN act IN ('deny','drop') THEN 'DROP' ELSE 'ACCEPT' END, ' IN=eth0 OUT=eth1 SRC=', src, ' DST=', dst, ' PROTO=', upper(proto), ' SPT=', spt, ' DPT=', dpt)
 WHEN 2 THEN concat('CEF:0|Acme|IDS|6.0|', CAST(2000000 + event_id % 97 AS {S}), '|', CASE WHEN event_id % 5 = 0 THEN 'port scan' ELSE 'policy hit' END, '|', CAST(event_id % 11 AS {S}), '|src=', src, ' dst=', dst, ' spt=', spt, ' dpt=', dpt, ' proto=', proto, ' act=', act, ' suser=', usr)
 WHEN 3 THEN concat('LEEF:1.0|Acme|SIEM|7.4|Login|src=', src, chr(9), 'dst=', dst, chr(9), 'srcPort=', spt, chr(9), 'dstPort=', dpt, chr(9), 'proto=', proto, chr(9), 'usrName=', usr)
 WHEN 4 THEN concat('{{"event_type":"alert","src_ip":"', src, '","src_port":', spt, ',"dest_ip":"', dst, '","dest_port":', dpt, ',"proto":"', proto, '","alert":{{"action":"', CASE WHEN act IN ('deny','drop') THEN 'blocked' ELSE 'allowed' END, '","severity":', CAST(event_id % 3 + 1 AS {S}), ',"signature":"sig"}}}}')
 WHEN 5 THEN concat('1,t,s,TRAFFIC,x,1,t,', src, ',', dst, ',0.0.0.0,0.0.0.0,rule-1,', usr, ',,web,v,a,b,c,d,e,t,9,1,', spt, ',', dpt, ',0,0,0x0,', proto, ',', act, ',1')
 WHEN 6 THEN concat('device="FG" src=', CASE WHEN event_id % 40 = 6 THEN 'bad-host' ELSE src END, ' dst=', dst, ' spt=', spt, ' dpt=', dpt, ' proto=', proto, ' action=', act, ' user=', usr)
 ELSE concat('GARBAGE-', CAST(event_id % 13 AS {S}), ' session started token') END AS raw_message FROM base"""


TASK_LINES = 50_000  # lines that a task parses, at most about


def lines_sql(string_type: str) -> str:
    """The lines as SQL, for engines that call texts ``string_type``."""
    return f"WITH base AS ({BASE.format(S=string_type)}) {LINES.format(S=string_type)}"


def lines_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """(raw_message, source, received_at, ingest_seq) of a statement over ``events`` that gives event_id, ts and raw_message."""
    # Lines cost far more to parse than to read, and a file's splits say nothing of how its rows lie in row groups: rows are dealt out by number.
    events = table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // TASK_LINES))
    events.repartition(tasks).createOrReplaceTempView("logloom_events")
    rows = spark.sql(sql.replace("FROM events", "FROM logloom_events"))
    return rows.selectExpr("raw_message", "'DERIVED' AS source", "CAST(ts AS TIMESTAMP) AS received_at", "event_id AS ingest_seq")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_table(spark, sf_dir, lines_sql("STRING"))
