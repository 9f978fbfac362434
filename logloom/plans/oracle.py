"""What the derived log lines should give, as SQL over the columns that the lines were made from: no parsing."""

from __future__ import annotations

from logloom.plans.raw_logs import BASE, LINES

_RULES = (
    ("SIGMA-T1046-CISCO-002", "medium", "T1046", "Discovery", "kind = 0"),
    ("SIGMA-T1046-SCAN-001", "medium", "T1046", "Discovery", "kind = 2 AND seq % 5 = 0"),
    ("SIGMA-T1071-C2PORT-001", "critical", "T1071", "Command And Control", "dpt IN (4444, 6667)"),
    ("SIGMA-T1071-IRC-002", "high", "T1071", "Command And Control", "dpt = 6667 AND proto = 'TCP'"),
    ("SIGMA-T1110-RDP-002", "high", "T1110", "Credential Access", "dpt = 3389 AND action = 'blocked'"),
    ("SIGMA-T1110-SSH-001", "high", "T1110", "Credential Access", "dpt = 22 AND action = 'blocked'"),
    ("SIGMA-T1552-FTP-002", "low", "T1552", "Credential Access", "dpt = 21"),
    ("SIGMA-T1552-TELNET-001", "medium", "T1552", "Credential Access", "dpt = 23"),
)
_TITLES = {
    "SIGMA-T1046-CISCO-002": "Cisco Firewall Teardown or Scan Signature Event", "SIGMA-T1046-SCAN-001": "Network Service Discovery and Port Scanning",
    "SIGMA-T1071-C2PORT-001": "Outbound Traffic to Known C2 / Trojan Ports", "SIGMA-T1071-IRC-002": "IRC or Botnet Protocol Tunneling", "SIGMA-T1110-RDP-002": "RDP Remote Desktop Brute Force Attempt",
    "SIGMA-T1110-SSH-001": "SSH Brute Force Authentication Failure", "SIGMA-T1552-FTP-002": "Cleartext FTP Unsecured Authentication Protocol", "SIGMA-T1552-TELNET-001": "Cleartext Telnet Management Traffic",
}

_SID = """CASE WHEN kind = 0 OR kind = 5 THEN CASE WHEN b THEN 4 ELSE 1 END WHEN kind = 1 OR kind = 6 THEN CASE WHEN b THEN 3 ELSE 1 END
 WHEN kind = 2 THEN CASE WHEN event_id % 11 >= 8 THEN 5 WHEN event_id % 11 >= 6 THEN 4 WHEN event_id % 11 >= 4 THEN 3 WHEN event_id % 11 >= 2 THEN 2 ELSE 1 END
 WHEN kind = 3 THEN 3 WHEN kind = 4 THEN CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 3 END END"""

#: The expected rows ``e``: seq, ts, kind, raw, hash, code, format, parser_name, action, severity_id, severity, addresses and so on.
EXPECTED = f"""base AS ({BASE.format(S="VARCHAR")}), lines AS ({LINES.format(S="VARCHAR")}),
 f AS (SELECT base.*, raw_message AS raw, sha256(raw_message) AS hash, act IN ('deny', 'drop') AND kind <> 3 AS b FROM base JOIN lines USING (event_id)),
 g AS (SELECT *, {_SID} AS severity_id, sha256(concat_ws('|', hash, 'DERIVED', CAST(epoch_us(ts) AS VARCHAR), CAST(event_id AS VARCHAR))) AS k FROM f),
 e AS (SELECT event_id AS seq, ts, kind, raw, hash, severity_id,
  concat('EVT-', substr(k, 1, 8), '-', substr(k, 9, 4), '-', substr(k, 13, 4), '-', substr(k, 17, 4), '-', substr(k, 21, 12)) AS event_uid, concat('RAW-', substr(hash, 1, 8), '-', substr(k, 33, 8)) AS raw_uid,
  CASE WHEN kind = 7 THEN 'UNPARSEABLE_FORMAT' WHEN event_id % 40 = 6 THEN 'VALIDATION_FAILED' ELSE 'NORMAL' END AS code,
  CASE kind WHEN 0 THEN 'SYSLOG' WHEN 1 THEN 'SYSLOG' WHEN 2 THEN 'CEF/LEEF' WHEN 3 THEN 'CEF/LEEF' WHEN 4 THEN 'JSON' WHEN 5 THEN 'CSV/KV' WHEN 6 THEN 'CSV/KV' END AS format,
  CASE kind WHEN 0 THEN 'syslog_rfc_parser' WHEN 1 THEN 'syslog_rfc_parser' WHEN 2 THEN 'cef_leef_parser' WHEN 3 THEN 'cef_leef_parser' WHEN 4 THEN 'json_generic_parser' WHEN 5 THEN 'csv_kv_parser' WHEN 6 THEN 'csv_kv_parser' END AS parser_name,
  CASE WHEN kind < 7 THEN CASE WHEN b THEN 'blocked' ELSE 'allowed' END END AS action,
  CASE WHEN kind = 4 THEN CASE WHEN severity_id >= 4 THEN 'high' ELSE 'medium' END ELSE CASE severity_id WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'informational' END END AS severity,
  CASE WHEN kind < 7 THEN CASE WHEN event_id % 40 = 6 THEN 'bad-host' ELSE src END END AS src_ip, CASE WHEN kind < 7 THEN CAST(spt AS INTEGER) END AS spt, CASE WHEN kind < 7 THEN dst END AS dst_ip, CASE WHEN kind < 7 THEN CAST(dpt AS INTEGER) END AS dpt,
  CASE WHEN kind < 7 THEN upper(proto) END AS proto, CASE WHEN kind IN (2, 3, 5, 6) THEN usr END AS usr,
  CASE kind WHEN 0 THEN 'Cisco' WHEN 1 THEN 'Linux' WHEN 2 THEN 'Acme' WHEN 3 THEN 'Acme' WHEN 4 THEN 'Suricata' WHEN 5 THEN 'Palo Alto Networks' WHEN 6 THEN 'FG' END AS vendor,
  CASE kind WHEN 0 THEN 'ASA-Firewall' WHEN 1 THEN 'iptables' WHEN 2 THEN 'IDS' WHEN 3 THEN 'SIEM' WHEN 4 THEN 'EVE' WHEN 5 THEN 'PAN-OS' WHEN 6 THEN 'KV-Parser' END AS product,
  CASE kind WHEN 2 THEN '6.0' WHEN 3 THEN '7.4' END AS version,
  CASE kind WHEN 0 THEN 'cisco-asa' WHEN 1 THEN 'fw01' END AS observer_host,
  CASE kind WHEN 0 THEN 'firewall' WHEN 1 THEN 'firewall' WHEN 2 THEN 'ids' WHEN 3 THEN 'security_event' WHEN 4 THEN 'ids' WHEN 5 THEN 'firewall' WHEN 6 THEN 'kv_log' END AS type,
  CASE kind WHEN 0 THEN 'egress' WHEN 5 THEN 'egress' WHEN 2 THEN 'ingress' END AS direction,
  CASE kind WHEN 0 THEN 0.983 WHEN 1 THEN 0.973 WHEN 2 THEN 0.986 WHEN 3 THEN 0.99 WHEN 4 THEN 0.985 WHEN 5 THEN 0.977 WHEN 6 THEN 0.94 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN kind IN (0, 1) THEN strftime(ts, '%Y-01-05T10:32:21Z') WHEN kind < 7 AND epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN kind < 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS time_text
  FROM g),
 n AS (SELECT *, CASE WHEN dpt IN (22, 3389) AND action = 'blocked' THEN 'T1110' ELSE 'T1046' END AS technique, CASE WHEN dpt IN (22, 3389) AND action = 'blocked' THEN 'Credential Access' ELSE 'Discovery' END AS tactic,
  CASE WHEN dpt IN (22, 3389) AND action = 'blocked' THEN 'Brute Force' ELSE 'Network Service Discovery' END AS technique_name, CASE WHEN kind IN (0, 1) THEN make_timestamp(CAST(year(ts) AS BIGINT), 1, 5, 10, 32, 21.0) ELSE ts END AS occurred
  FROM e WHERE code = 'NORMAL'),
 message AS (SELECT seq, CASE kind WHEN 0 THEN concat('Cisco ASA firewall traffic: ', action, ' ', proto, ' connection') WHEN 1 THEN concat('Linux kernel packet filter: ', action, ' ', proto)
  WHEN 2 THEN CASE WHEN seq % 5 = 0 THEN 'port scan' ELSE 'policy hit' END WHEN 3 THEN 'LEEF Event: Login' WHEN 4 THEN 'sig' WHEN 5 THEN concat('Palo Alto PAN-OS TRAFFIC Event: ', action, ' ', proto) WHEN 6 THEN concat('KV Event: ', action, ' ', proto) END AS message FROM e),
 matches AS ({" UNION ALL ".join(f"SELECT seq, '{i}' AS rule_id, '{_TITLES[i]}' AS rule_title, '{lv}' AS severity, '{t}' AS technique_id, '{ta}' AS tactic FROM n WHERE {c}" for i, lv, t, ta, c in _RULES)})"""


def expected(body: str) -> str:
    return f"WITH {EXPECTED} {body}"


_AS_OF = "(SELECT max(ts) FROM events)"
_WINDOW = f"({_AS_OF} - INTERVAL 7 DAY)"
_RANKS = "CASE t WHEN 'Credential Access' THEN 8 WHEN 'Discovery' THEN 9 WHEN 'Command and Control' THEN 12 ELSE 999 END"
DETECTIONS = f"""made AS (SELECT m.seq, rule_title AS title, technique_id, CASE m.tactic WHEN 'Command And Control' THEN 'Command and Control' ELSE m.tactic END AS t, n.ts AS occurred, m.severity, src_ip, usr FROM matches m JOIN n USING (seq) WHERE n.ts > {_WINDOW}),
 tagged AS (SELECT seq, technique_name AS title, technique AS technique_id, tactic AS t, occurred, severity, src_ip, usr FROM n WHERE ts > {_WINDOW} AND seq NOT IN (SELECT seq FROM made)),
 detected AS (SELECT * FROM made UNION ALL SELECT * FROM tagged),
 found AS (SELECT 'IP' AS key_type, src_ip AS key, * FROM detected WHERE src_ip IS NOT NULL AND occurred >= {_WINDOW} UNION ALL SELECT 'USER', usr, * FROM detected WHERE usr IS NOT NULL AND occurred >= {_WINDOW}),
 entities AS (SELECT key_type, key, count(DISTINCT t) AS tactics, min(occurred) AS first_seen, max(occurred) AS last_seen, count(DISTINCT seq) AS events, count(*) AS detections,
  max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS score, array_to_string(list_transform(list_sort(list(DISTINCT {{'r': {_RANKS}, 't': t}})), lambda x: x.t), ' > ') AS chain FROM found GROUP BY key_type, key),
 incidents AS (SELECT concat('INC-', upper(substr(sha256(concat(key_type, '|', key)), 1, 8))) AS incident_key, *, CASE WHEN tactics >= 4 THEN least(greatest(score, 1) + 1, 4) WHEN tactics >= 3 AND greatest(score, 1) <= 1 THEN 2 ELSE greatest(score, 1) END AS s FROM entities WHERE tactics >= 2)"""


def detected(body: str) -> str:
    return f"WITH {EXPECTED}, {DETECTIONS} {body}"


MERKLE = """WITH RECURSIVE {expected}, leaves AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS batch_number, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, seq) - 1 AS i, hash FROM e),
 up AS (SELECT batch_number, 0 AS level, i, hash, count(*) OVER (PARTITION BY batch_number) AS n FROM leaves
  UNION ALL
  SELECT batch_number, level + 1, i // 2, sha256(concat(min_by(hash, i), max_by(hash, i))), CAST((max(n) + 1) // 2 AS BIGINT) FROM up WHERE n > 1 GROUP BY batch_number, level, i // 2)"""


def merkle(body: str) -> str:
    return f"{MERKLE.replace('{expected}', EXPECTED)} {body}"
