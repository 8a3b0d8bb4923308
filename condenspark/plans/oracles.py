"""DuckDB SQL of the registered log queries."""

from __future__ import annotations

from condenspark.functions.normalize import CLASSES
from condenspark.functions.severity import ICONS, LEVELS
from condenspark.plans import shapes

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END"
_CODE = "CASE event_type WHEN 'error' THEN 6 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 WHEN 'click' THEN 3 ELSE 2 END"
_CENTS = "CAST(round(abs(value) * 100) AS BIGINT)"
_BODY = f"'user ' || user_id || ' ' || event_type || ' value=' || CASE WHEN value < 0 THEN '-' ELSE '' END || ({_CENTS} // 100) || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') || ' props=' || props"
_L = rf"""e AS (SELECT event_id AS event_no, ts, {_CODE} AS severity, {_LEVEL} AS level, {_BODY} AS content,
             regexp_replace({_BODY}, '\b\d+(\.\d+)?\b', '[NUM]', 'g') AS template, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || {_LEVEL} || '] ' AS prefix FROM events)"""
_D = f"""{_L}, r AS (SELECT *, row_number() OVER (PARTITION BY severity, template ORDER BY event_no) AS nth FROM e),
d AS (SELECT *, CASE WHEN nth = 10 AND severity >= 6 THEN 'anomaly' WHEN nth = 1 THEN 'event' ELSE 'repeat' END AS decision FROM r)"""
_HOURS = "h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket, count(*) AS n FROM events GROUP BY ALL)"
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS HUGEINT))), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_V = f"v AS (SELECT line_no, prefix, prefix || message AS raw, {shapes.PARSED} AS severity FROM (SELECT event_id AS line_no, {shapes.PREFIX} AS prefix, {shapes.MESSAGE} AS message, prefix || message AS raw FROM events))"
_W, _HOUR = 3, 3600
#: By the events' own clock: counts by pattern and hour, the baseline before each, the events from which it is a spike, and the pause.
_C = f"""{_L}, hours AS (SELECT severity, template, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, count(*) AS n FROM e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY severity, template ORDER BY b) AS i, coalesce(sum(n) OVER (PARTITION BY severity, template ORDER BY b RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS earlier FROM hours),
f AS (SELECT severity, template, i, b, n, earlier, CAST(0 AS DOUBLE) AS base, CAST(0 AS BIGINT) AS k FROM o WHERE i = 1
      UNION ALL SELECT o.severity, o.template, o.i, o.b, o.n, o.earlier,
        CASE WHEN f.k = 0 THEN f.n * 60.0::DOUBLE / 3600 ELSE 0.05::DOUBLE * (f.n * 60.0::DOUBLE / 3600) + (1 - 0.05::DOUBLE) * f.base END * pow(1 - 0.05::DOUBLE, least(o.b - f.b, 3) - 1),
        f.k + least(o.b - f.b, 3) FROM f JOIN o ON o.severity = f.severity AND o.template = f.template AND o.i = f.i + 1),
q AS (SELECT e.event_no, e.severity, e.template, e.ts, f.earlier + row_number() OVER (PARTITION BY e.severity, e.template, f.b ORDER BY e.ts, e.event_no) AS n, f.base, f.k >= 3 AND f.base > 0 AS known
      FROM e JOIN f ON f.severity = e.severity AND f.template = e.template AND f.b = CAST(floor(epoch(e.ts) / 3600) AS BIGINT)),
hot AS (SELECT *, row_number() OVER (PARTITION BY severity, template ORDER BY ts, event_no) AS i FROM q
        WHERE n >= 5 AND CASE WHEN known THEN n * 60.0::DOUBLE / 10800 >= base * (CASE WHEN severity >= 6 THEN 1.2 ELSE 1.5 END)::DOUBLE ELSE severity >= 6 AND n >= 10 AND n * 60.0::DOUBLE / 10800 >= 1.2::DOUBLE END),
nx AS (SELECT a.severity, a.template, a.i, min(z.i) AS j FROM hot a LEFT JOIN hot z ON z.severity = a.severity AND z.template = a.template AND z.i > a.i AND z.ts >= a.ts + INTERVAL 12 HOUR GROUP BY ALL),
al AS (SELECT severity, template, CAST(1 AS BIGINT) AS i FROM hot WHERE i = 1 UNION ALL SELECT nx.severity, nx.template, nx.j FROM al JOIN nx USING (severity, template, i) WHERE nx.j IS NOT NULL),
alerts AS (SELECT hot.event_no, hot.template, hot.severity, round(CASE WHEN known THEN base ELSE 1 END, 6) AS baseline_per_min, round(n * 60.0::DOUBLE / 10800, 6) AS current_per_min, NOT known AS bootstrap FROM hot JOIN al USING (severity, template, i))"""

ORACLES = {
    "dominant_shapes": f"WITH {_L} SELECT level, template, count(*) AS total_count, arg_min(content, event_no) AS example FROM e GROUP BY ALL",
    "severity_detect": f"WITH {_V} SELECT line_no, severity, {_LIST(LEVELS)}[severity + 1] AS level, CASE severity WHEN 0 THEN 3 ELSE severity END AS rank, {_LIST(ICONS)}[severity + 1] AS icon, CAST(length(prefix) AS INTEGER) AS consumed FROM v",
    "prefix_strip": rf"WITH {_V} SELECT line_no, substr(raw, length(prefix) + 1) AS content, regexp_replace(raw, '^\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d ', '') AS without_time FROM v",
    "norm_documents": f"WITH {{LINES}}, c AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{p}')" for n, p, _ in CLASSES)}) t(class, pattern)) SELECT class, count(*) AS lines FROM l, c WHERE regexp_matches(raw, pattern) GROUP BY class",
    "template_full": f"WITH {_L} SELECT event_no, template FROM e",
    "fingerprints": f"WITH {_L}, p AS (SELECT DISTINCT severity, template, printf('%02x', severity) || '00' || lower(hex(encode(template))) AS x FROM e) SELECT severity, template, lower(lpad(hex(CAST({_FNV} AS UBIGINT)), 16, '0')) AS fingerprint FROM p",
    "pattern_counts": f"WITH {_L} SELECT severity, template, count(*) AS total_count, min(event_no) AS first_no, max(event_no) AS last_no, min(ts) AS first_seen, max(ts) AS last_seen FROM e GROUP BY ALL",
    "pattern_example": f"WITH {_L} SELECT severity, template, arg_min(content, event_no) AS example FROM e GROUP BY ALL",
    "novelty": f"WITH {_D} SELECT event_no, true AS is_new FROM d WHERE nth = 1",
    "decisions_constant_clock": f"WITH {_D} SELECT event_no, decision FROM d",
    "repeat_summaries": f"WITH {_D} SELECT severity, template, count(*) AS count FROM d WHERE decision = 'repeat' GROUP BY ALL",
    "suppression_report": f"""WITH {_D} SELECT count(*) AS raw_lines, count(*) FILTER (decision <> 'repeat') AS displayed_events, count(*) FILTER (decision = 'repeat') AS suppressed_events,
CAST(sum(octet_length(encode(prefix || content)) + 1) AS BIGINT) AS raw_bytes, CAST(0 AS BIGINT) AS truncated_lines, CAST(0 AS BIGINT) AS patterns_evicted, count(*) FILTER (decision <> 'repeat') AS displayed_raw_lines, count(*) FILTER (decision = 'repeat') AS suppressed_raw_lines, count(*) FILTER (severity = 5) AS warning_events, count(*) FILTER (severity >= 6) AS error_events,
count(*) FILTER (decision = 'anomaly') AS anomaly_events, count(DISTINCT (severity, template)) AS structural_patterns,
round(100.0::DOUBLE * count(*) FILTER (decision = 'repeat') / count(*), 2) AS logical_event_suppression_percentage, round(100.0::DOUBLE * count(*) FILTER (decision = 'repeat') / count(*), 2) AS raw_line_suppression_percentage FROM d""",
    "bucket_counts": f"WITH {_HOURS} SELECT * FROM h",
    "rolling_rate": f"WITH {_HOURS}, w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_events FROM h) SELECT *, round(window_events * 60.0::DOUBLE / 10800, 6) AS rate_per_min FROM w",
    "ewma_baseline": f"""WITH RECURSIVE {_HOURS}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS i FROM h),
f AS (SELECT event_type, i, bucket, n, CAST(NULL AS DOUBLE) AS b, CAST(0 AS BIGINT) AS k FROM o WHERE i = 1
      UNION ALL SELECT o.event_type, o.i, o.bucket, o.n,
        CASE WHEN f.k = 0 THEN f.n * 60.0::DOUBLE / 3600 ELSE 0.05::DOUBLE * (f.n * 60.0::DOUBLE / 3600) + (1 - 0.05::DOUBLE) * f.b END * pow(1 - 0.05::DOUBLE, least((o.bucket - f.bucket) // 3600, 3) - 1),
        f.k + least((o.bucket - f.bucket) // 3600, 3) FROM f JOIN o ON o.event_type = f.event_type AND o.i = f.i + 1)
SELECT event_type, round(arg_max(b, i), 6) AS baseline_per_min, arg_max(k, i) AS samples FROM f GROUP BY event_type""",
    "conversation_novelty": "SELECT severity, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS turns FROM (SELECT role AS severity, text, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY severity",
    "lru_novelty": """WITH a AS (SELECT event_id AS i, user_id AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
s AS (SELECT a.i, a.k, a.p, (SELECT count(DISTINCT b.user_id) FROM events b WHERE b.event_id > a.p AND b.event_id < a.i) AS others FROM a)
SELECT k AS user_id, count(*) AS accesses, count(*) FILTER (p IS NULL OR others >= 50) AS generations FROM s GROUP BY k""",
    "retention": "SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text))) AS retained FROM benchmark b",
    "order_patterns": "SELECT o_orderpriority AS severity, o_orderstatus AS template, count(*) AS total_count, min(o_orderkey) AS first_no, max(o_orderkey) AS last_no FROM orders GROUP BY ALL",
    "lineitem_patterns": "SELECT l_returnflag AS severity, l_linestatus AS template, count(*) AS total_count, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL",
}
_LINES = "l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(string_split(text, chr(10))[i], '\\r$', '') AS raw FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
ORACLES["correctness_report"] = f"""WITH {_D}, m AS (SELECT level, ['user ' || arg_min(regexp_extract(content, '^user (\\d+) ', 1), event_no) || ' ', 'user ' || arg_max(regexp_extract(content, '^user (\\d+) ', 1), event_no) || ' ', 'user nobody'] AS wanted FROM d GROUP BY level),
k AS (SELECT level, wanted, list_filter(wanted, lambda w: len(list_filter(shown, lambda s: contains(s, w))) = 0) AS missed FROM m JOIN (SELECT level, list(content) AS shown FROM d WHERE decision <> 'repeat' GROUP BY level) USING (level)),
t AS (SELECT level, count(*) AS n, count(*) FILTER (decision <> 'repeat') AS shown, count(DISTINCT (severity, template)) AS patterns, count(*) FILTER (decision = 'anomaly') AS anomalies FROM d GROUP BY level)
SELECT CASE level WHEN 'ERROR' THEN 'error' WHEN 'NOTICE' THEN 'signup' WHEN 'WARN' THEN 'purchase' WHEN 'INFO' THEN 'click' ELSE 'view' END AS scenario, n AS input_lines, shown AS displayed_events, n - shown AS suppressed_events,
round(100.0::DOUBLE * (n - shown) / n, 2) AS logical_event_suppression_percentage, round(100.0::DOUBLE * (n - shown) / n, 2) AS raw_line_suppression_percentage, patterns AS structural_patterns, anomalies AS anomaly_events,
CAST(len(wanted) AS INTEGER) AS known_important_total, CAST(len(wanted) - len(missed) AS INTEGER) AS known_important_retained, array_to_string(missed, ',') AS missed FROM t JOIN k USING (level)"""
ORACLES["bounded_lines"] = f"""WITH {_LINES}, k AS (SELECT raw, octet_length(encode(raw)) > 48 AS truncated, list_max(list_filter(range(0, 49), lambda k: octet_length(encode(substr(raw, 1, CAST(k AS BIGINT)))) <= 48)) AS k FROM l WHERE raw IS NOT NULL)
SELECT CASE WHEN truncated THEN substr(raw, 1, CAST(k AS BIGINT)) || ' ...[truncated]' ELSE raw END AS raw, truncated, count(*) AS n FROM k GROUP BY ALL"""
ORACLES["norm_documents"] = ORACLES["norm_documents"].replace("{LINES}", _LINES)
ORACLES |= {f"norm_{name}": f"WITH l AS (SELECT event_id, {shapes.SHAPED} AS raw FROM events) SELECT event_id, regexp_replace(raw, '{pattern}', '{mark}', 'g') AS line FROM l WHERE regexp_matches(raw, '{pattern}')" for name, pattern, mark in CLASSES}
_FP = "p AS (SELECT DISTINCT severity, level, template, printf('%02x', severity) || '00' || lower(hex(encode(template))) AS x FROM e), i AS (SELECT *, lower(lpad(hex(CAST({fnv} AS UBIGINT)), 16, '0')) AS fingerprint FROM p)".replace("{fnv}", _FNV)
_HEAD = """'{"type":"' || type || '","fingerprint":"' || fingerprint || '","severity":"' || level || '","template":' || CAST(to_json(template) AS VARCHAR)"""
ORACLES |= {
    "ndjson_records": f"""WITH {_D}, {_FP}, s AS (SELECT CASE decision WHEN 'repeat' THEN 'repeat_summary' ELSE decision END AS type, severity, template, CASE WHEN decision <> 'repeat' THEN content END AS content, count(*) AS n
FROM d GROUP BY decision, severity, template, CASE WHEN decision <> 'repeat' THEN event_no END, CASE WHEN decision <> 'repeat' THEN content END)
SELECT {_HEAD} || CASE type WHEN 'repeat_summary' THEN ',"count":' || n WHEN 'event' THEN ',"lines":[' || CAST(to_json(content) AS VARCHAR) || '],"count":1,"new":true' ELSE ',"lines":[' || CAST(to_json(content) AS VARCHAR) || '],"baseline_per_min":1.0,"current_per_min":40.0,"bootstrap":true' END || '}}' AS value
FROM s JOIN i USING (severity, template)""",
    "spikes": f"WITH RECURSIVE {_C} SELECT event_no, template, baseline_per_min, current_per_min, bootstrap FROM alerts",
    "decisions_event_clock": f"""WITH RECURSIVE {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY severity, template ORDER BY event_no) AS nth FROM e)
SELECT r.event_no, CASE WHEN a.event_no IS NOT NULL THEN 'anomaly' WHEN nth = 1 THEN 'event' ELSE 'repeat' END AS decision, baseline_per_min, current_per_min FROM r LEFT JOIN alerts a USING (event_no)""",
    "stats": f"""WITH {_D}, t AS (SELECT count(*) AS n, count(*) FILTER (decision <> 'repeat') AS shown, count(*) FILTER (severity = 5) AS warnings, count(*) FILTER (severity >= 6) AS errors, count(*) FILTER (decision = 'anomaly') AS anomalies, count(DISTINCT (severity, template)) AS patterns FROM d)
SELECT CAST(u.k AS INTEGER) AS n, u.name, u.value FROM t, unnest([{{'k': 0, 'name': 'input lines', 'value': CAST(t.n AS VARCHAR)}}, {{'k': 1, 'name': 'displayed events', 'value': CAST(shown AS VARCHAR)}}, {{'k': 2, 'name': 'suppressed events', 'value': CAST(t.n - shown AS VARCHAR)}},
{{'k': 3, 'name': 'logical-event suppression', 'value': printf('%.1f%%', round(100.0::DOUBLE * (t.n - shown) / t.n, 2))}}, {{'k': 4, 'name': 'raw-line suppression', 'value': printf('%.1f%%', round(100.0::DOUBLE * (t.n - shown) / t.n, 2))}},
{{'k': 5, 'name': 'structural patterns', 'value': patterns || ' (evicted 0)'}}, {{'k': 6, 'name': 'warning events observed', 'value': CAST(warnings AS VARCHAR)}}, {{'k': 7, 'name': 'error events observed', 'value': CAST(errors AS VARCHAR)}},
{{'k': 8, 'name': 'anomalies detected', 'value': CAST(anomalies AS VARCHAR)}}, {{'k': 9, 'name': 'truncated lines', 'value': '0'}}]) AS q(u)""",
}
