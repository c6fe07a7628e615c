"""DuckDB SQL for the fleet queries: one chain of common table expressions, one select a query."""

from __future__ import annotations

from waybill import schemas


def _text(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_SPEC = ", ".join(f"({', '.join(map(_text, row))})" for row in schemas.SIGNAL_SPEC)
_FENCES = ", ".join(f"({', '.join(map(_text, row))}, TIMESTAMP '2000-01-01', CAST(NULL AS TIMESTAMP))" for row in schemas.SEED_FENCES)
_KINDS = ", ".join(f"({', '.join(map(_text, row))})" for row in schemas.ALERT_SIGNALS)
_T0 = "TIMESTAMP '2024-01-01 00:00:00'"
_AT = f"{_T0} + to_seconds(event_id + 2200 * (event_id // 5000))"
_SEV = "CASE WHEN alert_type = 'battery_low' THEN CASE WHEN value < 10 THEN 'critical' WHEN value < 20 THEN 'warning' END WHEN value > 45 THEN 'critical' END"
_CLR = "CASE WHEN alert_type = 'battery_low' THEN value >= 22 ELSE value <= 43 END"
_DIST = "2 * 6371000 * asin(sqrt(pow(sin(radians(x.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(x.lat)) * pow(sin(radians(x.lon - g.lon) / 2), 2)))"
_AGGS = "count(*) AS readings, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value, arg_max(value, event_ts) AS last_value, max(event_ts) AS last_ts"


def _episodes(source: str) -> str:
    return f"""SELECT vehicle_id, alert_type, CAST(ep AS BIGINT) AS episode,
      min(event_ts) FILTER (WHERE is_open = 1) AS raised_at, min(event_ts) FILTER (WHERE is_open = 0 AND was_open = 1) AS resolved_at,
      arg_max(sev, event_ts) FILTER (WHERE sev IS NOT NULL) AS severity,
      max(event_ts) FILTER (WHERE sev = 'critical' AND (was_open = 0 OR prev_sev = 'warning')) AS escalated_at
    FROM (SELECT *, sum(CASE WHEN is_open = 1 AND was_open = 0 THEN 1 ELSE 0 END) OVER w AS ep
      FROM (SELECT *, coalesce(lag(is_open) OVER w, 0) AS was_open,
          last_value(sev IGNORE NULLS) OVER (PARTITION BY vehicle_id, alert_type ORDER BY event_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_sev
        FROM (SELECT *, last_value(CASE WHEN sev IS NOT NULL THEN 1 WHEN clr THEN 0 END IGNORE NULLS) OVER (PARTITION BY vehicle_id, alert_type ORDER BY event_ts) AS is_open
          FROM (SELECT vehicle_id, alert_type, event_ts, {_SEV} AS sev, {_CLR} AS clr FROM {source} JOIN kinds USING (signal)))
        WINDOW w AS (PARTITION BY vehicle_id, alert_type ORDER BY event_ts))
      WINDOW w AS (PARTITION BY vehicle_id, alert_type ORDER BY event_ts))
    WHERE ep > 0 GROUP BY vehicle_id, alert_type, ep"""


CHAIN: dict[str, str] = {
    "sig": f"""SELECT event_id, concat('v', user_id) AS vehicle_id,
      CASE event_type WHEN 'view' THEN 'soc' WHEN 'purchase' THEN 'battery_temp' WHEN 'click' THEN 'speed' WHEN 'error' THEN 'ignition' ELSE 'odometer' END AS signal,
      {_AT} AS event_ts,
      CASE event_type WHEN 'view' THEN least(value, 100) WHEN 'purchase' THEN value WHEN 'click' THEN CASE WHEN value < 20 THEN 0 ELSE value END
        WHEN 'error' THEN CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END ELSE CAST(event_id AS DOUBLE) / 10.0 END AS value
      FROM events""",
    "fix": f"""SELECT event_id, concat('v', user_id) AS vehicle_id, {_AT} AS event_ts,
      round(12.96 + 0.055 * sin((user_id * 11 + CAST(event_id AS DOUBLE) / 10.0) / 41.0), 6) AS lat,
      round(77.60 + 0.055 * cos((user_id * 13 + CAST(event_id AS DOUBLE) / 10.0) / 37.0), 6) AS lon,
      CAST(CASE WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 10 = 7 THEN 150.0 ELSE 5.0 + event_id % 40 END AS DOUBLE) AS accuracy_m
      FROM events""",
    "spec(signal, label, unit, max_age_sec, warn_lo, warn_hi, crit_lo, crit_hi)": f"VALUES {_SPEC}",
    "kinds(alert_type, signal)": f"VALUES {_KINDS}",
    "fences(geofence_id, name, lat, lon, radius_m, active_from, active_to)": f"VALUES {_FENCES}",
    "c": f"SELECT max(event_ts) AS now, {_T0} + to_seconds(CAST(epoch(max(event_ts) - {_T0}) AS BIGINT) // 2) AS mid FROM sig",
    "roster": "SELECT vehicle_id, concat('KA01EV', lpad(substr(vehicle_id, 2), 9, '0')) AS reg_no, 'eT 1000' AS model FROM (SELECT DISTINCT vehicle_id FROM sig UNION ALL SELECT 'v-silent')",
    "latest": "SELECT vehicle_id, signal, max(event_ts) AS event_ts, arg_max(value, event_ts) AS value FROM sig GROUP BY ALL",
    "recent": "SELECT l.vehicle_id, l.signal, l.value FROM latest l JOIN spec p USING (signal), c WHERE l.event_ts >= c.now - to_seconds(p.max_age_sec)",
    "log": "SELECT * FROM sig WHERE event_ts <= (SELECT mid FROM c)",
    "flog": "SELECT * FROM fix WHERE event_ts <= (SELECT mid FROM c)",
    "batch": """SELECT CASE WHEN event_id % 50 = 0 THEN 'ghost' ELSE vehicle_id END AS vehicle_id, CASE WHEN event_id % 35 = 5 THEN 'bogus' ELSE signal END AS signal, event_ts, value, event_id % 3 AS batch_id, concat_ws('/', event_id, more) AS packet_id
      FROM (SELECT *, 0 AS more FROM sig UNION ALL SELECT event_id, vehicle_id, signal, event_ts, value + 1, 1 FROM sig WHERE event_id % 15 = 0)""",
    "clean": "SELECT * FROM batch WHERE vehicle_id IN (SELECT vehicle_id FROM roster) AND signal IN (SELECT signal FROM spec)",
    "deduped": "SELECT vehicle_id, signal, event_ts, min(value) AS value, count(DISTINCT value) - 1 AS conflicts FROM clean GROUP BY vehicle_id, signal, event_ts",
    "wm": "SELECT vehicle_id, max(event_ts) AS processed_through FROM (SELECT vehicle_id, event_ts FROM log UNION ALL SELECT vehicle_id, event_ts FROM flog) GROUP BY vehicle_id",
    "seen": "SELECT vehicle_id, event_ts FROM clean UNION ALL SELECT vehicle_id, event_ts FROM fix",
    "offers": """SELECT batch_id, concat_ws('|', vehicle_id, signal, event_ts) AS k, concat_ws('|', vehicle_id, signal, event_ts) IN (SELECT concat_ws('|', vehicle_id, signal, event_ts) FROM log) AS known FROM clean
      UNION ALL SELECT event_id % 3, concat_ws('|', vehicle_id, event_ts), event_ts <= (SELECT mid FROM c) FROM fix""",
    "offered": "SELECT batch_id, count(DISTINCT k) AS offered, count(DISTINCT k) FILTER (WHERE NOT known AND batch_id = first_batch) AS applied FROM (SELECT *, min(batch_id) OVER (PARTITION BY k) AS first_batch FROM offers) GROUP BY batch_id",
    "lates": "SELECT batch_id, count(*) AS late FROM (SELECT batch_id, vehicle_id, min(event_ts) AS t FROM (SELECT batch_id, vehicle_id, event_ts FROM clean UNION ALL SELECT event_id % 3, vehicle_id, event_ts FROM fix) GROUP BY 1, 2) JOIN wm USING (vehicle_id) WHERE t < processed_through GROUP BY 1",
    "receipts": "SELECT batch_id, packets, packets - kept AS orphans, offered, applied, coalesce(late, 0) AS late, offered - applied AS duplicates FROM (SELECT batch_id, count(DISTINCT packet_id) AS packets FROM batch GROUP BY 1) JOIN (SELECT batch_id, count(*) AS kept FROM clean GROUP BY 1) USING (batch_id) JOIN offered USING (batch_id) LEFT JOIN lates USING (batch_id)",
    "ep": _episodes("sig"),
    "ep_mid": _episodes("(SELECT * FROM sig WHERE event_ts <= (SELECT mid FROM c))"),
    "old_alerts": "SELECT concat_ws('|', vehicle_id, alert_type, epoch_ms(raised_at)) AS alert_id, vehicle_id, alert_type, severity, raised_at, escalated_at, resolved_at, CAST(NULL AS TIMESTAMP) AS dismissed_at, CAST(NULL AS VARCHAR) AS dismiss_reason FROM ep_mid",
    # alerts: a vehicle's fresh readings of a kind, held against its open alert of that kind
    "fresh": """SELECT v.vehicle_id, (SELECT s.value FROM recent s WHERE s.vehicle_id = v.vehicle_id AND s.signal = 'soc') AS soc, (SELECT t.value FROM recent t WHERE t.vehicle_id = v.vehicle_id AND t.signal = 'battery_temp') AS battery_temp
      FROM (SELECT DISTINCT vehicle_id FROM latest) v""",
    "cond": f"SELECT vehicle_id, alert_type, {_SEV} AS severity, {_CLR} AS cleared FROM recent JOIN kinds USING (signal)",
    "opened": "SELECT o.alert_id, d.severity AS now_is, d.cleared, d.severity = 'critical' AND o.severity = 'warning' AS worse FROM old_alerts o JOIN cond d USING (vehicle_id, alert_type) WHERE o.resolved_at IS NULL",
    "alerts": """SELECT o.alert_id, o.vehicle_id, o.alert_type, coalesce(x.now_is, o.severity) AS severity, o.raised_at, if(x.worse, c.now, o.escalated_at) AS escalated_at, if(x.cleared, c.now, o.resolved_at) AS resolved_at,
        if(x.worse, NULL, o.dismissed_at) AS dismissed_at, if(x.worse, NULL, o.dismiss_reason) AS dismiss_reason FROM c CROSS JOIN old_alerts o LEFT JOIN opened x USING (alert_id)
      UNION ALL SELECT concat_ws('|', d.vehicle_id, d.alert_type, epoch_ms(c.now)), d.vehicle_id, d.alert_type, d.severity, c.now, if(d.severity = 'critical', c.now, NULL), NULL, NULL, NULL
      FROM c CROSS JOIN cond d ANTI JOIN (SELECT vehicle_id, alert_type FROM old_alerts WHERE resolved_at IS NULL) o ON o.vehicle_id = d.vehicle_id AND o.alert_type = d.alert_type WHERE d.severity IS NOT NULL""",
    "live": "SELECT * FROM alerts WHERE resolved_at IS NULL AND dismissed_at IS NULL",
    "actions": "SELECT alert_id, (SELECT now FROM c) AS acted_at, 'known' AS code, CASE WHEN n % 2 = 1 THEN 'checked' ELSE '' END AS note, n % 5 = 0 AS undo FROM (SELECT *, CAST(substr(vehicle_id, 2) AS INTEGER) AS n FROM old_alerts)",
    "piv": """SELECT vehicle_id, max(value) FILTER (WHERE signal = 'soc') AS soc, max(value) FILTER (WHERE signal = 'range_km') AS range_km, max(value) FILTER (WHERE signal = 'speed') AS speed, max(event_ts) FILTER (WHERE signal = 'speed') AS speed_ts,
      max(value) FILTER (WHERE signal = 'ignition') AS ignition, max(event_ts) FILTER (WHERE signal = 'ignition') AS ignition_ts, max(event_ts) AS last_signal_ts FROM latest GROUP BY vehicle_id""",
    "ping": "SELECT vehicle_id, max(event_ts) AS last_ping FROM (SELECT vehicle_id, event_ts FROM latest UNION ALL SELECT vehicle_id, event_ts FROM fix) GROUP BY vehicle_id",
    "badge": "SELECT vehicle_id, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS alert_severity FROM live GROUP BY vehicle_id",
    "scored": """SELECT vehicle_id, reg_no, model, soc, range_km, speed, last_ping,
      CASE WHEN last_ping IS NULL OR last_ping < (SELECT now FROM c) - to_seconds(600) THEN 'OFFLINE' WHEN speed_ts >= (SELECT now FROM c) - to_seconds(600) AND speed > 0 THEN 'MOVING'
        WHEN speed_ts >= (SELECT now FROM c) - to_seconds(600) AND speed = 0 AND ignition_ts >= (SELECT now FROM c) - to_seconds(600) AND ignition = 1 THEN 'IDLE' ELSE 'STOPPED' END AS status, alert_severity
      FROM roster LEFT JOIN piv USING (vehicle_id) LEFT JOIN ping USING (vehicle_id) LEFT JOIN badge USING (vehicle_id)""",
    "register": """SELECT r.vehicle_id, s.signal, label, unit, value, event_ts, CASE WHEN value IS NULL THEN 'NULL' WHEN event_ts < (SELECT now FROM c) - to_seconds(max_age_sec) THEN 'STALE'
        WHEN value < warn_lo OR value < crit_lo OR value > warn_hi OR value > crit_hi THEN 'ALERT' ELSE 'NORMAL' END AS verdict,
      CAST(list_position(['soc', 'range_km', 'speed', 'battery_temp', 'odometer', 'ignition'], s.signal) AS BIGINT) AS display_order
      FROM roster r CROSS JOIN spec s LEFT JOIN latest l ON l.vehicle_id = r.vehicle_id AND l.signal = s.signal""",
    "soc": "SELECT * FROM sig WHERE signal = 'soc'",
    "span": "SELECT vehicle_id, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM soc GROUP BY vehicle_id",
    "width": "SELECT *, CAST(least(greatest(ceil(floor(epoch(last_ts - first_ts)) / 179), 1), 86400) AS BIGINT) AS width_s FROM span",
    "hist": "SELECT vehicle_id, CAST(floor(epoch(event_ts - first_ts) / width_s) AS BIGINT) AS bucket, min(event_ts) AS bucket_ts, round(avg(value), 6) AS mean_value, count(*) AS readings FROM soc JOIN width USING (vehicle_id) GROUP BY 1, 2",
    # fences, by stretches of equal votes: a stretch settles with its second vote or with a decisive one, and is crossed into at its first
    "probe": f"""SELECT x.vehicle_id, g.geofence_id, x.event_ts, {_DIST} AS d, g.radius_m AS r, CASE WHEN x.accuracy_m > 25 THEN x.accuracy_m ELSE 25.0 END AS h
      FROM fences g JOIN fix x ON x.event_ts >= g.active_from AND x.event_ts < coalesce(g.active_to, TIMESTAMP '9999-01-01') WHERE x.accuracy_m IS NULL OR x.accuracy_m <= 100""",
    "opinion": """SELECT vehicle_id, geofence_id, event_ts, 'IN' AS zone, r - d > 2 * h AS decisive FROM probe WHERE d <= r - h
      UNION ALL SELECT vehicle_id, geofence_id, event_ts, 'OUT', d - r > 2 * h FROM probe WHERE d >= r + h""",
    "told": "SELECT *, row_number() OVER (PARTITION BY vehicle_id, geofence_id ORDER BY event_ts) AS i FROM opinion",
    "vote": """SELECT *, i - row_number() OVER (PARTITION BY vehicle_id, geofence_id, zone ORDER BY event_ts) AS stretch FROM told""",
    "stretches": """SELECT vehicle_id, geofence_id, zone, stretch, min(i) AS i, min(event_ts) AS from_ts, max(event_ts) AS to_ts,
      min(CASE WHEN decisive THEN i ELSE NULL END) AS sure, CASE WHEN count(*) > 1 THEN min(i) + 1 END AS twice, max(i) AS last_i FROM vote GROUP BY vehicle_id, geofence_id, zone, stretch""",
    "certain": "SELECT vehicle_id, geofence_id, zone, i, last_i, from_ts, least(coalesce(sure, twice), coalesce(twice, sure)) AS at_i FROM stretches WHERE sure IS NOT NULL OR twice IS NOT NULL",
    "votes": """SELECT v.vehicle_id, v.geofence_id, v.event_ts, p.zone AS last_zone, p.event_ts AS last_ts, CASE WHEN v.decisive OR p.zone = v.zone THEN v.zone END AS settles,
      CASE WHEN p.zone = v.zone THEN p.event_ts ELSE v.event_ts END AS since_ts, c.zone AS stood
      FROM told v LEFT JOIN told p ON p.vehicle_id = v.vehicle_id AND p.geofence_id = v.geofence_id AND p.i = v.i - 1
      ASOF LEFT JOIN certain c ON c.vehicle_id = v.vehicle_id AND c.geofence_id = v.geofence_id AND c.at_i < v.i""",
    "changes": "SELECT c.*, lag(zone) OVER (PARTITION BY vehicle_id, geofence_id ORDER BY at_i) AS from_zone FROM certain c",
    "trans": """SELECT c.vehicle_id, c.geofence_id, c.from_ts AS event_ts, CASE c.zone WHEN 'IN' THEN 'ENTRY' ELSE 'EXIT' END AS kind, CASE WHEN date_diff('microsecond', b.event_ts, n.event_ts) <= 1800000000 THEN 'high' ELSE 'low' END AS confidence
      FROM changes c JOIN told n ON n.vehicle_id = c.vehicle_id AND n.geofence_id = c.geofence_id AND n.i = c.at_i
      LEFT JOIN told b ON b.vehicle_id = c.vehicle_id AND b.geofence_id = c.geofence_id AND b.i = c.at_i - 1 WHERE c.zone <> c.from_zone""",
    "cont": """SELECT s.vehicle_id, s.geofence_id, c.zone, s.zone AS pending_zone, s.to_ts AS pending_ts FROM (SELECT *, max(last_i) OVER (PARTITION BY vehicle_id, geofence_id) AS n FROM stretches) s
      LEFT JOIN (SELECT vehicle_id, geofence_id, max_by(zone, at_i) AS zone FROM certain GROUP BY 1, 2) c USING (vehicle_id, geofence_id) WHERE s.last_i = s.n""",
    "own": f"""SELECT concat('gf-', vehicle_id) AS geofence_id, CASE WHEN n % 4 = 0 THEN ' ' ELSE vehicle_id END AS name, lat, lon, n * 10.0 AS radius_m, {_T0} AS active_from, CAST(NULL AS TIMESTAMP) AS active_to, {_T0} AS updated_at
      FROM (SELECT vehicle_id, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, CAST(count(*) AS DOUBLE) AS n FROM fix GROUP BY vehicle_id)""",
    "switched": """SELECT geofence_id, name, CASE WHEN radius_m % 20 = 0 THEN (SELECT mid FROM c) ELSE active_from END AS active_from, CASE WHEN radius_m % 20 <> 0 THEN (SELECT mid FROM c) END AS active_to FROM own""",
    "crossing": "SELECT t.vehicle_id, t.event_ts, t.kind, t.confidence, t.geofence_id, g.radius_m FROM trans t JOIN fences g USING (geofence_id)",
    "base": """WITH inside AS (SELECT vehicle_id, count(*) AS n FROM cont WHERE zone = 'IN' GROUP BY vehicle_id),
      balance AS (SELECT vehicle_id, count(*) FILTER (WHERE kind = 'ENTRY') - count(*) FILTER (WHERE kind = 'EXIT') AS n FROM trans GROUP BY vehicle_id)
      SELECT r.vehicle_id, CAST(coalesce(inside.n, 0) - coalesce(balance.n, 0) AS BIGINT) AS start_count FROM roster r LEFT JOIN inside USING (vehicle_id) LEFT JOIN balance USING (vehicle_id)""",
    "move": """SELECT vehicle_id, event_ts, CAST(2 * count(*) FILTER (WHERE kind = 'ENTRY') - count(*) AS BIGINT) AS change, (list({r: radius_m, g: geofence_id} ORDER BY radius_m DESC, geofence_id DESC) FILTER (WHERE kind = 'EXIT'))[1].g AS left_fence,
      (list({r: radius_m, g: geofence_id} ORDER BY radius_m DESC, geofence_id DESC) FILTER (WHERE kind = 'ENTRY'))[1].g AS reached_fence, count(*) FILTER (WHERE confidence = 'low') > 0 AS doubtful FROM crossing GROUP BY vehicle_id, event_ts""",
    "level": "SELECT *, after - change AS before FROM (SELECT m.*, CAST(b.start_count + sum(m.change) OVER (PARTITION BY m.vehicle_id ORDER BY m.event_ts) AS BIGINT) AS after FROM move m JOIN base b USING (vehicle_id))",
    "edge": "SELECT * FROM (SELECT vehicle_id, CAST(count(*) FILTER (WHERE after = 0) OVER (PARTITION BY vehicle_id ORDER BY event_ts) AS BIGINT) AS outing, event_ts, after = 0 AS departs, left_fence, reached_fence, doubtful FROM level WHERE (after = 0) <> (before = 0)) WHERE outing > 0",
    "outing": """SELECT d.vehicle_id, d.outing, d.event_ts AS start_ts, d.left_fence AS origin, a.event_ts AS end_ts, a.reached_fence AS dest, d.doubtful OR coalesce(a.doubtful, FALSE) AS doubtful
      FROM edge d LEFT JOIN edge a ON a.vehicle_id = d.vehicle_id AND a.outing = d.outing AND NOT a.departs WHERE d.departs""",
    "odometer": "SELECT o.vehicle_id, o.outing, max({t: s.event_ts, v: s.value}) FILTER (WHERE s.event_ts <= o.start_ts) AS s, max({t: s.event_ts, v: s.value}) FILTER (WHERE o.end_ts IS NULL OR s.event_ts <= o.end_ts) AS e, any_value(o.start_ts) AS start_ts FROM outing o JOIN sig s ON s.vehicle_id = o.vehicle_id AND s.signal = 'odometer' GROUP BY o.vehicle_id, o.outing",
    "kept": """SELECT vehicle_id, event_ts, value FROM sig WHERE signal = 'odometer' QUALIFY row_number() OVER (PARTITION BY vehicle_id, CAST(event_ts AS DATE) ORDER BY event_ts DESC) = 1
      UNION SELECT vehicle_id, s.t, s.v FROM odometer WHERE s IS NOT NULL UNION SELECT d.vehicle_id, d.e.t, d.e.v FROM odometer d JOIN outing o USING (vehicle_id, outing) WHERE o.end_ts IS NOT NULL AND d.e IS NOT NULL""",
    "trip": """SELECT concat(vehicle_id, '|', epoch_ms(o.start_ts)) AS trip_id, vehicle_id, origin AS origin_geofence_id, o.start_ts, dest AS dest_geofence_id, end_ts, if(end_ts IS NULL, 'IN_PROGRESS', 'COMPLETED') AS status,
      round(if(d.e.t >= o.start_ts, d.e.v - d.s.v, NULL), 6) AS distance_km, if(doubtful, 'low', 'high') AS confidence FROM outing o LEFT JOIN odometer d USING (vehicle_id, outing)""",
    "rolled": f"SELECT vehicle_id, signal, time_bucket(INTERVAL 5 MINUTE, event_ts) AS bucket_ts, {_AGGS} FROM sig WHERE event_ts < (SELECT mid FROM c) GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "surviving": "SELECT vehicle_id, signal, event_ts, value FROM sig s WHERE event_ts >= (SELECT mid FROM c) OR NOT EXISTS (SELECT 1 FROM rolled r WHERE r.vehicle_id = s.vehicle_id AND r.signal = s.signal AND r.bucket_ts = time_bucket(INTERVAL 5 MINUTE, s.event_ts))",
    "hot": f"SELECT vehicle_id, signal, time_bucket(INTERVAL 5 MINUTE, event_ts) AS bucket_ts, {_AGGS} FROM surviving GROUP BY 1, 2, 3",
}

_SIX = "vehicle_id, signal, bucket_ts, readings, min_value, max_value, round(avg_value, 6) AS avg_value, last_value, last_ts"

SELECTS: dict[str, str] = {
    "s1_packets": "SELECT vehicle_id, event_ts, CASE WHEN signal = 'soc' THEN 2 ELSE 1 END AS signals, event_id % 4 <> 1 AS placed FROM sig",
    "s2_packet_signals": "SELECT vehicle_id, signal, event_ts, value FROM sig UNION ALL SELECT vehicle_id, 'range_km', event_ts, value * 4 FROM soc",
    "s3_packet_fixes": "SELECT vehicle_id, event_ts, lat, lon, accuracy_m FROM fix WHERE event_id % 4 <> 1",
    "s4_new_roster_rows": "SELECT * FROM roster WHERE length(vehicle_id) <> 2",
    "s5_config_in_use": "SELECT signal, label, unit, max_age_sec, coalesce(n, 0) AS readings FROM spec LEFT JOIN (SELECT signal, count(*) AS n FROM sig GROUP BY 1) USING (signal)",
    "s6_seed_fences": "SELECT f.geofence_id, f.name, CAST(f.lat AS DOUBLE) AS lat, CAST(f.lon AS DOUBLE) AS lon, CAST(f.radius_m AS DOUBLE) AS radius_m, count(*) FILTER (WHERE p.d <= p.r) AS fixes_inside FROM fences f LEFT JOIN probe p USING (geofence_id) GROUP BY ALL",
    "s7_readings_by_alert_type": "SELECT alert_type, count(*) AS readings FROM sig JOIN kinds USING (signal) GROUP BY 1",
    "s8_one_signal_scan": "SELECT event_ts, value FROM sig, c WHERE vehicle_id = 'v7' AND signal = 'soc' AND event_ts >= mid",
    "s9_log_append": "SELECT vehicle_id, signal, event_ts, value FROM log UNION ALL SELECT vehicle_id, signal, event_ts, value FROM deduped d WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.vehicle_id = d.vehicle_id AND l.signal = d.signal AND l.event_ts = d.event_ts)",
    "s10_keyed_replace": """SELECT * FROM (WITH moved AS (SELECT DISTINCT vehicle_id FROM sig WHERE event_ts > (SELECT mid FROM c)), halves AS (SELECT *, vehicle_id IN (SELECT vehicle_id FROM moved) AS is_moved FROM sig)
      SELECT 'latest' AS kept_table, vehicle_id, concat(vehicle_id, '|', signal, '|', epoch_ms(max(event_ts))) AS key FROM halves GROUP BY vehicle_id, signal
      UNION ALL SELECT 'trip', vehicle_id, trip_id FROM trip WHERE vehicle_id IN (SELECT vehicle_id FROM moved) UNION ALL SELECT 'trip', vehicle_id, trip_id FROM trip WHERE vehicle_id NOT IN (SELECT vehicle_id FROM moved))""",
    "s10_stored_tables": """SELECT 'signal_reading' AS kept_table, vehicle_id, concat_ws('|', signal, epoch_ms(event_ts)) AS key, value AS amount FROM sig
      UNION ALL SELECT 'location_fix', vehicle_id, concat(epoch_ms(event_ts)), lat FROM fix UNION ALL SELECT 'latest', vehicle_id, concat_ws('|', signal, epoch_ms(event_ts)), value FROM latest
      UNION ALL SELECT 'last_fix', vehicle_id, concat(epoch_ms(max(event_ts))), NULL FROM fix GROUP BY vehicle_id
      UNION ALL SELECT 'watermark', vehicle_id, concat(epoch_ms(max(event_ts))), NULL FROM sig GROUP BY vehicle_id
      UNION ALL SELECT 'transition', vehicle_id, concat_ws('|', geofence_id, kind, confidence, epoch_ms(event_ts)), NULL FROM trans
      UNION ALL SELECT 'containment', vehicle_id, concat_ws('|', geofence_id, zone, pending_zone, epoch_ms(pending_ts)), NULL FROM cont
      UNION ALL SELECT 'trip', vehicle_id, concat_ws('|', trip_id, origin_geofence_id, dest_geofence_id, status, confidence), distance_km FROM trip
      UNION ALL SELECT 'odometer', vehicle_id, concat(epoch_ms(event_ts)), value FROM kept""",
    "s11_totals": "SELECT (SELECT count(*) FROM roster) AS vehicles, (SELECT count(*) FROM sig) AS signal_rows, (SELECT count(*) FROM fix) AS fix_rows, (SELECT max(event_ts) FROM sig) AS newest_ts",
    "i1_orphans": "SELECT (SELECT count(*) FROM batch) AS total, (SELECT count(*) FROM clean) AS kept, (SELECT count(*) FROM batch) - (SELECT count(*) FROM clean) AS orphans",
    "i2_dedupe": "SELECT * FROM deduped",
    "i3_append_absent": "SELECT vehicle_id, signal, event_ts, value FROM deduped d WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.vehicle_id = d.vehicle_id AND l.signal = d.signal AND l.event_ts = d.event_ts)",
    "i4_advance_latest": "SELECT vehicle_id, signal, max(event_ts) AS event_ts, arg_max(value, (event_ts, age)) AS value FROM (SELECT vehicle_id, signal, event_ts, value, 1 AS age FROM log UNION ALL SELECT vehicle_id, signal, event_ts, value, 0 FROM deduped) GROUP BY 1, 2",
    "i5_late_vehicles": "SELECT count(*) AS late FROM (SELECT vehicle_id, min(event_ts) AS t FROM seen GROUP BY 1) JOIN wm USING (vehicle_id) WHERE t < processed_through",
    "i6_advance_watermark": "SELECT vehicle_id, max(t) AS processed_through FROM (SELECT vehicle_id, event_ts AS t FROM seen UNION ALL SELECT vehicle_id, processed_through FROM wm) GROUP BY 1",
    "i7_offered": "SELECT (SELECT count(*) FROM deduped) AS signals, (SELECT count(*) FROM fix) AS fixes",
    "i12_rejected": "SELECT vehicle_id, event_ts, CASE WHEN signal = 'soc' THEN 2 ELSE 1 END AS signals FROM sig, c WHERE event_ts < mid",
    "i8_receipts": "SELECT * FROM receipts",
    "i9_session_totals": "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("packets", "orphans", "offered", "applied", "late", "duplicates")) + " FROM receipts",
    "i10_batch_state": " UNION ALL ".join(
        f"SELECT '{name}' AS kept_table, count(*) AS n, CAST(sum(CAST(floor(epoch({ts})) AS BIGINT)) AS BIGINT) AS seconds FROM {rows}"
        for name, ts, rows in (
            ("signal_reading", "event_ts", "(SELECT DISTINCT vehicle_id, signal, event_ts FROM (SELECT vehicle_id, signal, event_ts FROM log UNION ALL SELECT vehicle_id, signal, event_ts FROM deduped))"),
            ("latest", "event_ts", "(SELECT vehicle_id, signal, max(event_ts) AS event_ts FROM (SELECT vehicle_id, signal, event_ts FROM log UNION ALL SELECT vehicle_id, signal, event_ts FROM deduped) GROUP BY 1, 2)"),
            ("transition", "event_ts", "trans"),
            ("containment", "pending_ts", "cont"),
            ("trip", "start_ts", "trip"),
            ("alert", "raised_at", "alerts"),
            ("watermark", "t", "(SELECT vehicle_id, max(t) AS t FROM (SELECT vehicle_id, event_ts AS t FROM seen UNION ALL SELECT vehicle_id, processed_through FROM wm) GROUP BY 1)"),
        )
    ),
    "i11_rebuild": "SELECT (SELECT count(*) FROM latest) AS latest, (SELECT count(*) FROM trans) AS transitions, (SELECT count(*) FROM cont) AS containment, (SELECT count(*) FROM trip) AS trips, (SELECT count(*) FROM alerts) AS alerts",
    "f1_pivot_latest": "SELECT * FROM piv",
    "f2_last_ping": "SELECT * FROM ping",
    "f3_badges": "SELECT * FROM badge",
    "f4_status": "SELECT vehicle_id, status FROM scored",
    "f5_scored_fleet": "SELECT * FROM scored",
    "f6_status_counts": "SELECT status, coalesce(n, 0) AS n FROM (VALUES ('MOVING'), ('IDLE'), ('STOPPED'), ('OFFLINE')) s(status) LEFT JOIN (SELECT status, count(*) AS n FROM scored GROUP BY 1) USING (status) UNION ALL SELECT 'ALL', count(*) FROM scored",
    "f7_moving_rows": "SELECT * FROM scored WHERE status = 'MOVING' ORDER BY reg_no",
    "v1_header": "SELECT * FROM scored WHERE vehicle_id = 'v7'",
    "v2_register": "SELECT * FROM register",
    "v3_register_order": "SELECT display_order, signal, verdict FROM register WHERE vehicle_id = 'v7' ORDER BY display_order NULLS LAST",
    "v4_soc_spans": "SELECT * FROM span",
    "v5_bucket_widths": "SELECT vehicle_id, width_s FROM width",
    "v6_history": "SELECT * FROM hist",
    "v7_history_summary": "SELECT vehicle_id, CAST(sum(readings) AS BIGINT) AS readings, min(bucket_ts) AS from_ts, max(bucket_ts) AS to_ts, min(mean_value) AS low, max(mean_value) AS high FROM hist GROUP BY 1",
    "v8_ages": "SELECT vehicle_id, signal, CAST(floor(epoch(now - event_ts)) AS BIGINT) AS age_s FROM latest, c",
    "v9_detail_bundle": """SELECT vehicle_id, 'header' AS part, CAST(1 AS BIGINT) AS n, last_ping AS at, status AS name, alert_severity AS detail, soc AS amount FROM scored
      UNION ALL SELECT vehicle_id, 'register', row_number() OVER (PARTITION BY vehicle_id ORDER BY display_order NULLS LAST, signal), event_ts, signal, verdict, value FROM register
      UNION ALL SELECT vehicle_id, 'history', row_number() OVER (PARTITION BY vehicle_id ORDER BY bucket), bucket_ts, NULL, CAST(readings AS VARCHAR), mean_value FROM hist
      UNION ALL SELECT vehicle_id, 'fence', 1, NULL, geofence_id, name, radius_m FROM cont JOIN fences USING (geofence_id) WHERE zone = 'IN' AND active_to IS NULL QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY radius_m, geofence_id) = 1
      UNION ALL SELECT vehicle_id, 'crossing', row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, geofence_id), event_ts, geofence_id, kind, NULL FROM trans QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, geofence_id) <= 8
      UNION ALL SELECT vehicle_id, 'trip', row_number() OVER (PARTITION BY vehicle_id ORDER BY start_ts DESC), start_ts, origin_geofence_id, dest_geofence_id, distance_km FROM trip QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY start_ts DESC) <= 6""",
    "a1_thresholds_met": "SELECT 300 AS soc_age, 300 AS temp_age, CAST(20 AS DOUBLE) AS soc_warn_lo, CAST(10 AS DOUBLE) AS soc_crit_lo, CAST(45 AS DOUBLE) AS temp_crit_hi, count(*) FILTER (WHERE value < 20) AS soc_below FROM soc",
    "a2_fresh_battery": "SELECT * FROM fresh",
    "a3_conditions": "SELECT * FROM cond",
    "a4_resolved": "SELECT alert_id, severity FROM alerts, c WHERE resolved_at = now",
    "a5_escalated": "SELECT alert_id, severity, raised_at FROM alerts, c WHERE escalated_at = now",
    "a6_raised": "SELECT alert_id, vehicle_id, alert_type, severity FROM alerts, c WHERE raised_at = now",
    "a7_evaluate": "SELECT * FROM alerts",
    "a8_episodes": "SELECT * FROM ep",
    "a9_dismissals": "SELECT o.* EXCLUDE (dismissed_at, dismiss_reason), CASE WHEN NOT undo THEN acted_at END AS dismissed_at, CASE WHEN NOT undo THEN CASE WHEN note = '' THEN code ELSE concat(code, ': ', note) END END AS dismiss_reason FROM old_alerts o LEFT JOIN actions USING (alert_id)",
    "a10_open_list": "SELECT alert_id, vehicle_id, reg_no, alert_type, severity, raised_at, escalated_at, l.value, s.unit, l.event_ts AS reading_ts FROM live JOIN roster USING (vehicle_id) JOIN kinds k USING (alert_type) LEFT JOIN spec s USING (signal) LEFT JOIN latest l USING (vehicle_id, signal) ORDER BY severity <> 'critical', raised_at DESC, alert_id",
    "a11_card_facts": "SELECT alert_id, l.event_ts IS NULL OR l.event_ts < now - to_seconds(max_age_sec) AS is_stale, escalated_at IS NOT NULL AND severity <> 'critical' AS eased_off, CAST(floor(epoch(now - raised_at)) AS BIGINT) AS age_s FROM live CROSS JOIN c JOIN kinds k USING (alert_type) LEFT JOIN spec s USING (signal) LEFT JOIN latest l USING (vehicle_id, signal)",
    "a12_badge_totals": "SELECT count(*) AS open_alerts, coalesce(bool_or(severity = 'critical'), FALSE) AS any_critical FROM live",
    "g1_distances": "SELECT geofence_id, round(min(d), 3) AS nearest_m, round(max(d), 3) AS farthest_m FROM probe GROUP BY 1",
    "g2_batch_scope": "SELECT vehicle_id, CASE WHEN NOT coalesce(t <= processed_through, FALSE) THEN t END AS from_ts, coalesce(t <= processed_through, FALSE) AS full_replay FROM (SELECT vehicle_id, min(event_ts) AS t FROM fix GROUP BY 1) LEFT JOIN wm USING (vehicle_id)",
    "g3_full_scope": "SELECT vehicle_id, TRUE AS full_replay FROM roster",
    "g4_probes": "SELECT vehicle_id, geofence_id, count(*) AS probes, sum(h) AS band_m FROM probe GROUP BY 1, 2",
    "g5_opinions": "SELECT * FROM opinion",
    "g6_seed_votes": """SELECT v.vehicle_id, v.geofence_id, v.event_ts, o.zone, coalesce(v.settles, v.stood) AS seed_zone FROM votes v JOIN opinion o USING (vehicle_id, geofence_id, event_ts)
      JOIN (SELECT vehicle_id, geofence_id, max(event_ts) AS event_ts FROM opinion, c WHERE event_ts <= mid GROUP BY 1, 2) e USING (vehicle_id, geofence_id, event_ts) SEMI JOIN (SELECT vehicle_id FROM fix, c WHERE event_ts > mid) USING (vehicle_id)""",
    "g7_votes": "SELECT geofence_id, zone, count(*) AS votes FROM opinion GROUP BY 1, 2",
    "g8_previous": "SELECT vehicle_id, geofence_id, event_ts, last_zone, last_ts FROM votes",
    "g9_confirmed": "SELECT vehicle_id, geofence_id, event_ts, settles, since_ts FROM votes",
    "g10_settled": "SELECT vehicle_id, geofence_id, event_ts, stood FROM votes",
    "g11_transitions": "SELECT * FROM trans",
    "g12_containment": "SELECT * FROM cont",
    "g13_incremental_crossings": "SELECT * FROM trans",
    "g12_incremental_containment": "SELECT * FROM cont",
    "g11_keyed_crossings": "SELECT * FROM trans",
    "g14_recompute": "SELECT geofence_id, kind, confidence, count(*) AS n FROM trans GROUP BY 1, 2, 3",
    "g15_occupancy": "SELECT f.geofence_id, name, active_to IS NULL AS active, (SELECT count(*) FROM cont WHERE cont.geofence_id = f.geofence_id AND zone = 'IN') AS vehicles FROM fences f ORDER BY active DESC, name",
    "g16_current_fence": "SELECT vehicle_id, geofence_id, name, radius_m FROM cont JOIN fences USING (geofence_id) WHERE zone = 'IN' AND active_to IS NULL QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY radius_m, geofence_id) = 1",
    "g17_recent_crossings": "SELECT * FROM trans QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, geofence_id) <= 8",
    "g18_upsert_fences": "SELECT geofence_id, name, lat, lon, CASE WHEN CAST(radius_m AS INTEGER) % 3 = 0 THEN radius_m * 2 ELSE radius_m END AS radius_m, active_from, active_to, CASE WHEN CAST(radius_m AS INTEGER) % 3 = 0 THEN (SELECT mid FROM c) ELSE updated_at END AS updated_at FROM own",
    "g19_switch_fences": "SELECT geofence_id, active_from, active_to FROM switched",
    "g19_rejected": "SELECT a.geofence_id FROM (SELECT geofence_id FROM own UNION ALL SELECT 'gf-nowhere') a ANTI JOIN own o ON o.geofence_id = a.geofence_id",
    "g20_fence_problems": "SELECT geofence_id, CASE WHEN trim(name) = '' THEN 'name' WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon' WHEN radius_m NOT BETWEEN 1 AND 200000 THEN 'radius_m' END AS problem FROM own",
    "g21_active_fences": "SELECT count(*) AS active FROM switched WHERE active_to IS NULL",
    "g21_fence_by_id": "SELECT * FROM own WHERE geofence_id = 'gf-v7'",
    "t1_crossings": "SELECT vehicle_id, event_ts, kind, geofence_id, radius_m FROM crossing",
    "t2_baselines": "SELECT * FROM base",
    "t3_steps": "SELECT * FROM move",
    "t4_occupancy": "SELECT vehicle_id, event_ts, before, after FROM level",
    "t5_edges": "SELECT * FROM edge",
    "t6_outings": "SELECT * FROM outing",
    "t7_distances": "SELECT trip_id, distance_km FROM trip",
    "t7_kept_readings": "SELECT * FROM kept",
    "t7_resumed_distances": "SELECT trip_id, distance_km FROM trip",
    "t8_trips": "SELECT * FROM trip",
    "t9_incremental_trips": "SELECT * FROM trip",
    "t10_fleet_trips": "SELECT trip.*, o.name AS origin_name, d.name AS dest_name FROM trip LEFT JOIN fences o ON o.geofence_id = origin_geofence_id LEFT JOIN fences d ON d.geofence_id = dest_geofence_id ORDER BY status = 'COMPLETED', start_ts DESC, trip_id LIMIT 50",
    "t11_vehicle_trips": "SELECT * FROM trip QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY start_ts DESC) <= 6",
    "t12_elapsed": "SELECT trip_id, status, CAST(floor(epoch(coalesce(end_ts, now) - start_ts)) AS BIGINT) AS elapsed_s FROM trip, c",
    "r1_roll_up": f"SELECT {_SIX} FROM rolled",
    "r2_surviving": "SELECT * FROM surviving",
    "r3_fixes_kept": "SELECT count(*) AS fixes FROM fix, c WHERE event_ts >= mid",
    "r4_compaction_report": "SELECT (SELECT count(*) FROM sig) AS before, (SELECT count(*) FROM surviving) AS after, (SELECT count(*) FROM rolled) AS buckets, (SELECT count(*) FROM fix, c WHERE event_ts < mid) AS fixes_dropped",
    "r5_stitched": """SELECT vehicle_id, signal, bucket_ts, CAST(sum(readings) AS BIGINT) AS readings, min(min_value) AS min_value, max(max_value) AS max_value, round(sum(avg_value * readings) / sum(readings), 6) AS avg_value,
      arg_max(last_value, last_ts) AS last_value, max(last_ts) AS last_ts FROM (SELECT * FROM rolled UNION ALL SELECT * FROM hot) GROUP BY 1, 2, 3""",
    "m1_percentiles": "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS low, max(value) AS high FROM events",
}


def oracle_sql() -> dict[str, str]:
    head = "WITH " + ", ".join(f"{name} AS ({body})" for name, body in CHAIN.items())
    return {name: f"{head} {select}" for name, select in SELECTS.items()}
