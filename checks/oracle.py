"""The registered queries as SQL over the given tables.

``PARTS`` are named sub-queries; :func:`statement` puts the ones a query needs in
front of it. Column lists end in ``:d`` for doubles, which are rounded as in
``queries.tidy``, and ``:i`` for counts.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {
    "ev": "SELECT *, CAST(ts AS DATE) AS op_day,"
    " CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events",
    "station_event": """
        SELECT op_day, event_id AS row_id, ts,
               CASE event_type WHEN 'click' THEN 'arrived' WHEN 'purchase' THEN 'triggerGo'
                    WHEN 'view' THEN 'release' WHEN 'signup' THEN 'ppReady' ELSE 'other' END
                   AS event_type,
               'LT_LABOR:POINT:' || ((k % 6) % 3) || ':' || (CASE WHEN k % 6 < 3 THEN 0 ELSE 1 END)
                   AS location_code,
               'R' || CAST(user_id % 4 AS VARCHAR) AS robot_id,
               CASE WHEN user_id % 4 = 3 THEN 'A42' ELSE 'K50' END AS robot_type
        FROM ev""",
    "callback": """
        SELECT op_day, event_id AS row_id, ts,
               CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'load'
                    ELSE 'unload' END AS action,
               CASE WHEN k % 11 = 0 THEN 'PORT-1' ELSE 'LABOR-' || (k % 6 + 1) END AS location_type
        FROM ev""",
    "lifecycle": """
        SELECT op_day, event_id AS row_id, 'ND' || event_id AS task_code,
               'T' || user_id AS container_id,
               CASE WHEN k % 10 = 0 THEN 'BUF-1'
                    ELSE 'HAI-' || (k % 20) || '-' || (user_id % 30 + 1) || '-1-1' END AS source_loc,
               CASE WHEN k % 11 = 0 THEN 'PORT-1' ELSE 'LABOR-' || (k % 6 + 1) END AS dest_loc,
               ts AS completed_ts, value * 40 AS total_s, value * 10 AS leg_s,
               value * 3 AS shuttle_s, value
        FROM ev""",
    "stage": """
        SELECT l.*, s.stage, s.stage_label, s.stage_ord, l.value * s.factor AS seconds
        FROM lifecycle l, (VALUES
            ('分配耗时(秒)', 'Allocation wait', 1, 0.5::DOUBLE),
            ('A42取箱耗时(秒)', 'A42 retrieve', 2, 2.0::DOUBLE),
            ('A42放箱耗时(秒)', 'A42 deposit', 3, 1.0::DOUBLE),
            ('K50完成耗时(秒)', 'K50 deliver + dwell', 4, 10.0::DOUBLE)
        ) s(stage, stage_label, stage_ord, factor)""",
    "station_dim": """
        SELECT location_code, 'LABOR-' || row_number() OVER (ORDER BY y, x, location_code) AS station,
               x, y, 'Zone ' || chr(CAST(64 + dense_rank() OVER (ORDER BY y) AS INT)) AS zone,
               row_number() OVER (ORDER BY y, x, location_code) AS station_ord
        FROM (SELECT DISTINCT location_code,
                     CAST(split_part(location_code, ':', 3) AS INT) AS x,
                     CAST(split_part(location_code, ':', 4) AS INT) AS y
              FROM station_event
              WHERE location_code LIKE '%LABOR%' AND location_code LIKE '%POINT%')""",
    "rated_dim": """
        SELECT d.*, CASE station WHEN 'LABOR-1' THEN 4 ELSE
                        CASE z.zone WHEN 'Zone A' THEN 6 WHEN 'Zone B' THEN 5 END END AS design_rate,
               z.zone AS own_zone
        FROM station_dim d JOIN (
            SELECT location_code, CASE station WHEN 'LABOR-3' THEN 'Zone X' ELSE zone END AS zone
            FROM station_dim) z USING (location_code)""",
    "rtype": """
        SELECT coalesce(arg_min(robot_type, row_id) FILTER (WHERE robot_type LIKE '%50%'),
                        arg_min(robot_type, row_id)) AS robot_type FROM station_event""",
    "located": "SELECT e.*, d.station FROM station_event e"
    " LEFT JOIN station_dim d ON e.location_code = d.location_code",
    "delivery": "SELECT * FROM located WHERE robot_type = (SELECT robot_type FROM rtype)",
    "day_stations": "SELECT DISTINCT op_day, station FROM located WHERE station IS NOT NULL",
    "pick_all": """
        SELECT op_day, robot_id, location_code, station, start_ts, end_ts,
               date_diff('microsecond', start_ts, end_ts) / 1e6 AS seconds
        FROM (SELECT op_day, robot_id, event_type, ts AS end_ts, lag(event_type) OVER w AS before,
                     lag(ts) OVER w AS start_ts, lag(location_code) OVER w AS location_code,
                     lag(station) OVER w AS station
              FROM located WHERE event_type IN ('arrived', 'triggerGo')
              WINDOW w AS (PARTITION BY op_day, robot_id ORDER BY ts, row_id))
        WHERE event_type = 'triggerGo' AND before = 'arrived'""",
    "pick_k50": """
        SELECT p.* FROM pick_all p
        WHERE robot_id IN (SELECT robot_id FROM station_event
                           WHERE robot_type = (SELECT robot_type FROM rtype))""",
    "picks": "SELECT *, date_trunc('hour', start_ts) AS hour FROM pick_k50"
    " WHERE seconds >= 0 AND seconds < 3600 AND station IS NOT NULL",
    "picks_all": "SELECT *, date_trunc('hour', start_ts) AS hour FROM pick_all"
    " WHERE seconds >= 0 AND seconds < 3600 AND station IS NOT NULL",
    "switch_all": """
        SELECT op_day, station, location_code, start_ts, end_ts,
               date_diff('microsecond', start_ts, end_ts) / 1e6 AS seconds
        FROM (SELECT op_day, station, location_code, event_type, ts AS end_ts,
                     lag(event_type) OVER w AS before, lag(ts) OVER w AS start_ts
              FROM located WHERE event_type IN ('release', 'arrived')
              WINDOW w AS (PARTITION BY op_day, location_code ORDER BY ts, row_id))
        WHERE event_type = 'arrived' AND before = 'release'""",
    "switches": "SELECT *, date_trunc('hour', start_ts) AS hour FROM switch_all"
    " WHERE seconds >= 0 AND seconds < 7200",
    "switch_k50": """
        SELECT op_day, station, start_ts, end_ts,
               date_diff('microsecond', start_ts, end_ts) / 1e6 AS seconds
        FROM (SELECT op_day, station, event_type, ts AS end_ts,
                     lag(event_type) OVER w AS before, lag(ts) OVER w AS start_ts
              FROM delivery WHERE event_type IN ('release', 'arrived')
              WINDOW w AS (PARTITION BY op_day, station ORDER BY ts, row_id))
        WHERE event_type = 'arrived' AND before = 'release'
          AND date_diff('microsecond', start_ts, end_ts) / 1e6 < 7200""",
    "dwell_all": """
        SELECT op_day, robot_id, min(ts) FILTER (WHERE event_type = 'arrived') AS start_ts,
               max(ts) FILTER (WHERE event_type = 'release') AS end_ts, max(robot_type) AS robot_type
        FROM (SELECT *, coalesce(count(*) FILTER (WHERE event_type = 'release') OVER (
                         PARTITION BY op_day, robot_id ORDER BY ts, row_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
              FROM station_event WHERE event_type IN ('arrived', 'release'))
        GROUP BY op_day, robot_id, island
        HAVING start_ts IS NOT NULL AND end_ts IS NOT NULL""",
    "done_cells": """
        SELECT op_day, station, date_trunc('hour', ts) AS hour, count(*) AS n
        FROM delivery WHERE event_type = 'triggerGo' AND station IS NOT NULL GROUP BY ALL""",
    "grid": """
        SELECT op_day, station, h.hour FROM (
            SELECT DISTINCT op_day, station FROM done_cells) s,
            unnest(generate_series(CAST(s.op_day AS TIMESTAMP),
                                   CAST(s.op_day AS TIMESTAMP) + INTERVAL 23 HOUR,
                                   INTERVAL 1 HOUR)) h(hour)""",
    "full_grid": """
        SELECT op_day, station, h.hour FROM day_stations s,
            unnest(generate_series(CAST(s.op_day AS TIMESTAMP),
                                   CAST(s.op_day AS TIMESTAMP) + INTERVAL 23 HOUR,
                                   INTERVAL 1 HOUR)) h(hour)""",
    "station_hour": "SELECT g.*, coalesce(c.n, 0) AS completions FROM grid g"
    " LEFT JOIN done_cells c USING (op_day, station, hour)",
    "pick_slices": """
        SELECT p.op_day, p.station, p.seconds, p.start_ts, p.end_ts, h.hour,
               date_diff('microsecond', greatest(p.start_ts, h.hour),
                         least(p.end_ts, h.hour + INTERVAL 1 HOUR)) / 1e6 AS slice_s
        FROM picks p, unnest(generate_series(date_trunc('hour', p.start_ts),
            date_trunc('hour', p.end_ts), INTERVAL 1 HOUR)) h(hour)
        WHERE p.seconds = 0 OR p.end_ts > h.hour""",
    "all_pick_slices": """
        SELECT p.op_day, p.station, h.hour,
               date_diff('microsecond', greatest(p.start_ts, h.hour),
                         least(p.end_ts, h.hour + INTERVAL 1 HOUR)) / 1e6 AS slice_s
        FROM picks_all p, unnest(generate_series(date_trunc('hour', p.start_ts),
            date_trunc('hour', p.end_ts), INTERVAL 1 HOUR)) h(hour)
        WHERE p.seconds = 0 OR p.end_ts > h.hour""",
    "switch_slices": """
        SELECT p.op_day, p.station, h.hour,
               date_diff('microsecond', greatest(p.start_ts, h.hour),
                         least(p.end_ts, h.hour + INTERVAL 1 HOUR)) / 1e6 AS slice_s
        FROM switches p, unnest(generate_series(date_trunc('hour', p.start_ts),
            date_trunc('hour', p.end_ts), INTERVAL 1 HOUR)) h(hour)
        WHERE p.seconds = 0 OR p.end_ts > h.hour""",
    "switch_k50_slices": """
        SELECT p.op_day, p.station, h.hour,
               date_diff('microsecond', greatest(p.start_ts, h.hour),
                         least(p.end_ts, h.hour + INTERVAL 1 HOUR)) / 1e6 AS slice_s
        FROM switch_k50 p, unnest(generate_series(date_trunc('hour', p.start_ts),
            date_trunc('hour', p.end_ts), INTERVAL 1 HOUR)) h(hour)""",
    "detail": """
        SELECT *, CASE WHEN cap > 0 THEN least(eff / cap * 100, 100) END AS implied_pct FROM (
            SELECT g.op_day, g.station, g.hour, g.completions, has_picks,
                   CASE WHEN has_picks THEN
                       least(coalesce(occ, 0) + coalesce(sw, 0), 3600) / 36.0::DOUBLE END AS active_pct,
                   CASE WHEN has_picks AND completions > 0 THEN coalesce(tasks, 0) END AS eff,
                   CASE WHEN completions > 0 THEN 3600 / (weighted / tasks + 6) END AS cap
            FROM station_hour g
            LEFT JOIN (SELECT op_day, station, hour, least(sum(slice_s), 3600) AS occ,
                              sum(slice_s / seconds) AS tasks,
                              sum(slice_s / seconds * seconds) AS weighted
                       FROM pick_slices WHERE seconds > 0 GROUP BY ALL) p USING (op_day, station, hour)
            LEFT JOIN (SELECT op_day, station, hour, least(sum(slice_s), 3600) AS sw
                       FROM switch_k50_slices GROUP BY ALL) s USING (op_day, station, hour)
            LEFT JOIN (SELECT op_day, bool_or(seconds > 0) AS has_picks FROM picks
                       JOIN (SELECT DISTINCT op_day, station FROM done_cells)
                       USING (op_day, station) GROUP BY op_day) d USING (op_day))""",
    "shown": """
        SELECT *, CASE WHEN has_picks THEN eff
                       WHEN completions > 0 THEN CAST(completions AS DOUBLE) END AS shown FROM detail""",
    "pick_cells": """
        SELECT op_day, station, hour, median(slice_s) AS median_s, avg(slice_s) AS mean_s,
               count(*) AS slices FROM pick_slices GROUP BY ALL""",
    "weighted_cells": """
        SELECT op_day, station, hour, sum(slice_s / seconds * seconds) / sum(slice_s / seconds)
                   AS weighted_pick_s
        FROM pick_slices WHERE seconds > 0 GROUP BY ALL""",
    "occupancy": """
        SELECT g.*, coalesce(p.v, 0::DOUBLE) AS pick_s, coalesce(s.v, 0::DOUBLE) AS switch_s
        FROM full_grid g
        JOIN (SELECT DISTINCT op_day FROM picks_all) USING (op_day)
        LEFT JOIN (SELECT op_day, station, hour, least(sum(slice_s), 3600) AS v
                   FROM all_pick_slices GROUP BY ALL) p USING (op_day, station, hour)
        LEFT JOIN (SELECT op_day, station, hour, least(sum(slice_s), 3600) AS v
                   FROM switch_slices GROUP BY ALL) s USING (op_day, station, hour)""",
    "scatter": """
        SELECT *, inlier OR sum(CAST(inlier AS INT)) OVER (PARTITION BY op_day) < 4 AS used FROM (
            SELECT c.*, pick_s BETWEEN x1 - 1.5 * (x3 - x1) AND x3 + 1.5 * (x3 - x1)
                    AND completions BETWEEN y1 - 1.5 * (y3 - y1) AND y3 + 1.5 * (y3 - y1) AS inlier
            FROM (SELECT op_day, station, hour, completions, mean_s AS pick_s
                  FROM station_hour JOIN pick_cells USING (op_day, station, hour)
                  WHERE completions > 0 AND mean_s > 0) c
            JOIN (SELECT op_day, quantile_cont(mean_s, 0.25) AS x1, quantile_cont(mean_s, 0.75) AS x3,
                         quantile_cont(completions::DOUBLE, 0.25) AS y1,
                         quantile_cont(completions::DOUBLE, 0.75) AS y3
                  FROM station_hour JOIN pick_cells USING (op_day, station, hour)
                  WHERE completions > 0 AND mean_s > 0 GROUP BY op_day) q USING (op_day))""",
    "switch_cells": "SELECT op_day, station, hour, median(seconds) AS median_s,"
    " avg(seconds) AS mean_s, count(*) AS switches FROM switches GROUP BY ALL",
    "cycle": "SELECT op_day, task_code, dest_loc, total_s, total_s / 60.0::DOUBLE AS cycle_min,"
    " date_trunc('hour', completed_ts) AS hour FROM lifecycle"
    " WHERE total_s >= 0 AND total_s < 7200",
    "demand": "SELECT op_day, date_trunc('hour', ts) AS hour, count(*) AS demand FROM callback"
    " WHERE action = 'complete' AND location_type LIKE 'LABOR%' GROUP BY ALL",
    "demand_cycle": """
        SELECT op_day, hour, demand, median(cycle_min) AS cycle_min
        FROM demand JOIN cycle USING (op_day, hour) GROUP BY ALL""",
    "demand_ranks": """
        SELECT *, rank() OVER (PARTITION BY op_day ORDER BY demand)
                  + (count(*) OVER (PARTITION BY op_day, demand) - 1) / 2.0::DOUBLE AS rx,
               rank() OVER (PARTITION BY op_day ORDER BY cycle_min)
                  + (count(*) OVER (PARTITION BY op_day, cycle_min) - 1) / 2.0::DOUBLE AS ry
        FROM demand_cycle""",
    "storage": """
        SELECT l.*, split_part(source_loc, '-', 2) AS aisle, split_part(source_loc, '-', 3) AS bay,
               split_part(source_loc, '-', 4) AS level
        FROM lifecycle l WHERE source_loc LIKE 'HAI%'""",
    "wide": """
        SELECT CAST(l_partkey AS VARCHAR) AS container_id, CAST(l_suppkey % 20 AS VARCHAR) AS aisle,
               l_orderkey % 30 + 1 AS bay FROM lineitem""",
    "wide_totes": "SELECT container_id, count(*) AS retrievals FROM wide GROUP BY ALL",
    "day_totes": "SELECT op_day, container_id, count(*) AS retrievals FROM lifecycle GROUP BY ALL",
    "legs": "SELECT op_day, row_id, dest_loc AS station, leg_s, completed_ts FROM lifecycle"
    " WHERE leg_s > 0 AND leg_s < 3600 AND dest_loc LIKE 'LABOR%'",
    "leg_spans": "SELECT *, completed_ts - to_microseconds(CAST(round_even(leg_s * 1e6, 0) AS BIGINT))"
    " AS start_ts FROM legs",
    "depths": """
        SELECT a.op_day, a.station, a.row_id, a.leg_s, count(*) AS depth
        FROM leg_spans a JOIN leg_spans b
          ON a.op_day = b.op_day AND a.station = b.station
         AND b.start_ts <= a.completed_ts AND b.completed_ts >= a.start_ts
        GROUP BY ALL""",
    "edges": """
        SELECT op_day, CASE WHEN len(e) < 2 THEN [1, greatest(2, top + 1)] ELSE e END AS e FROM (
            SELECT op_day, max(depth) AS top,
                   list_sort(list_distinct(list_transform(
                       quantile_cont(depth::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]),
                       lambda x: CAST(round_even(x, 0) AS BIGINT)))) AS e
            FROM depths GROUP BY op_day)""",
    "binned": """
        SELECT op_day, leg_s, bin,
               CASE WHEN bin = 0 THEN '<' || e[2] WHEN bin = len(e) - 2 THEN e[bin + 1] || '+'
                    ELSE e[bin + 1] || '–' || e[bin + 2] END AS label
        FROM (SELECT d.*, e, len(list_filter(e[2:], lambda x: x < depth)) AS bin
              FROM depths d JOIN edges USING (op_day))""",
    "boxes": """
        SELECT op_day, station, min(depth) AS low, quantile_cont(depth::DOUBLE, 0.25) AS q1,
               median(depth) AS med, quantile_cont(depth::DOUBLE, 0.75) AS q3, max(depth) AS high
        FROM depths GROUP BY ALL""",
    "tasks": """
        SELECT op_day, 'delivery' AS fleet, leg_start AS start_ts, completed_ts AS end_ts FROM t
        UNION ALL
        SELECT op_day, 'shuttle',
               leg_start - to_microseconds(CAST(round_even(shuttle_s * 1e6, 0) AS BIGINT)), leg_start
        FROM t WHERE shuttle_s > 0""",
    "t": "SELECT *, completed_ts - to_microseconds(CAST(round_even(leg_s * 1e6, 0) AS BIGINT))"
    " AS leg_start FROM lifecycle WHERE leg_s > 0 AND leg_s < 7200",
    "sizes": "SELECT op_day, CASE WHEN robot_type = 'K50' THEN 'delivery' ELSE 'shuttle' END AS fleet,"
    " count(DISTINCT robot_id) AS fleet_size FROM station_event GROUP BY ALL",
    "timeline": """
        SELECT g.op_day, g.fleet, g.mid_ts, g.fleet_size,
               least(count(i.start_ts), g.fleet_size) AS on_task
        FROM (SELECT s.op_day, s.fleet, s.fleet_size, b + INTERVAL 150 SECOND AS mid_ts
              FROM sizes s JOIN (
                  SELECT op_day, time_bucket(INTERVAL 5 MINUTE, min(ts)) AS lo,
                         time_bucket(INTERVAL 5 MINUTE, max(ts) - INTERVAL 1 MICROSECOND) AS hi
                  FROM station_event GROUP BY op_day) r USING (op_day),
                  unnest(generate_series(lo, hi, INTERVAL 5 MINUTE)) x(b)
              WHERE hi > lo) g
        LEFT JOIN tasks i ON i.op_day = g.op_day AND i.fleet = g.fleet
             AND i.start_ts <= g.mid_ts AND i.end_ts >= g.mid_ts
        GROUP BY g.op_day, g.fleet, g.mid_ts, g.fleet_size""",
    "daily": """
        SELECT d.op_day, t.n AS total_tasks, c.med AS median_cycle_min, c.p90 AS p90_cycle_min,
               p.s AS mean_pick_s, s.s AS median_switch_s
        FROM (SELECT DISTINCT op_day FROM ev) d
        LEFT JOIN (SELECT op_day, count(*) FILTER (WHERE event_type = 'triggerGo'
                       AND station IS NOT NULL) AS n FROM located GROUP BY op_day) t USING (op_day)
        LEFT JOIN (SELECT op_day, median(cycle_min) AS med, quantile_cont(cycle_min, 0.9) AS p90
                   FROM cycle GROUP BY op_day) c USING (op_day)
        LEFT JOIN (SELECT op_day, avg(seconds) AS s FROM pick_all
                   WHERE seconds < 3600 GROUP BY op_day) p USING (op_day)
        LEFT JOIN (SELECT op_day, median(seconds) AS s FROM switches GROUP BY op_day) s
            USING (op_day)""",
    "hourly_use": """
        SELECT op_day, station, avg(n / (3600 / (m + 6)) * 100) AS implied_pct
        FROM (SELECT op_day, station, date_trunc('hour', end_ts) AS h, count(*) AS n,
                     avg(seconds) AS m FROM picks_all GROUP BY ALL)
        GROUP BY op_day, station""",
    "log": """
        SELECT *, CASE WHEN k % 11 = 0 THEN 'PORT-1' ELSE 'LABOR-' || (k % 6 + 1) END AS stn,
               'LABOR-' || (k % 6 + 1) AS labor,
               'LT_LABOR:POINT:' || ((k % 6) % 3) || ':' || (CASE WHEN k % 6 < 3 THEN 0 ELSE 1 END)
                   AS point,
               'robot-' || (user_id % 4) AS robot, epoch_us(ts) // 1000 AS ms
        FROM ev""",
    "changes": """
        SELECT op_day, 'ND' || user_id AS task_code, event_id, 'G' || k AS grp, robot,
               CASE WHEN k % 3 = 0 THEN 'HAI-' || k || '-1-1-1' END AS src,
               CASE WHEN event_type = 'purchase' AND k % 11 <> 0 THEN stn END AS fin, labor,
               CASE WHEN event_type = 'view' THEN ms - 1500 END AS assigned,
               CASE WHEN event_type = 'purchase' THEN ms END AS completed
        FROM log WHERE event_type IN ('purchase', 'view')""",
    "folded": """
        SELECT op_day, task_code, arg_min(grp, event_id) AS task_group,
               arg_max(robot, event_id) AS robot_id,
               coalesce(arg_min(src, event_id) FILTER (WHERE src IS NOT NULL), '') AS source_loc,
               coalesce(arg_max(fin, event_id) FILTER (WHERE fin IS NOT NULL),
                        arg_min(labor, event_id)) AS dest_loc,
               make_timestamp(1000 * arg_max(assigned, event_id) FILTER (WHERE assigned IS NOT NULL))
                   AS assigned_ts,
               make_timestamp(1000 * arg_max(completed, event_id) FILTER (WHERE completed IS NOT NULL))
                   AS completed_ts
        FROM changes GROUP BY op_day, task_code HAVING completed_ts IS NOT NULL""",
    "matrix": "SELECT op_day, strftime(ts, '%H:00') AS hour_label, station FROM delivery"
    " WHERE event_type = 'triggerGo' AND station IS NOT NULL",
    "chain": """
        SELECT g.op_day, g.station, g.hour_label, p.v AS p, s.v AS s, coalesce(m.n, 0) AS n
        FROM (SELECT op_day, station, strftime(hour, '%H:00') AS hour_label FROM full_grid
              WHERE op_day IN (SELECT op_day FROM picks_all)) g
        LEFT JOIN (SELECT op_day, station, strftime(hour, '%H:00') AS hour_label, avg(seconds) AS v
                   FROM picks_all GROUP BY ALL) p USING (op_day, station, hour_label)
        LEFT JOIN (SELECT op_day, station, strftime(hour, '%H:00') AS hour_label, avg(seconds) AS v
                   FROM switches GROUP BY ALL) s USING (op_day, station, hour_label)
        LEFT JOIN (SELECT op_day, station, hour_label, count(*) AS n FROM matrix GROUP BY ALL) m
            USING (op_day, station, hour_label)""",
}


def _needed(text: str, found: dict[str, None]) -> None:
    for name in PARTS:
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            _needed(PARTS[name], found)
            found[name] = None


def statement(columns: str, body: str) -> str:
    """Full SQL text: needed parts, body, and the final casts."""
    parts: dict[str, None] = {}
    _needed(body, parts)
    out = []
    for column in columns.split():
        name, _, kind = column.partition(":")
        cast = {
            "": name,
            "d": f"round(CAST({name} AS DOUBLE) + 1e-9, 6) AS {name}",
            "i": f"CAST({name} AS BIGINT) AS {name}",
        }[kind]
        out.append(cast)
    head = ",\n".join(f"{n} AS ({PARTS[n].strip()})" for n in parts)
    prefix = f"WITH {head}\n" if parts else ""
    return f"{prefix}SELECT {', '.join(out)} FROM ({body.strip()}) AS result"


CELL = "op_day station hour"

SQL: dict[str, tuple[str, str]] = {
    "s1_read_log": (
        "op_day ts event data_id",
        """SELECT op_day, ts, 'TASK_EXECUTION_CALLBACK_SENT' AS event,
                  CAST(event_id AS VARCHAR) AS data_id FROM ev
           UNION ALL
           SELECT op_day, ts, 'BUSINESS_TASK_DATA_CHANGE', NULL
           FROM ev WHERE event_type IN ('purchase', 'view')""",
    ),
    # Text after an entry belongs to its payload, which makes entries of errors unreadable.
    "s1_read_log_multiline": (
        "op_day ts event data_id",
        """SELECT op_day, ts, 'TASK_EXECUTION_CALLBACK_SENT' AS event,
                  CAST(event_id AS VARCHAR) AS data_id FROM ev WHERE event_type <> 'error'
           UNION ALL
           SELECT op_day, ts, 'BUSINESS_TASK_DATA_CHANGE', NULL
           FROM ev WHERE event_type IN ('purchase', 'view')""",
    ),
    "s2_log_entries": (
        "op_day label ts event data_id",
        """SELECT op_day, CAST(op_day AS VARCHAR) AS label, ts, 'TASK_EXECUTION_CALLBACK_SENT' AS event,
                  CAST(event_id AS VARCHAR) AS data_id FROM ev
           UNION ALL
           SELECT op_day, CAST(op_day AS VARCHAR), ts, 'BUSINESS_TASK_DATA_CHANGE', NULL
           FROM ev WHERE event_type IN ('purchase', 'view')""",
    ),
    "s2_payload_fields": (
        "op_day ts event second_hop:i battery:i no_number:i robot",
        """SELECT op_day, ts, 'TASK_EXECUTION_CALLBACK_SENT' AS event, NULL AS second_hop, NULL AS battery,
                  NULL AS no_number, robot
           FROM (SELECT *, 'robot-' || (user_id % 4) AS robot FROM ev)
           UNION ALL
           SELECT op_day, ts, 'BUSINESS_TASK_DATA_CHANGE', k % 5, CASE WHEN k % 2 = 0 THEN k END, NULL, NULL
           FROM ev WHERE event_type IN ('purchase', 'view')""",
    ),
    "s4_log_days": (
        "label files:i",
        "SELECT DISTINCT CAST(op_day AS VARCHAR) AS label, 1 AS files FROM ev",
    ),
    "s5_callback": (
        "op_day ts action task_group task_code robot_id container_id location_code location_type"
        " callback_id robot_type",
        """SELECT op_day, ts, CASE WHEN event_type = 'purchase' THEN 'complete'
                       WHEN k % 2 = 0 THEN 'put' ELSE 'robot' END AS action,
                  '' AS task_group, 'ND' || user_id AS task_code, robot AS robot_id,
                  'T' || user_id AS container_id, point AS location_code, stn AS location_type,
                  CAST(event_id AS VARCHAR) AS callback_id, 'K50' AS robot_type
           FROM log WHERE event_type <> 'click' AND (event_type <> 'purchase' OR k % 11 <> 0)""",
    ),
    "s6_station_event": (
        "op_day ts event_type location_code robot_id robot_type",
        """SELECT DISTINCT op_day, ts, x.e AS event_type, point AS location_code, robot AS robot_id,
                  'K50' AS robot_type
           FROM log JOIN (VALUES ('click', 'arrived'), ('purchase', 'triggerGo'),
                                 ('purchase', 'release')) x(src, e) ON event_type = x.src
           WHERE k % 11 <> 0""",
    ),
    "s4_undated_pairs": (
        "op_day robot_id start_ts end_ts seconds:d location_code",
        """SELECT (SELECT min(op_day) FROM ev) AS op_day, robot AS robot_id, p_ts AS start_ts, ts AS end_ts,
                  date_diff('microsecond', p_ts, ts) / 1e6 AS seconds, p_point AS location_code
           FROM (SELECT *, lag(ts) OVER w AS p_ts, lag(event_type) OVER w AS p_type, lag(point) OVER w AS p_point
                 FROM log WHERE k % 11 <> 0 AND event_type IN ('click', 'purchase')
                 WINDOW w AS (PARTITION BY robot ORDER BY ts, event_id))
           WHERE event_type = 'purchase' AND p_type = 'click'""",
    ),
    "s4_incremental_ingest": (
        "ts event_type location_code robot_id robot_type",
        """SELECT DISTINCT ts, x.e AS event_type, point AS location_code, robot AS robot_id,
                  'K50' AS robot_type
           FROM log JOIN (VALUES ('click', 'arrived'), ('purchase', 'triggerGo'),
                                 ('purchase', 'release')) x(src, e) ON event_type = x.src
           WHERE k % 11 <> 0""",
    ),
    "s7_lifecycle_fold": (
        "op_day task_code task_group container_id robot_id source_loc dest_loc created_ts assigned_ts"
        " loaded_ts unloaded_ts completed_ts assign_s:d total_s:d leg_s:d",
        """SELECT op_day, task_code, task_group, '' AS container_id, robot_id, source_loc, dest_loc,
                  CAST(NULL AS TIMESTAMP) AS created_ts, assigned_ts,
                  CAST(NULL AS TIMESTAMP) AS loaded_ts, CAST(NULL AS TIMESTAMP) AS unloaded_ts,
                  completed_ts, CAST(NULL AS DOUBLE) AS assign_s,
                  round_even(date_diff('microsecond', assigned_ts, completed_ts) / 1e6, 0) AS total_s,
                  CAST(NULL AS DOUBLE) AS leg_s
           FROM folded""",
    ),
    "s9_identify": (
        "kind n:i",
        """SELECT kind, count(*) AS n FROM events,
           (VALUES ('callback'), ('station'), ('lifecycle')) k(kind) GROUP BY kind""",
    ),
    "s9_canonical_lifecycle": (
        "op_day task_code container_id source_loc dest_loc completed_ts total_s:d leg_s:d shuttle_s:d",
        "SELECT * FROM lifecycle",
    ),
    "s10_station_overrides": (
        "location_code station x:i y:i zone station_ord:i design_rate:i",
        "SELECT * REPLACE (own_zone AS zone) FROM rated_dim",
    ),
    "s10_design_total": ("design_total:i", "SELECT sum(design_rate) AS design_total FROM rated_dim"),
    "s11_written_parquet": (f"{CELL} completions:i", "SELECT * FROM station_hour"),
    "s11_written_csv": (f"{CELL} capacity_tph:d", "SELECT *, cap AS capacity_tph FROM detail"),
    "s12_json_safe": (
        f"{CELL} completions:i effective_tasks:d",
        "SELECT *, nullif(eff, 0) AS effective_tasks FROM detail",
    ),
    "s13_raw_station": (
        "op_day row_id:i ts event_type location_code robot_id robot_type",
        "SELECT * FROM station_event",
    ),
    "s13_read_back_stages": (
        "op_day stage stage_label stage_ord:i median_s:d share:d total_median_s:d",
        """SELECT m.*, median_s / nullif(sum(median_s) OVER (PARTITION BY m.op_day), 0) AS share,
                  total_median_s
           FROM (SELECT op_day, stage, stage_label, stage_ord,
                        coalesce(median(seconds) FILTER (WHERE seconds >= 0 AND seconds < 3600), 0)
                            AS median_s FROM stage GROUP BY ALL) m
           LEFT JOIN (SELECT op_day, median(total_s) AS total_median_s FROM cycle GROUP BY ALL) c
             ON c.op_day = m.op_day""",
    ),
    "v3_quality_report": (
        'severity "table" "check" detail',
        """SELECT 'warning' AS severity, x.a AS "table", x.b AS "check", x.c AS detail
           FROM (VALUES ('callback', 'expected_column', '机器人编号'),
                        ('callback', 'expected_column', '容器编号'),
                        ('station', 'expected_column', '机器人编号')) x(a, b, c)
           UNION ALL
           SELECT 'warning', 'station', 'bad_timestamps',
                  CAST(CAST(round_even((1 - avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)) * 100, 0)
                       AS BIGINT) AS VARCHAR)
           FROM events
           HAVING avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) < 0.5""",
    ),
    "v2_few_rows": (
        'severity "table" "check" detail',
        """WITH few AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS good
                        FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 5)
           SELECT 'warning' AS severity, x.a AS "table", 'expected_column' AS "check",
                  '机器人编号' AS detail
           FROM (VALUES ('station'), ('station_empty')) x(a)
           UNION ALL SELECT 'warning', 'station', 'few_rows', CAST(n AS VARCHAR) FROM few WHERE n < 10
           UNION ALL
           SELECT 'warning', 'station', 'bad_timestamps',
                  CAST(CAST(round_even((1 - good / n) * 100, 0) AS BIGINT) AS VARCHAR)
           FROM few WHERE good > 0 AND good < n * 0.5
           UNION ALL SELECT 'error', 'station_empty', 'empty', '0'
           UNION ALL SELECT 'error', 'station_empty', 'no_timestamps', '时间戳'""",
    ),
    "v5_settings": (
        'severity "table" "check" detail',
        """SELECT x.a AS severity, 'overrides' AS "table", x.b AS "check", x.c AS detail
           FROM (VALUES ('warning', 'unknown_keys', 'colour'), ('error', 'string', 'amr_type'),
                        ('error', 'numeric_rate', 'LABOR-1')) x(a, b, c)""",
    ),
    "v6_load_issues": (
        'severity "table" "check" detail',
        """SELECT 'warning' AS severity, x.a AS "table", 'expected_column' AS "check", x.c AS detail
           FROM (VALUES ('callback', '机器人编号'), ('callback', '容器编号'), ('station', '机器人编号'),
                        ('lifecycle', '任务全程耗时(秒)'), ('lifecycle', '目标位置'),
                        ('lifecycle', '起始位置'), ('lifecycle', '容器编号')) x(a, c)
           UNION ALL SELECT 'error', 'lifecycle', 'duration_column', '耗时'
           UNION ALL
           SELECT 'warning', 'lifecycle', 'few_rows', CAST(count(*) AS VARCHAR)
           FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 5
           UNION ALL
           SELECT 'warning', 'station', 'bad_timestamps',
                  CAST(CAST(round_even((1 - avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)) * 100, 0)
                       AS BIGINT) AS VARCHAR)
           FROM events
           UNION ALL
           SELECT DISTINCT 'warning', 'callback', 'duplicate_day', CAST(op_day AS VARCHAR)
           FROM ev WHERE user_id % 2 = 1 AND day(op_day) > 20""",
    ),
    "v6_duplicate_days": (
        'severity "table" "check" detail',
        """SELECT 'warning' AS severity, 'callback' AS "table", 'duplicate_day' AS "check",
                  CAST(op_day AS VARCHAR) AS detail
           FROM (SELECT op_day, user_id % 2 = 1 AND day(op_day) > 20 AS late FROM ev)
           GROUP BY op_day HAVING count(DISTINCT late) > 1""",
    ),
    "p1_station_dim": (
        "location_code station x:i y:i zone station_ord:i design_rate:i",
        "SELECT *, NULL AS design_rate FROM station_dim",
    ),
    "p3_robot_type": ("robot_type", "SELECT * FROM rtype"),
    "p8_peak_day": (
        "op_day", "SELECT op_day FROM ev GROUP BY op_day ORDER BY count(*) DESC, op_day LIMIT 1"
    ),
    "p8_peak_day_rows": (
        f"{CELL} completions:i",
        """SELECT * FROM station_hour WHERE op_day =
           (SELECT op_day FROM ev GROUP BY op_day ORDER BY count(*) DESC, op_day LIMIT 1)""",
    ),
    "p9_data_date": ("data_date", "SELECT strftime(min(ts), '%Y-%m-%d') AS data_date FROM events"),
    "p10_storage_parts": ("op_day task_code aisle bay level", "SELECT * FROM storage"),
    "p12_stage_unpivot": (
        "stage stage_label stage_ord:i n:i total_s:d",
        """SELECT stage, stage_label, stage_ord, count(seconds) AS n, sum(seconds) AS total_s
           FROM stage GROUP BY ALL""",
    ),
    "w1_pick_pairs": (
        "op_day robot_id start_ts end_ts seconds:d location_code", "SELECT * FROM pick_all"
    ),
    "w1_clustered_pairs": (
        "op_day robot_id start_ts end_ts seconds:d location_code", "SELECT * FROM pick_all"
    ),
    "w3_clustered_pairs": (
        "op_day robot_id start_ts end_ts seconds:d robot_type",
        """SELECT *, date_diff('microsecond', start_ts, end_ts) / 1e6 AS seconds FROM dwell_all""",
    ),
    "w2_switch_pairs": (
        "op_day location_code start_ts end_ts seconds:d", "SELECT * FROM switch_all"
    ),
    "w3_dwell_pairs": (
        "op_day robot_id start_ts end_ts seconds:d robot_type",
        """SELECT *, date_diff('microsecond', start_ts, end_ts) / 1e6 AS seconds FROM dwell_all""",
    ),
    "j5_overlap_all_days": (
        "station row_id depth:i",
        """SELECT a.dest_loc AS station, a.row_id, count(*) AS depth
           FROM lifecycle a JOIN lifecycle b ON a.dest_loc = b.dest_loc
            AND b.completed_ts <= a.completed_ts + INTERVAL 1 HOUR
            AND b.completed_ts + INTERVAL 1 HOUR >= a.completed_ts
           GROUP BY ALL""",
    ),
    "q01_throughput_station_hour": (f"{CELL} completions:i", "SELECT * FROM station_hour"),
    "r1_results_in_sql": (
        f"{CELL} completions:i mean_s:d",
        """SELECT h.*, mean_s FROM station_hour h LEFT JOIN pick_cells USING (op_day, station, hour)
           WHERE op_day = (SELECT min(op_day) FROM ev)""",
    ),
    "q02_total_hour": (
        "op_day hour completions:i is_peak peak:i avg_nonzero:d design_total:i",
        """SELECT *, row_number() OVER (PARTITION BY op_day ORDER BY completions DESC, hour) = 1
                  AS is_peak, max(completions) OVER (PARTITION BY op_day) AS peak,
                  avg(nullif(completions, 0)) OVER (PARTITION BY op_day) AS avg_nonzero,
                  (SELECT sum(design_rate) FROM rated_dim) AS design_total
           FROM (SELECT op_day, hour, sum(completions) AS completions FROM station_hour GROUP BY ALL)""",
    ),
    "q03_occupied_seconds": (
        f"{CELL} occupied_s:d",
        "SELECT op_day, station, hour, least(sum(slice_s), 3600) AS occupied_s FROM switch_slices"
        " GROUP BY ALL",
    ),
    "q04_active_time": (f"{CELL} active_pct:d", "SELECT * FROM detail"),
    "q05_effective_tasks": (
        f"{CELL} completions:i effective_tasks:d", "SELECT *, eff AS effective_tasks FROM detail"
    ),
    "q06_implied_capacity": (f"{CELL} capacity_tph:d", "SELECT *, cap AS capacity_tph FROM detail"),
    "q07_implied_share": (f"{CELL} implied_pct:d", "SELECT * FROM detail"),
    "q08_picker_rate": (
        "op_day station minute rate_tph:d",
        """SELECT op_day, station, minute, CASE WHEN row_number() OVER w >= 10 THEN
                  sum(n) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * 6 END AS rate_tph
           FROM (SELECT s.op_day, s.station, m.minute, coalesce(c.n, 0) AS n
                 FROM (SELECT DISTINCT op_day, station FROM done_cells) s,
                      unnest(generate_series(CAST(s.op_day AS TIMESTAMP),
                          CAST(s.op_day AS TIMESTAMP) + INTERVAL 1439 MINUTE,
                          INTERVAL 1 MINUTE)) m(minute)
                 LEFT JOIN (SELECT op_day, station, date_trunc('minute', ts) AS minute, count(*) AS n
                            FROM delivery WHERE event_type = 'triggerGo' GROUP BY ALL) c
                   ON c.op_day = s.op_day AND c.station = s.station AND c.minute = m.minute)
           WINDOW w AS (PARTITION BY op_day, station ORDER BY minute)""",
    ),
    "q09_design_utilisation": (
        f"{CELL} completions:i design_rate:i utilisation_pct:d",
        """SELECT h.*, design_rate, CASE WHEN completions > 0 THEN
                  completions / design_rate * 100.0::DOUBLE END AS utilisation_pct
           FROM station_hour h LEFT JOIN rated_dim USING (station)""",
    ),
    "q10_target_share": (
        f"{CELL} design_rate:i target_pct:d",
        """SELECT s.*, design_rate, CASE WHEN design_rate > 0 THEN shown / design_rate * 100 END
                  AS target_pct FROM shown s LEFT JOIN rated_dim USING (station)""",
    ),
    "q11_cell_summary": (
        "op_day mean_tasks:d median_tasks:d mean_implied_pct:d median_implied_pct:d",
        """SELECT op_day, coalesce(avg(shown), 0) AS mean_tasks,
                  coalesce(median(shown), 0) AS median_tasks,
                  coalesce(avg(implied_pct), 0) AS mean_implied_pct,
                  coalesce(median(implied_pct), 0) AS median_implied_pct
           FROM shown GROUP BY op_day""",
    ),
    "q12_pick_intervals": (
        "op_day robot_id station hour arrived_ts trigger_ts pick_s:d",
        "SELECT *, start_ts AS arrived_ts, end_ts AS trigger_ts, seconds AS pick_s FROM picks",
    ),
    "q13_pick_station_hour": (
        f"{CELL} slices:i mean_s:d median_s:d implied_tph:d",
        """SELECT *, CASE WHEN mean_s > 0 THEN 3600 / (mean_s + 6) END AS implied_tph
           FROM pick_cells""",
    ),
    "q14_weighted_pick": (
        f"{CELL} weighted_pick_s:d implied_tph:d",
        "SELECT *, 3600 / (weighted_pick_s + 6) AS implied_tph FROM weighted_cells",
    ),
    "q15_scale_anchors": (
        "op_day pick_p95_s:d rate_p5:d rate_p95:d",
        """SELECT op_day, quantile_cont(median_s, 0.95) AS pick_p95_s,
                  quantile_cont(3600 / (weighted_pick_s + 6), 0.05) AS rate_p5,
                  quantile_cont(3600 / (weighted_pick_s + 6), 0.95) AS rate_p95
           FROM pick_cells LEFT JOIN weighted_cells USING (op_day, station, hour) GROUP BY op_day""",
    ),
    "q16_pick_density": (
        "station bin:i center_s:d density:d smooth_density:d",
        """WITH x AS (SELECT least(quantile_cont(value, 0.99), 180) AS x_max FROM ev),
           v AS (SELECT 'LABOR-' || (k % 6 + 1) AS station, value,
                        CAST(ceil(x_max / 2) AS INT) AS bins FROM ev, x WHERE value <= x_max),
           n AS (SELECT station, count(*) AS total FROM v GROUP BY station HAVING count(*) >= 10),
           h AS (SELECT n.station, b.bin,
                        (SELECT count(*) FROM v WHERE v.station = n.station
                           AND least(CAST(floor(value / 2) AS INT), bins - 1) = b.bin)
                        / (n.total * 2.0::DOUBLE) AS density
                 FROM n, range((SELECT max(bins) FROM v)) b(bin)),
           w AS (SELECT o.off, exp(-0.5 * (o.off / 2.5) ** 2) AS g FROM range(-10, 11) o(off))
           SELECT a.station, a.bin, a.bin * 2 + 1 AS center_s, any_value(a.density) AS density,
                  sum(b.density * w.g) / (SELECT sum(g) FROM w) AS smooth_density
           FROM h a JOIN h b ON a.station = b.station JOIN w ON b.bin - a.bin = w.off
           GROUP BY a.station, a.bin""",
    ),
    "q16_pick_density_day": (
        "op_day station bin:i center_s:d density:d smooth_density:d",
        """WITH x AS (SELECT op_day, least(quantile_cont(seconds, 0.99), 180) AS x_max FROM picks
                      GROUP BY op_day),
           v AS (SELECT op_day, station, seconds, CAST(ceil(x_max / 2) AS INT) AS bins
                 FROM picks JOIN x USING (op_day) WHERE seconds <= x_max AND x_max > 0),
           n AS (SELECT op_day, station, max(bins) AS bins, count(*) AS total FROM v GROUP BY ALL
                 HAVING count(*) >= 10),
           c AS (SELECT op_day, station, least(CAST(floor(seconds / 2) AS INT), bins - 1) AS bin,
                        count(*) AS n FROM v GROUP BY ALL),
           h AS (SELECT n.op_day, n.station, b.bin, coalesce(c.n, 0) / (n.total * 2.0::DOUBLE) AS density
                 FROM n, unnest(range(n.bins)) b(bin)
                 LEFT JOIN c ON c.op_day = n.op_day AND c.station = n.station AND c.bin = b.bin),
           w AS (SELECT o.off, exp(-0.5 * (o.off / 2.5) ** 2) AS g FROM range(-10, 11) o(off))
           SELECT a.op_day, a.station, a.bin, a.bin * 2 + 1 AS center_s,
                  any_value(a.density) AS density,
                  sum(b.density * w.g) / (SELECT sum(g) FROM w) AS smooth_density
           FROM h a JOIN h b ON a.op_day = b.op_day AND a.station = b.station
           JOIN w ON b.bin - a.bin = w.off GROUP BY a.op_day, a.station, a.bin""",
    ),
    "q17_pick_averages": (
        "station picks:i mean_s:d median_s:d",
        """SELECT 'LABOR-' || (k % 6 + 1) AS station, count(*) AS picks, avg(value) AS mean_s,
                  median(value) AS median_s
           FROM ev WHERE value <= (SELECT least(quantile_cont(value, 0.99), 180) FROM ev)
           GROUP BY 1 HAVING count(*) >= 10""",
    ),
    "q18_occupancy": (
        f"{CELL} pick_s:d switch_s:d pick_pct:d station_pct:d",
        """SELECT *, pick_s / 3600 * 100 AS pick_pct,
                  least(pick_s + switch_s, 3600) / 3600 * 100 AS station_pct FROM occupancy""",
    ),
    "q18_occupancy_summary": (
        "op_day mean_pick_pct:d median_pick_pct:d mean_station_pct:d median_station_pct:d",
        """SELECT op_day, avg(p) AS mean_pick_pct, median(p) AS median_pick_pct,
                  avg(s) AS mean_station_pct, median(s) AS median_station_pct
           FROM (SELECT op_day, pick_s / 3600 * 100 AS p,
                        least(pick_s + switch_s, 3600) / 3600 * 100 AS s FROM occupancy)
           GROUP BY op_day""",
    ),
    "q19_pick_vs_throughput": (
        f"{CELL} completions:i pick_s:d inlier used ceiling_tph:d",
        "SELECT *, 3600 / (pick_s + 6) AS ceiling_tph FROM scatter",
    ),
    "q19_pick_vs_throughput_fit": (
        "op_day slope:d intercept:d r2:d used:i removed:i",
        """SELECT op_day, regr_slope(completions, pick_s) FILTER (WHERE used) AS slope,
                  regr_intercept(completions, pick_s) FILTER (WHERE used) AS intercept,
                  CASE WHEN var_pop(completions) FILTER (WHERE used) > 0
                        AND var_pop(pick_s) FILTER (WHERE used) > 0
                       THEN regr_r2(completions, pick_s) FILTER (WHERE used) END AS r2,
                  count(*) FILTER (WHERE used) AS used, count(*) FILTER (WHERE NOT used) AS removed
           FROM scatter GROUP BY op_day""",
    ),
    "q20_switch_intervals": (
        f"{CELL} release_ts arrived_ts switch_s:d",
        "SELECT *, start_ts AS release_ts, end_ts AS arrived_ts, seconds AS switch_s FROM switches",
    ),
    "q21_switch_station_hour": (
        f"{CELL} switches:i mean_s:d median_s:d",
        """SELECT g.op_day, g.station, g.hour, mean_s, median_s, coalesce(switches, 0) AS switches
           FROM full_grid g LEFT JOIN switch_cells USING (op_day, station, hour)
           WHERE g.op_day IN (SELECT op_day FROM switches)""",
    ),
    "q22_switch_fleet": (
        "op_day mean_s:d median_s:d",
        "SELECT op_day, avg(seconds) AS mean_s, median(seconds) AS median_s FROM switches GROUP BY op_day",
    ),
    "q22_switch_anchor": (
        "op_day p95_s:d",
        """SELECT op_day, quantile_cont(v, 0.95) AS p95_s FROM (
           SELECT op_day, median_s AS v FROM switch_cells
           UNION ALL SELECT op_day, mean_s FROM switch_cells) GROUP BY op_day""",
    ),
    "q23_cycle_rows": (
        "op_day task_code dest_loc total_s:d cycle_min:d hour", "SELECT * FROM cycle"
    ),
    "q24_cycle_histogram": (
        "op_day bin:i tasks:i from_min:d",
        """SELECT d.op_day, b.bin, b.bin * 0.5 AS from_min, count(c.op_day) AS tasks
           FROM (SELECT DISTINCT op_day FROM cycle) d, unnest(range(60)) b(bin)
           LEFT JOIN cycle c ON c.op_day = d.op_day
                AND least(CAST(floor(cycle_min * 2) AS INT), 59) = b.bin
           GROUP BY d.op_day, b.bin""",
    ),
    "q24_cycle_summary": (
        "op_day tasks:i median_min:d p90_min:d p99_min:d pct_beyond_cap:d",
        """SELECT op_day, count(*) AS tasks, median(cycle_min) AS median_min,
                  quantile_cont(cycle_min, 0.9) AS p90_min, quantile_cont(cycle_min, 0.99) AS p99_min,
                  avg(CASE WHEN cycle_min > 30 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS pct_beyond_cap
           FROM cycle GROUP BY op_day""",
    ),
    "q25_cycle_by_hour": (
        "op_day hour median_min:d p90_min:d is_peak",
        """SELECT *, row_number() OVER (PARTITION BY op_day ORDER BY median_min DESC, hour) = 1 AS is_peak
           FROM (SELECT op_day, hour, median(cycle_min) AS median_min,
                        quantile_cont(cycle_min, 0.9) AS p90_min FROM cycle GROUP BY ALL)""",
    ),
    "q26_demand_vs_cycle": ("op_day hour demand:i cycle_min:d", "SELECT * FROM demand_cycle"),
    "q26_demand_vs_cycle_fit": (
        "op_day hours:i pearson_r:d spearman_rho:d slope:d intercept:d",
        """SELECT op_day, count(*) AS hours,
                  CASE WHEN var_pop(demand) > 0 AND var_pop(cycle_min) > 0
                       THEN corr(demand, cycle_min) END AS pearson_r,
                  CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS spearman_rho,
                  regr_slope(cycle_min, demand) AS slope,
                  regr_intercept(cycle_min, demand) AS intercept
           FROM demand_ranks GROUP BY op_day""",
    ),
    "q27_stage_shares": (
        "op_day stage stage_label stage_ord:i median_s:d share:d total_median_s:d",
        """SELECT m.*, median_s / nullif(sum(median_s) OVER (PARTITION BY m.op_day), 0) AS share,
                  total_median_s
           FROM (SELECT op_day, stage, stage_label, stage_ord,
                        coalesce(median(seconds) FILTER (WHERE seconds >= 0 AND seconds < 3600), 0)
                            AS median_s FROM stage GROUP BY ALL) m
           LEFT JOIN (SELECT op_day, median(total_s) AS total_median_s FROM cycle GROUP BY ALL) c
             ON c.op_day = m.op_day""",
    ),
    "q28_stage_by_station": (
        "op_day station stage stage_label stage_ord:i median_s:d height_s:d base_s:d",
        """SELECT *, coalesce(sum(height_s) OVER (PARTITION BY op_day, station ORDER BY stage_ord
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_s
           FROM (SELECT d.op_day, d.station, s.stage, s.stage_label, s.stage_ord, m.median_s,
                        coalesce(m.median_s, 0) AS height_s
                 FROM day_stations d
                 JOIN (SELECT DISTINCT op_day, stage, stage_label, stage_ord FROM stage) s
                   ON s.op_day = d.op_day
                 LEFT JOIN (SELECT op_day, dest_loc, stage, median(seconds) AS median_s FROM stage
                            WHERE total_s < 7200 AND seconds < 3600 GROUP BY ALL) m
                   ON m.op_day = d.op_day AND m.dest_loc = d.station AND m.stage = s.stage)""",
    ),
    "q29_cycle_describe": (
        "op_day tasks:i mean_min:d std_min:d min_min:d p50_min:d p75_min:d p90_min:d p95_min:d"
        " p99_min:d max_min:d",
        """SELECT op_day, count(*) AS tasks, avg(cycle_min) AS mean_min,
                  stddev_samp(cycle_min) AS std_min, min(cycle_min) AS min_min,
                  median(cycle_min) AS p50_min, quantile_cont(cycle_min, 0.75) AS p75_min,
                  quantile_cont(cycle_min, 0.9) AS p90_min, quantile_cont(cycle_min, 0.95) AS p95_min,
                  quantile_cont(cycle_min, 0.99) AS p99_min, max(cycle_min) AS max_min
           FROM cycle GROUP BY op_day""",
    ),
    "q30_aisle_demand": (
        "op_day aisle retrievals:i mean_retrievals:d level",
        """SELECT *, CASE WHEN retrievals > 1.5 * mean_retrievals THEN 'hot'
                       WHEN retrievals > mean_retrievals THEN 'above mean' ELSE 'normal' END AS level
           FROM (SELECT *, avg(retrievals) OVER (PARTITION BY op_day) AS mean_retrievals
                 FROM (SELECT op_day, aisle, count(*) AS retrievals FROM storage GROUP BY ALL))""",
    ),
    "q30_aisle_demand_wide": (
        "aisle retrievals:i mean_retrievals:d level",
        """SELECT *, CASE WHEN retrievals > 1.5 * mean_retrievals THEN 'hot'
                       WHEN retrievals > mean_retrievals THEN 'above mean' ELSE 'normal' END AS level
           FROM (SELECT *, avg(retrievals) OVER () AS mean_retrievals
                 FROM (SELECT aisle, count(*) AS retrievals FROM wide GROUP BY ALL))""",
    ),
    "q31_bay_demand": (
        "op_day aisle:i bay:i retrievals:i p97:d",
        """SELECT op_day, aisle, bay, retrievals, p97 FROM (
               SELECT op_day, aisle, bay, count(*) AS retrievals FROM storage GROUP BY ALL)
           JOIN (SELECT op_day, quantile_cont(n::DOUBLE, 0.97) AS p97 FROM (
               SELECT op_day, count(*) AS n FROM storage GROUP BY op_day, aisle, bay)
               GROUP BY op_day) USING (op_day)""",
    ),
    "q31_bay_demand_wide": (
        "aisle:i bay:i retrievals:i p97:d",
        """SELECT *, (SELECT quantile_cont(n::DOUBLE, 0.97) FROM (
               SELECT count(*) AS n FROM wide GROUP BY aisle, bay)) AS p97
           FROM (SELECT aisle, bay, count(*) AS retrievals FROM wide GROUP BY ALL)""",
    ),
    "q32_ranked_totes": ("op_day container_id retrievals:i", "SELECT * FROM day_totes"),
    "q32_ranked_totes_wide": ("container_id retrievals:i", "SELECT * FROM wide_totes"),
    "q32_tote_totals": (
        "totes:i retrievals:i",
        "SELECT count(*) AS totes, sum(retrievals) AS retrievals FROM wide_totes",
    ),
    "q33_cohort_volume": (
        "op_day cohort:i volume:i",
        """SELECT d.op_day, c.cohort, coalesce(sum(retrievals), 0) AS volume
           FROM (SELECT DISTINCT op_day FROM day_totes) d, unnest(range(1, 22)) c(cohort)
           LEFT JOIN day_totes t ON t.op_day = d.op_day AND least(t.retrievals, 21) = c.cohort
           GROUP BY ALL""",
    ),
    "q33_cohort_volume_wide": (
        "cohort:i volume:i",
        """SELECT c.cohort, coalesce(sum(retrievals), 0) AS volume FROM range(1, 22) c(cohort)
           LEFT JOIN wide_totes t ON least(t.retrievals, 21) = c.cohort GROUP BY ALL""",
    ),
    "q34_pareto_curve": (
        "rank:i retrievals:i totes_pct:d cum_pct:d",
        """SELECT row_number() OVER w AS rank, retrievals,
                  row_number() OVER w / (count(*) OVER ()) * 100.0::DOUBLE AS totes_pct,
                  sum(retrievals) OVER w / (sum(retrievals) OVER ()) * 100.0::DOUBLE AS cum_pct
           FROM wide_totes WINDOW w AS (ORDER BY retrievals DESC, container_id ROWS UNBOUNDED PRECEDING)
           """,
    ),
    "q34_pareto_marks": (
        "mark_pct:i cum_pct:d",
        """SELECT m.p AS mark_pct, c.cum_pct FROM (VALUES (5), (20)) m(p) JOIN (
               SELECT row_number() OVER w AS rank, count(*) OVER () AS n,
                      sum(retrievals) OVER w / (sum(retrievals) OVER ()) * 100.0::DOUBLE AS cum_pct
               FROM wide_totes
               WINDOW w AS (ORDER BY retrievals DESC, container_id ROWS UNBOUNDED PRECEDING)) c
           ON c.rank = greatest(1, floor(c.n * m.p / 100))""",
    ),
    "q34_pareto_marks_day": (
        "op_day mark_pct:i cum_pct:d",
        """SELECT op_day, m.p AS mark_pct, c.cum_pct FROM (VALUES (5), (20)) m(p) JOIN (
               SELECT op_day, row_number() OVER w AS rank,
                      count(*) OVER (PARTITION BY op_day) AS n,
                      sum(retrievals) OVER w / (sum(retrievals) OVER (PARTITION BY op_day))
                          * 100.0::DOUBLE AS cum_pct
               FROM day_totes WINDOW w AS (PARTITION BY op_day
                   ORDER BY retrievals DESC, container_id ROWS UNBOUNDED PRECEDING)) c
           ON c.rank = greatest(1, floor(c.n * m.p / 100))""",
    ),
    "q35_queue_depth": ("op_day station row_id leg_s:d depth:i", "SELECT * FROM depths"),
    "q36_leg_by_depth": (
        "op_day bin:i label deliveries:i median_leg_s:d",
        """SELECT op_day, bin, label, count(*) AS deliveries, median(leg_s) AS median_leg_s
           FROM binned GROUP BY ALL""",
    ),
    "q37_depth_box": (
        "op_day station low:d q1:d median:d q3:d high:d", "SELECT *, med AS median FROM boxes"
    ),
    "q37_depth_summary": (
        "op_day pearson_r:d median_low:i median_high:i median_mid:i",
        """SELECT *, (median_low + median_high) // 2 AS median_mid
           FROM (SELECT op_day, CASE WHEN var_pop(depth) > 0 AND var_pop(leg_s) > 0
                        THEN corr(depth, leg_s) END AS pearson_r FROM depths GROUP BY op_day)
           JOIN (SELECT op_day, CAST(trunc(min(med)) AS BIGINT) AS median_low,
                        CAST(trunc(max(med)) AS BIGINT) AS median_high FROM boxes GROUP BY op_day)
             USING (op_day)""",
    ),
    "q38_task_intervals": (
        "op_day fleet start_ts end_ts source", "SELECT *, 'lifecycle' AS source FROM tasks"
    ),
    "q38_station_intervals": (
        "op_day fleet start_ts end_ts",
        """WITH d AS (SELECT op_day, CASE WHEN robot_type = 'K50' THEN 'delivery' ELSE 'shuttle' END
                          AS fleet, start_ts, end_ts FROM dwell_all)
           SELECT * FROM d
           UNION ALL
           SELECT op_day, fleet, min(ts), max(ts) FROM (
               SELECT *, CASE WHEN robot_type = 'K50' THEN 'delivery' ELSE 'shuttle' END AS fleet
               FROM station_event)
           WHERE (op_day, fleet) NOT IN (SELECT (op_day, fleet) FROM d)
           GROUP BY op_day, fleet, robot_id""",
    ),
    "q39_fleet_timeline": (
        "op_day fleet mid_ts on_task:i fleet_size:i utilisation_pct:d",
        "SELECT *, on_task / fleet_size * 100.0::DOUBLE AS utilisation_pct FROM timeline",
    ),
    "q40_fleet_summary": (
        "op_day fleet mean_pct:d median_pct:d peak_pct:d",
        """SELECT op_day, fleet, coalesce(avg(p) FILTER (WHERE p > 0), 0) AS mean_pct,
                  coalesce(median(p) FILTER (WHERE p > 0), 0) AS median_pct, max(p) AS peak_pct
           FROM (SELECT *, on_task / fleet_size * 100.0::DOUBLE AS p FROM timeline) GROUP BY ALL""",
    ),
    "q41_active_robots": (
        "op_day robot_type hour active_robots:i fleet_size:i utilisation_pct:d",
        """SELECT *, active_robots / fleet_size * 100.0::DOUBLE AS utilisation_pct
           FROM (SELECT op_day, robot_type, date_trunc('hour', ts) AS hour,
                        count(DISTINCT robot_id) AS active_robots FROM station_event GROUP BY ALL)
           JOIN (SELECT op_day, robot_type, count(DISTINCT robot_id) AS fleet_size
                 FROM station_event GROUP BY ALL) USING (op_day, robot_type)""",
    ),
    "q42_leg_describe": (
        "op_day station deliveries:i mean_s:d std_s:d min_s:d p25_s:d p50_s:d p75_s:d p90_s:d max_s:d",
        """SELECT d.op_day, d.station, nullif(count(leg_s), 0) AS deliveries, avg(leg_s) AS mean_s,
                  stddev_samp(leg_s) AS std_s, min(leg_s) AS min_s,
                  quantile_cont(leg_s, 0.25) AS p25_s, median(leg_s) AS p50_s,
                  quantile_cont(leg_s, 0.75) AS p75_s, quantile_cont(leg_s, 0.9) AS p90_s,
                  max(leg_s) AS max_s
           FROM day_stations d LEFT JOIN legs USING (op_day, station) GROUP BY d.op_day, d.station""",
    ),
    "q42_leg_rows": ("op_day row_id station leg_s:d completed_ts", "SELECT * FROM legs"),
    "q43_daily_stats": (
        "op_day total_tasks:i median_cycle_min:d p90_cycle_min:d mean_pick_s:d median_switch_s:d",
        "SELECT * FROM daily",
    ),
    "q44_pick_by_station": (
        "op_day station mean_pick_s:d",
        "SELECT op_day, station, avg(seconds) AS mean_pick_s FROM picks_all GROUP BY ALL",
    ),
    "q45_implied_by_station": ("op_day station implied_pct:d", "SELECT * FROM hourly_use"),
    "q45_implied_by_day": (
        "op_day implied_pct:d",
        "SELECT op_day, avg(implied_pct) AS implied_pct FROM hourly_use GROUP BY op_day",
    ),
    "q46_headline_trend": (
        "op_day total_tasks:i median_cycle_min:d",
        "SELECT * FROM daily WHERE (SELECT count(*) FROM daily) >= 2",
    ),
    "q47_day_changes": (
        "metric previous_day op_day change_pct:d improvement_pct:d scale_pct:d",
        """WITH l AS (
               SELECT op_day, 'total_tasks' AS metric, total_tasks::DOUBLE AS v FROM daily
               UNION ALL SELECT op_day, 'median_cycle_min', median_cycle_min FROM daily
               UNION ALL SELECT op_day, 'p90_cycle_min', p90_cycle_min FROM daily
               UNION ALL SELECT op_day, 'mean_pick_s', mean_pick_s FROM daily
               UNION ALL SELECT op_day, 'median_switch_s', median_switch_s FROM daily),
           c AS (SELECT metric, lag(op_day) OVER w AS previous_day, op_day,
                        (v - lag(v) OVER w) / nullif(abs(lag(v) OVER w), 0) * 100 AS change_pct
                 FROM l WINDOW w AS (PARTITION BY metric ORDER BY op_day))
           SELECT metric, previous_day, op_day, change_pct,
                  CASE WHEN metric = 'total_tasks' THEN change_pct ELSE -change_pct END
                      AS improvement_pct,
                  (SELECT CASE WHEN max(abs(change_pct)) IS NULL THEN 20
                               ELSE greatest(max(abs(change_pct)), 5) END FROM c) AS scale_pct
           FROM c WHERE previous_day IS NOT NULL
             AND metric IN (SELECT metric FROM c WHERE change_pct IS NOT NULL)""",
    ),
    "q48_tail_severity": (
        "op_day tail_ratio:d level",
        """SELECT op_day, r AS tail_ratio, CASE WHEN r >= 2 THEN 'severe' WHEN r >= 1.5 THEN 'moderate'
                  WHEN r IS NOT NULL THEN 'normal' END AS level
           FROM (SELECT op_day, p90_cycle_min / nullif(median_cycle_min, 0) AS r FROM daily)""",
    ),
    "q49_hourly_consistency": (
        "op_day hours:i cv:d peak_to_mean:d",
        """SELECT op_day, count(*) AS hours,
                  CASE WHEN count(*) >= 2 THEN stddev_samp(demand) / avg(demand) END AS cv,
                  CASE WHEN count(*) >= 2 THEN max(demand) / avg(demand) END AS peak_to_mean
           FROM demand GROUP BY op_day""",
    ),
    "q50_overlay_stats": (
        "op_day tasks:i mean_min:d p25_min:d p50_min:d p75_min:d",
        """SELECT * FROM (
               SELECT op_day, count(*) AS tasks, avg(m) AS mean_min, quantile_cont(m, 0.25) AS p25_min,
                      median(m) AS p50_min, quantile_cont(m, 0.75) AS p75_min,
                      count(*) OVER () AS days
               FROM (SELECT op_day, total_s / 60.0::DOUBLE AS m FROM lifecycle WHERE total_s < 1800)
               GROUP BY op_day HAVING count(*) >= 10) WHERE days >= 2""",
    ),
    "q50_overlay_rows": (
        "op_day cycle_min:d",
        """WITH d AS (SELECT op_day FROM lifecycle WHERE total_s < 1800 GROUP BY op_day
                      HAVING count(*) >= 10)
           SELECT op_day, total_s / 60.0::DOUBLE AS cycle_min FROM lifecycle
           WHERE total_s < 1800 AND op_day IN (SELECT op_day FROM d)
             AND (SELECT count(*) FROM d) >= 2""",
    ),
    "q51_cycle_percentiles": (
        "op_day tasks:i mean_min:d p25_min:d p50_min:d p75_min:d p90_min:d p95_min:d p99_min:d",
        """SELECT op_day, count(*) AS tasks, avg(cycle_min) AS mean_min,
                  quantile_cont(cycle_min, 0.25) AS p25_min, median(cycle_min) AS p50_min,
                  quantile_cont(cycle_min, 0.75) AS p75_min, quantile_cont(cycle_min, 0.9) AS p90_min,
                  quantile_cont(cycle_min, 0.95) AS p95_min, quantile_cont(cycle_min, 0.99) AS p99_min
           FROM cycle GROUP BY op_day""",
    ),
    "q52_pick_fit_by_day": (
        "op_day n:i r2:d slope:d",
        """WITH x AS (SELECT op_day, station, hour, avg(seconds) AS p FROM picks GROUP BY ALL),
           y AS (SELECT op_day, location_type AS station, date_trunc('hour', ts) AS hour,
                        count(*)::DOUBLE AS n FROM callback
                 WHERE action = 'complete' AND location_type LIKE 'LABOR%' GROUP BY ALL)
           SELECT x.op_day, count(y.n) FILTER (WHERE p > 0) AS n,
                  CASE WHEN count(y.n) FILTER (WHERE p > 0) >= 3
                        AND var_pop(n) FILTER (WHERE p > 0) > 0
                        AND var_pop(p) FILTER (WHERE p > 0 AND n IS NOT NULL) > 0
                       THEN regr_r2(n, p) FILTER (WHERE p > 0) END AS r2,
                  CASE WHEN count(y.n) FILTER (WHERE p > 0) >= 3
                       THEN regr_slope(n, p) FILTER (WHERE p > 0) END AS slope
           FROM x LEFT JOIN y USING (op_day, station, hour) GROUP BY x.op_day""",
    ),
    "q53_throughput_matrix": (
        "op_day hour_label station completions:i",
        """SELECT op_day, hour_label, station, count(*) AS completions FROM matrix GROUP BY ALL
           UNION ALL SELECT op_day, hour_label, 'TOTAL', count(*) FROM matrix GROUP BY ALL
           UNION ALL SELECT op_day, 'TOTAL', station, count(*) FROM matrix GROUP BY ALL
           UNION ALL SELECT op_day, 'TOTAL', 'TOTAL', count(*) FROM matrix GROUP BY ALL""",
    ),
    "q54_completion_events": (
        "op_day ts hour_label station",
        """SELECT op_day, ts, strftime(ts, '%H:00') AS hour_label, station FROM delivery
           WHERE event_type = 'triggerGo' AND station IS NOT NULL""",
    ),
    "q55_pick_events": (
        "op_day robot_id station hour arrived_ts trigger_ts pick_s:d hour_label",
        """SELECT *, start_ts AS arrived_ts, end_ts AS trigger_ts, seconds AS pick_s,
                  strftime(hour, '%H:00') AS hour_label FROM picks_all""",
    ),
    "q56_switch_events": (
        f"{CELL} release_ts arrived_ts switch_s:d hour_label",
        """SELECT *, start_ts AS release_ts, end_ts AS arrived_ts, seconds AS switch_s,
                  strftime(hour, '%H:00') AS hour_label FROM switches""",
    ),
    "q57_utilisation_chain": (
        "op_day station hour_label avg_pick_s:d avg_switch_s:d completions:i implied_fixed_tph:d"
        " implied_actual_tph:d util_fixed_pct:d util_actual_pct:d",
        """SELECT op_day, station, hour_label, p AS avg_pick_s, s AS avg_switch_s, n AS completions,
                  3600 / (p + 6) AS implied_fixed_tph, 3600 / nullif(p + s, 0) AS implied_actual_tph,
                  n / (3600 / (p + 6)) * 100 AS util_fixed_pct,
                  n / (3600 / nullif(p + s, 0)) * 100 AS util_actual_pct
           FROM chain""",
    ),
    "q58_pick_matrix": (
        f"{CELL} avg_pick_s:d picks:i",
        """SELECT g.op_day, g.station, g.hour, avg(seconds) AS avg_pick_s, count(seconds) AS picks
           FROM full_grid g LEFT JOIN picks_all USING (op_day, station, hour)
           WHERE g.op_day IN (SELECT op_day FROM picks_all) GROUP BY ALL""",
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(columns, body) for name, (columns, body) in SQL.items()}
