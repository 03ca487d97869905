"""DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

from gridlore.operators.case_search import EVENT_TYPE, FIELDS
from gridlore.operators.rules import BAD_MODES, BAD_STATUSES, RULES
from gridlore.plans.queries import RULE_QUERIES
from gridlore.schemas import EMS_MODES
from gridlore.sources.energy_csv import FALSE, MISSING, TRUE


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


ENERGY = """
e AS (
  SELECT event_id AS id, ts AS "timestamp", user_id % 5 + 1 AS dataset_id, 'site_' || CAST(user_id % 3 AS VARCHAR) AS site_id,
    value AS pv_forecast_kw, value * (CAST(5 + event_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE)) AS pv_actual_kw,
    CAST(40 + event_id % 61 AS DOUBLE) AS load_kw, CAST(70 AS DOUBLE) AS load_forecast_kw, CAST(event_id % 101 AS DOUBLE) AS battery_soc,
    CAST(event_id % 41 - 20 AS DOUBLE) AS battery_power_kw, CAST(20 + event_id % 25 AS DOUBLE) AS battery_temperature,
    CAST(2 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) * CAST(0.75 AS DOUBLE) AS electricity_price, CAST(100 AS DOUBLE) AS contract_capacity_kw,
    CAST(50 + (event_id * 7) % 60 AS DOUBLE) AS grid_import_kw, CASE WHEN event_id % 9 = 0 THEN value ELSE CAST(0 AS DOUBLE) END AS grid_export_kw,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'manual' ELSE 'auto' END AS ems_mode,
    CASE WHEN event_id % 50 = 0 THEN 'fault' ELSE 'normal' END AS equipment_status, CAST(70 + event_id % 31 AS DOUBLE) AS battery_soh,
    CAST(event_id % 997 AS INTEGER) AS battery_cycle_count,
    CASE WHEN event_id % 17 = 0 THEN 'critical' WHEN event_id % 7 = 0 THEN 'warning' ELSE 'normal' END AS battery_health_status,
    event_id % 2 = 0 AS battery_is_second_life, CAST(500 AS DOUBLE) AS battery_rated_capacity_kwh,
    CAST(500 - event_id % 100 AS DOUBLE) AS battery_available_capacity_kwh
  FROM events
)"""

_DEVIATION = "abs(pv_actual_kw - pv_forecast_kw) / greatest(pv_forecast_kw, CAST(1 AS DOUBLE))"
_SHOULD = "electricity_price >= 4.0 AND grid_import_kw >= CAST(0.9 AS DOUBLE) * contract_capacity_kw AND battery_soc > 30 AND battery_power_kw <= 0"
_WASTE = "grid_export_kw > 0 AND battery_soc < 90 AND battery_power_kw >= 0"
_STATUS = f"ems_mode IN {_in(BAD_MODES)} OR equipment_status IN {_in(BAD_STATUSES)}"
_LOAD = "(load_kw - load_forecast_kw) / greatest(load_forecast_kw, CAST(1 AS DOUBLE)) >= CAST(0.2 AS DOUBLE)"
_PEAK = "electricity_price >= 4.0 AND battery_power_kw < 0"
#: Rule: condition, severity.
CONDITIONS = {
    "PV_FORECAST_DEVIATION": (f"{_DEVIATION} >= CAST(0.2 AS DOUBLE)", f"CASE WHEN {_DEVIATION} >= CAST(0.4 AS DOUBLE) THEN 'critical' WHEN {_DEVIATION} >= CAST(0.2 AS DOUBLE) THEN 'warning' END"),
    "OVER_CONTRACT_RISK": ("grid_import_kw >= CAST(0.9 AS DOUBLE) * contract_capacity_kw", "CASE WHEN grid_import_kw >= contract_capacity_kw THEN 'critical' WHEN grid_import_kw >= CAST(0.9 AS DOUBLE) * contract_capacity_kw THEN 'warning' END"),
    "LOW_SOC_RISK": ("battery_soc < 20", "CASE WHEN battery_soc < 20 THEN 'critical' WHEN battery_soc < 30 THEN 'warning' END"),
    "BATTERY_HEALTH_RISK": (
        "battery_temperature >= 40 OR battery_soh < 80 OR battery_health_status IN ('warning', 'critical')",
        "CASE WHEN battery_temperature >= 40 OR battery_soh < 80 OR battery_health_status = 'critical' THEN 'critical' WHEN battery_temperature >= 35 OR battery_soh < 85 OR battery_health_status = 'warning' THEN 'warning' END",
    ),
    "PEAK_PERIOD_ABNORMAL_CHARGING": (_PEAK, f"CASE WHEN {_PEAK} THEN 'warning' END"),
    "BATTERY_SHOULD_DISCHARGE_BUT_DID_NOT": (_SHOULD, f"CASE WHEN {_SHOULD} THEN CASE WHEN grid_import_kw >= contract_capacity_kw THEN 'critical' ELSE 'warning' END END"),
    "GREEN_ENERGY_WASTE": (_WASTE, f"CASE WHEN {_WASTE} THEN 'warning' END"),
    "EMS_OR_EQUIPMENT_STATUS_WARNING": (_STATUS, f"CASE WHEN {_STATUS} THEN 'warning' END"),
    "ABNORMAL_LOAD_INCREASE": (_LOAD, f"CASE WHEN {_LOAD} THEN 'warning' END"),
}


def _holds(name: str) -> str:
    return f"coalesce({CONDITIONS[name][0]}, false)"


def _rule(name: str) -> str:
    condition, severity = CONDITIONS[name]
    return f"""WITH {ENERGY} SELECT id, dataset_id, site_id, "timestamp", coalesce({condition}, false) AS flagged, {severity} AS severity, '{RULES[name].explanation}' AS explanation
      FROM e WHERE coalesce({condition}, false) OR {severity} IS NOT NULL"""


_UNSAFE = "(battery_temperature >= 40 OR battery_health_status = 'critical')"
_ACTION = f"""CASE WHEN battery_soc <= 20 OR {_UNSAFE} THEN 'idle'
  WHEN electricity_price >= 4.0 AND battery_soc > 30 AND grid_import_kw >= CAST(0.8 AS DOUBLE) * contract_capacity_kw THEN 'discharge'
  WHEN ((electricity_price <= 2.75 AND battery_soc < 80) OR (pv_actual_kw > load_kw AND battery_soc < 90)) AND NOT {_UNSAFE} THEN 'charge' ELSE 'none' END"""
_ACTED = f"{ENERGY}, a AS (SELECT *, {_ACTION} AS action, CAST(\"timestamp\" AS DATE) AS day FROM e)"
_INDEX = f"""SELECT site_id, day,
    25.0::DOUBLE * (1.0::DOUBLE - count(*) FILTER (WHERE ({CONDITIONS["PV_FORECAST_DEVIATION"][0]}) OR ({_WASTE}))::DOUBLE / count(*)::DOUBLE) AS pv,
    25.0::DOUBLE * (1.0::DOUBLE - count(*) FILTER (WHERE ({_PEAK}) OR ({_SHOULD}) OR ({_STATUS}))::DOUBLE / count(*)::DOUBLE) AS operation,
    20.0::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, sum(grid_import_kw) / sum(load_kw))) * (1.0::DOUBLE - count(*) FILTER (WHERE {CONDITIONS["OVER_CONTRACT_RISK"][0]})::DOUBLE / count(*)::DOUBLE) AS grid,
    20.0::DOUBLE * (1.0::DOUBLE - count(*) FILTER (WHERE ({CONDITIONS["BATTERY_HEALTH_RISK"][0]}) OR battery_soc < 20)::DOUBLE / count(*)::DOUBLE) AS health,
    10.0::DOUBLE * (count(*) FILTER (WHERE battery_is_second_life AND battery_health_status IN ('normal', 'warning') AND battery_temperature < 40)::DOUBLE / count(*)::DOUBLE) AS bonus
  FROM a GROUP BY site_id, day"""
_CATALOGUE = f"""WITH {ENERGY}, c AS (SELECT dataset_id AS id, 'dataset_' || CAST(dataset_id AS VARCHAR) AS name, 'dataset_' || CAST(dataset_id AS VARCHAR) || '.csv' AS file_name, 'from events' AS description,
    CAST(count(*) AS INTEGER) AS row_count, min("timestamp") AS start_time, max("timestamp") AS end_time, max("timestamp") AS created_at FROM e GROUP BY dataset_id) SELECT * FROM c"""
_SUMMARY = [
    "pv_forecast_kw", "pv_actual_kw", "load_kw", "load_forecast_kw", "battery_soc", "battery_power_kw", "battery_temperature", "electricity_price",
    "contract_capacity_kw", "grid_import_kw", "grid_export_kw", "battery_soh", "battery_cycle_count", "battery_rated_capacity_kwh", "battery_available_capacity_kwh",
]
_CHARTS = [
    ("pv", "pv_forecast_kw"), ("pv", "pv_actual_kw"), ("load_and_capacity", "load_kw"), ("load_and_capacity", "load_forecast_kw"), ("load_and_capacity", "contract_capacity_kw"),
    ("soc", "battery_soc"), ("battery_power", "battery_power_kw"), ("price", "electricity_price"),
]


_K = "json_extract_string(props, '$.k')"
_CELLS = f"""cells AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN ' ' || {_K} || ' ' WHEN 2 THEN event_type WHEN 3 THEN props ELSE 'N/A' END AS number,
   CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN ' ' || event_type || ' ' WHEN 2 THEN '' ELSE {_K} END AS mode,
   CASE WHEN CAST({_K} AS INTEGER) < 60 THEN CAST(CAST({_K} AS INTEGER) % 3 AS VARCHAR) WHEN event_id % 3 = 0 THEN 'YES' WHEN event_id % 3 = 1 THEN 'No' ELSE event_type END AS "boolean", value - 5 AS soc FROM events)"""
_PRESENT = f"NOT IN {_in(MISSING)}"
_SPACE = r"[\s\x0b\x{85}\p{Z}\x1c-\x1f]"
_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
_PAGES = """pages_ AS (SELECT doc_id, source AS source_filename, (CASE WHEN doc_id % 5 = 0 THEN '4.' || CAST(doc_id % 9 + 1 AS VARCHAR) || ' Heading' || chr(10) ELSE '' END) || coalesce(text, '')
   || (CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' || CAST(doc_id % 9999 AS VARCHAR) || ' ' || chr(10) ELSE '' END) AS text FROM documents)"""
_LINES = f"lines AS (SELECT doc_id, source_filename, list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}\\x1c-\\x1e]'), lambda x: {_TRIM('x')}) AS l FROM pages_)"
_NUMBER = r"^(\d{1,4}|[IVXLCDM]{1,7})$"
_HEADING = r"^([一二三四五六七八九十]+、\S|\d+(\.\d+){1,3}\s+\S)"
_TITLE = f"list_filter(l, lambda x: regexp_matches(x, '{_HEADING}'))[1]"
_WINDOWS = lambda s, o: f"""(SELECT doc_id, start, substring(whole, CAST(start + 1 AS BIGINT), {s}) AS t FROM (SELECT doc_id, whole, unnest(generate_series(0, greatest(0, length(whole) - {o} - 1), {s - o})) AS start
   FROM (SELECT doc_id, coalesce(text, '') || chr(10) AS whole FROM documents)))"""  # noqa: E731
_FILE_WINDOWS = lambda s, o: f"""p AS (SELECT source, doc_id AS p, coalesce(text, '') || chr(10) AS t, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 500 AS VARCHAR) END AS label, CASE WHEN doc_id % 4 = 0 THEN '4.' || CAST(doc_id % 9 AS VARCHAR) || ' Part' END AS title FROM documents),
  q AS (SELECT *, sum(length(t)) OVER (PARTITION BY source ORDER BY p) AS e, sum(length(t)) OVER (PARTITION BY source ORDER BY p) - length(t) AS b FROM p),
  w AS (SELECT source, string_agg(t, '' ORDER BY p) AS whole FROM p GROUP BY source),
  c AS (SELECT source, start, substring(whole, CAST(start + 1 AS BIGINT), {s}) AS t FROM (SELECT *, unnest(generate_series(0, greatest(0, length(whole) - {o} - 1), {s - o})) AS start FROM w)),
  k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start) - 1 AS n FROM c WHERE length({_TRIM('t')}) > 0),
  numbered AS (SELECT k.source, n, any_value(k.t) AS t, CAST(min(p) AS INTEGER) AS a, CAST(max(p) AS INTEGER) AS b, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE label IS NOT NULL))), ','), '') AS labels,
      CASE WHEN arg_min(coalesce(title, '-'), p) <> '-' THEN arg_min(coalesce(title, '-'), p) END AS title FROM k JOIN q ON k.source = q.source AND q.b < k.start + length(k.t) AND q.e > k.start GROUP BY k.source, n)"""  # noqa: E731
_CHUNKS = """chunks AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS chunk_id, vec_id, CAST(embedding AS DOUBLE[]) AS v, label, 'doc_' || CAST(vec_id % 4 AS VARCHAR) AS filename,
    CASE WHEN vec_id % 3 = 0 THEN 'table' ELSE 'prose' END AS chunk_type, vec_id % 28 + 1 AS day FROM embeddings WHERE vec_id % 10 <> 9),
  asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, label AS query_label, vec_id % 28 + 1 AS day, vec_id % 100 = 0 AS about_table FROM embeddings WHERE vec_id % 50 = 0),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS vector_rank FROM (
      SELECT query_id, query_label, label, chunk_id, CAST(1 AS DOUBLE) - list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) AS distance,
        chunks.day = asked.day AS date_match, about_table AND chunk_type = 'table' AS table_match FROM chunks CROSS JOIN asked {scope})) WHERE vector_rank <= 30),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vector_rank) AS hybrid_rank FROM (
      SELECT *, CAST(1 AS DOUBLE) * (CAST(1 AS DOUBLE) - distance) + CAST(0.5 AS DOUBLE) * CAST(date_match AS INTEGER) + CAST(0.2 AS DOUBLE) * CAST(table_match AS INTEGER) AS final_score FROM pool))"""
_ALL = "WITH " + _CHUNKS.replace("{scope}", "")
_OTHERS = "WITH " + _CHUNKS.replace("{scope}", "WHERE vec_id <> query_id")
_STORED = "stored AS (SELECT d.doc_id, source AS document_id, lang AS strategy_name, quality = 1 AS is_active FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
#: The dates that each question asks about, and whether it asks about a table, without a look at its text.
_ASKED_DATES = """d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS placed, CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INTEGER) AS later, o_totalprice > 100000 AS more FROM orders),
  e AS (SELECT o_orderkey, CAST(0 AS INTEGER) AS place, placed AS asked FROM d UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER), later FROM d WHERE more)"""


def oracle_sql() -> dict[str, str]:
    anomalies = " UNION ALL ".join(
        f"""SELECT id, dataset_id, site_id, "timestamp", '{n}' AS rule, {CONDITIONS[n][1]} AS severity, '{r.explanation}' AS explanation FROM e WHERE {_holds(n)}""" for n, r in RULES.items()
    )
    placed = 'p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", id) AS place FROM e)'
    periods = " UNION ALL ".join(
        f"""SELECT '{n}' AS rule, site_id, min("timestamp") AS start_time, max("timestamp") AS end_time, count(*) AS readings FROM (
          SELECT site_id, "timestamp", place - row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", id) AS period FROM p WHERE {_holds(n)}) GROUP BY site_id, period""" for n in RULES
    )
    critical = " + ".join(f"CAST(coalesce({CONDITIONS[n][1]} = 'critical', false) AND {_holds(n)} AS INTEGER)" for n in RULES)
    flagged = " + ".join(f"CAST({_holds(n)} AS INTEGER)" for n in RULES)
    found = {
        "dataset_list": _CATALOGUE,
        "dataset_by_id": _CATALOGUE + " WHERE id = 2",
        "dataset_count": f"WITH {ENERGY} SELECT count(*) AS total FROM e WHERE dataset_id = 2",
        "dataset_summary": f"WITH {ENERGY} " + " UNION ALL ".join(
            f"SELECT CAST(2 AS BIGINT) AS dataset_id, '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS low, round(avg({c}), 6) AS mean, CAST(max({c}) AS DOUBLE) AS high FROM e WHERE dataset_id = 2" for c in _SUMMARY
        ),
        "dataset_extent": f'WITH {ENERGY} SELECT CAST(2 AS BIGINT) AS dataset_id, count(*) AS row_count, count(DISTINCT site_id) AS site_count, min("timestamp") AS start_time, max("timestamp") AS end_time FROM e WHERE dataset_id = 2',
        "timeseries_page": f'WITH {ENERGY} SELECT id, dataset_id, site_id, "timestamp", load_kw, battery_soc, electricity_price FROM e WHERE dataset_id = 1 ORDER BY "timestamp" ASC NULLS LAST, id ASC LIMIT 50 OFFSET 20',
        "quality_range_check": f"WITH {_CELLS} SELECT event_id, soc, 'kept as-is' AS action FROM cells WHERE soc < 0 OR soc > 100",
        "quality_enum_check": f"WITH {_CELLS}, w AS (SELECT event_id, CASE WHEN mode {_PRESENT} THEN lower(trim(mode)) END AS w FROM cells) SELECT event_id, CASE WHEN w IS NOT NULL AND w NOT IN {_in(EMS_MODES)} THEN 'unknown' ELSE w END AS mode, coalesce(w NOT IN {_in(EMS_MODES)}, false) AS warned FROM w",
        "quality_bool_lexicon": f"WITH {_CELLS}, w AS (SELECT event_id, CASE WHEN \"boolean\" {_PRESENT} THEN lower(trim(\"boolean\")) END AS w FROM cells), v AS (SELECT event_id, w, CASE WHEN w IN {_in(TRUE)} THEN true WHEN w IN {_in(FALSE)} THEN false END AS value FROM w) SELECT event_id, value, w IS NOT NULL AND value IS NULL AS warned FROM v",
        "quality_numeric_coerce": f"WITH {_CELLS}, w AS (SELECT event_id, CASE WHEN number {_PRESENT} THEN trim(number) END AS w FROM cells), v AS (SELECT event_id, w, CASE WHEN isfinite(TRY_CAST(w AS DOUBLE)) THEN TRY_CAST(w AS DOUBLE) END AS value FROM w) SELECT event_id, value, w IS NOT NULL AND value IS NULL AS warned FROM v",
        "anomalies_all": f"WITH {ENERGY} {anomalies}",
        "anomalies_own_bands": f"WITH {ENERGY.replace('e AS (', 'r AS (', 1)}, b AS (SELECT dataset_id, quantile_cont(electricity_price, 0.75) AS price_high FROM r GROUP BY dataset_id), e AS (SELECT r.*, price_high FROM r JOIN b ON r.dataset_id = b.dataset_id) {anomalies.replace('electricity_price >= 4.0', 'electricity_price >= price_high')}",
        "anomaly_timeline": f"WITH {ENERGY}, {placed} {periods}",
        "schedule_suggestion": f"""WITH {_ACTED} SELECT id, dataset_id, site_id, "timestamp", action, CASE WHEN action = 'discharge' THEN CASE WHEN {_UNSAFE} OR battery_soh < 80 THEN 'not_aggressive' ELSE 'normal' END END AS mode,
            CASE action WHEN 'idle' THEN 'battery is low, hot or critical' WHEN 'discharge' THEN 'price and grid import are high and the battery is charged' WHEN 'charge' THEN 'price is low or solar output exceeds load' END AS reason,
            CASE action WHEN 'idle' THEN 'none' WHEN 'discharge' THEN 'battery wear' WHEN 'charge' THEN 'battery wear' END AS risk,
            round(CASE action WHEN 'discharge' THEN -abs(battery_power_kw) * electricity_price WHEN 'charge' THEN abs(battery_power_kw) * electricity_price ELSE CAST(0 AS DOUBLE) END, 6) + CAST(0 AS DOUBLE) AS cost_impact,
            round(CASE WHEN action = 'charge' AND pv_actual_kw > load_kw THEN pv_actual_kw - load_kw ELSE CAST(0 AS DOUBLE) END, 6) AS green_impact FROM a""",
        "schedule_windows": f"""WITH {_ACTED}, p AS (SELECT site_id, action, "timestamp", row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", id) - row_number() OVER (PARTITION BY site_id, action ORDER BY "timestamp", id) AS period FROM a)
            SELECT site_id, action, min("timestamp") AS start_time, max("timestamp") AS end_time, count(*) AS readings FROM p WHERE action <> 'none' GROUP BY site_id, action, period""",
        "cost_energy": f"WITH {_ACTED} SELECT site_id, day, round(sum(grid_import_kw * electricity_price), 4) AS energy_cost, count(*) AS readings FROM a GROUP BY site_id, day",
        "cost_arbitrage": f"""WITH {_ACTED} SELECT site_id, day, round(sum(CASE WHEN electricity_price >= 4.0 AND battery_power_kw > 0 THEN battery_power_kw * electricity_price ELSE CAST(0 AS DOUBLE) END), 4) AS discharge_saving,
            round(sum(CASE WHEN electricity_price <= 2.75 AND battery_power_kw < 0 THEN abs(battery_power_kw) * electricity_price ELSE CAST(0 AS DOUBLE) END), 4) AS charging_cost FROM a GROUP BY site_id, day""",
        "cost_before_after": f"""WITH {_ACTED}, s AS (SELECT site_id, day, sum(grid_import_kw * electricity_price) AS x, sum(greatest(grid_import_kw + CASE WHEN action = 'discharge' AND battery_power_kw < 0 THEN 2 * battery_power_kw WHEN action = 'charge' AND battery_power_kw > 0 THEN 2 * battery_power_kw WHEN action = 'idle' THEN battery_power_kw ELSE CAST(0 AS DOUBLE) END, CAST(0 AS DOUBLE)) * electricity_price) AS y FROM a GROUP BY site_id, day)
            SELECT site_id, day, round(x, 4) AS cost_before, round(y, 4) AS cost_after, round(x - y, 4) AS saving FROM s""",
        "green_index_site_day": f"""WITH {_ACTED}, i AS ({_INDEX}) SELECT site_id, day, round(pv, 4) AS pv_points, round(operation, 4) AS operation_points, round(grid, 4) AS grid_points, round(health, 4) AS health_points, round(bonus, 4) AS bonus_points,
            round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), pv + operation + grid + health + bonus)), 4) AS green_index FROM i""",
        "capacity_fade": f"WITH {ENERGY}, f AS (SELECT site_id, CAST(1 AS DOUBLE) - battery_available_capacity_kwh / battery_rated_capacity_kwh AS f FROM e) SELECT site_id, round(min(f), 6) AS fade_low, round(max(f), 6) AS fade_high FROM f GROUP BY site_id",
        "site_day_analysis": f"""WITH {_ACTED}, i AS ({_INDEX}), n AS (SELECT site_id, day, count(*) AS readings, CAST(sum({flagged}) AS BIGINT) AS anomalies, CAST(sum({critical}) AS BIGINT) AS critical_anomalies,
            count(*) FILTER (WHERE action = 'charge') AS charge_suggestions, count(*) FILTER (WHERE action = 'discharge') AS discharge_suggestions, count(*) FILTER (WHERE action = 'idle') AS idle_suggestions,
            round(sum(grid_import_kw * electricity_price), 4) AS energy_cost FROM a GROUP BY site_id, day)
            SELECT n.*, round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), pv + operation + grid + health + bonus)), 4) AS green_index FROM n JOIN i ON n.site_id = i.site_id AND n.day = i.day""",
        "price_bands": f"WITH {ENERGY} SELECT dataset_id, quantile_cont(electricity_price, 0.75) AS price_high, quantile_cont(electricity_price, 0.25) AS price_low FROM e GROUP BY dataset_id",
        "cycle_trend_7d": f"""WITH {ENERGY}, t AS (SELECT id, site_id, "timestamp", CAST(floor(epoch("timestamp")) AS BIGINT) AS s, battery_cycle_count AS c FROM e),
            w AS (SELECT id, site_id, "timestamp", min(c) OVER x AS cycles_low, max(c) OVER x AS cycles_high FROM t WINDOW x AS (PARTITION BY site_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW))
            SELECT *, cycles_high - cycles_low AS cycles_spread FROM w""",
        "load_peak_rank": f"""WITH {ENERGY}, r AS (SELECT site_id, CAST("timestamp" AS DATE) AS day, CAST(row_number() OVER (PARTITION BY site_id, CAST("timestamp" AS DATE) ORDER BY load_kw DESC NULLS LAST, id) AS INTEGER) AS peak_rank, id, load_kw FROM e) SELECT * FROM r WHERE peak_rank <= 5""",
        "chart_series_bounds": f"WITH {ENERGY} " + " UNION ALL ".join(
            f"SELECT '{s}' AS series, '{c}' AS \"column\", count(*) FILTER (WHERE isfinite({c})) > 0 AS available, min({c}) FILTER (WHERE isfinite({c})) AS low, max({c}) FILTER (WHERE isfinite({c})) AS high FROM e" for s, c in _CHARTS
        ),
        "stream_hourly_batch": f"""WITH {ENERGY} SELECT site_id, date_trunc('hour', "timestamp") AS hour, count(*) AS readings, round(avg(load_kw), 6) AS mean_load_kw, sum(grid_import_kw) AS import_kwh FROM e GROUP BY 1, 2""",
        "page_status": _STATUS_PAGES + " SELECT doc_id, char_count, coverage, page_status FROM c",
        "page_status_counts": _STATUS_PAGES + " SELECT page_status, count(*) AS pages FROM c GROUP BY page_status",
        "printed_label": f"WITH {_PAGES}, {_LINES}, f AS (SELECT doc_id, list_filter(l, lambda x: length(x) > 0) AS l FROM lines) SELECT doc_id, coalesce(CASE WHEN regexp_matches(l[-1], '{_NUMBER}') THEN l[-1] END, CASE WHEN regexp_matches(l[1], '{_NUMBER}') THEN l[1] END) AS printed_page_number FROM f",
        "section_heading": f"WITH {_PAGES}, {_LINES} SELECT doc_id, {_TITLE} AS section_title FROM lines",
        "section_carry_forward": f"WITH {_PAGES}, {_LINES}, t AS (SELECT source_filename, doc_id AS page_index, {_TITLE} AS section_title FROM lines) SELECT *, last_value(section_title IGNORE NULLS) OVER (PARTITION BY source_filename ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_title FROM t",
        "chunk_fixed_600_100": f"SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(length(t) AS INTEGER) AS char_count, sha256(t) AS text_hash FROM {_WINDOWS(600, 100)} WHERE length({_TRIM('t')}) > 0",
        "chunk_fixed_pages": f"""WITH {_FILE_WINDOWS(600, 100)} SELECT source || '::fixed_600_100::prose::' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS chunk_id, source AS source_filename, CAST(length(t) AS INTEGER) AS char_count,
            a AS page_index_start, b AS page_index_end, labels, title AS section_title, sha256(t) AS text_hash FROM numbered""",
        "chunk_stats_by_strategy": " UNION ALL ".join(
            f"SELECT * FROM (WITH {_FILE_WINDOWS(s, o)} SELECT 'fixed_{s}_{o}' AS strategy_name, count(*) AS chunks, count(*) AS prose_chunks, CAST(0 AS BIGINT) AS table_chunks, round(avg(length(t)), 1) AS mean_chars, CAST(max(length(t)) AS INTEGER) AS max_chars, CAST(0 AS BIGINT) AS failures FROM numbered)"
            for s, o in ((400, 80), (600, 100), (800, 120))
        ),
        "page_labels": """WITH p AS (SELECT source, doc_id AS p, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 500 AS VARCHAR) ELSE '-' END AS label FROM documents)
            SELECT CAST(r.p AS VARCHAR) AS chunk_id, string_agg(CAST(q.p + 1 AS VARCHAR) || '=' || q.label, ',' ORDER BY CAST(q.p + 1 AS VARCHAR) || '=' || q.label) AS labels
            FROM p r JOIN p q ON r.source = q.source AND q.p BETWEEN r.p AND r.p + r.p % 90 GROUP BY r.p""",
        "overlapping_orders": """WITH o AS (SELECT o_custkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 97 AS INTEGER) AS b FROM orders)
            SELECT x.o_custkey, count(*) AS pairs, min(x.k) AS first_order, max(y.k) AS last_order FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.k < y.k AND x.a <= y.b AND y.a <= x.b GROUP BY x.o_custkey""",
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "chunk_id": "SELECT doc_id, sha256(concat_ws(':', source, 'fixed_600_100', 'prose', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), sha256(text))) AS chunk_id FROM documents",
        "metadata_hash": """SELECT doc_id, sha256('{"printed_page_number_list": ["' || CAST(doc_id AS VARCHAR) || '"], "section_title": ' || coalesce('"' || lang || '"', 'null') || ', "table_title": null}') AS metadata_hash FROM documents""",
        "sentence_split": r"SELECT doc_id, CAST(length(regexp_replace(text, '[^。！？.!?]', '', 'g')) + CAST(NOT regexp_matches(text, '[。！？.!?]$') AND text <> '' AS INTEGER) AS INTEGER) AS sentences FROM documents",
        "upsert_plan": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'insert' WHEN doc_id % 2 = 0 THEN 'update_metadata' ELSE 'skip' END AS action FROM documents",
        "upsert_next_snapshot": """SELECT doc_id AS document_id, lang AS section_title, doc_id % 3 = 0 AND doc_id % 4 <> 0 AS is_active, CASE WHEN doc_id % 3 = 0 THEN 'before' ELSE 'hash-64' END AS embedding_model,
            CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 64 END AS dimensions, doc_id % 6 = 0 AS updated, doc_id % 3 <> 0 AS new FROM documents""",
        "duplicate_content": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "lifecycle_counts": f"WITH {_STORED} SELECT document_id, strategy_name, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE NOT is_active) AS inactive FROM stored GROUP BY 1, 2",
        "lifecycle_decision": f"WITH {_STORED} SELECT document_id, strategy_name, CASE WHEN count(*) FILTER (WHERE is_active) > 0 AND count(*) FILTER (WHERE NOT is_active) > 0 THEN 'anomaly' WHEN count(*) FILTER (WHERE is_active) > 0 THEN 'already_active' ELSE 'activate' END AS decision FROM stored GROUP BY 1, 2",
        "active_documents": "SELECT doc_id AS id, source AS filename FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "superseded_pairs": "SELECT a.doc_id AS id, a.source AS filename, max(b.doc_id) AS old_id, a.source AS old_filename FROM documents a JOIN documents b ON a.source = b.source AND a.text = b.text AND b.doc_id < a.doc_id GROUP BY a.doc_id, a.source",
        "vector_topk": _ALL + " SELECT query_id, CAST(vector_rank AS INTEGER) AS vector_rank, chunk_id, round(distance, 6) + CAST(0 AS DOUBLE) AS distance FROM pool WHERE vector_rank <= 5",
        "vector_topk_scoped": "WITH " + _CHUNKS.replace("{scope}", "WHERE filename = 'doc_1'") + " SELECT query_id, CAST(vector_rank AS INTEGER) AS vector_rank, chunk_id, round(distance, 6) + CAST(0 AS DOUBLE) AS distance FROM pool WHERE vector_rank <= 5",
        "search_in_both_scopes": "".join(
            ("" if k == 0 else " UNION ALL ") + "SELECT '" + scope + "' AS scope, query_id, CAST(vector_rank AS INTEGER) AS vector_rank, chunk_id, round(distance, 6) + CAST(0 AS DOUBLE) AS distance FROM (WITH " + _CHUNKS.replace("{scope}", where) + " SELECT * FROM pool WHERE vector_rank <= 5)"
            for k, (scope, where) in enumerate((("all_documents", ""), ("document_scoped", "WHERE filename = 'doc_' || CAST(query_id % 4 AS VARCHAR)")))
        ),
        "page_overlap_hit": _ALL + """ SELECT query_id, bool_or(coalesce(CAST(chunk_id AS BIGINT) % 30 <= page AND page <= CAST(chunk_id AS BIGINT) % 30 + 2, false)) AS hit
            FROM (SELECT *, CASE WHEN query_id % 100 = 0 THEN query_id % 30 END AS page FROM pool WHERE vector_rank <= 5) GROUP BY query_id""",
        "chunks_with_filenames": "SELECT vec_id AS chunk_id, vec_id % 700 AS document_id, source AS filename FROM embeddings JOIN documents ON doc_id = vec_id % 700",
        "hybrid_topk": _ALL + " SELECT query_id, CAST(hybrid_rank AS INTEGER) AS hybrid_rank, CAST(vector_rank AS INTEGER) AS vector_rank, chunk_id, date_match, table_match, round(final_score, 6) AS final_score FROM ranked WHERE hybrid_rank <= 5",
        "order_unchanged": _OTHERS + " SELECT query_id, bool_and(hybrid_rank = vector_rank) AS unchanged FROM ranked GROUP BY query_id",
        "wrong_group_rate": _OTHERS + " SELECT count(*) FILTER (WHERE label <> query_label) AS wrong, count(*) AS candidates, round(avg(CAST(label <> query_label AS INTEGER)), 6) AS rate FROM ranked WHERE vector_rank <= 5",
        "hit_at_k": _OTHERS + ", h AS (SELECT query_id, CAST(min(vector_rank) FILTER (WHERE label = query_label) AS INTEGER) AS hit_rank FROM ranked GROUP BY query_id) SELECT *, coalesce(hit_rank <= 1, false) AS hit_at_1, coalesce(hit_rank <= 3, false) AS hit_at_3, coalesce(hit_rank <= 5, false) AS hit_at_5 FROM h",
        "benchmark_grades": " UNION ALL ".join(
            f"""SELECT * FROM (WITH {_CHUNKS.replace("{scope}", "WHERE vec_id <> query_id" + own)}, g AS (SELECT query_id, {rank} AS r, CAST(chunk_id AS BIGINT) AS v FROM ranked WHERE query_id % 7 <> 0),
              h AS (SELECT query_id, CAST(min(r) FILTER (WHERE v % 4 = query_id % 4 AND query_id % 30 BETWEEN v % 30 AND v % 30 + 9
                AND contains('chunk 2024 年5 月' || CAST(v % 28 + 1 AS VARCHAR) || ' 日', '月' || CAST(query_id % 3 + 1 AS VARCHAR))) AS INTEGER) AS hit_rank FROM g GROUP BY query_id)
              SELECT '{scope}' AS scope, query_id, '{rank}' AS ranked_by, hit_rank, coalesce(hit_rank <= 1, false) AS hit_at_1, coalesce(hit_rank <= 3, false) AS hit_at_3, coalesce(hit_rank <= 5, false) AS hit_at_5 FROM h)"""
            for scope, own in (("all_documents", ""), ("document_scoped", " AND vec_id % 4 = query_id % 4")) for rank in ("vector_rank", "hybrid_rank")
        ),
        "keyword_coverage": """WITH k AS (SELECT DISTINCT conv_id AS query_id, w FROM conversations, (SELECT unnest(['the', 'tion', 'que']) AS w)),
            m AS (SELECT k.query_id, k.w, coalesce(bool_or(contains(c.text, k.w)), false) AS found FROM k LEFT JOIN conversations c ON c.conv_id = k.query_id AND c.turn + 1 <= 3 GROUP BY 1, 2),
            s AS (SELECT query_id, count(*) FILTER (WHERE found)::DOUBLE / count(*)::DOUBLE AS c FROM m GROUP BY 1) SELECT query_id, round(c, 6) AS coverage, c >= CAST(0.6 AS DOUBLE) AS success FROM s""",
        "keyword_coverage_many": """WITH k AS (SELECT DISTINCT conv_id AS query_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM conversations WHERE turn = 0),
            m AS (SELECT k.query_id, k.w, coalesce(bool_or(contains(c.text, k.w)), false) AS found FROM k LEFT JOIN conversations c ON c.conv_id = k.query_id AND c.turn BETWEEN 1 AND 3 GROUP BY 1, 2),
            s AS (SELECT query_id, count(*) FILTER (WHERE found)::DOUBLE / count(*)::DOUBLE AS c FROM m GROUP BY 1) SELECT query_id, round(c, 6) AS coverage, c >= CAST(0.2 AS DOUBLE) AS success FROM s""",
        "date_candidates": f"WITH {_ASKED_DATES} SELECT o_orderkey, place, CAST(year(asked) AS INTEGER) AS year, CAST(month(asked) AS INTEGER) AS month, CAST(day(asked) AS INTEGER) AS day FROM e",
        "table_question": f"WITH {_ASKED_DATES} SELECT o_orderkey, more AS is_table_question FROM d",
        "range_overlap": """SELECT l_returnflag, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY AND o_orderdate <= l_shipdate + INTERVAL 10 DAY GROUP BY l_returnflag""",
        "case_time_range": f"""WITH {ENERGY}, d AS (SELECT DISTINCT dataset_id, CAST("timestamp" AS DATE) AS day FROM e)
            SELECT CAST(d.dataset_id AS VARCHAR) || '-' || strftime(day, '%Y-%m-%d') AS case_id, count(*) AS readings, max(load_kw) AS peak_load_kw
            FROM d JOIN e ON e.dataset_id = d.dataset_id AND e."timestamp" BETWEEN day + INTERVAL 6 HOUR AND day + INTERVAL 60 HOUR GROUP BY 1""",
        "case_evidence": f"""WITH {ENERGY}, a AS ({anomalies}), c AS (SELECT [{", ".join(f"'{n}'" for n in RULES)}][vec_id % {len(RULES)} + 1] AS rule, count(*) AS cases FROM embeddings GROUP BY 1)
            SELECT a.rule, severity, count(*) AS readings, any_value(cases) AS cases FROM a JOIN c ON a.rule = c.rule GROUP BY 1, 2""",
        "evidence_answers": f"""WITH {ENERGY}, a AS ({anomalies}), f AS (SELECT dataset_id, site_id, CAST("timestamp" AS DATE) AS day, rule, count(*) AS readings FROM a GROUP BY ALL),
            c AS (SELECT vec_id, [{", ".join(f"'{n}'" for n in RULES)}][vec_id % {len(RULES)} + 1] AS rule, 'cause_' || CAST(vec_id % 7 AS VARCHAR) AS cause, 'action_' || CAST(vec_id % 3 AS VARCHAR) AS action FROM embeddings),
            k AS (SELECT rule, count(*) AS cases FROM c GROUP BY 1),
            i AS (SELECT rule, string_agg('case:' || CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids FROM (SELECT rule, vec_id FROM c QUALIFY row_number() OVER (PARTITION BY rule ORDER BY vec_id) <= 5) GROUP BY 1),
            x AS (SELECT rule, string_agg(cause || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, cause) AS causes FROM (SELECT rule, cause, count(*) AS n FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY rule ORDER BY count(*) DESC, cause) <= 5) GROUP BY 1),
            y AS (SELECT rule, string_agg(action || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, action) AS actions FROM (SELECT rule, action, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
            p AS (SELECT [{", ".join(f"'{n}'" for n in RULES)}][2 * (doc_id % 4) + 1] AS rule, count(*) AS passages,
              string_agg('document:' || source || ' p. ' || CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + 1 AS VARCHAR), ',' ORDER BY doc_id) AS pages FROM documents WHERE doc_id // 4 + 1 <= doc_id % 4 + 1 GROUP BY 1)
            SELECT dataset_id, site_id, day, f.rule, readings, coalesce(cases, 0) AS cases, CAST(coalesce(passages, 0) AS INTEGER) AS passages, causes, actions,
              CASE WHEN cases IS NULL AND passages IS NULL THEN 'insufficient data' WHEN cases IS NULL OR passages IS NULL THEN 'low' WHEN least(cases, passages) < 2 THEN 'medium' ELSE 'high' END AS confidence,
              'dataset:' || CAST(dataset_id AS VARCHAR) || coalesce(',' || ids, '') || coalesce(',' || pages, '') AS citations
            FROM f LEFT JOIN p ON f.rule = p.rule LEFT JOIN k ON f.rule = k.rule LEFT JOIN i ON f.rule = i.rule LEFT JOIN x ON f.rule = x.rule LEFT JOIN y ON f.rule = y.rule""",
        "case_similarity": f"""WITH c AS (SELECT doc_id AS case_id, source AS event_type, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS symptoms, ['lang ' || lang, 'part ' || CAST(doc_id % 40 AS VARCHAR)] AS tags, 'cause ' || CAST(doc_id % 30 AS VARCHAR) AS root_cause, 'action ' || CAST(doc_id % 25 AS VARCHAR) AS operator_action FROM documents),
            t AS (SELECT case_id, 'symptoms' AS field, unnest(symptoms) AS term FROM c UNION ALL SELECT case_id, 'tags', unnest(list_filter(tags, lambda x: x IS NOT NULL)) FROM c UNION ALL SELECT case_id, 'root_cause', unnest(string_split(root_cause, ' ')) FROM c UNION ALL SELECT case_id, 'operator_action', unnest(string_split(operator_action, ' ')) FROM c),
            k AS (SELECT field, term, CAST(round(1000 * ln(CAST(1 AS DOUBLE) + CAST((SELECT count(*) FROM c) AS DOUBLE) / count(*))) AS BIGINT) AS w FROM t GROUP BY 1, 2),
            p AS (SELECT case_id, t.field, t.term, w FROM t JOIN k ON t.field = k.field AND t.term = k.term),
            o AS (SELECT case_id, field, sum(w) AS own FROM p GROUP BY 1, 2),
            m AS (SELECT q.case_id AS query_id, p.case_id, p.field, sum(p.w) AS both_ FROM p q JOIN p ON q.field = p.field AND q.term = p.term AND q.case_id <> p.case_id WHERE q.case_id % 10 = 0 GROUP BY 1, 2, 3),
            l AS (SELECT query_id, m.case_id, m.field, CAST(both_ AS DOUBLE) / CAST(a.own + b.own - both_ AS DOUBLE) AS likeness FROM m JOIN o a ON a.case_id = query_id AND a.field = m.field JOIN o b ON b.case_id = m.case_id AND b.field = m.field),
            s AS (SELECT query_id, case_id, {", ".join(f"coalesce(max(likeness) FILTER (WHERE field = '{f}'), CAST(0 AS DOUBLE)) AS {f}" for f in FIELDS)} FROM l GROUP BY 1, 2),
            e AS (SELECT s.*, CAST(coalesce(x.event_type = y.event_type, false) AS DOUBLE) AS event_type FROM s JOIN c x ON x.case_id = query_id JOIN c y ON y.case_id = s.case_id),
            r AS (SELECT *, CAST({EVENT_TYPE} AS DOUBLE) * event_type + {" + ".join(f"CAST({w} AS DOUBLE) * {f}" for f, w in FIELDS.items())} AS score FROM e),
            n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM r)
            SELECT query_id, case_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, concat_ws(',', {", ".join(f"CASE WHEN {f} > 0 THEN '{f}' END" for f in ("event_type", *FIELDS))}) AS matching,
              concat_ws(',', {", ".join(f"CASE WHEN NOT {f} > 0 THEN '{f}' END" for f in ("event_type", *FIELDS))}) AS differing FROM n WHERE rank <= 5""",
    }
    found["indexed_topk"] = found["vector_topk"]
    return found | {q: _rule(r) for q, r in RULE_QUERIES.items()}


_STATUS_PAGES = f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t, least(CAST(doc_id % 12 AS DOUBLE) * CAST(10 AS DOUBLE) / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS coverage FROM documents),
  n AS (SELECT doc_id, CAST(length({_TRIM("t")}) AS INTEGER) AS char_count, coverage FROM s),
  c AS (SELECT *, CASE WHEN char_count >= 20 THEN 'text' WHEN coverage >= 0.5 THEN 'scanned' ELSE 'near_empty' END AS page_status FROM n)"""
