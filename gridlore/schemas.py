"""Fixed schemas and value lists of the energy and document tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the columns below.
FLOAT_COLUMNS = [
    "pv_forecast_kw", "pv_actual_kw", "load_kw", "load_forecast_kw", "battery_soc", "battery_power_kw",
    "battery_temperature", "electricity_price", "contract_capacity_kw", "grid_import_kw", "grid_export_kw", "ghi",
    "temperature", "humidity", "battery_soh", "battery_equivalent_cycle", "battery_rated_capacity_kwh",
    "battery_available_capacity_kwh",
]
#: Canonical order of a stored row.
ENERGY_COLUMNS = [
    "timestamp", "site_id", "pv_forecast_kw", "pv_actual_kw", "load_kw", "load_forecast_kw", "battery_soc",
    "battery_power_kw", "battery_temperature", "electricity_price", "contract_capacity_kw", "grid_import_kw",
    "grid_export_kw", "weather_condition", "ghi", "temperature", "humidity", "ems_mode", "equipment_status",
    "battery_soh", "battery_cycle_count", "battery_equivalent_cycle", "battery_health_status", "battery_is_second_life",
    "battery_rated_capacity_kwh", "battery_available_capacity_kwh",
]
REQUIRED_COLUMNS = ["timestamp", "site_id"]
#: An upload holds at least one column of these groups.
BASIC_COLUMNS = {
    "pv": ["pv_forecast_kw", "pv_actual_kw"],
    "load": ["load_kw", "load_forecast_kw"],
    "battery": ["battery_soc", "battery_power_kw"],
    "price": ["electricity_price"],
}
#: The numeric columns of a summary, derived so that they cannot drift from the stored ones.
SUMMARY_COLUMNS = [c for c in ENERGY_COLUMNS if c in FLOAT_COLUMNS or c == "battery_cycle_count"]

# Enumerations.
HEALTH_STATUSES = ["normal", "warning", "critical", "unknown"]
EMS_MODES = ["auto", "manual", "schedule", "tou_arbitrage", "peak_shaving", "self_consumption", "idle", "fallback", "error", "unknown"]
EQUIPMENT_STATUSES = ["normal", "warning", "fault", "error", "offline", "maintenance", "unknown"]
ANOMALY_SEVERITIES = ["warning", "critical"]
CASE_SEVERITIES = ["low", "medium", "high", "critical"]


def _kind(column: str) -> T.DataType:
    if column in FLOAT_COLUMNS:
        return T.DoubleType()
    return {"timestamp": T.TimestampNTZType(), "battery_cycle_count": T.IntegerType(), "battery_is_second_life": T.BooleanType()}.get(column, T.StringType())


ENERGY = T.StructType([T.StructField(c, _kind(c)) for c in ENERGY_COLUMNS])
SERIES = T.StructType([T.StructField("id", T.LongType()), T.StructField("dataset_id", T.LongType()), *ENERGY.fields])
_TYPES = {
    "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType()),
    "vector": T.ArrayType(T.FloatType()), "labels": T.MapType(T.StringType(), T.StringType()),
    "location": T.StructType(
        [T.StructField("pdf_page_number", T.IntegerType()), T.StructField("printed_page_number", T.StringType()), T.StructField("section_title", T.StringType())]
    ),
}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in columns.split(", "))])


WARNING = _struct("row int, column string, issue string, action string")
DATASETS = _struct(
    "id long, name string, file_name string, description string, row_count int, start_time timestamp_ntz, end_time timestamp_ntz, created_at timestamp"
)
PAGES = _struct(
    "source_filename string, page_index int, pdf_page_number int, printed_page_number string, section_title string, "
    "page_status string, extraction_method string, text string, char_count int, image_coverage_ratio double"
)
CHUNKS = _struct(
    "chunk_id string, source_filename string, chunk_type string, text string, char_count int, page_index_start int, "
    "page_index_end int, pdf_page_number_start int, pdf_page_number_end int, printed_page_number_list strings, "
    "section_title string, strategy_name string, table_title string"
)
DOCUMENTS = _struct(
    "id long, filename string, document_content_hash string, total_pages int, created_at timestamp, supersedes_document_id long"
)
STORED_CHUNKS = _struct(
    "chunk_id string, document_id long, strategy_name string, chunk_type string, text string, page_index_start int, page_index_end int, "
    "pdf_page_number_start int, pdf_page_number_end int, printed_page_number_map labels, section_title string, table_title string, "
    "embedding_content_hash string, chunk_metadata_hash string, embedding vector, embedding_provider string, embedding_model string, "
    "embedding_dimensions int, embedding_model_version string, embedded_at timestamp, is_active boolean, created_at timestamp, updated_at timestamp"
)
QUESTIONS = _struct(
    "id string, question string, source_document string, verification_tier string, retrieval_eval_eligible boolean, eligibility_reason string, "
    "retrieval_target string, expected_location location, "
    "expected_content_keywords strings, multi_chunk_coverage_threshold double, false_positive_control boolean"
)
CASES = _struct(
    "case_id string, site_id string, event_time timestamp_ntz, event_type string, symptoms string, root_cause string, operator_action string, "
    "resolution_result string, severity string, tags string, related_dataset_id long, related_time_range string"
)


def assert_schema(df, schema: T.StructType, finite: bool = False) -> None:
    """Raise ``ValueError`` unless ``df`` has the schema's columns and types; with ``finite``, only finite numbers or null."""
    got = {f.name: f.dataType for f in df.schema}
    for f in schema:
        if got.get(f.name) != f.dataType:
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} expected, {got[f.name].simpleString() if f.name in got else 'nothing'} found")
    if finite and (names := [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]):
        from pyspark.sql import functions as F

        odd = lambda c: F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c)
        counts = df.agg(*map(odd, names)).first().asDict()
        if bad := [f"{n} ({k})" for n, k in counts.items() if k]:
            raise ValueError(f"numbers that are not finite: {', '.join(bad)}")
